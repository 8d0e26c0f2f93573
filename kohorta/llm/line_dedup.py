"""Line deduplication by winnowing over line hashes.

The lines of a document are a sequence of hashes. Of every ``window`` neighbouring k-grams of lines
the smallest is selected as a fingerprint, once for all windows it is the smallest of, so any run of
``window + gram - 1`` lines that stands in two places has a fingerprint in common. A line of ``LONG_BYTES``
bytes or more is a fingerprint of its own as well, so a passage that is one line is found between any
neighbours. Only fingerprints and their positions leave the texts. They are joined; what occurs more than
once is extended both ways, by the lines before and after it that its windows reach, and extensions
that agree with an earlier place are repeats. Those that follow each other make up one stretch. Lines of
later repeats are deleted, the first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import boxed, raw_texts, unboxed
from kohorta.session import written

#: Lines hashed together, and k-grams of which one is selected; runs of GRAM + WINDOW - 1 are found.
GRAM = 1
WINDOW = 2
#: Bytes of a line that is a repeat by itself. A line of more than 50 words has more, in any language.
LONG_BYTES = 100


def content_lines(raw: bytes) -> tuple[list[bytes], list[int]]:
    """Stripped lines that are not blank, and their numbers among all lines."""
    stripped = [line.strip() for line in raw.split(b"\n")]
    at = [i for i, line in enumerate(stripped) if line]
    return [stripped[i] for i in at], at


def _fingerprints(raw: bytes, gram: int, window: int, long_bytes: int) -> list[tuple[int, int, bytes]]:
    """(place, fingerprint, reach) of every window minimum and of every long line.

    The windows with one minimum begin at neighbouring lines. ``reach`` holds a digest of 16 bytes for
    the run of ``gram + window - 1`` lines of each: the fingerprint extended to the left by fewer and fewer
    lines and to the right by more and more. The place is the first line of the first run, doubled, plus one
    for a line that stands for itself. No line holds a line break, so a line and a run differ in digest.
    """
    lines, _ = content_lines(raw)
    size = gram + window - 1
    found = []
    if len(lines) >= size:
        joined = [b"\n".join(lines[i : i + gram]) for i in range(len(lines) - gram + 1)]
        grams = np.array([xxhash.xxh3_64_intdigest(g) for g in joined], np.uint64)
        chosen = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(axis=1)
        chosen += np.arange(len(chosen))
        # Of equal minima the first is taken, so the chosen places never go back.
        edges = [0, *(np.flatnonzero(np.diff(chosen)) + 1).tolist(), len(chosen)]
        values = grams.view(np.int64)[chosen[edges[:-1]]].tolist()
        for low, high, fp in zip(edges, edges[1:], values):
            runs = [xxhash.xxh3_128_digest(b"\n".join(lines[i : i + size])) for i in range(low, high)]
            found.append((2 * low, fp, b"".join(runs)))
    if size > 1:
        for i, line in enumerate(lines):
            if len(line) >= long_bytes:
                digest = xxhash.xxh3_128_digest(line)
                found.append((2 * i + 1, int.from_bytes(digest[:8], "little", signed=True), digest))
    return found


def _fingerprint_rows(gram: int, window: int, long_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, mark, place, fp, reach)
                for doc_id, mark, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)))
                for place, fp, reach in _fingerprints(raw, gram, window, long_bytes)
            ]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "mark", "place", "fp", "reach"]
            )

    return run


def _without(text: str | None, places, size: int) -> tuple[str | None, int, int, int]:
    """Text without the lines of the given runs and long lines; its content lines, deleted lines and deleted stretches."""
    raw = (text or "").encode()
    lines, at = content_lines(raw)
    if places is None or not len(places):
        return text, len(lines), 0, 0
    gone = np.zeros(len(lines), bool)
    for place in places:
        i = place >> 1
        gone[i : i + (1 if place & 1 else size)] = True
    stretches = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    dropped = {at[i] for i in np.flatnonzero(gone)}
    kept = [line for i, line in enumerate(raw.split(b"\n")) if i not in dropped]
    return b"\n".join(kept).decode(), len(lines), int(gone.sum()), stretches


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Documents with later repeats of runs of lines deleted from ``text``; all rows and columns stay.

    A run is ``gram + window - 1`` lines in a row, or one line of ``long_bytes`` bytes (UTF-8) or more,
    blank lines and white space at line ends aside; it is a later repeat if the same run stands earlier: in a document with a smaller id (null first), or
    earlier in the same document. Rows with the same id and text count as one document, so none of
    them is the later one; equal ids with different texts are ordered by a hash of the text. Null texts
    stay null. Added columns, replacing any of these names: n_lines (not blank), n_removed, n_runs.
    """
    size = gram + window - 1
    rows = boxed(docs).withColumns({"doc_id": F.col("row.doc_id").cast("bigint"), "mark": F.xxhash64("row.text")})
    slim = rows.select("doc_id", "mark", F.col("row.text").alias("text"))
    schema = "doc_id bigint, mark bigint, place int, fp bigint, reach binary"
    marks = written(slim.mapInArrow(_fingerprint_rows(gram, window, long_bytes), schema), "line-fingerprints")
    # Counts and first places are written before they are joined: no aggregate then stands between
    # shuffle and join, and a fingerprint that a third of the documents share can be split.
    shared = written(marks.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "line-repeated")
    steps = F.sequence(F.lit(0), (F.octet_length("reach") / 16).cast("int") - 1)
    extended = marks.join(shared, "fp").withColumn("i", F.explode(steps)).select(
        "doc_id", "mark", (F.col("place") + 2 * F.col("i")).alias("place"), F.expr("substring(reach, 16 * i + 1, 16)").alias("digest")
    )
    extended = written(extended, "line-extended")
    where = F.struct("doc_id", "mark", "place")
    first = extended.groupBy("digest").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = written(first.select("digest", "first"), "line-first-places")
    later = extended.join(first, "digest").where(where > F.col("first"))
    per_doc = later.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("place")).alias("places"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "id", "mark": "own"})

    @F.pandas_udf("text string, n_lines int, n_removed int, n_runs int")
    def cut(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = [_without(t, p, size) for t, p in zip(texts, places)]
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed", "n_runs"])

    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("mark").eqNullSafe(F.col("own")), "left")
    # Later filters on its numbers would have every text cut twice, were the function deterministic.
    once = cut.asNondeterministic()
    done = joined.withColumn("cut", once(F.col("row.text"), F.col("places")))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    return done.select(*unboxed(names, text=F.col("cut.text")), "cut.n_lines", "cut.n_removed", "cut.n_runs")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` after :func:`dedup_lines`, without those that lost all their lines."""
    taken = [c for c in docs.columns if c in ("n_lines", "n_removed", "n_runs")]
    done = dedup_lines(docs.withColumnsRenamed({c: f"{c} of input" for c in taken}))
    kept = done.where("n_removed = 0 or n_removed < n_lines").drop("n_lines", "n_removed", "n_runs")
    return kept.withColumnsRenamed({f"{c} of input": c for c in taken})
