"""Language by prediction by partial matching: whose statistics write the text in the fewest bits.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that
followed them. A byte is coded in the longest context that the language has seen: a seen byte with
n_b / (n + u), where n bytes and u different ones followed, any other byte by an escape of
u / (n + u) and then in the next shorter context, where bytes of the longer one are excluded; at the end
stand all 256 bytes, equally likely. The statistics are frozen after the fit, so a text's code
length is a sum of table entries, and the shortest one names the language.

The trees of all languages are laid over each other as one automaton. Its state is the longest context
known to any language, a step takes one byte, and every state and byte has one code length per
language. Tasks walk it over many short pieces of text at once; a piece begins with the ``ORDER`` bytes
before it, which settle its state.

Letters A-Z count as a-z, digits as one byte, runs of blanks as one blank. Null texts and texts without
a letter are ``und`` with score 0, as are all texts if nothing could be learned; a null id counts as
the empty text in the fold; repeated rows are scored as often as they stand, and other columns ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorta.llm.common import raw_texts

ORDER = 4
#: Rows that a fit may use, shared by the languages; each gives up to FIT_BYTES bytes from anywhere in its text.
FIT_ROWS = 4_000
FIT_BYTES = 2_048
#: Languages that can be learned; of more, the most frequent ones are.
FIT_LANGUAGES = 200
#: Entries (states times bytes times languages) of the automaton, which is broadcast.
TABLE_ENTRIES = 2_000_000
#: A context stays in the trees if so many bytes followed it in the sample.
LEAST_COUNT = 4
SEED = 13
#: Bytes of text in a piece, and pieces that are walked at once.
PIECE = 256
LANES = 4_096
UNKNOWN = "und"

#: Byte classes: lower case, one digit, one blank.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c <= 32 else c for c in range(256)
)


def folded(text: bytes) -> bytes:
    return b" ".join(text.translate(_FOLD).split())


class ContextModel:
    """The automaton: ``step`` and ``bits`` by state and byte class; plain arrays, so tasks can load it."""

    def __init__(self, languages: list[str], classes: np.ndarray, step: np.ndarray, bits: np.ndarray):
        self.languages, self.classes, self.step, self.bits = languages, classes, step, bits

    def code_lengths(self, texts: Sequence[bytes]) -> np.ndarray:
        """Bits per text and language."""
        out = np.zeros((len(texts), len(self.languages)))
        lanes: list[tuple[int, bytes, int]] = []
        for row, text in enumerate(texts):
            raw = folded(text)
            for at in range(0, len(raw), PIECE):
                lead = min(at, ORDER)
                lanes.append((row, raw[at - lead : at + PIECE], lead))
                if len(lanes) == LANES:
                    self._walk(lanes, out)
                    lanes = []
        if lanes:
            self._walk(lanes, out)
        return out

    def _walk(self, lanes: list[tuple[int, bytes, int]], out: np.ndarray) -> None:
        lanes = sorted(lanes, key=lambda x: -len(x[1]))
        sizes = np.array([len(raw) for _, raw, _ in lanes])
        grid = np.zeros((len(lanes), sizes[0]), np.uint8)
        for k, (_, raw, _) in enumerate(lanes):
            grid[k, : len(raw)] = np.frombuffer(raw, np.uint8)
        grid = self.classes[grid].T.copy()
        lead = np.array([skip for _, _, skip in lanes])
        width = self.step.shape[1]
        step, bits = self.step.ravel(), self.bits
        state = np.zeros(len(lanes), np.int64)
        total = np.zeros((len(lanes), len(self.languages)))
        alive = len(lanes)
        for t in range(sizes[0]):
            while sizes[alive - 1] <= t:
                alive -= 1
            at = state[:alive] * width + grid[t, :alive]
            cost = bits.take(at, axis=0)
            if t < ORDER:
                cost = np.where((t >= lead[:alive])[:, None], cost, 0)
            total[:alive] += cost
            state[:alive] = step.take(at)
        np.add.at(out, np.array([row for row, _, _ in lanes]), total)


def _tree_counts(sample: Sequence[bytes]) -> dict[bytes, dict[int, int]]:
    """Per context of up to ORDER bytes: how often each byte followed. Texts begin with a blank's context."""
    found: dict[bytes, dict[int, int]] = {}
    raws = [np.frombuffer(raw, np.uint8).astype(np.int64) for raw in sample if raw]
    for n in range(ORDER + 1):
        keys = [sum((raw[k : len(raw) - n + k] << (8 * (n - k)) for k in range(n + 1)), np.zeros(len(raw) - n, np.int64)) for raw in raws if len(raw) > n]
        if not keys:
            continue
        grams, counts = np.unique(np.concatenate(keys), return_counts=True)
        for gram, count in zip(grams.tolist(), counts.tolist()):
            followed = found.setdefault((gram >> 8).to_bytes(n, "big"), {})
            followed[gram & 255] = count
    return found


def fit_contexts(sample: Sequence[tuple[str, bytes]]) -> ContextModel | None:
    """Trees from (language, text) pairs, laid over each other; None without any letter to learn from."""
    by_language: dict[str, list[bytes]] = {}
    for language, text in sample:
        if raw := folded(text):
            by_language.setdefault(language, []).append(raw)
    if not by_language:
        return None
    languages = sorted(by_language)
    trees = [_tree_counts(by_language[name]) for name in languages]
    known = sorted({b for tree in trees for b in tree[b""]})
    classes = np.full(256, len(known), np.uint8 if len(known) < 256 else np.int64)
    classes[known] = np.arange(len(known))
    width = len(known) + 1  # the last class holds the bytes that the sample lacks
    # The most used contexts of all languages, each with all its suffixes, are the states.
    weight: dict[bytes, int] = {}
    for tree in trees:
        for context, followed in tree.items():
            weight[context] = max(weight.get(context, 0), sum(followed.values()))
    room = max(1, TABLE_ENTRIES // (width * len(languages)))
    ranked = sorted((c for c, n in weight.items() if n >= LEAST_COUNT or not c), key=lambda c: (len(c) > 0, -weight[c], len(c), c))
    # A suffix is at least as frequent as its context and shorter, so it is in front of it.
    states = sorted(ranked[:room], key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(states)}
    size = np.array([len(c) for c in states])
    parent = np.array([number[c[1:]] if c else 0 for c in states])
    step = np.zeros((len(states), width), np.int32)
    for context, i in number.items():
        if context:  # beginnings of a context are as frequent and shorter, so they are states, too
            step[number[context[:-1]], classes[context[-1]]] = i
    # States are in order of length, so the shorter context's row is ready.
    for i, context in enumerate(states):
        if context:
            step[i] = np.where(step[i] == 0, step[parent[i]], step[i])
    bits = np.empty((len(states), width, len(languages)), np.float32)
    flat = np.full(width, 1 / 256)
    flat[-1] = (256 - len(known)) / 256
    for z, tree in enumerate(trees):
        counts = np.zeros((len(states), width))
        for i, context in enumerate(states):
            followed = tree.get(context)
            if followed and sum(followed.values()) >= LEAST_COUNT or not context:
                counts[i, classes[list(followed)]] = list(followed.values())
        chance = np.empty((len(states), width))
        for n in range(size.max() + 1):
            at = np.flatnonzero(size == n)
            below = chance[parent[at]] if n else np.tile(flat, (len(at), 1))
            seen = counts[at] > 0
            total, kinds = counts[at].sum(1, keepdims=True), seen.sum(1, keepdims=True)
            left = np.where(seen, 0, below)
            rest = left.sum(1, keepdims=True)
            # Without a byte to escape to, nothing is set aside for the escape.
            spare = np.where(rest > 0, kinds, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                coded = np.where(seen, counts[at] / (total + spare), spare / (total + spare) * left / np.where(rest > 0, rest, 1))
            chance[at] = np.where(total > 0, coded, below)
        bits[:, :, z] = -np.log2(chance / np.append(np.ones(width - 1), max(256 - len(known), 1)))
    return ContextModel(languages, classes, step, bits.reshape(-1, len(languages)))


def language_sample(docs: DataFrame, learn: Column, rows: int = FIT_ROWS) -> list[tuple[str, bytes]]:
    """At most ``rows`` (language, part of a text) pairs of rows that may be learned from.

    Every language gives the same number of rows, chosen by a hash of id and text; repeated rows count once,
    and the part of a long text starts where its hash says. Of more than FIT_LANGUAGES languages the most frequent are learned.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    found = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(FIT_LANGUAGES).collect()
    if not found:
        return []
    quota = max(1, rows // len(found))
    # Some more rows than are needed pass by their hash, so no language gathers all its rows in one task.
    shares = F.create_map(*[F.lit(x) for r in found for x in (r.lang, min(1.0, (2 * quota + 50) / r["count"]))])
    key = F.xxhash64(F.lit(SEED), "doc_id", "text")
    size = F.length("text")
    start = F.when(size > FIT_BYTES, F.pmod("key", size - FIT_BYTES)).otherwise(0).cast("int") + 1
    passed = (
        usable.select("lang", "text", key.alias("key"))
        .where(F.pmod("key", F.lit(1 << 20)) < shares[F.col("lang")] * (1 << 20))
        .groupBy("lang", "key")
        .agg(F.first(F.substring("text", start, F.lit(FIT_BYTES))).alias("part"))
    )
    picked = passed.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("place") <= quota)
    got = picked.select("lang", "part").toArrow()
    return sorted(zip(got["lang"].to_pylist(), got["part"].cast(pa.binary()).to_pylist()))


def in_fold(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds) == fold


def identify_languages(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) per row.

    ``score`` is the probability of the language, all learned ones being equally likely before the text
    is read; ``bits_per_byte`` the length of its code, null for ``und``.
    """
    held = F.lit(False) if held_out is None else held_out
    model = fit_contexts(language_sample(docs, ~held))
    rows = docs.select("doc_id", held.alias("held_out"), F.when(F.col("text").rlike("\\p{L}"), F.col("text")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, bits_per_byte double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield _predicted(fitted, part)

    return rows.mapInArrow(scan, schema)


def _predicted(model: ContextModel | None, part: pa.RecordBatch) -> pa.RecordBatch:
    names, scores, rates = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), [None] * part.num_rows
    at = np.flatnonzero(part.column("text").is_valid().to_numpy(zero_copy_only=False))
    if model is not None and len(at):
        texts = list(raw_texts(part.column("text").take(pa.array(at))))
        lengths = model.code_lengths(texts)
        best = lengths.argmin(1)
        gap = lengths - lengths[np.arange(len(at)), best][:, None]
        scores[at] = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
        for i, z, text, row in zip(at.tolist(), best.tolist(), texts, lengths):
            names[i] = model.languages[z]
            rates[i] = float(row[z]) / max(len(text), 1)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), part.column("held_out"), pa.array(names), pa.array(scores), pa.array(rates, pa.float64())],
        names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
    )
