"""Document fingerprints as homomorphic multiset hashes of paragraphs.

Each paragraph (a non-empty line) is hashed to a wide vector, and a document's fingerprint is the sum
of its paragraphs' vectors modulo powers of two. So the order of paragraphs does not matter, and a
paragraph is inserted or deleted by adding or subtracting its vector, without the other text.

A vector has two parts. The exact part holds lanes modulo 2**64 spread from a 128-bit hash of the
paragraph; two texts with the same multiset of paragraphs agree in it, others do not but by accident.
The likeness part holds lanes modulo 2**24, where every byte n-gram of the paragraph adds one, with
a sign, to one lane. Differences of such sums estimate how many n-grams differ, which gives a likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import shuffle_partitions

EXACT_LANES = 16
LIKE_LANES = 256
LIKE_MODULUS = 1 << 24
#: Bytes of an n-gram; a paragraph too short for one gives each byte with its position.
GRAM = 8

_SPREAD = np.arange(1, EXACT_LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Fingerprint:
    """The two summed parts; ``+`` inserts and ``-`` deletes the paragraphs of another fingerprint."""

    __slots__ = ("exact", "like")

    def __init__(self, exact: np.ndarray, like: np.ndarray):
        self.exact, self.like = exact, like % LIKE_MODULUS

    def __add__(self, other: Fingerprint) -> Fingerprint:
        with np.errstate(over="ignore"):
            return Fingerprint(self.exact + other.exact, self.like + other.like)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        with np.errstate(over="ignore"):
            return Fingerprint(self.exact - other.exact, self.like - other.like)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.to_text() == other.to_text()

    __hash__ = None

    def signed(self) -> np.ndarray:
        return np.where(self.like >= LIKE_MODULUS // 2, self.like - LIKE_MODULUS, self.like).astype(np.float64)

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets, else about twice the shared share of n-grams, within 0 and 1."""
        if np.array_equal(self.exact, other.exact):
            return 1.0
        a, b = self.signed(), other.signed()
        total = float(a @ a + b @ b)
        return min(1.0, max(0.0, 2.0 * float(a @ b) / total)) if total else 0.0

    def to_text(self) -> str:
        like = self.like.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        return base64.b64encode(self.exact.astype("<u8").tobytes() + like.tobytes()).decode()

    @classmethod
    def from_text(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        like = np.zeros((LIKE_LANES, 4), np.uint8)
        like[:, :3] = np.frombuffer(raw, np.uint8, offset=8 * EXACT_LANES).reshape(-1, 3)
        return cls(np.frombuffer(raw, "<u8", EXACT_LANES).copy(), like.view("<u4").reshape(-1).astype(np.int64))


def _exact_part(paragraphs: list[bytes]) -> np.ndarray:
    if not paragraphs:
        return np.zeros(EXACT_LANES, np.uint64)
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in paragraphs), "<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        lanes = _mixed(digests[:, :1] + _SPREAD) ^ _mixed(digests[:, 1:] * _SPREAD)
        return lanes.sum(axis=0, dtype=np.uint64)


def _like_part(raw: bytes, paragraphs: list[bytes]) -> np.ndarray:
    grams = np.empty(0, np.uint64)
    if len(raw) >= GRAM:
        grams = np.ndarray((len(raw) - GRAM + 1,), "<u8", raw, strides=(1,))
        ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        if len(ends):
            inside = np.ones(len(grams), bool)
            for back in range(GRAM):
                at = ends - back
                inside[at[(at >= 0) & (at < len(grams))]] = False
            grams = grams[inside]
    short = [xxhash.xxh3_64_intdigest(bytes((i, c))) for p in paragraphs if len(p) < GRAM for i, c in enumerate(p)]
    if short:
        grams = np.concatenate([grams, np.array(short, np.uint64)])
    with np.errstate(over="ignore"):
        h = grams * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    # The top bit is the sign, the next bits are the lane.
    slots = np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=2 * LIKE_LANES)
    return slots[:LIKE_LANES] - slots[LIKE_LANES:]


def fingerprint(text: str | None) -> Fingerprint:
    """Fingerprint of one text; null and empty texts have the zero vector."""
    raw = (text or "").encode()
    paragraphs = [p for p in raw.split(b"\n") if p]
    return Fingerprint(_exact_part(paragraphs), _like_part(raw, paragraphs))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; equal texts get equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(t).to_text() for t in texts], pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


def edited_text(text: str, other: str) -> str:
    """The last third of ``text`` replaced by the first characters of ``other``, as many or all."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


def _unpacked(z: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(z).decode()


def _ranges(bounds: np.ndarray):
    """Rows with the range of their id (0 has the highest ids, nulls the last) and the text packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column(0)
            low = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
            part = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, len(bounds) - low)
            packed = [pack(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, pa.array(packed, pa.binary())], names=["part", "doc_id", "z"])

    return run


def _heads(packed: DataFrame) -> list[tuple[int, bytes]]:
    """The first row of each range that has rows, as (range, packed text)."""
    tops = packed.where("doc_id is not null").groupBy("part").agg(F.max("doc_id").alias("doc_id")).collect()
    found = packed.where(F.col("doc_id").isin([r["doc_id"] for r in tops])).groupBy("part", "doc_id").agg(F.max("z").alias("z"))
    heads = [(r["part"], r["z"]) for r in found.collect()] if tops else []
    nulls = packed.where("doc_id is null").agg(F.max("z").alias("z"), F.max("part").alias("part")).first()
    if nulls["z"] is not None:
        heads.append((nulls["part"], nulls["z"]))
    return sorted((part, bytes(z)) for part, z in heads)


def _edits(heads: list[tuple[int, bytes]]):
    def after(part: int) -> str:
        later = next((z for p, z in heads if p > part), heads[0][1])
        return _unpacked(later)

    def row(doc_id, text: str, mine: Fingerprint, other: str, others: Fingerprint) -> tuple:
        edited = edited_text(text, other)
        changed = fingerprint(edited)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mine.to_text(), changed.to_text(),
            mine.likeness(changed), mine.likeness(others),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next: part, id, text, fingerprint
        for batch in batches:
            out = []
            for part, doc_id, z in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = _unpacked(z)
                mine = fingerprint(text)
                if held:
                    same = held[0] == part
                    other = text if same else after(held[0])
                    out.append(row(*held[1:], other, mine if same else fingerprint(other)))
                held = (part, doc_id, text, mine)
            if out:
                yield _edit_batch(out)
        if held:
            other = after(held[0])
            yield _edit_batch([row(*held[1:], other, fingerprint(other))])

    return run


_EDIT_FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)


def _edit_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _EDIT_FIELDS)], schema=_EDIT_FIELDS)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses to it and to the next text.

    The next document is the one with the next lower id; after the lowest comes the highest. Null ids
    come last; rows with the same id follow each other in a fixed order of their packed texts; a
    single row is its own next. Null texts count as empty, other columns are left out. Rows are dealt
    into ranges of ids, so neighbours meet in one task; what the last row of a range still needs is
    the first row of the next range, one text per range, which is broadcast.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(2, shuffle_partitions(spark))
    found = slim.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    packed = slim.mapInArrow(_ranges(np.unique(np.array(found or [], np.int64))), "part int, doc_id bigint, z binary")
    dealt = packed.repartition(n, "part").sortWithinPartitions("part", F.col("doc_id").desc_nulls_last(), F.col("z").desc())
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return dealt.mapInArrow(_edits(_heads(packed)), schema)
