"""Similarity join of documents on word n-grams as a blocked sparse matrix product.

The rows of the matrix are documents, the columns are n-grams. The product of the matrix with its
transpose holds the overlap of every two documents, but hardly any of it is needed:

1. Column counts, block by block, tell how many n-grams of a document occur elsewhere at all. Less than
   the threshold of its set leaves no room for a link, and nearly all documents are out.
2. Of the rest, equal sets are one row. Columns are ordered by count, rare ones first. Two sets that
   reach the threshold share a column among the first of each, as many as its size leaves room to miss.
   Sets that are connected by such columns, linked or not, are a family.
3. In a large family each set is multiplied with a few pivots first, which its columns name. Sets that
   links to pivots connect are one component, and their other overlaps decide nothing.
4. Within a family, all rows whose sizes allow a link and that are in different components are multiplied,
   block by block, and the overlaps are judged exactly. Only a forest of links leaves a block.

So a family of near copies costs as much as its sets and the few that pivots leave apart. Where pivots
connect nothing, work and shuffle grow with the square of the family's blocks, as exact links need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.llm import blocked
from kohorta.llm.common import boxed, raw_texts, unboxed
from kohorta.operators.density import connected_components
from kohorta.plans.skew import small_table, spread_join
from kohorta.session import written

WORDS = 5
#: Two sets link when PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Sets of a block of rows, and cells of a block of the matrix that is dense while it is multiplied.
BLOCK_ROWS = 256
BLOCK_CELLS = 4_000_000
#: Pivots that a set of a large family is compared with.
PIVOTS = 3
#: Ids that may be broadcast to filter the documents; more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000
#: Words whose hashes a task remembers before it starts anew.
MEMO_WORDS = 200_000

_TAG = "uint16"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes, memo: dict[bytes, int], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; fewer words are one shingle."""
    words = raw.lower().split()  # on bytes: ASCII case and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(memo) > MEMO_WORDS:
        memo.clear()
    for w in set(words):
        if w not in memo:
            memo[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter((memo[w] for w in words), np.uint64, len(words))
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    n = len(h) - size + 1
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, size):
            out = blocked.mixed(out) * _MULTIPLIER + h[j : j + n]
    return np.unique(blocked.mixed(out))


def _set_hash(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(note: bytes) -> pa.Table:
    return pa.ipc.open_stream(note).read_all()


def _combined(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their counts, the place of one entry of each, and each entry's distinct key."""
    distinct, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return distinct, counts, first, inverse


def _document_columns(blocks: int):
    """Entries of documents by block: keys that several documents of a flush share travel once."""
    unwanted = np.iinfo(_TAG).max

    def flushed(nth: int, docs: list[tuple]) -> pa.RecordBatch:
        ids, sets = [d[0] for d in docs], [d[1] for d in docs]
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        keys, counts, first, inverse = _combined(np.concatenate(sets), owner)
        local = np.bincount(owner, weights=counts[inverse] > 1, minlength=len(sets)).astype(np.int64)
        note = _packed(
            pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(local), pa.array([_set_hash(s) for s in sets], pa.binary())],
                names=["doc_id", "n", "shared", "h"],
            )
        )
        tags = np.where(counts > 1, unwanted, owner[first]).astype(_TAG)
        return blocked.column_rows(blocks, blocked.flush_number(note, nth), keys, tags, counts, note)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        held: list[tuple] = []
        entries = nth = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                values = shingles(raw, memo)
                held.append((doc_id, values))
                entries += len(values)
                if entries >= blocked.FLUSH_ENTRIES or len(held) >= blocked.FLUSH_DOCS:
                    yield flushed(nth, held)
                    held, entries, nth = [], 0, nth + 1
        if held:
            yield flushed(nth, held)

    return run


def _document_counts(table: pa.Table) -> pa.Table:
    """(doc_id, n, shared, h) of a flush; ``shared`` bounds the n-grams that occur in other documents."""
    for note, tags, _ in blocked.gathered(table, _TAG):
        docs = _unpacked(note)
        elsewhere = np.bincount(tags, minlength=docs.num_rows)
        shared = docs.column("shared").to_numpy() + elsewhere
        return pa.table({"doc_id": docs["doc_id"], "n": docs["n"], "shared": pa.array(shared, pa.int64()), "h": docs["h"]})


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[bytes, int] = {}
    for batch in batches:
        sets = [shingles(raw, memo) for raw in raw_texts(batch.column(0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_set_hash(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["h", "n", "grams"],
        )


def _set_columns(blocks: int):
    """Entries of distinct sets by block; the note keeps the sets, for choosing their rarest n-grams."""

    def flushed(nth: int, rows: list[tuple]) -> pa.RecordBatch:
        sets = [r[1] for r in rows]
        keys, counts, _, inverse = _combined(np.concatenate(sets), np.empty(0))
        note = _packed(
            pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["h", "grams"]
            )
        )
        return blocked.column_rows(blocks, blocked.flush_number(note, nth), keys, np.arange(len(keys), dtype=np.uint32), counts, note)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        entries = nth = 0
        for batch in batches:
            for h, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((h, np.frombuffer(grams, np.uint64)))
                entries += len(grams) // 8
                if entries >= blocked.FLUSH_ENTRIES:
                    yield flushed(nth, held)
                    held, entries, nth = [], 0, nth + 1
        if held:
            yield flushed(nth, held)

    return run


def _rare_entries(table: pa.Table) -> pa.Table:
    """(g, h, n): the shared n-grams among the first of each set, rare ones first.

    A set of n that misses more than ``n - least`` of its own n-grams cannot link; so one of the first
    ``n - least + 1`` is shared with each partner, where ``least`` is the smallest overlap of a link.
    """
    out_g, out_h, out_n = [], [], []
    for note, tags, counts in blocked.gathered(table, "uint32"):
        rows = _unpacked(note)
        sets = [np.frombuffer(g, np.uint64) for g in rows.column("grams").to_pylist()]
        keys, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        seen = np.ones(len(keys), np.int64)
        seen[tags] = counts
        at = 0
        for h, grams in zip(rows.column("h").to_pylist(), sets):
            n = len(grams)
            df = seen[inverse[at : at + n]]
            at += n
            first = np.lexsort((grams, df))[: n - (PERCENT * n + 99) // 100 + 1]
            picked = grams[first[df[first] > 1]]
            out_g.append(picked.view(np.int64))
            out_h += [h] * len(picked)
            out_n.append(np.full(len(picked), n))
    g = np.concatenate(out_g) if out_g else np.empty(0, np.int64)
    n = np.concatenate(out_n) if out_n else np.empty(0, np.int64)
    return pa.table({"g": pa.array(g, pa.int64()), "h": pa.array(out_h, pa.binary()), "n": pa.array(n, pa.int64())})


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the linked pairs to connect what they connect."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for a, b in linked.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[y] = x
            kept.append((a, b))
    return kept


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Pairs (i, j) of sets of ``left`` and ``right`` that link; without ``right``, pairs i < j of ``left``.

    The sets are the rows of two sparse matrices, whose product holds the overlaps. Only columns that
    several rows have can add to an overlap; they are multiplied a block at a time and accumulated.
    """
    rows = left + (right or [])
    sizes = np.array([len(r) for r in rows], np.int64)
    split = len(left)
    n, m = sizes[:split, None], sizes[None, split:] if right is not None else sizes[None, :split]
    possible = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    if right is None:
        possible = np.triu(possible, 1)
    if not possible.any():
        return np.empty((0, 2), np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, column, counts = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(counts), -1, np.int64)
    place[shared] = np.arange(len(shared))
    keep = place[column] >= 0
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    overlap = np.zeros(possible.shape, np.float32)
    width = max(1, BLOCK_CELLS // len(rows))
    for start in range(0, len(shared), width):
        lo, hi = np.searchsorted(column, (start, start + width))
        block = np.zeros((len(rows), min(width, len(shared) - start)), np.float32)
        block[owner[lo:hi], column[lo:hi] - start] = 1.0
        overlap += block[:split] @ (block[split:] if right is not None else block[:split]).T
    k = overlap.astype(np.int64)
    return np.argwhere(possible & (100 * k >= PERCENT * (n + m - k)))


def _multiplied(table: pa.Table) -> pa.Table:
    """Links within every block and between every two blocks of a room."""
    groups: dict[tuple, tuple[list, list]] = {}
    for key, second, h, grams in zip(*(table.column(c).to_pylist() for c in ("pair", "second", "h", "grams"))):
        groups.setdefault(key, ([], []))[second].append((h, np.frombuffer(grams, np.uint64)))
    out: list[tuple[bytes, bytes]] = []
    for left, right in groups.values():
        found = linked_pairs([x for _, x in left], [x for _, x in right] if right else None)
        names = [h for h, _ in left + right]
        if right:
            found = found + np.array([0, len(left)])
        out += [(names[a], names[b]) for a, b in _forest(found)]
    a, b = zip(*out) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _families(entries: DataFrame) -> DataFrame:
    """(h, n, family): sets that are connected by shared columns, whether they link or not."""
    first = written(entries.groupBy("g").agg(F.min("h").alias("b")), "ngram-columns")
    edges = entries.join(first, "g").where("h <> b").select(F.col("h").alias("a"), "b").distinct()
    edges = written(edges, "ngram-edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = connected_components(nodes, edges).select(F.col("node").alias("h"), F.col("label").alias("family"))
    return written(entries.select("h", "n").distinct().join(found, "h"), "ngram-families")


def _pivot_links(entries: DataFrame, large: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between sets of large families and pivots; hot pivots are copied to many rooms.

    For each of ``PIVOTS`` orders by hash, a column names the first set that has it, and a set takes the
    first one that its columns name. So most sets of a family name the same few.
    """
    columns = entries.join(large.select("h"), "h", "left_semi").select("g", "h")
    orders = range(PIVOTS)
    named = columns.groupBy("g").agg(*[F.min(F.struct(F.xxhash64(F.lit(i), "h"), "h")).alias(f"p{i}") for i in orders])
    picked = spread_join(columns, named, ["g"]).groupBy("h").agg(*[F.min(f"p{i}").alias(f"p{i}") for i in orders])
    pairs = picked.select("h", F.explode(F.array_distinct(F.array(*[F.col(f"p{i}.h") for i in orders]))).alias("pivot"))
    pairs = written(pairs.where("h <> pivot"), "ngram-pivots")
    counts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    counts = written(counts, "ngram-pivot-sizes")
    name = F.concat_ws(":", F.hex("pivot"), F.col("block").cast("string")).alias("pair")
    mine = pairs.join(counts, "pivot").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")))
    theirs = counts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = mine.select(name, F.lit(0).alias("second"), "h").unionByName(
        theirs.select(name, F.lit(1).alias("second"), F.col("pivot").alias("h"))
    )
    return written(_products(met.withColumn("room", F.xxhash64("pair")), sets), "ngram-pivot-links")


def _products(rooms: DataFrame, sets: DataFrame) -> DataFrame:
    placed = written(rooms, "ngram-rooms").join(sets, "h").select("room", "pair", "second", "h", "grams")
    return placed.groupBy("room").applyInArrow(_multiplied, "a binary, b binary")


def _small_rooms(small: DataFrame, rooms: int) -> DataFrame:
    """(room, pair, second, h): a family of up to BLOCK_ROWS sets is one block; families share rooms."""
    return small.select(
        F.pmod(F.xxhash64("family"), F.lit(rooms)).alias("room"), F.hex("family").alias("pair"), F.lit(0).alias("second"), "h"
    )


def _large_rooms(large: DataFrame, labels: DataFrame) -> DataFrame:
    """(room, pair, second, h): which sets of large families are multiplied, two blocks in a room.

    A family is cut by bands of sizes, such that links are possible within a band and between neighbours
    only. In a band, a component of more than BLOCK_ROWS sets is a part of its own, all others share a
    part. Parts are cut by a hash into blocks of about BLOCK_ROWS. Blocks of one component never meet;
    every other two that may have links do.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / PERCENT)) * (1 + 1e-9))).cast("int")
    sized = spread_join(large, labels.toDF("h", "label"), ["h"]).select("family", "h", "label", band.alias("band"))
    sized = written(sized, "ngram-large")
    components = sized.groupBy("family", "band", "label").agg(F.count(F.lit(1)).alias("sets"))
    apart = written(sized.groupBy("family").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi"), "ngram-apart")
    own = F.when(F.col("sets") > BLOCK_ROWS, F.hex("label")).otherwise(F.lit(""))
    components = written(components.join(apart.select("family"), "family", "left_semi").withColumn("part", own), "ngram-labels")
    placed = sized.join(components.select("family", "band", "label", "part"), ["family", "band", "label"])
    blocks = F.ceil(F.sum("sets") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")
    parts = written(components.groupBy("family", "band", "part").agg(blocks), "ngram-parts")
    lower = parts.select("family", "band", "part", "blocks", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band2"))
    upper = parts.toDF("family", "band2", "part2", "blocks2")
    same = F.col("band") == F.col("band2")
    alike = F.col("part") == F.col("part2")
    # One component has the same label in every band; the shared part holds several.
    meets = F.when(alike, F.col("part") == "").otherwise(~same | (F.col("part") < F.col("part2")))
    met = lower.join(upper, ["family", "band2"]).where(meets).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("j", F.explode(F.sequence(F.when(same & alike, F.col("i")).otherwise(F.lit(0)), F.col("blocks2") - 1)))
    texts = [F.hex("family"), *[F.col(c).cast("string") for c in ("band", "part", "i", "band2", "part2", "j")]]
    met = met.withColumn("pair", F.concat_ws(":", *texts))
    first = met.select("pair", F.lit(0).alias("second"), "family", "band", "part", F.col("i").alias("own"))
    second = met.where(~(same & alike & (F.col("i") == F.col("j")))).select(
        "pair", F.lit(1).alias("second"), "family", F.col("band2").alias("band"), F.col("part2").alias("part"), F.col("j").alias("own")
    )
    dealt = placed.join(parts, ["family", "band", "part"]).withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    sides = written(first.unionByName(second), "ngram-sides")
    return sides.join(dealt, ["family", "band", "part", "own"]).select(F.xxhash64("pair").alias("room"), "pair", "second", "h")


def _components(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, label) of the sets that have a link."""
    members = _families(entries)
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    sized = spread_join(members, sizes, ["family"])
    large = written(sized.where(F.col("size") > BLOCK_ROWS).select("family", "h", "n"), "ngram-large-families")
    rooms = _small_rooms(sized.where(F.col("size") <= BLOCK_ROWS), blocked.block_count(sets))
    found = None
    if not large.isEmpty():
        found = _pivot_links(entries, large, sets)
        labels = connected_components(large.select(F.col("h").alias("node")), found)
        rooms = rooms.unionByName(_large_rooms(large, labels))
    links = _products(rooms, sets)
    links = written(links if found is None else links.union(found), "ngram-links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return connected_components(nodes, links)


def ngram_components(docs: DataFrame, with_sets: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; exact, whatever the sizes of groups.

    ``with_sets`` adds ``h``, the hash of the row's set, and ``label``, one of the component's hashes.

    Words are runs without ASCII white space, A-Z in lower case. A set is the distinct 5-word
    shingles, or all words as one if there are fewer. Null, empty and blank texts have no shingles and
    link with nothing, so their component is their own id. Repeated rows have equal sets and share a
    component; a null id is never the smallest, and a component of null ids only has a null id. Other
    columns are left out.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = blocked.block_count(docs)
    columns = slim.mapInArrow(_document_columns(blocks), blocked.COLUMN_SCHEMA)
    counted = blocked.counts_by_flush(columns, _TAG).groupBy("flush").applyInArrow(
        _document_counts, "doc_id bigint, n bigint, shared bigint, h binary"
    )
    rows = written(counted, "ngram-documents")
    near = F.col("n") * PERCENT <= F.col("shared") * 100
    alone = rows.where((F.col("n") == 0) | ~near).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "h", F.col("h").alias("label"))
    open_rows = rows.where((F.col("n") > 0) & near).select("doc_id", "n", "h")

    classes = written(open_rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("size")), "ngram-classes")
    ids = classes.select(F.col("doc_id").alias("_id"))
    few = small_table(ids, MAX_BROADCAST_IDS)
    chosen = slim.join(ids if few is None else few, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    # Other rows of the same id may come along; they are no representatives.
    sets = chosen.mapInArrow(_set_rows, "h binary, n bigint, grams binary")
    sets = written(sets.join(classes.select("h"), "h", "left_semi").dropDuplicates(["h"]), "ngram-sets")

    entries = sets.select("h", "grams").mapInArrow(_set_columns(blocks), blocked.COLUMN_SCHEMA)
    entries = blocked.counts_by_flush(entries, "uint32").groupBy("flush").applyInArrow(_rare_entries, "g bigint, h binary, n bigint")
    found = _components(written(entries, "ngram-entries"), sets.select("h", "grams"))

    labelled = classes.join(found.select(F.col("node").alias("h"), "label"), "h", "left").select(
        "h", F.coalesce("label", "h").alias("label"), "doc_id"
    )
    smallest = written(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "ngram-smallest")
    ids = written(labelled.select("h", "label").join(smallest, "label").select("h", "label", "component_id"), "ngram-class-ids")
    linked = open_rows.join(ids, "h").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "h", "label")
    found = alone.unionByName(linked)
    return found if with_sets else found.drop("h", "label")


def set_hash(text: Column) -> Column:
    """The hash of a text's shingle set, as :func:`ngram_components` gives it."""

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        memo: dict[bytes, int] = {}
        return texts.map(lambda t: _set_hash(shingles((t or "").encode(), memo)))

    return hashed(text)


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the smallest id stays.

    Rows with a null id stay. Of rows that share an id and a component, one stays, the first by a hash of
    the row; rows of one id in different components are different documents, and each is its component's.
    """
    components = written(ngram_components(docs, with_sets=True), "ngram-components")
    heads = components.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("head"), "h", "label").distinct()
    # An id that stands for several sets says nothing about its rows' components: some of its rows may be
    # no heads at all. Their texts are hashed again; of unique ids the row itself is the head.
    many = components.groupBy(F.col("doc_id").alias("_id")).agg(F.countDistinct("h").alias("sets")).where("sets > 1")
    many = written(many.select("_id"), "ngram-repeated-ids")
    rows = boxed(docs).withColumn("id", F.col("row.doc_id").cast("bigint"))
    plain = heads.join(many, F.col("head") == F.col("_id"), "left_anti").drop("h")
    marked = rows.join(plain, F.col("id") == F.col("head")).select("row", "id", "label")
    mixed = rows.join(many, F.col("id") == F.col("_id"), "left_semi").withColumn("own", set_hash(F.col("row.text")))
    chosen = mixed.join(heads, (F.col("id") == F.col("head")) & (F.col("own") == F.col("h"))).select("row", "id", "label")
    # Rows that repeat an id are few; of unique ids every row is its own group.
    kept = marked.unionByName(chosen).groupBy("id", "label").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select(*unboxed(docs.columns)).unionByName(docs.where("doc_id is null"))
