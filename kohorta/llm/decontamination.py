"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every run of words of every test item. A document's words are streamed through
it; at each word it knows the longest run of any item that ends there. Words inside an occurrence of
a window (13 consecutive item words, or a whole shorter item) are hit. Most words of a document are
never streamed: an occurrence needs all its neighbouring word pairs to be pairs of some item, and
stretches without enough such pairs in a row are skipped in one vector step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import boxed, raw_texts, unboxed
from kohorta.plans.skew import spread_join
from kohorta.session import written

#: Words of a window.
WINDOW = 13
#: Words of items that one automaton takes; a larger benchmark is matched block by block.
BLOCK_WORDS = 500_000
#: A document is contaminated when at least one word in this many is hit.
HIT_SHARE = 20

#: ASCII letters in lower case; other ASCII characters part words, all others belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class ItemAutomaton:
    """Suffix automaton of a block of items, with the items that each window occurs in."""

    def __init__(self, items: Sequence[tuple[str, list[bytes]]]):
        self.ids: dict[bytes, int] = {}
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        self.shortest = min((min(len(c), WINDOW) for _, c in coded), default=WINDOW)
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        # Which windows a state stands for: the items in which its run of `WINDOW` words occurs, and
        # the short items that it is the whole of.
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, set[str]] = {}
        pairs = set()
        for item, codes in coded:
            pairs.update(zip(codes, codes[1:]))
            state = run = 0
            for c in codes:
                state, run = self.step(state, run, c)
                if run > WINDOW:
                    run = WINDOW
                    state = self._shrunk(state, run)
                if run == WINDOW:
                    self.windows.setdefault(state, set()).add(item)
            if len(codes) < WINDOW:
                self.short.setdefault(state, set()).add((item, len(codes)))
        # The nearest suffix state, itself included, that is a whole short item.
        self.above = [0] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.above[v] = v if v in self.short else self.above[self.link[v]]
        size = len(self.ids)
        self.pairs = np.array(sorted(a * size + b for a, b in pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        """Append a word after ``last``; words that are already there share their states."""
        nexts, link, length = self.next, self.link, self.length
        if c in nexts[last]:
            q = nexts[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def step(self, state: int, run: int, c: int) -> tuple[int, int]:
        """The longest run that ends with word ``c``, given the longest that ended before it."""
        while state and c not in self.next[state]:
            state = self.link[state]
            run = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], run + 1
        return 0, 0

    def _shrunk(self, state: int, run: int) -> int:
        """The state of the last ``run`` words of the current match."""
        while self.length[self.link[state]] >= run:
            state = self.link[state]
        return state

    def _stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words long enough for a window, all neighbouring pairs of which some item has."""
        if self.shortest == 1:
            good = codes >= 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
            return [(a, b) for a, b in zip(edge[::2], edge[1::2])]
        if len(codes) < 2 or not len(self.pairs):
            return []
        pair = np.where((codes[:-1] >= 0) & (codes[1:] >= 0), codes[:-1] * len(self.ids) + codes[1:], -1)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        good = self.pairs[at] == pair
        edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
        return [(a, b + 1) for a, b in zip(edge[::2], edge[1::2]) if b + 1 - a >= self.shortest]

    def find(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words [begin, end) that windows cover, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        for begin, end in self._stretches(codes):
            state = run = 0
            for i, c in enumerate(codes[begin:end].tolist(), begin + 1):
                state, run = self.step(state, run, c)
                if run >= WINDOW:
                    run = WINDOW
                    state = self._shrunk(state, run)
                    spans.append((i - WINDOW, i))
                    items |= self.windows[state]
                v = self.above[state]
                while v:
                    for item, size in self.short[v]:
                        # The state stands for runs of several lengths; the item is one of them.
                        if size <= run:
                            spans.append((i - size, i))
                            items.add(item)
                    v = self.above[self.link[v]]
        return spans, items


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """Items dealt to blocks as (block, item, words), in the shared folder, and the number of blocks.

    Long items are cut into pieces that overlap by a window less one word, so each of their windows
    stands in a piece; equal rows are kept once. A benchmark of at most ``block_words`` words is one
    block. Pieces of a larger one are dealt by hash to blocks of half that on average; a piece is a 64th
    of a block at most, so blocks stay near their average. Rows without words are left out; an item with
    a null id is matched as any other, but has no name.
    """
    most = max(block_words // 64, 4 * WINDOW)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), raw_texts(batch.column(1))):
                words = words_of(text)
                begins = range(0, max(len(words) - WINDOW + 1, 1), most - WINDOW + 1) if words else ()
                parts = [words[i : i + most] for i in begins]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item.as_py()] * len(parts), pa.string()),
                        pa.array([b" ".join(w) for w in parts], pa.binary()),
                        pa.array([len(w) for w in parts], pa.int32()),
                    ],
                    names=["item", "words", "n"],
                )

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    pieces = written(rows.mapInArrow(cut, "item string, words binary, n int").distinct(), "benchmark-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    if total <= block_words:
        return pieces.select(F.lit(0).alias("block"), "item", "words"), 1
    blocks = -(-2 * total // block_words)
    dealt = pieces.select(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int").alias("block"), "item", "words")
    return written(dealt.repartition(blocks, "block").sortWithinPartitions("block"), "benchmark-blocks"), blocks


def _block(pieces: DataFrame, number: int):
    """A broadcast of one block; the driver holds one block at a time."""
    rows = pieces.where(F.col("block") == number).select("item", "words").toArrow()
    items = [(item, words.split()) for item, words in zip(rows["item"].to_pylist(), rows["words"].to_pylist())]
    return pieces.sparkSession.sparkContext.broadcast(items)


def _hits_in(texts: DataFrame, shared) -> DataFrame:
    """(digest, spans, items) of the texts that a block hits; ``texts`` are (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ItemAutomaton(shared.value)
        for batch in batches:
            out = []
            for digest, text in zip(batch.column(0), raw_texts(batch.column(1))):
                spans, items = automaton.find(words_of(text))
                if spans:
                    out.append((digest.as_py(), np.array(sorted(set(spans)), "<i8").tobytes(), sorted(items - {None})))
            columns = list(zip(*out)) or [[]] * 3
            kinds = (pa.string(), pa.binary(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "spans", "items"]
            )

    return texts.mapInArrow(run, "digest string, spans binary, items array<string>")


def _matched(docs: DataFrame, benchmark: DataFrame, block_words: int):
    """The rows of ``docs`` as (row, spans, items), and a function that loads a matcher in a task.

    The matcher turns a text's words, its spans and its items into a mask of hit words and a set of
    items. One block is broadcast and matched where the rows are read, and spans and items are null.
    Of several, each is matched in a pass of its own, which keeps only what it hit; hits are united by
    a digest of the text and joined back as a table. Texts themselves are never copied per block.
    """
    pieces, blocks = item_blocks(benchmark, block_words)
    rows = boxed(docs)
    if blocks == 1:
        shared = _block(pieces, 0)
        spans, items = F.lit(None).cast("array<binary>"), F.lit(None).cast("array<string>")
        rows = rows.select("row", spans.alias("spans"), items.alias("items"))
    else:
        shared = None
        keyed = rows.select(F.sha2(F.col("row.text"), 256).alias("digest"), "row")
        texts = keyed.where("digest is not null").select("digest", "row.text")
        passes = [_hits_in(texts, _block(pieces, b)) for b in range(blocks)]
        # A text has one set of spans per block, however many rows repeat it.
        united = reduce(DataFrame.union, passes).groupBy("digest").agg(
            F.collect_set("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
        )
        rows = spread_join(keyed, united, ["digest"], "left").select("row", "spans", "items")

    def load():
        automaton = ItemAutomaton(shared.value) if shared else None

        def match(words: Sequence[bytes], spans, items) -> tuple[np.ndarray, set[str]]:
            if automaton:
                found, names = automaton.find(words)
            else:
                found = [s for part in (() if spans is None else spans) for s in np.frombuffer(part, "<i8").reshape(-1, 2).tolist()]
                names = set(() if items is None else items)
            hit = np.zeros(len(words) + 1, np.int32)
            for a, b in found:
                hit[a] += 1
                hit[b] -= 1
            return np.cumsum(hit[:-1]) > 0, names - {None}

        return match

    return rows, load


def contamination(
    docs: DataFrame, benchmark: DataFrame, share: int = HIT_SHARE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row.

    Null and empty texts have no words and are clean; repeated rows are judged each, repeated items
    count once; an empty benchmark leaves everything clean. Other columns are left out.
    """
    rows, load = _matched(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = load()
        for batch in batches:
            out = []
            for text, spans, items in zip(raw_texts(batch.column(1)), batch.column(2), batch.column(3)):
                words = words_of(text)
                mask, items = match(words, spans.as_py(), items.as_py())
                n, hit = len(words), int(mask.sum())
                names = ",".join(sorted(items))
                out.append((n, hit, len(items), hashlib.sha256(names.encode()).hexdigest(), hit > 0 and share * hit >= n))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return rows.select("row.doc_id", "row.text", "spans", "items").mapInArrow(run, schema)


def without_spans(text: str, mask: np.ndarray) -> str:
    """The text without its hit words, and without what stands between two neighbouring hit words."""
    raw = text.encode()
    plain = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], plain.astype(np.int8), [0]])))
    begins, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for i in np.flatnonzero(mask):
        if i and mask[i - 1]:
            at = ends[i]
            continue
        out.append(raw[at : begins[i]])
        at = ends[i]
    out.append(raw[at:])
    return b"".join(out).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, share: int = HIT_SHARE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Clean documents as they are, contaminated ones gone, and hit words cut from the rest.

    The rest are documents whose hit words are fewer than one in ``share``. All columns stay; null
    texts stay null.
    """
    rows, load = _matched(docs, benchmark, block_words)

    @F.pandas_udf("contaminated boolean, text string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match = load()
        for texts, found in batches:
            out = []
            for text, spans in zip(texts, found):
                words = words_of((text or "").encode())
                mask, _ = match(words, spans, None)
                hit = int(mask.sum())
                bad = hit > 0 and share * hit >= len(words)
                out.append((bad, without_spans(text, mask) if hit and not bad else text))
            yield pd.DataFrame(out, columns=["contaminated", "text"]).astype({"contaminated": "bool", "text": "object"})

    # A filter on what is selected later would have every text judged twice, were the function deterministic.
    once = judged.asNondeterministic()
    kept = rows.withColumn("judged", once(F.col("row.text"), F.col("spans"))).where("not judged.contaminated")
    return kept.select(*unboxed(docs.columns, text=F.col("judged.text")))
