"""Periodic runs in texts: maximal pairs from a bottom-up walk of the LCP-interval tree.

A run is a stretch of words with smallest period q that no neighbouring word extends. Its first word and
the word q later begin a maximal pair: equal words from both on, another word before them and another
one after. The tree of LCP intervals holds all maximal pairs: two suffixes of different children of an
interval agree on exactly its depth, so only the words before them must be compared. The walk keeps, for
every interval, its places in order, each with the class of the word on its left, and puts smaller
children into larger ones. A pair of places next to each other, of different classes, with a distance of
at most a third of the depth is a run; nothing is extended afterwards.

Only stretches in which all 5-grams of words repeat get a tree: a run that is at least six words and four
periods long repeats each of its 5-grams. Texts are dealt as they are read; no row meets another.

Null and empty texts have no words and no runs; a null id leaves the text as it is; repeated rows are
reported as often as they stand; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.llm.common import raw_texts

#: A run has at least so many words, and so many periods.
MIN_WORDS = 6
MIN_PERIODS = 4
#: Every place of a maximal pair of a run begins a repeated sequence of so many words.
GRAM = MIN_WORDS - 1
#: Places in one list of an interval before it is cut in two.
LIST_PLACES = 1024
#: Up to so many words, suffixes are sorted by comparing them.
SHORT = 48

REPORT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]


class Places:
    """Places of an interval in order, in lists of bounded size, so that adding one stays cheap."""

    def __init__(self, place: int):
        self.lists = [[place]]
        self.size = 1

    def _find(self, place: int) -> tuple[int, int]:
        at = 0
        if len(self.lists) > 1:
            at = max(bisect_left(self.lists, [place + 1]) - 1, 0)
        return at, bisect_left(self.lists[at], place)

    def beside(self, place: int) -> tuple[int | None, int | None]:
        """The places before and after one that is not among them."""
        lists = self.lists
        at, k = self._find(place)
        own = lists[at]
        before = own[k - 1] if k else (lists[at - 1][-1] if at else None)
        after = own[k] if k < len(own) else (lists[at + 1][0] if at + 1 < len(lists) else None)
        return before, after

    def add(self, place: int) -> None:
        at, k = self._find(place)
        own = self.lists[at]
        own.insert(k, place)
        self.size += 1
        if len(own) > LIST_PLACES:
            half = len(own) // 2
            self.lists[at : at + 1] = [own[:half], own[half:]]

    def __iter__(self) -> Iterator[int]:
        for own in self.lists:
            yield from own


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the number of words that are compared."""
    n = len(words)
    if n <= SHORT:
        plain = words.tolist()
        return np.array(sorted(range(n), key=lambda i: plain[i:]), np.int64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        key = rank * (n + 2)
        key[: n - width] += rank[width:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate([[1], (key[1:] != key[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n:
            return order
        width *= 2


def common_prefixes(words: Sequence[int], order: Sequence[int]) -> list[int]:
    """Words that each suffix shares with the one before it in the order."""
    n = len(words)
    place, out = [0] * n, [0] * n
    for k, i in enumerate(order):
        place[i] = k
    shared = 0
    for i in range(n):
        k = place[i]
        if not k:
            shared = 0
            continue
        j = order[k - 1]
        room = n - max(i, j)
        while shared < room and words[i + shared] == words[j + shared]:
            shared += 1
        out[k] = shared
        shared -= shared > 0
    return out


def runs_of_stretch(words: np.ndarray) -> set[Run]:
    """(start, length, period) of the runs of a stretch whose neighbours extend none of them."""
    order = suffix_order(words).tolist()
    plain = words.tolist()
    shared = common_prefixes(plain, order)
    found: dict[tuple[int, int], int] = {}

    def joined(a: Places, b: Places, depth: int) -> Places:
        """The places of two children; pairs that meet here agree on ``depth`` words."""
        if a.size < b.size:
            a, b = b, a
        for i in b:
            before, after = a.beside(i)
            for one, two in ((before, i), (i, after)):
                if one is None or two is None:
                    continue
                period = two - one
                if (MIN_PERIODS - 1) * period > depth or depth + period < MIN_WORDS:
                    continue
                if one and plain[one - 1] == plain[two - 1]:  # the same class on the left: not maximal
                    continue
                key = (one, depth + period)
                if found.get(key, period) >= period:
                    found[key] = period  # multiples of a period end where it does
        for i in b:
            a.add(i)
        return a

    # Intervals that are still open: depth and places of the children so far.
    stack: list[tuple[int, Places]] = []
    open_places = Places(order[0]) if order else None
    for k in range(1, len(order) + 1):
        depth = shared[k] if k < len(order) else 0
        while stack and stack[-1][0] > depth:
            top, places = stack.pop()
            open_places = joined(places, open_places, top)
        if k == len(order):
            break
        if depth >= GRAM:
            if stack and stack[-1][0] == depth:
                stack[-1] = (depth, joined(stack[-1][1], open_places, depth))
            else:
                stack.append((depth, open_places))
        open_places = Places(order[k])
    return {(start, length, period) for (start, length), period in found.items()}


def periodic_runs(words: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers, by start, then period."""
    n = len(words)
    if n < MIN_WORDS:
        return []
    m = n - GRAM + 1
    # Hashes of 5-grams; equal hashes of different ones only make a stretch longer.
    gram = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for k in range(GRAM):
            gram = gram * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + m]
    order = np.argsort(gram, kind="stable")
    same = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    if not len(same):
        return []
    again = np.zeros(m, bool)
    again[order[same]] = again[order[same + 1]] = True
    distance = np.full(m, n, np.int64)
    distance[order[same]] = order[same + 1] - order[same]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
    out: list[Run] = []
    for a, b in edges.reshape(-1, 2).tolist():
        size = b - a + GRAM - 1
        # A run of period q has 5-grams that come again after q words, and takes four times as many.
        if size >= MIN_WORDS and MIN_PERIODS * int(distance[a:b].min()) <= size:
            out += [(a + start, length, period) for start, length, period in runs_of_stretch(words[a : a + size])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def word_numbers(words: Sequence[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return list(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def looped(words: list[bytes], h: int | None) -> list[bytes]:
    """The words, of which a tenth of the texts (by ``h``) repeats some from a word on to its end."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def run_report(words: Sequence[bytes]) -> tuple:
    """One text's values in the order of ``REPORT``."""
    runs = periodic_runs(word_numbers(words))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    best: Run | None = None
    for run in runs:  # by start, then period, so only a greater exponent replaces the best
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    figures = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *figures, _sha(listed), _sha(b" ".join(collapsed(words, runs))))


def detect_runs(docs: DataFrame, loop_key: Column | None = None) -> DataFrame:
    """(doc_id, n_runs, the run of greatest exponent, digests of all runs and of the collapsed text) per row.

    ``loop_key`` is an unsigned number per row by which a tenth of the texts is made periodic first
    (see ``looped``); without it texts are read as they are.
    """
    rows = docs.select("doc_id", "text", (F.lit(None) if loop_key is None else loop_key).cast("long").alias("key"))
    names = [c.split(" ")[0] for c in REPORT.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in REPORT.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            out = [run_report(looped(raw.split(), key)) for raw, key in zip(raw_texts(batch.column("text")), keys)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

    return rows.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {REPORT}")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated period cut from ``text``; words are then joined by one space.

    A text without runs is left as it is, blanks included; null stays null.
    """

    @F.pandas_udf("string")
    def cut(texts):
        def one(text):
            if text is None:
                return None
            words = text.encode().split()
            runs = periodic_runs(word_numbers(words))
            return b" ".join(collapsed(words, runs)).decode() if runs else text

        return texts.map(one, na_action="ignore")

    return docs.withColumn("text", cut("text"))
