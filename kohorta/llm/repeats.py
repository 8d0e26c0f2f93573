"""Repeated substrings of a corpus by enhanced suffix arrays over the parts that can repeat.

One suffix array over a whole corpus fits in no task. But two equal strings of ``MIN_BYTES`` bytes have
equal smallest n-grams (by a hash), so every window of that length is dealt to the bucket of its
smallest n-gram, and equal windows meet. Neighbouring windows mostly share their smallest n-gram; such
a run of windows travels as one stretch of text, its context, and only if its n-gram occurs in another
place of the corpus at all.

The task of a bucket builds a suffix array over its contexts and scans it. Suffixes that share
``MIN_BYTES`` bytes are an interval of the array: the occurrences of one repeat. An interval whose
suffixes all follow the same byte is part of a longer repeat that starts earlier; the others are the
starts of maximal repeats, and :func:`interval_tree` opens them into nested groups, longest inside.

Texts that are copies of each other are one text here, whose windows all repeat. Contexts that are
equal within a task's share travel once with all their places. The windows of an n-gram with very
many contexts are dealt on by a hash of their own, to the more buckets the more contexts there are, so
no bucket grows with the corpus. What a bucket finds is merged into stretches per text before it is sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.llm import blocked
from kohorta.llm.common import raw_texts, shuffle_partitions
from kohorta.plans.skew import small_table
from kohorta.session import written

#: Bytes of a repeat.
MIN_BYTES = 200
#: Bytes of the n-grams whose smallest deals a window to its bucket.
GRAM = 64
#: Windows of a context; longer runs are cut.
RUN_WINDOWS = 2048
#: Contexts of an n-gram beyond which its windows are compared by digest, in several buckets.
HOT_CONTEXTS = 4_000
#: Counts of contexts end here, and so many buckets take the windows of an n-gram that reaches it.
MOST_CONTEXTS = 65_535
MOST_BUCKETS = 4_096
#: Bytes of contexts that one suffix array takes, but for those of one n-gram that exceed it.
CHUNK_BYTES = 1_000_000
#: Bits of a position up to which two ranks and a position fit in one number.
_PACKED_BITS = 21
#: Bytes of contexts between two rounds of merging equal ones before they are sent.
MERGE_BYTES = 16_000_000
MAX_BROADCAST_IDS = 2_000_000
#: Ids of texts and bytes of a place: text digest and start.
_PLACE = np.dtype([("text", "V16"), ("start", "<i4")])

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, kept for the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.inverse)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    shaped = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(shaped, axis=1).reshape(-1)
    back = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def window_runs(raw: bytes, powers: _Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, windows, may repeat itself) of runs of windows with the same smallest n-gram.

    Two equal windows of one run put its n-gram in two places, and then in one where a window of the
    run begins and in another where one ends; so counting those two kinds of places finds such runs.
    """
    n = len(raw)
    if n < MIN_BYTES:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    up, down = powers.get(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        grams = blocked.mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    least = _sliding_min(grams, MIN_BYTES - GRAM + 1)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(least)))
    reach = MIN_BYTES - GRAM
    heads = np.flatnonzero(grams[: len(least)] == least)
    tails = np.flatnonzero(grams[reach:] == least)
    run_of = lambda windows: np.searchsorted(starts, windows, side="right") - 1
    first, last = np.full(len(starts), n), np.full(len(starts), -1)
    np.minimum.at(first, run_of(heads), heads)
    np.maximum.at(last, run_of(tails), tails + reach)
    twice = first < last
    if sizes.max() > RUN_WINDOWS:
        parts = -(-sizes // RUN_WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * RUN_WINDOWS
        twice = np.repeat(twice, parts)
        sizes = np.diff(np.append(starts, len(least)))
    return least[starts], starts, sizes, twice


def _digest(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


class Text(NamedTuple):
    doc_id: int | None
    digest: bytes
    size: int
    sha: bytes


def _text_columns(blocks: int):
    """Keys of the windows of every distinct text of a flush by block; the note lists all texts."""

    def flushed(nth: int, texts: list[Text], keys: dict[bytes, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        digests = list(keys)
        sizes = np.array([len(keys[d][0]) for d in digests], np.int64)
        flat, twice = (np.concatenate([keys[d][i] for d in digests]) for i in (0, 1))
        distinct, first, inverse, counts = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        counts = counts + np.bincount(inverse[twice], minlength=len(distinct))
        owner = np.frombuffer(b"".join(d[:8] for d in digests), np.uint64) | np.uint64(1)
        # Zero owns what several places of this flush share.
        owners = np.where(counts > 1, np.uint64(0), np.repeat(owner, sizes)[first])
        sink = pa.BufferOutputStream()
        listed = pa.table(
            {
                "doc_id": pa.array([t.doc_id for t in texts], pa.int64()),
                "digest": pa.array([t.digest for t in texts], pa.binary()),
                "n_bytes": pa.array([t.size for t in texts], pa.int64()),
                "sha": pa.array([t.sha for t in texts], pa.binary()),
            }
        ).replace_schema_metadata(
            {b"digests": b"".join(digests), b"sizes": sizes.tobytes(), b"inverse": inverse.astype(np.uint32).tobytes(), b"counts": np.minimum(counts, MOST_CONTEXTS).astype(np.uint16).tobytes()}
        )
        with pa.ipc.new_stream(sink, listed.schema) as w:
            w.write_table(listed)
        note = sink.getvalue().to_pybytes()
        tags = np.arange(len(distinct), dtype=np.uint32)
        return blocked.column_rows(blocks, blocked.flush_number(note, nth), distinct, tags, counts, note, owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        texts: list[Text] = []
        keys: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        entries = nth = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                digest = _digest(raw)
                texts.append(Text(doc_id, digest, len(raw), hashlib.sha256(raw).digest()))
                if digest not in keys:
                    found = window_runs(raw, powers)
                    keys[digest] = (found[0], found[3])
                    entries += len(found[0])
                if entries >= blocked.FLUSH_ENTRIES or len(texts) >= blocked.FLUSH_DOCS:
                    yield flushed(nth, texts, keys)
                    texts, keys, entries, nth = [], {}, 0, nth + 1
        if texts:
            yield flushed(nth, texts, keys)

    return run


def _text_hits(hot_contexts: int):
    """From a flush to all its texts, and for each the runs whose n-gram stands elsewhere, too, with a hot mark.

    A hit is eight times the number of the run, plus a level: 0 if its contexts go to one bucket, else
    what tells the number of buckets, see :func:`_buckets`. The count that decides is the same for every
    flush, so all contexts of an n-gram are dealt alike.
    """

    def hits_of(table: pa.Table) -> pa.Table:
        for note, tags, counts in blocked.gathered(table, "uint32"):
            texts = pa.ipc.open_stream(note).read_all()
            meta = texts.schema.metadata
            raw = meta[b"digests"]
            sizes = np.frombuffer(meta[b"sizes"], np.int64)
            seen = np.frombuffer(meta[b"counts"], np.uint16).astype(np.int64)
            seen[tags] = counts
            per_run = seen[np.frombuffer(meta[b"inverse"], np.uint32)]
            hits, at = {}, 0
            for i, size in enumerate(sizes.tolist()):
                own = per_run[at : at + size]
                at += size
                found = np.flatnonzero(own > 1)
                level = np.clip(np.ceil(np.log2(np.maximum(own[found], 1) / hot_contexts)), 0, 6).astype(np.int64)
                level[own[found] >= MOST_CONTEXTS] = 7
                hits[raw[16 * i : 16 * i + 16]] = (8 * found + level).astype(np.int32).tobytes() if len(found) else None
            column = pa.array([hits[d] for d in texts.column("digest").to_pylist()], pa.binary())
            return texts.replace_schema_metadata(None).append_column("hits", column)

    return hits_of


def _buckets(level: int) -> int:
    """Buckets that the windows of an n-gram with many contexts are dealt to."""
    return MOST_BUCKETS if level == 7 else 4 << level


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [(_digest(raw), pack(raw)) for raw in raw_texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([d for d, _ in packed], pa.binary()), pa.array([z for _, z in packed], pa.binary())],
            names=["doc_id", "own", "z"],
        )


_CONTEXT_FIELDS = pa.schema([("key", pa.int64()), ("body", pa.binary()), ("windows", pa.int32()), ("places", pa.binary())])
CONTEXT_SCHEMA = "key bigint, body binary, windows int, places binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the hit runs with all their places; of hot runs, the digest of every window."""
    powers, unpack = _Powers(), zstandard.ZstdDecompressor().decompress
    found: dict[tuple[int, bytes, int], list[tuple[bytes, int]]] = {}
    held = 0

    def merged() -> pa.RecordBatch:
        rows = [(key, body, windows, np.array(places, _PLACE).tobytes()) for (key, body, windows), places in found.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CONTEXT_FIELDS)], schema=_CONTEXT_FIELDS)

    for batch in batches:
        for digest, z, hits in zip(*(batch.column(c).to_pylist() for c in ("digest", "z", "hits"))):
            raw = unpack(z)
            keys, starts, sizes, _ = window_runs(raw, powers)
            for hit in np.frombuffer(hits, np.int32).tolist():
                run, level = hit >> 3, hit & 7
                start, size = int(starts[run]), int(sizes[run])
                if level:
                    gram, spread = int(keys[run]), _buckets(level)
                    bucket = [xxhash.xxh3_64_intdigest(gram.to_bytes(8, "little"), seed=z) - (1 << 63) for z in range(spread)] if size > spread else {}
                    for at in range(start, start + size):
                        body = _digest(raw[at : at + MIN_BYTES])
                        z = int.from_bytes(body[:8], "little") % spread
                        key = bucket[z] if bucket else xxhash.xxh3_64_intdigest(gram.to_bytes(8, "little"), seed=z) - (1 << 63)
                        found.setdefault((key, body, 0), []).append((digest, at))
                    held += 120 * size
                else:
                    body = raw[start : start + size - 1 + MIN_BYTES]
                    found.setdefault((int(keys[run].view(np.int64)), body, size), []).append((digest, start))
                    held += len(body) + 150
                if held >= MERGE_BYTES:
                    yield merged()
                    found, held = {}, 0
    if found:
        yield merged()


def _ranks(values: np.ndarray, bits: int) -> np.ndarray:
    """Dense ranks of numbers of at most ``2 * bits`` bits; positions have ``bits`` bits."""
    if bits > _PACKED_BITS:
        return np.unique(values, return_inverse=True)[1].astype(np.uint64)
    shift = np.uint64(bits)
    packed = values << shift | np.arange(len(values), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    ordered = packed >> shift
    ranks = np.empty(len(values), np.uint64)
    ranks[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.uint64)
    return ranks


def _prefix_ranks(text: np.ndarray, depth: int, kept: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, int, int]:
    """Ranks of all positions by their next ``size`` bytes, doubled from 5 to ``depth`` or more; size; bits of a position.

    ``kept`` gets the ranks of each size from 20 to the last but one.
    """
    padded = np.concatenate([text, np.zeros(2 * MIN_BYTES, np.uint8)])
    n = len(text) + MIN_BYTES
    bits = max(_PACKED_BITS, n.bit_length())
    ranks = np.zeros(n, np.uint64)
    for i in range(5):
        ranks = ranks << np.uint64(8) | padded[i : i + n]
    ranks = _ranks(ranks, bits)
    size = 5
    while size < depth:
        if kept is not None and size >= 20:
            kept[size] = ranks.astype(np.uint32)
        later = np.zeros(n, np.uint64)
        later[:-size] = ranks[size:]
        ranks = _ranks(ranks << np.uint64(bits) | later, bits)
        size *= 2
    return ranks, size, bits


def suffix_intervals(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``starts`` to a depth of MIN_BYTES, and the number of each suffix's interval.

    Ranks of 5 bytes are doubled to 160; two overlapping ranks of 160 give the order of the first 200
    bytes. Suffixes of one interval share all of them.
    """
    ranks, size, bits = _prefix_ranks(text, 160)
    pair = _ranks(ranks[starts] << np.uint64(bits) | ranks[starts + MIN_BYTES - size], bits)
    order = np.argsort(pair, kind="stable")
    return starts[order], pair[order].astype(np.int64)


def _common_prefixes(text: np.ndarray, ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes from ``a`` and ``b`` on, ``most`` at most, by the ranks of each size; 0 if they are fewer than MIN_BYTES."""
    out = np.zeros(len(a), np.int64)
    at = np.flatnonzero(ranks[160][a] == ranks[160][b])
    x, y, found, bound = a[at], b[at], np.zeros(len(at), np.int64), most[at]
    for size in sorted(ranks, reverse=True):
        same = ranks[size]
        last = len(same) - 1
        found += size * (same[np.minimum(x + found, last)] == same[np.minimum(y + found, last)])
    # What is left is shorter than the least size.
    open_ = np.arange(len(at))
    for _ in range(min(ranks)):
        open_ = open_[found[open_] < bound[open_]]
        open_ = open_[text[x[open_] + found[open_]] == text[y[open_] + found[open_]]]
        found[open_] += 1
    found = np.minimum(found, bound)
    out[at] = np.where(found < MIN_BYTES, 0, found)
    return out


def interval_scan(common: list[int], lefts: list[int]) -> list[tuple[int, int, int]]:
    """Maximal repeats (begin, end, length) of a suffix array by one scan with a stack of open intervals.

    ``common`` holds the bytes that a suffix shares with the one before it, 0 if too few; ``lefts`` the
    byte before each, -1 if unknown. An interval whose suffixes all follow the same byte is left out,
    being part of a repeat that starts earlier. Inner intervals come before those around them.
    """
    out = []
    lengths, begins, sides = [0], [0], [-1]
    for i, shared in enumerate([*common[1:], 0], 1):
        begin, side = i - 1, lefts[i - 1]
        while lengths[-1] > shared:
            length, begin, own = lengths.pop(), begins.pop(), sides.pop()
            if own != side:
                side = -1
            if side < 0:
                out.append((begin, i, length))
        if lengths[-1] < shared:
            lengths.append(shared)
            begins.append(begin)
            sides.append(side)
        elif sides[-1] != side:
            sides[-1] = -1
    return out


def interval_tree(suffixes: Sequence[bytes], lefts: Sequence[int], least: int) -> list[tuple[int, list[int]]]:
    """Maximal repeats among suffixes: (length, members), every nested group with all occurrences.

    The suffixes are sorted, and a stack holds the open intervals of the array by their common prefix.
    An interval is a maximal repeat if its members follow different bytes (-1: a text begins, or what
    stands before is not known, which counts as different from all).
    """
    order = sorted(range(len(suffixes)), key=lambda i: suffixes[i])
    out: list[tuple[int, list[int]]] = []
    stack: list[tuple[int, int]] = [(0, 0)]
    for i in range(1, len(order) + 1):
        common = 0
        if i < len(order):
            a, b = suffixes[order[i - 1]], suffixes[order[i]]
            common = _common(a, b)
        begin = i - 1
        while stack and stack[-1][0] > common:
            length, begin = stack.pop()
            members = order[begin:i]
            before = {lefts[m] for m in members}
            if length >= least and (len(before) > 1 or -1 in before):
                out.append((length, sorted(members)))
        if not stack or stack[-1][0] < common:
            stack.append((common, begin))
    return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Rows sorted by key, in chunks of bounded size that part no key: (contexts, window digests)."""
    cold: list[tuple] = []
    hot: list[tuple] = []
    held, last = 0, None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if row[0] != last and (held >= CHUNK_BYTES or len(hot) >= 200_000):
                yield cold, hot
                cold, hot, held = [], [], 0
            last = row[0]
            if row[2]:
                cold.append(row)
                held += len(row[1])
            else:
                hot.append(row)
    if cold or hot:
        yield cold, hot


def _scan(cold: list[tuple]):
    """Text of a chunk's contexts, and their windows in suffix order with their intervals."""
    bodies = [r[1] for r in cold]
    text = np.frombuffer(b"".join(bodies), np.uint8)
    begins = np.cumsum([0] + [len(b) for b in bodies])[:-1]
    windows = np.array([r[2] for r in cold], np.int64)
    context = np.repeat(np.arange(len(cold)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    order, interval = suffix_intervals(text, begins[context] + offset)
    return text, begins, windows, order, interval


def _repeated(cold: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, length): the stretches of a chunk's contexts that its maximal repeats cover.

    A byte that no UTF-8 text has parts the contexts, so no repeat goes past the end of one.
    """
    bodies = [r[1] for r in cold]
    sizes = np.array([len(b) for b in bodies], np.int64)
    text = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    windows = np.array([r[2] for r in cold], np.int64)
    context = np.repeat(np.arange(len(cold)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = begins[context] + offset
    shorter: dict[int, np.ndarray] = {}
    ranks, _, _ = _prefix_ranks(text, max(320, int(sizes.max()) + 1), shorter)
    order = np.argsort(ranks[starts], kind="stable")
    starts, context, offset = starts[order], context[order], offset[order]
    rest = sizes[context] - offset
    common = np.zeros(len(starts), np.int64)
    common[1:] = _common_prefixes(text, shorter, starts[:-1], starts[1:], np.minimum(rest[:-1], rest[1:]))
    near = common > 0
    near[:-1] |= common[1:] > 0
    lefts = np.where(offset > 0, text[np.maximum(starts - 1, 0)].astype(np.int64), -1)
    groups = interval_scan(common[near].tolist(), lefts[near].tolist()) if near.any() else []
    longest = np.zeros(int(near.sum()), np.int64)
    for begin, end, length in reversed(groups):  # inner groups are longer and come last
        longest[begin:end] = length
    # A context that stands for several places is a repeat of its own to its end.
    whole = np.flatnonzero([len(r[3]) > _PLACE.itemsize for r in cold])
    begin = np.concatenate([starts[near][longest > 0], begins[whole]])
    end = begin + np.concatenate([longest[longest > 0], sizes[whole]])
    if not len(begin):
        return begin, begin, begin
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    reach = reach[np.append(first[1:], len(begin)) - 1]
    context = np.searchsorted(begins, begin[first], side="right") - 1
    return context, begin[first] - begins[context], reach - begin[first]


_SPAN_FIELDS = pa.schema([("digest", pa.binary()), ("spans", pa.binary())])


def _stretches(texts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """One row per text: its spans merged into stretches, as pairs of begin and end."""
    halves = np.ascontiguousarray(texts).view("<u8").reshape(-1, 2)
    order = np.lexsort((starts, halves[:, 1], halves[:, 0]))
    halves, starts = halves[order], starts[order].astype(np.int64)
    ends = starts + sizes[order]
    fresh = np.concatenate([[True], (halves[1:] != halves[:-1]).any(axis=1)])
    text = np.cumsum(fresh) - 1
    # Texts are set apart, so the reach of one never meets the next.
    reach = np.maximum.accumulate((text << 32) + ends)
    opens = np.flatnonzero(np.concatenate([[True], (text[1:] << 32) + starts[1:] > reach[:-1]]))
    closes = reach[np.append(opens[1:], len(reach)) - 1] - (text[opens] << 32)
    pairs = np.stack([starts[opens], closes], axis=1).astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], text[opens][1:] != text[opens][:-1]]))
    digests = halves[opens[first]]
    return pa.RecordBatch.from_arrays(
        [pa.array([d.tobytes() for d in digests], pa.binary()), pa.array([p.tobytes() for p in np.split(pairs, first[1:])], pa.binary())],
        schema=_SPAN_FIELDS,
    )


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, spans): stretches of a text that lie in maximal repeats, or in repeated windows of hot n-grams."""
    for cold, hot in _chunks(batches):
        texts, starts, sizes = [], [], []
        if cold:
            for c, off, size in zip(*(x.tolist() for x in _repeated(cold))):
                places = np.frombuffer(cold[c][3], _PLACE)
                texts.append(places["text"])
                starts.append(places["start"] + off)
                sizes.append(np.full(len(places), size))
        same: dict[bytes, list[bytes]] = {}
        for row in hot:  # equal windows have equal keys, and no key is parted
            same.setdefault(row[1], []).append(row[3])
        for packed in same.values():
            places = np.frombuffer(b"".join(packed), _PLACE)
            if len(places) > 1:
                texts.append(places["text"])
                starts.append(places["start"])
                sizes.append(np.full(len(places), MIN_BYTES))
        if texts:
            yield _stretches(np.concatenate(texts), np.concatenate(starts), np.concatenate(sizes))


def _merged_spans(size: int, packed: Sequence[bytes]) -> list[tuple[int, int]]:
    """Maximal covered stretches [begin, end) of a text from stretches that may overlap or touch."""
    pairs = np.frombuffer(b"".join(packed), np.int32).reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    opens = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]]))
    closes = np.minimum(reach[np.append(opens[1:], len(reach)) - 1], size)
    return list(zip(pairs[opens, 0].tolist(), closes.tolist()))


_CUT_FIELDS = pa.schema(
    [("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))]
)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for digest, z, spans in zip(*(batch.column(c).to_pylist() for c in ("digest", "z", "spans"))):
            raw = unpack(z)
            gone = _merged_spans(len(raw), spans)
            kept, at = hashlib.sha256(), 0
            for a, b in gone:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((digest, sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [list(s) for s in gone]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT_FIELDS)], schema=_CUT_FIELDS)


class _Prepared(NamedTuple):
    rows: DataFrame
    classes: DataFrame
    texts: DataFrame
    contexts: DataFrame


def _prepare(docs: DataFrame, hot_contexts: int) -> _Prepared:
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    columns = slim.mapInArrow(_text_columns(blocked.block_count(docs)), blocked.COLUMN_SCHEMA)
    rows = blocked.counts_by_flush(columns, "uint32", owned=True).groupBy("flush").applyInArrow(
        _text_hits(hot_contexts), "doc_id bigint, digest binary, n_bytes bigint, sha binary, hits binary"
    )
    rows = written(rows, "repeat-texts")
    classes = written(rows.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("copies")), "repeat-classes")
    need = rows.where("hits is not null").join(classes.select("digest", "head"), "digest").where(F.col("doc_id").eqNullSafe(F.col("head")))
    need = written(need.select(F.col("doc_id").alias("_id"), "digest", "hits"), "repeat-need")
    few = small_table(need.select("_id").distinct(), MAX_BROADCAST_IDS)
    open_docs = slim if few is None else slim.join(few, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    packed = open_docs.mapInArrow(_pack, "doc_id bigint, own binary, z binary")
    texts = packed.join(need, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("digest")))
    texts = written(texts.select("digest", "z", "hits"), "repeat-open")
    contexts = texts.mapInArrow(_contexts, CONTEXT_SCHEMA)
    dealt = contexts.repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key")
    return _Prepared(rows, classes, texts, dealt)


def remove_repeats(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Removed is each byte in a string of MIN_BYTES bytes that also starts anywhere else, in the same
    text or another; overlapping occurrences count. Null texts count as empty. Repeated rows and copies
    are other places, so a copied text of MIN_BYTES or more is removed whole. Ties cannot arise, since
    every occurrence goes. Null ids are kept as they are. Other columns are left out.
    """
    parts = _prepare(docs, hot_contexts)
    spans = parts.contexts.mapInArrow(_spans, "digest binary, spans binary")
    per_text = spans.groupBy("digest").agg(F.collect_list("spans").alias("spans"))
    cut = parts.texts.select("digest", "z").join(per_text, "digest").mapInArrow(
        _cut, "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>"
    )
    cut = written(cut.drop("spans").dropDuplicates(["digest"]), "repeat-cut")
    by_text = written(parts.classes.select("digest", "copies").join(cut, "digest", "left"), "repeat-results")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= MIN_BYTES)
    return parts.rows.select("doc_id", "digest", "n_bytes", "sha").join(by_text, "digest").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cold, hot in _chunks(batches):
        rows = []
        if cold:
            text, begins, windows, order, interval = _scan(cold)
            raw = text.tobytes()
            ends = np.append(begins[1:], len(text))
            cuts = np.flatnonzero(np.diff(interval)) + 1
            for members in np.split(order, cuts):
                context = np.searchsorted(begins, members, side="right") - 1
                lefts = np.where(members > begins[context], text[np.maximum(members - 1, 0)].astype(np.int64), -1)
                if len(members) == 1 and len(cold[context[0]][3]) == _PLACE.itemsize:
                    continue
                if lefts.min() == lefts.max() >= 0:
                    continue  # all follow the same byte: part of a repeat that starts earlier
                suffixes = [raw[a:b] for a, b in zip(members.tolist(), ends[context].tolist())]
                groups = interval_tree(suffixes, lefts.tolist(), MIN_BYTES)
                # A context that stands for several places is a repeat of its own to its end.
                groups += [
                    (len(s), [i]) for i, s in enumerate(suffixes)
                    if len(cold[context[i]][3]) > _PLACE.itemsize and not any(n == len(s) and i in g for n, g in groups)
                ]
                for length, group in groups:
                    places = [
                        (bytes(raw_place[:16]), int.from_bytes(raw_place[16:], "little") + int(members[i] - begins[context[i]]))
                        for i in group
                        for raw_place in _split_places(cold[context[i]][3])
                    ]
                    rows.append((_digest(suffixes[group[0]][:length]), length, [{"digest": d, "start": s} for d, s in sorted(places)]))
        same: dict[bytes, list[bytes]] = {}
        for _, body, _, places in hot:
            same.setdefault(body, []).extend(_split_places(places))
        for body, places in same.items():
            if len(places) > 1:
                rows.append((body, MIN_BYTES, [{"digest": p[:16], "start": int.from_bytes(p[16:], "little")} for p in sorted(places)]))
        if rows:
            kinds = (pa.binary(), pa.int32(), pa.list_(pa.struct([("digest", pa.binary()), ("start", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["repeat", "length", "places"])


def _split_places(packed: bytes) -> list[bytes]:
    size = _PLACE.itemsize
    return [packed[i : i + size] for i in range(0, len(packed), size)]


def repeat_groups(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(repeat, length, places): maximal repeats with all their occurrences.

    ``repeat`` is a digest of the string, ``places`` are text digests (see :func:`_digest`) with byte
    offsets; copies of a text are one text. A repeat that is longer than its contexts is reported as
    several that overlap, each with all its occurrences; the strings of very frequent n-grams are
    reported window by window. The occurrences of one string within a text and across texts are alike.
    """
    return _prepare(docs, hot_contexts).contexts.mapInArrow(
        _groups, "repeat binary, length int, places array<struct<digest: binary, start: int>>"
    )
