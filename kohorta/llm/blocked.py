"""Blocked incidence counts: which keys of many documents occur elsewhere, and how often.

Documents by keys is a huge sparse matrix. Its columns are cut into blocks by a hash. A task gathers
the documents it reads into flushes of bounded size and sends, for each flush and block, one row of
packed arrays instead of a row per entry. A key that several documents of a flush share travels once
with its count, so a key of a third of all documents costs one entry per flush. The task of a block
adds up its columns and reports back to each flush.

Within a block, keys are compared by 32 more bits of their hash. A collision can only make a key look
shared that is not: the counts are upper bounds, which is the safe side for every use of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kohorta.llm.common import shuffle_partitions

#: Entries of a flush; it bounds a task's buffers.
FLUSH_ENTRIES = 500_000
#: Documents of a flush, so a document's number fits in 16 bits.
FLUSH_DOCS = 60_000
BLOCKS_PER_PARTITION = 4

COLUMN_SCHEMA = "block int, flush bigint, tags binary, rests binary, weights binary, owners binary, note binary"
COUNT_SCHEMA = "flush bigint, tags binary, counts binary, note binary"

_COLUMN_FIELDS = pa.schema(
    [("block", pa.int32()), ("flush", pa.int64()), *[(c, pa.binary()) for c in ("tags", "rests", "weights", "owners", "note")]]
)
_COUNT_FIELDS = pa.schema([("flush", pa.int64()), ("tags", pa.binary()), ("counts", pa.binary()), ("note", pa.binary())])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def block_count(df: DataFrame) -> int:
    return BLOCKS_PER_PARTITION * shuffle_partitions(df.sparkSession)


def flush_number(note: bytes, nth: int) -> int:
    """The number of a task's ``nth`` flush, the same whenever the task is run again.

    Flushes of the same rows have the same note, so the task and the flush's place in it count as well.
    """
    return xxhash.xxh3_64_intdigest(note + b"%d %d" % (TaskContext.get().partitionId(), nth)) >> 1


def column_rows(
    blocks: int, flush: int, keys: np.ndarray, tags: np.ndarray, weights: np.ndarray, note: bytes, owners: np.ndarray | None = None
) -> pa.RecordBatch:
    """The rows of one flush: entries by block, and one row with the flush's own note."""
    h = mixed(keys)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    starts = np.concatenate([[0], cuts]) if len(order) else np.empty(0, np.int64)
    ends = np.append(cuts, len(order)) if len(order) else np.empty(0, np.int64)
    sent = [
        tags[order],
        (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order],
        np.minimum(weights, 65535).astype(np.uint16)[order],
        None if owners is None else owners[order],
    ]
    rows = {name: [] for name in _COLUMN_FIELDS.names}
    for a, b in zip(starts.tolist(), ends.tolist()):
        rows["block"].append(int(block[order[a]]))
        for name, values in zip(("tags", "rests", "weights", "owners"), sent):
            rows[name].append(None if values is None else values[a:b].tobytes())
    n = len(rows["block"])
    rows["flush"], rows["note"] = [flush] * (n + 1), [None] * n + [note]
    rows["block"].append(flush % blocks)
    for name in ("tags", "rests", "weights", "owners"):
        rows[name].append(None)
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _COLUMN_FIELDS], schema=_COLUMN_FIELDS)


def _counted(tag_type: str, owned: bool):
    unwanted = np.iinfo(tag_type).max

    def count(table: pa.Table) -> pa.Table:
        columns = {f: table.column(f).to_pylist() for f in table.column_names}
        at = [i for i, note in enumerate(columns["note"]) if note is None]
        rests = [np.frombuffer(columns["rests"][i], np.uint32) for i in at]
        out = {"flush": [], "tags": [], "counts": [], "note": []}
        if at:
            sizes = np.array([len(r) for r in rests])
            packed = np.concatenate(rests).astype(np.uint64) << np.uint64(32) | np.arange(sizes.sum(), dtype=np.uint64)
            packed.sort()
            order = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], np.diff(packed >> np.uint64(32)) > 0]))
            weights = np.concatenate([np.frombuffer(columns["weights"][i], np.uint16) for i in at]).astype(np.int64)
            sums = np.add.reduceat(weights[order], starts)
            if owned:
                owners = np.concatenate([np.frombuffer(columns["owners"][i], np.uint64) for i in at])[order]
                least = np.minimum.reduceat(owners, starts)
                differ = (least == 0) | (least != np.maximum.reduceat(owners, starts))
                sums = np.where(differ, sums, 1)
            counts = np.empty(len(order), np.int64)
            counts[order] = np.repeat(sums, np.diff(np.append(starts, len(order))))
            ends = np.cumsum(sizes)
            for i, a, b in zip(at, ends - sizes, ends):
                tags = np.frombuffer(columns["tags"][i], tag_type)
                wanted = (counts[a:b] > 1) & (tags != unwanted)
                if wanted.any():
                    out["flush"].append(columns["flush"][i])
                    out["tags"].append(tags[wanted].tobytes())
                    out["counts"].append(np.minimum(counts[a:b][wanted], 65535).astype(np.uint16).tobytes())
                    out["note"].append(None)
        for i, note in enumerate(columns["note"]):
            if note is not None:
                for name, value in zip(out, (columns["flush"][i], None, None, note)):
                    out[name].append(value)
        return pa.table([pa.array(out[f.name], f.type) for f in _COUNT_FIELDS], schema=_COUNT_FIELDS)

    return count


def counts_by_flush(columns: DataFrame, tag_type: str, owned: bool = False) -> DataFrame:
    """For every flush its note, and tags and counts of its entries whose key occurs more than once.

    With ``owned``, a key counts as shared only if its entries have two different owners, or the owner
    zero, which stands for several.
    """
    return columns.groupBy("block").applyInArrow(_counted(tag_type, owned), COUNT_SCHEMA)


def gathered(table: pa.Table, tag_type: str) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(note, tags, counts) of the one flush that ``table`` holds."""
    columns = {f: table.column(f).to_pylist() for f in table.column_names}
    notes = [n for n in columns["note"] if n is not None]
    tags = [np.frombuffer(t, tag_type) for t in columns["tags"] if t is not None]
    counts = [np.frombuffer(c, np.uint16) for c in columns["counts"] if c is not None]
    joined = (np.concatenate(tags), np.concatenate(counts)) if tags else (np.empty(0, tag_type), np.empty(0, np.uint16))
    # Two flushes could draw the same number; their notes would meet here and must not be mixed up.
    if len(notes) != 1:
        raise ValueError(f"{len(notes)} flushes have one number")
    yield notes[0], *joined
