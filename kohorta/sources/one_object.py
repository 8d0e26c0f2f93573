"""Reading a file that is one large JSON object by many tasks.

The file is read as text that ends at closing brackets, which Spark splits into byte ranges by itself.
What a bracket or comma means depends on the depth and on whether a string is open, and a range does not
know either where it begins. So a first pass tells for each range, for both answers to the latter, what the
range changes; one row per range, chained on the driver, gives every range its state. The second pass cuts
the members of the object at the commas of the outermost level. A member that reaches past its range is put
together from its pieces, which carry the range it began in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What can change depth or string state; an escaped character is one token.
_TOKEN = re.compile(rb'\\.|["\[\]{},]', re.DOTALL)
_END = b"]"


def _depths(text: bytes, inside: bool) -> tuple[bool, int, set[int]]:
    """From a string state on: the state after the text, the change of depth, depths at which commas stand."""
    depth, commas = 0, set()
    for token in _TOKEN.finditer(text):
        c = token.group()
        if c == b'"':
            inside = not inside
        elif inside:
            continue
        elif c in b"[{":
            depth += 1
        elif c in b"]}":
            depth -= 1
        elif c == b",":
            commas.add(depth)
    return inside, depth, commas


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """(file, start of the range, its pieces) a batch at a time; the pieces of a range come in order."""
    for batch in batches:
        files, starts, values = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        while at < len(files):
            end = at
            while end < len(files) and files[end] == files[at] and starts[end] == starts[at]:
                end += 1
            yield files[at], starts[at], [v.encode() + _END for v in values[at:end]]
            at = end


def _summarized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range and first string state: the last one, the change of depth, and where commas stand."""
    seen: dict[tuple[str, int], list] = {}
    for file, start, pieces in _texts(batches):
        known = seen.setdefault((file, start), [[h, 0, set()] for h in (False, True)])
        text = b"".join(pieces)
        for way in known:
            inside, change, commas = _depths(text, way[0])
            way[2] |= {way[1] + d for d in commas}
            way[0], way[1] = inside, way[1] + change
    rows = [(f, s, first, way[0], way[1], sorted(way[2])) for (f, s), ways in seen.items() for first, way in zip((False, True), ways)]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
    columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)]
    yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "first", "last", "change", "commas"])


def object_members(spark: SparkSession, path: str) -> DataFrame:
    """(member): the members ``"name": value`` of the files' objects as text, in no order.

    Each file under ``path`` holds one JSON object. Empty objects and empty files have no members.
    """
    pieces = spark.read.option("lineSep", "]").text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), "value"
    )
    ways = pieces.mapInArrow(_summarized, "file string, start bigint, first boolean, last boolean, change bigint, commas array<bigint>")
    by_range: dict[tuple[str, int], dict[bool, tuple]] = {}
    for r in ways.orderBy("file", "start").collect():  # two rows per range
        by_range.setdefault((r["file"], r["start"]), {})[r["first"]] = (r["last"], r["change"], r["commas"])
    # (string state, depth, range in which the open member began) at the start of every range
    states: dict[tuple[str, int], tuple[bool, int, int]] = {}
    at_file, inside, depth, owner = None, False, 0, 0
    for (file, start), known in sorted(by_range.items()):
        if file != at_file:
            at_file, inside, depth, owner = file, False, 0, -1  # no range: the first member
        states[(file, start)] = (inside, depth, owner)
        last, change, commas = known[inside]
        if 1 - depth in commas:
            owner = start
        inside, depth = last, depth + change
    shared = spark.sparkContext.broadcast(states)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[str, int], list] = {}

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 5, kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["file", "owner", "start", "text", "whole"])

        for file, start, parts in _texts(batches):
            if (file, start) not in open_:
                inside, depth, owner = shared.value[(file, start)]
                # State, depth, owner of the open member, its bytes so far, whether it began in this range.
                open_[(file, start)] = [inside, depth, owner, [], False]
            state = open_[(file, start)]
            inside, depth, owner, held, own = state
            text, begin, found = b"".join(parts), 0, []
            for token in _TOKEN.finditer(text):
                c = token.group()
                if c == b'"':
                    inside = not inside
                elif inside:
                    continue
                elif c in b"[{":
                    depth += 1
                    if depth == 1:  # the object itself
                        begin = token.end()
                elif c in b"]}":
                    depth -= 1
                    if depth == 0:  # its end: what follows is no member
                        held.append(text[begin : token.start()])
                        begin = len(text)
                elif depth == 1:
                    held.append(text[begin : token.start()])
                    found.append((file, owner, start, b"".join(held).decode(), own))
                    held, owner, own, begin = [], start, True, token.end()
            if depth > 0 and begin < len(text):
                held.append(text[begin:])
            state[:] = [inside, depth, owner, held, own]
            if found:
                yield rows(found)
        left = [(f, s[2], start, b"".join(s[3]).decode(), False) for (f, start), s in open_.items()]
        if left:
            yield rows(left)

    parts = pieces.mapInArrow(cut, "file string, owner bigint, start bigint, text string, whole boolean")
    whole = parts.where("whole").select("text")
    joined = parts.where("not whole").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    stitched = joined.select(F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"))
    return whole.unionByName(stitched).select(F.trim("text").alias("member")).where("trim(both ' \n\r\t' from member) <> ''")
