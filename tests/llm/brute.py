"""Plain versions of the operators, by their definitions, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def removed_repeats(texts: list[str | None], size: int = 200) -> list[tuple[int, int, int, str]]:
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i : i + size] for raw in raws for i in range(len(raw) - size + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if seen[raw[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, sha(bytes(c for c, g in zip(raw, gone) if not g))))
    return out


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    words = BLANKS.findall(lowered(text))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def components(rows: list[tuple[int | None, str | None]]) -> list[tuple[int, int | None]]:
    """(n_shingles, component_id) per row."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least: dict[int, int | None] = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        if doc_id is not None and (least.get(r) is None or doc_id < least[r]):
            least[r] = doc_id
    return [(len(s), least.get(root(i))) for i, s in enumerate(sets)]


def hit_words(text: str | None, items: list[tuple[int, str | None]], size: int = 13) -> tuple[list[bool], set[str]]:
    words = WORD.findall(lowered(text))
    windows: dict[tuple[str, ...], set[str]] = {}
    for item, content in items:
        found = WORD.findall(lowered(content))
        k = min(size, len(found))
        for i in range(len(found) - k + 1 if found else 0):
            windows.setdefault(tuple(found[i : i + k]), set()).add(str(item))
    hit, names = [False] * len(words), set()
    for k in {len(w) for w in windows}:
        for i in range(len(words) - k + 1):
            if found := windows.get(tuple(words[i : i + k])):
                names |= found
                hit[i : i + k] = [True] * k
    return hit, names


def contamination(text: str | None, items: list[tuple[int, str | None]]) -> tuple:
    hit, names = hit_words(text, items)
    return len(hit), sum(hit), len(names), sha(",".join(sorted(names)).encode()), sum(hit) > 0 and 20 * sum(hit) >= len(hit)


def base_licenses(text: str | None) -> tuple:
    words = WORD.findall(lowered(text))
    starts, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        parts = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def removed_lines(rows: list[tuple[int | None, str | None]], size: int = 2, long_bytes: int = 100) -> list[int]:
    """Lines per row that go as part of a repeated run, or as a repeated long line; ids must differ."""
    seen: set[tuple[str, ...]] = set()
    out = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0])):
        lines = [x for x in (line.strip() for line in (rows[i][1] or "").split("\n")) if x]
        gone = set()
        for at in range(len(lines) - size + 1):
            run = tuple(lines[at : at + size])
            if run in seen:
                gone |= set(range(at, at + size))
            seen.add(run)
        for at, line in enumerate(lines):
            if len(line.encode()) >= long_bytes:
                gone |= {at} if (line,) in seen else set()
                seen.add((line,))
        out[i] = len(gone)
    return [out[i] for i in range(len(rows))]
