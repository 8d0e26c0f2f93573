"""Inputs on which an operator once did less than its whole job."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kohorta.llm import repeats
from kohorta.llm.licenses import LICENSES, NOTICES, WORDINGS, license_report, scan_licenses, signature_rules
from kohorta.llm.line_dedup import LONG_BYTES, _fingerprints, dedup_lines
from kohorta.llm.mixing import mix_sources
from kohorta.llm.ngram_join import ngram_components
from kohorta.llm.repeats import remove_repeats
from tests.llm import brute


def _words(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(pick.randrange(40)) for _ in range(n))


# ---- lines


def test_a_long_line_is_a_repeat_by_itself(spark):
    passage, unspaced, at_least, short = _words(1, 51), "世界" * 40, "x" * LONG_BYTES, "x" * (LONG_BYTES - 1)
    rows = [
        (1, passage),
        (2, f"one above\n{passage}\nand one below"),
        (3, f"{passage}  \n\nother"),
        (4, passage),
        (5, f"a\n{unspaced}\nb\n{at_least}\nc\n{short}\nd"),
        (6, f"e\n{unspaced}\nf\n{at_least}\ng\n{short}\nh"),
        (7, f"k\n{passage}\nl\n{passage}\nand one below"),
    ]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert {d: (r.n_removed, r.n_runs) for d, r in got.items()} == {1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (0, 0), 6: (2, 2), 7: (3, 2)}
    assert got[2].text == "one above\nand one below" and got[3].text == "\nother" and got[4].text == ""
    assert got[6].text == f"e\nf\ng\n{short}\nh" and got[7].text == "k\nl"


def test_line_dedup_keeps_one_of_each_line(spark):
    pick = random.Random(6)
    lines = [_words(i, 30) for i in range(6)] + ["a", "b", "c"]
    rows = [(i, "\n".join(pick.choice(lines) for _ in range(pick.randint(1, 6)))) for i in range(40)]
    seen, runs, want = set(), set(), {}
    for doc_id, text in rows:
        own = text.split("\n")
        gone = {i for i, line in enumerate(own) if len(line) >= LONG_BYTES and (line in seen or line in own[:i])}
        for i, run in enumerate(zip(own, own[1:])):
            gone |= {i, i + 1} if run in runs else set()
            runs.add(run)
        seen |= set(own)
        want[doc_id] = "\n".join(line for i, line in enumerate(own) if i not in gone)
    got = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert {x for t in want.values() for x in t.split("\n") if x} == {x for _, t in rows for x in t.split("\n")}


# ---- mixing


def test_large_rates_are_drawn_in_parts(spark):
    rows = [(i, f"text {i}", "hot" if i < 40 else None) for i in range(41)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix_sources(docs, {"hot": 0.9, None: 0.1}, repetition=1000.0)
    per_doc = got.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.min("copy").alias("a"), F.max("copy").alias("b"),
        F.max("copies").alias("k"), F.max("rate").alias("rate"),
    ).collect()
    assert len(per_doc) == 41
    for r in per_doc:
        assert (r.n, r.d, r.a, r.b) == (r.k, r.k, 0, r.k - 1)
        assert r.rate > 900 and abs(r.k - r.rate) < 6 * math.sqrt(r.rate)
    scores = [(r.k - r.rate) / math.sqrt(r.rate) for r in per_doc]
    assert abs(sum(scores)) < 5 * math.sqrt(41) and 0.3 < sum(x * x for x in scores) / 41 < 2.2
    again = mix_sources(docs.repartition(5), {"hot": 0.9, None: 0.1}, repetition=1000.0)
    assert again.groupBy("doc_id").count().exceptAll(got.groupBy("doc_id").count()).count() == 0


def test_a_stray_source_beside_large_ones_is_mixed(spark):
    docs = spark.range(300_001).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") > 0, "large").alias("source")
    )
    got = mix_sources(docs, repetition=1.0, temper=0.5)
    stray = got.where("source is null").agg(F.count("*").alias("n"), F.max("copies").alias("k"), F.max("rate").alias("rate")).first()
    assert stray.rate > 500 and stray.n == stray.k and abs(stray.n - stray.rate) < 6 * math.sqrt(stray.rate)


@pytest.mark.parametrize("gram, window", [(1, 2), (2, 3), (1, 5), (3, 1)])
def test_fingerprints_reach_every_run_once(spark, gram, window):
    pick = random.Random(8)
    for n in (0, 1, gram, gram + window - 1, 60):
        lines = [pick.choice("abc").encode() for _ in range(n)]
        size, runs = gram + window - 1, {}
        found = _fingerprints(b"\n".join(lines), gram, window, LONG_BYTES)
        for place, fp, reach in found:
            for i in range(len(reach) // 16):
                runs[place // 2 + i] = fp, reach[16 * i : 16 * i + 16]
        assert sorted(runs) == list(range(max(0, n - size + 1))) and sum(len(r) // 16 for _, _, r in found) == len(runs)
        same = {}
        for start, run in runs.items():
            same.setdefault(tuple(lines[start : start + size]), set()).add(run)
        assert all(len(v) == 1 for v in same.values()) and len(set.union(set(), *same.values())) == len(same)


def test_line_dedup_by_longer_windows_matches_brute_force(spark):
    pick = random.Random(9)
    rows = [(i, "\n".join(pick.choice("abcd") for _ in range(pick.randint(0, 30)))) for i in range(60)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), gram=2, window=3).collect()
    got = {r.doc_id: r.n_removed for r in got}
    assert [got[i] for i, _ in rows] == brute.removed_lines(rows, size=4)


# ---- licenses


def _example(pattern: str) -> str:
    """The shortest words that a rule's pattern takes: optional parts left out, the first of each choice."""
    pattern = re.sub(r"\(\?:[^()|]*\)\?", "", pattern).replace(" ?", " ").replace("s?", "s")
    while (plain := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?)?", lambda m: "" if m[2] else m[1], pattern)) != pattern:
        pattern = plain
    return re.sub(r"\[(.)[^\]]*\](?:\{\d\})?", lambda m: m[1], pattern.replace("[0-9]{2}", "19"))


def test_one_example_of_every_rule_passes_the_gate(spark):
    named = [(label.removesuffix("-short"), _example(name)) for label, _, name in LICENSES]
    rows = named + [(label, _example(p)) for _, label, _, p in NOTICES + WORDINGS] + [("mit-0", "released under MIT No Attribution")]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: (r.labels or "").split(",") for r in license_report(docs).collect()}
    assert [rows[i] for i in range(len(rows)) if rows[i][0] not in got[i]] == []


def test_matches_are_found_in_any_number(spark):
    """Blocks of matches end and begin anywhere; kept matches follow the rule of containment."""
    pick = random.Random(4)
    parts = ["MIT License", "under the MIT license", "copyright 2019", "licensed under", "GNU GPL v3", "Apache License 2.0", "word", "a b c"]
    texts = [" ".join(pick.choice(parts) for _ in range(n)) for n in (0, 1, 255, 256, 257, 700)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rules = [(r.priority, r.label, r.pattern) for r in signature_rules()]
    for row in scan_licenses(docs).collect():
        words = re.findall("[a-z0-9]+", texts[row.doc_id].lower())
        spaced = "".join(f" {w} " for w in words)
        found = sorted({(m.start(), -m.end(), -p, label) for p, label, pattern in rules for m in re.finditer(pattern, spaced)})
        kept = [m for i, m in enumerate(found) if not any(-b[1] >= -m[1] and -b[2] >= -m[2] for b in found[:i])]
        assert [(d.start, -d.end, -d.priority, d.label) for d in row.detections] == kept


def test_a_text_of_many_mentions_takes_time_in_proportion(spark):
    docs = spark.createDataFrame([(1, "mit license, " * 100_000)], "doc_id bigint, text string")
    began = time.monotonic()
    row = license_report(docs).first()
    assert (row.n_words, row.n_base, row.n_detections, row.labels) == (200_000, 100_000, 100_000, "mit")
    assert time.monotonic() - began < 120


# ---- flushes


@pytest.mark.parametrize("fills_a_flush", [False, True])
def test_flushes_of_equal_rows(spark, fills_a_flush):
    text = _words(7, 300)
    once = spark.createDataFrame([(1, text), (2, _words(8, 90))], "doc_id bigint, text string").coalesce(1)
    if fills_a_flush:
        rows = [(1, " ".join(f"{i:x}" for i in range(500_010)))] * 3
        docs = spark.createDataFrame(rows[:1], "doc_id bigint, text string").select(F.explode(F.array_repeat(F.struct("doc_id", "text"), 3)).alias("r")).select("r.*")
    else:
        rows = [(1, text), (2, _words(8, 90))] * 2
        docs = once.union(once)
    n = [len(t.split()) - 4 for _, t in rows]
    assert sorted(map(tuple, ngram_components(docs).collect())) == sorted((d, k, d) for (d, _), k in zip(rows, n))
    want = sorted((d, len(t), len(t), 1, brute.sha(b"")) for d, t in rows)
    assert sorted(map(tuple, remove_repeats(docs).collect())) == want


# ---- repeats


def test_scan_yields_the_maximal_repeats_of_the_tree():
    pick = random.Random(5)
    for _ in range(100):
        texts = [bytes(pick.choice(b"ab") for _ in range(pick.randint(1, 12))) for _ in range(4)]
        places = [(t, i) for t in texts for i in range(len(t))]
        suffixes, lefts = [t[i:] for t, i in places], [t[i - 1] if i else -1 for t, i in places]
        order = sorted(range(len(suffixes)), key=lambda i: suffixes[i])
        common = [0] + [n if (n := repeats._common(suffixes[a], suffixes[b])) >= 2 else 0 for a, b in zip(order, order[1:])]
        got = {(n, tuple(sorted(order[b:e]))) for b, e, n in repeats.interval_scan(common, [lefts[i] for i in order])}
        assert got == {(n, tuple(g)) for n, g in repeats.interval_tree(suffixes, lefts, 2)}


def test_maximal_repeats_cover_every_repeated_window():
    pick = random.Random(5)
    for _ in range(60):
        units = [bytes(pick.choice(b"ab\x00z") for _ in range(pick.choice([1, 2, 90, 230, 400]))) for _ in range(4)]
        bodies = {b"".join(pick.choice(units) for _ in range(pick.randint(1, 8)))[:2247] for _ in range(pick.randint(1, 7))}
        cold = [(1, b, len(b) - 199, b"x" * 20 * pick.choice([1, 1, 1, 2])) for b in sorted(bodies) if len(b) >= 200]
        if not cold:
            continue
        seen = Counter()
        for _, body, windows, places in cold:
            for i in range(windows):
                seen[body[i : i + 200]] += len(places) // 20
        want = {(c, j) for c, (_, b, n, _) in enumerate(cold) for i in range(n) if seen[b[i : i + 200]] > 1 for j in range(i, i + 200)}
        stretches = list(zip(*(x.tolist() for x in repeats._repeated(cold))))
        assert {(c, j) for c, at, size in stretches for j in range(at, at + size)} == want


def test_the_query_scans_its_intervals(monkeypatch):
    called = []
    monkeypatch.setattr(repeats, "interval_scan", lambda *a, scan=repeats.interval_scan: called.append(a) or scan(*a))
    body = bytes(random.Random(1).choice(b"abcdef") for _ in range(300))
    rows = [(7, b, len(b) - 199, bytes([i]) * 16 + b"\0" * 4) for i, b in enumerate((b"1" + body, b"2" + body))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), repeats._CONTEXT_FIELDS)], schema=repeats._CONTEXT_FIELDS)
    found = [
        (r["digest"], a, b - a)
        for out in repeats._spans(iter([batch]))
        for r in out.to_pylist()
        for a, b in np.frombuffer(r["spans"], np.int32).reshape(-1, 2).tolist()
    ]
    assert called and found == [(bytes([i]) * 16, 1, 300) for i in range(2)]
