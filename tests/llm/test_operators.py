"""The text operators against plain versions, exact round trips and held-out accuracy."""

import itertools
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kohorta.llm import queries as Q
from kohorta.llm import ngram_join, repeats
from kohorta.llm.common import table as given
from kohorta.llm.decontamination import ItemAutomaton
from kohorta.llm.fingerprints import Fingerprint, fingerprint
from kohorta.llm.licenses import license_report, scan_licenses, signature_rules
from kohorta.llm.mixing import hash_uniform, mix_sources, poisson_draws
from kohorta.llm.token_counts import TokenLedger, count_changes, deletes, inserts, revisions, without_echoes, word_counter
from kohorta.llm.toxicity import ToxicityModel, fit_sample
from kohorta.session import run_dir
from tests.llm import brute

SF = os.environ.get("KOHORTA_TEST_SF", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in given(spark, SF, "documents").orderBy("doc_id").collect()]


# ---- repeats


@tables
def test_repeats_match_brute_force(spark, documents):
    got = {r.doc_id: tuple(r)[1:] for r in Q.op1_repeats(spark, SF).collect()}
    want = brute.removed_repeats([t for _, t in documents])
    assert [got[d] for d, _ in documents] == want


def test_hot_keys_take_the_same_bytes(spark):
    pick = random.Random(3)
    shared = "".join(pick.choice("abcdefgh ") for _ in range(420))
    rows = [(i, f"{pick.random()}" * 12 + shared + f"{pick.random()}" * 12) for i in range(25)]
    rows += [(100, "xy" * 400), (101, shared[:199]), (102, shared[:200])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted((d, *w) for (d, _), w in zip(rows, brute.removed_repeats([t for _, t in rows])))
    for limit in (1, 4, 4000):
        assert sorted(map(tuple, repeats.remove_repeats(docs, hot_contexts=limit).collect())) == want


def test_suffix_intervals_sort_to_their_depth(monkeypatch):
    pick = random.Random(2)
    unit = bytes(pick.choice(b"ab") for _ in range(300))
    raw = unit + b"a" * 300 + unit + b"b" + unit[:250]
    starts = np.arange(len(raw) - 199)
    for packed in (21, 4):
        monkeypatch.setattr(repeats, "_PACKED_BITS", packed)
        order, interval = repeats.suffix_intervals(np.frombuffer(raw, np.uint8), starts)
        cut = [raw[i : i + 200] for i in order]
        assert cut == sorted(cut)
        assert [int(a != b) for a, b in zip(cut, cut[1:])] == np.diff(interval).tolist()


def test_maximal_repeats_of_an_interval_tree():
    texts = [b"xabcabc", b"yabcab", b"zabd"]
    places = [(t, i) for t in texts for i in range(len(t))]
    suffixes = [t[i:] for t, i in places]
    lefts = [t[i - 1] if i else -1 for t, i in places]
    got = {(suffixes[g[0]][:n], tuple(g)) for n, g in repeats.interval_tree(suffixes, lefts, 2)}
    want = set()
    for s in {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 2, len(t) + 1)}:
        found = tuple(i for i, x in enumerate(suffixes) if x.startswith(s))
        ends = {suffixes[i][len(s) : len(s) + 1] or i for i in found}
        before = {lefts[i] for i in found}
        if len(found) > 1 and len(ends) > 1 and (len(before) > 1 or -1 in before):
            want.add((s, found))
    assert got == want


def test_repeat_groups_have_all_occurrences(spark):
    pick = random.Random(9)
    shared = "".join(pick.choice("abcdefgh ") for _ in range(260))
    own = lambda: "".join(pick.choice("0123456789") for _ in range(350))
    rows = [(i, own() + shared + own()) for i in range(3)]
    groups = repeats.repeat_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    digests = {repeats._digest(t.encode()): t.encode() for _, t in rows}
    covered = set()
    for g in groups:
        strings = {digests[bytes(p.digest)][p.start : p.start + g.length] for p in g.places}
        assert len(strings) == 1 and g.length >= repeats.MIN_BYTES
        found = {(bytes(p.digest), p.start) for p in g.places}
        (string,) = strings
        assert len(found) == len(g.places) >= 2
        assert found == {(d, i) for d, t in digests.items() for i in range(len(t)) if t.startswith(string, i)}
        covered |= {p.start + i - digests[bytes(p.digest)].index(shared.encode()) for p in g.places for i in (0, g.length - 1)}
    assert min(covered) <= 0 and max(covered) >= 259


# ---- n-gram join


def test_components_match_brute_force(spark, monkeypatch):
    pick = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    base = [pick.choice(words) for _ in range(60)]
    rows = []
    for i in range(120):
        own = base[:] if i % 3 else [pick.choice(words) for _ in range(pick.randint(0, 40))]
        for _ in range(pick.randint(0, 4)):
            if own:
                own[pick.randrange(len(own))] = pick.choice(words)
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted((d, *c) for (d, _), c in zip(rows, brute.components(rows)))
    for rows_of_block in (4, 256):
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows_of_block)
        assert sorted(map(tuple, ngram_join.ngram_components(docs).collect())) == want


def test_products_in_column_blocks(monkeypatch):
    pick = np.random.default_rng(3)
    base = pick.integers(0, 1 << 60, 50).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[pick.random(50) < 0.93], pick.integers(0, 1 << 60, 4).astype(np.uint64)])) for _ in range(30)]
    want = {(i, j) for j in range(30) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert 0 < len(want) < 435
    for cells in (200, 4_000_000):
        monkeypatch.setattr(ngram_join, "BLOCK_CELLS", cells)
        assert set(map(tuple, ngram_join.linked_pairs(sets).tolist())) == want
        crossed = {(i, j) for i, j in want if i < 12 <= j}
        assert {(i, j + 12) for i, j in ngram_join.linked_pairs(sets[:12], sets[12:]).tolist()} == crossed


# ---- scores


def _auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@tables
@pytest.mark.parametrize("query, label, least", [(Q.op6_quality, "quality", 0.95), (Q.op2_toxicity, "toxic", 0.85)])
def test_scores_separate_held_out_labels(spark, query, label, least):
    sf = SF.replace("sf0.001", "sf0.1") if os.path.isdir(SF.replace("sf0.001", "sf0.1")) else SF
    got = query(spark, sf).join(given(spark, sf, "labels"), "doc_id").where("held_out").select("doc_id", "score", label).toPandas()
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id)
    assert _auc(got[label].to_numpy(), got.score.to_numpy()) > least


def test_misspelt_words_share_their_grams():
    pick = random.Random(1)
    clean = lambda: " ".join("".join(pick.choice("aeioulmnrst") for _ in range(6)) for _ in range(12))
    sample = [(f"{clean()} disgusting {clean()}".encode(), 1) for _ in range(60)] + [(clean().encode(), 0) for _ in range(240)]
    model = fit_sample(sample)
    bad, good = model.scores([f"{clean()} disgustin {clean()}".encode(), clean().encode()], {})
    assert bad > good
    assert ToxicityModel(model.gram_scores, model.bias, model.prior).scores([b""], {}) == [0.0]


# ---- fingerprints


def test_fingerprints_are_homomorphic():
    a, b, c = "first paragraph of some length", "the second one, longer than that", "third"
    one = fingerprint(f"{a}\n{b}\n{c}")
    assert one == fingerprint(f"{c}\n\n{a}\n{b}") and one.likeness(fingerprint(f"{b}\n{c}\n{a}")) == 1.0
    assert one == fingerprint(a) + fingerprint(f"{b}\n{c}")
    assert one - fingerprint(b) == fingerprint(f"{a}\n{c}")
    assert one != fingerprint(f"{a}\n{b}\n{b}\n{c}") and fingerprint(f"{a}\n{a}") != fingerprint(a)
    assert Fingerprint.from_text(one.to_text()) == one
    assert fingerprint(None) == fingerprint("") == fingerprint("\n")


@tables
def test_fingerprint_query(spark, documents):
    import hashlib

    got = {r.doc_id: r for r in Q.op5_fingerprints(spark, SF).collect()}
    order = [(d, t or "") for d, t in reversed(documents)]
    near, apart = [], []
    for i, (doc_id, text) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        row = got[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == fingerprint(text).to_text() and row.edited_fingerprint == fingerprint(edited).to_text()
        if len(text) > 200:
            near.append(row.near_edited)
            apart.append(row.near_next)
    assert np.mean([a > b for a, b in zip(near, apart)]) > 0.97


# ---- licenses


@tables
def test_licenses_match_brute_force(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in Q.op10_license_scan(spark, SF).collect()}
    assert got == {d: brute.base_licenses(t) for d, t in documents}


def test_rules_resolve_overlaps(spark):
    text = "Released under the GNU Lesser General Public License, version 2.1. Copyright (c) 2019. MIT License MIT License"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = license_report(docs).first()
    assert row.labels == "copyright-notice,gpl,lgpl-2.1,mit" and row.base_labels == "gpl,mit" and row.score == 0.8
    assert (row.n_base, row.first_word, row.last_word) == (3, 5, 16)
    found = scan_licenses(docs).first().detections
    for a, b in itertools.permutations(found, 2):
        assert not (b.start <= a.start and a.end <= b.end and b.priority >= a.priority)
    assert len(signature_rules()) > 250 and len({(r.label, r.pattern) for r in signature_rules()}) == len(signature_rules())


# ---- decontamination


def test_automaton_matches_brute_force():
    pick = random.Random(1)
    for trial in range(200):
        letters = "abcd"[: pick.randint(1, 4)]
        sizes = [0, 1, 2, 5, 13, 14, 20] if trial % 2 else [6, 13, 14, 20]
        items = [(i, " ".join(pick.choice(letters) for _ in range(pick.choice(sizes)))) for i in range(pick.randint(0, 5))]
        words = [pick.choice(letters + "z") for _ in range(60)]
        if items and pick.random() < 0.7:
            words[10:10] = pick.choice(items)[1].split()
        spans, found = ItemAutomaton([(str(i), t.encode().split()) for i, t in items]).find([w.encode() for w in words])
        hit = [False] * len(words)
        for a, b in spans:
            hit[a:b] = [True] * (b - a)
        assert (hit, found) == brute.hit_words(" ".join(words), items)


# ---- lines


@tables
def test_line_dedup_matches_brute_force(spark, documents):
    got = {r.doc_id: r.n_removed for r in Q.op7_line_dedup(spark, SF).collect()}
    assert [got[d] for d, _ in documents] == brute.removed_lines(documents)


# ---- mixing


def test_poisson_draws_follow_the_distribution(spark):
    rate = 1.7
    rows = spark.range(20_000).select(F.size(poisson_draws(hash_uniform(F.lit(1), F.col("id")), F.lit(rate))).alias("k"))
    counts = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    for k in range(6):
        p = math.exp(-rate) * rate**k / math.factorial(k)
        assert abs(counts.get(k, 0) / 20_000 - p) < 4 * math.sqrt(p / 20_000)


def test_mixture_reaches_its_weights(spark):
    docs = spark.range(9000).select(
        F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") < 8000, "big").otherwise("small").alias("source")
    )
    mixed = mix_sources(docs, {"big": 0.5, "small": 0.5}, repetition=1.0)
    sizes = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(sizes["big"] - 4500) < 250 and abs(sizes["small"] - 4500) < 250
    once, again = ([tuple(r) for r in mix_sources(docs.repartition(n), temper=0.5).orderBy("doc_id", "copy").collect()] for n in (1, 5))
    assert once == again


# ---- token counts


def test_ledger_adds_up_and_commits_once(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "en", "s"), (2, "d\nd\ne", "en", "s"), (3, None, "de", "t"), (4, "f g", None, "t")],
        "doc_id bigint, text string, lang string, source string",
    )
    versions = {"words/1": word_counter}
    ledger = TokenLedger(spark, f"{run_dir(spark)}/ledger-test")
    assert ledger.totals().count() == 0
    batches = [
        ("insert", inserts(docs)),
        ("delete", deletes(docs.where("doc_id = 1"))),
        ("revise", revisions(docs.where("doc_id > 1"), without_echoes(F.col("text")))),
    ]
    assert [ledger.commit(name, count_changes(rows, versions)) for name, rows in batches] == [True] * 3
    assert [ledger.commit(name, count_changes(rows, versions)) for name, rows in batches] == [False] * 3
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in ledger.totals().collect()}
    assert got == {("s", "en", "words/1"): (1, 2, 3), ("t", "de", "words/1"): (1, 0, 0), ("t", None, "words/1"): (1, 2, 3)}


# ---- pipeline


@tables
def test_pipeline_stages_match_brute_force(spark):
    docs, names = given(spark, SF, "documents"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "decontamination", "mixture"]
    items = [(r.item_id, r.text) for r in given(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
        out = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
        if name == "line_dedup":
            lines = [len([x for x in (t or "").split("\n") if x.strip()]) for _, t in before]
            gone = {d for (d, _), n, k in zip(before, brute.removed_lines(before), lines) if n and n == k}
            assert kept == {d for d, _ in before} - gone
        elif name == "near_duplicates":
            assert kept == {d for (d, _), (_, head) in zip(before, brute.components(before)) if d == head}
        elif name == "decontamination":
            assert kept == {d for d, t in before if not brute.contamination(t, items)[-1]}
            assert not any(brute.contamination(r.text, items)[-1] for r in out.collect())
        elif name == "mixture":
            assert out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("k")).where("n <> k").count() == 0
        docs = out
