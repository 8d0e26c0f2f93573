"""Hard negatives, periodic runs and language against plain versions, and on odd tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohorta.llm import hard_negatives as H
from kohorta.llm import language as L
from kohorta.llm import periodic_runs as P

# ---- hard negatives


def brute_negatives(rows, positives=5, negatives=10):
    """Rows are (id, label, vector of whole numbers)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, la, va in rows:
        if a is None or a % 100:
            continue
        scored = sorted(((-dot(va, v), i is None, i, lab) for i, lab, v in rows if i != a or i is None), key=lambda r: (r[0], r[1], r[2] or 0))
        for ps, _, p, _ in [r for r in scored if r[3] == la][:positives]:
            near = [r for r in scored if r[3] != la and 30 * -ps <= 100 * -r[0] <= 90 * -ps][:negatives]
            out += [(a, p, k, n, -ps, -ns) for k, (ns, _, n, _) in enumerate(near, 1)]
    return sorted(out, key=str)


def _mined(spark, rows, **options):
    df = spark.createDataFrame([(i, lab, [float(x) for x in v]) for i, lab, v in rows], "vec_id bigint, label int, vec array<double>")
    usable = H.usable_rows(df, "vec_id", "vec", "label")
    got = H.mine_hard_negatives(usable, F.col("vec_id") % 100 == 0, **options)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_match_brute_force(spark, seed):
    pick = random.Random(seed)
    centers = [[pick.randint(-9, 9) for _ in range(6)] for _ in range(4)]
    # Hot cell: a third of all rows are equal, so scores tie and ids decide.
    rows = [(i, pick.randrange(3), [c + pick.randint(-3, 3) for c in pick.choice(centers)]) for i in range(400)]
    rows += [(i, i % 3, centers[0]) for i in range(400, 620)]
    assert _mined(spark, rows, first=40, block_rows=64) == brute_negatives(rows)


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, 1, [5, 1, 2]), (1, 1, [4, 4]), (2, 2, [3]), (None, 2, [2, 1, 0]), (3, 2, []), (100, 2, [-4, -1, 3]), (101, 2, [1, 1, 1]), (5, 1, [0, 0, 0])]
    assert _mined(spark, rows) == brute_negatives(rows)
    bad = spark.createDataFrame(
        [(0, None, [1.0]), (0, 1, None), (0, 1, [None]), (0, 1, [float("nan")]), (0, 1, [float("-inf")])],
        "vec_id bigint, label int, vec array<double>",
    )
    usable = H.usable_rows(bad, "vec_id", "vec", "label")
    assert usable.count() == 0
    assert H.mine_hard_negatives(usable, F.col("vec_id") % 100 == 0).count() == 0


def test_equal_anchor_rows_are_one_anchor(spark):
    rows = [(0, 1, [5, 1]), (0, 1, [5, 1]), (1, 1, [4, 4]), (2, 2, [3, 1]), (2, 2, [3, 1])]
    got = _mined(spark, rows)
    assert [r[:4] for r in got] == [(0, 1, 1, 2), (0, 1, 2, 2)]


def test_cells_come_in_order_and_stop_when_certified():
    pick = np.random.default_rng(4)
    x = pick.integers(-50, 50, (500, 8)).astype(float)
    index = H.MultiIndex(8, (H._codebook(x[:, :4], 5, 1), H._codebook(x[:, 4:], 5, 2)))
    cells, far = index.assign(x)
    known = np.unique(cells)
    radii = np.array([[far[z][cells == c].max() for z in (0, 1)] for c in known])
    index.fill(known, np.array([(cells == c).sum() for c in known]), radii, 64)
    for anchor in x[:20]:
        scores = x @ anchor
        beat = int(np.sort(scores)[-5])
        asked, _, done = H.next_cells(index, anchor, 0, 10**6, [(H.LEAST, H.MOST, beat)])
        assert done and set(cells[scores >= beat]) <= {int(index.cells[k]) for k in asked}
        some, passed, done = H.next_cells(index, anchor, 0, 100, [(H.LEAST, H.MOST, H.LEAST)])
        rest, _, last = H.next_cells(index, anchor, passed, 10**6, [(H.LEAST, H.MOST, H.LEAST)])
        assert not done and last and sorted(some + rest) == list(range(len(known)))
        assert H.next_cells(index, anchor, 0, 10**6, []) == ([], 0, True)


# ---- periodic runs


def brute_runs(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                best[i, j - i + q] = min(q, best.get((i, j - i + q), q))
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    pick = random.Random(7)
    for _ in range(1500):
        w, n = [], pick.randrange(200)
        while len(w) < n:
            w += [pick.randrange(pick.choice([1, 2, 4])) for _ in range(pick.randrange(1, 9))] * pick.choice([1, 1, 2, 4, 6])
        assert P.periodic_runs(np.array(w, np.int64)) == brute_runs(w), w


def test_long_stretches_stay_fast():
    """One word, one long unit, two words in any order: no quadratic list of pairs."""
    n = 60_000
    assert P.periodic_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    unit = np.random.default_rng(1).integers(0, 500, n // 6)
    assert P.periodic_runs(np.tile(unit, 6)) == [(0, n // 6 * 6, n // 6)]
    coins = np.random.default_rng(2).integers(0, 2, 3_000)
    assert P.periodic_runs(coins) == brute_runs(coins.tolist())


def _plain_report(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return (
        doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_run_report_of_odd_texts(spark):
    pick = random.Random(3)
    words = lambda n: " ".join(pick.choice("abc") for _ in range(n))
    rows = [(i, words(pick.randrange(120))) for i in range(80)]
    rows += [(None, None), (None, "a a a a a a a"), (200, ""), (201, None), (202, " \t\n"), (203, "x y \x1cz " * 9), (203, "x y \x1cz " * 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit("z").alias(c) for c in ("key", "n_runs", "start", "row")])
    got = P.detect_runs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((_plain_report(*r) for r in rows), key=str)
    assert P.detect_runs(docs.where("false")).count() == 0


def test_collapse_keeps_one_period(spark):
    rows = [(1, "so it is it is it is it is it is  now"), (2, "nothing  twice"), (3, None), (4, "ha " * 50)]
    got = {r.doc_id: r.text for r in P.collapse_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "so it is now", 2: "nothing  twice", 3: None, 4: "ha"}


# ---- language


def brute_bits(sample, language, text):
    """Code length by walking the language's own contexts, byte by byte."""
    counts = {}
    for name, raw in sample:
        raw = L.folded(raw)
        if name == language:
            for n in range(L.ORDER + 1):
                for i in range(n, len(raw)):
                    own = counts.setdefault(raw[i - n : i], {})
                    own[raw[i]] = own.get(raw[i], 0) + 1
    def chances(context):
        """Chance of every byte after the context, as far as the language knows it."""
        below = chances(context[1:]) if context else [1 / 256] * 256
        seen = counts.get(context, {})
        if context and sum(seen.values()) < L.LEAST_COUNT or not seen:
            return below
        left = [0 if b in seen else p for b, p in enumerate(below)]
        rest, n, u = sum(left), sum(seen.values()), len(seen)
        u = u if rest else 0
        return [seen[b] / (n + u) if b in seen else u / (n + u) * left[b] / rest for b in range(256)]

    raw = L.folded(text)
    return sum(-math.log2(chances(raw[max(0, i - L.ORDER) : i])[raw[i]]) for i in range(len(raw)))


SAMPLE = [
    ("en", b"the other thing is that they think there is nothing in the other thing 12 times " * 3),
    ("de", "der andere ding ist dass sie denken es gäbe nichts über den anderen dingen " .encode() * 3),
    ("xx", b"zq zq zqq"),
]


def test_code_lengths_match_the_definition():
    model = L.fit_contexts(SAMPLE)
    texts = ["the thing", "über THE 7 things there", "zq\x7f一 den", "", "there " * 60]
    got = model.code_lengths([t.encode() for t in texts])
    for row, text in zip(got, texts):
        for bits, name in zip(row, model.languages):
            assert bits == pytest.approx(brute_bits(SAMPLE, name, text.encode()), rel=1e-4, abs=1e-4)


def test_chances_sum_to_one():
    model = L.fit_contexts(SAMPLE)
    chance = np.exp2(-model.bits.reshape(*model.step.shape, -1).astype(float))
    rare = 256 - (model.step.shape[1] - 1)
    assert np.allclose(chance[:, :-1].sum(1) + rare * chance[:, -1], 1, atol=1e-4)


def test_automaton_keeps_the_longest_known_context():
    model = L.fit_contexts(SAMPLE)
    raw = L.folded(SAMPLE[0][1])[:200]
    contexts = {}
    for name, text in SAMPLE:
        for context, followed in L._tree_counts([L.folded(t) for n, t in SAMPLE if n == name]).items():
            if not context or sum(followed.values()) >= L.LEAST_COUNT:
                contexts[context] = True
    order = {c: i for i, c in enumerate(sorted(contexts, key=lambda c: (len(c), c)))}
    state = 0
    for i, b in enumerate(raw):
        state = model.step[state, model.classes[b]]
        longest = next(raw[i + 1 - n : i + 1] for n in range(min(L.ORDER, i + 1), -1, -1) if raw[i + 1 - n : i + 1] in contexts)
        assert state == order[longest]


def test_languages_of_odd_texts(spark):
    rows = [(i, ("the other thing is that " if i % 2 else "der andere ding ist dass ") * (1 + i % 7), "en" if i % 2 else "de", "s") for i in range(60)]
    rows += [(None, None, None, None), (70, "", "en", None), (71, "123 !?", "de", "s"), (72, "THE OTHER", None, None), (73, "der " * 9000, None, None)]
    rows += [(73, "der " * 9000, None, None), (None, "andere", "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").select("*", F.lit(1).alias("score"), F.lit(2).alias("held_out"), F.lit(3).alias("key"))
    got = L.identify_languages(docs, L.in_fold(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2)
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r.lang_pred for r in got if r.doc_id is not None}
    assert (by_id[70], by_id[71], by_id[72], by_id[73]) == ("und", "und", "en", "de")
    assert all(by_id[i] == ("en" if i % 2 else "de") for i in range(60))
    nothing = L.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert L.identify_languages(docs.where("false")).count() == 0
