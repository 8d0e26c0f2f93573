"""Odd tables: nulls in any column, empty and long texts, ties, repeated rows, no rows, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kohorta.llm import queries as Q
from kohorta.llm.decontamination import contamination, decontaminate
from kohorta.llm.fingerprints import fingerprint_edits
from kohorta.llm.licenses import license_report
from kohorta.llm.line_dedup import dedup_lines, drop_repeated_lines
from kohorta.llm.mixing import mix_sources
from kohorta.llm.ngram_join import ngram_components, one_per_component
from kohorta.llm.quality import keep_good, score_quality
from kohorta.llm.repeats import remove_repeats, repeat_groups
from kohorta.llm.token_counts import byte_pair_counter, count_changes, inserts, revisions, without_echoes, word_counter
from kohorta.llm.toxicity import score_toxicity
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["row", "id", "_id", "own", "mark", "places", "cut", "judged", "block", "flush", "key", "digest", "h", "n", "g", "z",
           "part", "label", "score", "copies", "copy", "rate", "n_lines", "held_out", "_label", "_spaced", "first", "head"]


def _words(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(pick.randrange(40)) for _ in range(n))


LONG = "\n".join(_words(i, 40) for i in range(600))
SHARED = _words(991, 60)
ROWS = [
    (None, None, None, None, None),
    (None, "lonely text with a null id", "en", None, 26),
    (1, "", "en", "a", 0),
    (2, "   \n\t\n ", None, "a", 7),
    (3, LONG, "en", "b", len(LONG)),
    (4, "same words here in five\nand a second line", "en", "a", 41),
    (4, "same words here in five\nand a second line", "en", "a", 41),
    (5, "same words here in five\nand a second line", "en", "b", 41),
    (6, "SAME words\there in FIVE and a second line", "en", "b", 41),
    (7, f"before it {SHARED} after it", "fr", "b", None),
    (8, f"others {SHARED}\nunder the MIT License, idiot éK", "fr", "a", None),
    (9, "ab " * 300, "de", "a", 900),
    (10, "ü\U0001f600", "de", "a", 2),
    (11, LONG[: len(LONG) // 2] + _words(5, 30), "en", "b", None),
]
ITEMS = [(1, SHARED), (2, None), (None, "nobody"), (3, "second line"), (3, "second line"), (4, "")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(3, 1, 0), (7, 1, 0), (8, 0, 1), (9, 0, None), (None, 1, 1), (8, 1, 1), (99, 0, 0)], "doc_id bigint, quality int, toxic int"
    )


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def _rows(df, *columns):
    return _sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_repeats(docs, empty):
    want = [(r[0], *w) for r, w in zip(ROWS, brute.removed_repeats([r[1] for r in ROWS]))]
    assert _rows(remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _sorted(want)
    assert remove_repeats(empty).count() == 0
    assert repeat_groups(empty).count() == 0


def test_ngram_components(docs, empty):
    want = [(r[0], *c) for r, c in zip(ROWS, brute.components([(r[0], r[1]) for r in ROWS]))]
    assert _rows(ngram_components(docs), "doc_id", "n_shingles", "component_id") == _sorted(want)
    assert ngram_components(empty).count() == 0


def test_one_per_component(docs, empty):
    kept = one_per_component(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    found = brute.components([(r[0], r[1]) for r in ROWS])
    assert ids == sorted({r[0] for r, (_, head) in zip(ROWS, found) if r[0] is not None and r[0] == head})
    assert 4 in ids and 5 not in ids and 6 not in ids
    assert kept.where("doc_id is null").count() == 2
    assert one_per_component(empty).count() == 0


def test_contamination(docs, empty, items):
    named = [(k, t) for k, t in ITEMS if k is not None]
    want = [(r[0], *brute.contamination(r[1], named)) for r in ROWS]
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert _rows(contamination(docs, items), *columns) == _sorted(want)
    assert contamination(empty, items).count() == 0
    assert contamination(docs, items.where("false")).where("contaminated or n_hit > 0").count() == 0


def test_decontaminate(docs, empty, items):
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 9, 10, 11}
    assert kept.where("doc_id is null and text is null").count() == 1
    assert decontaminate(empty, items).count() == 0


def test_decontaminate_cuts_small_hits(spark, items):
    text = f"{_words(1, 300)} the second line. {_words(2, 300)}"
    kept = decontaminate(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), items).first()
    assert kept.text == text.replace("second line", "")


def test_licenses(docs, empty):
    want = [(r[0], *brute.base_licenses(r[1])) for r in ROWS]
    got = license_report(docs)
    assert _rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == _sorted(want)
    assert got.where("doc_id = 8").first().labels == "mit"
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert license_report(empty).count() == 0


def test_line_dedup(spark, docs, empty):
    got = dedup_lines(docs)
    assert [c for c in got.columns if c not in ("n_lines", "n_removed", "n_runs")] == [c for c in docs.columns if c != "n_lines"]
    assert got.count() == len(ROWS)
    removed = {(r.doc_id, r.n_removed) for r in got.where("doc_id is not null").collect()}
    # Rows 4 and 4 are one document, so 5 is the first later one; 11 begins as 3 does.
    assert {(4, 0), (5, 2), (3, 0)} <= removed and dict(removed)[11] > 100
    kept = drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert 5 not in {r.doc_id for r in kept.collect()} and kept.count() == len(ROWS) - 1
    assert kept.where("n_lines <> 'n_lines'").count() == 0
    assert dedup_lines(empty).count() == 0


def test_fingerprints(docs, empty):
    got = fingerprint_edits(docs)
    assert got.count() == len(ROWS)
    assert fingerprint_edits(empty).count() == 0
    assert fingerprint_edits(docs.where("doc_id = 3")).count() == 1
    assert got.where("near_edited < 0 or near_edited > 1 or near_next < 0 or near_next > 1").count() == 0
    same = got.where("doc_id in (4, 5)").select("fingerprint").distinct().count()
    assert same == 1


def test_classifiers(docs, empty, labels):
    for score in (score_quality, score_toxicity):
        for marks in (labels, labels.where("false"), labels.where("doc_id = 3")):
            got = score(docs, marks)
            assert got.count() == len(ROWS)
            assert got.where("score is null or score < 0 or score > 1 or isnan(score) or predicted not in (0, 1)").count() == 0
        assert score(empty, labels).count() == 0
    assert keep_good(docs, labels).columns == docs.columns
    assert keep_good(empty, labels).count() == 0


def test_mixing(docs, empty):
    got = mix_sources(docs, weights={"a": 1.0, None: 1.0}, repetition=3.0)
    assert {r.source for r in got.collect()} <= {"a", None}
    assert set(docs.columns) | {"copy", "copies", "rate", "shuffle_key"} == set(got.columns)
    twins = got.where("doc_id = 4").groupBy("copy").count().collect()
    assert all(r["count"] == 2 for r in twins)
    assert mix_sources(empty).count() == 0
    assert mix_sources(docs, weights={}).count() == 0
    large = mix_sources(docs.where("doc_id in (7, 8)"), {"a": 0.5, "b": 0.5}, repetition=700.0).groupBy("doc_id")
    for r in large.agg(F.count("*").alias("n"), F.max("copies").alias("k"), F.max("rate").alias("rate")).collect():
        assert r.n == r.k and r.rate == 700 and abs(r.n - r.rate) < 6 * r.rate**0.5


def test_token_counts(docs, empty):
    tokenizers = {"bpe": byte_pair_counter("byte_bpe_50k"), "words": word_counter}
    sums = count_changes(inserts(docs), tokenizers)
    assert sums.where("tokenizer = 'words'").agg(F.sum("n_docs")).first()[0] == len(ROWS)
    want = sum(len(brute.BLANKS.findall(r[1] or "")) for r in ROWS)
    assert sums.where("tokenizer = 'words'").agg(F.sum("n_tokens")).first()[0] == want
    assert count_changes(inserts(empty), tokenizers).count() == 0
    assert count_changes(revisions(docs, without_echoes(F.col("text"))), tokenizers).count() == 0


def test_pipeline_stages(spark, docs, empty, labels, items, tmp_path, monkeypatch):
    tables = {"labels": labels, "benchmark": items}
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: tables[name])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name))
        if name != "mixture":
            assert out.columns == docs.columns, name
        assert stage(spark, empty, "").count() == 0, name


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in Q.LLM_QUERIES) == list(range(1, 14))
