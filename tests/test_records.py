"""Cleaning, cohort rules and history on literal records."""

import random

import pytest
from pyspark.sql import functions as F

from kohorta.operators import clean, cohort, longitudinal
from kohorta.plans import pipelines
from kohorta.sources import catalog as cat
from tests.conftest import records

SEX_CASES = {
    "0": [["1111", "2222"], ["9093", "401"], ["9093", "403"]],
    "1": [["1111"], ["2222"], ["9093", "401"], ["9093", "403"]],
    "2": [["1111"], ["9093", "401"], ["9093", "403"]],
}
HISTORY = {
    "h": [
        ["9050", "402"],
        ["9052", "703"],
        ["9051", "401"],
        ["9052", "914"],
        ["9060", "404"],
    ]
}


def test_sex_cases(table, rows):
    recs = records(table, SEX_CASES)
    assert rows(clean.resolve_sex(recs)) == [("0", "U"), ("1", "U"), ("2", "M")]
    assert rows(clean.sex_conflicts(recs)) == [("0",), ("1",)]
    assert rows(cohort.classify_cohort(recs), "p_id", "cohort") == [("0", "one_year"), ("1", "one_year"), ("2", "one_year")]


def test_strict_sex_visit_drops_unknown_sex(table, rows):
    recs = records(table, SEX_CASES)
    validated = cohort.validate_visits(cohort.visit_flags(recs))
    kept = cohort.require_min_visits(validated, sex=clean.resolve_sex(recs), strict_sex_visit=True)
    assert rows(kept, "p_id") == [("2",)]


@pytest.mark.parametrize(
    "visit, status",
    [
        (["401", "901"], "drop_no_age"),
        (["9045", "9023"], "drop_only_age"),
        (["9075"], "drop_single"),
        (["401"], "drop_single"),
        (["401", "9045"], "keep"),
        (["401", "9045", "9034"], "keep"),
        (["703"], "keep_age_unknown"),
        (["1401", "9050"], "keep_target"),
        (["1111"], "sex_only"),
        (["3333"], "drop_single"),
    ],
)
def test_visit_rules(table, visit, status):
    flags = cohort.visit_flags(records(table, {"p": [visit]}))
    row = cohort.validate_visits(flags).first()
    assert row["status"] == status
    assert row["age_unknown"] == (status == "keep_age_unknown")


def test_cohort_cases(table, rows):
    people = {
        "a": [["9040", "913"], ["9045", "401"], ["9050", "402"]],
        "b": [["9045", "401"], ["9050", "402"]],
        "c": [["9040", "913"], ["9045", "401"]],
        "d": [["9045", "401"], ["9045", "402"]],
        "f": [["9045", "401"], ["9043", "401"], ["9050", "402"]],
        "none": [["9040", "913"], ["9041", "913"]],
        "few": [["9040", "401"]],
    }
    classified = cohort.classify_cohort(records(table, people))
    assert rows(classified, "p_id", "first_index_age", "cohort") == [
        ("a", 45, "complete"),
        ("b", 45, "only_future"),
        ("c", 45, "only_past"),
        ("d", 45, "one_year"),
        ("f", 43, "only_future"),
    ]
    members = rows(cohort.cohort_families(classified), "family", "p_id")
    assert [m for m in members if m[0] in ("future", "past", "complete")] == [
        ("complete", "a"),
        ("future", "a"),
        ("future", "b"),
        ("future", "f"),
        ("past", "a"),
        ("past", "c"),
    ]
    steps = rows(cohort.cohort_attrition(records(table, people)))
    assert steps == [
        ("0_initial", 7, 0),
        ("1_has_index", 6, 1),
        ("2_has_index_with_age", 6, 0),
        ("3_min_visits", 5, 1),
    ]


def test_no_index_is_an_error(table, rows):
    dx = table([("e", 0, 40, "913"), ("b", 0, 45, "401"), ("b", 1, 50, "402")], "p_id STRING, visit_idx INT, age INT, code STRING")
    assert rows(cohort.classify_diagnoses(dx, "401"), "p_id", "cohort") == [("b", "only_future"), ("e", "errors")]


def test_legacy_index_age_zero_is_missing(table, rows):
    people = {"z": [["9000", "401"], ["9050", "402"]], "y": [["9045", "401"], ["9050", "402"]], "x": [["401"]]}
    recs = records(table, people)
    assert rows(cohort.classify_cohort_legacy(recs)) == [("x", "errors"), ("y", "only_future"), ("z", "errors")]
    assert rows(cohort.classify_cohort_legacy(recs, zero_is_missing=False))[2] == ("z", "only_future")


def test_single_age_attrition(table, rows):
    people = {
        "a": [["9040", "401"]],
        "b": [["9040", "9041", "401"]],
        "c": [["9040", "402"]],
        "d": [["9140", "401"]],
    }
    assert rows(cohort.single_age_attrition(records(table, people))) == [
        ("0_initial", 4, 0),
        ("1_one_age", 2, 2),
        ("2_has_index", 1, 1),
        ("3_any_age", 1, 0),
    ]


def test_first_age_in_list_order(table, rows):
    recs = records(table, {"p": [["401", "9051", "9050"], ["402"], ["1111"]]})
    ages = clean.visit_ages(recs)
    assert rows(ages, "visit_idx", "age", "min_age") == [(0, 51, 50), (1, None, None)]
    assert rows(clean.age_conflict_report(recs)) == [(1, 1)]


def wide_of(spark, table, people):
    rows = cat.catalog_rows()
    codes = sorted(r[1] for r in rows)
    targets = sorted(r[1] for r in rows if r[2])
    return pipelines.to_wide(records(table, people), cat.builtin_catalog(spark), codes, targets), codes


def test_history_cases(spark, table):
    wide, codes = wide_of(spark, table, HISTORY)
    got = {r["visit_idx"]: r for r in wide.collect()}
    expected = {
        0: (50, {"E78"}, None),
        1: (52, {"E78", "E10-E14", "H35"}, 1),
        2: (51, {"E78", "E10-E14"}, 1),
        3: (52, {"E78", "E10-E14", "H35", "I50"}, 1),
        4: (60, {"E78", "E10-E14", "H35", "I50", "E66"}, 1),
    }
    for visit, (age, carried, label) in expected.items():
        row = got[visit]
        assert row["age"] == age and row["sex"] == "U"
        assert {c for c in codes if row[c] is not None} == carried
        assert row["pred1y_H35"] == label
        assert row["pred1y_N18"] is None


def test_yearly_years(spark, table, rows):
    wide, _ = wide_of(spark, table, HISTORY)
    yearly = pipelines.to_yearly(wide)
    assert rows(yearly, "age", "years_with_diabetes", "visit_idx") == [(50, 0, 0), (51, 0, 2), (52, 1, 3), (60, 9, 4)]


def random_dx(seed, patients=12, visits=8):
    rng = random.Random(seed)
    out = []
    for p in range(patients):
        for v in range(rng.randint(1, visits)):
            age = rng.randint(40, 46)
            for code in rng.sample("ABCDE", rng.randint(1, 3)):
                out.append((f"p{p}", v, age, code))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closed_forms_equal_the_self_join(table, rows, seed):
    dx = table(random_dx(seed), "p_id STRING, visit_idx INT, age INT, code STRING")
    visits = dx.select("p_id", "visit_idx", "age").distinct()
    a, b = visits.alias("a"), visits.alias("b")
    earlier = (F.col("b.age") < F.col("a.age")) | (
        (F.col("b.age") == F.col("a.age")) & (F.col("b.visit_idx") <= F.col("a.visit_idx"))
    )
    seen = a.join(b, (F.col("a.p_id") == F.col("b.p_id")) & earlier).select(
        F.col("a.p_id").alias("p_id"), F.col("a.visit_idx").alias("visit_idx"), F.col("a.age").alias("age"),
        F.col("b.visit_idx").alias("past"),
    )
    codes = dx.select(F.col("p_id"), F.col("visit_idx").alias("past"), "code")
    literal = seen.join(codes, ["p_id", "past"]).select("p_id", "visit_idx", "age", "code").distinct()
    assert rows(longitudinal.carry_history(visits, dx)) == rows(literal)

    hits = literal.where(F.col("code").isin("A", "B")).select("p_id", "age", "code")
    shifted = hits.union(hits.withColumn("age", F.col("age") - 1)).distinct()
    labels = visits.join(shifted, ["p_id", "age"]).select(
        "p_id", "visit_idx", "age", F.concat(F.lit("pred1y_"), "code").alias("label")
    )
    assert rows(longitudinal.lookahead_labels(visits, dx, ["A", "B"])) == rows(labels.distinct())

    wide = longitudinal.wide_table(visits, dx, list("ABCDE"), ["A", "B"])
    assert wide.count() == visits.count()
    long = wide.unpivot(["p_id", "visit_idx", "age"], list("ABCDE"), "code", "v").where("v = 1").drop("v")
    assert rows(long) == rows(literal)
    flagged = wide.unpivot(["p_id", "visit_idx", "age"], ["pred1y_A", "pred1y_B"], "label", "v").where("v = 1").drop("v")
    assert rows(flagged) == rows(labels.distinct())


def test_wide_keeps_visits_without_listed_codes(table, rows):
    dx = table([("p", 0, 40, "Z"), ("q", 0, 40, "A")], "p_id STRING, visit_idx INT, age INT, code STRING")
    visits = dx.select("p_id", "visit_idx", "age").distinct()
    assert rows(longitudinal.wide_table(visits, dx, ["A"], []), "p_id", "A") == [("p", None), ("q", 1)]


def test_onset_only_stops_at_the_onset(table, rows):
    dx = table([("p", v, 40 + v, "A" if v == 2 else "B") for v in range(5)], "p_id STRING, visit_idx INT, age INT, code STRING")
    visits = dx.select("p_id", "visit_idx", "age")
    ages = longitudinal.lookahead_labels(visits, dx, ["A"], onset_only=True)
    assert rows(ages, "age") == [(41,), (42,)]
    assert rows(longitudinal.lookahead_labels(visits, dx, ["A"], horizon=2), "age") == [(40,), (41,), (42,), (43,), (44,)]


def test_timeline(table, rows):
    onsets = table([("p", 50, 0, 45), ("q", 0, 0, 0)], "p_id STRING, a INT, b INT, c INT")
    names = table([("H35", "Retinopathy")], "cie10 STRING, name STRING")
    got = longitudinal.timeline(onsets.toDF("p_id", "H35", "K76.0", "E10-E14"), ["H35", "K76.0", "E10-E14"], names)
    assert rows(got, "p_id", "seq", "code", "age", "name", "is_highlight") == [
        ("p", 1, "E10-E14", 45, None, True),
        ("p", 2, "H35", 50, "H35 - Retinopathy", True),
    ]


def test_visit_marked_unknown_never_counts(table):
    from kohorta.operators.cohort import classify_cohort, validate_visits, visit_flags

    patients = {"a": [["1111"], ["401", "9050"], ["402", "9999", "9045"]], "b": [["401", "9050"], ["402", "9045"]]}
    long = records(table, patients)
    assert [r.p_id for r in classify_cohort(long).collect()] == ["b"]
    status = {r.visit_idx: r.status for r in validate_visits(visit_flags(long)).where("p_id = 'a'").collect()}
    assert status == {0: "sex_only", 1: "keep", 2: "keep_age_unknown"}


def test_cleaned_records_feed_the_wide_table(table):
    from kohorta.sources.records import flatten_visits

    patients = {
        "a": [["401", "9050"], ["1111", "402"], ["703"], ["9060"], ["402", "9999", "9045"], ["404", "9052"]],
        "b": [["1111", "2222"], ["402"]],
    }
    cleaned = cohort.clean_records(records(table, patients))
    got = {r.p_id: r.visits for r in cleaned.collect()}
    assert got["a"] == [["1111"], ["401", "9050"], ["703", "9999"], ["402", "9999", "9045"], ["404", "9052"]]
    assert got["b"] == [["3333"]]
    catalog = cat.builtin_catalog(cleaned.sparkSession)
    wide = pipelines.to_wide(flatten_visits(cleaned), catalog, cat.column_codes(catalog), ["H35"])
    assert sorted((r.p_id, r.sex, r.age) for r in wide.collect()) == [("a", "M", 45), ("a", "M", 50), ("a", "M", 52)]
