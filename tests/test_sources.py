import json
import random

import pytest
from pyspark.sql import functions as F

from kohorta.operators import coding
from kohorta.sources import catalog as cat
from kohorta.sources import records as rec
from kohorta.sources import relational

PEOPLE = {"0": [["1111"], [], ["9093", "401", ""]], "1": [["9040", "402"]]}
LONG = [("0", 0, 0, "1111"), ("0", 2, 0, "9093"), ("0", 2, 1, "401"), ("1", 0, 0, "9040"), ("1", 0, 1, "402")]


def test_both_record_layouts(spark, tmp_path, rows):
    (tmp_path / "object.json").write_text(json.dumps(PEOPLE))
    nested = rec.read_records_object(spark, str(tmp_path / "object.json"))
    assert rows(rec.flatten_visits(nested)) == LONG
    rec.write_records(nested, str(tmp_path / "lines"))
    assert rows(rec.flatten_visits(rec.read_records(spark, str(tmp_path / "lines")))) == LONG


def test_cohort_folders(spark, tmp_path, rows):
    (tmp_path / "object.json").write_text(json.dumps(PEOPLE))
    nested = rec.read_records_object(spark, str(tmp_path / "object.json"))
    classified = nested.select("p_id", F.when(F.col("p_id") == "0", "complete").otherwise("only_past").alias("cohort"))
    rec.write_cohorts(nested, classified, str(tmp_path / "cohorts"))
    past = rec.read_family(spark, str(tmp_path / "cohorts"), ["complete", "only_past"])
    assert rows(past, "p_id") == [("0",), ("1",)]
    only = rec.read_family(spark, str(tmp_path / "cohorts"), ["only_past"])
    assert rows(only, "p_id", "visits") == [("1", [["9040", "402"]])]


def test_tables_round_trip(spark, tmp_path, table, rows):
    wide = table([("p", 10, 1, None), ("p", 2, None, 1)], "p_id STRING, visit_idx INT, a INT, b INT").toDF(
        "p_id", "visit_idx", "K76.0", "E10-E14"
    )
    stored = rec.rendered_wide(wide)
    assert stored.columns == ["p_id", "v_o_id", "K76.0", "E10-E14"]
    for fmt in ("csv", "parquet"):
        rec.write_table(stored, str(tmp_path / fmt), fmt)
        back = rec.read_table(spark, str(tmp_path / fmt), "p_id STRING, v_o_id STRING, `K76.0` INT, `E10-E14` INT", fmt)
        assert [tuple(r) for r in back.orderBy("v_o_id").collect()] == [("p", "p_10", 1, None), ("p", "p_2", None, 1)]


def test_ragged_catalog(spark, tmp_path, rows):
    text = "CODE_BPS,PATOLOGIA_BPS,BPS_PATHOLOGY,CIE-10,TARGET\n401,Diabetes,Diabetes,E10-E14\n703,Retina,Retinopathy,H35,T\n"
    (tmp_path / "catalog.csv").write_text(text)
    frame = cat.read_catalog(spark, str(tmp_path / "catalog.csv"))
    assert rows(frame, "code_bps", "cie10", "target") == [(401, "E10-E14", None), (703, "H35", "T")]
    assert rows(cat.target_groups(frame)) == [("H35",)]


def test_builtin_catalog_expands(spark, rows):
    catalog = cat.builtin_catalog(spark)
    assert catalog.count() == 83
    assert rows(cat.target_groups(catalog)) == [("H35",), ("I20-I25",), ("N18",), ("Z89",)]
    pairs = coding.expand_code_ranges(catalog)
    assert pairs.count() == 177 and pairs.select("cie").distinct().count() == 176
    groups = {}
    for r in pairs.collect():
        groups.setdefault(r["cie_group"], []).append(r["cie"])
    assert sorted(groups["C18-C20"]) == ["C18", "C19", "C20"]
    assert sorted(groups["F01-F03"]) == ["F01", "F02", "F03"]
    assert groups["K76.0"] == ["K760"]


def test_prefixes(spark, table, rows):
    pairs = coding.expand_code_ranges(cat.builtin_catalog(spark))
    keys = table([("H353X",), ("H35",), ("Z999",), ("I691",), ("E119",), ("E1",)], "k STRING")
    got = coding.classify_by_prefix(keys, "k", pairs)
    assert rows(got, "k", "cie", "cie_group") == [
        ("E119", "E11", "E10-E14"),
        ("H35", "H35", "H35"),
        ("H353X", "H353", "H35.3"),
        ("I691", "I69", "I67-I69"),
        ("I691", "I69", "I69"),
    ]
    counts = dict(rows(coding.prefix_counts(keys, "k", pairs)))
    assert counts["E11"] == 1 and counts["C20"] == 0 and len(counts) == 176


def test_relational_records(spark, table, rows):
    catalog = cat.builtin_catalog(spark)
    diagnoses = table(
        [
            ("a", "E119", "2020-03-01 10:00"),
            ("a", "E112", "2020-03-02 10:00"),
            ("a", "H353", "2021-03-01 10:00"),
            ("b", "I10", "2020-01-01 09:00"),
            ("c", "E100", "2020-01-01 09:00"),
        ],
        relational.DIAGNOSES_SCHEMA,
    )
    patients = table([("a", "x"), ("b", "x"), ("d", "x")], relational.PATIENTS_SCHEMA)
    people = table([("a", "1990-02-28", "M"), ("b", "1980-01-01", "F")], relational.DEMOGRAPHICS_SCHEMA)
    nested = relational.relational_to_records(diagnoses, patients, people, catalog)
    assert rows(nested) == [("a", [["1111"], ["401", "9030"], ["701", "9031"]])]
    counts = relational.relational_counts(diagnoses, patients, people, catalog)
    assert tuple(counts.first()) == (3, 2, 1)


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", ["64", "997", "128m"])
def test_one_large_object_is_read_in_ranges(spark, tmp_path, indent, size):
    """Ranges that begin inside strings, names and nested lists; records longer than a range."""
    pick = random.Random(7)
    odd = ["a]b", '"quo"ted', "back\\slash", "{", "}", ",", "[", "é\n", ""]
    people = {
        f"p{i}{pick.choice(odd)}": [[pick.choice([*odd, "401", "9045"]) for _ in range(pick.randrange(4))] for _ in range(pick.choice([0, 1, 3, 40]))]
        for i in range(60)
    }
    (tmp_path / "a.json").write_text(json.dumps(people, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"other": [["1"]]}, indent=indent))
    (tmp_path / "c.json").write_text("{}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "8")
    try:
        got = {r.p_id: r.visits for r in rec.read_records_object(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {**people, "other": [["1"]]}
