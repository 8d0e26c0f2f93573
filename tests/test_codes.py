import pytest
from pyspark.sql import functions as F

from kohorta.functions import codes as C
from kohorta.functions import scalars as S


def one(table, value, kind, expr):
    return table([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "code, age", [("9045", 45), ("9100", 100), ("9999", None), ("901", None), ("914", None), ("1999", None)]
)
def test_extract_age(table, code, age):
    assert one(table, code, "STRING", C.extract_age) == age


@pytest.mark.parametrize(
    "code, kind",
    [("1111", "sex"), ("3333", "sex"), ("9045", "age"), ("9999", "age_unknown"), ("401", "dx"), ("901", "dx")],
)
def test_code_kind(table, code, kind):
    assert one(table, code, "STRING", C.code_kind) == kind


@pytest.mark.parametrize(
    "age, band", [(17, "0-18"), (18, "18-44"), (44, "18-44"), (45, "45-64"), (64, "45-64"), (65, "60>"), (None, None)]
)
def test_age_band(table, age, band):
    frame = table([(age,), (1,)], "v INT")
    bands = {r["v"]: r["b"] for r in frame.select("v", S.age_band(F.col("v")).alias("b")).collect()}
    assert bands[age] == band


@pytest.mark.parametrize(
    "birth, day, age", [("1990-02-28", "2020-03-01 09:30:00", 30), ("2020-01-02", "2020-01-01 00:00:00", -1)]
)
def test_age_from_dates(table, birth, day, age):
    frame = table([(birth, day)], "b STRING, d STRING")
    got = frame.select(S.age_between(S.date_part(F.col("b")), S.date_part(F.col("d"))).alias("a")).first()["a"]
    assert got == age


def test_bad_date_raises(table):
    with pytest.raises(Exception, match="(?i)parse|invalid"):
        table([("yesterday",)], "d STRING").select(S.date_part(F.col("d"))).collect()


def test_strict_code_raises(table):
    from kohorta.operators.coding import strict_code

    with pytest.raises(Exception, match="(?i)cast"):
        table([("4x1",)], "code STRING").select(strict_code("code")).collect()


def test_visit_label_round_trip(table):
    frame = table([("p_1", 12)], "p STRING, v INT")
    label = C.visit_label(F.col("p"), F.col("v"))
    row = frame.select(label.alias("l"), C.visit_position(label).alias("n")).first()
    assert (row["l"], row["n"]) == ("p_1_12", 12)


def test_sex_encodings(table):
    frame = table([("M",), ("F",), ("U",)], "s STRING")
    got = frame.select(
        C.sex_to_code(F.col("s")).alias("c"),
        C.sex_to_number(F.col("s")).alias("n"),
        C.number_to_sex_label(C.sex_to_number(F.col("s"))).alias("l"),
    ).collect()
    assert [tuple(r) for r in got] == [("1111", 1, "Male"), ("2222", 2, "Female"), ("U", 3, "Unknow")]


def test_moment_orders_by_age_then_position(table):
    visits = [(-1, 5), (0, 0), (0, 9), (41, 10), (41, 9), (40, 1 << 40)]
    frame = table(visits, "age INT, visit BIGINT").withColumn("m", C.moment(F.col("age"), F.col("visit")))
    got = [(r["age"], r["visit"]) for r in frame.orderBy("m").collect()]
    assert got == sorted(visits)
    with pytest.raises(Exception, match="out of range"):
        table([(1, -1)], "age INT, visit BIGINT").select(C.moment(F.col("age"), F.col("visit"))).collect()


def test_hash_bucket_is_stable(spark):
    keys = spark.range(5000)
    first = {r["id"]: r["b"] for r in keys.select("id", S.hash_bucket(F.col("id")).alias("b")).collect()}
    second = {r["id"]: r["b"] for r in keys.repartition(7).select("id", S.hash_bucket(F.col("id")).alias("b")).collect()}
    assert first == second and set(first.values()) == set(range(100))


def test_display_texts(table):
    frame = table([(2, 12.345, 66.666)], "n INT, m DOUBLE, p DOUBLE")
    row = frame.select(
        S.mean_std_text(F.col("m"), F.col("p")).alias("a"),
        S.mean_std_text(F.col("m"), F.lit(None).cast("double")).alias("b"),
        S.count_percent_text(F.col("n"), F.col("p")).alias("c"),
    ).first()
    assert tuple(row) == ("12.34 (66.67)", "12.34 (nan)", "2 (66.67%)")
