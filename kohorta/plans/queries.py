"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kohorta.functions import codes as C
from kohorta.functions import scalars
from kohorta.operators import clean, cluster, coding, cohort, density, features, longitudinal, metric, tableone, validity
from kohorta.plans import pipelines, views
from kohorta.plans.skew import spread_join
from kohorta.session import literal_table, run_dir, written
from kohorta.sources import catalog as cat
from kohorta.sources import records as rec
from kohorta.sources import relational

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Small code lists used by several queries; the oracle SQL states the same values.
PART_CATALOG = [("ECONOMY", "T01"), ("LARGE", "T02"), ("MEDIUM", "T03"), ("PROMO", "T04-T05"), ("SMALL", "T06.1")]
BRAND_PREFIXES = [
    ("Brand#1", "low", 1),
    ("Brand#10", "ten", 2),
    ("Brand#2", "twenty", 3),
    ("Brand#2", "twenties", 4),
    ("Brand#25", "last", 5),
]
BRAND_GROUPS = [(11, "B01-B05"), (12, "B06-B12"), (13, "B10"), (14, "B13"), (15, "B20-B24")]
CODE_NAMES = [("ECONOMY", "Economy part"), ("LARGE", "Large part"), ("PROMO", "Promo part"), ("SMALL", "Small part")]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    doubles = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.round(longitudinal.quoted(n), digits) for n in doubles}) if doubles else df


# ---- records and scalar functions -------------------------------------------------------------


@query
def flatten_visits(spark, sf):
    return rec.flatten_visits(views.notes(spark, sf))


@query
def parse_visit_id(spark, sf):
    orders = views.table(spark, sf, "orders")
    label = C.visit_label(F.col("o_custkey"), F.col("o_orderkey"))
    return orders.select(label.alias("v_o_id")).withColumn("position", C.visit_position(F.col("v_o_id")))


@query
def extract_age(spark, sf):
    codes = views.activity(spark, sf)
    return codes.select("code_idx", C.extract_age(F.col("code")).alias("age"))


@query
def code_kinds(spark, sf):
    codes = views.activity(spark, sf).withColumn("kind", C.code_kind(F.col("code")))
    return codes.groupBy("kind").agg(F.count("*").alias("n"))


@query
def strict_code_cast(spark, sf):
    parts = views.table(spark, sf, "part").withColumn("digits", F.substring("p_brand", 7, 9))
    return parts.select("p_partkey", coding.strict_code("digits").alias("brand_no"))


@query
def age_from_dates(spark, sf):
    day = F.to_date("o_orderdate")
    return views.table(spark, sf, "orders").select(
        "o_orderkey",
        scalars.age_between(F.lit("1970-03-01").cast("date"), day).alias("age_a"),
        scalars.age_between(F.lit("1998-07-01").cast("date"), day).alias("age_b"),
    )


@query
def age_band(spark, sf):
    visits = views.visits_of(views.purchases(spark, sf))
    return visits.select("visit_idx", scalars.age_band((F.col("age") - 45) * 10 + 10).alias("band"))


# ---- sex and age ------------------------------------------------------------------------------


@query
def sex_evidence(spark, sf):
    return clean.spread_sex_evidence(views.line_flags(spark, sf))


@query
def sex_resolve(spark, sf):
    return clean.resolve_sex(views.line_flags(spark, sf))


@query
def drop_marker_rows(spark, sf):
    return clean.drop_markers(views.line_flags(spark, sf))


@query
def sex_report(spark, sf):
    return clean.sex_report(views.line_flags(spark, sf))


@query
def sex_conflicts(spark, sf):
    return clean.sex_conflicts(views.line_flags(spark, sf))


@query
def sex_encode_code(spark, sf):
    sexes = clean.resolve_sex(views.line_flags(spark, sf))
    return sexes.select("p_id", C.sex_to_code(F.col("sex")).alias("sex_code"))


@query
def sex_encode_num(spark, sf):
    sexes = clean.resolve_sex(views.line_flags(spark, sf))
    number = C.sex_to_number(F.col("sex"))
    return sexes.select("p_id", number.alias("sex_num"), C.number_to_sex_label(number).alias("sex_label"))


@query
def first_age_in_visit(spark, sf):
    ages = clean.visit_ages(views.activity(spark, sf))
    return ages.where("age IS NOT NULL").select("p_id", "visit_idx", "age")


@query
def age_conflict_report(spark, sf):
    return clean.age_conflict_report(views.activity(spark, sf))


@query
def clinical_visits(spark, sf):
    return clean.clinical_visits(clean.coded_visits(views.coded_activity(spark, sf)))


# ---- codes ------------------------------------------------------------------------------------


def _part_catalog(spark):
    return literal_table(spark, PART_CATALOG, "code_bps STRING, cie10 STRING")


@query
def map_codes(spark, sf):
    return coding.map_codes(views.purchases(spark, sf), _part_catalog(spark))


@query
def unmapped_codes(spark, sf):
    return coding.unmapped_codes(views.purchases(spark, sf), _part_catalog(spark))


def _brand_number():
    return F.substring("p_brand", 7, 9).cast("int")


@query
def code_range_expand(spark, sf):
    """The brand numbers of each part type and size, as catalog ranges."""
    low = F.concat(F.lit("B"), F.lpad(F.min(_brand_number()).cast("string"), 2, "0"))
    high = F.concat(F.lit("B"), F.lpad(F.max(_brand_number()).cast("string"), 2, "0"))
    group = F.when(low == high, low).otherwise(F.concat(low, F.lit("-"), high))
    parts = views.table(spark, sf, "part")
    ranges = parts.groupBy("p_type", "p_size").agg(group.alias("cie10"), F.max("p_size").alias("code_bps"))
    return coding.expand_code_ranges(ranges)


def _brand_prefixes(spark):
    return literal_table(spark, BRAND_PREFIXES, "cie STRING, cie_group STRING, code_bps LONG")


@query
def prefix_match(spark, sf):
    parts = views.table(spark, sf, "part").select("p_partkey", "p_brand")
    return coding.classify_by_prefix(parts, "p_brand", _brand_prefixes(spark), (7, 8)).drop("p_brand")


@query
def prefix_counts(spark, sf):
    parts = views.table(spark, sf, "part").select("p_partkey", "p_brand")
    return coding.prefix_counts(parts, "p_brand", _brand_prefixes(spark), (7, 8))


# ---- relational tables ------------------------------------------------------------------------


@query
def enrich_left(spark, sf):
    orders = views.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    solvent = views.table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    return orders.join(solvent, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query
def inner_enrich(spark, sf):
    orders = views.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    solvent = views.table(spark, sf, "customer").where("c_acctbal > 0")
    nation = views.table(spark, sf, "nation")
    known = solvent.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(known, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query
def semi_join_index(spark, sf):
    dx = written(views.purchases(spark, sf), "purchases")
    return spread_join(dx, cohort.index_patients(dx, views.PURCHASE_INDEX), ["p_id"], "left_semi")


@query
def target_filter(spark, sf):
    listed = literal_table(spark, [(c, c, "T") for c in views.PURCHASE_TARGETS], "code_bps STRING, cie10 STRING, target STRING")
    return views.purchases(spark, sf).join(cat.target_groups(listed), "code", "left_semi")


@query
def attrition_counts(spark, sf):
    patients = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("p_id"))
    return cohort.attrition_counts(views.purchases(spark, sf), patients, views.PURCHASE_INDEX)


@query
def distinct_rows(spark, sf):
    return views.purchases(spark, sf).select("p_id", "age", "code").distinct()


@query
def build_nested_records(spark, sf):
    return rec.records_json(rec.build_nested(views.purchases(spark, sf)))


def _relational(spark, sf):
    lines = views.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = views.table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit("B"), F.lpad(_brand_number().cast("string"), 2, "0"), F.col("p_type")).alias("catalog_key"),
    )
    orders = views.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    diagnoses = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").cast("string").alias("cx_curp"),
            "catalog_key",
            F.concat(F.to_date("o_orderdate").cast("string"), F.lit(" 10:00:00")).alias("df_consulta"),
        )
    )
    customers = views.table(spark, sf, "customer")
    key = F.col("c_custkey")
    patients = customers.select(key.cast("string").alias("cx_curp_original"))
    nation = F.col("c_nationkey") % 3
    demographics = customers.select(
        key.cast("string").alias("cx_curp"),
        F.date_add(F.lit("1950-01-01").cast("date"), (key % 9000).cast("int")).cast("string").alias("df_nacimiento"),
        F.when(nation == 0, "M").when(nation == 1, "F").otherwise("X").alias("cs_sexo"),
    )
    groups = literal_table(spark, BRAND_GROUPS, "code_bps LONG, cie10 STRING")
    return diagnoses, patients, demographics, groups


@query
def relational_to_records(spark, sf):
    nested = relational.relational_to_records(*_relational(spark, sf), index_group="B13")
    return rec.records_json(nested)


@query
def relational_counts(spark, sf):
    return relational.relational_counts(*_relational(spark, sf), index_group="B13")


# ---- history, labels, wide tables -------------------------------------------------------------


def _purchases(spark, sf):
    """dx rows, joined once, and their visits."""
    dx = written(views.purchases(spark, sf), "purchases")
    return dx, views.visits_of(dx)


@query
def history_carry(spark, sf):
    dx, visits = _purchases(spark, sf)
    return longitudinal.carry_history(visits, dx)


@query
def target_labels(spark, sf):
    dx, visits = _purchases(spark, sf)
    return longitudinal.lookahead_labels(visits, dx, views.PURCHASE_TARGETS)


@query
def target_labels_onset(spark, sf):
    dx, visits = _purchases(spark, sf)
    return longitudinal.lookahead_labels(visits, dx, views.PURCHASE_TARGETS, onset_only=True)


@query
def label_shift_union(spark, sf):
    return longitudinal.shifted_targets(views.purchases(spark, sf), views.PURCHASE_TARGETS)


@query
def label_union(spark, sf):
    dx, visits = _purchases(spark, sf)
    labels = longitudinal.lookahead_labels(visits, dx, views.PURCHASE_TARGETS)
    return longitudinal.label_union(longitudinal.carry_history(visits, dx), labels)


@query
def wide_pivot(spark, sf):
    dx, visits = _purchases(spark, sf)
    return longitudinal.wide_table(visits, dx, views.PURCHASE_CODES, views.PURCHASE_TARGETS)


def _catalog_columns():
    rows = cat.catalog_rows()
    return sorted(r[1] for r in rows), sorted(r[1] for r in rows if r[2])


def _to_wide(spark, sf):
    codes, targets = _catalog_columns()
    return pipelines.to_wide(views.coded_activity(spark, sf), cat.builtin_catalog(spark), codes, targets)


@query
def to_wide(spark, sf):
    return rec.rendered_wide(_to_wide(spark, sf))


@query
def to_yearly(spark, sf):
    return pipelines.to_yearly(_to_wide(spark, sf))


@query
def final_sort(spark, sf):
    return longitudinal.final_sort(views.visits_of(views.purchases(spark, sf)))


@query
def final_sort_file(spark, sf):
    """The sorted visits written in order and read back with their positions."""
    path = f"{run_dir(spark)}/sorted-{uuid.uuid4().hex}"
    rec.write_ordered(views.visits_of(views.purchases(spark, sf)), path, "p_id", "age", "visit_idx")
    return rec.read_ordered(spark, path)


@query
def strict_codes(spark, sf):
    """Codes as numbers, with the rows whose code is none; every seventh customer's code is a name."""
    key = F.col("c_custkey")
    raw = F.when(key % 7 == 0, F.col("c_mktsegment")).when(key % 11 != 0, key.cast("string"))
    frame = views.table(spark, sf, "customer").select(key, raw.alias("code"))
    good, rejects, counts = coding.cast_codes(frame, "code", f"{run_dir(spark)}/codes-{uuid.uuid4().hex}")
    rows = good.select("c_custkey", "code", F.lit(None).cast("string").alias("raw"), F.lit(counts["good"]).alias("n_kind"))
    return rows.unionByName(rejects.select("c_custkey", F.lit(None).cast("long").alias("code"), F.col("code").alias("raw"), F.lit(counts["rejected"]).alias("n_kind")))


@query
def yearly_max(spark, sf):
    dx, visits = _purchases(spark, sf)
    return longitudinal.yearly_max(
        longitudinal.wide_table(visits, dx, views.PURCHASE_CODES, views.PURCHASE_TARGETS)
    )


@query
def years_since_index(spark, sf):
    dx = views.purchases(spark, sf)
    yearly = dx.groupBy("p_id", "age").agg(F.bool_or(F.col("code") == views.PURCHASE_INDEX).alias("hit"))
    return longitudinal.years_since_index(yearly, F.col("hit"), "years").drop("hit")


def _onsets(spark, sf):
    return longitudinal.onset_ages(views.purchases(spark, sf), views.PURCHASE_CODES)


@query
def timeline(spark, sf):
    names = literal_table(spark, CODE_NAMES, "cie10 STRING, name STRING")
    return longitudinal.timeline(_onsets(spark, sf), views.PURCHASE_CODES, names, ("PROMO", "LARGE"))


@query
def positive_count(spark, sf):
    return longitudinal.positive_count(_onsets(spark, sf), ["p_id", *views.PURCHASE_CODES])


# ---- cohorts ----------------------------------------------------------------------------------


def _flags(spark, sf):
    return cohort.visit_flags(views.activity(spark, sf))


@query
def has_index_dx(spark, sf):
    return cohort.require_index(_flags(spark, sf)).select("p_id", "has_index")


@query
def has_index_dx_with_age(spark, sf):
    return cohort.require_index(_flags(spark, sf)).select("p_id", "has_index_with_age")


@query
def visit_validity(spark, sf):
    return cohort.validate_visits(_flags(spark, sf)).select("p_id", "visit_idx", "status", "age_unknown")


@query
def min_visits(spark, sf):
    return cohort.require_min_visits(cohort.validate_visits(_flags(spark, sf)))


@query
def min_visits_strict(spark, sf):
    records = views.activity(spark, sf)
    validated = cohort.validate_visits(cohort.visit_flags(records))
    return cohort.require_min_visits(validated, sex=clean.resolve_sex(records), strict_sex_visit=True)


@query
def cohort_classify(spark, sf):
    return cohort.classify_diagnoses(views.purchases(spark, sf), views.PURCHASE_INDEX)


@query
def cohort_select(spark, sf):
    return cohort.classify_cohort(views.activity(spark, sf))


@query
def cleaned_records(spark, sf):
    return rec.records_json(cohort.clean_records(views.activity(spark, sf)))


@query
def cohort_files(spark, sf):
    """Records of the chosen patients, written by cohort; the family with a future is read back."""
    activity = views.activity(spark, sf)
    path = f"{run_dir(spark)}/cohorts-{uuid.uuid4().hex}"
    rec.write_cohorts(cohort.clean_records(activity), cohort.classify_cohort(activity), path)
    family = rec.read_family(spark, path, cohort.FAMILIES["future"])
    return family.select("p_id", "cohort", F.to_json("visits").alias("visits_json"))


@query
def csv_round_trip(spark, sf):
    """Visits written as CSV and read back."""
    visits = views.visits_of(views.purchases(spark, sf))
    path = f"{run_dir(spark)}/visits-{uuid.uuid4().hex}"
    rec.write_table(visits, path, "csv")
    return rec.read_table(spark, path, "p_id BIGINT, visit_idx BIGINT, age INT", "csv")


@query
def nested_round_trip(spark, sf):
    """Nested records written as JSON Lines, read back and flattened."""
    path = f"{run_dir(spark)}/records-{uuid.uuid4().hex}"
    rec.write_records(views.notes(spark, sf), path)
    return rec.flatten_visits(rec.read_records(spark, path))


@query
def object_round_trip(spark, sf):
    """Nested records written as one JSON object a file, read back in byte ranges and flattened."""
    path = f"{run_dir(spark)}/objects-{uuid.uuid4().hex}"
    rec.write_records_object(views.notes(spark, sf), path)
    return rec.flatten_visits(rec.read_records_object(spark, path))


@query
def cohort_classify_legacy(spark, sf):
    return cohort.classify_cohort_legacy(views.activity(spark, sf))


@query
def cleaned_records_legacy(spark, sf):
    """What the earlier selection leaves, with its cohorts."""
    activity = views.activity(spark, sf)
    cleaned = rec.records_json(cohort.clean_records_legacy(activity))
    return cleaned.join(cohort.classify_cohort_legacy(activity), "p_id")


@query
def cohort_families(spark, sf):
    return cohort.family_sizes(cohort_classify(spark, sf))


@query
def cohort_members(spark, sf):
    return cohort.cohort_families(cohort_select(spark, sf))


@query
def cohort_attrition(spark, sf):
    return cohort.cohort_attrition(views.activity(spark, sf))


@query
def single_age_attrition(spark, sf):
    return cohort.single_age_attrition(views.activity(spark, sf))


def _summary(spark, sf):
    return cohort.patient_summary(views.purchases(spark, sf), views.PURCHASE_CODES, views.PURCHASE_INDEX)


@query
def first_index_age(spark, sf):
    return _summary(spark, sf).where("age_dm IS NOT NULL").select("p_id", "age_dm")


@query
def patient_summary(spark, sf):
    return _summary(spark, sf)


@query
def patient_summary_by_sex(spark, sf):
    """With a sex on every row, here by the visit's number, a patient has a row per sex."""
    dx = views.purchases(spark, sf).withColumn("sex", F.when(F.col("visit_idx") % 2 == 0, "M").otherwise("F"))
    return cohort.patient_summary(dx, views.PURCHASE_CODES, views.PURCHASE_INDEX)


# ---- table one --------------------------------------------------------------------------------

TABLE_CATEGORICAL = ["c_mktsegment", "age_dm_cat", "age_cat", "ECONOMY", "PROMO", "STANDARD"]
TABLE_NUMERIC = ["age_dm", "c_acctbal"]


def _patients(spark, sf) -> DataFrame:
    customers = views.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    joined = customers.join(_summary(spark, sf), F.col("c_custkey") == F.col("p_id"))
    return joined.withColumns({"age_dm_cat": scalars.age_band(F.col("age_dm")), "age_cat": scalars.age_band(F.col("age"))})


@query
def tableone_header(spark, sf):
    return tableone.header(_patients(spark, sf), "diabetes")


@query
def tableone_numeric(spark, sf):
    return rounded(tableone.numeric(_patients(spark, sf), TABLE_NUMERIC, "diabetes"))


@query
def tableone_categorical(spark, sf):
    return rounded(tableone.categorical(_patients(spark, sf), TABLE_CATEGORICAL, "diabetes"))


@query
def tableone_full(spark, sf):
    return rounded(tableone.table_one(_patients(spark, sf), TABLE_CATEGORICAL, TABLE_NUMERIC, "diabetes"))


@query
def tableone_merge(spark, sf):
    return rounded(tableone.merged(_patients(spark, sf), TABLE_CATEGORICAL, TABLE_NUMERIC, "diabetes"))


@query
def tableone_display(spark, sf):
    patients = _patients(spark, sf)
    tidy = tableone.table_one(patients, TABLE_CATEGORICAL, TABLE_NUMERIC, "diabetes")
    shown = tableone.display(tidy, ["DM", "No DM"], [*TABLE_NUMERIC, *TABLE_CATEGORICAL])
    return shown.select("row", F.col("DM").alias("dm"), F.col("No DM").alias("no_dm"))


# ---- features ---------------------------------------------------------------------------------

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _customers(spark, sf):
    return views.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


@query
def one_hot(spark, sf):
    return features.one_hot(_customers(spark, sf).select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS, "seg")


@query
def bools_to_int(spark, sf):
    flags = [(F.col("o_orderstatus") == s).alias(f"is_{s}") for s in ("F", "O")]
    return features.bools_to_int(views.table(spark, sf, "orders").select("o_orderkey", *flags, "o_orderstatus"))


@query
def feature_fill(spark, sf):
    return features.fill_missing(_summary(spark, sf).select("p_id", "age", "age_dm"), ["age_dm"])


def _ratio() -> Column:
    nation = F.col("c_nationkey")
    return (
        F.when(nation == 0, F.lit(float("inf")))
        .when(nation == 1, F.lit(None).cast("double"))
        .otherwise(F.col("c_acctbal") / nation)
    )


@query
def feature_clean(spark, sf):
    frame = _customers(spark, sf).select("c_custkey", _ratio().alias("ratio"))
    return rounded(features.clean_features(frame, ["ratio"]))


@query
def scale_minmax(spark, sf):
    frame = _customers(spark, sf).select("c_custkey", "c_acctbal", F.lit(7).alias("constant"))
    return rounded(features.scale_minmax(frame, ["c_acctbal", "constant"]))


@query
def scale_standard(spark, sf):
    frame = _customers(spark, sf).select("c_custkey", "c_acctbal", F.lit(7).alias("constant"))
    return rounded(features.scale_standard(frame, ["c_acctbal", "constant"]))


@query
def hash_sample(spark, sf):
    return features.hash_sample(_customers(spark, sf).select("c_custkey"), "c_custkey", 10)


@query
def hash_split(spark, sf):
    return features.hash_split(_customers(spark, sf).select("c_custkey"), "c_custkey")


@query
def assemble(spark, sf):
    frame = features.require_numeric(_customers(spark, sf).drop("c_mktsegment"))
    wide = features.assemble(frame, ["c_nationkey", "c_acctbal"])
    return wide.select("c_custkey", F.size("features").alias("n_features"), F.element_at("features", 2).alias("last"))


@query
def correlation_pairs(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(features.correlation_pairs(views.table(spark, sf, "lineitem"), columns))


@query
def cluster_sizes(spark, sf):
    return features.cluster_sizes(views.points(spark, sf))


@query
def cluster_overview(spark, sf):
    return features.cluster_overview(views.points(spark, sf))


def _profile(spark, sf):
    flags = {f"v{i}": (F.col("features")[i] > 0).cast("int") for i in range(64)}
    return features.cluster_profile(views.points(spark, sf), flags)


@query
def cluster_profile_count(spark, sf):
    return _profile(spark, sf).select("cluster", "size", "col", "n")


@query
def cluster_profile_percent(spark, sf):
    return rounded(_profile(spark, sf).select("cluster", "col", "pct"))


# ---- cluster validity on given labels ---------------------------------------------------------

LABEL_KS = list(range(2, 10))


def _labelled(spark, sf):
    return validity.with_label(views.points(spark, sf))


def _relabelled(spark, sf):
    """Several labellings of the same rows: the label modulo each k."""
    labels = F.array(*[(F.col("label") % k).cast("int") for k in LABEL_KS])
    return views.points(spark, sf).select("id", "features", labels.alias("labels"))


@query
def inertia(spark, sf):
    return rounded(validity.inertia(validity.spreads(_relabelled(spark, sf), LABEL_KS)))


@query
def aic_bic(spark, sf):
    rows = _relabelled(spark, sf)
    dims = validity.dimension(rows)
    return rounded(validity.aic_bic(validity.inertia(validity.spreads(rows, LABEL_KS, dims)), dims))


@query
def davies_bouldin(spark, sf):
    return rounded(validity.davies_bouldin(validity.spreads(_relabelled(spark, sf), LABEL_KS)))


@query
def calinski_harabasz(spark, sf):
    rows = _relabelled(spark, sf)
    dims = validity.dimension(rows)
    return rounded(validity.calinski_harabasz(validity.spreads(rows, LABEL_KS, dims), dims))


@query
def silhouette_samples(spark, sf):
    return rounded(validity.silhouette_samples(_labelled(spark, sf)))


@query
def silhouette_exact(spark, sf):
    return rounded(validity.silhouette_exact(_relabelled(spark, sf), LABEL_KS))


@query
def silhouette_sq(spark, sf):
    return rounded(validity.silhouette_squared(_labelled(spark, sf), [10]))


@query
def drop_noise(spark, sf):
    """Scores of the labels without label 0, which stands for noise."""
    noisy = views.points(spark, sf).withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    return rounded(validity.score_models(validity.with_label(validity.drop_noise(noisy)), [9]))


def _ranked(spark, sf):
    return validity.rank_scores(validity.score_models(_relabelled(spark, sf), LABEL_KS))


@query
def rank_scores(spark, sf):
    return rounded(_ranked(spark, sf))


@query
def best_k_union(spark, sf):
    return validity.best_k_union(_ranked(spark, sf))


# ---- fitted models ----------------------------------------------------------------------------


@query
def kmeans_fit(spark, sf):
    return cluster.kmeans_fit(views.points(spark, sf), 8).select("id", "cluster")


@query
def bisecting_fit(spark, sf):
    return cluster.bisecting_fit(views.points(spark, sf), 8).select("id", "cluster")


@query
def ward_two_stage(spark, sf):
    placed = cluster.ward_two_stage(views.points(spark, sf), [4, 8])
    return placed.select("id", F.col("labels")[0].alias("ward_4"), F.col("labels")[1].alias("ward_8"))


@query
def birch_fit(spark, sf):
    placed = cluster.birch_labels(views.points(spark, sf), [4, 8])
    return placed.select("id", F.col("labels")[0].alias("birch_4"), F.col("labels")[1].alias("birch_8"))


@query
def pca_project(spark, sf):
    return rounded(cluster.pca_project(views.points(spark, sf), 3).drop("features", "label"))


@query
def pca_kmeans(spark, sf):
    return rounded(cluster.pca_kmeans(views.points(spark, sf)))


@query
def dbscan(spark, sf):
    """Two scaled whole-number columns and status flags, as in a yearly patient table."""
    day = F.col("o_orderdate")
    status = [(F.col("o_orderstatus") == s).cast("int").alias(f"is_{s}") for s in ("F", "O", "P")]
    orders = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.year(day).alias("age"), F.month(day).alias("years"), *status
    )
    scaled = features.scale_minmax(features.scale_standard(orders, ["age"]), ["years"])
    return density.dbscan(scaled, ["age", "years"], 0.1, 7, ["is_F", "is_O", "is_P"])


@query
def dbscan_plane(spark, sf):
    """Two continuous columns and two flags."""
    f = F.col("features")
    flags = [(f[i] > 0).cast("int").alias(f"b{i}") for i in (2, 3)]
    plane = views.points(spark, sf).select("id", f[0].alias("x"), f[1].alias("y"), *flags)
    return density.dbscan(plane, ["x", "y"], 0.04, 4, ["b2", "b3"])


@query
def dbscan_vectors(spark, sf):
    """All 64 dimensions, inside each label."""
    return metric.dbscan_metric(views.points(spark, sf), "features", 1.22, 4, ["label"])


@query
def best_k_silhouette(spark, sf):
    """By the Euclidean index, which is exact and quadratic in distinct rows."""
    return rounded(validity.best_k_silhouette(views.points(spark, sf), metric="euclidean"))


@query
def best_k_silhouette_sq(spark, sf):
    return rounded(validity.best_k_silhouette(views.points(spark, sf)))


@query
def best_k_elbow(spark, sf):
    return rounded(validity.best_k_elbow(views.points(spark, sf)))


@query
def best_k_gap(spark, sf):
    return rounded(validity.best_k_gap(views.points(spark, sf)))


@query
def aic_bic_sweep(spark, sf):
    return rounded(validity.aic_bic_sweep(views.points(spark, sf)))


@query
def evaluate_k(spark, sf):
    return rounded(validity.evaluate_k(views.points(spark, sf), range(2, 41)))


@query
def evaluate_k_ward(spark, sf):
    return rounded(validity.evaluate_k(views.points(spark, sf), range(2, 10), "ward"))


@query
def candidate_ks(spark, sf):
    points = views.points(spark, sf)
    return validity.candidate_ks(
        [
            validity.best_k_silhouette(points),
            validity.best_k_silhouette(points, method="ward"),
            validity.best_k_silhouette(points, method="birch"),
            validity.best_k_gap(points),
            validity.best_k_elbow(points),
        ]
    )


# ---- what must hold for models that SQL cannot fit ---------------------------------------------


@query
def cluster_facts(spark, sf):
    """Per method: rows, ids and clusters of its labels; every row has one label, no cluster is empty."""
    points, k = views.points(spark, sf), 8
    plane = cluster.pca_kmeans(points, k)
    labels = {
        "kmeans": cluster.kmeans_fit(points, k).select("id", F.col("cluster").alias("c")),
        "bisecting": cluster.bisecting_fit(points, k).select("id", F.col("cluster").alias("c")),
        "ward": cluster.ward_two_stage(points, [k]).select("id", F.col("labels")[0].alias("c")),
        "pca_kmeans": plane.select("id", F.col("cluster").alias("c")),
        "birch": cluster.birch_labels(points, [k]).select("id", F.col("labels")[0].alias("c")),
        "ward_rows": cluster.ward_fit(points, [k]).select("id", F.col("labels")[0].alias("c")),
    }
    rows = None
    for method, found in labels.items():
        one = found.agg(
            F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count_distinct("c").alias("n_clusters"),
            F.min("c").alias("lowest"), F.max("c").alias("highest"),
        ).withColumn("method", F.lit(method))
        rows = one if rows is None else rows.union(one)
    return rows


@query
def sweep_facts(spark, sf):
    """Per k: does the cost of the labels equal the model's, and does it fall as k grows."""
    points, ks = views.points(spark, sf), list(range(2, 10))
    models, cost = cluster.sweep_kmeans(points, ks)
    labelled = cluster.assign(points, [models[(0, k)] for k in ks])
    measured = literal_table(spark, [(k, float(cost[(0, k)])) for k in ks], "k INT, cost DOUBLE")
    # The model's cost is measured around its centers; the mean of their rows can only be closer.
    totals = validity.inertia(validity.spreads(labelled, ks)).join(measured, "k")
    before = F.lag("cost").over(Window.orderBy("k"))
    return totals.select(
        "k",
        "n",
        "n_clusters",
        ((F.col("inertia") <= F.col("cost") * (1 + 1e-9)) & (F.col("inertia") >= F.col("cost") * 0.98)).alias("cost_agrees"),
        F.coalesce(F.col("cost") < before, F.lit(True)).alias("falls"),
    )


@query
def stored_models(spark, sf):
    """Models fitted on one half of the rows, stored, read and given to the other half: are its labels those of the fit."""
    points, ks = views.points(spark, sf), [3, 5, 8]
    models, _ = cluster.sweep_kmeans(points.where("id % 2 = 0"), ks, max_iter=10)
    path = f"{run_dir(spark)}/models-{uuid.uuid4().hex}"
    cluster.write_models(spark, models, path)
    rest, stored = points.where("id % 2 = 1"), cluster.read_models(spark, path)
    labels = [cluster.assign(rest, [m[(0, k)] for k in ks]).select("id", F.col("labels").alias(n)) for m, n in ((models, "a"), (stored, "b"))]
    return labels[0].join(labels[1], "id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"))


@query
def pca_facts(spark, sf):
    """Components are centred, uncorrelated and in order of variance."""
    plane = cluster.pca_project(views.points(spark, sf), 2)
    a, b = F.col("pca_0"), F.col("pca_1")
    return plane.agg(
        F.count("*").alias("n_rows"),
        ((F.abs(F.avg(a)) < 1e-9) & (F.abs(F.avg(b)) < 1e-9)).alias("centred"),
        (F.abs(F.corr(a, b)) < 1e-6).alias("uncorrelated"),
        (F.var_samp(a) >= F.var_samp(b)).alias("ordered"),
    )


@query
def choice_facts(spark, sf):
    """Per criterion: how many k's it looked at, how many it chose, and whether these are the best of its scores."""
    points = views.points(spark, sf)
    info = validity.aic_bic_sweep(points, range(2, 9))
    least = lambda value: F.min_by("k", F.struct(value, "k"))
    tables = {
        "silhouette": (validity.best_k_silhouette(points, range(2, 7)), F.min_by("k", F.struct(-F.col("silhouette"), "k"))),
        "aic": (info.withColumn("chosen", F.col("chosen_aic")), least("aic")),
        "bic": (info.withColumn("chosen", F.col("chosen_bic")), least("bic")),
        "gap": (
            validity.best_k_gap(points, range(1, 5), references=2, max_iter=5),
            F.min_by("k", F.struct(-F.col("gap"), "k")),
        ),
    }
    rows = None
    for name, (found, best) in tables.items():
        picked = F.max(F.when(F.col("chosen"), F.col("k")))
        one = found.agg(F.count("*").alias("n_k"), F.count_if("chosen").alias("n_chosen"), (picked == best).alias("is_best"))
        one = one.withColumn("criterion", F.lit(name))
        rows = one if rows is None else rows.union(one)
    return rows


@query
def silhouette_bounds(spark, sf):
    """Does the exact Euclidean index lie within the stated error of the linear one, for given labels."""
    rows = _relabelled(spark, sf)
    exact = validity.silhouette_exact(rows, LABEL_KS).withColumnRenamed("silhouette", "exact")
    both = validity.silhouette_bounded(rows, LABEL_KS, cells=100).join(exact, "k")
    return both.select("k", (F.abs(F.col("silhouette") - F.col("exact")) <= F.col("error")).alias("within"), (F.col("error") < 1).alias("bounded"))
