"""SQL that gives the result of each registered query, written from the definitions.

History and labels use the literal self joins here; the Spark side uses the closed forms.
"""

from __future__ import annotations

from kohorta.plans import queries as Q
from kohorta.plans import views
from kohorta.sources.catalog import catalog_rows

ORACLE: dict[str, str] = {}


def _values(rows) -> str:
    def cell(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + ")"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


REC = """rec AS (
  SELECT DISTINCT o_custkey AS p_id, o_orderkey AS visit_idx, CAST(year(o_orderdate) - 1950 AS INT) AS age, p_type AS code
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
vis AS (SELECT DISTINCT p_id, visit_idx, age FROM rec)"""

_EVT = """{name} AS (
  SELECT CAST(user_id AS VARCHAR) || ':' || CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS p_id,
    CAST(date_diff('day', CAST(date_trunc('week', ts) AS DATE), CAST(ts AS DATE)) AS INT) AS visit_idx,
    event_id AS code_idx,
    CASE event_type WHEN 'signup' THEN '401' WHEN 'error' THEN {error} WHEN 'click' THEN '1111' WHEN 'view' THEN '2222'
      ELSE CASE WHEN event_id % 17 = 3 THEN '9999' WHEN event_id % 19 = 5 THEN '3333'
      WHEN event_id % 13 = 7 THEN '9' || CAST(CAST(floor(value) AS BIGINT) % 80 + 120 AS VARCHAR) ELSE '9' || lpad(CAST(CAST(floor(value) AS BIGINT) % 120 AS VARCHAR), 3, '0') END END AS code
  FROM events)"""
EVT = _EVT.format(name="evt", error="'703'")
_KNOWN = "[" + ", ".join(f"'{r[0]}'" for r in catalog_rows()) + "]"
CEVT = _EVT.format(name="evt", error=f"({_KNOWN})[CAST(regexp_extract(props, '[0-9]+') AS INT) % 83 + 1]")

LINE = """line AS (
  SELECT l_orderkey AS p_id, l_linenumber AS visit_idx, l_partkey AS code_idx,
    CASE l_returnflag WHEN 'A' THEN '1111' WHEN 'R' THEN '2222' ELSE l_returnflag END AS code
  FROM lineitem)"""
SEX = """sexes AS (
  SELECT p_id, bool_or(code = '1111') AS is_male, bool_or(code = '2222') AS is_female FROM {src} GROUP BY p_id),
sexed AS (SELECT p_id, CASE WHEN is_male AND NOT is_female THEN 'M' WHEN is_female AND NOT is_male THEN 'F' ELSE 'U' END AS sex FROM sexes)"""

# ---- records and scalar functions

ORACLE["flatten_visits"] = _with(
    """c AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS p_id, string_split(text, chr(10)) AS ls FROM conversations)""",
    """v AS (SELECT p_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS visit_idx FROM c)""",
    """w AS (SELECT p_id, visit_idx, string_split(line, ' ') AS ws FROM v)""",
    """x AS (SELECT p_id, visit_idx, unnest(ws) AS code, generate_subscripts(ws, 1) - 1 AS code_idx FROM w)""",
) + "SELECT p_id, CAST(visit_idx AS INT) AS visit_idx, CAST(code_idx AS INT) AS code_idx, code FROM x WHERE code <> ''"
ORACLE["parse_visit_id"] = """
SELECT CAST(o_custkey AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR) AS v_o_id, o_orderkey AS position FROM orders"""
ORACLE["extract_age"] = _with(EVT) + """
SELECT code_idx, CASE WHEN code ~ '^9[01][0-9][0-9]$' THEN CAST(substr(code, 2) AS INT) END AS age FROM evt"""
ORACLE["code_kinds"] = _with(EVT) + """
SELECT CASE WHEN code IN ('1111', '2222', '3333') THEN 'sex' WHEN code IN ('401', '703') THEN 'dx'
  WHEN code = '9999' THEN 'age_unknown' ELSE 'age' END AS kind,
  count(*) AS n FROM evt GROUP BY 1"""
ORACLE["strict_code_cast"] = "SELECT p_partkey, CAST(substr(p_brand, 7) AS BIGINT) AS brand_no FROM part"
ORACLE["age_from_dates"] = """
SELECT o_orderkey,
  CAST(floor(date_diff('day', DATE '1970-03-01', CAST(o_orderdate AS DATE)) / CAST(365.25 AS DOUBLE)) AS BIGINT) AS age_a,
  CAST(floor(date_diff('day', DATE '1998-07-01', CAST(o_orderdate AS DATE)) / CAST(365.25 AS DOUBLE)) AS BIGINT) AS age_b
FROM orders"""
ORACLE["age_band"] = _with(REC) + """
SELECT visit_idx, CASE WHEN a < 18 THEN '0-18' WHEN a < 45 THEN '18-44' WHEN a < 65 THEN '45-64' ELSE '60>' END AS band
FROM (SELECT visit_idx, (age - 45) * 10 + 10 AS a FROM vis)"""

# ---- sex and age

_LINE_SEX = _with(LINE, SEX.format(src="line"))
ORACLE["sex_evidence"] = _with(LINE) + """
SELECT p_id, visit_idx, code_idx, code, bool_or(code = '1111') OVER (PARTITION BY p_id) AS is_male,
  bool_or(code = '2222') OVER (PARTITION BY p_id) AS is_female FROM line"""
ORACLE["sex_resolve"] = _LINE_SEX + "SELECT p_id, sex FROM sexed"
ORACLE["drop_marker_rows"] = _with(LINE) + "SELECT * FROM line WHERE code NOT IN ('1111', '2222')"
ORACLE["sex_report"] = _LINE_SEX + "SELECT is_male, is_female, count(*) AS n FROM sexes GROUP BY 1, 2"
ORACLE["sex_conflicts"] = _LINE_SEX + "SELECT p_id FROM sexes WHERE is_male AND is_female"
ORACLE["sex_encode_code"] = _LINE_SEX + """
SELECT p_id, CASE sex WHEN 'M' THEN '1111' WHEN 'F' THEN '2222' ELSE sex END AS sex_code FROM sexed"""
ORACLE["sex_encode_num"] = _LINE_SEX + """
SELECT p_id, CASE sex WHEN 'M' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS sex_num,
  CASE sex WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE 'Unknow' END AS sex_label FROM sexed"""
_AGED = """aged AS (SELECT *, CASE WHEN code ~ '^9[01][0-9][0-9]$' THEN CAST(substr(code, 2) AS INT) END AS a
  FROM evt WHERE code NOT IN ('1111', '2222', '3333'))"""
ORACLE["first_age_in_visit"] = _with(EVT, _AGED) + """
SELECT p_id, visit_idx, a AS age FROM
  (SELECT *, row_number() OVER (PARTITION BY p_id, visit_idx ORDER BY code_idx) AS rn FROM aged WHERE a IS NOT NULL)
WHERE rn = 1"""
ORACLE["age_conflict_report"] = _with(
    EVT,
    _AGED,
    """f AS (SELECT *, first_value(a IGNORE NULLS) OVER
      (PARTITION BY p_id, visit_idx ORDER BY code_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS age FROM aged)""",
) + """
SELECT count(DISTINCT CASE WHEN age <> a THEN p_id END) AS n_conflict,
  count(DISTINCT CASE WHEN age IS NULL THEN p_id END) AS n_unknown FROM f"""

# The coded activity as the wide table sees it: cdx are diagnosis rows, cvis their visits.
WIDE_SRC = ",\n".join(
    [
        CEVT,
        SEX.format(src="evt"),
        _AGED,
        """fa AS (SELECT p_id, visit_idx, arg_min(a, code_idx) AS age FROM aged WHERE a IS NOT NULL GROUP BY ALL)""",
        "cat AS (SELECT * FROM " + _values([(str(r[0]), r[1]) for r in catalog_rows()]) + " AS t(raw, cie10))",
        """cdx AS (SELECT DISTINCT aged.p_id, aged.visit_idx, sex, fa.age, coalesce(cie10, aged.code) AS code
          FROM aged JOIN fa ON aged.p_id = fa.p_id AND aged.visit_idx = fa.visit_idx
          JOIN sexed ON sexed.p_id = aged.p_id LEFT JOIN cat ON cat.raw = aged.code
          WHERE a IS NULL AND aged.code <> '9999')""",
        "cvis AS (SELECT DISTINCT p_id, visit_idx, sex, age FROM cdx)",
    ]
)
ORACLE["clinical_visits"] = _with(WIDE_SRC) + "SELECT p_id, visit_idx, sex, age FROM cvis"

# ---- codes

_PCAT = "pcat AS (SELECT * FROM " + _values(Q.PART_CATALOG) + " AS t(code_bps, cie10))"
ORACLE["map_codes"] = _with(REC, _PCAT) + """
SELECT p_id, visit_idx, age, coalesce(cie10, code) AS code FROM rec LEFT JOIN pcat ON code_bps = code"""
ORACLE["unmapped_codes"] = _with(REC, _PCAT) + """
SELECT DISTINCT code, p_id FROM rec WHERE code NOT IN (SELECT code_bps FROM pcat) ORDER BY code, p_id"""
ORACLE["code_range_expand"] = _with(
    """r AS (SELECT p_size AS code_bps, min(CAST(substr(p_brand, 7) AS INT)) AS lo, max(CAST(substr(p_brand, 7) AS INT)) AS hi
       FROM part GROUP BY p_type, p_size)""",
    """e AS (SELECT code_bps, lo, hi, unnest(generate_series(lo, hi)) AS n FROM r)""",
) + """
SELECT 'B' || lpad(CAST(n AS VARCHAR), 2, '0') AS cie, code_bps,
  'B' || lpad(CAST(lo AS VARCHAR), 2, '0') || CASE WHEN lo = hi THEN '' ELSE '-B' || lpad(CAST(hi AS VARCHAR), 2, '0') END AS cie_group
FROM e"""
_PRE = "pre AS (SELECT * FROM " + _values(Q.BRAND_PREFIXES) + " AS t(cie, cie_group, code_bps))"
_BEST = """best AS (SELECT p_partkey, cie FROM (SELECT p_partkey, cie,
    row_number() OVER (PARTITION BY p_partkey ORDER BY length(cie) DESC) AS rn
  FROM part JOIN (SELECT DISTINCT cie FROM pre) ON starts_with(p_brand, cie)) WHERE rn = 1)"""
ORACLE["prefix_match"] = _with(_PRE, _BEST) + """
SELECT p_partkey, best.cie AS cie, cie_group, CAST(code_bps AS BIGINT) AS code_bps FROM best JOIN pre ON pre.cie = best.cie"""
ORACLE["prefix_counts"] = _with(_PRE, _BEST) + """
SELECT p.cie AS cie, count(best.cie) AS n FROM (SELECT DISTINCT cie FROM pre) p LEFT JOIN best ON best.cie = p.cie GROUP BY 1"""

# ---- relational tables

ORACLE["enrich_left"] = """
SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey"""
ORACLE["inner_enrich"] = """
SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0"""
ORACLE["semi_join_index"] = _with(REC) + """
SELECT p_id, visit_idx, age, code FROM rec WHERE p_id IN (SELECT p_id FROM rec WHERE code = 'PROMO')"""
ORACLE["target_filter"] = _with(REC) + "SELECT p_id, visit_idx, age, code FROM rec WHERE code IN ('ECONOMY', 'LARGE')"
ORACLE["attrition_counts"] = _with(REC) + """
SELECT (SELECT count(DISTINCT c_custkey) FROM customer) AS n_initial,
  (SELECT count(DISTINCT p_id) FROM rec) AS n_with_code,
  (SELECT count(DISTINCT p_id) FROM rec WHERE code = 'PROMO') AS n_with_index"""
ORACLE["distinct_rows"] = _with(REC) + "SELECT DISTINCT p_id, age, code FROM rec"
ORACLE["build_nested_records"] = _with(REC, "d AS (SELECT DISTINCT p_id, age, code FROM rec)") + """
SELECT p_id, '[' || string_agg('["' || code || '","' || CAST(age + 9000 AS VARCHAR) || '"]', ',' ORDER BY age, code) || ']' AS visits_json
FROM d GROUP BY p_id"""
_REL = _with(
    "g AS (SELECT * FROM " + _values(Q.BRAND_GROUPS) + " AS t(code_bps, cie10))",
    """e AS (SELECT code_bps, cie10, unnest(generate_series(CAST(substr(cie10, 2, 2) AS INT),
        CAST(right(cie10, 2) AS INT))) AS n FROM g)""",
    """diag AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, CAST(substr(p_brand, 7) AS INT) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)""",
    """rows_ AS (SELECT DISTINCT o_custkey, CASE c_nationkey % 3 WHEN 0 THEN '1111' WHEN 1 THEN '2222' ELSE 'X' END AS sex,
        CAST(code_bps AS VARCHAR) AS code, cie10,
        CAST(floor(date_diff('day', DATE '1950-01-01' + CAST(c_custkey % 9000 AS INT), d) / CAST(365.25 AS DOUBLE)) AS BIGINT) AS age
        FROM diag JOIN e USING (n) JOIN customer ON c_custkey = o_custkey)""",
)
ORACLE["relational_to_records"] = _REL + """
SELECT CAST(o_custkey AS VARCHAR) AS p_id, '[["' || max(sex) || '"],' ||
  string_agg('["' || code || '","' || CAST(age + 9000 AS VARCHAR) || '"]', ',' ORDER BY age, code) || ']' AS visits_json
FROM (SELECT DISTINCT o_custkey, sex, code, age FROM rows_)
WHERE o_custkey IN (SELECT o_custkey FROM rows_ WHERE cie10 = 'B13') GROUP BY o_custkey"""
ORACLE["relational_counts"] = _REL + """
SELECT (SELECT count(*) FROM customer) AS n_initial, count(DISTINCT o_custkey) AS n_with_code,
  count(DISTINCT CASE WHEN cie10 = 'B13' THEN o_custkey END) AS n_with_index FROM rows_"""

# ---- history, labels, wide tables


def _carry(vis: str, dx: str, prefix: str, keys: str) -> str:
    """Literal form: every earlier visit of the patient joined, labels by shift and join on age."""
    targets = _in(views.PURCHASE_TARGETS) if prefix == "r" else _in(t for t in sorted(r[1] for r in catalog_rows() if r[2]))
    return f"""{prefix}pairs AS (SELECT a.*, b.visit_idx AS visit2 FROM {vis} a JOIN {vis} b ON a.p_id = b.p_id
    AND (b.age < a.age OR (b.age = a.age AND b.visit_idx <= a.visit_idx))),
{prefix}carried AS (SELECT DISTINCT {', '.join('x.' + k for k in keys.split(', '))}, d.code FROM {prefix}pairs x JOIN {dx} d
    ON d.p_id = x.p_id AND d.visit_idx = x.visit2),
{prefix}hits AS (SELECT p_id, age, 'pred1y_' || code AS label FROM {prefix}carried WHERE code IN {targets}),
{prefix}shift AS (SELECT p_id, age, label FROM {prefix}hits UNION SELECT p_id, age - 1, label FROM {prefix}hits),
{prefix}labels AS (SELECT DISTINCT {', '.join('v.' + k for k in keys.split(', '))}, label FROM {vis} v JOIN {prefix}shift s
    ON v.p_id = s.p_id AND v.age = s.age)"""


RCARRY = _carry("vis", "rec", "r", "p_id, visit_idx, age")
CCARRY = _carry("cvis", "cdx", "c", "p_id, visit_idx, sex, age")


def _pivot(prefix: str, keys: str, codes, targets) -> str:
    flags = ", ".join(
        f"max(CASE WHEN code = '{c}' THEN 1 END) AS \"{c}\""
        for c in [*codes, *("pred1y_" + t for t in targets)]
    )
    return f"""{prefix}wide AS (SELECT {keys}, {flags} FROM
  (SELECT {keys}, code FROM {prefix}carried UNION ALL SELECT {keys}, label FROM {prefix}labels) GROUP BY {keys})"""


RWIDE = _pivot("r", "p_id, visit_idx, age", views.PURCHASE_CODES, views.PURCHASE_TARGETS)
_CODES, _TARGETS = Q._catalog_columns()
CWIDE = _pivot("c", "p_id, visit_idx, sex, age", _CODES, _TARGETS)


def _yearly(src: str, keys_out, columns) -> str:
    maxes = ", ".join(f'max("{c}") AS "{c}"' for c in [*keys_out, *columns])
    return f"SELECT p_id, age, {maxes} FROM {src} GROUP BY p_id, age"


_RCOLS = [*views.PURCHASE_CODES, *("pred1y_" + t for t in views.PURCHASE_TARGETS)]
_CCOLS = [*_CODES, *("pred1y_" + t for t in _TARGETS)]
ORACLE["history_carry"] = _with(REC, RCARRY) + "SELECT p_id, visit_idx, age, code FROM rcarried"
ORACLE["target_labels"] = _with(REC, RCARRY) + "SELECT p_id, visit_idx, age, label FROM rlabels"
ORACLE["target_labels_onset"] = _with(
    REC, "o AS (SELECT p_id, code, min(age) AS f FROM rec WHERE code IN ('ECONOMY', 'LARGE') GROUP BY 1, 2)"
) + """
SELECT vis.p_id, visit_idx, age, 'pred1y_' || code AS label FROM vis JOIN o ON o.p_id = vis.p_id AND age BETWEEN f - 1 AND f"""
ORACLE["label_shift_union"] = _with(REC) + """
SELECT p_id, age, 'pred1y_' || code AS label FROM rec WHERE code IN ('ECONOMY', 'LARGE')
UNION SELECT p_id, CAST(age - 1 AS INT), 'pred1y_' || code FROM rec WHERE code IN ('ECONOMY', 'LARGE')"""
ORACLE["label_union"] = _with(REC, RCARRY) + """
SELECT p_id, visit_idx, age, code FROM rcarried UNION ALL SELECT p_id, visit_idx, age, label FROM rlabels"""
ORACLE["wide_pivot"] = _with(REC, RCARRY, RWIDE) + "SELECT * FROM rwide"
ORACLE["to_wide"] = _with(WIDE_SRC, CCARRY, CWIDE) + """
SELECT p_id || '_' || CAST(visit_idx AS VARCHAR) AS v_o_id, * EXCLUDE (visit_idx) FROM cwide"""
ORACLE["to_yearly"] = _with(WIDE_SRC, CCARRY, CWIDE, "y AS (" + _yearly("cwide", ["visit_idx", "sex"], _CCOLS) + ")") + """
SELECT *, CAST(greatest(coalesce(age - min(CASE WHEN "E10-E14" IS NOT NULL THEN age END) OVER (PARTITION BY p_id), 0), 0) AS INT)
  AS years_with_diabetes FROM y"""
ORACLE["final_sort"] = _with(REC) + "SELECT p_id, visit_idx, age FROM vis ORDER BY p_id, age, visit_idx"
ORACLE["yearly_max"] = _with(REC, RCARRY, RWIDE) + _yearly("rwide", ["visit_idx"], _RCOLS)
ORACLE["years_since_index"] = _with(REC) + """
SELECT p_id, age, CAST(greatest(coalesce(age - min(CASE WHEN hit THEN age END) OVER (PARTITION BY p_id), 0), 0) AS INT) AS years
FROM (SELECT p_id, age, bool_or(code = 'PROMO') AS hit FROM rec GROUP BY p_id, age)"""
_ONSET = "onset AS (SELECT p_id, " + ", ".join(
    f"coalesce(min(CASE WHEN code = '{c}' THEN age END), 0) AS \"{c}\"" for c in views.PURCHASE_CODES
) + " FROM rec GROUP BY p_id)"
_NAMES = "names AS (SELECT * FROM " + _values(Q.CODE_NAMES) + " AS t(cie10, name))"
ORACLE["timeline"] = _with(REC, _NAMES, "f AS (SELECT p_id, code, min(age) AS age FROM rec GROUP BY p_id, code)") + """
SELECT p_id, CAST(row_number() OVER (PARTITION BY p_id ORDER BY age, code) AS INT) AS seq, code, age,
  cie10 || ' - ' || names.name AS name, code IN ('PROMO', 'LARGE') AS is_highlight FROM f LEFT JOIN names ON cie10 = code WHERE age > 0"""
ORACLE["positive_count"] = _with(REC, _ONSET) + "SELECT *, CAST(" + " + ".join(
    f"(CASE WHEN \"{c}\" > 0 THEN 1 ELSE 0 END)" for c in ["p_id", *views.PURCHASE_CODES]
) + " AS INT) AS total_data FROM onset"

# ---- cohorts

FLAGS = """flags AS (SELECT p_id, visit_idx, count(*) FILTER (code NOT IN ('1111', '2222', '3333', '9999')) AS n,
    count(*) FILTER (code ~ '^9[0-9][0-9][0-9]$' AND code <> '9999') AS n_age,
    count(*) FILTER (code IN ('703', '910', '1999', '1401')) AS n_target, count(*) FILTER (code IN ('1111', '2222')) AS n_sex,
    bool_or(code = '9999') AS unknown, bool_or(code = '401') AS has_index,
    min(CASE WHEN code ~ '^9[0-9][0-9][0-9]$' AND code <> '9999' THEN CAST(substr(code, 2) AS INT) END) AS min_age
  FROM evt GROUP BY p_id, visit_idx),
valid AS (SELECT *, CASE WHEN n_target > 0 AND n_age > 0 AND NOT unknown THEN 'keep_target' WHEN n_target > 0 THEN 'keep_age_unknown'
    WHEN n = 0 AND n_sex > 0 THEN 'sex_only' WHEN unknown AND n > n_age THEN 'keep_age_unknown'
    WHEN n <= 1 THEN 'drop_single' WHEN n = n_age THEN 'drop_only_age'
    WHEN n_age = 0 THEN 'drop_no_age' ELSE 'keep' END AS status FROM flags),
pat AS (SELECT p_id, bool_or(has_index) AS has_index, bool_or(has_index AND n_age > 0) AS has_index_with_age,
    count(*) FILTER (status IN ('keep', 'keep_target')) AS n_valid,
    min(CASE WHEN has_index AND status IN ('keep', 'keep_target') THEN min_age END) AS dm,
    min(CASE WHEN status IN ('keep', 'keep_target') THEN min_age END) AS lo,
    max(CASE WHEN status IN ('keep', 'keep_target') THEN min_age END) AS hi FROM valid GROUP BY p_id)"""
_COHORT = """CASE WHEN dm IS NULL THEN 'errors' WHEN hi > dm AND lo < dm THEN 'complete' WHEN hi > dm AND lo = dm THEN 'only_future'
  WHEN hi = dm AND lo < dm THEN 'only_past' ELSE 'one_year' END"""
_FLAGGED = _with(EVT, FLAGS)
ORACLE["has_index_dx"] = _FLAGGED + "SELECT p_id, has_index FROM pat"
ORACLE["has_index_dx_with_age"] = _FLAGGED + "SELECT p_id, has_index_with_age FROM pat"
ORACLE["visit_validity"] = _FLAGGED + "SELECT p_id, visit_idx, status, status = 'keep_age_unknown' AS age_unknown FROM valid"
ORACLE["min_visits"] = _FLAGGED + "SELECT p_id, n_valid FROM pat WHERE n_valid >= 2"
ORACLE["min_visits_strict"] = _with(EVT, FLAGS, SEX.format(src="evt")) + """
SELECT pat.p_id, n_valid FROM pat JOIN sexed USING (p_id) WHERE n_valid >= CASE WHEN sex = 'U' THEN 3 ELSE 2 END"""
_RC = """rc AS (SELECT p_id, min(CASE WHEN code = 'PROMO' THEN age END) AS dm, min(age) AS lo, max(age) AS hi FROM rec GROUP BY p_id)"""
ORACLE["cohort_classify"] = _with(REC, _RC) + f"""
SELECT p_id, dm AS first_index_age, lo AS min_age, hi AS max_age, {_COHORT} AS cohort FROM rc"""
_SELECT = f"""chosen AS (SELECT p_id, dm AS first_index_age, lo AS min_age, hi AS max_age, {_COHORT} AS cohort
  FROM pat WHERE has_index_with_age AND n_valid >= 2)"""
ORACLE["cohort_select"] = _with(EVT, FLAGS, _SELECT) + "SELECT * FROM chosen"
_CLEAN = """own AS (SELECT p_id, visit_idx, list(code ORDER BY code_idx, code) FILTER (code NOT IN ('1111', '2222', '3333')) AS cs
  FROM evt GROUP BY p_id, visit_idx),
kv AS (SELECT p_id, list(CASE WHEN n_target > 0 AND n_age = 0 AND NOT unknown THEN list_append(cs, '9999') ELSE cs END ORDER BY visit_idx) AS vs
  FROM valid JOIN own USING (p_id, visit_idx) WHERE status LIKE 'keep%' GROUP BY p_id),
cleaned AS (SELECT sexed.p_id, CAST(to_json(list_concat(
    [[CASE sex WHEN 'M' THEN '1111' WHEN 'F' THEN '2222' ELSE '3333' END]], coalesce(vs, []))) AS VARCHAR) AS visits_json
  FROM sexed LEFT JOIN kv USING (p_id))"""
ORACLE["cleaned_records"] = _with(EVT, FLAGS, SEX.format(src="evt"), _CLEAN) + "SELECT p_id, visits_json FROM cleaned"
ORACLE["cohort_files"] = _with(EVT, FLAGS, SEX.format(src="evt"), _CLEAN, _SELECT) + """
SELECT p_id, cohort, visits_json FROM cleaned JOIN chosen USING (p_id) WHERE cohort IN ('only_future', 'complete')"""
ORACLE["csv_round_trip"] = _with(REC) + "SELECT DISTINCT p_id, visit_idx, age FROM rec"
ORACLE["nested_round_trip"] = ORACLE["flatten_visits"]
ORACLE["object_round_trip"] = ORACLE["flatten_visits"]
ORACLE["cohort_classify_legacy"] = _with(
    EVT,
    """lf AS (SELECT p_id, visit_idx, count(*) AS n, count(*) FILTER (code LIKE '%90%' AND length(code) = 4) AS n_age,
      bool_or(code = '401') AS has_index,
      min(CASE WHEN code LIKE '%90%' AND length(code) = 4 THEN CAST(substr(code, 2) AS INT) END) AS a FROM evt GROUP BY 1, 2)""",
    """lp AS (SELECT p_id, min(CASE WHEN n > 1 AND has_index THEN a END) AS d,
      min(CASE WHEN n > 1 AND n > n_age AND n_age > 0 THEN a END) AS lo,
      max(CASE WHEN n > 1 AND n > n_age AND n_age > 0 THEN a END) AS hi FROM lf GROUP BY 1)""",
    "lq AS (SELECT p_id, CASE WHEN lo IS NOT NULL AND d <> 0 THEN d END AS dm, lo, hi FROM lp)",
) + f"SELECT p_id, {_COHORT} AS cohort FROM lq"
ORACLE["cleaned_records_legacy"] = _with(
    EVT,
    """lf AS (SELECT p_id, visit_idx, count(*) AS n, count(*) FILTER (code LIKE '%90%' AND length(code) = 4) AS n_age,
      bool_or(code = '401') AS has_index, list(code ORDER BY code_idx, code) AS cs,
      min(CASE WHEN code LIKE '%90%' AND length(code) = 4 THEN CAST(substr(code, 2) AS INT) END) AS a FROM evt GROUP BY 1, 2)""",
    """lp AS (SELECT p_id, min(CASE WHEN n > 1 AND has_index THEN a END) AS d,
      list(cs ORDER BY visit_idx) FILTER (n > 1 AND n > n_age AND n_age > 0) AS vs,
      min(CASE WHEN n > 1 AND n > n_age AND n_age > 0 THEN a END) AS lo,
      max(CASE WHEN n > 1 AND n > n_age AND n_age > 0 THEN a END) AS hi FROM lf GROUP BY 1)""",
    "lq AS (SELECT p_id, vs, CASE WHEN lo IS NOT NULL AND d <> 0 THEN d END AS dm, lo, hi FROM lp)",
) + f"SELECT p_id, CAST(to_json(coalesce(vs, [])) AS VARCHAR) AS visits_json, {_COHORT} AS cohort FROM lq"
_FAM = """fam AS (SELECT * FROM (VALUES ('all', 'complete'), ('all', 'only_future'), ('all', 'only_past'), ('all', 'one_year'),
  ('all', 'errors'), ('future', 'only_future'), ('future', 'complete'), ('past', 'only_past'), ('past', 'complete'),
  ('complete', 'complete'), ('only_future', 'only_future'), ('only_past', 'only_past'), ('one_year', 'one_year'),
  ('errors', 'errors')) AS t(family, cohort))"""
ORACLE["cohort_families"] = _with(REC, _RC, _FAM, f"k AS (SELECT p_id, {_COHORT} AS cohort FROM rc)") + """
SELECT family, count(*) AS n FROM k JOIN fam USING (cohort) GROUP BY family"""
ORACLE["cohort_members"] = _with(EVT, FLAGS, _SELECT, _FAM) + "SELECT p_id, family FROM chosen JOIN fam USING (cohort)"


def _steps(counts) -> str:
    names, exprs = zip(*counts)
    out = []
    for i, name in enumerate(names):
        dropped = "0" if i == 0 else f"c{i - 1} - c{i}"
        out.append(f"SELECT '{i}_{name}' AS step, c{i} AS n_remaining, CAST({dropped} AS BIGINT) AS n_dropped FROM k")
    cols = ", ".join(f"count(*) FILTER ({e}) AS c{i}" for i, e in enumerate(exprs))
    return cols, "\nUNION ALL ".join(out)


_cols, _union = _steps(
    [
        ("initial", "true"),
        ("has_index", "has_index"),
        ("has_index_with_age", "has_index AND has_index_with_age"),
        ("min_visits", "has_index AND has_index_with_age AND n_valid >= 2"),
    ]
)
ORACLE["cohort_attrition"] = _with(EVT, FLAGS, f"k AS (SELECT {_cols} FROM pat)") + _union
_cols, _union = _steps(
    [
        ("initial", "true"),
        ("one_age", "one_age"),
        ("has_index", "one_age AND has_index"),
        ("any_age", "one_age AND has_index AND any_age"),
    ]
)
ORACLE["single_age_attrition"] = _with(
    EVT,
    """sv AS (SELECT p_id, visit_idx, count(*) FILTER (code ~ '^90[0-9][0-9]$') AS n_age, bool_or(code = '401') AS ix FROM evt GROUP BY 1, 2)""",
    """sp AS (SELECT p_id, bool_or(n_age = 1) AS one_age, bool_or(ix) AS has_index, bool_or(n_age > 0) AS any_age FROM sv GROUP BY 1)""",
    f"k AS (SELECT {_cols} FROM sp)",
) + _union
_SUMMARY = "summ AS (SELECT p_id, " + ", ".join(
    f"max(CASE WHEN code = '{c}' THEN 1 ELSE 0 END) AS \"{c}\"" for c in views.PURCHASE_CODES
) + """, min(age) AS age, min(CASE WHEN code = 'PROMO' THEN age END) AS age_dm,
  CASE WHEN bool_or(code = 'PROMO') THEN 'DM' ELSE 'No DM' END AS diabetes FROM rec GROUP BY p_id)"""
ORACLE["first_index_age"] = _with(REC) + "SELECT p_id, min(age) AS age_dm FROM rec WHERE code = 'PROMO' GROUP BY p_id"
ORACLE["patient_summary"] = _with(REC, _SUMMARY) + "SELECT * FROM summ"
ORACLE["patient_summary_by_sex"] = _with(
    REC,
    "rs AS (SELECT *, CASE WHEN visit_idx % 2 = 0 THEN 'M' ELSE 'F' END AS sex FROM rec)",
    _SUMMARY.replace("SELECT p_id,", "SELECT p_id, sex,").replace("FROM rec GROUP BY p_id", "FROM rs GROUP BY p_id, sex"),
) + "SELECT * FROM summ"

# ---- table one

_BAND = """CASE WHEN age_dm < 18 THEN '0-18' WHEN age_dm < 45 THEN '18-44' WHEN age_dm < 65 THEN '45-64' WHEN age_dm >= 65 THEN '60>' END"""
_PATIENTS = f"""pt AS (SELECT customer.*, summ.*, {_BAND} AS age_dm_cat, {_BAND.replace('age_dm', 'age')} AS age_cat FROM customer JOIN summ ON p_id = c_custkey)"""


def _melt(columns, as_type: str, value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, diabetes AS grp, CAST(\"{c}\" AS {as_type}) AS {value} FROM pt" for c in columns
    )


_T = _with(
    REC,
    _SUMMARY,
    _PATIENTS,
    "sizes AS (SELECT diabetes AS grp, count(*) AS n FROM pt GROUP BY 1)",
    f"num AS (SELECT variable, grp, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM ({_melt(Q.TABLE_NUMERIC, 'DOUBLE', 'v')}) GROUP BY 1, 2)",
    f"lev AS ({_melt(Q.TABLE_CATEGORICAL, 'VARCHAR', 'level')})",
    """catg AS (SELECT variable, level, lev.grp, count(*) AS n, round(count(*) * CAST(100 AS DOUBLE) / max(sizes.n), 6) AS pct
      FROM lev JOIN sizes ON sizes.grp = lev.grp WHERE level IS NOT NULL GROUP BY 1, 2, 3)""",
    """tall AS (SELECT 'N' AS variable, NULL AS level, grp, n, NULL AS pct, NULL AS mean, NULL AS std FROM sizes
      UNION ALL SELECT variable, NULL, grp, n, NULL, mean, std FROM num
      UNION ALL SELECT variable, level, grp, n, pct, NULL, NULL FROM catg)""",
    """allsize AS (SELECT count(*) AS n FROM pt)""",
    f"""whole AS (SELECT 'N' AS variable, CAST(NULL AS VARCHAR) AS level, n, CAST(NULL AS DOUBLE) AS pct, CAST(NULL AS DOUBLE) AS mean FROM allsize
      UNION ALL SELECT variable, NULL, count(v), NULL, round(avg(v), 6) FROM ({_melt(Q.TABLE_NUMERIC, 'DOUBLE', 'v')}) GROUP BY 1
      UNION ALL SELECT variable, level, count(*), round(count(*) * CAST(100 AS DOUBLE) / (SELECT n FROM allsize), 6), NULL
        FROM lev WHERE level IS NOT NULL GROUP BY 1, 2)""",
)
ORACLE["tableone_header"] = _T + "SELECT grp, n FROM sizes"
ORACLE["tableone_numeric"] = _T + "SELECT variable, grp, n, mean, std FROM num"
ORACLE["tableone_categorical"] = _T + "SELECT variable, level, grp, n, pct FROM catg"
ORACLE["tableone_full"] = _T + "SELECT * FROM tall"
ORACLE["tableone_merge"] = _T + """
SELECT w.variable, w.level, g.grp, w.n AS n_all, w.pct AS pct_all, w.mean AS mean_all, g.n, g.pct, g.mean
FROM whole w LEFT JOIN tall g ON g.variable = w.variable AND g.level IS NOT DISTINCT FROM w.level"""

_CELL = """max(CASE WHEN grp = '{g}' THEN {text} END) AS {name}"""


def _cells(text: str) -> str:
    return ", ".join(_CELL.format(g=g, text=text, name=n) for g, n in (("DM", "dm"), ("No DM", "no_dm")))


_NP = "printf('%d (%.2f%%)', n, round_even(pct, 2))"
_MS = """coalesce(CAST(round_even(mean, 2) AS VARCHAR), 'nan') || ' (' || coalesce(CAST(round_even(std, 2) AS VARCHAR), 'nan') || ')'"""
ORACLE["tableone_display"] = _T + f"""
SELECT 'N' AS row, {_cells('CAST(n AS VARCHAR)')} FROM sizes
UNION ALL SELECT variable, {_cells(_MS)} FROM num GROUP BY variable
UNION ALL SELECT CASE WHEN one THEN variable ELSE level END, {_cells(_NP)}
  FROM catg JOIN (SELECT variable, count(DISTINCT level) = 1 AS one FROM catg GROUP BY 1) USING (variable) GROUP BY variable, level, one
UNION ALL SELECT variable, NULL, NULL FROM catg GROUP BY variable HAVING count(DISTINCT level) > 1"""

# ---- features

ORACLE["one_hot"] = "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"seg_{s}\"" for s in Q.SEGMENTS
) + " FROM customer"
ORACLE["feature_fill"] = _with(REC, _SUMMARY) + "SELECT p_id, age, coalesce(age_dm, 0) AS age_dm FROM summ"
ORACLE["feature_clean"] = "SELECT c_custkey, round(c_acctbal / c_nationkey, 6) AS ratio FROM customer WHERE c_nationkey > 1"
ORACLE["scale_minmax"] = """
SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) /
  ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)), 6) AS c_acctbal,
  CAST(0 AS DOUBLE) AS constant FROM customer"""
ORACLE["scale_standard"] = """
SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) /
  (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal, CAST(0 AS DOUBLE) AS constant FROM customer"""
_BUCKET = "CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 100"
ORACLE["hash_sample"] = f"SELECT c_custkey FROM customer WHERE {_BUCKET} < 10"
ORACLE["hash_split"] = f"SELECT c_custkey, CASE WHEN {_BUCKET} < 80 THEN 'train' ELSE 'test' END AS fold FROM customer"
ORACLE["assemble"] = "SELECT c_custkey, 2 AS n_features, c_acctbal AS last FROM customer"
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORACLE["correlation_pairs"] = " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS corr FROM lineitem"
    for i, x in enumerate(_NUM)
    for y in _NUM[i + 1 :]
)
ORACLE["cluster_sizes"] = "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1"
ORACLE["cluster_overview"] = "SELECT count(DISTINCT label) AS n_clusters, min(label) AS min_cluster FROM embeddings"
_PROFILE = _with(
    """e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""",
    """p AS (SELECT label AS cluster, count(*) AS size, 'v' || CAST(i AS VARCHAR) AS col, count(*) FILTER (v > 0) AS n FROM e GROUP BY label, i)""",
)
ORACLE["cluster_profile_count"] = _PROFILE + "SELECT cluster, size, col, n FROM p"
ORACLE["cluster_profile_percent"] = _PROFILE + "SELECT cluster, col, round(n * CAST(100 AS DOUBLE) / size, 6) AS pct FROM p"

# ---- cluster validity on given labels

_KS = "ks AS (SELECT unnest(generate_series(2, 9)) AS k)"
_PTS = "pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, label FROM embeddings)"
_MODELS = """lab AS (SELECT id, f, CAST(k AS INT) AS k, CAST(label % k AS INT) AS cluster FROM pts, ks)"""
# Scores of any (id, f, k, cluster) table called lab.
_SCORES = """lng AS (SELECT id, k, cluster, unnest(f) AS v, generate_subscripts(f, 1) AS i FROM lab),
mu AS (SELECT k, cluster, i, avg(v) AS m, count(*) AS n FROM lng GROUP BY 1, 2, 3),
d AS (SELECT lng.k, lng.cluster, id, sum((v - m) * (v - m)) AS d2 FROM lng JOIN mu USING (k, cluster, i) GROUP BY 1, 2, 3),
st AS (SELECT k, cluster, count(*) AS n, sum(d2) AS ss, avg(sqrt(d2)) AS dev FROM d GROUP BY 1, 2),
tot AS (SELECT k, count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n, sum(ss) AS inertia FROM st GROUP BY 1),
cc AS (SELECT x.k, x.cluster AS a, y.cluster AS b, sqrt(sum((x.m - y.m) * (x.m - y.m))) AS dist
  FROM mu x JOIN mu y ON x.k = y.k AND x.i = y.i AND x.cluster <> y.cluster GROUP BY 1, 2, 3),
db AS (SELECT k, avg(r) AS davies_bouldin FROM (SELECT cc.k, cc.a, max((p.dev + q.dev) / dist) AS r FROM cc
  JOIN st p ON p.k = cc.k AND p.cluster = cc.a JOIN st q ON q.k = cc.k AND q.cluster = cc.b GROUP BY 1, 2) GROUP BY k),
gm AS (SELECT k, i, avg(v) AS g FROM lng GROUP BY 1, 2),
bt AS (SELECT mu.k, sum(mu.n * (m - g) * (m - g)) AS between_ FROM mu JOIN gm ON gm.k = mu.k AND gm.i = mu.i GROUP BY 1),
ch AS (SELECT k, (between_ / (n_clusters - 1)) / (inertia / (n - n_clusters)) AS calinski_harabasz FROM bt JOIN tot USING (k)),
far AS (SELECT x.k, x.id, x.cluster AS own, y.cluster AS other, {dist} AS s, count(*) AS n
  FROM lab x JOIN lab y ON x.k = y.k GROUP BY 1, 2, 3, 4),
ab AS (SELECT k, id, max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b,
  max(CASE WHEN own = other THEN n END) AS own_n FROM far GROUP BY 1, 2),
sil AS (SELECT k, id, CASE WHEN own_n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab),
sc AS (SELECT k, davies_bouldin, calinski_harabasz, silhouette FROM db JOIN ch USING (k)
  JOIN (SELECT k, avg(s) AS silhouette FROM sil GROUP BY 1) USING (k))"""
_EUCLID = _SCORES.format(dist="sum(list_distance(x.f, y.f))")
_SQUARE = _SCORES.format(dist="sum(list_distance(x.f, y.f) * list_distance(x.f, y.f))")
_ALL = _with(_KS, _PTS, _MODELS, _EUCLID)
_ONE = "lab AS (SELECT id, f, 10 AS k, label AS cluster FROM pts)"
_RANKS = """rk AS (SELECT *, rank() OVER (ORDER BY davies_bouldin) AS davies_bouldin_rank,
  rank() OVER (ORDER BY calinski_harabasz DESC) AS calinski_harabasz_rank, rank() OVER (ORDER BY silhouette DESC) AS silhouette_rank FROM sc)"""
ORACLE["inertia"] = _ALL + "SELECT k, n_clusters, n, round(inertia, 6) AS inertia FROM tot"
ORACLE["aic_bic"] = _ALL + """
SELECT k, round(inertia, 6) AS inertia, round(2 * n_clusters * 64 + inertia, 6) AS aic,
  round(ln(n) * n_clusters * 64 + inertia, 6) AS bic FROM tot"""
ORACLE["davies_bouldin"] = _ALL + "SELECT k, round(davies_bouldin, 6) AS davies_bouldin FROM db"
ORACLE["calinski_harabasz"] = _ALL + "SELECT k, round(calinski_harabasz, 6) AS calinski_harabasz FROM ch"
ORACLE["silhouette_samples"] = _with(_PTS, _ONE, _EUCLID) + "SELECT id, round(s, 6) AS s FROM sil"
ORACLE["silhouette_exact"] = _ALL + "SELECT k, round(silhouette, 6) AS silhouette FROM sc"
ORACLE["silhouette_sq"] = _with(_PTS, _ONE, _SQUARE) + "SELECT k, round(silhouette, 6) AS silhouette FROM sc"
ORACLE["drop_noise"] = _with(_PTS, "lab AS (SELECT id, f, 9 AS k, label AS cluster FROM pts WHERE label <> 0)", _SQUARE) + """
SELECT k, round(davies_bouldin, 6) AS davies_bouldin, round(calinski_harabasz, 6) AS calinski_harabasz,
  round(silhouette, 6) AS silhouette FROM sc"""
ORACLE["rank_scores"] = _with(_KS, _PTS, _MODELS, _SQUARE, _RANKS) + """
SELECT k, round(davies_bouldin, 6) AS davies_bouldin, round(calinski_harabasz, 6) AS calinski_harabasz,
  round(silhouette, 6) AS silhouette, CAST(davies_bouldin_rank AS INT) AS davies_bouldin_rank,
  CAST(calinski_harabasz_rank AS INT) AS calinski_harabasz_rank, CAST(silhouette_rank AS INT) AS silhouette_rank FROM rk"""
ORACLE["best_k_union"] = _with(_KS, _PTS, _MODELS, _SQUARE, _RANKS) + """
SELECT k FROM rk WHERE davies_bouldin_rank <= 3 OR calinski_harabasz_rank <= 3 OR silhouette_rank <= 3"""

# ---- density clusters: neighbours of all points, closure over core points

_DBSCAN = """nb AS (SELECT a.id, b.id AS bid FROM {pts} a JOIN {pts} b ON a.blk = b.blk AND {d2} <= {eps} * {eps}),
core AS (SELECT nb.id FROM nb JOIN {pts} p ON p.id = bid GROUP BY nb.id HAVING sum(p.w) >= {least}),
ce AS (SELECT nb.id, bid FROM nb WHERE nb.id IN (SELECT id FROM core) AND bid IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT ce.bid, reach.root FROM reach JOIN ce ON ce.id = reach.id),
comp AS (SELECT id, min(root) AS label FROM reach GROUP BY id),
border AS (SELECT nb.id, min(label) AS label FROM nb JOIN comp ON comp.id = nb.bid
    WHERE nb.id NOT IN (SELECT id FROM core) GROUP BY nb.id),
found AS (SELECT * FROM comp UNION ALL SELECT * FROM border)"""
_PLANE_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
ORACLE["dbscan_plane"] = "WITH RECURSIVE " + ",\n".join(
    [
        """pl AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  CAST(embedding[3] > 0 AS INT) * 2 + CAST(embedding[4] > 0 AS INT) AS blk, 1 AS w FROM embeddings)""",
        _DBSCAN.format(pts="pl", d2=_PLANE_D2, eps="CAST(0.04 AS DOUBLE)", least=4),
    ]
) + "\nSELECT pl.id, coalesce(label, -1) AS cluster FROM pl LEFT JOIN found ON found.id = pl.id"
ORACLE["dbscan"] = "WITH RECURSIVE " + ",\n".join(
    [
        "o AS (SELECT o_orderkey AS id, year(o_orderdate) AS a, month(o_orderdate) AS m, o_orderstatus AS blk FROM orders)",
        """sc AS (SELECT id, blk, (a - (SELECT avg(a) FROM o)) / (SELECT stddev_pop(a) FROM o) AS x,
  (m - (SELECT min(m) FROM o)) / CAST((SELECT max(m) - min(m) FROM o) AS DOUBLE) AS y FROM o)""",
        "pl AS (SELECT blk, x, y, min(id) AS id, count(*) AS w FROM sc GROUP BY blk, x, y)",
        _DBSCAN.format(pts="pl", d2=_PLANE_D2, eps="CAST(0.1 AS DOUBLE)", least=7),
    ]
) + """
SELECT sc.id, coalesce(label, -1) AS cluster FROM sc JOIN pl USING (blk, x, y) LEFT JOIN found ON found.id = pl.id"""
ORACLE["dbscan_vectors"] = "WITH RECURSIVE " + ",\n".join(
    [
        "pl AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, label AS blk, 1 AS w FROM embeddings)",
        _DBSCAN.format(pts="pl", d2="list_distance(a.f, b.f) * list_distance(a.f, b.f)", eps="CAST(1.22 AS DOUBLE)", least=4),
    ]
) + "\nSELECT pl.id, coalesce(label, -1) AS cluster FROM pl LEFT JOIN found ON found.id = pl.id"

# ---- facts that hold for models that SQL cannot fit

ORACLE["cluster_facts"] = " UNION ALL ".join(
    f"""SELECT '{m}' AS method, count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, 8::BIGINT AS n_clusters, 0 AS lowest, 7 AS highest
FROM embeddings"""
    for m in ("kmeans", "bisecting", "ward", "pca_kmeans", "birch", "ward_rows")
)
ORACLE["sweep_facts"] = """
SELECT CAST(k AS INT) AS k, (SELECT count(*) FROM embeddings) AS n, k AS n_clusters, true AS cost_agrees, true AS falls
FROM (SELECT unnest(generate_series(2, 9)) AS k)"""
ORACLE["stored_models"] = """
SELECT count(*) AS n_rows, count(*) AS n_equal FROM embeddings WHERE vec_id % 2 = 1"""
ORACLE["final_sort_file"] = _with(REC) + """
SELECT p_id, visit_idx, age, row_number() OVER (ORDER BY p_id, age, visit_idx) AS position
FROM (SELECT DISTINCT p_id, visit_idx, age FROM rec)"""
ORACLE["strict_codes"] = """
SELECT c_custkey, TRY_CAST(raw AS BIGINT) AS code, CASE WHEN rejected THEN raw END AS raw, count(*) OVER (PARTITION BY rejected) AS n_kind
FROM (SELECT *, raw IS NOT NULL AND TRY_CAST(raw AS BIGINT) IS NULL AS rejected
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS raw
    FROM customer))"""
ORACLE["bools_to_int"] = """
SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS "is_F", CAST(o_orderstatus = 'O' AS INT) AS "is_O", o_orderstatus FROM orders"""
ORACLE["pca_facts"] = "SELECT count(*) AS n_rows, true AS centred, true AS uncorrelated, true AS ordered FROM embeddings"
ORACLE["choice_facts"] = """SELECT *, true AS is_best FROM (VALUES ('silhouette', 5::BIGINT, 1::BIGINT), ('aic', 7, 1), ('bic', 7, 1), ('gap', 4, 1))
  AS t(criterion, n_k, n_chosen)"""
ORACLE["silhouette_bounds"] = """
SELECT CAST(k AS INT) AS k, true AS within, true AS bounded FROM (SELECT unnest(generate_series(2, 9)) AS k)"""
