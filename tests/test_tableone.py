import pytest

from kohorta.operators import tableone


@pytest.fixture
def people(table):
    rows = [
        ("a", "F", 1, 50.0, "DM"),
        ("b", "M", 1, 60.0, "DM"),
        ("c", "F", 1, 40.0, "No DM"),
        ("d", None, 1, None, "No DM"),
        ("e", "F", 1, 30.0, "No DM"),
    ]
    return table(rows, "p_id STRING, sex STRING, flag INT, age DOUBLE, diabetes STRING")


def test_tidy(people, rows):
    tidy = tableone.table_one(people, ["sex", "flag"], ["age"], "diabetes")
    got = {(r["variable"], r["level"], r["grp"]): r for r in tidy.collect()}
    assert got[("N", None, "No DM")]["n"] == 3
    assert got[("age", None, "DM")]["mean"] == 55 and round(got[("age", None, "DM")]["std"], 4) == 7.0711
    assert got[("age", None, "No DM")]["n"] == 2
    # The null row counts in the denominator and is no level of its own.
    assert got[("sex", "F", "No DM")]["n"] == 2
    assert round(got[("sex", "F", "No DM")]["pct"], 4) == 66.6667
    assert ("sex", "M", "No DM") not in got and ("sex", None, "No DM") not in got
    assert all(r["pct"] is None or r["pct"] <= 100 for r in got.values())


def test_display(people):
    tidy = tableone.table_one(people, ["sex", "flag"], ["age"], "diabetes")
    shown = [tuple(r) for r in tableone.display(tidy, ["DM", "No DM"], ["age", "sex", "flag"]).collect()]
    assert shown == [
        ("N", "2", "3"),
        ("age", "55.0 (7.07)", "35.0 (7.07)"),
        ("sex", None, None),
        ("F", "1 (50.00%)", "2 (66.67%)"),
        ("M", "1 (50.00%)", None),
        ("flag", "2 (100.00%)", "3 (100.00%)"),
    ]


def test_merge_keeps_levels_apart(table):
    people = table(
        [("a", "1", "1", 3.0, "x"), ("b", "1", "0", 5.0, "y")], "p_id STRING, u STRING, v STRING, n DOUBLE, g STRING"
    )
    merged = tableone.merged(people, ["u", "v"], ["n"], "g").collect()
    got = sorted((r["variable"], r["level"] or "", r["grp"], r["n_all"], r["n"]) for r in merged)
    assert got == [
        ("N", "", "x", 2, 1),
        ("N", "", "y", 2, 1),
        ("n", "", "x", 2, 1),
        ("n", "", "y", 2, 1),
        ("u", "1", "x", 2, 1),
        ("u", "1", "y", 2, 1),
        ("v", "0", "y", 1, 1),
        ("v", "1", "x", 1, 1),
    ]


def test_global(people):
    assert tuple(tableone.header(people).first()) == ("Global", 5)
