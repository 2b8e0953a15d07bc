import pytest

from quire.operators import units

FACTS = "fact_id long, entity string, metric string, period string, key string, value string, unit string, section string, quantity string"
METRICS = [("Revenue", "money", "ETB"), ("Output", "mass", "t"), ("Heat", "temperature", "°C"), ("Sales", "energy", "MWh"), ("Share", "share", "%")]


def common(spark, facts):
    f = spark.createDataFrame([(i, "E", m, "2020", k, v, u, s, "clash") for i, (m, k, v, u, s) in enumerate(facts, 1)], FACTS)
    return units.to_common_units(f, spark.createDataFrame(METRICS, "metric string, quantity string, common_unit string"))


CASES = [
    (("Revenue", "Revenue", "11.8 million", "ETB", None), 11.8e6),
    (("Revenue", "Revenue", "ETB 9,029,000", "", None), 9029000),
    (("Revenue", "Revenue (ETB bn)", "2.5", None, None), 2.5e9),
    (("Revenue", "Revenue", "1 000 000 santim", "", None), 10000),
    (("Revenue", "Revenue", "9906000", "ETB '000", None), 9906000e3),
    (("Revenue", "Revenue", "-3.5 ETB mn;", "", None), -3.5e6),
    (("Output", "Output (Group) restated", "526.5 T", "t", None), 526.5),
    (("Output", "Output", "12", None, "Notes (all figures in quintal)"), 1.2),
    (("Heat", "Heat", "212°F", "", None), 100.0),
    (("Heat", "Heat (K)", "273.15", "", None), 0.0),
    (("Sales", "Sales", "5 thousand kWh", "", None), 5.0),
    (("Share", "Share", "250 basis points", None, None), 2.5),
    (("Revenue", "Revenue", "see Note 4", "ETB", None), None),
    (("Revenue", "Revenue", None, "ETB", None), None),
    (("Revenue", "Revenue", "", "ETB", None), None),
    (("Revenue", None, "7", "km", None), None),
]


def test_amounts(spark):
    got = {r.fact_id: r.amount for r in common(spark, [c for c, _ in CASES]).collect()}
    assert len(got) == len(CASES)
    for i, (_, want) in enumerate(CASES, 1):
        assert got[i] == (None if want is None else pytest.approx(want)), CASES[i - 1]


def test_source_default_is_the_last_resort(spark):
    f = spark.createDataFrame([(1, "E", "Revenue", "2020", "Revenue", "5", None, None, "S"), (2, "E", "Revenue", "2020", "Revenue", "5", "birr", None, "S")], FACTS.replace("quantity", "source"))
    d = spark.createDataFrame([("S", "Revenue", "ETB mn")], "source string, metric string, unit string")
    got = {r.fact_id: (r.amount, r.found_in) for r in units.to_common_units(f, spark.createDataFrame(METRICS, "metric string, quantity string, common_unit string"), d).collect()}
    assert got == {1: (5e6, "source"), 2: (5.0, "unit")}


def test_pairs_need_different_units_and_close_amounts(spark, rows):
    c = common(
        spark,
        [("Revenue", "Revenue", "5 million birr", "", None), ("Revenue", "Revenue", "5000", "ETB '000", None), ("Revenue", "Revenue", "5004000", "ETB", None), ("Revenue", "Revenue", "5.000 ETB mn", "", None), ("Revenue", "Revenue", "5010000", "ETB", None), ("Sales", "S", "1 MWh", "", None), ("Sales", "S", "1 thousand kWh", "", None), ("Sales", "S", "0", "MWh", None), ("Sales", "S", "0", "GJ", None)],
    )
    # 5 million birr and 5 ETB mn are the same scale; 5,004,000 is within 0.1 %, 5,010,000 is not
    assert rows(units.same_amount_pairs(c)) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (8, 9)]


def test_repeated_and_empty(spark, rows):
    f = [("Revenue", "Revenue", "5 million birr", "", None)] * 2
    assert rows(units.same_amount_pairs(common(spark, f))) == []
    assert common(spark, []).count() == 0
    assert units.same_amount_pairs(common(spark, [])).count() == 0


def test_usual_units_of_a_source_are_defaults(spark):
    rows = [(1, "a", "Output", "5", "kg"), (2, "a", "Output", "6", "kg"), (3, "a", "Output", "7", "t"), (4, "a", "Output", "9", ""), (5, "b", "Output", "9", None), (6, None, "Output", "9", None), (7, "a", "Output", "2 thousand", None)]
    f = spark.createDataFrame([(i, "E", m, "2020", m, v, u, None, s) for i, s, m, v, u in rows], "fact_id long, entity string, metric string, period string, key string, value string, unit string, section string, source string")
    m = spark.createDataFrame(METRICS, "metric string, quantity string, common_unit string")
    found = units.to_common_units(f, m).select("fact_id", "metric", "unit_found").join(f.select("fact_id", "source"), "fact_id")
    usual = units.usual_units(found)
    assert [tuple(r) for r in usual.collect()] == [("a", "Output", "kg")]
    got = {r.fact_id: (r.found_in, r.amount) for r in units.to_common_units(f, m, usual).collect()}
    assert got[4] == ("source", pytest.approx(0.009)) and got[3] == ("unit", 7.0) and got[5] == got[6] == (None, None) and got[7] == ("source", pytest.approx(2.0))
