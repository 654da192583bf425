"""Screens, registers and ratio inputs on small tables with odd rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tesserae.operators import inputs, registers, screener
from tesserae.operators.screener import Criteria

COLUMNS = "code long, name string, kind string, sector string, market string, cap double, close double, traded double, change_pct double, revenue_yoy double, op_yoy double, revenue_qoq double, op_qoq double, op_status string, net_status string, momentum double, per double, pbr double, roe double, dividend double, ev_ebitda double, coverage long, buys long, growth double, value double, trend double, topdown double, overall double"


def company(code, **given):
    row = {"code": code, "name": f"n{code}", "kind": "stock", "sector": "s", "market": "A", "cap": 100.0, "close": 1.0, "coverage": 0, "buys": 0}
    row |= given
    return tuple(row.get(c.split()[0]) for c in COLUMNS.split(", "))


@pytest.fixture(scope="module")
def companies(spark):
    rows = [
        company(1, growth=50.0, overall=40.0, per=10.0, revenue_yoy=0.5, traded=5.0), company(2, growth=70.0, overall=None, per=-1.0, revenue_yoy=None, traded=None, coverage=2, buys=1),
        company(3, growth=None, overall=60.0, per=30.0, op_status="turnaround", traded=0.0), company(4, growth=50.0, cap=None), company(5, growth=90.0, close=None), company(6, growth=80.0, kind="etf"),
        company(7, name="삼성전자우", growth=10.0), company(8, name="삼성전자우B", growth=10.0), company(9, growth=50.0, op_yoy=0.1, net_status="profit", momentum=5.0, traded=50.0, market="B", sector="t", pbr=1.0),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def test_screen(companies):
    def codes(criteria, strategy="growth", sort=None):
        rows = screener.screen(companies, criteria, strategy, sort).orderBy("place").collect()
        assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and {r.total for r in rows} <= {len(rows)}
        return [r.code for r in rows]

    assert codes(Criteria()) == [2, 1, 9, 3]  # without a score last, ties by code
    assert codes(Criteria(funds=True)) == [6, 2, 1, 9, 7, 8, 3]
    assert codes(Criteria(), "overall") == [3, 1]
    assert codes(Criteria(liquidity_min=10)) == [2, 9, 3]  # missing and zero liquidity pass
    assert codes(Criteria(revenue_yoy_min=0.1)) == [1]
    assert codes(Criteria(op_growth="turnaround")) == [3] and codes(Criteria(op_growth="growth")) == [9]
    assert codes(Criteria(net_status="profit", market="B", sector="t", momentum_min=0, momentum_max=10, cap_min=1, cap_max=1e3)) == [9]
    assert codes(Criteria(coverage="has", recent_buy=True)) == [2] and codes(Criteria(coverage="none")) == [1, 9, 3]
    assert codes(Criteria(per_max=20), "value") == [1] and codes(Criteria(), "value") == [1, 2, 3, 9]
    assert codes(Criteria(per_max=20)) == [2, 1, 9, 3]  # multiples bound the value strategy alone
    assert codes(Criteria(), sort="trading_value") == [9, 1, 2, 3]
    got = screener.page(screener.screen(companies, Criteria(), "growth"), 1, 2).orderBy("place").collect()
    assert [(r.code, r.total) for r in got] == [(1, 4), (9, 4)]
    assert screener.asked(Criteria(per_max=3, funds=True)) == {"per_max": 3, "funds": True}
    assert screener.screen(companies.limit(0), Criteria(), "trend").collect() == []


def test_rates_filings_and_segments(spark):
    day = dt.date(2024, 1, 1)
    rates = spark.createDataFrame([("a", day, 3.0), ("a", day + dt.timedelta(1), None), ("b", day, 1.0), ("b", day + dt.timedelta(2), 2.0)], "key string, day date, percent double")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    assert sorted((r.key, r.rate) for r in registers.latest_rates(rates, asked, {"c": 0.5}).collect()) == [("a", 0.03), ("b", 0.02), ("c", 0.5), ("d", None)]
    stored = spark.createDataFrame([(1, "x")], "k int, v string")
    found = spark.createDataFrame([(1, "y"), (2, "b"), (2, "a"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, registers.insert_new(stored, found, "k", [F.asc("v")]).collect())) == [(2, "a"), (3, "c")]
    many = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 7)], "c int, n int")
    assert sorted(map(tuple, registers.newest_of(many, "c", [F.desc("n")], 3).select("c", "n", "number").collect())) == [(1, 497, 3), (1, 498, 2), (1, 499, 1), (2, 7, 1)]
    old = spark.createDataFrame([(1, 2020, "a", 10.0), (1, 2020, "b", 30.0), (2, 2020, "a", 0.0)], "code int, year int, segment string, revenue double")
    new = spark.createDataFrame([(1, 2020, "a", 5.0, 1), (1, 2020, "a", 10.0, 2)], "code int, year int, segment string, revenue double, at long")
    got = {(r.code, r.segment): (r.revenue, r.ratio_pct) for r in registers.segment_sales(old, new, ["code", "year", "segment"], "at").collect()}
    assert got == {(1, "a"): (10.0, 25.0), (1, "b"): (30.0, 75.0), (2, "a"): (0.0, None)}


def test_review_states(spark):
    resolved = spark.createDataFrame([(1, 10, "id"), (2, None, "new"), (3, None, "new"), (4, None, "new"), (5, None, "new")], "m_id int, found int, how string")
    no, up = spark.createDataFrame([(1,), (3,), (3,), (4,)], "m_id int"), spark.createDataFrame([(4, 40), (5, 50), (1, 99)], "m_id int, found int")
    got = sorted(map(tuple, registers.review_states(resolved, no, up).collect()))
    assert got == [(1, 10, "id", "canonical"), (2, None, "new", "pending"), (3, None, "new", "rejected"), (4, 40, "review", "canonical"), (5, 50, "review", "canonical")]


def test_filters_and_absent_keys(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 2), (3.0, 4)], "a double, b int")
    got = sorted(map(tuple, registers.filter_catalog(df, {"a": ("A", "gte,lte"), "b": ("B", "lt")}).collect()))
    assert got == [("a", "A", 1.0, 3.0, 0, 2, "gte"), ("a", "A", 1.0, 3.0, 0, 2, "lte"), ("b", "B", 2.0, 4.0, 1, 2, "lt")]
    j = spark.createDataFrame([('{"k": null}',), ('{"x": {"k": 1}}',), ("[1]",), (None,), ("",)], "j string")
    assert [r.a for r in j.select(registers.without_key(F.col("j"), "k").alias("a")).collect()] == [False, True, True, True, True]


def test_ratio_inputs(spark):
    facts = [(1, n, "rev", "flow", float(n)) for n in (8000, 8001, 8002, 8003, 8005)] + [(1, n, "eq", "stock", 10.0 * n) for n in (8000, 8004, 8005)] + [(1, 8000, "eq", "stock", 1.0), (2, 8003, "rev", "flow", None), (1, 8003, "one", "flow", 5.0)]
    got = {(r.code, r.n): r["values"] for r in inputs.namespace(spark.createDataFrame(facts, "code int, n int, account string, kind string, amount double")).collect()}
    assert got[(1, 8003)] == {"rev": 8000.0 + 8001 + 8002 + 8003} and got[(2, 8003)] == {}
    assert got[(1, 8004)] == {"eq": 80040.0, "eq:closing": 80040.0, "eq:opening": 80000.0}
    assert got[(1, 8005)] == {"eq": 80050.0, "eq:closing": 80050.0} and got[(1, 8000)] == {"eq": 80000.0, "eq:closing": 80000.0}
