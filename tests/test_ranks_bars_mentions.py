"""Ranks over ranges, stored bars and mentions of names, against plain Python."""

import datetime as dt
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.functions.columns import series
from tesserae.operators import mentions, ranks
from tesserae.sources import barstore, views

SF = "/root/testdata/sf0.001"


def test_numbers_follow_the_order(spark):
    rows = [(i % 7, "x" if i % 3 else "y", i) for i in range(500)] + [(3, "x", -1)] * 300 + [(None, "z", 0)] * 5
    df = spark.createDataFrame(rows, "number int, at string, tie int")
    got = ranks.numbered(df, [F.desc_nulls_last("number"), F.asc("at")], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, len(rows) + 1))
    keys = [(r.number is None, -(r.number or 0), r["at"]) for r in got]
    assert keys == sorted(keys) and Counter((r.number, r["at"], r.tie) for r in got) == Counter(rows)
    assert ranks.numbered(df.limit(0), [F.asc("number")]).collect() == []


def test_standings_of_hot_values_and_groups(spark):
    values = [1.0] * 400 + [float(i % 37) for i in range(150)] + [math.nan, None, None, -0.0, 0.0]
    rows = [(i, v, None if i % 4 == 0 else f"g{i % 3}", None if v is None or math.isnan(v) else -v) for i, v in enumerate(values)] + [(999, 5.0, "alone", None)]
    df = spark.createDataFrame(rows, "id int, v double, g string, _0_g0 double")
    got = {r.id: r for r in ranks.percentile_ranks(df, {"up": ("v", False), "down": ("v", True), "other": ("_0_g0", False)}, ["g"]).collect()}
    key = lambda x: (math.isnan(x), 0.0 if math.isnan(x) else x)
    for i, v, g, other in rows:
        for name, x, sign, column in (("up", v, 1, 1), ("down", v, -1, 1), ("other", other, 1, 3)):
            group = [key(r[column]) for r in rows if r[2] == g and r[column] is not None]
            below = 0.0 if x is None else sum((k < key(x)) if sign > 0 else (k > key(x)) for k in group)
            want = 0.0 if x is None else 0.5 if len(group) <= 1 else below / (len(group) - 1)
            assert got[i][name] == pytest.approx(want), (i, name)
    rated = {r.id: r.rating for r in ranks.rating(df, "v").collect()}
    there = [key(r[1]) for r in rows if r[1] is not None]
    for i, v, _, _ in rows:
        assert rated[i] == (None if v is None else round(sum(k < key(v) for k in there) / (len(there) - 1) * 98) + 1)
    assert [r.rating for r in ranks.rating(df.where("id = 999"), "v").collect()] == [None]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_read_stored_bars_without_an_exchange(spark):
    bars = views.bars(spark, SF)
    w = bars.select("code", "bar_date", F.avg("close").over(series().rowsBetween(-19, 0)).alias("ma"))
    assert "Exchange" not in plan_of(w) and w.count() == views.derived_bars(spark, SF).count()
    assert views.bars(spark, SF).inputFiles() == bars.inputFiles()  # written once
    assert sorted(map(tuple, bars.collect())) == sorted(map(tuple, views.derived_bars(spark, SF).select(*bars.columns).collect()))


def test_last_days_open_their_partitions_only(spark):
    bars = views.minute_bars(spark, SF)
    newest = barstore.latest(bars, "minute", "bar_ts")
    held = barstore.last_days(bars, "minute", "bar_ts", 3, newest)
    all_of = bars.collect()
    assert newest == max(r.bar_ts for r in all_of)
    assert sorted((r.code, r.bar_ts) for r in held.collect()) == sorted((r.code, r.bar_ts) for r in all_of if r.bar_ts >= newest - dt.timedelta(days=3))
    plan = plan_of(held)
    assert "PartitionFilters: [isnotnull(day" in plan
    touched = {r[0] for r in held.select(F.input_file_name()).distinct().collect()}
    assert touched and len({re.search(r"day=([\d-]+)", f)[1] for f in touched}) <= 4 < len({re.search(r"day=([\d-]+)", f)[1] for f in bars.inputFiles()})


def plain_mention(text, name, others):
    for o in sorted(others, key=lambda o: (-len(o), o)):
        text = text.replace(o, " ")
    b = "가-힣A-Za-z0-9"
    return re.search(rf"(?<![{b}]){re.escape(name)}(?![{b}])", text) is not None


NAMES = ["SK", "SK하이닉스", "SK증권", "SK텔레콤", "SK가스", "삼성전자", "삼성전자우", "KODEX 삼성전자", "A.B (C)", "North Sea", "North Sea Oil", "Sea", "LG", "LG화학", "LG전자", "x", "[a-z]$"]
TEXTS = [
    "SK와 SK하이닉스", "SK하이닉스 SK 증권", "삼성전자가 삼성전자 를", "North Sea Oil and North Sea, Sea", "North Sea Oil", "A.B (C)!", "AxB (C)", "LG LG화학", "LG화학 LG전자", "LG화학LG", "x", "xx", None, "", "Seaside", "the [a-z]$ b", "KODEX 삼성전자우",
]


@pytest.mark.parametrize("limit", [mentions.LIMIT, 20])
def test_mentions_are_what_the_rule_says(spark, limit):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)] + [(100, "Sea"), (101, None), (102, " ")], "code int, name string")
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])], "t_id int, text string")
    got = {(r.t_id, r.code) for r in mentions.mentions(texts, names, limit=limit).collect()}
    want = set()
    for code, name in enumerate(NAMES):
        others = [o for o in NAMES if name in o and o != name and not re.match(rf"^{re.escape(name)}우[A-C]?$", o) and not re.search(mentions.PRODUCTS, o)]
        if len(others) < 4:
            want |= {(i, code) for i, t in enumerate(TEXTS) if t and plain_mention(t, name, others)}
    want |= {(i, 100) for i, c in want if NAMES[c] == "Sea"}
    assert got == want and (0, 0) not in got
    assert mentions.mentions(texts, names.limit(0)).collect() == []
