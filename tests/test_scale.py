"""What shows only in larger tables: rounded ties, and work that grows faster than its input."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from tesserae.functions.columns import decimal_round
from tesserae.operators import graphs, mentions, prices, registers, scores, sequences, shared, statements
from tesserae.plans import coverage as coverage_plans
from tesserae.plans import fiscal as fiscal_plans
from tesserae.sources import barstore, containers, grids, views

TIES = [32.55, 64.85, 32.45, 0.05, 12.35, -32.55, 0.0, 99.95, 100.0, 41.125, 7.25]


def test_rounded_ties_are_those_of_a_decimal(spark):
    got = [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(TIES)], "i int, x double").select("i", decimal_round(F.col("x"), 1).alias("y")).orderBy("i").collect()]
    cast = lambda x: duckdb.sql(f"SELECT CAST(round(CAST({x!r}::DOUBLE AS DECIMAL(38, 18)), 1) AS DOUBLE)").fetchall()[0][0]
    assert got == [cast(x) for x in TIES]
    assert got[:2] == [32.5, 64.8]


def test_scores_round_their_ties_so(spark):
    norms = [(0.0, 0.25), (0.0, 0.15), (0.5189999999999999, 0.15), (1.0, 0.10), (1.0, 0.05)]  # of a company of 1.2 million: 32.55
    one = spark.range(1).select(scores.score({str(i): (F.lit(x), w) for i, (x, w) in enumerate(norms)}).alias("s")).head()
    assert one.s == 32.5


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_filed_document_is_read_once_and_its_cells_are_not_dealt(spark):
    body = "<P>자본변동표</P><TABLE><TR><TH>과목</TH><TH>a</TH></TR><TR><TD>2020.01.01 (기초자본)</TD><TD>1</TD></TR><TR><TD>2020.12.31 (기말자본)</TD><TD>(2)</TD></TR></TABLE>"
    got = grids.equity_changes(spark.createDataFrame([(1, body)], "doc long, body string"))
    assert [(r.label, r.part, r.amount) for r in got.orderBy("step").collect()] == [("opening", "a", 1.0), ("closing", "a", -2.0)]
    plan = _plan(got).split("Initial Plan")[-1]
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") <= 1


def test_files_of_containers_are_handed_on_together(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for i in range(3):
            z.writestr(f"{i}.xml", "<P/>")
    got = containers.unpack(spark.createDataFrame([(1, held.getvalue()), (2, b"no zip"), (3, held.getvalue())], "doc long, content binary").coalesce(1), "doc")
    sizes = got.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert [r.n for r in sizes] == [6]


def test_bars_are_dealt_once(spark):
    lines = spark.createDataFrame([(1, 2, 3, 4, 5.0, 10.0, "1998-01-01 00:00:00")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate string")
    folder = shared.new_folder(spark, "lines")
    lines.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{folder}/lineitem.parquet")
    bars = views.derived_bars(spark, folder)
    assert _plan(bars).count("REPARTITION_BY_NUM") == _plan(bars).count("Exchange") == 1  # and write() adds none
    assert bars.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    barstore.write(bars, "dealt_once", "day", "bar_date", bars.rdd.getNumPartitions())
    stored = spark.table("dealt_once")
    assert "Exchange" not in _plan(stored.groupBy("code").agg(F.sum("volume"))) and stored.count() == 1


def test_names_that_are_no_part_of_others_are_settled_where_they_are_found(spark):
    texts = spark.createDataFrame([(1, "alpha beta, alphas"), (2, "alphas xalpha 9beta beta9 가beta"), (3, "beta gamma"), (4, None), (5, "beta alpha-beta")], "t_id long, text string")
    names = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "beta gamma"), (4, "alpha"), (5, "")], "code long, name string")
    got = mentions.mentions(texts, names)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (1, 4), (3, 3), (5, 1), (5, 2), (5, 4)]
    held = mentions._held(texts, [Row(name="alpha", free=True), Row(name="beta", free=False)])
    assert sorted((r.t_id, r.text is None, tuple(r.names)) for r in held.collect()) == [(1, False, ("beta",)), (1, True, ("alpha",)), (2, False, ("beta",)), (3, False, ("beta",)), (5, False, ("beta",)), (5, True, ("alpha",))]


def test_names_with_confusables_are_settled_in_the_row_too(spark):
    words = [Row(name="sea", free=False, others=["north sea oil", "north sea"]), Row(name="north sea", free=False, others=["north sea oil"]), Row(name="ado", free=False, others=["boado"]), Row(name="north sea oil", free=True, others=[])]
    rows = ["north sea oil", "north sea oil, sea", "north sea", "seaside sea", "boadoado", "boado", "xado", "north sea oils", None, "xnorth sea oilsea"]
    held = mentions._held(spark.createDataFrame(list(enumerate(rows)), "t_id int, text string"), words)
    assert {(r.t_id, r.text, tuple(r.names)) for r in held.collect()} == {(0, None, ("north sea oil",)), (1, None, ("north sea oil", "sea")), (2, None, ("north sea",)), (3, None, ("sea",)), (4, None, ("ado",)), (9, None, ("sea",))}


def test_pairs_of_texts_and_codes_are_not_dealt_and_names_are_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def name_of(x):
        made.add(1)
        return x

    raw = [(1, "alpha"), (2, "alpha"), (3, "beta"), (3, "alpha"), (4, "alpha beta"), (5, "no"), (None, "beta"), (1, "alpha")]
    names = spark.createDataFrame(raw, "code long, raw string").select("code", F.udf(name_of, "string")("raw").alias("name"))
    texts = spark.createDataFrame([(1, "alpha"), (1, "alpha"), (2, "beta, alpha"), (3, "alpha beta"), (4, "alphabet"), (None, "beta")], "t_id long, text string")
    want = {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, None), (3, 4), (None, 3), (None, None)}
    for most in (mentions.BROADCAST_NAMES, 2):
        monkeypatch.setattr(mentions, "BROADCAST_NAMES", most)
        made.value = 0
        got = mentions.mentions(texts, names)
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)
        assert made.value == len(raw)
        above = _plan(got).split("Initial Plan")[-1].split("BroadcastHashJoin")[0]
        assert "Exchange" not in above and "HashAggregate" not in above


def test_reports_of_an_industry_are_met_by_number_and_texts_are_read_once(spark):
    got = coverage_plans.industry_companies(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("ReadSchema: struct<doc_id:bigint,text:string>") == 1
    assert not [line for line in plan.splitlines() if "called" in line and ("Exchange hash" in line or "Join" in line)]  # no list of names is dealt or joined
    with duckdb.connect() as c:
        for t in ("documents", "labels", "supplier"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
        want = c.execute(f"SELECT industry, code, n, above FROM ({coverage_plans.INDUSTRY_COMPANIES})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_codes_of_equal_names_are_counted_once(spark):
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "a"), (4, " "), (5, None)], "code long, name string")
    codes, sets = mentions.called(names)
    assert {r.code: r.called for r in codes.collect()} == {1: ["a"], 2: ["a"], 3: ["a", "b"]}
    assert sorted((tuple(r.called), r.name) for r in sets.collect()) == [(("a",), "a"), (("a", "b"), "a"), (("a", "b"), "b")]


def test_frames_of_stages_slide_and_are_not_added_up_for_each_bar(spark):
    """By hand, over batches that are shorter than a frame; the plan has no window of the last n bars."""
    rows = [(code, i, 50 + 9 * np.sin(i / (5.0 + code)) + i % 3, 10.0 + (i * 7) % 11) for code in (1, 2) for i in range(70 if code == 1 else 25)]
    bars = spark.createDataFrame([(c, float(x), float(v), i) for c, i, x, v in rows], "code long, close double, volume double, i int").selectExpr("code", "date_add(DATE'2024-01-01', i) AS bar_date", "close", "close + 1 AS high", "close - 1 AS low", "volume").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = prices.stage_features(bars, 20, 10, 5)
        plan = _plan(got)
        assert "RowFrame, -19, currentrow" not in plan and "RowFrame, -19, -1)" not in plan and plan.count("Exchange") <= 1
        found = {(r.code, r.bar_date.toordinal() - 738886): r for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    for code, at in ((1, 19), (1, 44), (1, 69), (2, 19), (2, 24)):
        x, v = (np.array([r[k] for r in rows if r[0] == code and r[1] <= at]) for k in (2, 3))
        r, ln, half = found[code, at], np.log(x[-20:]), np.polyfit(np.arange(11), np.log(x[-11:]), 1)[0] - np.polyfit(np.arange(11), np.log(x[-20:-9]), 1)[0]
        rise, fall = (v[-20:-1][k].sum() for k in (np.diff(x, prepend=x[0])[-20:-1] > 0, np.diff(x, prepend=x[0])[-20:-1] < 0))
        assert np.allclose([r.slope, r.r2, r.curvature, r.ma, r.efficiency, r.volume_balance], [np.polyfit(np.arange(20), ln, 1)[0], np.corrcoef(np.arange(20), ln)[0, 1] ** 2, half, x[-10:].mean(), abs(x[-1] - x[-20]) / np.abs(np.diff(x[-20:])).sum(), rise / fall])
        assert r.breakout == (x[-1] > x[-20:-1].max() + 1 and v[-1] >= 1.5 * v[-20:-1].mean()) and r.context_up == (x[-10:].mean() >= x[-20:-10].mean())
    assert found[1, 18].slope is None and found[2, 18].slope is None and found[2, 8].ma is None and found[2, 9].ma is not None and found[2, 13].ma_change is None


def test_statements_are_dealt_by_their_number_and_years_need_no_exchange(spark, monkeypatch):
    monkeypatch.setattr(statements, "PART_FACTS", 10)
    tree = spark.createDataFrame([("all", None, 0), ("a", "all", 1), ("b", "all", 2)], "account string, parent string, position int")
    facts = spark.createDataFrame([(e, y, a, 10 * e + y % 7) for e in range(40) for y in (2000, 2001) for a in ("a", "b", "none")], "entity int, period int, account string, amount int").withColumn("amount", F.col("amount").cast("decimal(20,2)"))
    rows, _ = statements._levels(facts, tree)
    assert rows.rdd.getNumPartitions() == 24  # 240 facts
    got = statements.by_period(facts, tree, [2000, 2001, 2002])
    assert _plan(got).count("Exchange hashpartitioning") == 1
    assert sorted((r.entity, r.account, r.level, r.y2000, r.y2001, r.y2002) for r in got.collect()) == sorted(
        (e, a, level, k * (10 * e + 2000 % 7), k * (10 * e + 2001 % 7), None) for e in range(40) for a, level, k in (("all", 0, 2), ("a", 1, 1), ("b", 1, 1))
    )


def test_valuation_folds_once_and_blends_in_the_row(spark):
    rows = [(0, 900.0, 1), (1, 900.1, 50), (11, 1000.0, 40), (4, 0.0, 7), (None, 5.0, 7)]
    folder = shared.new_folder(spark, "parts")
    spark.createDataFrame(rows, "p_partkey long, p_retailprice double, p_size int").write.parquet(f"{folder}/part.parquet")
    got = fiscal_plans.multiples(spark, folder)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    with duckdb.connect() as c:
        c.execute("CREATE TABLE part (p_partkey BIGINT, p_retailprice DOUBLE, p_size INTEGER)")
        c.executemany("INSERT INTO part VALUES (?, ?, ?)", rows)
        want = c.execute(f"SELECT code, target, methods, kept, multiple, dcf FROM ({fiscal_plans.MULTIPLES})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) == 3


def test_segments_of_ordered_bars_are_not_dealt_again(spark):
    day = dt.date(2020, 1, 1)
    series = {c: [((k // 7 + c) % 4 + 1 if k > 3 else None, (k // 5) % 3 - 1, (k // 9) % 3 - 1, 10.0 + (k * 7 + c) % 13 if k % 11 else None) for k in range(40 + 30 * c)] for c in range(4)}
    want = set()
    for c, bars in series.items():
        there = [(k, *b) for k, b in enumerate(bars) if b[0]]
        runs = sequences.segment_series(*([b[i] for b in there] for i in (1, 2, 3)), [float("nan") if b[4] is None else b[4] for b in there], 5)
        want |= {(c, day + dt.timedelta(there[a][0]), day + dt.timedelta(there[b][0]), s, b - a + 1) for a, b, s in runs}
    rows = [(c, day + dt.timedelta(k), b[3], *b[:3]) for c, bars in series.items() for k, b in enumerate(bars)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # batches end within codes, and codes within batches
    try:
        schema = "code long, bar_date date, close double, stage int, side int, slope int"
        ordered = sequences.segments(spark.createDataFrame(rows, schema).coalesce(1), 5, in_order=True)
        assert "Exchange" not in _plan(ordered)
        assert {tuple(r) for r in ordered.collect()} == want
        assert {tuple(r) for r in sequences.segments(spark.createDataFrame(rows[::-1], schema), 5).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_last_stages_are_those_of_all_bars_and_frames_of_weeks_share_them(spark):
    rows = [(c, i, float(60 + 12 * np.sin(i / (31.0 + 9 * c)) + (i * 7 + c) % 5), float(5 + (i * 5) % 9)) for c in (1, 2, 3) for i in range(700 if c == 1 else 120 * c - 200)]
    bars = spark.createDataFrame(rows, "code long, i int, close double, volume double").selectExpr("code", "date_add(DATE'2020-01-01', i) AS bar_date", "close AS open", "close + 1 AS high", "close - 1 AS low", "close", "volume")
    got = prices.last_stages(bars)
    assert _plan(got).split("Initial Plan")[-1].count("MapInArrow") == 2
    want = {c: [] for c in (1, 2, 3)}
    for frame in prices.FRAMES:
        for r in prices.staged(bars, frame).groupBy("code").agg(F.max_by("stage", "bar_date").alias("s")).collect():
            want[r.code].append(r.s)
    assert {r[0]: list(r[1:]) for r in got.collect()} == want and None in want[2] and None not in want[1]


def test_reviewed_names_are_joined_once_after_the_stages_of_resolution(spark):
    canon = spark.createDataFrame([(i, f"red bolt n{i}") for i in range(9)], "c_id long, c_name string")
    named = spark.createDataFrame([(0, "x", 4), (1, "RED BOLT N1 Inc.", None), (2, "n2 bolt red", None), (3, "zz3", None), (6, "zz6", None), (7, "zz7", None), (21, "zz21", None)], "m_id long, name string, hint_id long")
    rejected, promoted = spark.createDataFrame([(3,), (3,), (21,), (0,)], "m_id long"), spark.createDataFrame([(7, 70), (7, 71), (21, 210), (2, 5)], "m_id long, found long")
    got = registers.review_states(graphs.resolve(named, canon), rejected, promoted)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    want = {(0, 4, "id", "canonical"), (1, 1, "exact", "canonical"), (2, 2, "fuzzy", "canonical"), (3, None, "new", "rejected"), (6, None, "new", "pending"), (7, 71, "review", "canonical"), (21, 210, "review", "canonical")}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 7


def test_closure_splits_what_a_node_depends_on_and_leaves_no_cycle_out(spark, monkeypatch):
    monkeypatch.setattr(graphs, "ROW_NODES", 3)
    pairs = [(i, i // 2) for i in range(2, 30)] + [(i, i // 3) for i in range(3, 30)] + [(1, 5), (40, 41), (41, 40), (41, 42), (7, 3), (7, 3), (50, 50), (8, None)]
    got = graphs.closure(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(i,) for i in (1, 7, 29, 40, 42, 50, 99)], "node long"))
    below = {}
    for a, b in pairs:
        below.setdefault(a, set()).add(b)
    want = set()
    for root in (1, 7, 29, 40, 42, 50, 99):
        seen, front = {root}, {root}
        while front := {b for a in front for b in below.get(a, ()) if b is not None} - seen:
            seen |= front
        want |= {(root, n) for n in seen - {root}}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
