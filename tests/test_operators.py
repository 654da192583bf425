"""Kernels against hand values and plain Python."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import columns
from tesserae.operators import graphs, nearest, ratios, relational, sequences, valuation
from tesserae.sources import parsers


def one(spark, *cols):
    return spark.range(1).select(*cols).head()


def test_missing_parts_renormalise(spark):
    none = F.lit(None).cast("double")
    r = one(spark, columns.weighted([(F.lit(1.0), 0.5), (none, 0.3), (F.lit(0.0), 0.2)]).alias("a"), columns.weighted([(none, 1.0)]).alias("b"), columns.band(none, 0.0, 1.0).alias("c"), columns.band(F.lit(5.0), 0.0, 1.0).alias("d"))
    assert (r.a, r.b, r.c, r.d) == (71.4, None, None, 1.0)


def test_numbers_and_labels(spark):
    got = one(spark, *[columns.parse_number(F.lit(x)).alias(f"c{i}") for i, x in enumerate(("(1,234)", "-5", "1,000.5", "x", ""))], columns.label_key(F.lit("Ⅰ. x")).alias("l"), columns.label_key(F.lit("1. Net Income (loss)")).alias("m"))
    assert (got.c0, got.c1, got.c2, got.c3, got.c4, got.m) == (-1234.0, -5.0, 1000.5, None, None, "netincome")


def test_ratio_formulas(spark):
    df = spark.createDataFrame([({"a": 10.0, "b": 4.0, "e:opening": 1.0, "e:closing": 3.0, "z": 0.0},)], "v map<string,double>")
    f = {"x": "(a - b) / a", "y": "a / avg(e)", "w": "a / z", "m": "nope / a", "n": "-abs(b - a) * 2", "c": "net / b"}
    got = df.select(*[c.alias(n) for n, c in ratios.ratios(F.col("v"), f, {"net": "a - b"}).items()]).head()
    assert (got.x, got.y, got.w, got.m, got.n, got.c) == (0.6, 5.0, None, None, -12.0, 1.5)
    for bad in ("__import__('os')", "a ** b", "a if b else c", "a +", "a.b"):
        with pytest.raises(ratios.FormulaError):
            ratios.compile_formula(bad, F.col("v"))
    with pytest.raises(ratios.FormulaError):
        ratios.expand({"p": "q + 1", "q": "p"})
    assert all(ratios.names(f) for f, _, _ in ratios.RATIOS.values()) and len(ratios.RATIOS) == 57


def test_valuation_by_hand(spark):
    lit = F.lit
    dcf = valuation.dcf_target(lit(100.0), lit(0.0), lit(1), lit(0.0), lit(0.1), lit(0.0), lit(1e8), lit(None).cast("double"), lit("medium"), 1e8)
    low = valuation.dcf_target(lit(100.0), lit(0.0), lit(1), lit(0.04), lit(0.03), lit(0.0), lit(1e8), lit(None).cast("double"), lit("medium"), 1e8)
    got = one(spark, dcf.alias("dcf"), low.alias("low"), valuation.ddm_target(lit(1000.0), lit(0.03), lit(0.08)).alias("ddm"), valuation.cap_years(lit(0.2), lit(0.1), lit("strong")).alias("cap"))
    assert round(got.dcf, 6) == 1000 and got.low is None and round(got.ddm) == 20600 and got.cap == 10.0
    g, roe, coe, t, n = 0.12, 0.2, 0.1, 0.03, 5
    pv, eps, d = 0.0, 1.0, 1.0
    for k in range(1, 2 * n + 1):
        s = max(0, k - n) / n
        gk, rk = g + (t - g) * s, roe + (coe - roe) * s
        eps, d = eps * (1 + gk), d * (1 + coe)
        pv += max(0, 1 - gk / rk) * eps / d
    pv += (1 - t / coe) * eps * (1 + t) / (coe - t) / d
    m = one(spark, valuation.forward_multiple(lit(g), lit(roe), lit(coe), lit(t), lit(5.0)).alias("m")).m
    assert m == round(pv / (1 + g), 1)


def test_blend_drops_unfit_and_outliers(spark):
    rows = [(1, "per", 100.0, "high", 1.0, False), (1, "pbr", 110.0, "low", 1.0, False), (1, "dcf", 500.0, "high", 1.0, False), (1, "ddm", 90.0, "medium", 0.0, False)]
    got = valuation.blend(spark.createDataFrame(rows, "code int, method string, target double, confidence string, fit double, is_growth boolean")).head()
    assert (got.methods, got.kept, round(got.target, 6)) == (4, 2, (100 * 3 + 110) / 4)


def plain_zigzag(s, t):
    if len(s) < 2:
        return []
    hi = lo = s[0]
    way, out = 0, []
    for x in s[1:]:
        if way >= 0 and x[1] > hi[1]:
            hi = x
        if way <= 0 and x[1] < lo[1]:
            lo = x
        if way >= 0 and x[1] <= hi[1] * (1 - t):
            out.append((*hi, "high"))
            way, lo = -1, x
        elif way <= 0 and x[1] >= lo[1] * (1 + t):
            out.append((*lo, "low"))
            way, hi = 1, x
    return out + ([(*hi, "high")] if way == 1 else [(*lo, "low")] if way == -1 else [])


def test_zigzag_and_segments(spark):
    import random

    random.seed(1)
    p, s = 100.0, []
    for i in range(300):
        p *= 1 + random.uniform(-0.03, 0.03)
        s.append((dt.date(2024, 1, 1) + dt.timedelta(days=i), p))
    df = spark.createDataFrame([(1, d, x) for d, x in s] + [(2, s[0][0], 1.0)], "code long, bar_date date, close double")
    got = [(r.pivot_date, r.price, r.kind) for r in sequences.zigzag(df).where("code = 1").orderBy("n").collect()]
    assert got == plain_zigzag(s, 0.06) and sequences.zigzag(df).where("code = 2").count() == 0
    close = [100.0 + i for i in range(45)] + [145.0 - i for i in range(30)]
    runs = sequences.segment_series([2] * 30 + [3] * 5 + [2] * 10 + [4] * 30, [1] * 45 + [-1] * 30, [1] * 45 + [-1] * 30, close)
    assert runs == [(0, 44, 2), (45, 74, 4)]


def test_segment_steps():
    flat = [100.0] * 60
    # stages 1 and 3 go on near a flat average, others don't
    assert sequences.settled_stages([1, 2, 2, 4, 2], [0, 0, 1, 0, 0], [0, 0, 0, 0, 0]) == [1, 1, 2, 4, 2]
    # a short flicker is no run; a turn from 2 to 4 needs half the time
    assert sequences.debounced([2] * 30 + [1] * 15 + [2] * 15, [0] * 60, [0] * 60, 20) == [(0, 59, 2)]
    assert sequences.debounced([2] * 30 + [4] * 15 + [2] * 15, [0] * 60, [0] * 60, 20) == [(0, 29, 2), (30, 44, 4), (45, 59, 2)]
    v = np.array([100.0 - i for i in range(30)] + [71.0 + 2 * i for i in range(30)])
    assert sequences.by_direction((0, 59, 4), v, [-1] * 60) == [(0, 29, 4), (30, 59, 1)]
    assert sequences.by_direction((0, 59, 2), 500 - v, [1] * 60) == [(0, 59, 2)]  # fell by less than a tenth
    assert sequences.by_direction((0, 59, 2), 140 - v, [1] * 60) == [(0, 29, 2), (30, 59, 3)]
    up = np.array([100.0 + i for i in range(60)])
    assert sequences.by_direction((0, 59, 3), up, [0] * 20 + [1] * 40) == [(0, 19, 1), (20, 59, 2)]
    assert sequences.by_direction((0, 59, 3), up, [0] * 60) == [(0, 59, 2)] and sequences.by_direction((0, 59, 4), np.array(flat), [0] * 60) == [(0, 59, 4)]
    assert sequences.by_tail((0, 59, 4), [-1] * 40 + [0] * 5 + [1] * 15) == [(0, 39, 4), (40, 59, 1)] and sequences.by_tail((0, 59, 2), [1] * 50 + [-1] * 10) == [(0, 59, 2)]
    assert sequences.merged([(0, 3, 1), (4, 5, 1), (6, 9, 2)]) == [(0, 5, 1), (6, 9, 2)] and sequences.segment_series([], [], [], []) == []


def test_filters_refuse_what_they_dont_know(spark):
    with pytest.raises(ValueError):
        relational.filters([{"id": "nope", "op": "gte", "value": 1}], {"a": "a"})
    with pytest.raises(ValueError):
        relational.filters([{"id": "a", "op": "like", "value": 1}], {"a": "a"})


def test_upsert_twice_is_once(spark):
    s = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    n = spark.createDataFrame([(2, 5.0, 1), (2, 6.0, 2), (3, 3.0, 1)], "k int, v double, seq long")
    once = relational.upsert(s, n, ["k"], "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, relational.upsert(once, n, ["k"], "seq").collect())) == [(1, 1.0), (2, 6.0), (3, 3.0)]


def test_frames(spark):
    f = "^".join(["A", "0900", "70000", "2", "1", "0.5"] + ["0"] * 7 + ["123"])
    g = f.replace("70000", "71000")
    lines = spark.createDataFrame([(f"0|H0STCNT0|1|{f}",), (f"0|H0STCNT0|2|{f}^{g}",), (f"0|OTHER|1|{f}",), ("0|H0STCNT0|x|a",), ("0|H0STCNT0|1|a^b",), ("",), (None,)], "value string")
    assert [(r.code, r.price, r.volume) for r in parsers.frames(lines).collect()] == [("A", 70000.0, 123), ("A", 71000.0, 123)]


def test_cells_take_the_last_unit(spark):
    rows = [(1, 1, None, None, "(단위: 천원)"), (1, 2, "1. 매출액", "1,000", ""), (1, 3, None, None, "단위 : 백만원"), (1, 4, "자본 (주1)", "(5)", "")]
    got = [(r.label, r.amount) for r in parsers.cells(spark.createDataFrame(rows, "doc int, n int, label string, value string, text string")).orderBy("n").collect()]
    assert got == [("매출액", 1_000_000.0), ("자본", -5_000_000.0)]


def test_sequence_ratio(spark):
    got = one(spark, nearest.sequence_ratio(F.lit("abcd"), F.lit("bcde")).alias("r"), graphs.name_key(F.lit("ACME (Korea) Co., Ltd.")).alias("k"))
    assert got.r == 0.75 and got.k == "acme"


def test_closure_follows_chains_to_their_end(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    e = spark.createDataFrame([(i, i + 1) for i in range(24)] + [(24, 20)], "src long, dst long").coalesce(1).cache()
    got = graphs.closure(e, spark.createDataFrame([(0,)], "node long").coalesce(1))
    assert sorted((r.root, r.node) for r in got.collect()) == [(0, i) for i in range(1, 25)]


def test_nearest_takes_queries_in_blocks(spark):
    v = [(i, [float(i % 7) + 1, float(i % 5), float(i % 3)]) for i in range(60)]
    base = spark.createDataFrame(v, "id long, v array<double>")
    asked = base.where("id % 2 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    rows = lambda block: sorted((r.q, r.id, r["rank"]) for r in nearest.nearest_by_cosine(base, asked, 5, queries=block, rows=13).collect())
    assert rows(7) == rows(100) and len(rows(7)) == 150


def test_fuzzy_top_scores_all_names(spark):
    """Brute force over all names; errors in the first letters share no start and no word."""
    from difflib import SequenceMatcher

    words = ["Samsung", "Hyundai", "Kia Motors", "LG Chem", "samsong", "Posco", "Naver", "Kakao", "Celltrion", "hyundae", "", "qqq", "Samsung SDI"]
    names = [(i, w) for i, w in enumerate(words + [f"{w} {i}" for i, w in enumerate(words)] + words)] + [(99, None)]
    asked = ["amsung", "Hyndai", "xosco", "#", "a"]
    want = []
    for q in asked:
        scored = sorted((-SequenceMatcher(None, q.lower(), w.lower()).ratio(), i) for i, w in names if w is not None)
        want += [(q, i, n + 1, -s) for n, (s, i) in enumerate([x for x in scored if x[0] < 0][:5])]
    got = nearest.fuzzy_top(spark.createDataFrame(names, "id long, name string"), spark.createDataFrame([(q,) for q in asked], "q string"))
    assert sorted((r.q, r.id, r["rank"], r.score) for r in got.collect()) == sorted(want)


def test_fuzzy_top_goes_down_level_by_level(spark):
    """Many near names, some with few alike ones; the index compares far fewer than all pairs and loses none."""
    from difflib import SequenceMatcher

    r = np.random.default_rng(8)
    roots = ["".join(r.choice(list("abcdefghijklmnopqrst"), int(n))) for n in r.integers(1, 30, 60)]

    def worn(x):
        x = list(x)
        for _ in range(int(r.integers(0, 4))):
            x.insert(int(r.integers(0, len(x) + 1)), str(r.choice(list("xyz "))))
        return "".join(x)

    names = [(i, worn(roots[i % 60]).title()) for i in range(600)] + [(1000 + i, "One Hot Name Ltd") for i in range(300)]
    asked = [worn(x) for x in roots[:25]] + ["one hot name", "zzzzzzzz", "A"]
    want = []
    for q in dict.fromkeys(asked):
        scored = sorted((-SequenceMatcher(None, q.lower(), w.lower()).ratio(), i) for i, w in names)
        want += [(q, i, n + 1, -s) for n, (s, i) in enumerate([x for x in scored if x[0] < 0][:5])]
    df, queries = spark.createDataFrame(names, "id long, name string"), spark.createDataFrame([(q,) for q in asked], "q string")
    assert sorted((x.q, x.id, x["rank"], x.score) for x in nearest.fuzzy_top(df, queries).collect()) == sorted(want)
    low = sorted({w.lower() for _, w in names})
    lows = spark.createDataFrame([(w,) for w in low], "low string")
    for t in nearest.LEVELS:
        got = sorted((x.asked_low, x.low) for x in nearest.alike_names(lows, lows, t).collect())
        assert got == sorted((a, b) for a in low for b in low if SequenceMatcher(None, a, b).ratio() >= t)


def test_nearest_leaves_out_what_has_no_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [2.0, 0.0]), (7, [2.0, 2.0]), (8, [])]
    base = spark.createDataFrame(rows, "id long, v array<double>")
    asked = base.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    got = sorted((r.q, r["rank"], r.id, round(r.score, 6)) for r in nearest.nearest_by_cosine(base, asked, 5).collect())
    assert got == [(1, 1, 6, 1.0), (1, 2, 7, 0.707107), (6, 1, 1, 1.0), (6, 2, 7, 0.707107), (7, 1, 1, 0.707107), (7, 2, 6, 0.707107)]
    assert nearest.nearest_by_cosine(base, asked.limit(0), 5).collect() == []


def test_text_rules(spark):
    """Pieces against the plain rule, feeds with odd items, dates, titles and phases."""
    from tesserae.functions import texts

    def cut(text, most):
        out, held = [], []
        for line in text.split("\n"):
            hard = [line[i : i + most] for i in range(0, max(1, len(line)), most)]
            if len(hard) > 1:
                out += (["\n".join(held)] if held else []) + hard[:-1]
                held = []
            if held and len("\n".join([*held, hard[-1]])) > most:
                out.append("\n".join(held))
                held = []
            held.append(hard[-1])
        return out + (["\n".join(held)] if "".join(held) else [])

    r = np.random.default_rng(3)
    samples = ["\n".join("".join(r.choice(list("ab "), int(n))) or "x" for n in r.integers(1, 45, int(r.integers(1, 12)))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i int, t string")
    got = {x.i: list(x.p) for x in df.select("i", texts.pieces(F.col("t"), 20).alias("p")).collect()}
    for i, t in enumerate(samples):
        assert got[i] == cut(t, 20) and all(len(p) <= 20 for p in got[i])
    feed = "<rss><channel><title>feed</title><item><title>A &amp; B</title><link> http://x </link><source url='u'>S</source><pubDate>Tue, 02 Jan 2024 03:04:05 +0900</pubDate></item><item><link>no title</link></item><item><title><![CDATA[two]]></title><pubDate>rubbish</pubDate></item></channel></rss>"
    items = spark.createDataFrame([(feed,), ("not xml <item>",), (None,)], "x string").select(F.inline(texts.rss_items(F.col("x")))).collect()
    assert [(x.title, x.link, x.source) for x in items] == [("A & B", "http://x", "S"), ("two", "", "")]
    assert str(items[0].published) == "2024-01-01 18:04:05" and items[1].published is None
    titles = [("코스피 마감 시황", True), ("미국 주식시장 마감 시황", False), ("뉴욕發 훈풍에 코스피 마감 강세", True), ("장마감코멘트", True), ("오늘의 전략", False), (None, False)]
    got = spark.createDataFrame(titles, "t string, want boolean").select("want", texts.domestic_closing(F.col("t")).alias("got")).collect()
    assert all(x.want == x.got for x in got)
    row = spark.range(1).select(texts.queries(F.lit("N"), ["a", "b", "c"], ["b", "d"], 2).alias("q"), texts.snippet(F.lit("head\n───\n\none\ntwo"), 5).alias("s"), texts.mentions(F.lit("aXaXa"), F.lit("aX")).alias("m")).head()
    assert (list(row.q), row.s, row.m) == (["N a", "N b", "N d"], "one t…", 2)


def test_ledger_of_odd_rows(spark):
    """Updates of unknown keys, a series of one bar, and a kind that never came."""
    from tesserae.operators import ledger

    stored = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, s string, v double")
    got = ledger.updated(stored, spark.createDataFrame([(2, None), (9, "z")], "k int, s string"), ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1.0), (2, None, None)]
    bars = spark.createDataFrame([("A", "2024-01-01", 1.0), ("B", "2024-01-01", 1.0), ("B", "2024-01-02", 2.0)], "code string, d string, close double").select("code", F.to_date("d").alias("bar_date"), "close")
    fresh = spark.createDataFrame([("A", "2024-01-01", 5.0), ("B", "2024-01-01", 0.5), ("B", "2024-01-03", 1.0)], "code string, d string, close double").select("code", F.to_date("d").alias("bar_date"), "close")
    full = fresh.withColumn("close", F.lit(7.0))
    got = sorted((r.code, str(r.bar_date), r.close) for r in ledger.merged_series(bars, fresh, full).collect())
    assert got == [("A", "2024-01-01", 5.0), ("B", "2024-01-01", 7.0), ("B", "2024-01-03", 7.0)]
    plan = {r.code: (r.mode, str(r.since)) for r in ledger.fetch_plan(spark.createDataFrame([("A",), ("B",), ("C",)], "code string"), bars).collect()}
    assert plan == {"A": ("incremental", "2023-12-29"), "B": ("incremental", "2023-12-29"), "C": ("seed", "None")}
    q = spark.createDataFrame([("x", "us")], "name string, kind string").withColumn("minute", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    stale = {r.kind: r.stale for r in ledger.staleness(q, ["us", "kr"], F.lit("2024-01-01 00:01:00").cast("timestamp"), 61).collect()}
    assert stale == {"us": False, "kr": True}


def test_cycles_and_projection(spark):
    """Blocks from the left without overlap, and the zone after an impulse and its correction."""
    assert sequences.greedy_cycles({0: "up", 2: "down", 9: "up"}, {5: "down", 6: "down"}, 20) == [(0, "motive", "up"), (5, "corrective", "down"), (9, "motive", "up")]
    assert sequences.greedy_cycles({1: "down"}, {6: "down", 8: "up"}, 20) == [(1, "motive", "down"), (8, "corrective", "up")] and sequences.greedy_cycles({}, {3: "up"}, 9) == []
    prices = [100.0, 110.0, 104.4, 120.6, 114.4, 124.4, 112.0, 119.4, 105.0]
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=10 * i)
    pivots = spark.createDataFrame([(1, i, day(i), p, "low" if i % 2 == 0 else "high", True) for i, p in enumerate(prices)], "code long, n int, pivot_date date, price double, kind string, settled boolean")
    bars = spark.createDataFrame([(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(120)], "code long, bar_date date, close double")
    legs = sequences.cycles(pivots)
    got = [(r.n, r.label, r.phase) for r in legs.orderBy("n").collect()]
    assert got == [(0, "1", "motive"), (1, "2", "motive"), (2, "3", "motive"), (3, "4", "motive"), (4, "5", "motive"), (5, "A", "corrective"), (6, "B", "corrective"), (7, "C", "corrective")]
    r = sequences.projections(pivots, legs, bars).head()
    span = 124.4 - 105.0
    assert (r.label, r.next, r.low, r.high, r.bars_low, r.bars_high) == ("C", "advance", round(105 + span, 2), round(105 + 1.618 * span, 2), 30, 48)
    first = sequences.projections(pivots, legs.where("n < 5"), bars).head()
    assert (first.next, first.low, first.high, first.bars_low) == ("correction", round(124.4 - 0.618 * 24.4, 2), round(124.4 - 0.382 * 24.4, 2), 19)


def test_structure_and_boxes(spark):
    """Hand-made pivots: a base that turns up, a broken box with and without volume, and a box upside down."""
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    series = {1: [120.0, 90.0, 110.0, 95.0], 2: [100.0, 120.0, 101.0, 121.0, 99.5, 119.0, 100.5], 3: [100.0, 110.0, 105.0], 4: [100.0, 130.0]}
    starts = {1: "high", 2: "low", 3: "low", 4: "low"}
    kind = lambda c, i: starts[c] if i % 2 == 0 else ("low" if starts[c] == "high" else "high")
    pivots = spark.createDataFrame([(c, i, day(i), p, kind(c, i), i < len(ps) - 1) for c, ps in series.items() for i, p in enumerate(ps)], "code long, n int, pivot_date date, price double, kind string, settled boolean")
    got = {r.code: (r.last_high, r.last_low, r.trend, r.setup) for r in sequences.structure(pivots).collect()}
    assert got == {1: ("LH", "HL", "range", "stage 1 to 2"), 2: ("LH", "HL", "range", "stage 1 to 2"), 3: (None, "HL", "range", "stage 1 to 2")}
    bars = [(2, day(i), 110.0, 10.0) for i in range(9)] + [(2, day(9), 125.0, 15.0)] + [(1, day(i), 100.0, 10.0) for i in range(9)] + [(1, day(9), 80.0, 11.0)] + [(3, day(i), 1.0, 1.0) for i in range(3)]
    box = {r.code: (r.support, r.resistance, r.event, r.confirmed) for r in sequences.boxes(pivots, spark.createDataFrame(bars, "code long, bar_date date, close double, volume double")).collect()}
    assert box == {2: (round((100 + 101 + 99.5) / 3, 2), 120.0, "breakout", True), 1: (90.0, 120.0, "breakdown", False)}


def test_spool_there_and_back(spark, tmp_path):
    """Broken lines and unknown kinds are left out, good ones are appended once and come back; repeats by key go within the lateness."""
    from tesserae.streaming import ticks

    inbox, out = tmp_path / "in", f"file://{tmp_path}/out"
    inbox.mkdir()
    row = '{"kind": "%s", "ref_date": "2024-01-0%d", "sent_at": "2024-01-01T00:00:00Z", "title": "t", "body": "%s", "stock_codes": ["1"], "industries": [], "dedup_key": "k"}'
    (inbox / "a.json").write_text("\n".join([row % ("morning", 1, "x"), "not json", row % ("party", 1, "x"), row % ("closing", 2, "y"), row % ("morning", 1, "x")]))
    run = lambda: ticks.append_json(ticks.spool(spark, f"file://{inbox}"), out, f"file://{tmp_path}/state")
    run()
    run()  # nothing new
    held = spark.read.schema(ticks.SPOOL).json(out)
    assert sorted((r.kind, str(r.ref_date), r.body) for r in held.collect()) == [("closing", "2024-01-02", "y"), ("morning", "2024-01-01", "x"), ("morning", "2024-01-01", "x")]
    keyed = ticks.spool(spark, f"file://{inbox}").withColumn("key", ticks.dedup_key("kind", "ref_date", "body"))
    once = ticks.first_seen(keyed, "key", "sent_at", "1 hour").writeStream.format("memory").queryName("once").option("checkpointLocation", f"file://{tmp_path}/once").outputMode("append").trigger(availableNow=True).start()
    once.awaitTermination()
    assert sorted(r.kind for r in spark.table("once").collect()) == ["closing", "morning"]
