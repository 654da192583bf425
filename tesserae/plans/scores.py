"""Queries that score, rank and screen a universe: every part is a company with fundamentals made from its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.functions.columns import decimal_round
from tesserae.operators import scores, valuation
from tesserae.sources.views import table

#: Inputs of a company, in SQL that both engines read: about a tenth of each is missing.
_K = "p_partkey"
_STATUS = "CASE CAST({0} % 5 AS INT) WHEN 0 THEN 'turnaround' WHEN 1 THEN 'profit' WHEN 2 THEN 'deficit' WHEN 3 THEN 'loss' END"
_INPUTS = {
    "code": _K,
    "sector": "p_brand",
    "market": f"CASE WHEN {_K} % 3 = 0 THEN 'A' ELSE 'B' END",
    "cap": f"CASE WHEN {_K} % 29 <> 0 THEN p_retailprice * 7 END",
    "per": f"CASE WHEN {_K} % 11 <> 0 THEN CAST(({_K} * 37) % 531 - 40 AS DOUBLE) / 7 END",
    "pbr": f"CASE WHEN {_K} % 13 <> 0 THEN CAST(({_K} * 53) % 419 - 10 AS DOUBLE) / 127 END",
    "ev_ebitda": f"CASE WHEN {_K} % 7 <> 0 THEN CAST(({_K} * 71) % 271 - 16 AS DOUBLE) / 7 END",
    "roe": f"CASE WHEN {_K} % 17 <> 0 THEN CAST(({_K} * 29) % 211 - 50 AS DOUBLE) / 7 END",
    "dividend": f"CASE WHEN {_K} % 4 <> 0 THEN CAST(({_K} * 19) % 97 AS DOUBLE) / 17 END",
    "eps_yoy": f"CASE WHEN {_K} % 3 <> 0 THEN CAST(({_K} * 41) % 131 - 30 AS DOUBLE) / 127 END",
    "revenue_yoy": f"CASE WHEN {_K} % 10 <> 0 THEN CAST(({_K} * 23) % 257 - 100 AS DOUBLE) / 127 END",
    "op_status": _STATUS.format(_K),
    "op_delta": f"CASE WHEN {_K} % 9 <> 0 THEN CAST(({_K} * 31) % 83 - 40 AS DOUBLE) / 251 END",
    "net_status": _STATUS.format(f"({_K} + 2)"),
    "net_delta": f"CASE WHEN {_K} % 8 <> 0 THEN CAST(({_K} * 43) % 101 - 50 AS DOUBLE) / 251 END",
    "ebitda_status": _STATUS.format(f"({_K} * 2 + 1)"),
    "ebitda_delta": f"CASE WHEN {_K} % 6 = 0 THEN CAST(({_K} * 47) % 67 - 33 AS DOUBLE) / 251 END",
    "momentum": f"CASE WHEN {_K} % 14 <> 0 THEN CAST(({_K} * 61) % 647 - 250 AS DOUBLE) / 7 END",
    "near_high": f"CASE WHEN {_K} % 15 <> 0 THEN CAST(({_K} * 59) % 321 + 480 AS DOUBLE) / 7 END",
    "volume_ratio": f"CASE WHEN {_K} % 16 <> 0 THEN CAST(({_K} * 67) % 311 AS DOUBLE) / 127 END",
    "foreign_delta": f"CASE WHEN {_K} % 5 <> 0 THEN CAST(({_K} * 73) % 301 - 150 AS DOUBLE) / 127 END",
    "aligned": f"CASE WHEN {_K} % 19 <> 0 THEN {_K} % 3 = 1 END",
    "above_long": f"{_K} % 4 = 1",
    "stage": f"CAST(CASE WHEN {_K} % 6 < 4 THEN {_K} % 6 + 1 END AS INT)",
    "strength": f"CASE WHEN {_K} % 12 <> 0 THEN CAST(({_K} * 79) % 99 + 1 AS DOUBLE) END",
    "coverage": f"CAST(({_K} * 3) % 7 AS INT)",
    "buys": f"CAST((({_K} * 3) % 7) / 2 AS INT)",
    "revenue": "p_retailprice * 10",
    "revenue_prior": f"p_retailprice * CASE WHEN {_K} % 21 = 0 THEN 0 ELSE 8 + {_K} % 4 END",
    "receivables": f"p_retailprice * ({_K} % 5)",
    "receivables_prior": f"p_retailprice * ({_K} % 4)",
    "inventory": f"p_retailprice * ({_K} % 7)",
    "inventory_prior": f"p_retailprice * ({_K} % 6)",
    "ocf": f"CASE WHEN {_K} % 23 <> 0 THEN p_retailprice * ({_K} % 9 - 2) END",
    "net_income": f"p_retailprice * ({_K} % 10 - 1)",
    "intangibles": f"p_retailprice * ({_K} % 13)",
    "assets": f"p_retailprice * ({_K} % 31)",
}
_BUYS_SQL = f"CAST(floor((({_K} * 3) % 7) / 2) AS INT)"  # the cast of the other engine rounds


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(*[F.expr(e).alias(name) for name, e in _INPUTS.items()])


COMPANIES = "companies AS (SELECT " + ", ".join(f"{_BUYS_SQL if name == 'buys' else e} AS {name}" for name, e in _INPUTS.items()) + " FROM part)"


def _c(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in df.columns}


# The same rules as SQL text, for the oracles.
def _clamp(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest(0::DOUBLE, least(1::DOUBLE, {x})) END)"


def _band(x: str, low: float, high: float) -> str:
    return _clamp(f"(({x} - ({low})::DOUBLE) / {high - low}::DOUBLE)")


def _weighted(parts: list[tuple[str, float]], scale: int = 100, digits: int = 1) -> str:
    there = " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN {w}::DOUBLE ELSE 0::DOUBLE END)" for x, w in parts)
    total = " + ".join(f"coalesce({x} * {w}::DOUBLE, 0)" for x, w in parts)
    return f"CASE WHEN ({there}) > 0 THEN {_round(f'({total}) / ({there}) * {scale}', digits)} END"


def _round(x: str, digits: int) -> str:
    """Rounded by its decimal digits, as the other engine does: a tie is one only if the number shows it."""
    return f"CAST(round(CAST({x} AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def _status(x: str) -> str:
    return f"(CASE {x} WHEN 'turnaround' THEN 1::DOUBLE WHEN 'profit' THEN 0.7::DOUBLE WHEN 'deficit' THEN 0.3::DOUBLE WHEN 'loss' THEN 0::DOUBLE END)"


def _margin(x: str) -> str:
    return f"(0.5::DOUBLE * (1 + tanh({x} / 0.08::DOUBLE)))"


def _cheap(x: str, best: float, worst: float) -> str:
    return f"(CASE WHEN {x} > 0 THEN {_clamp(f'(({worst}::DOUBLE - {x}) / {worst - best}::DOUBLE)')} END)"


_NEAR = _clamp("((near_high / 100 - 0.7::DOUBLE) / 0.3::DOUBLE)")
_PEG = f"""coalesce({_clamp("(2::DOUBLE - CASE WHEN per > 0 AND eps_yoy > 0 THEN round(per / (eps_yoy * 100), 3) END)")}, CASE WHEN net_status IN ('turnaround', 'profit') AND net_delta IS NOT NULL THEN least({_margin("net_delta")}, 0.7::DOUBLE) END)"""
_GROWTH = {"revenue": (_band("revenue_yoy", -0.2, 0.6), 0.24), "op_status": (_status("op_status"), 0.16), "op_margin": (_margin("op_delta"), 0.14), "net_status": (_status("net_status"), 0.13), "net_margin": (_margin("net_delta"), 0.11), "ebitda_status": (_status("ebitda_status"), 0.12), "ebitda_margin": (_margin("ebitda_delta"), 0.10)}
_VALUE = {"pbr": (_cheap("pbr", 0.5, 3.0), 0.30), "per": (_cheap("per", 5.0, 40.0), 0.25), "ev": (_cheap("ev_ebitda", 3.0, 20.0), 0.15), "peg": (_PEG, 0.15), "roe": (_clamp("(roe / 15)"), 0.10), "dividend": (_clamp("(dividend / 5)"), 0.05)}
_ALIGNED = "(CASE WHEN aligned IS NULL THEN NULL WHEN aligned OR above_long THEN 1::DOUBLE ELSE 0::DOUBLE END)"
_STAGE = "(CASE stage WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1::DOUBLE WHEN 3 THEN 0.3::DOUBLE WHEN 4 THEN 0::DOUBLE END)"
_TREND = {"near_high": (_NEAR, 0.35), "aligned": (_ALIGNED, 0.30), "return": (_band("momentum", -20, 40), 0.20), "volume": (_band("volume_ratio", 0.5, 2.0), 0.15), "stage": (_STAGE, 0.15)}
_FLOW = {"1d": (0.20, 0.25, 0.45, 0.10), "1w": (0.30, 0.30, 0.30, 0.10), "1m": (0.35, 0.30, 0.25, 0.10), "3m": (0.40, 0.30, 0.20, 0.10), "1y": (0.45, 0.25, 0.20, 0.10)}


def _flow(lookback: str) -> str:
    return _weighted(list(zip((_band("momentum", -20, 40), _NEAR, _band("volume_ratio", 0.5, 2.0), _band("foreign_delta", -1.0, 1.0)), _FLOW[lookback])))


def _parts(df: DataFrame) -> dict[str, scores.Parts]:
    c = _c(df)
    return {"growth": scores.growth_parts(c), "value": scores.value_parts(c), "trend": scores.trend_parts(c | {"return_3m": c["momentum"]})}


def _sector_flow(df: DataFrame, by: str) -> DataFrame:
    """Flow of each group from the means of its members."""
    means = df.groupBy(by).agg(*[F.avg(c).alias(c) for c in ("momentum", "near_high", "volume_ratio", "foreign_delta")])
    return means.select(by, *[scores.flow_score(F.col("momentum"), F.col("near_high"), F.col("volume_ratio"), F.col("foreign_delta"), k).alias(f"flow_{k}") for k in scores.FLOW])


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth, value, trend and topdown scores of every company, and their mean."""
    return with_axes(companies(spark, sf_dir)).select("code", "sector", "market", "cap", "growth", "value", "trend", "topdown", "overall")


def with_axes(df: DataFrame) -> DataFrame:
    """Companies with their four axes and the mean of these."""
    own = df.columns
    sectors = _sector_flow(df, "sector").select("sector", F.col("flow_3m").alias("sector_flow"))
    lead = _sector_flow(df.where("market = 'A'"), "sector").select("sector", F.col("flow_1m").alias("lead_flow"))
    markets = _sector_flow(df, "market").select("market", F.col("flow_3m").alias("index_flow"))
    # a row for each sector and market, by their definition few
    df = df.join(sectors, "sector").join(lead, "sector", "left").join(markets, "market")
    parts = _parts(df) | {"topdown": scores.topdown_parts({"lead_sector": F.col("lead_flow"), "sector": F.col("sector_flow"), "index": F.col("index_flow"), "strength": F.col("strength")})}
    scored = df.select(*own, *[scores.score(p).alias(k) for k, p in parts.items()])
    return scored.withColumn("overall", scores.overall([F.col(k) for k in parts], digits=4))


def four_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes(spark, sf_dir).select("code", "growth", "value", "trend", "topdown", "overall")


_MEANS = "avg(momentum) AS momentum, avg(near_high) AS near_high, avg(volume_ratio) AS volume_ratio, avg(foreign_delta) AS foreign_delta"
_TOPDOWN = _weighted([("(lead_flow / 100)", 0.35), ("(sector_flow / 100)", 0.30), ("(index_flow / 100)", 0.10), (_clamp("(strength / 100)"), 0.25)])
_OVERALL = _weighted([(x, 1.0) for x in ("growth", "value", "trend", "topdown")], 1, 4)
AXES_CTE = f"""{COMPANIES}, sectors AS (SELECT sector, {_flow("3m")} AS sector_flow FROM (SELECT sector, {_MEANS} FROM companies GROUP BY 1)),
leads AS (SELECT sector, {_flow("1m")} AS lead_flow FROM (SELECT sector, {_MEANS} FROM companies WHERE market = 'A' GROUP BY 1)),
markets AS (SELECT market, {_flow("3m")} AS index_flow FROM (SELECT market, {_MEANS} FROM companies GROUP BY 1)),
scored AS (SELECT code, sector, market, cap, {_weighted(list(_GROWTH.values()))} AS growth, {_weighted(list(_VALUE.values()))} AS value, {_weighted(list(_TREND.values()))} AS trend, {_TOPDOWN} AS topdown
  FROM companies JOIN sectors USING (sector) LEFT JOIN leads USING (sector) JOIN markets USING (market)),
axes AS (SELECT *, {_OVERALL} AS overall FROM scored)"""
FOUR_AXES = f"WITH {AXES_CTE} SELECT code, growth, value, trend, topdown, overall FROM axes"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow of every sector at five look-backs, with its class."""
    df = _sector_flow(companies(spark, sf_dir), "sector")
    return df.select("*", scores.strength(F.col("flow_3m")).alias("strength"))


FLOWS = f"""WITH {COMPANIES}, m AS (SELECT sector, {_MEANS} FROM companies GROUP BY 1), f AS (SELECT sector, {", ".join(f"{_flow(k)} AS flow_{k}" for k in _FLOW)} FROM m)
SELECT *, CASE WHEN flow_3m >= 60 THEN 'strong' WHEN flow_3m >= 40 THEN 'moderate' WHEN flow_3m IS NOT NULL THEN 'weak' END AS strength FROM f"""


def factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of three scores as a row: norm and weight."""
    df = companies(spark, sf_dir)

    def rows(axis: str, parts: scores.Parts) -> Column:
        return F.transform(scores.breakdown(parts), lambda x: F.struct(F.lit(axis).alias("axis"), x["part"].alias("part"), x["norm"].alias("norm"), x["weight"].alias("weight")))

    return df.select("code", F.inline(F.concat(*[rows(axis, p) for axis, p in _parts(df).items()])))


FACTOR_ROWS = f"WITH {COMPANIES} " + " UNION ALL ".join(
    f"SELECT code, '{axis}' AS axis, '{part}' AS part, {_round(norm, 3)} AS norm, {w}::DOUBLE AS weight FROM companies" for axis, parts in (("growth", _GROWTH), ("value", _VALUE), ("trend", _TREND)) for part, (norm, w) in parts.items()
)


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile scores of growth and value among each market."""
    df = companies(spark, sf_dir)
    return scores.cross_value(scores.cross_growth(df, ["market"]), ["market"]).select("code", "growth", "value")


def _rank(x: str, by: str, order: str = "", where: str = "true") -> str:
    there = f"({x} IS NOT NULL AND {where})"
    w = f"PARTITION BY {by}, {there}"
    return f"(CASE WHEN NOT {there} THEN 0::DOUBLE WHEN count(*) OVER ({w}) <= 1 THEN 0.5::DOUBLE ELSE percent_rank() OVER ({w} ORDER BY {x} {order}) END)"


def _cheap_rank(x: str, by: str) -> str:
    return _rank(x, by, "DESC", f"coalesce({x} > 0, false)")


CROSS = f"""WITH {COMPANIES} SELECT code, round(least(0.20::DOUBLE * {_rank("revenue_yoy", "market")} + 0.11::DOUBLE * coalesce({_status("op_status")}, 0) + 0.09::DOUBLE * coalesce({_margin("op_delta")}, 0)
  + 0.08::DOUBLE * coalesce({_status("net_status")}, 0) + 0.07::DOUBLE * coalesce({_margin("net_delta")}, 0) + 0.06::DOUBLE * coalesce({_status("ebitda_status")}, 0) + 0.05::DOUBLE * coalesce({_margin("ebitda_delta")}, 0)
  + 0.13::DOUBLE * {_rank("momentum", "market")} + 0.12::DOUBLE * CASE WHEN coverage > 0 THEN buys / coverage ELSE 0 END + 0.08::DOUBLE * CASE WHEN coverage > 0 THEN 1 ELSE 0 END, 1) * 100, 1) + 0.0 AS growth,
  round(least(0.35::DOUBLE * {_cheap_rank("pbr", "market")} + 0.28::DOUBLE * {_cheap_rank("per", "market")} + 0.17::DOUBLE * {_cheap_rank("ev_ebitda", "market")} + coalesce({_clamp("(roe / 15)")}, 0) * 0.12::DOUBLE + coalesce({_clamp("(dividend / 5)")}, 0) * 0.08::DOUBLE, 1) * 100, 1) + 0.0 AS value
FROM companies"""


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen with bounds on multiples, liquidity and momentum, scored in the set that is left; total beside the page (rows 11 to 60)."""
    df = companies(spark, sf_dir).where(F.col("cap").isNotNull() & scores.positive_up_to(F.col("per"), 45) & scores.positive_up_to(F.col("pbr"), 2.5) & (F.col("momentum") >= -20) & (F.col("market") == "B"))
    scored = scores.cross_screen(df, ["market"]).withColumn("total", F.count("*").over(Window.partitionBy("market")))
    return scored.select("code", "score", "total").orderBy(F.desc("score"), "code").offset(10).limit(50)


SCREEN = f"""WITH {COMPANIES}, kept AS (SELECT * FROM companies WHERE cap IS NOT NULL AND per > 0 AND per <= 45 AND pbr > 0 AND pbr <= 2.5 AND momentum >= -20 AND market = 'B')
SELECT code, round(least(0.30::DOUBLE * {_cheap_rank("pbr", "market")} + 0.25::DOUBLE * {_cheap_rank("per", "market")} + 0.30::DOUBLE * {_rank("momentum", "market")} + 0.15::DOUBLE * coalesce({_NEAR}, 0), 1) * 100, 1) + 0.0 AS score, count(*) OVER () AS total
FROM kept ORDER BY score DESC, code LIMIT 50 OFFSET 10"""


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red flags of every company, and how grave they are."""
    df = companies(spark, sf_dir)
    found = df.select("code", scores.red_flags(_c(df)).alias("flags"))
    return found.select("code", F.array_join(F.transform("flags", lambda x: x["flag"]), ",").alias("flags"), scores.severity(F.col("flags")).alias("severity"))


FLAGS = f"""WITH {COMPANIES}, r AS (SELECT *, CASE WHEN revenue_prior > 0 THEN (revenue - revenue_prior) / revenue_prior END AS g FROM companies),
f AS (SELECT code, list_filter([
  CASE WHEN receivables_prior > 0 AND (receivables - receivables_prior) / receivables_prior - g >= 0.15 THEN 'receivables_outpace_revenue' END,
  CASE WHEN inventory_prior > 0 AND (inventory - inventory_prior) / inventory_prior - g >= 0.15 THEN 'inventory_outpace_revenue' END,
  CASE WHEN net_income > 0 AND ocf < 0 THEN 'profit_no_cash' END, CASE WHEN net_income > 0 AND ocf >= 0 AND ocf < net_income * 0.5 THEN 'ocf_below_profit' END,
  CASE WHEN assets > 0 AND intangibles / assets >= 0.3 THEN 'high_intangibles' END], lambda x: x IS NOT NULL) AS flags FROM r)
SELECT code, array_to_string(flags, ',') AS flags, CASE WHEN list_contains(flags, 'receivables_outpace_revenue') OR list_contains(flags, 'profit_no_cash') THEN 'danger' WHEN len(flags) > 0 THEN 'caution' ELSE 'good' END AS severity FROM f"""


def value_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value strategy: companies with any multiple, cheap by absolute bands, best first, with their place."""
    df = companies(spark, sf_dir).where(scores.any_value("per", "pbr", "dividend"))
    scored = df.select("code", "sector", scores.score(scores.value_parts(_c(df))).alias("score"), (scores.positive_up_to(F.col("per"), 12) & scores.positive_up_to(F.col("pbr"), 1)).alias("cheap"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc(F.coalesce("score", F.lit(-1.0))), "code")))


VALUE_SCREEN = f"""WITH {COMPANIES}, s AS (SELECT code, sector, {_weighted(list(_VALUE.values()))} AS score, coalesce(per > 0 AND per <= 12, false) AND coalesce(pbr > 0 AND pbr <= 1, false) AS cheap FROM companies WHERE per IS NOT NULL OR pbr IS NOT NULL OR dividend IS NOT NULL)
SELECT *, row_number() OVER (PARTITION BY sector ORDER BY coalesce(score, -1) DESC, code) AS place FROM s"""


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company beside its sector: four axes, and by how much the overall score is above the sector's mean."""
    a = axes(spark, sf_dir)
    means = a.groupBy("sector").agg(F.avg("overall").alias("mean"), F.count("*").alias("peers"))
    return a.join(means, "sector").select("code", "sector", "overall", "peers", decimal_round(F.col("overall") - F.col("mean"), 8).alias("above"))


PEERS = f"WITH {AXES_CTE}, m AS (SELECT sector, avg(overall) AS mean, count(*) AS peers FROM axes GROUP BY 1) SELECT code, sector, overall, peers, {_round('overall - mean', 8)} AS above FROM axes JOIN m USING (sector)"


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgment of every company from its axes, and the axes that are strong and weak."""
    a = axes(spark, sf_dir)
    names = ["growth", "value", "trend", "topdown"]
    mean, verdict = valuation.judgment([F.col(c) for c in names])
    pick = lambda test: F.array_join(F.filter(F.array(*[F.when(test(F.col(c)), c) for c in names]), lambda x: x.isNotNull()), ",")
    return a.select("code", F.round(mean, 4).alias("mean"), verdict.alias("verdict"), pick(lambda x: x >= 60).alias("strong"), pick(lambda x: x < 40).alias("weak"))


ANALYSIS = f"""WITH {AXES_CTE}, l AS (SELECT code, list_filter([growth, value, trend, topdown], lambda x: x IS NOT NULL) AS a, growth, value, trend, topdown FROM axes), m AS (SELECT *, list_sum(a) / len(a) AS mean, len(list_filter(a, lambda x: x < 40)) AS n FROM l)
SELECT code, {_round('mean', 4)} AS mean, CASE WHEN mean >= 60 AND n = 0 THEN 'fit' WHEN mean < 40 OR n >= 2 THEN 'avoid' WHEN mean IS NOT NULL THEN 'watch' END AS verdict,
  concat_ws(',', CASE WHEN growth >= 60 THEN 'growth' END, CASE WHEN value >= 60 THEN 'value' END, CASE WHEN trend >= 60 THEN 'trend' END, CASE WHEN topdown >= 60 THEN 'topdown' END) AS strong,
  concat_ws(',', CASE WHEN growth < 40 THEN 'growth' END, CASE WHEN value < 40 THEN 'value' END, CASE WHEN trend < 40 THEN 'trend' END, CASE WHEN topdown < 40 THEN 'topdown' END) AS weak FROM m"""


QUERIES = {
    "f3_f13_four_axes": four_axes,
    "f9_q5_flows": flows,
    "f16_factors": factor_rows,
    "f14_cross_section": cross_section,
    "f15_q3_screen": screen,
    "f18_red_flags": flags,
    "p13_p14_value_screen": value_screen,
    "q2_peers": peers,
    "q7_analysis": analysis,
}
ORACLES = {
    "f3_f13_four_axes": FOUR_AXES,
    "f9_q5_flows": FLOWS,
    "f16_factors": FACTOR_ROWS,
    "f14_cross_section": CROSS,
    "f15_q3_screen": SCREEN,
    "f18_red_flags": FLAGS,
    "p13_p14_value_screen": VALUE_SCREEN,
    "q2_peers": PEERS,
    "q7_analysis": ANALYSIS,
}
