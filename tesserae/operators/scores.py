"""Scores of 0 to 100 from weighted parts; a missing part leaves its weight to the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.columns import band, clamp01, decimal_round, weighted
from tesserae.operators import ranks

# Results depend on them.
STATUS = {"turnaround": 1.0, "profit": 0.7, "deficit": 0.3, "loss": 0.0}
MARGIN_SCALE = 0.08
GROWTH = {"revenue": 0.24, "op_status": 0.16, "op_margin": 0.14, "net_status": 0.13, "net_margin": 0.11, "ebitda_status": 0.12, "ebitda_margin": 0.10}
VALUE_BANDS = {"per": (5.0, 40.0), "pbr": (0.5, 3.0), "ev_ebitda": (3.0, 20.0)}
VALUE = {"pbr": 0.30, "per": 0.25, "ev": 0.15, "peg": 0.15, "roe": 0.10, "dividend": 0.05}
STAND_IN_MOST = 0.7
TREND = {"near_high": 0.35, "aligned": 0.30, "return": 0.20, "volume": 0.15, "stage": 0.15}
STAGES = {1: 0.5, 2: 1.0, 3: 0.3, 4: 0.0}
TOPDOWN = {"lead_sector": 0.35, "sector": 0.30, "index": 0.10, "strength": 0.25}
#: Weights of return, nearness to the high, volume and foreign holdings by look-back.
FLOW = {"1d": (0.20, 0.25, 0.45, 0.10), "1w": (0.30, 0.30, 0.30, 0.10), "1m": (0.35, 0.30, 0.25, 0.10), "3m": (0.40, 0.30, 0.20, 0.10), "1y": (0.45, 0.25, 0.20, 0.10)}
FLAG_GAP, FLAG_CASH, FLAG_INTANGIBLE = 0.15, 0.5, 0.30


def one_of(key: Column, values: dict) -> Column:
    """The value of a key, missing for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def margin_score(delta: Column) -> Column:
    """A change of margin as an S-curve around one half."""
    return 0.5 * (1 + F.tanh(delta / MARGIN_SCALE))


def status_score(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), status)


def cheapness(x: Column, band_: tuple[float, float]) -> Column:
    """1 at the good end, 0 at the bad one; only positive values count."""
    best, worst = band_
    return F.when(x > 0, clamp01((worst - x) / (worst - best)))


def peg(per: Column, eps_yoy: Column) -> Column:
    return F.when((per > 0) & (eps_yoy > 0), F.round(per / (eps_yoy * 100), 3))


def peg_score(per: Column, eps_yoy: Column, net_status: Column, net_delta: Column) -> Column:
    """2 and more is 0, 1 and less is 1; without a rate of growth the margin stands in for companies in profit."""
    stand_in = F.when(net_status.isin("turnaround", "profit") & net_delta.isNotNull(), F.least(margin_score(net_delta), F.lit(STAND_IN_MOST)))
    return F.coalesce(clamp01(2.0 - peg(per, eps_yoy)), stand_in)


Parts = dict[str, tuple[Column, float]]


def growth_parts(c: dict[str, Column]) -> Parts:
    """c: revenue_yoy, and status and margin change of op, net and ebitda."""
    norms = {"revenue": band(c["revenue_yoy"], -0.2, 0.6)}
    for kind in ("op", "net", "ebitda"):
        norms[f"{kind}_status"], norms[f"{kind}_margin"] = status_score(c[f"{kind}_status"]), margin_score(c[f"{kind}_delta"])
    return {k: (norms[k], w) for k, w in GROWTH.items()}


def value_parts(c: dict[str, Column]) -> Parts:
    norms = {
        "pbr": cheapness(c["pbr"], VALUE_BANDS["pbr"]), "per": cheapness(c["per"], VALUE_BANDS["per"]), "ev": cheapness(c["ev_ebitda"], VALUE_BANDS["ev_ebitda"]),
        "peg": peg_score(c["per"], c["eps_yoy"], c["net_status"], c["net_delta"]), "roe": clamp01(c["roe"] / 15.0), "dividend": clamp01(c["dividend"] / 5.0),
    }
    return {k: (norms[k], w) for k, w in VALUE.items()}


def near_high(percent: Column) -> Column:
    return clamp01((percent / 100 - 0.7) / 0.3)


def trend_parts(c: dict[str, Column]) -> Parts:
    """Without alignment a close above the long average counts in full."""
    aligned = F.when(c["aligned"] | c["above_long"], 1.0).when(~c["aligned"], 0.0)
    norms = {"near_high": near_high(c["near_high"]), "aligned": F.when(c["aligned"].isNotNull(), aligned), "return": band(c["return_3m"], -20, 40), "volume": band(c["volume_ratio"], 0.5, 2.0), "stage": one_of(c["stage"], STAGES)}
    return {k: (norms[k], w) for k, w in TREND.items()}


def topdown_parts(c: dict[str, Column]) -> Parts:
    norms = {"lead_sector": c["lead_sector"] / 100, "sector": c["sector"] / 100, "index": c["index"] / 100, "strength": clamp01(c["strength"] / 100)}
    return {k: (norms[k], w) for k, w in TOPDOWN.items()}


def score(parts: Parts) -> Column:
    return weighted(list(parts.values()), rounded=decimal_round)


def flow_score(change: Column, high: Column, volume: Column, foreign: Column, lookback: str) -> Column:
    weights = FLOW.get(lookback, FLOW["3m"])
    return weighted(list(zip((band(change, -20, 40), near_high(high), band(volume, 0.5, 2.0), band(foreign, -1.0, 1.0)), weights)), rounded=decimal_round)


def strength(x: Column) -> Column:
    return F.when(x >= 60, "strong").when(x >= 40, "moderate").when(x.isNotNull(), "weak")


def overall(axes: list[Column], digits: int = 1) -> Column:
    """Mean of the axes that are there."""
    return weighted([(a, 1.0) for a in axes], scale=1.0, digits=digits, rounded=decimal_round)


def breakdown(parts: Parts) -> Column:
    """A score's parts as rows to explode: part, norm, weight."""
    return F.array(*[F.struct(F.lit(k).alias("part"), decimal_round(norm, 3).alias("norm"), F.lit(w).alias("weight")) for k, (norm, w) in parts.items()])


def _sum(parts: list[Column]) -> Column:
    return F.round(F.least(reduce(lambda a, b: a + b, parts), F.lit(1.0)) * 100, 1)


def _or0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def cross_growth(df: DataFrame, partition: list[str]) -> DataFrame:
    """The score among a cross-section: percentiles of growth and momentum; a missing part counts 0."""
    there = F.col("coverage") > 0
    ranked = _ranked(df, {"revenue_yoy": False, "momentum": False}, partition)
    parts = [
        0.20 * F.col("_rank_revenue_yoy"), 0.11 * _or0(status_score(F.col("op_status"))), 0.09 * _or0(margin_score(F.col("op_delta"))),
        0.08 * _or0(status_score(F.col("net_status"))), 0.07 * _or0(margin_score(F.col("net_delta"))), 0.06 * _or0(status_score(F.col("ebitda_status"))), 0.05 * _or0(margin_score(F.col("ebitda_delta"))),
        0.13 * F.col("_rank_momentum"), 0.12 * F.when(there, F.col("buys") / F.col("coverage")).otherwise(0.0), 0.08 * F.when(there, 1.0).otherwise(0.0),
    ]
    return ranked.select(*[c for c in df.columns if c != "growth"], _sum(parts).alias("growth"))


def _ranked(df: DataFrame, cheap: dict[str, bool], partition: list[str]) -> DataFrame:
    """df with _rank_<column>: a percentile; of cheap columns 1 for the smallest positive value, and others count 0."""
    ready = df.withColumns({f"_positive_{c}": F.when(F.col(c) > 0, F.col(c)) for c, yes in cheap.items() if yes})
    return ranks.percentile_ranks(ready, {f"_rank_{c}": (f"_positive_{c}" if yes else c, yes) for c, yes in cheap.items()}, partition)


def cross_value(df: DataFrame, partition: list[str]) -> DataFrame:
    ranked = _ranked(df, {"pbr": True, "per": True, "ev_ebitda": True}, partition)
    parts = [0.35 * F.col("_rank_pbr"), 0.28 * F.col("_rank_per"), 0.17 * F.col("_rank_ev_ebitda"), _or0(clamp01(F.col("roe") / 15.0)) * 0.12, _or0(clamp01(F.col("dividend") / 5.0)) * 0.08]
    return ranked.select(*[c for c in df.columns if c != "value"], _sum(parts).alias("value"))


def cross_screen(df: DataFrame, partition: list[str]) -> DataFrame:
    """Cheap and leading: value percentiles, momentum and nearness to the high."""
    ranked = _ranked(df, {"pbr": True, "per": True, "momentum": False}, partition)
    parts = [0.30 * F.col("_rank_pbr"), 0.25 * F.col("_rank_per"), 0.30 * F.col("_rank_momentum"), 0.15 * _or0(near_high(F.col("near_high")))]
    return ranked.select(*[c for c in df.columns if c != "score"], _sum(parts).alias("score"))


def rate(new: Column, old: Column) -> Column:
    return F.when(old > 0, (new - old) / old)


def red_flags(c: dict[str, Column]) -> Column:
    """Rows (flag, severity) of four rules; what can't be told gives none."""
    faster = lambda k: rate(c[k], c[f"{k}_prior"]) - rate(c["revenue"], c["revenue_prior"]) >= FLAG_GAP
    earned = (c["net_income"] > 0) & c["ocf"].isNotNull()
    rules = [
        (faster("receivables"), "receivables_outpace_revenue", "high"), (faster("inventory"), "inventory_outpace_revenue", "medium"),
        (earned & (c["ocf"] < 0), "profit_no_cash", "high"), (earned & (c["ocf"] >= 0) & (c["ocf"] < c["net_income"] * FLAG_CASH), "ocf_below_profit", "medium"),
        ((c["assets"] > 0) & (F.try_divide(c["intangibles"], c["assets"]) >= FLAG_INTANGIBLE), "high_intangibles", "medium"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(flag).alias("flag"), F.lit(level).alias("severity"))) for when, flag, level in rules]), lambda x: x.isNotNull())


def severity(flags: Column) -> Column:
    return F.when(F.exists(flags, lambda x: x["severity"] == "high"), "danger").when(F.size(flags) > 0, "caution").otherwise("good")


def positive_up_to(x: Column, most: float) -> Column:
    """A multiple that is there, positive and not above a bound."""
    return F.coalesce((x > 0) & (x <= most), F.lit(False))


def any_value(*columns: str) -> Column:
    """Whether a row has any of these."""
    return F.coalesce(*columns).isNotNull()
