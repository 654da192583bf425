"""One screen over all strategies: what is asked of a company, its score by the strategy, the page."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.columns import all_of, null_tolerant_least
from tesserae.operators import ranks, scores

STRATEGIES = ("growth", "value", "trend", "topdown", "overall")
#: Fixed value: the end of a preferred share's name.
PREFERRED = "우[A-C]?$"
#: How a page can be sorted instead of by score: column and whether the largest comes first.
SORTS = {"market_cap": ("cap", False), "change": ("change_pct", True), "trading_value": ("traded", True)}


@dataclass(frozen=True)
class Criteria:
    """What a user asks; None asks nothing.  Growth and momentum bounds leave out companies where the figure is missing, liquidity lets them pass."""

    cap_min: float | None = None
    cap_max: float | None = None
    liquidity_min: float | None = None
    revenue_yoy_min: float | None = None
    op_yoy_min: float | None = None
    revenue_qoq_min: float | None = None
    op_qoq_min: float | None = None
    op_growth: str | None = None
    op_status: str | None = None
    net_status: str | None = None
    momentum_min: float | None = None
    momentum_max: float | None = None
    per_max: float | None = None
    pbr_max: float | None = None
    roe_min: float | None = None
    dividend_min: float | None = None
    market: str | None = None
    sector: str | None = None
    coverage: str | None = None
    recent_buy: bool = False
    funds: bool = False


def conditions(c: Criteria, of: dict[str, Column], strategy: str) -> list[Column]:
    """One condition for each thing that is asked; multiples only where the strategy is value."""
    out = [of["cap"].isNotNull(), of["close"].isNotNull()]
    least = {"cap_min": "cap", "revenue_yoy_min": "revenue_yoy", "op_yoy_min": "op_yoy", "revenue_qoq_min": "revenue_qoq", "op_qoq_min": "op_qoq", "momentum_min": "momentum"}
    most = {"cap_max": "cap", "momentum_max": "momentum"}
    same = {"op_status": "op_status", "net_status": "net_status", "market": "market", "sector": "sector"}
    out += [of[column] >= value for name, column in least.items() if (value := getattr(c, name)) is not None]
    out += [of[column] <= value for name, column in most.items() if (value := getattr(c, name)) is not None]
    out += [of[column] == value for name, column in same.items() if (value := getattr(c, name)) is not None]
    if c.liquidity_min is not None:
        out.append(null_tolerant_least(of["traded"], c.liquidity_min))
    if c.op_growth == "turnaround":
        out.append(of["op_status"] == "turnaround")
    elif c.op_growth == "growth":
        out.append(of["op_yoy"] > 0)
    if c.coverage == "has":
        out.append(of["coverage"] > 0)
    elif c.coverage == "none":
        out.append(F.coalesce(of["coverage"], F.lit(0)) == 0)
    if c.recent_buy:
        out.append(of["buys"] > 0)
    if not c.funds:
        out += [of["kind"] == "stock", ~of["name"].rlike(PREFERRED)]
    if strategy == "value":
        out += [scores.positive_up_to(of[column], value) for column, value in (("per", c.per_max), ("pbr", c.pbr_max)) if value is not None]
        out += [of[column] >= value for column, value in (("roe", c.roe_min), ("dividend", c.dividend_min)) if value is not None]
        out.append(F.coalesce(of["per"], of["pbr"], of["roe"], of["dividend"], of["ev_ebitda"]).isNotNull())
    return out


def screen(scored: DataFrame, criteria: Criteria, strategy: str, sort: str | None = None) -> DataFrame:
    """scored: companies with a score for each strategy.  Those that meet the criteria, with score, place and total.

    Companies without a score come last, and not at all if all axes are asked for; ties go by code.
    """
    found = scored.where(all_of(conditions(criteria, {c: F.col(c) for c in scored.columns}, strategy))).withColumn("score", F.col(strategy))
    if strategy == "overall":
        found = found.where("score is not null")
    column, down = SORTS.get(sort or "", ("score", True))
    key = F.coalesce(column, F.lit(0.0 if sort else -1.0))
    placed = ranks.numbered(found, [key.desc() if down else key.asc(), F.asc("code")], "place")
    return placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("total"))))  # one row


def page(screened: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows of one page: by their place, so nothing before them is sorted again."""
    return screened.where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def asked(criteria: Criteria) -> dict[str, object]:
    """What is asked, by name."""
    return {f.name: value for f in fields(criteria) if (value := getattr(criteria, f.name)) not in (None, False)}
