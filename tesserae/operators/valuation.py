"""Valuation as columns: multiples, discounted flows, blending.  Loops over years are folds over a sequence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CAP_YEARS = {"strong": 10.0, "medium": 6.0, "weak": 3.0}
MAX_CAP = 12.0
LEAST_SPREAD = 0.045
STAGE_GAP = 0.08
LEAST_YIELD = 1.5
CONFIDENCE = {"high": 3.0, "medium": 2.0, "low": 1.0}
FIT = {
    "growth": {"per": 1.5, "pbr": 0.5, "ev_ebitda": 1.0, "dcf": 1.5, "ddm": 1.0, "ggm_dcf": 1.0},
    "asset": {"per": 1.0, "pbr": 1.5, "ev_ebitda": 1.0, "dcf": 1.0, "ddm": 1.0, "ggm_dcf": 0.5},
    "financial": {"per": 1.0, "pbr": 1.5, "ev_ebitda": 0.0, "dcf": 0.0, "ddm": 1.5, "ggm_dcf": 0.0},
    "cyclical": {"per": 0.5, "pbr": 1.0, "ev_ebitda": 1.5, "dcf": 0.5, "ddm": 1.0, "ggm_dcf": 0.5},
    "other": {"per": 1.0, "pbr": 1.0, "ev_ebitda": 1.0, "dcf": 1.0, "ddm": 1.0, "ggm_dcf": 0.8},
}
METHODS = ("per", "pbr", "ev_ebitda", "dcf", "ddm", "ggm_dcf")


def per_target(eps: Column, multiple: Column) -> Column:
    return F.when(eps > 0, eps * multiple)


def pbr_target(bps: Column, multiple: Column) -> Column:
    return F.when(bps > 0, bps * multiple)


def ev_target(ebitda: Column, multiple: Column, net_debt: Column, shares: Column, unit: float = 1.0) -> Column:
    equity = ebitda * multiple - F.coalesce(net_debt, F.lit(0.0))
    return F.when((ebitda > 0) & (shares > 0) & (equity > 0), equity * unit / shares)


def ddm_target(dps: Column, growth: Column, rate: Column) -> Column:
    return F.when((dps > 0) & (rate > growth), dps * (1 + growth) / (rate - growth))


def ggm_dcf_target(fcf: Column, growth: Column, rate: Column, net_debt: Column, shares: Column, unit: float = 1.0) -> Column:
    """Next year's flow over what the rate is above the growth, for ever; missing unless the rate is above it and equity is left."""
    equity = fcf * (1 + growth) / (rate - growth) - F.coalesce(net_debt, F.lit(0.0))
    return F.when((fcf > 0) & (shares > 0) & (rate > growth), F.when(equity > 0, equity * unit / shares))


def cost_of_equity(risk_free: Column, beta: Column, premium: Column) -> Column:
    return risk_free + beta * premium


def wacc(equity_cost: Column, equity: Column, net_debt: Column, tax: Column, debt_cost: Column) -> Column:
    """The cost of equity alone where the structure is unknown."""
    d = F.greatest(F.lit(0.0), F.coalesce(net_debt, F.lit(0.0)))
    blended = equity_cost * equity / (equity + d) + debt_cost * (1 - tax) * d / (equity + d)
    return F.when((equity > 0) & (d > 0) & tax.isNotNull() & debt_cost.isNotNull(), blended).otherwise(equity_cost)


def cap_years(roe: Column, rate: Column, moat: Column) -> Column:
    """Years of competitive advantage; roe as a fraction."""
    base = F.lit(CAP_YEARS["medium"])
    for name, years in CAP_YEARS.items():
        base = F.when(moat == name, years).otherwise(base)
    spread = F.greatest(F.lit(0.0), roe - rate)
    lasting = F.when(roe.isNotNull() & (rate > 0), spread / (spread + rate)).otherwise(0.0)
    return F.round(F.least(F.lit(MAX_CAP), base * (0.5 + lasting)), 1)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def forward_multiple(growth: Column, roe: Column, rate: Column, terminal: Column, years: Column) -> Column:
    """Price over next year's profit of a three-stage dividend model where growth and payout hang together."""
    n = F.bround(years).cast("int")
    given = F.struct(n.alias("n"), F.least(growth, roe).alias("g0"), roe.alias("roe"), rate.alias("rate"), terminal.alias("terminal"))
    start = F.struct(F.lit(0.0).alias("pv"), F.lit(1.0).alias("eps"), F.lit(1.0).alias("d"))

    def folded(x: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            return _once(F.greatest(F.lit(0), k - x["n"]) / x["n"], lambda fade: year(a, x["g0"] + (x["terminal"] - x["g0"]) * fade, x["roe"] + (x["rate"] - x["roe"]) * fade))

        def year(a: Column, g: Column, r: Column) -> Column:
            def grown(y: Column) -> Column:
                paid = F.when(y["r"] > 0, F.greatest(F.lit(0.0), 1 - y["g"] / y["r"])).otherwise(0.0)
                return F.struct((a["pv"] + paid * y["eps"] / y["d"]).alias("pv"), y["eps"].alias("eps"), y["d"].alias("d"))

            return _once(F.struct(g.alias("g"), r.alias("r"), (a["eps"] * (1 + g)).alias("eps"), (a["d"] * (1 + x["rate"])).alias("d")), grown)

        def multiple(end: Column) -> Column:
            value = end["pv"] + (1 - x["terminal"] / x["rate"]) * end["eps"] * (1 + x["terminal"]) / (x["rate"] - x["terminal"]) / end["d"]
            return _once(value / (1 + x["g0"]), lambda out: F.when(out > 0, F.bround(out, 1)))

        return F.aggregate(F.sequence(F.lit(1), 2 * x["n"]), start, step, multiple)

    valid = (roe > 0) & (rate > 0) & (years > 0) & (n > 0) & (terminal < rate) & growth.isNotNull()
    return F.when(valid, _once(given, folded))


def dcf_target(fcf: Column, growth: Column, years: Column, terminal: Column, rate: Column, net_debt: Column, shares: Column, roe: Column, moat: Column, unit: float = 1.0) -> Column:
    """Two stages, or three with a plateau and a fade where growth is far above the terminal rate."""
    r = F.greatest(rate, terminal + LEAST_SPREAD)
    half = F.greatest(F.lit(1), F.bround(cap_years(roe, r, moat) / 2).cast("int"))
    three = ((growth - terminal) > STAGE_GAP) & roe.isNotNull()
    plateau = F.when(three, half).otherwise(F.greatest(F.lit(1), F.least(years.cast("int"), F.lit(15))))
    fade = F.when(three, half).otherwise(0)
    given = F.struct(r.alias("r"), plateau.alias("plateau"), fade.alias("fade"), growth.alias("growth"), terminal.alias("terminal"))
    start = F.struct(F.lit(0.0).alias("pv"), fcf.cast("double").alias("f"), F.lit(1.0).alias("d"))

    def folded(x: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            share = F.when(k > x["plateau"], F.try_divide((k - x["plateau"]).cast("double"), x["fade"])).otherwise(0.0)
            grown = F.struct((a["f"] * (1 + x["growth"] + (x["terminal"] - x["growth"]) * share)).alias("f"), (a["d"] * (1 + x["r"])).alias("d"))
            return _once(grown, lambda y: F.struct((a["pv"] + y["f"] / y["d"]).alias("pv"), y["f"].alias("f"), y["d"].alias("d")))

        def target(end: Column) -> Column:
            equity = end["pv"] + end["f"] * (1 + x["terminal"]) / (x["r"] - x["terminal"]) / end["d"] - F.coalesce(net_debt, F.lit(0.0))
            return _once(equity, lambda e: F.when(e > 0, e * unit / shares))

        return F.aggregate(F.sequence(F.lit(1), x["plateau"] + x["fade"]), start, step, target)

    return F.when((fcf > 0) & (shares > 0) & (rate > terminal), _once(given, folded))


def fit_of(method: str, kind: Column, div_yield: Column, is_loss: Column) -> Column:
    """How far a method fits a kind of company; none for dividends without a yield and for profits of a loss."""
    fit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, row in FIT.items() for x in (k, row[method])]), kind), F.lit(FIT["other"][method]))
    if method == "ddm":
        return F.when(F.coalesce(div_yield, F.lit(0.0)) < LEAST_YIELD, 0.0).otherwise(fit)
    return F.when(is_loss, 0.0).otherwise(fit) if method in ("per", "dcf") else fit


def fits(kinds: DataFrame) -> DataFrame:
    """kinds: code, kind, div_yield, is_loss.  (code, method, fit)."""
    each = [F.struct(F.lit(m).alias("method"), fit_of(m, F.col("kind"), F.col("div_yield"), F.col("is_loss")).alias("fit")) for m in METHODS]
    return kinds.select("code", F.inline(F.array(*each)))


def target_row(target: Column, confidence: Column, fit: Column, is_growth: Column) -> Column:
    """What ``blended`` reads of one method."""
    conf = F.lit(2.0)
    for name, w in CONFIDENCE.items():
        conf = F.when(confidence == name, w).otherwise(conf)
    return F.struct(target.cast("double").alias("target"), conf.alias("c"), fit.cast("double").alias("fit"), F.when(is_growth, 1.2).otherwise(0.6).alias("most"))


def blended(rows: Column) -> Column:
    """rows: an array of ``target_row``, of one code's methods.  (target, methods, kept): means without what fits not or lies far off the middle, unless nothing else is left."""

    def some(t: Column, of: Callable[[Column], Column]) -> Column:
        return _once(F.filter(t, of), lambda x: F.when(F.size(x) > 0, x).otherwise(t))

    def inside(t: Column) -> Column:
        mid = F.get(F.sort_array(F.transform(t, lambda x: x["target"])), F.floor(F.size(t) / 2).cast("int"))
        dev = lambda x, m: (x["target"] - m) / m
        return _once(mid, lambda m: some(t, lambda x: (dev(x, m) <= x["most"]) & (dev(x, m) >= -0.6)))

    def add(t: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(t, F.lit(0.0), lambda a, x: a + F.coalesce(of(x), F.lit(0.0)))

    def mean(t: Column) -> Column:
        by_fit = add(t, lambda x: x["c"] * x["fit"])
        return F.when(by_fit > 0, F.try_divide(add(t, lambda x: x["target"] * (x["c"] * x["fit"])), by_fit)).otherwise(add(t, lambda x: x["target"] * x["c"]) / add(t, lambda x: x["c"]))

    def told(t: Column) -> Column:
        kept = _once(some(t, lambda x: x["fit"] > 0), inside)
        return _once(kept, lambda k: F.struct(mean(k).alias("target"), F.size(t).cast("long").alias("methods"), F.size(k).cast("long").alias("kept")))

    return _once(F.filter(rows, lambda x: x["target"] > 0), lambda t: F.when(F.size(t) > 0, told(t)))


def blend(targets: DataFrame) -> DataFrame:
    """targets: code, method, target, confidence, fit, is_growth.  (code, target, methods, kept)."""
    row = F.struct("method", target_row(F.col("target"), F.col("confidence"), F.col("fit"), F.col("is_growth")).alias("row"))
    per = targets.where("target > 0").groupBy("code").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # the methods of one code
    return per.select("code", blended(F.col("rows.row")).alias("b")).select("code", "b.target", "b.methods", "b.kept")


def judgment(axes: list[Column]) -> tuple[Column, Column]:
    """Mean of the axes that are there, and fit, watch or avoid."""
    there = F.filter(F.array(*axes), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there))
    weak = F.size(F.filter(there, lambda x: x < 40))
    return mean, F.when((mean >= 60) & (weak == 0), "fit").when((mean < 40) | (weak >= 2), "avoid").when(mean.isNotNull(), "watch")
