"""Fiscal series: discrete quarters, trailing twelve months, growth; rows are (code, y, q, values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def number(y: str = "y", q: str = "q") -> Column:
    return F.col(y) * 4 + F.col(q) - 1


def period_parts(period: Column) -> tuple[Column, Column, Column]:
    """Year, quarter and estimate mark of 'YYYY.MM' or 'YYYY.MM(E)'."""
    y = F.regexp_extract(period, r"^(\d{4})\.(\d{2})", 1).try_cast("int")
    m = F.regexp_extract(period, r"^(\d{4})\.(\d{2})", 2).try_cast("int")
    return y, F.ceil(m / 3).cast("int"), F.contains(period, F.lit("(E)"))


def quarter_end(y: Column, q: Column) -> Column:
    return F.last_day(F.make_date(y, q * 3, F.lit(1)))


def discrete(df: DataFrame, value: str) -> DataFrame:
    """Quarter 4 holds the year's total: it becomes the total less the first three, missing if any is."""
    w = Window.partitionBy("code", "y")
    first = F.sum(F.when(F.col("q") < 4, F.col(value))).over(w)
    n = F.count(F.when(F.col("q") < 4, F.col(value))).over(w)
    return df.withColumn(value, F.when(F.col("q") < 4, F.col(value)).when(n == 3, F.col(value) - first))


def trailing(df: DataFrame, value: str, name: str) -> DataFrame:
    """Sum of four consecutive quarters; a gap or a missing value gives none."""
    w = Window.partitionBy("code").orderBy("_n").rangeBetween(-3, 0)
    return df.withColumn("_n", number()).withColumn(name, F.when(F.count(value).over(w) == 4, F.sum(value).over(w))).drop("_n")


def same_quarter_before(df: DataFrame, value: str) -> Column:
    """Last year's value of the same quarter: by number, since rows may have gaps."""
    return F.first(value).over(Window.partitionBy("code").orderBy("_n").rangeBetween(-4, -4))


def yoy(new: Column, old: Column, digits: int = 4) -> Column:
    return F.when(old > 0, F.round((new - old) / old, digits))


def profit_status(new: Column, old: Column) -> Column:
    """Zero counts as a loss."""
    return (
        F.when(new.isNull() | old.isNull(), None)
        .when((new > 0) & (old > 0), "profit").when((new > 0) & (old <= 0), "turnaround")
        .when((new <= 0) & (old > 0), "deficit").otherwise("loss")
    )


def growth(df: DataFrame, revenue: str = "revenue", profit: str = "profit") -> DataFrame:
    base = df.withColumn("_n", number())
    r0, p0 = same_quarter_before(base, revenue), same_quarter_before(base, profit)
    rq = F.first(revenue).over(Window.partitionBy("code").orderBy("_n").rangeBetween(-1, -1))
    margin = lambda p, r: F.when(r > 0, p / r)
    out = base.withColumns({"_r0": r0, "_p0": p0, "_rq": rq})
    return out.select(
        "code", "y", "q", yoy(F.col(revenue), F.col("_r0")).alias("revenue_yoy"), yoy(F.col(revenue), F.col("_rq")).alias("revenue_qoq"), yoy(F.col(profit), F.col("_p0")).alias("profit_yoy"),
        profit_status(F.col(profit), F.col("_p0")).alias("status"), F.round(margin(F.col(profit), F.col(revenue)) - margin(F.col("_p0"), F.col("_r0")), 4).alias("margin_delta"),
    )


def incremental_margin(df: DataFrame, revenue: str, profit: str) -> DataFrame:
    """Sum of profit changes over sum of revenue changes against a year before, where revenue grew; four points at least."""
    base = df.withColumn("_n", number())
    d = base.select("code", (F.col(revenue) - same_quarter_before(base, revenue)).alias("dr"), (F.col(profit) - same_quarter_before(base, profit)).alias("dp")).where("dr > 0 and dp is not null")
    return d.groupBy("code").agg(F.count("*").alias("n"), F.sum("dp").alias("p"), F.sum("dr").alias("r")).where("n >= 4").select("code", "n", (F.col("p") / F.col("r")).alias("margin"))


def growth_ensemble(df: DataFrame, value: str) -> DataFrame:
    """0.4 mean of the last 12 yearly rates, 0.3 the last, 0.3 its convex extrapolation; three rates at least."""
    base = df.withColumn("_n", number())
    old = same_quarter_before(base, value)
    g = base.withColumn("_old", old).where(F.col("_old") > 0).select("code", "_n", (F.col(value) / F.col("_old") - 1).alias("g"))
    newest = Window.partitionBy("code").orderBy(F.desc("_n"))
    last = g.withColumn("k", F.row_number().over(newest)).where("k <= 12").groupBy("code").agg(F.count("*").alias("n"), F.avg("g").alias("mean"), *[F.max(F.when(F.col("k") == i, F.col("g"))).alias(f"g{i}") for i in (1, 2, 3)])
    slope, curve = F.col("g1") - F.col("g2"), F.col("g1") - 2 * F.col("g2") + F.col("g3")
    return last.where("n >= 3").select("code", "n", (0.4 * F.col("mean") + 0.3 * F.col("g1") + 0.3 * (F.col("g1") + slope + 0.5 * curve)).alias("growth"))


def spans_ttm(facts: DataFrame) -> DataFrame:
    """facts: code, start, end, val, ord.  The last fiscal year plus later quarters less the same quarters a year before.

    Quarters span 80 to 100 days, years 350 to 380; of rows with one span the last
    stays; the earlier quarter is the first reported that ends within 20 days of 365
    days before, and a missing one leaves the total missing.  A code without a year
    has the sum of its last four quarters, if they span a year.
    """
    rows = facts.where("start is not null and end is not null and val is not null").groupBy("code", "start", "end").agg(F.max_by("val", "ord").alias("val"), F.min("ord").alias("ord")).withColumn("days", F.datediff("end", "start"))
    quarters = rows.where("days between 80 and 100").select("code", "start", "end", "val", "ord")
    year = rows.where("days between 350 and 380").groupBy("code").agg(F.max("end").alias("fy_end"), F.max_by("val", F.struct("end", "ord")).alias("fy"))
    later = quarters.join(year, "code").where("end > fy_end").select("code", F.col("end").alias("q_end"), F.col("val").alias("q_val"))
    old = quarters.select("code", F.col("end").alias("o_end"), F.col("val").alias("o_val"), F.col("ord").alias("o_ord"))
    near = F.abs(F.datediff(F.date_sub("q_end", 365), "o_end")) <= 20
    pairs = later.join(old, "code").where(near).groupBy("code", "q_end").agg(F.min_by("o_val", "o_ord").alias("o_val"))
    parts = later.join(pairs, ["code", "q_end"], "left").groupBy("code").agg(F.sum("q_val").alias("new"), F.sum("o_val").alias("gone"), F.count_if(F.col("o_val").isNull()).alias("holes"))
    moved = year.join(parts, "code", "left").select("code", F.when(F.coalesce("holes", F.lit(0)) == 0, F.col("fy") + F.coalesce("new", F.lit(0.0)) - F.coalesce("gone", F.lit(0.0))).alias("ttm"))
    newest = quarters.join(year, "code", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("end")))).where("k <= 4")
    four = newest.groupBy("code").agg(F.count("*").alias("n"), F.sum("val").alias("val"), F.datediff(F.max("end"), F.min_by("start", "end")).alias("days"))
    return moved.unionByName(four.select("code", F.when((F.col("n") == 4) & F.col("days").between(350, 380), F.col("val")).alias("ttm")))


def rolling_rows(df: DataFrame, value: str, name: str, n: int = 4) -> DataFrame:
    """Sum of n rows in a row, whatever their quarters; a missing value gives none."""
    w = Window.partitionBy("code").orderBy("_n").rowsBetween(1 - n, 0)
    return df.withColumn("_n", number()).withColumn(name, F.when(F.count(value).over(w) == n, F.sum(value).over(w))).drop("_n")


def cagr(df: DataFrame, value: str, per_year: int = 4) -> DataFrame:
    """Yearly rate from a code's first value to its last, both positive, over a year at least."""
    there = df.where(F.col(value).isNotNull()).groupBy("code").agg(F.min_by(value, number()).alias("first"), F.max_by(value, number()).alias("last"), F.count("*").alias("n"))
    return there.select("code", F.when((F.col("n") > per_year) & (F.col("first") > 0) & (F.col("last") > 0), F.pow(F.col("last") / F.col("first"), per_year / (F.col("n") - 1)) - 1).alias("cagr"))


#: Fixed value: the weight of the short view in long-term growth.
SHORT_WEIGHT = 0.5


def long_growth(df: DataFrame, value: str) -> DataFrame:
    """Blended (half the ensemble, half the yearly rate) and sustainable growth (the yearly rate, else half the ensemble)."""
    both = cagr(df, value).join(growth_ensemble(df, value).select("code", "growth"), "code", "left")
    blended = F.when(F.col("cagr").isNotNull(), SHORT_WEIGHT * F.col("growth") + (1 - SHORT_WEIGHT) * F.col("cagr")).otherwise(F.col("growth") * SHORT_WEIGHT)
    return both.select("code", "cagr", blended.alias("blended"), F.coalesce("cagr", F.col("growth") * SHORT_WEIGHT).alias("sustainable"))


def normalized_profit(df: DataFrame, revenue: str, profit: str, now: str, least: int = 6) -> DataFrame:
    """now, moved from the margin of today to that of the middle of the cycle: the upper median of margins of four rows each."""
    w = rolling_rows(rolling_rows(df, revenue, "_r"), profit, "_p").where("_r > 0 and _p is not null").withColumn("_m", F.col("_p") / F.col("_r")).withColumn("_n", number())
    # a code's own quarters
    got = w.groupBy("code").agg(F.sort_array(F.collect_list("_m")).alias("all"), F.max_by("_m", "_n").alias("today"), F.max_by(now, "_n").alias("now"), F.count("*").alias("windows"))
    middle = F.get("all", F.floor(F.col("windows") / 2).cast("int"))
    return got.select("code", "windows", F.when((F.col("windows") >= least) & (F.col("today") > 0) & (middle > 0), F.col("now") * middle / F.col("today")).alias("normalized"))


def recent_mean(df: DataFrame, value: str, n: int) -> DataFrame:
    """Mean of a code's last n values that are there."""
    k = F.row_number().over(Window.partitionBy("code").orderBy(F.desc(number())))
    return df.where(F.col(value).isNotNull()).withColumn("_k", k).where(F.col("_k") <= n).groupBy("code").agg(F.round(F.avg(value), 4).alias("mean"), F.count("*").alias("n"))


def annual_change(df: DataFrame, profit: str, revenue: str) -> DataFrame:
    """df: code, y, values of whole years.  Status and margin change of the last year, if the one before is its neighbour."""
    w = Window.partitionBy("code").orderBy("y")
    prior = lambda c: F.lag(c).over(w)
    rows = df.withColumns({"_y": prior("y"), "_p": prior(profit), "_r": prior(revenue), "_k": F.row_number().over(Window.partitionBy("code").orderBy(F.desc("y")))}).where("_k = 1 and y - _y = 1")
    margin = lambda p, r: F.when(F.col(r) > 0, F.col(p) / F.col(r))
    return rows.select("code", "y", profit_status(F.col(profit), F.col("_p")).alias("status"), F.round(margin(profit, revenue) - margin("_p", "_r"), 4).alias("margin_delta"))


def month_before(df: DataFrame, value: str, most: int = 12) -> Column:
    """df: code, month (a number that counts months).  The last value of the months before, up to a year back."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("code").orderBy("month").rangeBetween(-most, -1))


def free_cash_flow(profit: Column, tax: Column, depreciation: Column, capex: Column) -> Column:
    """After-tax profit plus depreciation less investment, the tax rate held within 0 and 0.35."""
    return F.round(profit * (1 - F.when(tax.isNotNull(), F.least(F.greatest(tax, F.lit(0.0)), F.lit(0.35)))) + depreciation - capex, 2)


def target_book_multiple(roe: Column, coe: Column, growth: Column, fair_per: Column) -> Column:
    """(roe - g) / (coe - g) on book, else the fair earnings multiple times roe."""
    book = (roe - growth) / (coe - growth)
    return F.coalesce(F.when((roe > 0) & (coe > growth) & (book > 0), F.round(book, 2)), F.when(roe > 0, F.round(fair_per * roe, 2)))


def claim_uplift(claims: DataFrame, base: DataFrame) -> DataFrame:
    """claims: code, value, unit (pct, absolute), scope (segment, company), share, metric (revenue, profit), refuted; base: code, revenue, income, margin.

    The sum of what claims that stand add to profit: growth of revenue times the
    incremental margin, or growth of profit itself; what can't be worked out adds nothing.
    """
    c = claims.where("not coalesce(refuted, false) and value > 0").join(base, "code")
    pct = F.when(F.col("scope") == "segment", F.when(F.col("share") > 0, F.col("value") / 100 * F.col("share") / 100)).when(F.col("scope") == "company", F.col("value") / 100)
    sales = F.when(F.col("unit") == "absolute", F.when(F.col("revenue") > 0, F.col("value") / F.col("revenue"))).when(F.col("unit") == "pct", pct)
    gain = F.when(F.col("metric") == "revenue", F.when((F.col("income") > 0) & (F.col("revenue") > 0), sales * F.col("revenue") * F.col("margin") / F.col("income"))).when(F.col("metric") == "profit", sales)
    return c.withColumn("gain", F.when(sales > 0, gain)).where("gain > 0").groupBy("code").agg(F.sum("gain").alias("uplift"), F.count("*").alias("claims"))


FACTS = "struct<facts:map<string,map<string,struct<label:string,units:map<string,array<struct<start:string,end:string,val:double>>>>>>>"


def flatten_facts(filings: DataFrame) -> DataFrame:
    """filings: code, doc (JSON).  A row for each reported value: namespace, concept, label, unit, start, end, val, ord."""
    spaces = filings.select("code", F.explode(F.from_json("doc", FACTS)["facts"]).alias("namespace", "concepts"))
    concepts = spaces.select("code", "namespace", F.explode("concepts").alias("concept", "c"))
    units = concepts.select("code", "namespace", "concept", F.coalesce(F.col("c.label"), "concept").alias("label"), F.explode("c.units").alias("unit", "rows"))
    rows = units.select("code", "namespace", "concept", "label", "unit", F.posexplode("rows").alias("ord", "r"))
    return rows.select("code", "namespace", "concept", "label", "unit", F.to_date("r.start").alias("start"), F.to_date("r.end").alias("end"), F.col("r.val").alias("val"), "ord").where("end is not null and val is not null")


def newest_concept(facts: DataFrame, concepts: list[str]) -> DataFrame:
    """Of several concepts for one quantity the one with the newest period; a tie goes to the first named."""
    place = F.array_position(F.array(*[F.lit(c) for c in concepts]), F.col("concept"))
    kept = facts.where(F.col("concept").isin(concepts) & F.col("start").isNotNull())
    return kept.groupBy("code").agg(F.max_by("concept", F.struct("end", -place)).alias("concept"))


def latest_instant(facts: DataFrame, concept: str, name: str) -> DataFrame:
    """The newest value of a quantity at a day; of several on that day the first reported."""
    return facts.where(F.col("concept") == concept).groupBy("code").agg(F.max_by("val", F.struct("end", -F.col("ord"))).alias(name))


def reconcile(candidates: DataFrame, balance: DataFrame, scales: list[float], must: str) -> DataFrame:
    """candidates: code, tab, leaf, amount; balance: code, leaf, amount.  The tables with the most components that equal the balance at one scale.

    A table must match in the component must at that or another scale.
    """
    both = candidates.join(balance.select("code", "leaf", F.col("amount").alias("b")), ["code", "leaf"])
    hits = both.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales]))).where(F.abs(F.col("b") * F.col("scale") - F.col("amount")) < 0.5)
    per = hits.groupBy("code", "tab", "scale").agg(F.count("*").alias("n"), F.max(F.col("leaf") == must).alias("ok")).groupBy("code", "tab").agg(F.max("n").alias("matches"), F.max("ok").alias("ok")).where("ok")
    most = F.max("matches").over(Window.partitionBy("code"))
    return per.withColumn("most", most).where("matches = most").select("code", "tab", "matches")
