"""Price-series operators: every one is a window over (code, bar_date), so all of them share one shuffle on code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.functions.columns import full, n_bar_return, rows, series, sma
from tesserae.operators import ranks, sliding
from tesserae.operators.shared import stored

MAS = (20, 60, 120)
STRENGTH = ((63, 0.4), (126, 0.2), (189, 0.2), (252, 0.2))


#: Bars that the features of a code's last bar look back on: a year, and the one before.
LOOK_BACK = 253


def last_bars(bars: DataFrame, n: int = LOOK_BACK) -> DataFrame:
    """The newest bars of each code: what features of the last bar need, however long the series are."""
    newest = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("bar_date")))
    return bars.withColumn("_newest", newest).where(F.col("_newest") <= n).drop("_newest")


def technicals(bars: DataFrame) -> DataFrame:
    """Per bar: moving averages, nearness of the year's high, alignment, volume ratio, returns."""
    w = series()
    out = bars.select("*", *[sma(F.col("close"), n, w).alias(f"ma{n}") for n in MAS])
    top = F.max("high").over(rows(w, -251))
    usual = full(F.avg("volume").over(rows(w, -50, -1)), F.col("volume"), rows(w, -50, -1), 50)
    known = F.col("ma20").isNotNull() & F.col("ma60").isNotNull() & F.col("ma120").isNotNull()
    chain = (F.col("close") > F.col("ma20")) & (F.col("ma20") > F.col("ma60")) & (F.col("ma60") > F.col("ma120"))
    return out.select(
        "code", "bar_date", "close", *[f"ma{n}" for n in MAS],
        (F.col("close") / top).alias("near_high"),
        F.when(known, chain).alias("aligned"),
        F.when(usual > 0, F.col("volume") / usual).alias("volume_ratio"),
        n_bar_return(F.col("close"), 20, w).alias("return_20"),
        n_bar_return(F.col("close"), 60, w).alias("return_60"),
    )


def strength_factor(w: WindowSpec) -> Column:
    """Weighted rates of change over a quarter to a year; missing before 253 bars."""
    c = F.col("close")
    parts = [(F.lag(c, n).over(w), k) for n, k in STRENGTH]
    total = sum(((c / past - 1) * k for past, k in parts[1:]), (c / parts[0][0] - 1) * parts[0][1])
    there = parts[-1][0].isNotNull()
    for past, _ in parts:
        there = there & (past > 0)
    return F.when(there, total)


def strength_ratings(bars: DataFrame) -> DataFrame:
    """The last bar of each code with its strength factor and its rating among all codes."""
    w = series()
    last = last_bars(bars).select("code", "bar_date", "close", strength_factor(w).alias("strength"), F.lead("bar_date").over(w).alias("_next")).where("_next is null").drop("_next")
    return ranks.rating(stored(last, "strength"), "strength")


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Bars of ISO weeks or months, dated by the last trading day."""
    at = lambda c: F.struct("bar_date", c)
    return (
        bars.groupBy("code", F.date_trunc(unit, "bar_date").cast("date").alias("bucket"))
        .agg(F.max("bar_date").alias("bar_date"), F.min_by("open", "bar_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_date").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("bars"))
        .drop("bucket")
    )


def relative_strength(bars: DataFrame, index: DataFrame, n: int = 200) -> DataFrame:
    """Mansfield: the ratio to the index against its own moving average, in percent, on shared dates."""
    both = bars.select("code", "bar_date", "close").join(index, "bar_date").where((F.col("close") > 0) & (F.col("level") > 0))
    ratio = both.withColumn("ratio", F.col("close") / F.col("level"))
    base = sma(F.col("ratio"), n, series())
    return ratio.select("code", "bar_date", "ratio", F.when(base > 0, (F.col("ratio") / base - 1) * 100).alias("mansfield"))


def beta(bars: DataFrame, index: DataFrame, least: int = 60) -> DataFrame:
    """Slope of a code's daily returns on the index's over shared dates, held between -1 and 3."""
    w = series()
    both = bars.select("code", "bar_date", "close").join(index, "bar_date").where((F.col("close") > 0) & (F.col("level") > 0))
    returns = both.select("code", (F.col("close") / F.lag("close").over(w) - 1).alias("y"), (F.col("level") / F.lag("level").over(w) - 1).alias("x")).where("x is not null and y is not null")
    slope = F.try_divide(F.covar_pop("y", "x"), F.var_pop("x"))
    out = returns.groupBy("code").agg(F.count("*").alias("n"), slope.alias("raw"))
    return out.select("code", "n", F.when((F.col("n") >= least) & F.col("raw").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(3.0), F.col("raw")))).alias("beta"))


def stage_features(bars: DataFrame, n: int = 60, ma: int = 50, lookback: int = 10) -> DataFrame:
    """What the stage decision looks at, per bar: trend, fit, efficiency, curvature, volume, range, channel.

    What a bar says of itself and of the one before are columns; frames of many bars are slid over in ``sliding``.
    """
    return _frame_features(bars, {"": (n, ma, lookback)}).drop("frame")


def _frame_features(bars: DataFrame, frames: dict[str, tuple[int, int, int]], last: bool = False) -> DataFrame:
    """``stage_features`` of several frames (column frame) of the same bars; last: those of each code's newest bar alone, from the bars that it looks back on."""
    w = series()
    close, prev, volume = F.col("close"), F.col("prev"), F.col("volume")
    base = bars.select("code", "bar_date", "close", "high", "low", "volume", F.row_number().over(w).alias("i"), F.lag("close").over(w).alias("prev"))
    base = base.withColumns({
        "ln": F.when(close > 0, F.ln("close")),
        "step": F.abs(close - prev),
        "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)) / close,
        "up": F.when(close > prev, volume).otherwise(0.0),
        "down": F.when(close < prev, volume).otherwise(0.0),
        "obv": F.sum(F.when(close > prev, volume).when(close < prev, -volume).otherwise(0.0)).over(rows(w, Window.unboundedPreceding)),
    })
    if last:  # sums that begin with the series are columns by now
        ahead = F.count("*").over(Window.partitionBy("code")) - F.col("i")
        base = base.withColumn("ahead", ahead).where(F.col("ahead") < max(sliding.held(*f) for f in frames.values()))
    f = sliding.stage_frames(base, frames, last)
    enough, varied = F.col("enough"), F.col("spread") > 0
    net = F.abs(close - F.col("past"))
    high, low, heavy = F.col("top"), F.col("bottom"), volume >= 1.5 * F.col("usual")
    return f.select(
        "frame", "code", "bar_date", "close", "ma",
        F.when(enough & varied, F.col("slope")).when(enough, 0.0).alias("slope"),
        F.when(enough & varied, F.col("r2")).when(enough, 0.0).alias("r2"),
        F.when(enough, F.coalesce(F.try_divide(net, F.col("path")), F.lit(0.0))).alias("efficiency"),
        F.when(enough, F.col("slope_late") - F.col("slope_early")).alias("curvature"),
        F.when(enough, F.try_divide("up_sum", "down_sum")).alias("volume_balance"),
        F.when(enough, F.try_divide("atr_new", "atr_old")).alias("range_ratio"),
        F.when(enough, F.when(high > low, F.least(F.lit(100.0), F.greatest(F.lit(0.0), (close - low) / (high - low) * 100))).otherwise(50.0)).alias("channel"),
        F.when(enough, (close > high) & heavy).alias("breakout"),
        F.when(enough, (close < low) & heavy).alias("breakdown"),
        F.when(enough, F.col("obv_slope")).alias("obv_slope"),
        ((close - F.col("ma")) / F.col("ma")).alias("position"),
        (F.col("ma") / F.col("ma_back") - 1).alias("ma_change"),
        (F.col("ma") >= F.col("ma_far")).alias("context_up"),
    )


# Fixed values of the stage decision.
FLAT, PRICE_BAND, CLEAN_ER, CLEAN_R2, CURVE, STEEP, MILD = 0.02, 0.03, 0.30, 0.50, 5e-4, 0.005, 0.0015
DEEP_BELOW, DEEP_ABOVE, CHANNEL_HIGH, CHANNEL_LOW = 0.10, 0.07, 80, 20


def classify_stage(f: DataFrame) -> DataFrame:
    """Stage 1 to 4 of each bar; the first rule that holds decides."""
    slope, curve, pos = F.col("slope"), F.col("curvature"), F.col("position")
    up = F.coalesce(F.col("context_up"), F.lit(False))
    above, below = pos > PRICE_BAND, pos < -PRICE_BAND
    rising, falling = F.coalesce(F.col("ma_change") > FLAT, F.lit(False)), F.coalesce(F.col("ma_change") < -FLAT, F.lit(False))
    clean = (F.col("efficiency") >= CLEAN_ER) & (F.col("r2") >= CLEAN_R2)
    contraction, expansion = F.coalesce(F.col("range_ratio") <= 0.80, F.lit(False)), F.coalesce(F.col("range_ratio") >= 1.25, F.lit(False))
    gathering = F.coalesce((F.col("volume_balance") >= 1.15) & (F.col("obv_slope") > 0), F.lit(False))
    selling = F.coalesce((F.col("volume_balance") <= 0.87) & (F.col("obv_slope") < 0), F.lit(False))
    out, breakdown = F.coalesce(F.col("breakout"), F.lit(False)), F.coalesce(F.col("breakdown"), F.lit(False))
    basing = (slope > -STEEP) & (curve > CURVE)
    declining = (slope <= -STEEP) | ((slope < -MILD) & ((curve < -CURVE) | expansion)) | (falling & (slope < -MILD))
    either = lambda a, b: F.when(up, a).otherwise(b)
    stage = (
        F.when(slope.isNull() | pos.isNull() | curve.isNull(), None)
        .when((clean & (slope > 0) & ~below) | (above & rising) | (out & ~below), 2)
        .when((clean & (slope < 0) & ~above) | (below & falling & ~basing) | (breakdown & ~above), 4)
        .when(below, F.when(pos < -DEEP_BELOW, 4).when(basing, 1).when(declining, 4).otherwise(either(3, 1)))
        .when(above & (pos > DEEP_ABOVE) & ~rising & up, 3)
        .when(F.col("channel") <= CHANNEL_LOW, F.when(curve > CURVE, 1).otherwise(either(1, 4)))
        .when(F.col("channel") >= CHANNEL_HIGH, F.when(up & (curve >= -CURVE), 2).otherwise(either(3, 1)))
        .when(curve > CURVE, 1)
        .when(curve < -CURVE, either(3, 1))
        .when(contraction, 1)
        .when(expansion, either(3, 4))
        .when(gathering, 1)
        .when(selling, 3)
        .otherwise(either(3, 1))
    )
    return f.withColumn("stage", stage)


#: Bars, average and window, look-back of its slope, least run of a stage.
FRAMES = {"short": ("day", 50, 10, 20), "mid": ("week", 30, 5, 8), "long": ("week", 40, 8, 8)}


def staged(bars: DataFrame, frame: str) -> DataFrame:
    """Stages of a frame's bars, with side (of the average) and slope (of it) as -1, 0, 1."""
    unit, n, lookback, _ = FRAMES[frame]
    f = classify_stage(stage_features(bars if unit == "day" else resample(bars, unit), n, n, lookback))
    sign = lambda c, band: F.when(F.col(c) > band, 1).when(F.col(c) < -band, -1).otherwise(0)
    return f.withColumns({"side": sign("position", PRICE_BAND), "slope": sign("ma_change", FLAT)})


def last_stages(bars: DataFrame) -> DataFrame:
    """code, and the stage of its newest bar in each of FRAMES.  Frames of the same bars are slid over together."""
    out = None
    for unit in dict.fromkeys(f[0] for f in FRAMES.values()):
        frames = {name: (n, n, lookback) for name, (u, n, lookback, _) in FRAMES.items() if u == unit}
        f = classify_stage(_frame_features(bars if unit == "day" else resample(bars, unit), frames, last=True)).select("code", "frame", "stage")
        out = f if out is None else out.unionByName(f)
    return out.groupBy("code").agg(*[F.max(F.when(F.col("frame") == name, F.col("stage"))).alias(name) for name in FRAMES])


def as_of_close(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """The last close on or before each date: both go into one ordered series for each code (no range join)."""
    asked = dates.select("code", F.col("as_of").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("struct<bar_date:date,close:double>").alias("bar"))
    known = bars.select("code", F.col("bar_date").alias("at"), F.lit(0).alias("asks"), F.struct("bar_date", "close").alias("bar"))
    w = Window.partitionBy("code").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = known.unionByName(asked).withColumn("bar", F.last("bar", ignorenulls=True).over(w)).where("asks = 1")
    return found.select("code", F.col("at").alias("as_of"), F.col("bar.bar_date").alias("bar_date"), F.col("bar.close").alias("close"))


def lookback_delta(bars: DataFrame, value: str, n: int = 20) -> DataFrame:
    """Latest value minus the last one at least n rows earlier, else the first."""
    per = bars.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("bar_date", value))), lambda x: x[value]).alias("v"))  # one code's bars
    known = F.filter(F.slice("v", F.lit(1), F.greatest(F.size("v") - n, F.lit(0))), lambda x: x.isNotNull())
    first = F.get(F.filter("v", lambda x: x.isNotNull()), F.lit(0))
    past = F.coalesce(F.get(known, F.size(known) - 1), first)
    return per.select("code", (F.get("v", F.size("v") - 1) - past).alias("delta"))


def corporate_action(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Codes whose second-last stored close differs from the fresh close of that day."""
    w = Window.partitionBy("code").orderBy(F.desc("bar_date"))
    second = stored.withColumn("rn", F.row_number().over(w)).where("rn = 2").select("code", "bar_date", F.col("close").alias("stored_close"))
    return second.join(fresh.select("code", "bar_date", F.col("close").alias("fresh_close")), ["code", "bar_date"], "left").select("code", "bar_date", F.coalesce(F.abs(F.col("stored_close") - F.col("fresh_close")) > 0.01, F.lit(False)).alias("changed"))


def quantile_bands(values: DataFrame, key: str, value: str, least: int = 4) -> DataFrame:
    """Nearest-rank and interpolated bands of the positive values, and the upper median."""
    per = values.where(F.col(value) > 0).groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    n = F.size("v")
    nearest = lambda p: F.when(n >= least, F.get("v", F.bround((n - 1) * p).cast("int")))
    return per.select(key, n.alias("n"), *[nearest(p).alias(f"near_{int(p * 100)}") for p in (0.25, 0.5, 0.75)], *[F.when(n >= least, F.get("p", F.lit(i))).alias(f"linear_{x}") for i, x in enumerate((25, 50, 75))], F.get("v", F.floor(n / 2).cast("int")).alias("upper_median"))
