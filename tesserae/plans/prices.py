"""Queries over price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.functions.columns import series
from tesserae.operators import prices
from tesserae.operators.ranks import percentile_ranks
from tesserae.sources import barstore, views
from tesserae.sources.views import BARS, INDEX, UNIVERSE

W = "WINDOW w AS (PARTITION BY code ORDER BY bar_date)"
# In the SQL, + 0.0 after round() turns a negative zero into zero, which is what Spark's round() gives.


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def technicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prices.technicals(views.bars(spark, sf_dir))
    return _round(out, 4, "ma20", "ma60", "ma120", "near_high", "volume_ratio")


TECHNICALS = f"""WITH {BARS}, m AS (
  SELECT *, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS ma20,
    CASE WHEN count(*) OVER (w ROWS 59 PRECEDING) = 60 THEN avg(close) OVER (w ROWS 59 PRECEDING) END AS ma60,
    CASE WHEN count(*) OVER (w ROWS 119 PRECEDING) = 120 THEN avg(close) OVER (w ROWS 119 PRECEDING) END AS ma120,
    max(high) OVER (w ROWS 251 PRECEDING) AS top, lag(close, 20) OVER w AS c20, lag(close, 60) OVER w AS c60,
    CASE WHEN count(volume) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) = 50 THEN avg(volume) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) END AS usual
  FROM bars {W})
SELECT code, bar_date, close, round(ma20, 4) AS ma20, round(ma60, 4) AS ma60, round(ma120, 4) AS ma120,
  round(close / top, 4) AS near_high,
  CASE WHEN ma20 IS NOT NULL AND ma60 IS NOT NULL AND ma120 IS NOT NULL THEN close > ma20 AND ma20 > ma60 AND ma60 > ma120 END AS aligned,
  CASE WHEN usual > 0 THEN round(volume / usual, 4) END AS volume_ratio,
  CASE WHEN c20 > 0 THEN round((close / c20 - 1) * 100, 1) + 0.0 END AS return_20,
  CASE WHEN c60 > 0 THEN round((close / c60 - 1) * 100, 1) + 0.0 END AS return_60
FROM m"""


def strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of all codes, strongest first."""
    rated = prices.strength_ratings(views.bars(spark, sf_dir))
    return _round(rated, 6, "strength").orderBy(F.desc_nulls_last("rating"), "code")


STRENGTH = f"""WITH {BARS}, s AS (
  SELECT code, bar_date, close, lead(bar_date) OVER w AS nxt, lag(close, 63) OVER w AS a, lag(close, 126) OVER w AS b, lag(close, 189) OVER w AS c, lag(close, 252) OVER w AS d
  FROM bars {W}),
l AS (SELECT code, bar_date, close, CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN (close / a - 1) * 0.4 + (close / b - 1) * 0.2 + (close / c - 1) * 0.2 + (close / d - 1) * 0.2 END AS strength FROM s WHERE nxt IS NULL),
r AS (SELECT *, percent_rank() OVER (PARTITION BY strength IS NULL ORDER BY strength) AS pr, count(strength) OVER () AS n FROM l)
SELECT code, bar_date, close, round(strength, 6) AS strength,
  CASE WHEN strength IS NOT NULL AND n > 1 THEN CAST(round_even(pr * 98, 0) AS INTEGER) + 1 END AS rating FROM r"""


def _resampled(unit: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return prices.resample(views.bars(spark, sf_dir), unit)

    return query


def _resample_sql(unit: str) -> str:
    return f"""WITH {BARS}
SELECT code, max(bar_date) AS bar_date, first(open ORDER BY bar_date) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY bar_date) AS close, sum(volume) AS volume, count(*) AS bars
FROM bars GROUP BY code, date_trunc('{unit}', bar_date)"""


def mansfield(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prices.relative_strength(views.bars(spark, sf_dir), views.benchmark_index(spark, sf_dir))
    return _round(out, 4, "ratio", "mansfield")


MANSFIELD = f"""WITH {BARS}, {INDEX}, r AS (SELECT code, bar_date, close / level AS ratio FROM bars JOIN idx USING (bar_date) WHERE close > 0 AND level > 0),
m AS (SELECT *, CASE WHEN count(*) OVER (w ROWS 199 PRECEDING) = 200 THEN avg(ratio) OVER (w ROWS 199 PRECEDING) END AS base FROM r {W})
SELECT code, bar_date, round(ratio, 4) AS ratio, CASE WHEN base > 0 THEN round((ratio / base - 1) * 100, 4) + 0.0 END AS mansfield FROM m"""


def beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(prices.beta(views.bars(spark, sf_dir), views.benchmark_index(spark, sf_dir)), 6, "beta")


BETA = f"""WITH {BARS}, {INDEX}, r AS (
  SELECT code, close / lag(close) OVER w - 1 AS y, level / lag(level) OVER w - 1 AS x
  FROM (SELECT code, bar_date, close, level FROM bars JOIN idx USING (bar_date) WHERE close > 0 AND level > 0) {W})
SELECT code, count(*) AS n, CASE WHEN count(*) >= 60 AND var_pop(x) > 0 THEN round(greatest(-1.0, least(3.0, covar_pop(y, x) / var_pop(x))), 6) END AS beta
FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY code"""


def stage_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = prices.stage_features(views.bars(spark, sf_dir))
    return _round(f, 4, "ma", "r2", "efficiency", "volume_balance", "range_ratio", "channel", "position").select("code", "bar_date", "close", "ma", F.round("slope", 6).alias("slope"), "r2", "efficiency", "volume_balance", "range_ratio", "channel", "breakout", "breakdown", "position")


STAGE_INPUTS = f"""WITH {BARS}, b AS (SELECT *, row_number() OVER w AS i, lag(close) OVER w AS prev FROM bars {W}),
c AS (SELECT *, ln(close) AS lg, abs(close - prev) AS step, greatest(high - low, abs(high - prev), abs(low - prev)) / close AS tr FROM b),
d AS (SELECT *, count(lg) OVER f AS n, var_pop(lg) OVER f AS vp, regr_slope(lg, i) OVER f AS sl, regr_r2(lg, i) OVER f AS rr,
  abs(close - lag(close, 59) OVER w) AS net, sum(step) OVER (w ROWS 58 PRECEDING) AS path,
  sum(CASE WHEN close > prev THEN volume ELSE 0 END) OVER p AS up, sum(CASE WHEN close < prev THEN volume ELSE 0 END) OVER p AS down,
  avg(tr) OVER (w ROWS 29 PRECEDING) AS atr1, avg(tr) OVER (w ROWS BETWEEN 59 PRECEDING AND 30 PRECEDING) AS atr0,
  max(high) OVER p AS hi, min(low) OVER p AS lo, avg(volume) OVER p AS usual,
  CASE WHEN count(*) OVER (w ROWS 49 PRECEDING) = 50 THEN avg(close) OVER (w ROWS 49 PRECEDING) END AS ma
  FROM c WINDOW w AS (PARTITION BY code ORDER BY bar_date), f AS (PARTITION BY code ORDER BY bar_date ROWS 59 PRECEDING), p AS (PARTITION BY code ORDER BY bar_date ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING))
SELECT code, bar_date, close, round(ma, 4) AS ma, CASE WHEN n = 60 THEN round(CASE WHEN vp > 0 THEN sl ELSE 0 END, 6) + 0.0 END AS slope,
  CASE WHEN n = 60 THEN round(CASE WHEN vp > 0 THEN rr ELSE 0 END, 4) END AS r2,
  CASE WHEN n = 60 THEN round(CASE WHEN path > 0 THEN net / path ELSE 0 END, 4) END AS efficiency,
  CASE WHEN n = 60 AND down > 0 THEN round(up / down, 4) END AS volume_balance,
  CASE WHEN n = 60 AND atr0 > 0 THEN round(atr1 / atr0, 4) END AS range_ratio,
  CASE WHEN n = 60 THEN round(CASE WHEN hi > lo THEN least(100, greatest(0, (close - lo) / (hi - lo) * 100)) ELSE 50 END, 4) END AS channel,
  CASE WHEN n = 60 THEN close > hi AND volume >= 1.5 * usual END AS breakout, CASE WHEN n = 60 THEN close < lo AND volume >= 1.5 * usual END AS breakdown,
  round((close - ma) / ma, 4) + 0.0 AS position FROM d"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.classify_stage(prices.stage_features(views.bars(spark, sf_dir), 60, 60)).select("code", "bar_date", "stage")


STAGES = f"""WITH {BARS}, b AS (SELECT *, row_number() OVER w AS i, lag(close) OVER w AS prev FROM bars {W}),
c AS (SELECT *, ln(close) AS lg, abs(close - prev) AS step, greatest(high - low, abs(high - prev), abs(low - prev)) / close AS tr,
  sum(CASE WHEN close > prev THEN volume WHEN close < prev THEN -volume ELSE 0 END) OVER (PARTITION BY code ORDER BY bar_date ROWS UNBOUNDED PRECEDING) AS obv,
  CASE WHEN count(*) OVER (PARTITION BY code ORDER BY bar_date ROWS 59 PRECEDING) = 60 THEN avg(close) OVER (PARTITION BY code ORDER BY bar_date ROWS 59 PRECEDING) END AS ma FROM b),
d AS (SELECT *, count(lg) OVER f AS n, var_pop(lg) OVER f AS vp, regr_slope(lg, i) OVER f AS sl, regr_r2(lg, i) OVER f AS rr, regr_slope(lg, i) OVER (w ROWS 30 PRECEDING) - regr_slope(lg, i) OVER (w ROWS BETWEEN 59 PRECEDING AND 29 PRECEDING) AS curve0,
  abs(close - lag(close, 59) OVER w) AS net, sum(step) OVER (w ROWS 58 PRECEDING) AS path, sum(CASE WHEN close > prev THEN volume ELSE 0 END) OVER p AS up0, sum(CASE WHEN close < prev THEN volume ELSE 0 END) OVER p AS down0,
  avg(tr) OVER (w ROWS 29 PRECEDING) AS atr1, avg(tr) OVER (w ROWS BETWEEN 59 PRECEDING AND 30 PRECEDING) AS atr0, max(high) OVER p AS hi, min(low) OVER p AS lo, avg(volume) OVER p AS usual, regr_slope(obv, i) OVER p AS os,
  (close - ma) / ma AS pos, ma / lag(ma, 10) OVER w - 1 AS moved, coalesce(ma >= lag(ma, 60) OVER w, false) AS up
  FROM c WINDOW w AS (PARTITION BY code ORDER BY bar_date), f AS (PARTITION BY code ORDER BY bar_date ROWS 59 PRECEDING), p AS (PARTITION BY code ORDER BY bar_date ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, CASE WHEN n = 60 THEN CASE WHEN vp > 0 THEN sl ELSE 0 END END AS slope, CASE WHEN n = 60 THEN CASE WHEN vp > 0 THEN rr ELSE 0 END END AS r2, CASE WHEN n = 60 THEN CASE WHEN path > 0 THEN net / path ELSE 0 END END AS er, CASE WHEN n = 60 THEN curve0 END AS curve,
  CASE WHEN n = 60 AND down0 > 0 THEN up0 / down0 END AS vb, CASE WHEN n = 60 AND atr0 > 0 THEN atr1 / atr0 END AS rg, CASE WHEN n = 60 THEN CASE WHEN hi > lo THEN least(100, greatest(0, (close - lo) / (hi - lo) * 100)) ELSE 50 END END AS ch,
  coalesce(n = 60 AND close > hi AND volume >= 1.5 * usual, false) AS bo, coalesce(n = 60 AND close < lo AND volume >= 1.5 * usual, false) AS bd, CASE WHEN n = 60 THEN os END AS obs FROM d),
g AS (SELECT *, pos > 0.03 AS above, pos < -0.03 AS below, coalesce(moved > 0.02, false) AS rising, coalesce(moved < -0.02, false) AS falling, er >= 0.3 AND r2 >= 0.5 AS clean, coalesce(rg <= 0.8, false) AS tight, coalesce(rg >= 1.25, false) AS wide,
  coalesce(vb >= 1.15 AND obs > 0, false) AS gathering, coalesce(vb <= 0.87 AND obs < 0, false) AS selling, slope > -0.005 AND curve > 5e-4 AS basing FROM e),
h AS (SELECT *, slope <= -0.005 OR (slope < -0.0015 AND (curve < -5e-4 OR wide)) OR (falling AND slope < -0.0015) AS declining FROM g)
SELECT code, bar_date, CAST(CASE WHEN slope IS NULL OR pos IS NULL OR curve IS NULL THEN NULL WHEN (clean AND slope > 0 AND NOT below) OR (above AND rising) OR (bo AND NOT below) THEN 2
  WHEN (clean AND slope < 0 AND NOT above) OR (below AND falling AND NOT basing) OR (bd AND NOT above) THEN 4
  WHEN below THEN CASE WHEN pos < -0.1 THEN 4 WHEN basing THEN 1 WHEN declining THEN 4 WHEN up THEN 3 ELSE 1 END WHEN above AND pos > 0.07 AND NOT rising AND up THEN 3
  WHEN ch <= 20 THEN CASE WHEN curve > 5e-4 THEN 1 WHEN up THEN 1 ELSE 4 END WHEN ch >= 80 THEN CASE WHEN up AND curve >= -5e-4 THEN 2 WHEN up THEN 3 ELSE 1 END
  WHEN curve > 5e-4 THEN 1 WHEN curve < -5e-4 THEN CASE WHEN up THEN 3 ELSE 1 END WHEN tight THEN 1 WHEN wide THEN CASE WHEN up THEN 3 ELSE 4 END WHEN gathering THEN 1 WHEN selling THEN 3 WHEN up THEN 3 ELSE 1 END AS INT) AS stage FROM h"""


def quarter_end_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The close as of every quarter's end."""
    bars = views.bars(spark, sf_dir)
    ends = bars.select("code", F.last_day(F.add_months(F.date_trunc("quarter", "bar_date"), 2)).alias("as_of")).distinct()
    return prices.as_of_close(bars, ends)


QUARTER_END = f"""WITH {BARS}, e AS (SELECT DISTINCT code, CAST(date_trunc('quarter', bar_date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS as_of FROM bars)
SELECT e.code, e.as_of, b.bar_date, b.close FROM e ASOF LEFT JOIN bars b ON e.code = b.code AND e.as_of >= b.bar_date"""


def volume_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.lookback_delta(views.bars(spark, sf_dir), "volume")


VOLUME_DELTA = f"""WITH {BARS}, r AS (SELECT code, volume, row_number() OVER (PARTITION BY code ORDER BY bar_date DESC) AS k, count(*) OVER (PARTITION BY code) AS n FROM bars)
SELECT a.code, a.volume - b.volume AS delta FROM r a JOIN r b ON a.code = b.code AND b.k = CASE WHEN b.n >= 21 THEN 21 ELSE b.n END WHERE a.k = 1"""


def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars(spark, sf_dir)
    out = prices.quantile_bands(bars, "code", "close")
    return _round(out, 10, *[c for c in out.columns if c not in ("code", "n")])


PRICE_BANDS = f"""WITH {BARS}, v AS (SELECT code, count(*) AS n, list_sort(list(close)) AS v, quantile_cont(close, [0.25, 0.5, 0.75]) AS p FROM bars WHERE close > 0 GROUP BY code)
SELECT code, CAST(n AS INTEGER) AS n, round(v[CAST(round_even((n - 1) * 0.25, 0) AS INTEGER) + 1], 10) AS near_25, round(v[CAST(round_even((n - 1) * 0.5, 0) AS INTEGER) + 1], 10) AS near_50,
  round(v[CAST(round_even((n - 1) * 0.75, 0) AS INTEGER) + 1], 10) AS near_75, round(p[1], 10) AS linear_25, round(p[2], 10) AS linear_50, round(p[3], 10) AS linear_75,
  round(v[n // 2 + 1], 10) AS upper_median FROM v"""


def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh bars are the stored ones with every tenth code halved."""
    bars = views.bars(spark, sf_dir)
    return prices.corporate_action(bars, bars.withColumn("close", F.when(F.col("code") % 10 == 0, F.col("close") / 2).otherwise(F.col("close"))))


CORPORATE = f"""WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY bar_date DESC) AS k FROM bars)
SELECT code, bar_date, CASE WHEN code % 10 = 0 THEN abs(close - close / 2) > 0.01 ELSE false END AS changed FROM r WHERE k = 2"""


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile and cheapness ranks of suppliers within their market."""
    u = views.universe(spark, sf_dir).withColumn("positive", F.when(F.col("cap") > 0, F.col("cap")))
    ranked = percentile_ranks(u, {"rank": ("cap", False), "cheapness": ("positive", True)}, ["market"])
    return _round(ranked.select("code", "market", "rank", "cheapness"), 6, "rank", "cheapness")


RANKS = f"""WITH {UNIVERSE}, p AS (SELECT *, CASE WHEN cap > 0 THEN cap END AS pos FROM universe)
SELECT code, market,
  round(CASE WHEN cap IS NULL THEN 0 WHEN count(cap) OVER (PARTITION BY market) <= 1 THEN 0.5 ELSE percent_rank() OVER (PARTITION BY market, cap IS NULL ORDER BY cap) END, 6) AS rank,
  round(CASE WHEN pos IS NULL THEN 0 WHEN count(pos) OVER (PARTITION BY market) <= 1 THEN 0.5 ELSE percent_rank() OVER (PARTITION BY market, pos IS NULL ORDER BY pos DESC) END, 6) AS cheapness
FROM p"""

def periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All day bars with the bar before, as a chart of any code reads them."""
    bars = views.bars(spark, sf_dir)
    change = F.col("close") - F.lag("close").over(series())
    return _round(bars.select("code", "bar_date", "open", "high", "low", "close", "volume", change.alias("change")), 6, "change")


PERIODIC = f"WITH {BARS} SELECT *, round(close - lag(close) OVER (PARTITION BY code ORDER BY bar_date), 6) + 0.0 AS change FROM bars"


def intraday(spark: SparkSession, sf_dir: str, days: int = 14) -> DataFrame:
    """Minute bars of the last days before the newest one, with their number in the code's day."""
    bars = views.minute_bars(spark, sf_dir)
    newest = barstore.latest(bars, "minute", "bar_ts")
    held = bars.limit(0) if newest is None else barstore.last_days(bars, "minute", "bar_ts", days, newest)
    number = F.row_number().over(Window.partitionBy("code", "day").orderBy("bar_ts"))
    return held.select("code", F.date_format("bar_ts", "yyyy-MM-dd HH:mm").alias("bar"), "open", "high", "low", "close", "n", number.alias("number"))


INTRADAY = """WITH m AS (SELECT user_id AS code, date_trunc('minute', ts) AS b, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)
SELECT code, strftime(b, '%Y-%m-%d %H:%M') AS bar, open, high, low, close, n, CAST(row_number() OVER (PARTITION BY code, CAST(b AS DATE) ORDER BY b) AS INTEGER) AS number
FROM m WHERE b >= (SELECT max(b) FROM m) - INTERVAL 14 DAY"""

QUERIES = {
    "s2_periodic_bars": periodic,
    "s3_intraday_bars": intraday,
    "w1_w5_technicals": technicals,
    "q6_strength_rating": strength,
    "a14_resample_week": _resampled("week"),
    "a14_resample_month": _resampled("month"),
    "w9_mansfield": mansfield,
    "a15_beta": beta,
    "w12_w18_stage_inputs": stage_inputs,
    "w20_stage": stages,
    "j10_quarter_end_close": quarter_end_close,
    "w31_lookback_delta": volume_delta,
    "a19_a21_quantile_bands": price_bands,
    "w46_corporate_action": corporate_actions,
    "w10_w11_ranks": ranks,
}

ORACLES = {
    "s2_periodic_bars": PERIODIC,
    "s3_intraday_bars": INTRADAY,
    "w20_stage": STAGES,
    "w1_w5_technicals": TECHNICALS,
    "q6_strength_rating": STRENGTH,
    "a14_resample_week": _resample_sql("week"),
    "a14_resample_month": _resample_sql("month"),
    "w9_mansfield": MANSFIELD,
    "a15_beta": BETA,
    "w12_w18_stage_inputs": STAGE_INPUTS,
    "j10_quarter_end_close": QUARTER_END,
    "w31_lookback_delta": VOLUME_DELTA,
    "a19_a21_quantile_bands": PRICE_BANDS,
    "w46_corporate_action": CORPORATE,
    "w10_w11_ranks": RANKS,
}
