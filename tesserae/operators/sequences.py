"""Sequential kernels: what depends on its own past state, one code at a time.

The zigzag is a state machine over batches of sorted bars; patterns on its
pivots are windows over a few leads.  Stage segments, with their
hysteresis and look-back, are a kernel over the bars of one code after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

THRESHOLD = 0.06


_PIVOTS = pa.schema([("code", pa.int64()), ("n", pa.int32()), ("pivot_date", pa.date32()), ("price", pa.float64()), ("kind", pa.string()), ("settled", pa.bool_())])


class Swing:
    """One code's search for pivots: the extremes since the last one, and the way prices go.  Its size is the same however long the series is."""

    def __init__(self, code: int, day: object, price: float):
        self.code, self.way, self.n = code, 0, 0
        self.high = self.low = (day, price)

    def bar(self, day: object, price: float, up: float, down: float) -> tuple | None:
        """The pivot that this bar settles, if any."""
        if self.way >= 0 and price > self.high[1]:
            self.high = (day, price)
        if self.way <= 0 and price < self.low[1]:
            self.low = (day, price)
        if self.way >= 0 and price <= self.high[1] * down:
            found, self.way, self.low = (*self.high, "high"), -1, (day, price)
        elif self.way <= 0 and price >= self.low[1] * up:
            found, self.way, self.high = (*self.low, "low"), 1, (day, price)
        else:
            return None
        self.n += 1
        return self.code, self.n - 1, *found, True

    def last(self) -> tuple | None:
        """The pivot that is still moving."""
        if not self.way:
            return None
        return self.code, self.n, *(self.high if self.way > 0 else self.low), "high" if self.way > 0 else "low", False


def zigzag(bars: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """code, n, pivot_date, price, kind, settled: swing points; the last one of a code is provisional.

    A state machine over batches of sorted bars that emits pivots as it goes: time is linear and memory
    that of one batch, whatever the length of a series.  Stored bars are in buckets of codes already, so they aren't exchanged.
    Bars without a close or a code are left out.
    """
    up, down = 1 + threshold, 1 - threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Swing | None = None
        for batch in batches:
            out = []
            for code, day, price, number in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or number == 1:
                    if own is not None:
                        out.append(own.last())
                    own = Swing(code, day, price)
                else:
                    out.append(own.bar(day, price, up, down))
            yield pivots_of(out)
        if own is not None:
            yield pivots_of([own.last()])

    def pivots_of(rows: list[tuple | None]) -> pa.RecordBatch:
        there = [r for r in rows if r is not None]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*there)) or [[]] * len(_PIVOTS), _PIVOTS)], schema=_PIVOTS)

    series = bars.where("code is not null and close is not null").select(F.col("code").cast("bigint"), "bar_date", F.col("close").cast("double"))
    # the window deals and sorts by code; a repartition() would be dropped over a bucketed table, and its scan then be dealt by files
    numbered = series.withColumn("number", F.row_number().over(Window.partitionBy("code").orderBy("bar_date")))
    return numbered.mapInArrow(run, "code bigint, n int, pivot_date date, price double, kind string, settled boolean")


def near(value: Column, target: float, tolerance: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(value - target) / tolerance)


def impulses(pivots: DataFrame) -> DataFrame:
    """Five-wave patterns: the pivot where each begins, its direction and its likeness to Fibonacci ratios."""
    w = Window.partitionBy("code").orderBy("n")
    p = [F.lead("price", i).over(w).alias(f"p{i}") for i in range(6)]
    rows = pivots.select("code", "n", "kind", *p).where("p5 is not null").withColumn("s", F.when(F.col("kind") == "low", 1.0).otherwise(-1.0))
    leg = lambda a, b: F.col("s") * (F.col(f"p{b}") - F.col(f"p{a}"))
    rows = rows.withColumns({"w1": leg(0, 1), "w2": -leg(1, 2), "w3": leg(2, 3), "w4": -leg(3, 4), "w5": leg(4, 5), "over": leg(1, 4)})
    valid = (
        (F.least("w1", "w3", "w5") > 0) & (F.col("w2") < F.col("w1")) & ~((F.col("w3") < F.col("w1")) & (F.col("w3") < F.col("w5"))) & (F.col("over") > 0)
        & (F.col("w2") >= 0.2 * F.col("w1")) & (F.col("w3") >= F.col("w1") / 3) & (F.col("w3") > F.col("w2")) & (F.col("w5") < 2 * F.col("w1"))
    )
    score = (near(F.col("w2") / F.col("w1"), 0.559, 0.25) + near(F.col("w3") / F.col("w1"), 1.618, 0.6) + near(F.col("w4") / F.col("w3"), 0.382, 0.25)) / 3
    return rows.where(valid).select("code", "n", F.when(F.col("s") > 0, "up").otherwise("down").alias("direction"), score.alias("score"))


def corrections(pivots: DataFrame) -> DataFrame:
    """Three-wave corrections by how far the second wave comes back."""
    w = Window.partitionBy("code").orderBy("n")
    rows = pivots.select("code", "n", "kind", *[F.lead("price", i).over(w).alias(f"p{i}") for i in range(4)]).where("p3 is not null")
    s = F.when(F.col("kind") == "high", 1.0).otherwise(-1.0)
    rows = rows.withColumns({"a": s * (F.col("p0") - F.col("p1")), "b": s * (F.col("p2") - F.col("p1")), "c": s * (F.col("p2") - F.col("p3"))}).where("a > 0 and b > 0 and c > 0")
    r = F.col("b") / F.col("a")
    rows = rows.withColumn("r", r).where("r <= 1.5")
    shape = F.when(F.col("r") <= 0.786, "zigzag").when(F.col("r") <= 1.05, "flat").otherwise("expanded")
    score = F.when(F.col("r") <= 0.786, near(F.col("r"), 0.618, 0.4)).when(F.col("r") <= 1.05, 0.5 * near(F.col("r"), 0.9, 0.25)).otherwise(0.5 * near(F.col("r"), 1.236, 0.3))
    return rows.select("code", "n", F.when(F.col("kind") == "high", "down").otherwise("up").alias("direction"), shape.alias("shape"), score.alias("score"))


#: Pivots that a correction may start after an impulse, and how far the next move reaches (price and time alike).
CORRECTION_WITHIN, RETRACE, EXTEND = 8, (0.382, 0.618), (1.0, 1.618)


def greedy_cycles(impulse_at: dict[int, str], correction_at: dict[int, str], pivots: int) -> list[tuple[int, str, str]]:
    """(first pivot, phase, direction) of blocks from the left: the next impulse, then the first correction against it soon after; what fits neither stays without."""
    out, at = [], 0
    for start in sorted(impulse_at):
        if start < at:
            continue
        way = impulse_at[start]
        out.append((start, "motive", way))
        at = start + 5
        against = "down" if way == "up" else "up"
        follows = next((k for k in range(at, min(at + CORRECTION_WITHIN, pivots - 3)) if correction_at.get(k) == against), None)
        if follows is not None:
            out.append((follows, "corrective", against))
            at = follows + 3
    return out


def cycles(pivots: DataFrame) -> DataFrame:
    """pivots as zigzag gives them.  The labelled legs: code, n (the pivot where a leg starts), label 1 to 5 or A to C, phase, direction of the block, score."""
    found = impulses(pivots).select("code", "n", "direction", "score", F.lit("motive").alias("phase")).unionByName(corrections(pivots).select("code", "n", "direction", "score", F.lit("corrective").alias("phase")))
    sized = found.join(pivots.groupBy("code").agg(F.max("n").alias("last")), "code")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = {phase: {int(r.n): (r.direction, r.score) for r in own.itertuples()} for phase, own in pdf.groupby("phase")}
        blocks = greedy_cycles(*[{n: d for n, (d, _) in of.get(k, {}).items()} for k in ("motive", "corrective")], int(pdf["last"].iloc[0]) + 1)
        rows = [(pdf["code"].iloc[0], start + k, label, phase, way, round(of[phase][start][1], 2)) for start, phase, way in blocks for k, label in enumerate("12345" if phase == "motive" else "ABC")]
        return pd.DataFrame(rows, columns=["code", "n", "label", "phase", "direction", "score"])

    return sized.groupBy("code").applyInPandas(run, "code bigint, n int, label string, phase string, direction string, score double")


def projections(pivots: DataFrame, legs: DataFrame, bars: DataFrame) -> DataFrame:
    """The zone and time of the move after each code's last labelled legs of one phase."""
    index = bars.select("code", F.col("bar_date").alias("pivot_date"), F.row_number().over(Window.partitionBy("code").orderBy("bar_date")).alias("i"))
    w = Window.partitionBy("code").orderBy("n")
    ends = pivots.join(index, ["code", "pivot_date"]).select("code", "n", "price", F.lead("price").over(w).alias("to"), (F.lead("i").over(w) - F.col("i")).alias("bars"))
    rows = legs.join(ends, ["code", "n"]).where("to is not null")
    turned = rows.withColumn("t", F.when(F.lag("phase").over(w) != F.col("phase"), 1).otherwise(0)).withColumn("set", F.sum("t").over(w))
    last = turned.groupBy("code", "set").agg(F.max("phase").alias("phase"), F.min_by("price", "n").alias("start"), F.max_by("to", "n").alias("end"), F.max_by(F.col("to") > F.col("price"), "n").alias("rose"), F.sum("bars").alias("bars"), F.max_by("label", "n").alias("label"))
    last = last.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("set")))).where("k = 1")
    motive, span = F.col("phase") == "motive", F.abs(F.col("end") - F.col("start"))
    low, high = (F.when(motive, RETRACE[i]).otherwise(EXTEND[i]) for i in (0, 1))
    way = F.when(F.col("rose"), -1.0).otherwise(1.0)  # either way the next move goes against the last leg
    one, two = F.col("end") + way * span * low, F.col("end") + way * span * high
    time = lambda r: F.greatest(F.lit(1), F.floor(F.col("bars") * r)).cast("int")
    return last.where(span > 0).select("code", "label", F.when(motive, "correction").otherwise("advance").alias("next"), F.round(F.least(one, two), 2).alias("low"), F.round(F.greatest(one, two), 2).alias("high"), time(low).alias("bars_low"), time(high).alias("bars_high"))


def swings(pivots: DataFrame) -> DataFrame:
    """Each pivot against the one of its kind before it: HH, LH, HL, LL."""
    before = F.lag("price").over(Window.partitionBy("code", "kind").orderBy("n"))
    label = F.when(before.isNull(), None).when(F.col("kind") == "high", F.when(F.col("price") > before, "HH").otherwise("LH")).otherwise(F.when(F.col("price") > before, "HL").otherwise("LL"))
    return pivots.withColumn("swing", label)


def structure(pivots: DataFrame) -> DataFrame:
    """Per code: its last high and low against those before, the trend they make, and whether a turn is being set up; codes with three pivots and more."""
    labelled = swings(pivots)
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("swing")), F.when(F.col("kind") == kind, F.col("n")))
    got = labelled.groupBy("code").agg(F.count("*").alias("pivots"), last("high").alias("last_high"), last("low").alias("last_low"), F.max_by("kind", "n").alias("newest")).where("pivots >= 3")
    high, low = F.coalesce("last_high", F.lit("none")), F.coalesce("last_low", F.lit("none"))
    trend = F.when((high == "HH") & (low == "HL"), "up").when((high == "LH") & (low == "LL"), "down").when((high == "none") & (low == "none"), "none").otherwise("range")
    setup = F.when((F.col("newest") == "low") & (low == "HL") & (high != "HH"), "stage 1 to 2").when((F.col("newest") == "high") & (high == "LH") & (low != "LL"), "stage 3 to 4")
    return got.select("code", "last_high", "last_low", trend.alias("trend"), setup.alias("setup"))


#: Pivots of a box, how near to its edge they lie, and the volume that confirms.
BOX_PIVOTS, BOX_NEAR, BOX_VOLUME = 6, 0.04, 1.5


def boxes(pivots: DataFrame, bars: DataFrame) -> DataFrame:
    """Support and resistance per code, from the settled pivots near the lowest and the highest of the last few, and what the last close does to them."""
    k = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n")))
    recent = pivots.where("settled").withColumn("k", k).where(F.col("k") <= BOX_PIVOTS)
    edges = recent.groupBy("code").agg(F.max(F.when(F.col("kind") == "high", F.col("price"))).alias("top"), F.min(F.when(F.col("kind") == "low", F.col("price"))).alias("bottom"))
    near_top = (F.col("kind") == "high") & (F.col("price") >= F.col("top") * (1 - BOX_NEAR))
    near_bottom = (F.col("kind") == "low") & (F.col("price") <= F.col("bottom") * (1 + BOX_NEAR))
    levels = recent.join(edges, "code").groupBy("code").agg(F.avg(F.when(near_top, F.col("price"))).alias("resistance"), F.avg(F.when(near_bottom, F.col("price"))).alias("support")).where("resistance > support")
    w = Window.partitionBy("code").orderBy("bar_date")
    last = bars.select("code", "close", "volume", F.avg("volume").over(w.rowsBetween(-5, -1)).alias("usual"), F.count("*").over(w).alias("i"), F.lead("bar_date").over(w).alias("next")).where("next is null and i >= 5")
    event = F.when(F.col("close") > F.col("resistance"), "breakout").when(F.col("close") < F.col("support"), "breakdown").otherwise("inside")
    sure = (F.col("event") != "inside") & (F.col("i") >= 6) & (F.col("usual") > 0) & (F.col("volume") >= F.col("usual") * BOX_VOLUME)
    return levels.join(last, "code").withColumn("event", event).select("code", F.round("support", 2).alias("support"), F.round("resistance", 2).alias("resistance"), "event", F.coalesce(sure, F.lit(False)).alias("confirmed"))


# How far a run may go against its stage, how far a top may rise, and the least tail.
AGAINST, ADVANCE, TAIL_BARS, TAIL_SHARE = 0.10, 0.10, 4, 0.25
Run = tuple[int, int, int]


def settled_stages(stage: list[int], side: list[int], slope: list[int]) -> list[int]:
    """Stages 1 and 3 go on while the price is near a flat average."""
    out: list[int] = []
    for s, near, flat in zip(stage, side, slope):
        out.append(out[-1] if out and out[-1] in (1, 3) and near == 0 == flat else s)
    return out


def debounced(stage: list[int], side: list[int], slope: list[int], least: int) -> list[Run]:
    """Runs (first, last, stage).  A new stage is taken when it has lasted, in half the time for a turn between 2 and 4, a change of sides, or one that price or average confirm; it counts from its first bar."""
    starts, kept, at, since = [0], [stage[0]], side[0], 0
    for i in range(1, len(stage)):
        if stage[i] != stage[i - 1]:
            since = i
        now, new = kept[-1], stage[i]
        if new == now:
            continue
        sooner = {now, new} == {2, 4} or side[i] * at < 0 or (new == 4 and side[i] < 0) or (new == 2 and slope[i] > 0)
        if i - since + 1 >= (max(2, least // 2) if sooner else least):
            starts.append(since)
            kept.append(new)
            at = side[i]
    return [(a, b - 1, s) for a, b, s in zip(starts, [*starts[1:], len(stage)], kept)]


def by_direction(run: Run, close: np.ndarray, side: list[int]) -> list[Run]:
    """A top that rose to its end is an advance; a decline that rose and an advance that fell are split at their extreme."""
    a, b, s = run
    if not close[a] or not close[b]:
        return [run]
    change, own = close[b] / close[a] - 1, close[a : b + 1]
    if s == 3 and change > ADVANCE and int(np.argmax(own)) >= 0.7 * len(own):
        cut = next((k for k in range(a, b + 1) if side[k] > 0), None)
        return [(a, cut - 1, 1), (cut, b, 2)] if cut is not None and a < cut < b else [(a, b, 2)]
    if not (s == 4 and change > AGAINST or s == 2 and change < -AGAINST):
        return [run]
    turned = 1 if s == 4 else 3
    pivot = a + int(np.argmin(own) if s == 4 else np.argmax(own))
    if len(own) < 4 or pivot == a:
        return [(a, b, turned)]
    return [run] if pivot == b else [(a, pivot, s), (pivot + 1, b, turned)]


def by_tail(run: Run, side: list[int]) -> list[Run]:
    """The end of a decline that lies above, or of an advance that lies below, is a stage of its own if it is long."""
    a, b, s = run
    if s not in (2, 4) or b - a + 1 < 2 * TAIL_BARS:
        return [run]
    home, tail = (-1 if s == 4 else 1), 0
    while tail <= b - a and side[b - tail] != home:
        tail += 1
    if tail < TAIL_BARS or tail < TAIL_SHARE * (b - a + 1):
        return [run]
    rest = [(b - tail + 1, b, 1 if s == 4 else 3)]
    return [(a, b - tail, s), *rest] if tail <= b - a else rest


def merged(runs: list[Run]) -> list[Run]:
    out: list[Run] = []
    for a, b, s in runs:
        out = [*out[:-1], (out[-1][0], b, s)] if out and out[-1][2] == s else [*out, (a, b, s)]
    return out


def segment_series(stage: list, side: list[int], slope: list[int], close: list[float], least: int = 20) -> list[Run]:
    """(first, last, stage) runs of one series; bars without a stage are left out before, so numbers count the others.

    side: -1 below, 0 near, 1 above the average; slope: -1, 0, 1 for a falling, flat,
    rising one.
    """
    if not stage:
        return []
    prices = np.nan_to_num(np.asarray(close, dtype=np.float64))
    runs = debounced(settled_stages(stage, side, slope), side, slope, least)
    return merged([t for r in runs for d in by_direction(r, prices, side) for t in by_tail(d, side)])


_SEGMENTS = pa.schema([("code", pa.int64()), ("start", pa.date32()), ("end", pa.date32()), ("stage", pa.int32()), ("bars", pa.int32())])


def segments(stages: DataFrame, least: int = 20, in_order: bool = False) -> DataFrame:
    """stages: code, bar_date, close, stage, side, slope.  Runs of a settled stage for each code.

    in_order: the bars of a code lie together and by date, as ``prices.staged`` leaves them, and aren't dealt again.
    A task holds a batch and the bars of one code.
    """

    def found(rows: pa.Table) -> pa.RecordBatch:
        """Runs of whole codes."""
        key = rows["code"].fill_null(np.iinfo(np.int64).min).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        stage, side, slope = (rows[c].to_pylist() for c in ("stage", "side", "slope"))
        close = rows["close"].to_numpy()
        runs = [(a + first, a + last, s) for a, b in zip(cuts, cuts[1:]) for first, last, s in segment_series(stage[a:b], side[a:b], slope[a:b], close[a:b], least)]
        first, last, of = (np.array(x, np.int64) for x in (zip(*runs) if runs else ([], [], [])))
        made = [rows["code"].take(first), rows["bar_date"].take(first), rows["bar_date"].take(last), pa.array(of, pa.int32()), pa.array(last - first + 1, pa.int32())]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made], schema=_SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []  # of the code that goes on
        for batch in batches:
            batch = batch.filter(batch.column("stage").is_valid())
            if not batch.num_rows:
                continue
            last = batch.column("code")[batch.num_rows - 1]
            if all(x.column("code")[0] == last for x in (*open_[:1], batch)):  # nothing has ended
                open_.append(batch)
                continue
            code = batch.column("code").to_pylist()
            ended = next((i + 1 for i in range(len(code) - 1, -1, -1) if code[i] != code[-1]), 0)
            yield found(pa.Table.from_batches([*open_, batch.slice(0, ended)]))
            open_ = [batch.slice(ended)]
        if open_:
            yield found(pa.Table.from_batches(open_))

    rows = stages.select(F.col("code").cast("bigint"), "bar_date", F.col("close").cast("double"), *[F.col(c).cast("int") for c in ("stage", "side", "slope")])
    if not in_order:  # the window deals and sorts, as for the zigzag
        rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("code").orderBy("bar_date")))
    return rows.mapInArrow(run, "code bigint, start date, end date, stage int, bars int")


# Fixed values of the long view, in months, and of what counts as near and flat.
LONG_LEAST, LONG_MOST, LONG_SLOPE, NEAR, FLAT = 40, 120, 12, 0.03, 0.02


def secular(months: DataFrame) -> DataFrame:
    """months: code, month, close.  Where the last close lies to the longest average of months that there is, and where that is heading."""
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("month")))
    n = F.count("*").over(Window.partitionBy("code"))
    size = F.greatest(F.lit(LONG_LEAST), F.least(F.lit(LONG_MOST), n - LONG_SLOPE)).cast("int")
    rows = months.select("code", "close", back.alias("k"), n.alias("n"), size.alias("size")).where(F.col("n") >= LONG_LEAST + LONG_SLOPE)
    got = rows.groupBy("code", "size").agg(
        F.avg(F.when(F.col("k") <= F.col("size"), F.col("close"))).alias("now"),
        F.avg(F.when((F.col("k") > LONG_SLOPE) & (F.col("k") <= F.col("size") + LONG_SLOPE), F.col("close"))).alias("before"),
        F.max(F.when(F.col("k") == 1, F.col("close"))).alias("last"),
    )
    ratio, slope = F.col("last") / F.col("now") - 1, F.col("now") / F.col("before") - 1
    band = lambda x, b, names: F.when(x > b, names[0]).when(x < -b, names[2]).otherwise(names[1])
    return got.select("code", F.col("size").alias("months"), band(ratio, NEAR, ("above", "near", "below")).alias("position"), band(slope, FLAT, ("rising", "flat", "falling")).alias("heading"), F.round(ratio, 4).alias("ratio"))
