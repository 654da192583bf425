"""Column helpers.  A missing input stays missing: no helper turns NULL into a number."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def band(x: Column, low: float, high: float) -> Column:
    """0 at low, 1 at high, linear between."""
    return clamp01((x - low) / (high - low))


def decimal_round(x: Column, digits: int) -> Column:
    """Rounded half up by the eighteen decimals that x has as a DECIMAL(38, 18), which are those of the double x * 10^18.

    round() goes by the shortest digits that tell a double from others: 32.55 is a tie for it, but 32.549999999999995904 here.
    """
    steps = F.round((x * 1e18).cast("decimal(38,0)"), digits - 18).cast("double") / 10.0 ** (18 - digits)
    return F.rint(steps) / 10.0**digits


def weighted(parts: list[tuple[Column, float]], scale: float = 100.0, digits: int = 1, rounded: Callable[[Column, int], Column] = F.round) -> Column:
    """Weighted mean of the parts that are there, weights renormalised."""
    there = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts])
    total = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in parts])
    return rounded(F.try_divide(total, there) * scale, digits)


def series(code: str = "code", date: str = "bar_date") -> WindowSpec:
    return Window.partitionBy(code).orderBy(date)


def rows(w: WindowSpec, first: int, last: int = 0) -> WindowSpec:
    return w.rowsBetween(first, last)


def full(value: Column, x: Column, frame: WindowSpec, n: int) -> Column:
    """value, where the frame has n values of x."""
    return F.when(F.count(x).over(frame) == n, value)


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    f = rows(w, 1 - n)
    return full(F.avg(x).over(f), x, f, n)


def n_bar_return(x: Column, n: int, w: WindowSpec, digits: int = 1) -> Column:
    past = F.lag(x, n).over(w)
    return F.when(past > 0, F.round((x / past - 1) * 100, digits))


def null_tolerant_least(x: Column, least: float) -> Column:
    """A lower bound that a missing or non-positive value passes."""
    return x.isNull() | (x <= 0) | (x >= least)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def keyword_class(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The class of the first keyword that the text contains, rules in order of priority."""
    found = F.lit(None).cast("string")
    for word, name in reversed(rules):
        found = F.when(F.contains(F.lower(text), F.lit(word.lower())), name).otherwise(found)
    return found


def label_key(x: Column) -> Column:
    """A label without notes in brackets, numbering and white space."""
    bare = F.regexp_replace(x, r"\([^)]*\)|\[[^\]]*\]", "")
    bare = F.regexp_replace(bare, r"^\s*([0-9]+|[IVXivx]+|[A-Za-z가-힣])[.)]\s*", "")
    return F.lower(F.regexp_replace(bare, r"\s+", ""))


def parse_number(x: Column) -> Column:
    """'(1,234)' is -1234; anything that isn't a number is missing."""
    bare = F.regexp_replace(F.trim(x), r"[,\s]", "")
    inner = F.regexp_replace(bare, r"^[(△▲-](.*?)\)?$", "$1")
    value = inner.try_cast("double")
    return F.when(bare.rlike(r"^[(△▲-]"), -value).otherwise(value)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def name_words(x: Column) -> Column:
    """The different words of a name, brackets counting as white space."""
    return F.array_distinct(F.filter(F.split(F.trim(F.lower(F.regexp_replace(x, r"[()]", " "))), r"\s+"), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two names as sets of words."""
    both = F.size(F.array_intersect(name_words(a), name_words(b)))
    return F.try_divide(both.cast("double"), F.size(F.array_union(name_words(a), name_words(b))))
