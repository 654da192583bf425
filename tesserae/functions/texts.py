"""Small text rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and hours that results depend on.
CLOSE_WORD = r"(?<![가-힣])마감|장\s*마감"
DOMESTIC = r"국내|코스피|코스닥|KOSPI|KOSDAQ|국장"
OVERSEAS_CLOSE = r"(미국|뉴욕|나스닥|다우|S&P|해외|글로벌)\s*(증시|주식시장|시장)?\s*마감"
OPENS, CLOSES = (9, 0), 16


def domestic_closing(title: Column) -> Column:
    """A review of the home market's close: a word of closing, and a home word or no foreign market that closes."""
    t = F.coalesce(title, F.lit(""))
    return t.rlike(CLOSE_WORD) & (t.rlike(DOMESTIC) | ~t.rlike(OVERSEAS_CLOSE))


def market_phase(ts: Column, opens: tuple[int, int] = OPENS, closes: int = CLOSES) -> Column:
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.when(F.hour(ts) >= closes, "closing").when(minute >= opens[0] * 60 + opens[1], "intraday").otherwise("forecast")


def mentions(text: Column, name: Column) -> Column:
    """How often a name is in a text, without overlap."""
    return F.when(F.length(name) > 0, (F.length(text) - F.length(F.replace(text, name))) / F.length(name)).otherwise(0).cast("int")


def is_subject(name: Column, title: Column, body: Column, least: int = 3) -> Column:
    """The title has the name (white space aside), or the body has it several times."""
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    return F.coalesce(F.contains(bare(title), bare(name)), F.lit(False)) | F.coalesce(mentions(body, name) >= least, F.lit(False))


def hits(text: Column, words: list[str]) -> Column:
    """The words that a text contains, in order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def queries(name: Column, catalysts: list[str], risks: list[str], per_side: int = 6) -> Column:
    """Search queries: the name and each of the first words of both sides."""
    words = list(dict.fromkeys(catalysts[:per_side] + risks[:per_side]))
    return F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.concat_ws(" ", name, w))


def snippet(body: Column, most: int = 60) -> Column:
    """The start of a text without blank lines, rules and its first line."""
    lines = F.filter(F.split(body, r"\r\n|\n|\r"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("^─+$"))
    text = F.array_join(F.when(F.size(lines) > 1, F.slice(lines, 2, 1_000_000)).otherwise(lines), " ")
    return F.concat(F.left(text, F.lit(most)), F.when(F.length(text) > most, "…").otherwise(""))


def pieces(text: Column, most: int = 4096) -> Column:
    """Parts of at most so many characters, cut at line ends where that is possible."""
    lines = F.split(text, "\n")
    # a line above the bound is cut hard; all but its last part close what was open
    parts = F.flatten(F.transform(lines, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(x) / most).cast("int") - 1)), lambda k: F.struct(F.substring(x, k * most + 1, F.lit(most)).alias("s"), (F.length(x) > (k + 1) * most).alias("hard")))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, p: Column) -> Column:
        closed = F.when(a["open"] != "", F.array_append(a["done"], a["open"])).otherwise(a["done"])
        joined = F.when(a["open"] != "", F.concat(a["open"], F.lit("\n"), p["s"])).otherwise(p["s"])
        return F.when(p["hard"], F.struct(F.array_append(closed, p["s"]).alias("done"), F.lit("").alias("open"))).otherwise(
            F.when(F.length(joined) > most, F.struct(closed.alias("done"), p["s"].alias("open"))).otherwise(F.struct(a["done"].alias("done"), joined.alias("open")))
        )

    return F.aggregate(parts, start, step, lambda a: F.when(a["open"] != "", F.array_append(a["done"], a["open"])).otherwise(a["done"]))


def longest_keyword(text: Column, rules: dict[str, str]) -> Column:
    """The class of the longest keyword in the text, whatever its case."""
    found = F.lit(None).cast("string")
    for word in sorted(rules, key=len):
        found = F.when(F.contains(F.lower(F.trim(text)), F.lit(word.lower())), rules[word]).otherwise(found)
    return found


_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}


def rfc822(x: Column) -> Column:
    """A date like 'Tue, 02 Jan 2024 03:04:05 +0900' as a moment; without a zone it counts as UTC, anything else is missing."""
    part = lambda i: F.regexp_extract(x, r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2}:\d{2})(?: (GMT|UTC|[+-]\d{4}))?\s*$", i)
    month = F.try_element_at(F.create_map(*[F.lit(v) for kv in _MONTHS.items() for v in kv]), part(2))
    zone = F.when(part(5).rlike("^[+-]"), F.concat(F.substring(part(5), 1, 3), F.lit(":"), F.substring(part(5), 4, 2))).otherwise("+00:00")
    return F.try_to_timestamp(F.concat(part(3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit(" "), part(4), zone), F.lit("yyyy-MM-dd HH:mm:ssXXX"))


def rss_items(xml: Column) -> Column:
    """Items of a feed as an array of (title, link, source, published); those without a title are left out."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    entity = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    tag = lambda x, t: F.trim(entity(F.regexp_extract(x, rf"(?s)<{t}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{t}>", 1)))
    rows = F.transform(blocks, lambda x: F.struct(tag(x, "title").alias("title"), tag(x, "link").alias("link"), tag(x, "source").alias("source"), rfc822(tag(x, "pubDate")).alias("published")))
    return F.filter(rows, lambda r: r["title"] != "")
