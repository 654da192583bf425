"""Mentions of names of any number of words in texts.

All names are searched in one pass by an Aho-Corasick automaton.  A name that is
part of other names (its confusables) is only searched after these have been
taken out of the text, the longest first, and a name with ``MOST`` and more of them
is an abbreviation that isn't searched at all.  What is left of a text must have the name on
its own: no Korean or Latin letter and no digit beside it.  Which names are parts of
others is found by the same automaton, run over the names.

The names' characters, and those of what they are part of, are counted before they are sent to tasks; beyond
``LIMIT`` they are split by a hash into automata of at most about that size, and texts are
read once for each.  A name is settled in the task that finds it, so no text is handed on.

Codes of equal names have equal mentions, so these are found once for a group of such codes.  Pairs of
texts and codes, which grow with both, are made last, by a join that deals none of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tesserae.operators.shared import stored

#: Names with so many confusables are off.
MOST = 4
#: Characters of the names of one automaton, about.
LIMIT = 20_000_000
#: Names, or codes with their group, that are broadcast at most.
BROADCAST_NAMES = 500_000
#: A letter or digit beside a name; marks of products that are named after a company without being another one.
BESIDE = "가-힣A-Za-z0-9"
PREFERRED = "우[A-C]?"
PRODUCTS = (
    "KODEX|TIGER|KIWOOM|SOL|RISE|PLUS|ACE|WON|UNICORN|HANARO|KOSEF|ARIRANG|KBSTAR|TIMEFOLIO|"
    "채권혼합|레버리지|인버스|단일종목|선물|ETN|액티브|커버드콜|밸류체인|그룹플러스|포커스|[0-9]+호$"
)


def _automaton(words: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


def _split(words: DataFrame, limit: int) -> list[list[Row]]:
    """words: name, all different, and perhaps others, and more.  Lists of rows of at most about limit characters of names and others in all."""
    size = F.length("name") + (F.aggregate("others", F.lit(0), lambda n, o: n + F.length(o)) if "others" in words.columns else F.lit(0))
    total = words.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).head()["n"]
    parts = max(1, -(-total // limit))
    at = F.pmod(F.xxhash64("name"), F.lit(parts))
    return [words.where(at == i).collect() for i in range(parts)]  # counted above


def _found(texts: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, name) of each name in each text, wherever it stands."""
    sent = texts.sparkSession.sparkContext.broadcast(words)
    id_type = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _automaton(sent.value) if sent.value else None
        for batch in batches:
            ids, names = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                for name in sorted({name for _, name in search.iter(x)}) if search and x else ():
                    ids.append(i)
                    names.append(name)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(names, pa.string())], names=[key, "name"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {id_type}, name string")


def _different(names: DataFrame) -> DataFrame:
    return names.where(F.length(F.trim("name")) > 0).select("name").distinct()


def confusables(names: DataFrame, most: int = MOST, limit: int = LIMIT) -> DataFrame:
    """names: name.  Each name that can be searched, with the longer names it is part of (fewer than most, the longest first)."""
    words = _different(names)
    longer = words.select(F.col("name").alias("other"))
    pairs = None
    for part in _split(words, limit):
        got = _found(longer, "other", "other", [r.name for r in part])
        pairs = got if pairs is None else pairs.unionByName(got)
    rest = F.substring("other", F.length("name") + 1, F.length("other"))
    preferred = F.startswith("other", F.col("name")) & rest.rlike(f"^{PREFERRED}$")
    pairs = pairs.where((F.col("name") != F.col("other")) & ~preferred & ~F.col("other").rlike(PRODUCTS))
    few = pairs.groupBy("name").agg(F.count("*").alias("n"))
    off = few.where(F.col("n") >= most).select("name")
    kept = pairs.join(few.where(F.col("n") < most).select("name"), "name", "left_semi").groupBy("name").agg(F.collect_list("other").alias("others"))  # fewer than most
    ordered = F.array_sort("others", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    empty = F.array().cast("array<string>")
    return words.join(off, "name", "left_anti").join(kept, "name", "left").select("name", F.coalesce(ordered, empty).alias("others"))


def mentions(texts: DataFrame, names: DataFrame, most: int = MOST, limit: int = LIMIT) -> DataFrame:
    """texts: t_id, text.  names: code, name.  (t_id, code) of each name that a text has on its own.

    Null texts and names mention nothing; equal names belong to all their codes; repeated texts of one t_id count as one.
    """
    codes, found = grouped(texts, names, most, limit)
    # each pair is made where its text lies: a name of many codes in many texts has no task to itself, and as pairs are different they need no exchange
    parts = max(1, -(-codes.count() // BROADCAST_NAMES))
    if parts > 1:
        found = stored(found, "mentions")
    at = F.pmod(F.xxhash64("code"), F.lit(parts))
    pairs = [found.join(F.broadcast(codes.where(at == i)), "group").select("t_id", "code") for i in range(parts)]  # counted
    return reduce(DataFrame.unionByName, pairs)


def grouped(texts: DataFrame, names: DataFrame, most: int = MOST, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """As ``mentions``, but counted once for a group of codes with equal names: (code, group) and (t_id, group), all different."""
    names = stored(names.select("code", "name"), "named")  # it may take all texts to make them
    codes, sets = called(names)
    groups = stored(sets.select("called").distinct().select(F.monotonically_increasing_id().alias("group"), "called"), "groups")
    codes = stored(codes.join(groups, "called").select("code", "group"), "codes")
    members = groups.select("group", F.explode("called").alias("name"))
    usable = stored(confusables(names, most, limit), "names")
    # a row for each text with the names that it has
    held = [_held(texts, part) for part in _split(usable.select("name", (F.size("others") == 0).alias("free"), "others"), limit)]
    small = F.broadcast if members.count() <= BROADCAST_NAMES else (lambda df: df)
    found = reduce(DataFrame.unionByName, held).select("t_id", F.explode("names").alias("name")).join(small(members), "name")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named: few bytes here may be many pairs later
    return codes, found.select("t_id", "group").repartition(parts, "t_id", "group").distinct()


def called(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """names: code, name.  Codes with the set of their names (code, called), and the different sets with their names (called, name).

    Codes of equal names have equal mentions, so these are counted once for a set, and not for each of its codes.
    """
    codes = names.where(F.length(F.trim("name")) > 0).groupBy("code").agg(F.array_sort(F.collect_set("name")).alias("called"))  # the names of one code
    return codes, codes.select("called").distinct().select("called", F.explode("called").alias("name"))


def _stands(text: str, name: str, beside: re.Pattern[str]) -> bool:
    """Whether a name stands in a text on its own."""
    at = text.find(name)
    while at >= 0:
        if not (at and beside.match(text, at - 1)) and not beside.match(text, at + len(name)):
            return True
        at = text.find(name, at + 1)
    return False


def _held(texts: DataFrame, words: list[Row]) -> DataFrame:
    """words: name, free (no part of others), and the others, the longest first.  t_id, text, names: without the text the names that stand there on their own, once the others are taken out.

    Names that are not free and come without their others can't be settled: the text goes on with those that it has.
    """
    sent = texts.sparkSession.sparkContext.broadcast({r.name: () if r.free else tuple(r.others) if "others" in r else None for r in words})
    id_type = texts.schema["t_id"].dataType.simpleString()
    beside = re.compile(f"[{BESIDE}]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longer = sent.value
        search = _automaton(list({*longer, *(o for others in longer.values() for o in others or ())})) if longer else None
        for batch in batches:
            at, out, names = [], [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                seen, single, settled, open_ = set(), set(), set(), set()
                for end, name in search.iter(x) if search and x else ():
                    seen.add(name)
                    if name not in single:
                        start = end - len(name)
                        if not (start >= 0 and beside.match(x, start)) and not beside.match(x, end + 1):
                            single.add(name)
                for name in seen:
                    others = longer.get(name, ())
                    if others is None:
                        open_.add(name)
                    elif seen.isdisjoint(others):  # nothing to take out
                        if name in single and name in longer:
                            settled.add(name)
                    elif _stands(reduce(lambda left, other: left.replace(other, " "), others, x), name, beside):
                        settled.add(name)
                for text, got in ((None, settled), (x, open_)):
                    if got:
                        at.append(i)
                        out.append(text)
                        names.append(sorted(got))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string()), pa.array(names, pa.list_(pa.string()))], names=["t_id", "text", "names"])

    return texts.select("t_id", "text").mapInArrow(run, f"t_id {id_type}, text string, names array<string>")
