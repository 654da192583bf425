"""Queries over statements and filed documents that are made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import statements
from tesserae.sources import grids
from tesserae.sources.views import table

# A tree of accounts, four levels deep: all, by flag, by flag and status, by these and the tens of the quantity.
_TREE = """WITH leaf AS (SELECT DISTINCT l_returnflag AS f, l_linestatus AS s, CAST(floor(l_quantity / 10) AS INT) AS b FROM {lineitem})
SELECT 'ALL' AS account, CAST(NULL AS STRING) AS parent, 0 AS position
UNION ALL SELECT DISTINCT f, 'ALL', CAST(ascii(f) AS INT) FROM leaf
UNION ALL SELECT DISTINCT concat(f, '.', s), f, CAST(ascii(s) AS INT) FROM leaf
UNION ALL SELECT DISTINCT concat(f, '.', s, '.', CAST(b AS STRING)), concat(f, '.', s), b FROM leaf"""
_FACTS = """WITH l AS (SELECT l_suppkey AS e, CAST(year(l_shipdate) AS INT) AS y, l_returnflag AS f, l_linestatus AS s, CAST(floor(l_quantity / 10) AS INT) AS b, CAST(l_extendedprice AS DECIMAL(12, 2)) AS p FROM {lineitem})
SELECT e AS entity, y AS period, concat(f, '.', s, '.', CAST(b AS STRING)) AS account, CAST(sum(p) AS DECIMAL(30, 2)) AS amount FROM l WHERE (e + b) % 7 <> 0 GROUP BY e, y, f, s, b
UNION ALL SELECT e, y, concat(f, '.', s), CAST(sum(p) + CASE WHEN e % 5 = 0 THEN 1000 ELSE 0 END AS DECIMAL(30, 2)) FROM l WHERE (e + y) % 3 = 0 GROUP BY e, y, f, s
UNION ALL SELECT e, y, f, CAST(sum(p) AS DECIMAL(30, 2)) FROM l WHERE (e + y) % 4 = 0 GROUP BY e, y, f"""


def reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts, and the tree of their accounts."""
    lines = table(spark, sf_dir, "lineitem")
    return spark.sql(_FACTS, lineitem=lines), spark.sql(_TREE, lineitem=lines)


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all suppliers and years, rolled up and checked, with the year before."""
    d = lambda c: F.col(c).cast("double").alias(c)
    return statements.roll_up(*reported(spark, sf_dir)).select("entity", "period", "account", "level", F.array_join(F.transform("path", lambda p: p["account"]), "/").alias("path"), d("amount"), d("total"), "children", "ok", d("prior"), statements.change(F.col("amount"), F.col("prior")).alias("change"))


_TREE_SQL = _TREE.replace("{lineitem}", "lineitem").replace("STRING", "VARCHAR")
_FACTS_SQL = _FACTS.replace("{lineitem}", "lineitem").replace("STRING", "VARCHAR")
_ROLLED = f"""tree AS ({_TREE_SQL}), facts AS ({_FACTS_SQL}),
outline(account, level, path) AS (SELECT account, 0, account FROM tree WHERE parent IS NULL UNION ALL SELECT t.account, o.level + 1, o.path || '/' || t.account FROM tree t JOIN outline o ON t.parent = o.account),
-- from every account down to the nearest reported ones
walk(root, first, node) AS (SELECT parent, account, account FROM tree WHERE parent IS NOT NULL),
statements AS (SELECT DISTINCT entity, period FROM facts),
down(entity, period, root, first, node, amount) AS (
  SELECT s.entity, s.period, w.root, w.first, w.node, f.amount FROM statements s, walk w LEFT JOIN facts f ON f.entity = s.entity AND f.period = s.period AND f.account = w.node
  UNION ALL
  SELECT d.entity, d.period, d.root, d.first, t.account, f.amount FROM down d JOIN tree t ON t.parent = d.node LEFT JOIN facts f ON f.entity = d.entity AND f.period = d.period AND f.account = t.account WHERE d.amount IS NULL),
totals AS (SELECT entity, period, root AS account, sum(amount) AS total, count(DISTINCT first) AS children FROM down WHERE amount IS NOT NULL GROUP BY 1, 2, 3),
rolled AS (SELECT entity, period, account, coalesce(f.amount, t.total) AS amount, f.amount AS reported, t.total, coalesce(children, 0) AS children FROM facts f FULL JOIN totals t USING (entity, period, account))"""

HIERARCHY = f"""WITH RECURSIVE {_ROLLED},
prior AS (SELECT r.*, p.amount AS prior FROM rolled r LEFT JOIN rolled p ON r.entity = p.entity AND r.account = p.account AND p.period = r.period - 1)
SELECT entity, period, account, level, path, CAST(amount AS DOUBLE) AS amount, CAST(total AS DOUBLE) AS total, children, abs(reported - total) <= abs(reported) * 0.005 AS ok, CAST(prior AS DOUBLE) AS prior,
  CASE WHEN prior > 0 THEN round(CAST(amount - prior AS DOUBLE) / CAST(prior AS DOUBLE) * 100, 1) + 0.0 END AS change FROM prior JOIN outline USING (account)"""

YEARS = list(range(1995, 2002))


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statements with a column for each year."""
    wide = statements.by_period(*reported(spark, sf_dir), YEARS)
    return wide.select("entity", "account", "level", *[F.col(f"y{y}").cast("double").alias(f"y{y}") for y in YEARS])


STATEMENT_YEARS = f"WITH RECURSIVE {_ROLLED} SELECT entity, account, level, " + ", ".join(f"CAST(max(amount) FILTER (period = {y}) AS DOUBLE) AS y{y}" for y in YEARS) + " FROM rolled JOIN outline USING (account) GROUP BY 1, 2, 3"

# Changes in equity: a document for each customer, a table with a period for each year: opening, a row for each status of orders, closing.
_PARTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_MOVES = f"""SELECT o_custkey AS doc, CAST(year(o_orderdate) AS INT) AS y, o_orderstatus AS label, {", ".join(f"CAST(coalesce(sum(CASE WHEN o_orderpriority = '{p}' THEN CAST(floor(o_totalprice) AS BIGINT) END), 0) AS BIGINT) AS p{i}" for i, p in enumerate(_PARTS))} FROM {{orders}} GROUP BY 1, 2, 3"""


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, body: filed documents with tables whose headings span rows and columns."""
    moves = spark.sql(_MOVES, orders=table(spark, sf_dir, "orders"))
    whole = sum((F.col(f"p{i}") for i in range(1, 5)), F.col("p0"))
    shown = lambda x: F.when(x == 0, "-").when(x < 0, F.concat(F.lit("("), F.format_number(-x, 0), F.lit(")"))).otherwise(F.format_number(x, 0))
    cell = lambda x: F.concat(F.lit("<TD ALIGN='RIGHT'>"), shown(x), F.lit("</TD>"))
    sums = [f"p{i}" for i in range(5)]
    row = lambda label, of: F.concat(F.lit("<TR><TD>"), label, F.lit("</TD>"), *[cell(of(c)) for c in sums], cell(sum((of(c) for c in sums[1:]), of(sums[0]))), F.lit("</TR>\n"))
    yearly = moves.groupBy("doc", "y").agg(F.array_sort(F.collect_list(F.struct("label", row(F.col("label"), F.col).alias("tr")))).alias("rows"), *[F.sum(c).alias(c) for c in sums])  # a row for each status
    from pyspark.sql import Window

    upto = Window.partitionBy("doc").orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the years of one customer
    close = yearly.select("doc", "y", "rows", *[F.sum(c).over(upto).alias(c) for c in sums], *[(F.sum(c).over(upto) - F.col(c)).alias(f"o{c}") for c in sums])
    day = lambda md, kind: F.concat(F.col("y").cast("string"), F.lit(f".{md} ({kind})"))
    block = F.concat(row(day("01.01", "기초자본"), lambda c: F.col(f"o{c}")), F.array_join(F.transform("rows", lambda r: r["tr"]), ""), row(day("12.31", "기말자본"), F.col))
    held = close.select("doc", F.struct("y", block.alias("block")).alias("b")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "").alias("blocks"))
    head = (
        "<TABLE><TR><TH ROWSPAN='3'>과목</TH><TH COLSPAN='4'>지배기업 소유주지분</TH><TH ROWSPAN='3'>5-LOW</TH><TH ROWSPAN=3>자본총계</TH></TR>"
        "<TR><TH COLSPAN=2>빠른 &amp; 급한</TH><TH ROWSPAN=2>3-MEDIUM</TH><TH ROWSPAN='2'>4-NOT SPECIFIED 합계</TH></TR><TR><TH>1-URGENT</TH><TH>2-HIGH</TH></TR>\n"
    )
    name, unit = F.when(F.col("doc") % 2 == 0, "연결 자본변동표").otherwise("자본변동표"), F.when(F.col("doc") % 3 == 0, "천원").otherwise("원")
    return held.select("doc", F.concat(F.lit("<P>목차</P><TABLE><TR><TD>1.</TD><TD>x</TD></TR></TABLE><P>"), name, F.lit("</P><P>(단위 : "), unit, F.lit(")</P>"), F.lit(head), "blocks", F.lit("</TABLE>")).alias("body"))


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes in equity, read back from the filed documents."""
    return grids.equity_changes(filed(spark, sf_dir))


EQUITY = f"""WITH m AS ({_MOVES.replace("{orders}", "orders")}),
l AS (SELECT doc, y, label, unnest([{", ".join(f"'{p}'" for p in _PARTS)}, 'whole']) AS part, unnest([p0, p1, p2, p3, p4, p0 + p1 + p2 + p3 + p4]) AS v FROM m),
y AS (SELECT doc, y, part, sum(v) AS v FROM l GROUP BY 1, 2, 3), c AS (SELECT doc, y, part, v, sum(v) OVER (PARTITION BY doc, part ORDER BY y) AS closing FROM y),
k AS (SELECT doc, y, count(DISTINCT label) AS n FROM l GROUP BY 1, 2),
r AS (SELECT doc, y, row_number() OVER (PARTITION BY doc, y, part ORDER BY label) AS step, label, part, v FROM l
  UNION ALL SELECT doc, y, 0, 'opening', part, closing - v FROM c UNION ALL SELECT doc, y, n + 1, 'closing', part, closing FROM c JOIN k USING (doc, y))
SELECT doc, CASE WHEN doc % 2 = 0 THEN 'consolidated' ELSE 'separate' END AS scope, make_date(y, 12, 31) AS ends, CAST(step AS INTEGER) AS step, label, part, CAST(v AS DOUBLE) * CASE WHEN doc % 3 = 0 THEN 1000 ELSE 1 END AS amount FROM r WHERE v <> 0"""

QUERIES = {"f47_hierarchy": hierarchy, "f47_years": years, "s12_equity_changes": equity}
ORACLES = {"f47_hierarchy": HIERARCHY, "f47_years": STATEMENT_YEARS, "s12_equity_changes": EQUITY}
