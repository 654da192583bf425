"""Statements as trees of accounts: roll-up, checks of totals, the year before, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tesserae.operators.shared import stored

#: Accounts that are broadcast at most: a chart of accounts, not facts.
BROADCAST_ACCOUNTS = 100_000
#: Summed facts that a task takes, on average.
PART_FACTS = 100_000


def outline(accounts: DataFrame) -> DataFrame:
    """accounts: account, parent, position.  account, parent, level (roots 0) and path, which sorts a statement as it is printed.

    Recursive SQL, so of any depth; accounts that no root leads to (rings among them) have no row.
    """
    return accounts.sparkSession.sql(
        """WITH RECURSIVE t(account, parent, level, path) AS (
             SELECT account, parent, 0, array(struct(position, account)) FROM {accounts} WHERE parent IS NULL
             UNION ALL
             SELECT a.account, a.parent, t.level + 1, concat(t.path, array(struct(a.position, a.account))) FROM {accounts} a JOIN t ON a.parent = t.account)
           SELECT * FROM t""",
        accounts=accounts,
    )


def roll_up(facts: DataFrame, accounts: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """facts: entity, period (a year), account, amount.  A row for each account with an amount or with any below it.

    amount is what was reported, else the total of the accounts right below; total is that
    total; ok says whether both agree, by the tolerance as a share of the reported one (missing where only one is there); prior is the amount of the year before.
    Several facts of one account add up; null amounts and accounts outside the tree are left out.

    Facts are summed, stored and counted, and dealt by entity once, into so many parts that a task's share doesn't grow with
    them: levels are added from the deepest up, each row handing its amount to its parent, and neither they nor the year before need another exchange.
    """
    rows, place = _levels(facts, accounts)
    year = Window.partitionBy("entity", "account").orderBy("period")
    before = F.when(F.lag("period").over(year) == F.col("period") - 1, F.lag("amount").over(year))
    agree = F.abs(F.col("reported") - F.col("total")) <= F.abs(F.col("reported")) * F.lit(tolerance).cast("decimal(10,6)")
    dated = rows.withColumn("amount", F.coalesce("reported", "total")).withColumn("prior", before)  # before paths, which are wide, are there to be sorted
    return dated.join(place, "account").select("entity", "period", "account", "parent", "level", "path", "amount", "reported", "total", "children", agree.alias("ok"), "prior")


def by_period(facts: DataFrame, accounts: DataFrame, periods: list[int]) -> DataFrame:
    """facts as in ``roll_up``.  A row for each entity and account with an amount, a column y<period> for each stated period; nothing is dealt but the facts."""
    rows, place = _levels(facts, accounts)
    amount = F.coalesce("reported", "total")
    wide = rows.groupBy("entity", "account").agg(*[F.max(F.when(F.col("period") == p, amount)).alias(f"y{p}") for p in periods])
    return wide.join(place, "account").select("entity", "account", "level", "path", *[f"y{p}" for p in periods])


def _levels(facts: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entity, period, account, reported, total, children, all of an entity in one part; the outline of the accounts."""
    tree = outline(accounts)
    n, depth = tree.agg(F.count("*"), F.coalesce(F.max("level"), F.lit(0))).head()
    place = F.broadcast(tree) if n <= BROADCAST_ACCOUNTS else tree
    money = "decimal(38,6)"
    summed = stored(facts.where("amount is not null").groupBy("entity", "period", "account").agg(F.sum("amount").cast(money).alias("reported")), "facts")
    parts = max(int(summed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-summed.count() // PART_FACTS))
    rows = summed.repartition(parts, "entity").select("entity", "period", "account", "reported", F.lit(None).cast(money).alias("total"), F.lit(0).cast("bigint").alias("children"))
    amount = F.coalesce("reported", "total")
    for level in range(depth, 0, -1):
        own = F.struct("account", "reported", "total", "children")
        given = F.struct(F.col("parent").alias("account"), F.lit(None).cast(money).alias("reported"), amount.alias("total"), F.lit(1).cast("bigint").alias("children"))
        both = rows.join(place, "account").select("entity", "period", F.inline(F.when(F.col("level") == level, F.array(own, given)).otherwise(F.array(own))))
        rows = both.groupBy("entity", "period", "account").agg(F.max("reported").alias("reported"), F.sum("total").cast(money).alias("total"), F.sum("children").alias("children"))
    # accounts that no root leads to have no place
    return rows, place


def change(new: Column, old: Column) -> Column:
    """Growth in percent, where the old amount is positive."""
    return F.when(old > 0, F.round((new - old).cast("double") / old.cast("double") * 100, 1))
