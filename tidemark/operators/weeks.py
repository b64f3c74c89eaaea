"""Weekly fetch windows, the run ledger, and weekly counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def weekly_windows(spark: SparkSession, first: date, today: date) -> DataFrame:
    """since, until: weeks from the first day on, half open; the last one ends with tomorrow at the latest."""
    one = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(today), F.expr("interval 7 days"))).alias("since"))
    return one.select("since", F.least(F.date_add("since", 7), F.date_add(F.lit(today), 1)).alias("until"))


def unfetched(windows: DataFrame, ledger: DataFrame, account: str) -> DataFrame:
    """Windows without a finished run that covered the complete week."""
    done = ledger.filter((F.lower("account") == account.lower()) & F.col("complete_week") & (F.col("status") == "SUCCEEDED")).select(F.col("since").cast("date").alias("since"), F.col("until").cast("date").alias("until"))
    return windows.join(done, ["since", "until"], "left_anti")


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """Runs, items, posts and cost of each account."""
    total = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero))
    return ledger.groupBy(F.lower("account").alias("account")).agg(F.count("*").alias("runs"), total("items", 0).alias("items"), total("unique_posts", 0).alias("unique_posts"), total("cost_usd", 0.0).alias("cost_usd"))


def other_authors(ledger: DataFrame, n: int = 25) -> DataFrame:
    """Authors other than the account's, by how many of their posts came along."""
    each = ledger.select(F.explode("other_authors").alias("author", "posts"))
    return each.groupBy("author").agg(F.sum("posts").alias("posts")).orderBy(F.desc("posts"), "author").limit(n)


def weekly_counts(windows: DataFrame, posts: DataFrame) -> DataFrame:
    """label, posts, originals of every window, also of weeks without posts.

    Windows are whole weeks of days, so posts are counted by day and days joined to their window, instead of every post to every window.
    """
    days = posts.groupBy(F.to_date("t0").alias("day")).agg(F.count("*").alias("n"), F.count_if(~F.col("is_retweet")).alias("o"))
    covered = windows.withColumn("day", F.explode(F.sequence("since", F.date_sub("until", 1))))
    got = covered.join(days, "day", "left").groupBy("since", "until").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("posts"), F.coalesce(F.sum("o"), F.lit(0)).alias("originals"))
    return got.select(F.concat_ws(" to ", F.col("since").cast("string"), F.date_sub("until", 1).cast("string")).alias("label"), "posts", "originals")


def coverage_counts(posts: DataFrame, by: list[str]) -> DataFrame:
    return posts.groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by)


def search_query(account: str, since: str, until: str) -> str:
    """The search text of one window."""
    return f"from:{account} since:{since} until:{until}"
