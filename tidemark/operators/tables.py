"""Upserts and replacements on plain Parquet tables: each gives the table's new rows; writers replace partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_by_key(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """One row per key, the last one in the given order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if isinstance(order, str) else order.desc())
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """Old rows with `update` columns from the new row of the same key (also where that is NULL), other columns kept; and the new keys.

    rules: expressions on columns old.<c> and new.<c> for columns with a rule of their own.
    """
    rules = rules or {}
    o, n = old.withColumn("_o", F.lit(True)).alias("old"), new.withColumn("_n", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    both = o.join(n, on, "full_outer")
    had, comes = F.col("old._o").isNotNull(), F.col("new._n").isNotNull()
    out = []
    for c in old.columns:
        a, b = F.col(f"old.{c}"), F.col(f"new.{c}")
        value = F.coalesce(a, b) if c in keys else F.when(had & comes, rules[c]).when(had, a).otherwise(b) if c in rules else F.when(comes & (F.lit(c in update) | ~had), b).otherwise(a)
        out.append(value.alias(c))
    return both.select(*out)


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """File rows: the etag stays if the new one is NULL, loaded_at is cleared when the size changes."""
    rules = {"etag": F.coalesce("new.etag", "old.etag"), "loaded_at": F.when(F.col("old.size_bytes") == F.col("new.size_bytes"), F.col("old.loaded_at")), "row_count": F.when(F.col("old.size_bytes") == F.col("new.size_bytes"), F.col("old.row_count"))}
    return upsert(old, new, ["file_date"], ["size_bytes", "downloaded_at"], rules)


def upsert_events(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["event_id"], ["status", "description", "starts_at", "synced_at"])


def upsert_markets(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["market_id"], ["status", "description", "outcomes", "synced_at"])


def upsert_posts(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["post_id"], ["text", "raw", "fetched_at"])


def upsert_classifications(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["post_id", "model", "model_version"], ["sport", "team", "players", "status_change", "template", "detail", "classified_at"])


def replace_resolutions(old: DataFrame, new: DataFrame, version: str, order: str = "resolved_at") -> DataFrame:
    """All rows of the version replaced; of several new rows for a subject the first in the given order stays, of those that tie the one with the least event and status."""
    first = Window.partitionBy("post_id", "model_version", "subject").orderBy(order, "event_id", "status", "reason")
    return old.filter(F.col("model_version") != version).unionByName(new.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth"))


#: A rule gives a table's new rows from its old rows and the rows that come, both of all the keys concerned.
Rule = Callable[[DataFrame, DataFrame], DataFrame]


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_keyed(rows: DataFrame, path: str, keys: list[str], buckets: int = 256) -> None:
    """A table in one folder for each hash bucket of its keys, so that an upsert rewrites just the buckets that it touches; replaces those the rows have."""
    dealt = rows.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_keyed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table's rows; a table that nothing was written to has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).drop("bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def upsert_keyed(new: DataFrame, path: str, keys: list[str], rule: Rule, batch: str, buckets: int = 256) -> None:
    """Puts the rows of a batch into a table of `write_keyed`, whose columns they have; once, however often the batch comes.

    The new rows of the touched buckets are written beside the table first; then they replace these buckets, then the ledger gets the batch with
    its buckets.  A batch that broke off before its rows stood starts anew, one that broke off later replaces the buckets again with
    the same rows, and one that is in the ledger changes nothing.  Reading prunes to the touched buckets, and at most
    one number for each bucket reaches the driver.
    """
    spark, staged, entry = new.sparkSession, f"{path}/_staged/{batch}", f"{path}/_ledger/batch={batch}"
    if _exists(spark, f"{entry}/_SUCCESS"):
        return
    if not _exists(spark, f"{staged}/_SUCCESS"):
        named = new.withColumn("bucket", _bucket(keys, buckets))
        touched = sorted(r[0] for r in named.select("bucket").distinct().collect())
        held = spark.createDataFrame([], new.schema)
        if _exists(spark, path):
            held = spark.read.schema(named.schema).parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket")
        rule(held, new).select(new.columns).write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(new.schema).parquet(staged)
    write_keyed(rows, path, keys, buckets)
    done = rows.groupBy(_bucket(keys, buckets).alias("bucket")).agg(F.count("*").alias("rows"))
    done.coalesce(1).write.mode("overwrite").json(entry)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def manifest(files: DataFrame) -> DataFrame:
    """name and size of archived files (path, size), one row a name: what a later run compares with to skip what has not changed."""
    return files.groupBy(F.regexp_extract("path", "([^/]*)$", 1).alias("name")).agg(F.max("size").alias("size"))


def write_day(trades: DataFrame, path: str) -> None:
    """Replaces the partitions (source, file_date) that the rows have, and no others."""
    trades.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("source", "file_date").parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def compare_files(archived: DataFrame, source: DataFrame) -> DataFrame:
    """path, verdict (missing, extra, size, checksum) where an archive and its source differ; columns path, size, md5."""
    a, s = archived.alias("a"), source.alias("s")
    both = a.join(s, F.col("a.path") == F.col("s.path"), "full_outer")
    verdict = F.when(F.col("a.path").isNull(), "missing").when(F.col("s.path").isNull(), "extra").when(F.col("a.size") != F.col("s.size"), "size").when(F.col("a.md5") != F.col("s.md5"), "checksum")
    return both.select(F.coalesce("a.path", "s.path").alias("path"), verdict.alias("verdict")).filter("verdict is not null")


def deletable(raw: DataFrame, manifest: DataFrame, archive: DataFrame, parquet: DataFrame, failed: DataFrame) -> DataFrame:
    """name, reason: the first reason for which a raw file must stay, NULL if it may go. raw and manifest have name and size, the others name."""
    m = manifest.select("name", F.col("size").alias("m_size"))
    mark = lambda df, c: df.select("name").distinct().withColumn(c, F.lit(True))
    all_ = raw.join(m, "name", "left").join(mark(archive, "local"), "name", "left").join(mark(parquet, "has_parquet"), "name", "left").join(mark(failed, "bad"), "name", "left")
    reason = F.when(F.col("m_size").isNull() | (F.col("m_size") != F.col("size")), "no backup").when(F.col("local").isNull(), "backup not local").when(F.col("has_parquet").isNull(), "no parquet").when(F.col("bad").isNotNull(), "verify failed")
    return all_.select("name", "size", reason.alias("reason"))
