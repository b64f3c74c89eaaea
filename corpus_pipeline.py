"""From raw documents to packed training sequences: language ID, line dedup, near-duplicate removal, packing.

Every stage but the last returns the columns of its input, other columns
and ones that clash with an operator's own names unchanged; an empty table
gives an empty table.  Repeated rows are kept or dropped alike by the first
two stages; of equal documents the third keeps one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, linededup, packing, setjoin
from tidemark.llm.common import discard, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty ones, too) and documents that fit none of the languages; a mix of two languages stays."""
    return langid.accepted(docs, langid.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of windows of three lines; a document that has no line left is dropped, one with an empty or null text stays."""
    return linededup.without_repeats(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.75 or more, the one with the smallest doc_id stays.

    Every row is a document: rows that share a doc_id, or have none, are told apart by keys of their own for a while and compared like all
    others, so that unlike ones all stay and of equal ones one does.  Where the smallest doc_id is several rows', the one with
    the smallest digest of its text stays; rows without a doc_id come last and keep their null.
    """
    first, last = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    shared = docs.groupBy(F.col("doc_id").alias("shared_id")).agg(F.count("*").alias("n")).filter("n > 1 or shared_id is null").select("shared_id")
    shared = written(shared, "shared_ids")
    if shared.isEmpty():
        return docs.join(_stays(docs), "doc_id", "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("shared_id"))
    step = F.monotonically_increasing_id() + 1
    key = step if last is None else F.lit(last) + step if last < 1 << 62 else F.lit(first) - step
    rows = docs.join(shared, same, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = written(rows.withColumn("doc_id", key), "keyed")
    own = docs.join(shared, same, "left_anti")
    named = keyed.select("doc_id", F.col("row").getField("text").alias("text"))
    groups = written(setjoin.jaccard_components(own.select("doc_id", "text").unionByName(named)).select("doc_id", "component_id"), "groups")
    none, name = F.col("name").isNull().alias("none"), F.struct(F.col("row").getField("doc_id").alias("name"), F.xxhash64(F.col("row").getField("text")).alias("digest"))
    ranked = groups.join(keyed.select("doc_id", name.alias("k")), "doc_id", "left").withColumns({"name": F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("k.name")), "digest": F.col("k.digest")})
    stays = written(ranked.groupBy("component_id").agg(F.min(F.struct(none, "name", "digest", "doc_id")).alias("best")).select(F.col("best.doc_id").alias("doc_id")), "stays")
    back = keyed.join(stays, "doc_id", "left_semi").select("row.*").select(*[F.col(f"`{c}`") for c in docs.columns])
    return own.join(stays, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(back)


def _stays(docs: DataFrame) -> DataFrame:
    return written(setjoin.jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct(), "stays")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document's tokens; null texts give their end id."""
    return packing.pack_documents(docs)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_duplicates", keep_one_of_each_group), ("packing", pack)]

#: The classifier of the first stage can't be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    was = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if was is not None:
            discard(was)  # the next stage's table takes its place
        was = docs
    return STAGES[-1][1](spark, docs, sf_dir)
