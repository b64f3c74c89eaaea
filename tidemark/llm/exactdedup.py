"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's mergeable frequent-items aggregate) names the
digests that may be frequent; their exact counts are taken, the winners are
broadcast (at most CANDIDATES rows) and settled on the map side.  All other
digests have fewer than 1 row in 500 and go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: With TRACKED counters every digest with more than 1 row in 500 is among the first CANDIDATES.
CANDIDATES, TRACKED = 1024, 8192
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are compared after lower-casing A-Z; null counts as empty, and empty
    texts are equal to one another.  The row with the largest doc_id stays; rows
    that repeat a doc_id and text all count, and all with that doc_id are kept; a
    null doc_id only stays where a group has no other.
    Texts are digested whole; an empty table gives no rows; other columns are
    ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # in pure ASCII lower() touches A-Z only, and is faster
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    sig = written(docs.select("doc_id", F.sha2(low.cast("binary"), 256).alias("text_sha256")), "digests")
    top = sig.agg(F.expr(f"approx_top_k(text_sha256, {CANDIDATES}, {TRACKED})").alias("top"))
    named = top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256"))
    winners = sig.join(F.broadcast(named), "text_sha256", "left_semi").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = F.broadcast(written(winners.filter("group_size > 1").orderBy(F.desc("group_size")).limit(CANDIDATES), "winners"))
    hot = sig.join(winners, "text_sha256")
    cold = sig.join(winners, "text_sha256", "left_anti")
    # aggregated before the shuffle, and joined back by streaming both sides: no group is held by a task
    rest = cold.join(cold.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "text_sha256")
    out = hot.unionByName(rest)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = f"""
WITH s AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM s WINDOW w AS (PARTITION BY text_sha256)
"""
