"""Line dedup by overlapping windows of three lines.

A window of three consecutive lines that occurs more than once in the corpus keeps its
first occurrence (smallest doc_id, then position); the lines that later
occurrences cover are merged into runs and removed.

Windows are hashed once and written as arrays, a row a document.  Their first
occurrences are aggregated on the map side before any shuffle; a window with more
than one occurrence in HOT goes to every task by broadcast (fewer than HOT rows
exist), all others are joined by a shuffle, so no frequent line fills a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LINES = 3
#: A window with more than one in HOT of all occurrences is broadcast: there are fewer than HOT such windows.
HOT = 1024
#: The order of occurrences: by doc_id, rows without one last; then by text digest and position.
PLACE = ("_none", "doc_id", "_a", "_b", "_pos")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, all columns in _row, and a row's identity: _none and two digests of doc_id and text."""
    none = F.col("doc_id").isNull()
    a, b = F.xxhash64(F.lit(1), none, "doc_id", "text"), F.xxhash64(F.lit(2), "text", "doc_id", none)
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), none.alias("_none"), a.alias("_a"), b.alias("_b"))


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """_none, doc_id, _a, _b and _hashes: two hashes of each window of a text that has any, made of the hashes of its lines."""
    of_line = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("x"), F.hash(x).alias("y")))
    part = lambda c: ", ".join(f"_l[i + {k}].{c}" for k in range(lines))
    hashed = F.expr(f"transform(slice(_l, 1, greatest(size(_l) - {lines - 1}, 0)), (v, i) -> struct(xxhash64({part('x')}) as _h, hash({part('y')}) as _g))")
    split = _keyed(docs).filter("text is not null").select("_none", "doc_id", "_a", "_b", of_line.alias("_l"))
    return split.filter(F.size("_l") >= lines).select("_none", "doc_id", "_a", "_b", hashed.alias("_hashes"))


def runs(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """_a, _b, _cut of the rows that hold later occurrences: the sorted, disjoint runs of lines (from, up to) that these cover."""
    kept = written(windows(docs, lines), "windows")
    each = kept.select("_none", "doc_id", "_a", "_b", F.posexplode("_hashes").alias("_pos", "_w")).select("_none", "doc_id", "_a", "_b", "_pos", "_w.*")
    place = F.struct(*PLACE)
    firsts = written(each.groupBy("_h", "_g").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1"), "firsts")
    total = kept.agg(F.coalesce(F.sum(F.size("_hashes").cast("long")), F.lit(0).cast("long"))).first()[0]
    hot = F.col("_n") * HOT > total
    after = place > F.col("_first")
    by_hash = lambda side: each.join(side.select("_h", "_g", "_first"), ["_h", "_g"]).filter(after).select("_a", "_b", "_pos")
    later = by_hash(F.broadcast(firsts.filter(hot))).unionByName(by_hash(firsts.filter(~hot))).distinct()
    order = Window.partitionBy("_a", "_b").orderBy("_pos")
    gap = F.col("_pos") > F.lag("_pos").over(order) + lines
    numbered = later.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    merged = numbered.groupBy("_a", "_b", "_run").agg(F.min("_pos").alias("a"), (F.max("_pos") + lines).alias("b"))
    return merged.groupBy("_a", "_b").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_cut"))


def _cut(docs: DataFrame, lines: int) -> DataFrame:
    """_row with every row's _text, _lines and _removed."""
    kept = F.expr("""array_join(flatten(transform(sequence(0, size(_cut)), k ->
        slice(split(text, '\n', -1), if(k = 0, 0, _cut[k - 1].b) + 1, if(k = size(_cut), size(split(text, '\n', -1)), _cut[k].a) - if(k = 0, 0, _cut[k - 1].b)))), '\n')""")
    removed = F.coalesce(F.expr("aggregate(_cut, 0L, (s, x) -> s + x.b - x.a)"), F.lit(0).cast("long"))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    # the text moves once, inside its row
    whole = _keyed(docs).select("_a", "_b", "_row").join(runs(docs, lines), ["_a", "_b"], "left").withColumn("text", F.col("_row").getField("text"))
    return whole.select("_row", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(kept).alias("_text"), n.alias("_lines"), removed.alias("_removed"))


def line_dedup(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """The documents with `text` rebuilt from the lines that stay, and n_lines, n_removed.

    A null text stays null, with 0 lines; texts with fewer than `lines` lines stay
    as they are, however long.  Rows are told apart by doc_id and text: rows
    that repeat both count as one document and keep the same lines, rows that
    share a doc_id only are documents of their own, in the order of their text's
    digest.  Rows without a doc_id come after all others.  Windows are equal
    when two hashes of together 96 bits are.  Other columns pass through, but
    for ones named n_lines or n_removed, which are replaced; an empty table
    gives no rows.
    """
    passed = [(F.col("_text") if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _cut(docs, lines).select(*passed, F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"))


def without_repeats(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """The documents with just their own columns, cut as in line_dedup; n_chars, where there is one, follows the text, and a document that loses all its lines goes."""
    lean = _cut(docs, lines).filter("_lines = 0 or _lines > _removed")
    own = lambda c: F.col("_row").getField(c)
    value = {"text": F.col("_text"), "n_chars": F.when(F.col("_removed") > 0, F.length("_text")).otherwise(own("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return lean.select(*[(value[c] if c in value else own(c)).alias(c) for c in docs.columns])


SQL = """
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i AS pos, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS k
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS i FROM l WHERE len(ls) >= 3)),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS rn FROM w),
c AS (SELECT DISTINCT doc_id, pos + d AS line FROM o, (SELECT unnest([0, 1, 2]) AS d) WHERE rn > 1),
g AS (SELECT doc_id, list(line) AS cut FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN cut IS NULL THEN text
    ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(cut, i)), lambda i: ls[i + 1]), chr(10)), '') END AS text,
  CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines, coalesce(len(cut), 0) AS n_removed
FROM l LEFT JOIN g USING (doc_id)
"""
