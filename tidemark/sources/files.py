"""File sources with explicit schemas."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.scalar import scraped_time

MEMBERS_OF = pa.schema([("path", pa.string()), ("member", pa.int32()), ("start", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("crc32", pa.int64()), ("verdict", pa.string())])
MEMBERS = MEMBERS_OF.names


def numbered(rows: DataFrame, name: str = "row_num") -> DataFrame:
    """The number of each row in its file, from 1; needs the hidden file columns, so it comes right after a read.

    Rows are numbered inside the blocks that a file is read in, and the counts of a file's earlier blocks are added, so a large file
    takes as many tasks as it has blocks.
    """
    file, block = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    marked = rows.select("*", file, block, F.monotonically_increasing_id().alias("_row"))
    # a column is read for the counts, too: without any a reader may count lines that it skips otherwise
    first = F.max(F.xxhash64(rows.columns[0])).alias("_read")
    counts = marked.groupBy("_file", "_block").agg(F.count("*").alias("_n"), first).filter("_read is not null")
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_file", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = marked.withColumn("_in", F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_row")))
    return inside.join(before, ["_file", "_block"]).withColumn(name, (F.col("_before") + F.col("_in")).cast("int")).select(*rows.columns, name)


def trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw trade columns as strings, with row_num; missing columns are an error that names them, others are ignored."""
    found = spark.read.option("header", True).csv(path)
    gone = [c for c in schemas.RAW_TRADES if c not in found.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return numbered(found).select(*schemas.RAW_TRADES, "row_num")


def stored_trades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STORED_TRADES).parquet(path)


def index_dates(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct days of the daily trade files that index pages link to."""
    links = F.regexp_extract_all(html, F.lit(r"/reporting/trade-data/(\d{4}-\d{2}-\d{2})/trades\.csv"), 1)
    return pages.select(F.explode(links).alias("d")).select(F.col("d").try_cast("date").alias("day")).filter("day is not null").distinct()


def post_items(items: DataFrame, account: str) -> DataFrame:
    """Posts from scraped items; items whose id is no number are dropped, of several with one id any may stay."""
    ok = items.filter(F.rlike("id", F.lit(r"^\d+$")))
    text = F.coalesce(F.nullif("fullText", F.lit("")), F.nullif("text", F.lit("")), F.lit(""))
    return ok.select(F.col("id").cast("long").alias("post_id"), F.coalesce(F.nullif("author.userName", F.lit("")), F.lit(account)).alias("account"), text.alias("text"), scraped_time(F.col("createdAt")).alias("created_at"), F.coalesce("isRetweet", F.lit(False)).alias("is_retweet"), F.coalesce("isQuote", F.lit(False)).alias("is_quote"))


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal lines with their number, which is their order."""
    return numbered(spark.read.schema(schemas.JOURNAL).json(path), "line")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUN_LEDGER).json(path)


def roster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.ROSTER).alias("players"))


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed stream records; gzip files with several members are read whole."""
    return spark.read.schema(schemas.STREAM).json(path)


def gzip_members(contents: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """path, member, start, packed, size, crc32, verdict of every gzip member in files (path, content).

    Verdicts: ok; corrupt where the data or their CRC or length are wrong; truncated where a file ends inside a member; trailing
    for bytes after a member that start none.  After a member that is not ok nothing more of its file can be read.  Members are
    unpacked piece by piece and not kept, so memory does not grow with what is packed; a file without bytes has no member.
    """

    def members(content: bytes) -> Iterator[tuple]:
        view, at, number = memoryview(content), 0, 0
        while at < len(view):
            if number and view[at:at + 2] != b"\x1f\x8b":
                yield number, at, len(view) - at, 0, 0, "trailing"
                return
            unpack, size, crc, fed, verdict = zlib.decompressobj(wbits=31), 0, 0, at, "truncated"
            rest = b""
            try:
                while not unpack.eof and (rest or fed < len(view)):
                    if not rest:
                        rest = bytes(view[fed:fed + piece])
                        fed += len(rest)
                    out = unpack.decompress(rest, piece)
                    size, crc, rest = size + len(out), zlib.crc32(out, crc), unpack.unconsumed_tail
                if unpack.eof:
                    verdict, fed = "ok", fed - len(unpack.unused_data)
            except zlib.error:
                verdict, fed = "corrupt", len(view)
            yield number, at, fed - at, size, crc, verdict
            if verdict != "ok":
                return
            at, number = fed, number + 1

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                rows = [(path.as_py(), *m) for m in members(content.as_buffer().to_pybytes() if content.is_valid else b"")]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(MEMBERS, r, strict=True)) for r in rows], schema=MEMBERS_OF)

    return contents.select("path", "content").mapInArrow(walk, "path string, member int, start bigint, packed bigint, size bigint, crc32 bigint, verdict string")


def archive_verdicts(contents: DataFrame) -> DataFrame:
    """path, members, size (unpacked), verdict: ok, or that of the member at which reading ends; files of no bytes are left out."""
    bad = F.min(F.when(F.col("verdict") != "ok", F.col("verdict")))
    return gzip_members(contents).groupBy("path").agg(F.count("*").alias("members"), F.sum("size").alias("size"), F.coalesce(bad, F.lit("ok")).alias("verdict"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, size, md5 of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.md5("content").alias("md5"))


def completed_days(names: DataFrame, today) -> DataFrame:
    """Folder names that are dates before today."""
    return names.withColumn("day", F.col("name").try_cast("date")).filter(F.col("day") < F.lit(today))


def channels(records: DataFrame) -> DataFrame:
    """conn, recv_ts, kind, market, event_id, channel, seq: one row for each market and channel that has a sequence number."""

    def part(kind: str) -> DataFrame:
        each = records.select("conn", "recv_ts", F.explode(f"msg.{kind}").alias("market", "body"))
        pair = F.explode(F.array(F.struct(F.lit("book").alias("channel"), F.col("body.book.seq").alias("seq")), F.struct(F.lit("lifecycle").alias("channel"), F.col("body.lifecycle.seq").alias("seq")))).alias("c")
        return each.select("conn", "recv_ts", F.lit(kind).alias("kind"), "market", F.col("body.eventId").alias("event_id"), pair).select("conn", "recv_ts", "kind", "market", "event_id", "c.*").filter("seq is not null")

    return part("snapshot").unionByName(part("delta"))


def messages(records: DataFrame) -> DataFrame:
    """The parts of each record in the order in which they count: snapshots (turn 0), the acknowledged nonce (1), deltas (2)."""
    parts = channels(records).withColumn("turn", F.when(F.col("kind") == "snapshot", 0).otherwise(2)).withColumn("nonce", F.lit(None).cast("long"))
    acks = records.filter("msg.nonce is not null").select("conn", "recv_ts", F.lit("ack").alias("kind"), F.lit(1).alias("turn"), F.col("msg.nonce").alias("nonce"))
    return parts.unionByName(acks, allowMissingColumns=True)


def convert(spark: SparkSession, csv: str, parquet: str, day) -> DataFrame:
    """A day's validated trades as a zstd Parquet table beside its CSV; the commit protocol makes the switch whole."""
    from tidemark.operators.ingest import for_day, parse_trades

    for_day(parse_trades(trades_csv(spark, csv)), day).write.mode("overwrite").option("compression", "zstd").parquet(parquet)
    return stored_trades(spark, parquet)


def stream_errors(records: DataFrame) -> DataFrame:
    """Error envelopes as journal lines."""
    code = F.col("msg.code")
    return records.filter(code.isNotNull()).select(F.col("recv_ts").alias("ts"), F.lit("error").alias("kind"), "conn", F.concat_ws(": ", code, "msg.message").alias("detail"))


def sizes(files: DataFrame) -> DataFrame:
    """Number and bytes of files by folder."""
    return files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
