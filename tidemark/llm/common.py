"""What the operators share: tables, written intermediates, batches of Arrow rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Removes a finished query's shuffle files: once its rows are a table nobody needs them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made for local sessions whose spark.checkpoint.dir is unset (it can't be set while a session runs), by application.
_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a local one only in local mode, where every task shares the machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        base = _LOCAL[context.applicationId]
    return base.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, so a lost executor costs no recomputation."""
    spark, path = df.sparkSession, f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more: what was made of them is itself written."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts, null as empty."""
    return [t or "" for t in column.to_pylist()]


def slabs(batches: Iterable[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded number of rows."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def text_slabs(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text; a longer text may be one of its own."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        slab = np.cumsum(sizes) // size
        for at in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(slab)) + 1):
            if len(at):
                yield b.slice(int(at[0]), len(at))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A shuffle by keys into the session's number of shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
