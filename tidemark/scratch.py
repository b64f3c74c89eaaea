"""Written intermediates: tables in the shared folder that the cluster names, which cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for local sessions whose spark.checkpoint.dir is unset, by application.
_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only in local mode, where every task shares it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="tidemark-")
        _LOCAL[context.applicationId] = base
    return base.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path for a table that nothing else has."""
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a Parquet table: computed once, however often they are read."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def merged(side: DataFrame) -> DataFrame:
    """One side of a join that grows with the input: it is shuffled and never broadcast.  A written table is a small file however many rows it has, so Spark would take it through the driver."""
    return side.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
