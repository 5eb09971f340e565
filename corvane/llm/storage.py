"""Places for intermediate tables that every executor can reach."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_made: dict[str, int] = {}  # by which thread


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in a local session that names none (tests), a new temporary one.

    On a cluster without that setting there is no folder that all executors are known to share: ValueError.
    """
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp()
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def table(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    files: at most so many, for tables that are small beside the number of partitions that they come from. They go when
    the session ends, or earlier by drop().
    """
    spark = df.sparkSession
    df = df if files is None else df.coalesce(files)
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, where = _place(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    _made[path] = threading.get_ident()
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that nothing reads any more; what is no table() is left alone."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            delete(df.sparkSession, [path])


def made() -> list[str]:
    """The folders of all tables that this thread has made and that are not deleted."""
    return [p for p, thread in list(_made.items()) if thread == threading.get_ident()]


def read_by(df: DataFrame) -> set[str]:
    """The folders that the plan of a DataFrame reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    files = (x for x in map(leaves.apply, range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRelation")
    roots = [x.relation().location().rootPaths() for x in files if x.relation().getClass().getSimpleName() == "HadoopFsRelation"]
    return {r.apply(i).toString() for r in roots for i in range(r.size())}


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables by their folders."""
    for path in paths:
        if _made.pop(path, None) is not None:
            fs, where = _place(spark, path)
            fs.delete(where, True)
