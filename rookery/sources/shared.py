"""The folder that driver and executors share, for tables that cut a plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the session's checkpoint folder.

    Only a session within one process (tests, a laptop) gets a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rookery-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark)}/rookery-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "table", most: int | None = None) -> DataFrame:
    """df written once to the shared folder as Parquet; later reads survive lost executors and start there.

    most: files and tasks that the last stage takes at most, for tables whose size is known.
    """
    path = new_path(df.sparkSession, name)
    (df if most is None else df.coalesce(most)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df written once to the checkpoint folder, its partitions and the order of their rows as they are; reads go row by row and hold nothing."""
    folder, sc = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that kept() wrote and that nothing will read any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dealt(df: DataFrame, key: str, rows: int, rows_per_task: int) -> DataFrame:
    """df partitioned by key into a part for each rows_per_task of rows; unlike parts of a join or grouping they are never merged by their bytes."""
    return df.repartition(max(1, -(-rows // rows_per_task)), key)


def release_path(spark: SparkSession, path: str) -> None:
    """Deletes what was written to a path of new_path()."""
    if "/rookery-" in path:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables that settled() wrote and that nothing will read any more."""
    for path in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        release_path(tables[0].sparkSession, path)
