"""Weight files: one pair a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.scalars import truncate_x100

_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"


def read_weights(texts: DataFrame, per_unit: float = 100.0) -> DataFrame:
    """idx, mg and eg from whole files (value): lines of pairs in order, others skipped, divided by per_unit."""
    lines = texts.select(F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(rf"\({_NUMBER}, ?{_NUMBER}\)")).alias("l")).select(F.posexplode("l").alias("idx", "line"))
    pick = lambda k: F.regexp_extract("line", rf"\({_NUMBER}, ?{_NUMBER}\)", k).cast("double") / per_unit
    return lines.select(F.col("idx").cast("long").alias("idx"), pick(1).alias("mg"), pick(2).alias("eg"))


def weight_lines(weights: DataFrame) -> DataFrame:
    """idx and its line as decimals."""
    return weights.select("idx", F.format_string("\tScore_Pair(%.6f,%.6f),", "mg", "eg").alias("line"))


def weight_lines_x100(weights: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """idx and its line as integers, 100 times the weight cut towards zero; divided by the feature's scale first."""
    w = weights if scales is None else weights.join(scales, "idx").withColumns({"mg": F.col("mg") / F.col("scale"), "eg": F.col("eg") / F.col("scale")})
    whole = w.select("idx", F.expr(truncate_x100("mg")).alias("mg"), F.expr(truncate_x100("eg")).alias("eg"))
    return whole.select("idx", F.format_string("\tScore_Pair(%d,%d),", "mg", "eg").alias("line"))


def save_lines(lines: DataFrame, path: str) -> None:
    """One text file in order of idx; a weight file has one line a feature, whatever the data."""
    lines.repartition(1).sortWithinPartitions("idx").select("line").write.mode("overwrite").text(path)


def write_snapshot(weights: DataFrame, trained: DataFrame, epoch: int, path: str) -> None:
    """Weights (idx, mg, eg) of an epoch in a partition of its own, with the ones it was trained to (idx, mg, eg), which scales may have changed.

    The partition is written anew, so an epoch that runs again after a failure is there once; it counts from when the
    writer's marker is there.
    """
    state = trained.select("idx", F.col("mg").alias("trained_mg"), F.col("eg").alias("trained_eg"))
    weights.join(state, "idx").coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs whose snapshots are whole."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(jvm(path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(jvm(path))]
    return sorted(int(n[6:]) for n in names if n.startswith("epoch=") and fs.exists(jvm(f"{path}/{n}/_SUCCESS")))


def last_snapshot(spark: SparkSession, path: str) -> tuple[int, DataFrame] | None:
    """The last of the epochs that follow each other from 0 on, and its trained weights (idx, mg, eg)."""
    last = -1
    for epoch in _epochs(spark, path):
        if epoch != last + 1:
            break
        last = epoch
    if last < 0:
        return None
    return last, spark.read.parquet(f"{path}/epoch={last}").selectExpr("idx", "trained_mg AS mg", "trained_eg AS eg")


def drop_snapshots(spark: SparkSession, path: str) -> None:
    """Deletes the snapshots in path, nothing else."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(jvm(path)):
        for f in fs.listStatus(jvm(path)):
            if f.getPath().getName().startswith("epoch="):
                fs.delete(f.getPath(), True)
