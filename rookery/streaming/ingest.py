"""Chunks that arrive in a folder: each micro-batch takes one descent step on a table of weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from rookery.operators import linear

CHUNK_SCHEMA = "row_ord long, y double, idx long, value double"


def learn_from_folder(spark: SparkSession, chunks: str, weights: str, checkpoint: str, rate: float, penalty: float) -> StreamingQuery:
    """Follows Parquet chunks (row_ord, y, idx, value) and appends weights by batch to a table.

    A batch that runs again after a failure writes its own partition again, so it counts once.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.select("row_ord", "y").distinct()
        if rows.isEmpty():
            return
        before = current_weights(spark, weights, number)
        guess = linear.predict_with_values(batch.select("row_ord", "idx", "value"), before, "row_ord")
        none = F.array().cast("array<struct<idx:bigint,value:double>>")
        left = rows.join(guess, "row_ord", "left").select(F.coalesce("v", none).alias("v"), (F.col("y") - F.coalesce("y_hat", F.lit(0.0))).alias("residual"))
        g = linear.gradient(left)
        linear.step(linear.l2_shrink(g, before, penalty), rate).write.mode("overwrite").parquet(f"{weights}/batch={number}")

    return spark.readStream.schema(CHUNK_SCHEMA).parquet(chunks).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_weights(spark: SparkSession, weights: str, before: int | None = None) -> DataFrame:
    """idx and w of the last batch, or of the last one before a number; empty if there is none."""
    empty = spark.createDataFrame([], "idx long, w double")
    path = spark._jvm.org.apache.hadoop.fs.Path(weights)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return empty
    numbers = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path) if f.getPath().getName().startswith("batch=")]
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{weights}/batch={max(numbers)}") if numbers else empty
