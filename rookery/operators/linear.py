"""The linear model: phase expansion, predictions, gradients and steps on tables of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions.scalars import win_probability

#: Features or weights that may be broadcast: models have a row a feature, not a row a record.
MOST_FEATURES = 1 << 20


def small(d: DataFrame, most: int = MOST_FEATURES) -> DataFrame:
    """d, a stored or otherwise cheap table, for a broadcast if its rows, counted up to the bound, allow one; a larger one is joined by shuffle."""
    return F.broadcast(d) if d.limit(most + 1).count() <= most else d


def phase_expand(d: DataFrame, half: int) -> DataFrame:
    """Rows (.., idx, value, mg, eg) twice: value * mg / 24 at idx, value * eg / 24 at idx + half. No shuffle."""
    pair = F.explode(F.array(F.struct(F.col("idx").alias("idx"), (F.col("value") * F.col("mg") / 24).alias("value")), F.struct((F.col("idx") + half).alias("idx"), (F.col("value") * F.col("eg") / 24).alias("value"))))
    keep = [c for c in d.columns if c not in ("idx", "value")]
    return d.select(*keep, pair.alias("p")).select(*keep, "p.*")


def scale_features(d: DataFrame, scales: list[float]) -> DataFrame:
    """value / scales[idx]; rows of other features go. No join: the scales are part of the expression."""
    return d.filter(F.col("idx").between(0, len(scales) - 1)).withColumn("value", F.col("value") / F.get(F.array(*[F.lit(float(x)) for x in scales]), F.col("idx").cast("int")))


def _scored(d: DataFrame, weights: DataFrame, row: str, *more: Column) -> DataFrame:
    d = d.join(small(weights), "idx", "left")
    return d.groupBy(row).agg(F.sum(F.coalesce("w", F.lit(0.0)) * F.col("value")).alias("y_hat"), *more)


def predict(d: DataFrame, weights: DataFrame, row: str = "row_id") -> DataFrame:
    """row and y_hat, the sum of weight and value; a feature without weight adds nothing.

    Weights are a row for each feature and broadcast while they are few; sums are taken before the one shuffle.
    """
    return _scored(d, weights, row)


def predict_with_values(d: DataFrame, weights: DataFrame, row: str = "row_id") -> DataFrame:
    """predict() with v, the row's (idx, value), for gradients: the shuffle brings the values of a row together."""
    return _scored(d, weights, row, F.collect_list(F.struct("idx", "value")).alias("v"))


def gradient(rows: DataFrame) -> DataFrame:
    """idx and the mean over rows (v, residual) of residual * value.

    Rows are taken apart where they are: each partition sums its features, and a row a feature is shuffled. The number of
    rows is summed along, under no feature.
    """
    none = F.array(F.struct(F.lit(None).cast("long").alias("idx"), F.lit(None).cast("double").alias("value")))
    e = rows.select("residual", F.explode(F.concat(F.transform("v", lambda x: F.struct(x["idx"].cast("long").alias("idx"), x["value"].cast("double").alias("value"))), none)).alias("e"))
    sums = e.groupBy("e.idx").agg(F.sum(F.col("residual") * F.col("e.value")).alias("s"), F.count("*").alias("n"))
    n = F.max(F.when(F.col("idx").isNull(), F.col("n"))).over(Window.partitionBy(F.lit(0)))
    return sums.withColumn("g", F.col("s") / n).filter("idx is not null").select("idx", "g")


def logistic_residuals(d: DataFrame, mix: float) -> DataFrame:
    """mix * (q - p) + (1 - mix) * (q - t), by the chances of label, prediction and result."""
    p, q = F.expr(win_probability("y")), F.expr(win_probability("y_hat"))
    t = (F.col("result") + 1) / 2
    return d.withColumn("residual", mix * (q - p) + (1 - mix) * (q - t))


def l2_shrink(grad: DataFrame, weights: DataFrame, penalty: float) -> DataFrame:
    """Gradient less penalty * weight, for every weight."""
    return weights.join(grad, "idx", "full_outer").select("idx", F.coalesce("w", F.lit(0.0)).alias("w"), (F.coalesce("g", F.lit(0.0)) - penalty * F.coalesce("w", F.lit(0.0))).alias("g"))


def step(grad: DataFrame, rate: float) -> DataFrame:
    """w + rate * gradient. An empty gradient leaves every weight."""
    return grad.select("idx", (F.col("w") + rate * F.col("g")).alias("w"))
