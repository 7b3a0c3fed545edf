"""Losses and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rookery.functions.scalars import win_probability


def mse(d: DataFrame, whole: bool = False) -> DataFrame:
    """n, sum and mean of (y - y_hat)^2; zeros on empty input. whole: errors are whole numbers, and so is their sum, without rounding."""
    e = (F.col("y") - F.col("y_hat")) * (F.col("y") - F.col("y_hat"))
    total = F.sum(e.cast("decimal(28,0)")).cast("decimal(38,0)") if whole else F.sum(e)
    return d.agg(F.count("*").alias("n"), F.coalesce(total, F.lit(0)).alias("sse"), F.coalesce(F.avg(e), F.lit(0.0)).alias("mse"))


def entropy(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return -a * F.log(b + eps) - (1 - a) * F.log(1 - b + eps)


def cross_entropy(d: DataFrame, mix: float) -> DataFrame:
    """Mean cross-entropies of the mixed target, of result and of label, and the entropies of each."""
    p, q = F.expr(win_probability("y")), F.expr(win_probability("y_hat"))
    t = (F.col("result") + 1) / 2
    m = (1 - mix) * t + mix * p
    terms = {"loss": entropy(m, q), "loss_result": entropy(t, q), "loss_label": entropy(p, q), "h_label": entropy(p, p), "h_result": entropy(t, t), "h_mixed": entropy(m, m)}
    return d.agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(k) for k, v in terms.items()])


def feature_scale(d: DataFrame, n_features: int) -> DataFrame:
    """idx and ceil(max(1, max |value|)) of every feature, seen or not."""
    seen = d.filter(F.col("idx").between(0, n_features - 1)).groupBy("idx").agg(F.max(F.abs("value")).alias("top"))
    every = d.sparkSession.range(n_features).select(F.col("id").alias("idx"))
    return every.join(seen, "idx", "left").select("idx", F.ceil(F.greatest(F.lit(1.0), F.coalesce("top", F.lit(0.0)))).cast("double").alias("scale"))


def feature_range(d: DataFrame, rows: DataFrame) -> DataFrame:
    """idx, least and greatest |value|; zeros that aren't stored count."""
    total = rows.agg(F.count("*")).scalar()
    seen = d.groupBy("idx").agg(F.min(F.abs("value")).alias("low"), F.max(F.abs("value")).alias("high"), F.count("*").alias("n"))
    return seen.select("idx", F.when(F.col("n") < total, 0.0).otherwise(F.col("low").cast("double")).alias("low"), F.col("high").cast("double").alias("high"))


def width(v: Column) -> Column:
    """How a stored value's width is called: a fraction, or an integer of one, two or four bytes."""
    return F.when(v != F.floor(v), "fraction").when(F.abs(v) <= 127, "int8").when(F.abs(v) <= 32767, "int16").otherwise("int32")


def value_widths(d: DataFrame) -> DataFrame:
    """How many stored values there are of each width."""
    return d.groupBy(width(F.col("value")).alias("width")).agg(F.count("*").alias("n"))


WIDTHS = ("fraction", "int8", "int16", "int32")


def observed(vectors: DataFrame, kept: Column) -> tuple[DataFrame, Observation]:
    """Rows (row_ord, vals) that are kept, and what is counted while they pass: seen, kept, last (greatest row_ord of all) and the stored values of each width."""
    seen = Observation()
    count = lambda w: F.sum(F.when(kept, F.size(F.filter("vals", lambda x: width(x) == w)))).alias(w)
    d = vectors.observe(seen, F.count("*").alias("seen"), F.count_if(kept).alias("kept"), F.max("row_ord").alias("last"), *[count(w) for w in WIDTHS])
    return d.filter(kept), seen
