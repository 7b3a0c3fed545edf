"""Algebra of sparse vectors (structs of indices and vals) and dense ones (arrays), row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(indices: Column, vals: Column) -> Column:
    return F.struct(indices.alias("indices"), vals.alias("vals"))


def _pairs(v: Column) -> Column:
    return F.zip_with(v["indices"], v["vals"], lambda i, x: F.struct(i.alias("i"), x.alias("x")))


def dot(v: Column, w: Column) -> Column:
    """Sparse by dense: the sum of vals * w[index]; indices beyond w count as nothing."""
    return F.aggregate(_pairs(v), F.lit(0.0), lambda a, p: a + p["x"] * F.coalesce(F.get(w, p["i"]), F.lit(0.0)))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _dense(v: Column, dim: Column, pick) -> Column:
    """An array of dim numbers: pick of the values of each index in their order, 0 where there are none.

    Entries are sorted by index once; each run of equal ones becomes the zeros since the run before and one number, so the
    work is that of the entries and places together. Indices outside the array are left out.
    """
    pairs = F.zip_with(v["indices"], v["vals"], lambda i, x: F.struct(i.cast("int").alias("i"), x.cast("double").alias("x")))
    placed = F.transform(F.filter(pairs, lambda p: (p["i"] >= 0) & (p["i"] < dim)), lambda p, k: F.struct(p["i"].alias("i"), k.alias("k"), p["x"].alias("x")))

    def filled(e: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(e)), lambda k: (k == 0) | (k == F.size(e)) | (F.get(e, k)["i"] != F.get(e, k - 1)["i"]))
        return _let(starts, lambda s: F.concat(F.flatten(F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda at, n: run(e, s, at, n))), F.array_repeat(F.lit(0.0), dim - 1 - F.get(e, F.size(e) - 1)["i"])))

    def run(e: Column, s: Column, at: Column, n: Column) -> Column:
        gap = F.get(e, at)["i"] - F.coalesce(F.get(e, at - 1)["i"], F.lit(-1)) - 1
        return F.concat(F.array_repeat(F.lit(0.0), gap), F.array(pick(F.transform(F.slice(e, at + 1, F.get(s, n + 1) - at), lambda p: p["x"]))))

    return _let(F.array_sort(placed), lambda e: F.when(F.size(e) == 0, F.array_repeat(F.lit(0.0), dim)).otherwise(filled(e)))


def densify(v: Column, dim: int) -> Column:
    """An array of dim numbers; of an index that repeats, the last value counts."""
    return _dense(v, F.lit(dim), lambda x: F.element_at(x, -1))


def add_sparse(w: Column, v: Column, factor: float = 1.0) -> Column:
    """Dense w + factor * v; values of an index that repeats all count."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    return _let(w, lambda w: F.zip_with(w, _dense(v, F.size(w), total), lambda x, y: x + factor * y))


def add_dense(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def multiply(w: Column, factor: float) -> Column:
    return F.transform(w, lambda x: x * factor)


def divide(w: Column, divisor: float) -> Column:
    return F.transform(w, lambda x: x / divisor)


def total(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
