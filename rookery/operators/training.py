"""Training and validation on rows of sparse vectors: mini-batches in barrier stages, losses, snapshots, and the Gram forms."""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.functions.scalars import LOGISTIC_SCALE
from rookery.operators import batching
from rookery.sources import shared, weight_text

#: Rows of a vectorized step.
STEP_ROWS = 4096
#: Tasks of a training stage at most: all run at once, and each hears every other's gradient for each batch.
MOST_TASKS = 16


@dataclass(frozen=True)
class Plan:
    """epochs over batches of batch rows each; rate and penalty (of squared weights) of a step.

    mix: None for squared residuals y - y_hat; else the label's part in the logistic residual, the rest is the result's.
    """

    epochs: int
    batch: int
    rate: float
    penalty: float
    mix: float | None = None


def vectors(d: DataFrame, row: str, *labels: str) -> DataFrame:
    """row, labels, indices and vals from (row, labels, idx, value): a shuffle by row, to be stored, not repeated."""
    v = d.groupBy(row, *labels).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("v"))
    return v.select(row, *labels, F.expr("transform(v, x -> CAST(x.idx AS INT))").alias("indices"), F.expr("transform(v, x -> CAST(x.value AS DOUBLE))").alias("vals"))


def expand(v: DataFrame, half: int) -> DataFrame:
    """vals * mg / 24 at indices and vals * eg / 24 at indices + half; no shuffle."""
    part = lambda f: F.transform("vals", lambda x: x * F.col(f) / 24)
    return v.withColumns({"indices": F.concat("indices", F.transform("indices", lambda i: i + half)), "vals": F.concat(part("mg"), part("eg"))})


def scale(v: DataFrame, scales: list[float]) -> DataFrame:
    """vals divided by their features' scales."""
    known = F.array(*[F.lit(float(x)) for x in scales])
    return v.withColumn("vals", F.zip_with("indices", "vals", lambda i, x: x / F.get(known, i)))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index and value of every entry."""
    ix, v = b.column("indices"), b.column("vals")
    return np.repeat(np.arange(b.num_rows), np.diff(np.asarray(ix.offsets))), np.asarray(ix.flatten()), np.asarray(v.flatten(), dtype=float)


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x / LOGISTIC_SCALE / 4 * np.log(10)))


def _residuals(y: np.ndarray, y_hat: np.ndarray, result: np.ndarray | None, mix: float | None) -> np.ndarray:
    """Target less prediction, of labels, or of the chances to win: a step along them goes downhill."""
    return y - y_hat if mix is None else mix * _chance(y) + (1 - mix) * (result + 1) / 2 - _chance(y_hat)


def _partial(b: pa.RecordBatch, w: np.ndarray, mix: float | None) -> np.ndarray:
    """Sum over rows of residual * vector; dot products and sums need no dense rows."""
    row, k, x = _flat(b)
    y_hat = np.bincount(row, x * w[k], minlength=b.num_rows)
    r = _residuals(np.asarray(b.column("y"), dtype=float), y_hat, None if mix is None else np.asarray(b.column("result"), dtype=float), mix)
    return np.bincount(k, x * r[row], minlength=len(w))


def losses(v: DataFrame, w: np.ndarray, quiet: str | None = None) -> dict[str, float]:
    """n, sum and mean of squared errors of rows (indices, vals, y), and the same of the rows where the column quiet holds; zeros of none."""

    def partial(batches):
        for b in batches:
            row, k, x = _flat(b)
            e = (np.asarray(b.column("y"), dtype=float) - np.bincount(row, x * w[k], minlength=b.num_rows)) ** 2
            calm = np.asarray(b.column("quiet").fill_null(False)).astype(bool) if quiet else np.ones(len(e), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array([len(e)]), pa.array([float(e.sum())]), pa.array([int(calm.sum())]), pa.array([float(e[calm].sum())])], ["n", "sse", "n_quiet", "sse_quiet"])

    d = v.select("indices", "vals", "y", *([F.col(quiet).alias("quiet")] if quiet else []))
    out = d.mapInArrow(partial, "n long, sse double, n_quiet long, sse_quiet double").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "sse", "n_quiet", "sse_quiet")]).first().asDict()
    return out | {"mse": out["sse"] / max(out["n"], 1), "mse_quiet": out["sse_quiet"] / max(out["n_quiet"], 1)}


def tasks_at_once(spark: SparkSession) -> int:
    """Tasks of a training stage: as many as run side by side, MOST_TASKS at most."""
    return max(1, min(MOST_TASKS, spark.sparkContext.defaultParallelism))


def spread(v: DataFrame, task: str, tasks: int, order: str) -> DataFrame:
    """v with the rows of each task (a number below tasks) in a partition of their own, in order, kept for all epochs until shared.forget().

    Rows are shuffled once. They lie in the shared folder and are read row by row: executors hold none of them, however many there are, and lose none.
    """
    return shared.kept(v.repartitionById(tasks, F.expr(f"CAST({task} AS INT)")).sortWithinPartitions(order))


def _messages(ctx: BarrierTaskContext, g: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Sums of all tasks' gradients and rows, added in the order of tasks, so that every task has the same bits."""
    at = np.flatnonzero(g).astype(np.int32)
    sent = base64.b64encode(np.int64(n).tobytes() + np.int64(len(at)).tobytes() + at.tobytes() + g[at].tobytes()).decode()
    total, rows = np.zeros_like(g), 0
    for said in ctx.allGather(sent):
        raw = base64.b64decode(said)
        n, size = np.frombuffer(raw, np.int64, 2)
        total[np.frombuffer(raw, np.int32, size, 16)] += np.frombuffer(raw, np.float64, size, 16 + 4 * size)
        rows += int(n)
    return total, rows


def train_epoch(layout: DataFrame, w: np.ndarray, plan: Plan, batches: int) -> np.ndarray:
    """Weights after one epoch over rows (batch_id below batches, indices, vals, y and, with mix, result): one barrier stage, one job.

    Each task reads its rows in order of batch_id and sums their gradient for a batch; tasks then hear each other's and all take the same step:
    w + rate * (gradient - penalty * w). Rows of a batch may lie anywhere; batches without rows change nothing. A lost task starts the epoch
    anew, from the same weights.
    """
    start = w

    def run(arrow):
        ctx, w, now, g, n = BarrierTaskContext.get(), start.copy(), 0, np.zeros_like(start), 0
        for whole in arrow:
            ids = np.asarray(whole.column("batch_id"))
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                while end > at and now < ids[at]:
                    w, now, g, n = _stepped(w, *_messages(ctx, g, n), plan), now + 1, np.zeros_like(w), 0
                for k in range(at, end, STEP_ROWS):
                    b = whole.slice(k, min(STEP_ROWS, end - k))
                    g += _partial(b, w, plan.mix)
                    n += b.num_rows
        while now < batches:
            w, now, g, n = _stepped(w, *_messages(ctx, g, n), plan), now + 1, np.zeros_like(w), 0
        if ctx.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w), dtype=np.int32)), pa.array(w)], ["idx", "w"])

    columns = ["batch_id", "indices", "vals", "y"] + (["result"] if plan.mix is not None else [])
    got = layout.select(*columns).mapInArrow(run, "idx int, w double", barrier=True).toArrow()
    out = np.zeros_like(start)
    out[np.asarray(got.column("idx"))] = np.asarray(got.column("w"))
    return out if got.num_rows else start


def _stepped(w: np.ndarray, g: np.ndarray, n: int, plan: Plan) -> np.ndarray:
    return w + plan.rate * (g / n - plan.penalty * w) if n else w


def fit(epoch_rows: Callable[[int], DataFrame], dim: int, plan: Plan, batches: int, after: Callable[[int, np.ndarray], None] | None = None, start: tuple[int, np.ndarray] | None = None) -> list[np.ndarray]:
    """Weights after each epoch, from zero or from start, the number of the next epoch and its weights.

    epoch_rows gives an epoch's rows as train_epoch() takes them, of a layout that spread() made. after sees each epoch's weights, for losses and snapshots.
    Weights (dim numbers) are the only thing the driver holds.
    """
    first, w = start or (0, np.zeros(dim))
    out = []
    for epoch in range(first, plan.epochs):
        w = train_epoch(epoch_rows(epoch), w, plan, batches)
        out.append(w)
        if after:
            after(epoch, w)
    return out


def weight_table(spark: SparkSession, w: np.ndarray) -> DataFrame:
    """idx, mg and eg from weights of both phases, one after the other."""
    half = len(w) // 2
    return spark.createDataFrame([(i, float(w[i]), float(w[half + i])) for i in range(half)], "idx long, mg double, eg double")


def weight_array(weights: DataFrame, half: int) -> np.ndarray:
    """The other way: weights of both phases in a row from (idx, mg, eg)."""
    w = np.zeros(2 * half)
    for r in weights.filter(F.col("idx") < half).collect():
        w[r["idx"]], w[half + r["idx"]] = r["mg"], r["eg"]
    return w


def unscaled(w: np.ndarray, scales: list[float]) -> np.ndarray:
    """Weights for features that aren't divided by their scales."""
    return w / np.tile(np.asarray(scales, dtype=float), len(w) // len(scales))


def _followed(spark: SparkSession, check: DataFrame, path: str, seen: list, plain: Callable[[np.ndarray], np.ndarray]) -> Callable[[int, np.ndarray], None]:
    """Losses and a snapshot after each epoch, of weights for plain features."""
    def after(epoch: int, w: np.ndarray) -> None:
        seen.append(losses(check, plain(w), "quiet"))
        weight_text.write_snapshot(weight_table(spark, plain(w)), weight_table(spark, w), epoch, f"{path}/weights")

    return after


def _resumed(spark: SparkSession, path: str, half: int, resume: bool) -> tuple[int, np.ndarray] | None:
    """Where a fit goes on: behind the last epoch of an unbroken row of snapshots. Without resume, old snapshots go."""
    if not resume:
        weight_text.drop_snapshots(spark, f"{path}/weights")
        return None
    last = weight_text.last_snapshot(spark, f"{path}/weights")
    return None if last is None else (last[0] + 1, weight_array(last[1], half))


def _fitted(plan: Plan) -> list[str]:
    """What a layout keeps of rows, besides their place: one phase, as expand() doubles them when they are read."""
    return ["mg", "eg", "y", "indices", "vals"] + (["result"] if plan.mix is not None else [])


def fit_records(rows: DataFrame, validation: DataFrame, path: str, half: int, plan: Plan, quiet_only: bool = False, seed: int | None = None, resume: bool = False, tasks: int | None = None) -> tuple[list[np.ndarray], list[dict[str, float]]]:
    """The whole training job on rows (row_ord, mg, eg, y, quiet, indices, vals of one phase): weights and losses of each epoch.

    Batches are cut from all rows, in their order or, with a seed, in an order of its own for each epoch; quiet_only then leaves the other rows out,
    and the gradient divides by the rows that stay. If one batch holds all rows and residuals are plain, the steps come from one pass over the
    rows (fit_gram). path/weights gets a snapshot of each epoch; with resume, a fit that was stopped goes on behind the last one
    and returns the epochs from there. Losses are those of the validation rows, all and quiet. Both tables are stored ones: validation is
    read again after each epoch, as held rows would fill the executors' memory.
    """
    spark, seen = rows.sparkSession, []
    total, tasks = batching.ordinals(rows), tasks or tasks_at_once(spark)
    start = _resumed(spark, path, half, resume)
    v = rows.filter("quiet") if quiet_only else rows
    after, layout = _followed(spark, expand(validation, half), path, seen, lambda w: w), None
    try:
        if plan.batch >= total and plan.mix is None:
            return fit_gram(expand(v, half), 2 * half, plan.epochs, plan.rate, plan.penalty, after, start), seen
        layout = spread(v.select("row_ord", *_fitted(plan)), f"row_ord % {tasks}", tasks, "row_ord")

        def epoch_rows(epoch: int) -> DataFrame:
            if seed is None:
                return expand(layout.withColumn("batch_id", F.expr(f"row_ord DIV {plan.batch}")), half)
            d = batching.with_place(layout, "row_ord", str(total), batching.epoch_seed(seed, epoch))
            return expand(d.withColumn("batch_id", F.expr(f"place DIV {plan.batch}")).sortWithinPartitions("batch_id"), half)

        return fit(epoch_rows, 2 * half, plan, -(-total // plan.batch), after, start), seen
    finally:
        if layout is not None:
            shared.forget(layout)


def chunk_offsets(sizes: np.ndarray, epoch: int, seed: int, workers: int) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk of an epoch, dealt as deal_chunks() does: its worker, and the rows that the worker has read before it."""
    place = batching.places(len(sizes), batching.epoch_seed(seed, epoch))
    worker, before = place % workers, np.zeros(len(sizes), np.int64)
    for k in range(workers):
        mine = np.flatnonzero(worker == k)
        mine = mine[np.argsort(place[mine])]
        before[mine] = np.cumsum(sizes[mine]) - sizes[mine]
    return worker, before


def worker_shares(batch: int, workers: int) -> np.ndarray:
    """Rows that each worker gives to a batch: equal shares of one row at least, the rest from the last."""
    share = max(1, batch // workers)
    return np.array([share] * (workers - 1) + [max(1, batch - (workers - 1) * share)])


def worker_batches(rows: DataFrame, sizes: np.ndarray, batch: int, workers: int, epoch: int, seed: int) -> DataFrame:
    """rows (chunk_id, i: the place in the chunk) with the worker and batch_id of an epoch that reads chunks in a new order.

    Chunks are shuffled and dealt to workers round robin. A batch takes its share of rows from each worker, and is smaller once workers run
    dry; every row is in one batch. sizes has the rows of each chunk: one number a chunk, as the driver has for the files of any table.
    """
    share = worker_shares(batch, workers)
    dealt = rows.sparkSession.sparkContext.broadcast(chunk_offsets(sizes, epoch, seed, workers))

    @F.pandas_udf("worker long, batch_id long")
    def deal(chunk: pd.Series, i: pd.Series) -> pd.DataFrame:
        worker, before = (x[chunk.to_numpy()] for x in dealt.value)
        return pd.DataFrame({"worker": worker, "batch_id": (before + i.to_numpy()) // share[worker]})

    return rows.withColumn("_deal", deal("chunk_id", "i")).select(*rows.columns, "_deal.*")


def fit_chunks(rows: DataFrame, validation: DataFrame, path: str, half: int, plan: Plan, chunk: int, workers: int, seed: int, scales: list[float] | None = None, resume: bool = False, tasks: int | None = None) -> tuple[list[np.ndarray], list[dict[str, float]]]:
    """As fit_records(), from feature rows that are read by chunk: each epoch in an order of its own, its batches from all workers.

    Chunks stay where they are for all epochs; a task sorts its rows by the epoch's batches. validation is a stored table, read again after each epoch.
    With scales, features are divided first, and the weights given back, as those that are validated and stored, are for plain features.
    """
    spark, seen, tasks = rows.sparkSession, [], tasks or tasks_at_once(rows.sparkSession)
    v = batching.chunks(rows, chunk).withColumn("i", F.row_number().over(Window.partitionBy("chunk_id").orderBy("row_ord")) - 1)
    v = (scale(v, scales) if scales else v).select("row_ord", "chunk_id", "i", *_fitted(plan))
    layout = spread(v, f"chunk_id % {tasks}", tasks, "row_ord")
    plain = (lambda w: unscaled(w, scales)) if scales else (lambda w: w)
    try:
        found = layout.groupBy("chunk_id").agg(F.count("*").alias("n")).toArrow()
        sizes = np.zeros(max(np.asarray(found.column("chunk_id")), default=-1) + 1, np.int64)
        sizes[np.asarray(found.column("chunk_id"), dtype=np.int64)] = np.asarray(found.column("n"))

        def batches(epoch: int) -> int:
            worker, _ = chunk_offsets(sizes, epoch, seed, workers)
            return int(max(-(-np.bincount(worker, sizes, workers).astype(np.int64) // worker_shares(plan.batch, workers))))

        w, first, out = np.zeros(2 * half), 0, []
        if start := _resumed(spark, path, half, resume):
            first, w = start
        after = _followed(spark, expand(validation, half), path, seen, plain)
        for epoch in range(first, plan.epochs):
            d = worker_batches(layout, sizes, plan.batch, workers, epoch, seed).sortWithinPartitions("batch_id")
            w = train_epoch(expand(d, half), w, plan, batches(epoch))
            out.append(plain(w))
            after(epoch, w)
        return out, seen
    finally:
        shared.forget(layout)


def gram(v: DataFrame, dim: int, newton: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """sum of phi phi^T, of y phi, of y^2, and the rows, of (indices, vals, y).

    newton, weights and the label's part in the target, sums what a Newton step for chances to win needs (and result): phi phi^T by the slope of the
    chance, residuals for y, and cross-entropies for y^2.

    Each partition makes one partial matrix; its rows are dealt by number and summed as arrays, so the driver gets dim rows of
    dim numbers whatever the input.
    """

    def partial(batches):
        g, c, yy, n = np.zeros((dim, dim)), np.zeros(dim), 0.0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                row, k, value = _flat(b)
                x = np.zeros((b.num_rows, dim))
                np.add.at(x, (row, k), value)
                y = np.asarray(b.column("y"), dtype=float)
                if newton is None:
                    g += x.T @ x
                    c += x.T @ y
                    yy += float(y @ y)
                else:
                    w, mix = newton
                    q = _chance(x @ w)
                    m = mix * _chance(y) + (1 - mix) * (np.asarray(b.column("result"), dtype=float) + 1) / 2
                    g += x.T @ (x * (q * (1 - q))[:, None])
                    c += x.T @ (m - q)
                    yy -= float(m @ np.log(q + 1e-300) + (1 - m) @ np.log(1 - q + 1e-300))
                n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1), pa.int32()), pa.array([*g, c], pa.list_(pa.float64())), pa.array([0.0] * dim + [yy]), pa.array([0] * dim + [n], pa.int64())], ["r", "x", "yy", "n"])

    def summed(batches):
        held: dict[int, list] = {}
        for b in batches:
            for r, x, yy, n in zip(b.column("r").to_pylist(), b.column("x"), b.column("yy").to_pylist(), b.column("n").to_pylist(), strict=True):
                had = held.get(r, (0.0, 0.0, 0))
                held[r] = (had[0] + np.asarray(x.values), had[1] + yy, had[2] + n)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x for x, _, _ in held.values()], pa.list_(pa.float64())), pa.array([y for _, y, _ in held.values()]), pa.array([n for _, _, n in held.values()], pa.int64())], ["r", "x", "yy", "n"])

    kind = "r int, x array<double>, yy double, n long"
    full, yy, rows = np.zeros((dim + 1, dim)), 0.0, 0
    for r in v.select("indices", "vals", "y", *(["result"] if newton else [])).mapInArrow(partial, kind).repartition("r").mapInArrow(summed, kind).collect():
        full[r["r"]] = r["x"]
        yy, rows = yy + r["yy"], rows + r["n"]
    return full[:dim], full[dim], yy, rows


def fit_gram(v: DataFrame, dim: int, epochs: int, rate: float, penalty: float, after: Callable[[int, np.ndarray], None] | None = None, start: tuple[int, np.ndarray] | None = None) -> list[np.ndarray]:
    """Weights after each full-batch epoch: rate * ((c - G w) / n - penalty * w), from one pass over the rows."""
    g, c, _, n = gram(v, dim)
    first, w = start or (0, np.zeros(dim))
    out = []
    for epoch in range(first, epochs):
        if n:
            w = w + rate * ((c - g @ w) / n - penalty * w)
        out.append(w)
        if after:
            after(epoch, w)
    return out


#: Slope of the chance to win at even scores, in the unit of labels.
SLOPE = np.log(10) / 4 / LOGISTIC_SCALE


def fit_newton(v: DataFrame, dim: int, penalty: float, mix: float, passes: int = 12, tolerance: float = 1e-9) -> tuple[np.ndarray, list[float]]:
    """Weights that minimize the mean cross-entropy of chances to win plus SLOPE * penalty * w^2 / 2, and that loss before each pass.

    These are the weights where mean gradient steps with the logistic residual stand still. Each pass sums a weighted Gram matrix of
    rows (indices, vals, y, result) in tasks and takes a Newton step, halved while the loss would grow; it ends when the step is small.
    """
    w, seen, step = np.zeros(dim), [], np.zeros(dim)
    for _ in range(passes):
        g, c, loss, n = gram(v, dim, (w, mix))
        if not n:
            return w, seen
        loss = loss / n + SLOPE * penalty * float(w @ w) / 2
        if seen and not loss <= seen[-1] + 1e-12:
            step = step / 2
            w = w - step
            continue
        seen.append(loss)
        ridge = SLOPE * g / n + penalty * np.eye(dim)
        step = np.linalg.lstsq(ridge, c / n - penalty * w, rcond=None)[0]
        w = w + step
        if np.abs(step).max(initial=0.0) <= tolerance * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w, seen
