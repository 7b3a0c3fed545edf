"""Row order, windows, chunks, workers and batches, all from an ordinal that the rows bring along."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modulus of round functions: products of two residues fit in 63 bits.
PRIME = 2**31 - 1
ROUNDS, PASSES = 4, 2


def _keys(seed: int | str, n: int) -> list[int]:
    """n numbers below PRIME that stand for chance."""
    return [1 + int.from_bytes(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest()) % (PRIME - 1) for k in range(n)]


def permutation_steps(x: str, n: str, seed: int, tweak: str = "0", div: str = "DIV") -> list[list[tuple[str, str]]]:
    """Columns to be added one list after the other; the last is _x, the place of ordinal x of n: a bijection of 0 .. n - 1.

    A pass splits the first a * a places (a the root of n, rounded down) into two digits of base a and mixes them in Feistel
    rounds; as a round adds to one digit what depends on the other, any function will do, here a square modulo a prime. The few places beyond a * a stay, so all places
    are turned by half of n between the passes: each then is mixed by one pass at least. That takes the place of walking cycles, which have no
    bound. tweak makes permutations of the same seed differ. All is integer arithmetic that any engine repeats; div is its integer division.
    """
    keys = iter(_keys(seed, 4 * ROUNDS * PASSES))
    root = f"CAST(floor(sqrt(CAST({n} AS DOUBLE))) AS BIGINT)"
    steps = [[("_n", f"CAST({n} AS BIGINT)"), ("_a", f"greatest({root} - CASE WHEN {root} * {root} > {n} THEN 1 ELSE 0 END, 1)"), ("_x", f"CAST({x} AS BIGINT)"), ("_w", f"CAST({tweak} AS BIGINT) % {PRIME}")]]
    for k in range(PASSES):
        steps.append([("_l", f"_x {div} _a"), ("_r", "_x % _a")])
        for _ in range(ROUNDS):
            times, plus, turn, last = (next(keys) for _ in range(4))
            steps.append([("_t", f"(_r % {PRIME} * {times} + _w * {turn} % {PRIME} + {plus}) % {PRIME}")])
            steps.append([("_l", "_r"), ("_r", f"(_l + (_t * _t % {PRIME} * {last} + {plus}) % {PRIME}) % _a")])
        mixed = "CASE WHEN _x < _a * _a THEN _l * _a + _r ELSE _x END"
        steps.append([("_x", mixed if k == PASSES - 1 else f"({mixed} + _n {div} 2) % _n")])
    return steps


def place_sql(source: str, x: str, n: str, seed: int, tweak: str = "0", div: str = "//") -> str:
    """A SELECT of source's columns and place, for engines whose integer division is div."""
    held: list[str] = []
    for step in permutation_steps(x, n, seed, tweak, div):
        new = [c for c, _ in step]
        again = [c for c in new if c in held]
        star = f"* EXCLUDE ({', '.join(again)})" if again else "*"
        source = f"(SELECT {star}, {', '.join(f'{e} AS {c}' for c, e in step)} FROM {source})"
        held += [c for c in new if c not in held]
    return f"(SELECT * EXCLUDE ({', '.join(held)}), _x AS place FROM {source})"


def with_place(d: DataFrame, x: str, n: str, seed: int, tweak: str = "0") -> DataFrame:
    """d with place, where ordinal x of n goes: no sort and no shuffle. Columns _n, _a, _x, _w, _l, _r and _t are taken up."""
    keep = d.columns
    for step in permutation_steps(x, n, seed, tweak):
        d = d.withColumns({c: F.expr(e) for c, e in step})
    return d.select(*keep, F.col("_x").alias("place"))


def places(n: int, seed: int) -> np.ndarray:
    """The same for all ordinals below n, for tables of a row a chunk."""
    keys, a = iter(_keys(seed, 4 * ROUNDS * PASSES)), max(1, int(np.sqrt(n)) - (int(np.sqrt(n)) ** 2 > n))
    x = np.arange(n, dtype=np.int64)
    for k in range(PASSES):
        left, right = x // a, x % a
        for _ in range(ROUNDS):
            times, plus, _, last = (next(keys) for _ in range(4))
            t = (right % PRIME * times + plus) % PRIME
            left, right = right, (left + (t * t % PRIME * last + plus) % PRIME) % a
        x = np.where(x < a * a, left * a + right, x)
        if k < PASSES - 1:
            x = (x + n // 2) % n
    return x


def epoch_seed(seed: int, epoch: int) -> int:
    """A seed for each epoch."""
    return _keys(f"{seed}/{epoch}", 1)[0]


def ordinals(d: DataFrame) -> int:
    """One more than the greatest row_ord."""
    return (d.agg(F.max("row_ord")).first()[0] or 0) + 1


def shuffle_rows(d: DataFrame, seed: int, total: int | None = None) -> DataFrame:
    """All rows in a new order, each once, with their place. total: one more than the greatest row_ord, else it is looked up.

    Places are spread evenly, so equal ranges of them are the partitions: no sample is taken, and each partition is sorted by itself.
    """
    total = ordinals(d) if total is None else total
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = with_place(d, "row_ord", str(total), seed)
    return d.repartitionById(parts, F.expr(f"CAST(place * {parts} DIV {total} AS INT)")).sortWithinPartitions("place")


def shuffle_within_windows(d: DataFrame, size: int, seed: int, total: int | None = None) -> DataFrame:
    """A permutation of its own inside each run of size ordinals, the last run shorter; place is the new position. No sort and no shuffle."""
    total = ordinals(d) if total is None else total
    d = d.withColumn("win", F.expr(f"row_ord DIV {size}"))
    d = with_place(d, f"row_ord % {size}", f"least({size}, {total} - win * {size})", seed, "win")
    return d.withColumn("place", F.col("win") * size + F.col("place"))


def chunks(d: DataFrame, size: int) -> DataFrame:
    """chunk_id counts input rows before any filter."""
    return d.withColumn("chunk_id", F.expr(f"row_ord DIV {size}"))


def chunk_name(base: str) -> Column:
    """The file name of a chunk: the base without its extension, and the number."""
    return F.concat(F.regexp_replace(F.lit(base), r"\.[^.]*$", ""), F.lit("-"), F.col("chunk_id").cast("string"), F.lit(".bin"))


def chunk_manifest(d: DataFrame, size: int, base: str, kept: Column | None = None) -> DataFrame:
    """chunk_id, file name, rows seen and kept, first and last ordinal. Rows of one chunk are summed before any shuffle."""
    kept = F.lit(True) if kept is None else kept
    g = chunks(d, size).groupBy("chunk_id").agg(F.count("*").alias("n_rows"), F.count_if(kept).alias("n_kept"), F.min("row_ord").alias("first_ord"), F.max("row_ord").alias("last_ord"))
    return g.withColumn("name", chunk_name(base))


def deal_chunks(ids: DataFrame, epoch: int, seed: int, workers: int, total: int | None = None) -> DataFrame:
    """chunk_id, its place in the epoch's order of chunks 0 .. total - 1 and its worker, dealt round robin. No sort and no shuffle; chunks
    that aren't there leave their places empty."""
    total = (ids.agg(F.max("chunk_id")).first()[0] or 0) + 1 if total is None else total
    d = with_place(ids.select("chunk_id"), "chunk_id", str(total), epoch_seed(seed, epoch))
    return d.withColumn("worker", F.col("place") % workers)


def by_worker(d: DataFrame, workers: int) -> DataFrame:
    """d (worker) with the rows of worker k in partition k, one task a worker, whatever hashes would do."""
    return d.repartitionById(workers, F.col("worker").cast("int"))


def mini_batches(d: DataFrame, size: int, workers: int) -> DataFrame:
    """batch_id of size rows each, the last one short, and the worker: shares of size / workers, one row at least, the rest to the last."""
    return d.withColumns({"batch_id": F.expr(f"row_ord DIV {size}"), "worker": F.expr(f"least(row_ord % {size} DIV {max(1, size // workers)}, {workers - 1})").cast("long")})
