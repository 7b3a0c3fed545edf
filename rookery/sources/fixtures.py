"""Positions, pieces, rows and sparse values derived from the order tables: the same SQL in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions import board as B
from rookery.sources import shared

#: A position is made from all orders of five keys.
POSITIONS = """SELECT pos_id, (k*17+c)%64 AS wk, ((k*17+c)%64 + 1 + (c*13+k)%63)%64 AS bk, c%2 AS turn, p%4001-2000 AS score,
  CASE s WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS game_result, (k*2654435 + c*97) % 65536 AS move,
  (k+c)%16 AS rights, CASE WHEN c%3=0 THEN k%8*8 + CASE WHEN c%2=0 THEN 5 ELSE 2 END ELSE -1 END AS ep
FROM (SELECT CAST(FLOOR(o_orderkey/5) AS BIGINT) AS pos_id, CAST(SUM(o_orderkey) AS BIGINT) AS k, CAST(SUM(o_custkey) AS BIGINT) AS c,
  CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS BIGINT) AS p, MAX(o_orderstatus) AS s FROM orders GROUP BY 1)"""

PIECES = f"""WITH k AS ({POSITIONS}), r AS (
  SELECT CAST(FLOOR(l_orderkey/5) AS BIGINT) AS pos_id, (l_partkey*31+l_suppkey*7+l_linenumber)%64 AS sq,
    MIN((l_partkey%8)*2 + l_suppkey%2) AS code FROM lineitem GROUP BY 1,2)
SELECT r.pos_id, CAST(r.sq AS INT) AS sq, CAST(code%2 AS INT) AS side,
  CAST(CASE WHEN code<8 AND r.sq%8 BETWEEN 1 AND 6 THEN 0 WHEN code<8 THEN 1 ELSE CAST(FLOOR(code/2) AS BIGINT)-3 END AS INT) AS pc
FROM r JOIN k ON r.pos_id=k.pos_id WHERE r.sq<>k.wk AND r.sq<>k.bk
UNION ALL SELECT pos_id, CAST(wk AS INT), 0, 5 FROM k
UNION ALL SELECT pos_id, CAST(bk AS INT), 1, 5 FROM k"""

ROWS = """SELECT o_orderkey AS row_ord, CAST(FLOOR(o_totalprice) AS BIGINT)%4001-2000 AS y,
  24 - o_custkey%25 AS mg, o_custkey%25 AS eg,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS result FROM orders"""

SPARSE = """SELECT l_orderkey AS row_id, l_partkey%40 AS idx,
  SUM(CASE WHEN l_suppkey%2=0 THEN l_quantity ELSE -l_quantity END) AS value FROM lineitem GROUP BY 1,2
HAVING SUM(CASE WHEN l_suppkey%2=0 THEN l_quantity ELSE -l_quantity END)<>0"""


def _run(spark: SparkSession, sf_dir: str, sql: str, *tables: str, parts: int | None = None) -> DataFrame:
    """sql over tables; with parts, these are first dealt by their rows' pos_id, and all groupings and joins by it stay in those parts."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if parts:
        read = {t: d.repartition(parts, F.expr(f"CAST(FLOOR({t[0]}_orderkey/5) AS BIGINT)")) for t, d in read.items()}
    return spark.sql(sql.replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}"), **read)


#: Rows of orders and lineitem, about 25 a position, whose positions and pieces one task takes.
ROWS_PER_TASK = 100_000
#: As many times the rows are grouped into positions and pieces by one task: far fewer values than attacks and features.
GROUPED = 4


def by_position(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """sql's rows partitioned by pos_id into as many parts as the tables have rows for, so that a task's memory doesn't grow with them.

    The files' footers have the counts. Groupings of the tables have larger parts, by these counts too. All that meets by pos_id has this
    one partitioning, also what a union made.
    """
    rows = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("orders", "lineitem"))
    d = _run(spark, sf_dir, sql, *tables, parts=max(1, -(-rows // (GROUPED * ROWS_PER_TASK))))
    return shared.dealt(d, "pos_id", rows, ROWS_PER_TASK)


#: Squares of the rooks with the four bits of rights.
RIGHTS = (56, 0, 63, 7)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos_id, king squares, turn, score, game_result, best move, castling (squares of rooks with rights) and ep (-1 or a square)."""
    castling = " + ".join(f"CASE WHEN (rights & {1 << n}) <> 0 THEN {B.bit(str(sq))} ELSE 0L END" for n, sq in enumerate(RIGHTS))
    d = by_position(spark, sf_dir, POSITIONS, "orders")
    return d.selectExpr("pos_id", "CAST(wk AS INT) wk", "CAST(bk AS INT) bk", "CAST(turn AS INT) turn", "score", "game_result", "CAST(move AS INT) move", f"{castling} AS castling", "CAST(ep AS INT) AS ep")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_position(spark, sf_dir, PIECES, "orders", "lineitem")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ROWS, "orders")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, SPARSE, "lineitem")
