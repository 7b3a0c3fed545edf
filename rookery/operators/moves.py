"""Best moves: decoding, classes, quiet rows and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions import board as B

#: prom of a decoded move: 0 pawn marks en passant, 1..4 the promotion, 5 castling, 6 none.
EN_PASSANT, CASTLING, NONE = 0, 5, 6


def decode_moves(d: DataFrame, move: str = "move") -> DataFrame:
    """d with frm, dst and prom from 16 bits: target, origin (by rank), promotion, flag."""
    turned = lambda s: f"CAST((({s}) & 7) * 8 + (({s}) >> 3) AS INT)"
    flag = f"(({move} >> 14) & 3)"
    return d.selectExpr("*", f"{turned(f'({move} >> 6) & 63')} AS frm", f"{turned(f'{move} & 63')} AS dst", f"CAST(CASE {flag} WHEN 1 THEN (({move} >> 12) & 3) + 1 WHEN 2 THEN {EN_PASSANT} WHEN 3 THEN {CASTLING} ELSE {NONE} END AS INT) AS prom")


def classify_moves(d: DataFrame, pieces: DataFrame) -> DataFrame:
    """decode_moves() with moved and captured piece and the classes of the move.

    Both lookups share the pieces' partitioning by pos_id: the squares of a position are one row.
    """
    squares = pieces.groupBy("pos_id").agg(F.map_from_entries(F.collect_list(F.struct("sq", "pc"))).alias("at"))
    m = d.join(squares, "pos_id", "left").selectExpr("*", "at[frm] AS moved", f"CASE WHEN prom = {CASTLING} THEN NULL WHEN prom = {EN_PASSANT} THEN 0 ELSE at[dst] END AS captured").drop("at")
    m = m.selectExpr("*", "captured IS NOT NULL AS is_capture", "prom BETWEEN 1 AND 4 AS is_promotion", "prom BETWEEN 1 AND 3 AS is_underpromotion", f"prom = {CASTLING} AS is_castling", f"prom = {EN_PASSANT} AS is_en_passant")
    return m.selectExpr("*", "is_capture OR is_promotion AS is_tactical", "coalesce(moved = 0, false) OR is_capture AS is_conversion")


def move_text(d: DataFrame) -> DataFrame:
    """d (with frm, dst, prom) and text: origin, target and promotion letter; castling names where the king goes."""
    name = lambda s: f"concat(substring('abcdefgh', shiftright({s}, 3) + 1, 1), CAST(({s} & 7) + 1 AS STRING))"
    king_to = "CASE WHEN shiftright(dst, 3) > shiftright(frm, 3) THEN 48 + (dst & 7) ELSE 16 + (dst & 7) END"
    return d.withColumn("landing", F.expr(f"CASE WHEN prom = {CASTLING} THEN {king_to} ELSE dst END")).selectExpr("*", f"concat({name('frm')}, {name('landing')}, CASE WHEN prom BETWEEN 1 AND 4 THEN substring('nbrq', prom, 1) ELSE '' END) AS text").drop("landing")


def in_check(side_rows: DataFrame) -> DataFrame:
    """pos_id and whether the side to move is in check."""
    return side_rows.filter("side = turn").select("pos_id", F.expr(B.has("x_hit_all", "king")).alias("in_check"))


def quiet(classified: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows whose best move is neither capture nor promotion and whose side to move is not in check."""
    return classified.filter("NOT is_tactical").join(checks.filter("in_check"), "pos_id", "left_anti")
