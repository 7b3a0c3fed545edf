"""Static and endgame-scaled scores of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions import board as B
from rookery.functions.scalars import clamp_score
from rookery.operators import features
from rookery.operators.linear import small


#: Features that scores read, and how many bits each flag of an ending takes in one number.
_READ = (*features.FAMILIES, *features.EXTRAS)
_BITS = {"force": 8, "pawns": 4, "minors": 1, "two_knights": 1, "lone_king": 1, "rook_a": 1, "rook_h": 1, "blocked": 1, "one_bishop": 2}


def scores(side_rows: DataFrame, weights: DataFrame) -> DataFrame:
    """pos_id, turn, score in centipawns for the side to move, the same score where every
    side's feature value is rounded to a whole number first (rounded), in_check of the side to move, and endgame_flags() of both sides (w, b).

    weights: idx, mg and eg in hundredths, one row for each of the N_FEATURES features and so broadcast. The weighted sum is
    rounded to 4 digits, so that the order of summing decides nothing, then to the nearest integer. One pass over the rows of
    sides(), in its partitioning.
    """
    at, packed = 0, []
    for name, bits in _BITS.items():
        value = "coalesce(flags.one_bishop, -1) + 1" if name == "one_bishop" else f"CAST(flags.{name} AS INT)"
        packed.append(f"shiftleft(CAST({value} AS BIGINT), {at})")
        at += bits
    d = side_rows.withColumn("flags", F.expr(f"struct({', '.join(_FLAGS)})")).withColumns({"packed": F.expr(" | ".join(packed)), "checked": F.expr(B.has("x_hit_all", "king"))}).drop("flags")
    v = features.values(d, _READ, ("packed", "checked")).join(small(weights), "idx", "left")
    sign = "CASE WHEN side = turn THEN 1 ELSE -1 END"
    whole = "CAST(floor(round(value, 4) + 0.5) AS DOUBLE)"
    total = lambda e, alias: F.expr(f"sum({e})").alias(alias)
    s = v.groupBy("pos_id", "turn").agg(
        *[total(f"CASE WHEN idx < {features.N_FEATURES} THEN {sign} * {x} * {w} ELSE 0 END", f"{w}_{name}") for name, x in (("score", "value"), ("rounded", whole)) for w in ("mg", "eg")],
        total(f"CASE WHEN idx = {features.GAIN} THEN {sign} * value ELSE 0 END", "gain"), F.expr(f"greatest(24 - sum(CASE WHEN idx = {features.FORCE} THEN value ELSE 0 END), 0)").alias("stage"),
        F.expr("bool_or(side = turn AND checked)").alias("in_check"), *[F.expr(f"max(CASE WHEN side = {n} THEN packed END)").alias(x) for n, x in enumerate("wb")],
    )
    score = lambda x: f"CAST(floor((round(coalesce(mg_{x}, 0) * (24 - stage) + coalesce(eg_{x}, 0) * stage + 24 * gain, 4) + 1200) / 2400) AS BIGINT) AS {x}"

    def unpacked(x: str) -> str:
        at, parts = 0, []
        for name, bits in _BITS.items():
            value = f"CAST(shiftright({x}, {at}) & {(1 << bits) - 1} AS INT)"
            parts.append(f"nullif({value} - 1, -1) AS {name}" if name == "one_bishop" else f"{value} AS {name}" if name in ("force", "pawns") else f"{value} = 1 AS {name}")
            at += bits
        return f"struct({', '.join(parts)}) AS {x}"

    return s.selectExpr("pos_id", "turn", score("score"), score("rounded"), "in_check", unpacked("w"), unpacked("b"))


def _flag_terms() -> list[str]:
    officers = "(own_all & ~(own[0] | own[5]))"
    corner = lambda f: f"({8 * f} + 7 * (1 - side))"
    colour = lambda sq: f"CASE WHEN ((shiftright({sq}, 3) + {sq}) & 1) = 0 THEN {B.COLOURS[0]}L ELSE {B.COLOURS[1]}L END"
    rook = lambda f: f"op <> 0 AND (op & ~{B.FILES[f]}L) = 0 AND {officers} = own[2] AND {B.distance('xking', corner(f))} <= 1 AND (own[2] & {colour(corner(f))}) = 0"
    first = "CAST(bit_count((op & -op) - 1) AS INT)"
    return [
        f"CAST({features.OFFICER_FORCE} AS INT) AS force",
        "CAST(bit_count(op) AS INT) AS pawns", "(own[1] | own[2]) <> 0 AS minors", f"{officers} = own[1] AND bit_count(own[1]) = 2 AS two_knights", f"{officers} = 0 AS lone_king",
        f"{rook(0)} AS rook_a", f"{rook(7)} AS rook_h",
        f"bit_count(op) = 1 AND (opp[5] & {B.file_set(first)} & {B.ahead(first)}) <> 0 AS blocked",
        f"CASE WHEN {officers} = own[2] AND bit_count(own[2]) = 1 THEN CASE WHEN (own[2] & {B.COLOURS[0]}L) <> 0 THEN 0 ELSE 1 END END AS one_bishop",
    ]


_FLAGS = _flag_terms()


def endgame_flags(side_rows: DataFrame) -> DataFrame:
    """pos_id, side with force, pawns, and the endings that draw: all bishops wrong for a rook pawn on file A or H
    (rook_a, rook_h), two knights alone, lone king, a blocked single pawn, single opposite bishops."""
    return side_rows.selectExpr("pos_id", "side", "turn", *_FLAGS)


def scaled_scores(d: DataFrame) -> DataFrame:
    """scores() with score for the side to move, divided or zero in endings that the leading side can't win."""
    d = d.withColumn("v", F.expr("CASE WHEN turn = 0 THEN score ELSE -score END"))
    d = d.withColumns({"x": F.expr("CASE WHEN v >= 0 THEN w ELSE b END"), "y": F.expr("CASE WHEN v >= 0 THEN b ELSE w END")})
    by = """CASE WHEN x.force >= 6 THEN 1
      WHEN x.force = 0 AND x.pawns = 0 THEN 0 WHEN x.rook_a OR x.rook_h THEN 64
      WHEN x.pawns = 0 THEN CASE WHEN x.force <= 1 THEN 16 WHEN x.force = 2 AND x.two_knights AND y.pawns = 0 THEN 16 WHEN x.force - y.force <= 1 THEN 4 ELSE 1 END
      WHEN x.pawns = 1 THEN CASE WHEN x.force <= 1 AND y.minors THEN 8 WHEN x.force = 2 AND x.two_knights AND y.pawns = 0 AND y.minors THEN 8
        WHEN x.force = y.force AND x.blocked THEN 4 WHEN x.force = y.force AND y.minors THEN 2 ELSE 1 END
      WHEN w.one_bishop <> b.one_bishop AND abs(w.pawns - b.pawns) <= 2 THEN 2 ELSE 1 END"""
    d = d.withColumn("k", F.expr(by)).withColumn("u", F.expr("CASE WHEN k = 0 THEN 0 WHEN v < 0 THEN -(-v DIV k) ELSE v DIV k END"))
    return d.select("pos_id", F.expr(f"CAST({clamp_score('CASE WHEN turn = 0 THEN u ELSE -u END')} AS BIGINT)").alias("score"))
