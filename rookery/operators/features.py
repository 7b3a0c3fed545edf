"""The 759 features: families of (index, value) on side rows or piece rows, summed by position and side."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions import board as B

N_FEATURES = 759


@dataclass(frozen=True)
class Family:
    """where: a condition on the row; values: (index, value) expressions. Zero values are no features.

    level 'side' reads a row of sides(), 'piece' such a row with one own piece: sq, pc, tos and
    file and rank as f (mirrored) and r (as the side counts).
    """

    name: str
    level: str
    where: str
    values: tuple[tuple[str, str], ...]

    def types(self) -> tuple[int, ...]:
        """Types of pieces that the condition allows, as it names them first: pc = 0, pc IN (1, 5) or pc BETWEEN 1 AND 4."""
        if m := re.match(r"pc = (\d)|pc IN \((\d), (\d)\)|pc BETWEEN (\d) AND (\d)", self.where):
            one, *rest = (int(x) for x in m.groups() if x)
            return tuple(range(one, rest[0] + 1)) if m[4] else (one, *rest)
        return tuple(range(6))


_OFFICER = "pc BETWEEN 1 AND 4"
_IS_PASSED = f"pc = 0 AND (xp & {B.around_files('sq')} & {B.ahead('sq')}) = 0 AND (op & {B.file_set('sq')} & {B.ahead('sq')}) = 0"
_FRONT = f"({B.file_set('sq')} & {B.ahead('sq')})"
_PROM = f"({B.file_of('sq')} * 8 + 7 * (1 - side))"
_STOP = "(sq + 1 - 2 * side)"
_FLOOR_RANK = "greatest(r, 2)"
#: The score of a pawn that nothing can stop; both phases get it.
_GAIN = f"CAST(90000 * ({_FLOOR_RANK} - 1) DIV 6 AS BIGINT)"
OFFICER_FORCE = "bit_count(own[1]) + bit_count(own[2]) + 2 * bit_count(own[3]) + 4 * bit_count(own[4])"
_KING_HITS = "king_tos"
_IS_UNSTOPPABLE = (
    f"passed AND (opp_all & ~(opp[0] | opp[5])) = 0 AND ({_FRONT} & occ) = 0 AND "
    f"(7 - {_FLOOR_RANK} + CASE WHEN turn <> side THEN 1 ELSE 0 END < {B.distance('xking', _PROM)} OR ({_FRONT} & ~{_KING_HITS}) = 0)"
)
#: The nearest piece behind a pawn on its file, and whether it is an opposing rook or queen.
_BEHIND = f"(shiftrightunsigned(occ & {B.file_set('sq')} & {B.ahead('sq', '(1 - side)')}, CAST({B.file_of('sq')} * 8 AS INT)))"
_NEAREST = f"CAST(floor(log2(CASE WHEN side = 0 THEN {_BEHIND} ELSE {_BEHIND} & -{_BEHIND} END)) AS INT)"
_PUSHED = f"({_BEHIND} <> 0 AND ((opp[3] | opp[4]) & shiftleft(1L, {B.file_of('sq')} * 8 + {_NEAREST})) <> 0)"
_IS_FREE = f"(({_FRONT} & (opp_all | ~queen_safe)) = 0 AND NOT {_PUSHED})"
_IS_PINNED_BY = f"get(filter(pins, x -> x.pin = {B.bit('sq')}), 0).pc"
_PROTECTED = B.has("o_hit_pawn", "sq")


#: Beyond the features: what scores need of unstoppable pawns and of the officers on the board.
GAIN, FORCE = N_FEATURES, N_FEATURES + 1


def _sum(*pairs: tuple[str, str]) -> tuple[tuple[str, str], ...]:
    return pairs


FAMILIES = (
    Family("x1_material", "side", "true", tuple((str(p), f"bit_count(own[{p}])") for p in range(5))),
    Family("x2_bishop_pair", "side", "bit_count(own[2]) > 1", _sum(("6", "1"))),
    Family("x3_piece_square", "piece", "true", _sum(("7 + pc * 32 + r * 4 + f", "1"))),
    Family("x4_pawn_mobility", "side", "true", _sum(("199", f"bit_count({B.forward('op', 'side')} & ~occ)"))),
    Family("x5_piece_mobility", "piece", _OFFICER, tuple((f"199 + pc * 12 + {at}", "CAST(CAST(sqrt(bit_count(tos & pawn_safe)) AS FLOAT) AS DOUBLE)") for at in ("f", "4 + r"))),
    Family("x6_pawn_captures", "side", "true", tuple((str(271 + t), f"bit_count(o_hit_pawn & opp[{t}])") for t in range(1, 6))),
    Family("x7_piece_captures", "piece", _OFFICER, tuple((f"271 + pc * 6 + {t}", f"bit_count(tos & opp[{t}]{' & ~x_hit_pawn' if t == 0 else ''})") for t in range(6))),
    Family("x8_king_captures", "piece", "pc = 5", tuple((str(301 + t), f"bit_count(tos & opp[{t}] & ~x_hit_pawn)") for t in range(6))),
    Family("x9_safe_checks", "piece", f"{_OFFICER} AND NOT {B.has('tos', 'xking')}", _sum(("307 + pc", "bit_count(tos & ~own_all & queen_safe & CASE pc WHEN 4 THEN probe[1] | probe[2] ELSE probe[pc - 1] END)"))),
    Family("x10_pinned", "piece", f"{_OFFICER} AND pinner IS NOT NULL AND (pinner <= pc OR (tos & {B.ray('king', 'sq')}) = 0)", _sum(("313 + pc * 6 + pinner", "1"))),
    Family("x11_king_attack", "piece", f"{_OFFICER} AND attackers > 0", _sum(
        ("349 + ((attackers - 1) * 6 + pc) * 2", "bit_count(tos & xzone & pawn_safe & ~x_hit_queen)"), ("350 + ((attackers - 1) * 6 + pc) * 2", "bit_count(tos & xzone & pawn_safe & x_hit_queen)"))),
    Family("x12_pawn_shield", "piece", f"pc = 0 AND {B.has('zone', 'sq')} AND r >= {B.side_rank('king')}", _sum(("397 + f", "1"), ("401 + r", "1"))),
    Family("x13_defended_piece", "piece", f"pc BETWEEN 1 AND 3 AND {B.has('o_hit_all', 'sq')}", _sum((f"CASE WHEN {_PROTECTED} THEN 409 ELSE 421 END + f", "1"), (f"CASE WHEN {_PROTECTED} THEN 413 ELSE 425 END + r", "1"))),
    Family("x14_minor_outpost", "piece", f"pc IN (1, 2) AND {_PROTECTED} AND {B.has('strong', 'sq')} AND f >= 2 AND r BETWEEN 3 AND 5", _sum(("433 + pc * 8 + r", "1"))),
    Family("x15_bad_bishop", "piece", "pc = 2", tuple((str(481 + k), f"bit_count(op & (CASE WHEN (({B.file_of('sq')} + sq) & 1) = 0 THEN {B.COLOURS[0]}L ELSE {B.COLOURS[1]}L END) & {'~' * k}blocked)") for k in (0, 1))),
    Family("x16_rook_files", "piece", f"pc = 3 AND (op & {B.file_set('sq')}) = 0", _sum((f"CASE WHEN (xp & {B.file_set('sq')}) = 0 THEN 483 ELSE 484 END", "1"))),
    Family("x17_trapped_rook", "piece", f"pc = 3 AND bit_count(tos & pawn_safe & ~own[5]) < 3 AND r < 2 AND {B.side_rank('king')} = 0 AND NOT {B.has('castling', 'sq')} AND CASE WHEN {B.file_of('king')} < 4 THEN {B.file_of('sq')} <= {B.file_of('king')} ELSE {B.file_of('sq')} >= {B.file_of('king')} END", _sum(("485", "1"))),
    Family("x18_passed_pawn", "piece", "pc = 0 AND passed AND NOT unstoppable", tuple((f"486 + {_FLOOR_RANK} * 20 + {at}", v) for at, v in (
        ("0", "1"), ("1", f"CASE WHEN {B.has('opp_all', _STOP)} THEN 0 ELSE 1 END"), ("2", "CASE WHEN free THEN 1 ELSE 0 END"), (f"4 + {B.distance('king', _STOP)}", "1"), (f"12 + {B.distance('xking', _STOP)}", "1")))),
    Family("x20_pawn_structure", "piece", "pc = 0", _sum(("646 + r * 4 + f", f"CASE WHEN {B.has(B.beside('op'), 'sq')} THEN 1 ELSE 0 END"), ("678 + r * 4 + f", f"CASE WHEN {_PROTECTED} THEN 1 ELSE 0 END"), ("710 + r * 4 + f", f"CASE WHEN {B.has('xp', _STOP)} THEN 1 ELSE 0 END"))),
    Family("x21_weak_pawn", "piece", f"pc = 0 AND {B.has('weak', 'sq')}", _sum(("742 + f", "1"), ("746 + r", "1"))),
    Family("x22_pawn_centre", "piece", "pc IN (1, 5)", _sum((f"CASE pc WHEN 5 THEN 754 ELSE 756 END", f"abs({B.file_of('sq')} + 0.5D - mid_file)"), ("CASE pc WHEN 5 THEN 755 ELSE 757 END", f"abs({B.rank_of('sq')} + 0.5D - mid_rank)"))),
    Family("x23_side_to_move", "side", f"side = turn AND NOT {B.has('x_hit_all', 'king')}", _sum(("758", "1"))),
)

EXTRAS = (Family("gain", "piece", "pc = 0 AND unstoppable", ((str(GAIN), _GAIN),)), Family("force", "side", "true", ((str(FORCE), OFFICER_FORCE),)))


#: What stands for a side in its list of pieces.
_SIDE = -1


def piece_rows(side_rows: DataFrame, with_side: bool = False) -> DataFrame:
    """A row for each own piece; with_side: and one, of pc -1, for the side itself."""
    d = side_rows.withColumns({
        "attackers": F.expr("least(size(filter(men, x -> x.pc BETWEEN 1 AND 4 AND (x.tos & xzone & pawn_safe) <> 0)), 4)"),
        "king_tos": F.expr("filter(men, x -> x.pc = 5)[0].tos"),
    })
    men = F.expr(f"concat(men, array(struct(0 AS sq, {_SIDE} AS pc, 0L AS tos)))") if with_side else F.col("men")
    d = d.withColumn("m", F.explode(men)).drop("men").selectExpr("*", "m.sq AS sq", "m.pc AS pc", "m.tos AS tos").drop("m")
    d = d.withColumns({"f": F.expr(B.mirror_file("sq")), "r": F.expr(B.side_rank("sq")), "passed": F.expr(_IS_PASSED), "pinner": F.expr(_IS_PINNED_BY)})
    return d.withColumns({"unstoppable": F.expr(_IS_UNSTOPPABLE), "free": F.expr(f"passed AND {_IS_FREE}")})


def entries(side_rows: DataFrame, families: tuple[Family, ...] = FAMILIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """pos_id, side, turn, further columns of side_rows, idx and value: each piece's and side's share in the families, zeros left out.

    A row is sent to the entries of its piece's type at once, where the type is a constant; others are never evaluated. One
    projection, no shuffle.
    """
    with_side = any(f.level == "side" for f in families)
    known = lambda text, pc: re.sub(r"(?<![.\w])pc\b", str(pc), text)
    entry = lambda f, i, v, pc: known(f"CASE WHEN {f.where} THEN struct(CAST({i} AS INT) AS idx, CAST({v} AS DOUBLE) AS value) END", pc)
    cases = []
    for pc in (*range(6), _SIDE):
        own = [entry(f, i, v, pc) for f in families if (f.level == "side") == (pc == _SIDE) and (pc == _SIDE or pc in f.types()) for i, v in f.values]
        if own:
            cases.append(f"WHEN {pc} THEN array({', '.join(own)})")
    # A column first: a generator would evaluate its argument without generated code. Outer, else the
    # optimizer would test the size of the array before, and so build it twice.
    own = ["pos_id", "side", "turn", *keep]
    d = piece_rows(side_rows, with_side).select(*own, F.expr(f"CASE pc {' '.join(cases)} END").alias("all"))
    return d.select(*own, F.explode_outer("all").alias("e")).filter("e.value <> 0").select(*own, "e.*")


def values(side_rows: DataFrame, families: tuple[Family, ...] = FAMILIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """pos_id, side, turn, idx and summed value of the families, for each side, with further columns of side_rows.

    The sums share the partitioning of sides(): no shuffle is added.
    """
    return entries(side_rows, families, keep).groupBy("pos_id", "side", "turn", *keep, "idx").agg(F.sum("value").alias("value"))


#: An entry as the side to move counts it.
_SIGNED = "CASE WHEN side = turn THEN value ELSE -value END"


def feature_rows(side_rows: DataFrame, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """pos_id, idx, value: the side to move less the other side, without zeros. Entries of both sides are summed at once."""
    return entries(side_rows, families).groupBy("pos_id", "idx").agg(F.sum(F.expr(_SIGNED)).alias("value")).filter("value <> 0")


def signed_values(side_rows: DataFrame) -> DataFrame:
    """pos_id, idx, value (the side to move less the other), with the officers of both sides under FORCE (force) and, in
    every row, whether the side to move is in check (checked)."""
    d = side_rows.withColumn("checked", F.expr(B.has("x_hit_all", "king")))
    v = entries(d, (*FAMILIES, EXTRAS[1]), ("checked",))
    return v.groupBy("pos_id", "idx").agg(F.sum(F.expr(_SIGNED)).alias("value"), F.sum("value").alias("force"), F.expr("bool_or(side = turn AND checked)").alias("checked"))


def phases(side_rows: DataFrame) -> DataFrame:
    """pos_id, mg and eg factors (24 together) by the officers on the board."""
    return side_rows.groupBy("pos_id").agg(F.expr(f"CAST(greatest(24 - sum({OFFICER_FORCE}), 0) AS INT)").alias("stage")).selectExpr("pos_id", "24 - stage AS mg", "stage AS eg")


def unstoppable(side_rows: DataFrame) -> DataFrame:
    """pos_id, side and the score that pawns give which nothing can stop."""
    d = piece_rows(side_rows).filter("unstoppable")
    return d.groupBy("pos_id", "side").agg(F.expr(f"sum({_GAIN})").alias("gain"))
