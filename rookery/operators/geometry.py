"""Attack relations: a broadcast table of lines joined to pieces, folded back to one row a position and side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions import board as B


#: Every move from sq on an empty board, pawns as they attack, as (dst, squares strictly between).
_DF, _DR = "(dst DIV 8 - sq DIV 8)", "(dst % 8 - sq % 8)"
_BETWEEN = f"CASE WHEN pc BETWEEN 2 AND 4 THEN aggregate(sequence(1, 7), 0L, (a, i) -> CASE WHEN i < greatest(abs({_DF}), abs({_DR})) THEN a | shiftleft(1L, CAST(sq + i * (sign({_DF}) * 8 + sign({_DR})) AS INT)) ELSE a END) ELSE 0L END"
_ROOK, _BISHOP = f"({_DF} = 0 OR {_DR} = 0)", f"abs({_DF}) = abs({_DR})"
_REACH = f"CASE pc WHEN 0 THEN abs({_DF}) = 1 AND {_DR} = 1 - 2 * side WHEN 1 THEN abs({_DF} * {_DR}) = 2 WHEN 2 THEN {_BISHOP} WHEN 3 THEN {_ROOK} WHEN 4 THEN {_ROOK} OR {_BISHOP} ELSE greatest(abs({_DF}), abs({_DR})) = 1 END"


def targets(spark: SparkSession) -> DataFrame:
    """pc, side, sq and its lines: 768 rows from the board's coordinates; their size doesn't depend on any data."""
    d = spark.range(768).selectExpr("CAST(id DIV 128 AS INT) AS pc", "CAST(id DIV 64 % 2 AS INT) AS side", "CAST(id % 64 AS INT) AS sq")
    return d.selectExpr("pc", "side", "sq", f"transform(filter(sequence(0, 63), dst -> sq <> dst AND {_REACH}), dst -> struct(dst, {_BETWEEN} AS between)) AS lines")


def lines(spark: SparkSession) -> DataFrame:
    """pc, side, sq, dst and the squares strictly between, a row for each of the 7,532 lines."""
    return targets(spark).select("pc", "side", "sq", F.explode("lines").alias("l")).select("pc", "side", "sq", "l.*")


def attack_edges(pieces: DataFrame) -> DataFrame:
    """pos_id, side, pc, sq, dst of every attacked square; sliders reach the first piece, inclusive.

    One shuffle by pos_id, to give each piece the occupied squares; the lines are broadcast.
    """
    occupied = pieces.groupBy("pos_id").agg(F.expr(f"bit_or({B.bit('sq')})").alias("occ"), F.collect_list(F.struct("sq", "side", "pc")).alias("own"))
    each = occupied.select("pos_id", "occ", F.explode("own").alias("p")).select("pos_id", "occ", "p.*")
    return each.join(F.broadcast(lines(pieces.sparkSession)), ["pc", "side", "sq"]).filter("(between & occ) = 0").select("pos_id", "side", "pc", "sq", "dst")


#: Directions as (files, ranks): squares ahead of one have higher numbers in the first four and lower ones in the others. Rooks' come first.
_DIRECTIONS = ((0, 1), (1, 0), (1, 1), (1, -1), (0, -1), (-1, 0), (-1, -1), (-1, 1))
_STRAIGHT = (0, 1, 4, 5)


def _squares(sq: int, df: int, dr: int) -> list[int]:
    f, r = divmod(sq, 8)
    return [(f + i * df) * 8 + r + i * dr for i in range(1, 8) if 0 <= f + i * df < 8 and 0 <= r + i * dr < 8]


def _jumps(pc: int, side: int, sq: int) -> list[int]:
    """Squares that a pawn, knight or king attacks."""
    steps = {0: [(d, 1 - 2 * side) for d in (-1, 1)], 1: [(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)], 5: _DIRECTIONS}
    return [to for df, dr in steps.get(pc, ()) for to in _squares(sq, df, dr)[:1]]


def rays(spark: SparkSession) -> DataFrame:
    """pc, side, sq, jumps and the squares in each of eight directions (d0 to d7, none where the piece doesn't slide): 768 rows from the board's coordinates."""
    slides = {2: [d for d in range(8) if d not in _STRAIGHT], 3: _STRAIGHT, 4: range(8)}
    rows = [(pc, side, sq, B._mask(_jumps(pc, side, sq)), *[B._mask(_squares(sq, *_DIRECTIONS[d])) if d in slides.get(pc, ()) else 0 for d in range(8)]) for pc in range(6) for side in (0, 1) for sq in range(64)]
    return spark.createDataFrame(rows, "pc int, side int, sq int, jumps long, " + ", ".join(f"d{d} long" for d in range(8)))


def attacked(d: DataFrame) -> DataFrame:
    """d (occ, xk and the columns of rays()) with tos, the squares a piece attacks: jumps, and each direction up to its first piece; and
    shield, the pieces between it and the king on xk, if that is on one of its lines, else null.

    Upwards that is the lowest piece, b ^ (b - 1); downwards the highest, found by filling all squares below each piece. Plain integer
    operations, a column a step, so no step is computed twice.
    """
    lowest = lambda b: f"CASE WHEN {b} = {-(1 << 63)}L THEN -1L ELSE {b} ^ ({b} - 1L) END"
    keep = [c for c in d.columns if c not in ("jumps", *(f"d{k}" for k in range(8)))]
    d = d.withColumns({f"b{k}": F.expr(f"d{k} & occ") for k in range(8)})
    for step in (1, 2, 4, 8, 16, 32):
        d = d.withColumns({f"b{k}": F.expr(f"b{k} | shiftrightunsigned(b{k}, {step})") for k in range(4, 8)})
    up = " | ".join(f"(d{k} & ({lowest(f'b{k}')}))" for k in range(4))
    down = " | ".join(f"(d{k} & ~shiftrightunsigned(b{k}, 1))" for k in range(4, 8))
    below = "~shiftleft(-1L, xk)"
    near = [f"WHEN {B.has(f'd{k}', 'xk')} THEN occ & d{k} & {below if k < 4 else f'~({below} | {B.bit("xk")})'}" for k in range(8)]
    return d.select(*keep, F.expr(f"jumps | {up} | {down}").alias("tos"), F.expr(f"CASE {' '.join(near)} END").alias("shield"))


#: Kinds of rows while attacks are folded: pieces, and what knights, bishops and rooks would attack from a king's square.
_REAL, _PROBE = 0, 1


def sides(positions: DataFrame, pieces: DataFrame) -> DataFrame:
    """Two rows a position, one for each side, with everything that features are made of.

    own and opp: pieces by type (arrays of six sets); o_* and x_*: sets of own and opposing
    attacks; men: own pieces with what they attack and, for sliders, the one piece that stands
    between them and the other king; probes: what each piece type would attack from the other
    king's square. A row for each piece meets the broadcast targets and is folded back; that and all later
    groupings share the partitioning by pos_id, so the plan has one shuffle of pieces and one of positions.
    """
    b = pieces.groupBy("pos_id").agg(F.expr(f"bit_or({B.bit('sq')})").alias("occ"), F.collect_list(F.struct(F.lit(_REAL).alias("what"), "sq", "side", "pc")).alias("men"))
    b = positions.select("pos_id", "wk", "bk", "turn", "castling").join(b, "pos_id")
    probes = ", ".join(f"struct({_PROBE} AS what, {king} AS sq, {side} AS side, {pc} AS pc)" for side, king in ((0, "bk"), (1, "wk")) for pc in (1, 2, 3))
    each = b.withColumn("m", F.explode(F.expr(f"concat(men, array({probes}))"))).select("pos_id", "wk", "bk", "turn", "castling", "occ", "m.*")
    each = each.withColumn("xk", F.expr("CASE WHEN side = 0 THEN bk ELSE wk END"))
    hit = attacked(each.join(F.broadcast(rays(pieces.sparkSession)), ["pc", "side", "sq"]))
    hit = hit.withColumn("pin", F.expr(f"CASE WHEN what = {_REAL} AND bit_count(shield) = 1 THEN shield ELSE 0L END")).drop("xk", "shield")
    real = f"what = {_REAL}"
    either = lambda value, cond: F.array(*[F.expr(f"coalesce(bit_or(CASE WHEN {real} AND side = {s} AND {cond} THEN {value} END), 0L)") for s in (0, 1)])
    listed = lambda value, cond: F.array(*[F.expr(f"collect_list(CASE WHEN {real} AND side = {s} AND {cond} THEN {value} END)") for s in (0, 1)])
    mean = lambda e: F.expr(f"CAST(CAST(coalesce(avg(CASE WHEN {real} AND pc = 0 THEN {e} + 0.5D END), 4.0D) AS FLOAT) AS DOUBLE)")
    one = hit.groupBy("pos_id", "wk", "bk", "turn", "castling", "occ").agg(
        *[F.array(*[F.expr(f"coalesce(bit_or(CASE WHEN {real} AND side = {s} AND pc = {p} THEN {B.bit('sq')} END), 0L)") for p in range(6)]).alias("wb"[s]) for s in (0, 1)],
        F.array(*[F.array(*[F.expr(f"max(CASE WHEN what = {_PROBE} AND side = {s} AND pc = {p} THEN tos END)") for p in (1, 2, 3)]) for s in (0, 1)]).alias("probe"),
        either("tos", "true").alias("hit_all"), either("tos", "pc <= 4").alias("hit_queen"), either("tos", "pc = 0").alias("hit_pawn"),
        listed("struct(sq, pc, tos)", "true").alias("men"), listed("struct(pin, pc)", "pin <> 0").alias("pins"),
        mean("shiftright(sq, 3)").alias("mid_file"), mean("(sq & 7)").alias("mid_rank"),
    )
    # Squares attacked twice: pawns attack as one set, every other piece for itself.
    twice = "transform(array(0, 1), s -> aggregate(filter(men[s], x -> x.pc > 0), struct(hit_pawn[s] AS once, 0L AS twice), (a, x) -> struct(a.once | x.tos AS once, a.twice | (a.once & x.tos) AS twice), a -> a.twice))"
    one = one.withColumn("twice", F.expr(twice)).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    pick = lambda c, x: f"{c}[{'side' if x == 'o' else '1 - side'}]"
    out = one.select(
        "pos_id", "side", "turn", "castling", "occ", "mid_file", "mid_rank",
        F.expr("CASE WHEN side = 0 THEN wk ELSE bk END").alias("king"), F.expr("CASE WHEN side = 0 THEN bk ELSE wk END").alias("xking"),
        F.expr("CASE WHEN side = 0 THEN w ELSE b END").alias("own"), F.expr("CASE WHEN side = 0 THEN b ELSE w END").alias("opp"),
        *[F.expr(pick(c, x)).alias(f"{x}_{c}") for x in "ox" for c in ("hit_all", "hit_queen", "hit_pawn", "twice")],
        F.expr("men[side]").alias("men"), F.expr("pins[1 - side]").alias("pins"), F.expr("probe[side]").alias("probe"),
    )
    every = " | ".join("{0}[%d]" % p for p in range(6))
    return _pawn_reach(out.withColumns({
        "own_all": F.expr(every.format("own")), "opp_all": F.expr(every.format("opp")), "op": F.expr("own[0]"), "xp": F.expr("opp[0]"),
        "pawn_safe": F.expr("~(own[0] | x_hit_pawn)"), "queen_safe": F.expr("~x_hit_all | (~x_hit_queen & o_twice)"),
        "zone": F.expr(B.king_zone("king")), "xzone": F.expr(B.king_zone("xking")),
    }))


def _fill(start: str, step: str, name: str) -> str:
    """start spread by step until nothing changes; seven steps cross the board."""
    return f"aggregate(sequence(1, 7), {start}, ({name}, n) -> {name} | {step})"


def _pawn_reach(d: DataFrame) -> DataFrame:
    """weak: own pawns that no own pawn can come to stand beside or behind; strong: squares that no
    opposing pawn can come to attack; blocked: own pawns whose next square is unsafe."""
    pawns = "(op | xp)"
    safe_o = f"~({pawns} | (x_hit_pawn & ~o_hit_pawn))"
    safe_x = f"~({pawns} | (o_hit_pawn & ~x_hit_pawn))"
    d = d.withColumns({"safe_o": F.expr(safe_o), "safe_x": F.expr(safe_x)})
    d = d.withColumns({
        "ahead_o": F.expr(_fill("op", f"({B.forward('a', 'side')} & safe_o)", "a")),
        "back_o": F.expr(_fill(B.beside("op"), B.forward("a & safe_o", "(1 - side)"), "a")),
        "ahead_x": F.expr(_fill("xp", f"({B.forward('a', '(1 - side)')} & safe_x)", "a")),
    })
    return d.withColumns({
        "weak": F.expr(f"op & ~({B.beside('ahead_o')} | {B.pawn_hits('ahead_o', 'side')}) & ~back_o"),
        "strong": F.expr(f"~{B.pawn_hits('ahead_x', '(1 - side)')}"),
        "blocked": F.expr(f"op & {B.forward('~safe_o', '(1 - side)')}"),
    }).drop("ahead_o", "back_o", "ahead_x", "safe_o", "safe_x")
