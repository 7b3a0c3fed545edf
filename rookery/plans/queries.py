"""Registered queries of the position engine, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions import board as B
from rookery.functions import scalars as S
from rookery.operators import batching, features, geometry, linear, metrics, moves, scoring, sparse, training
from rookery.plans import feature_sql as Q
from rookery.plans import jobs
from rookery.sources import fixtures as X
from rookery.sources import records, shared, text_positions, weight_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.sides(X.positions(spark, sf_dir), X.pieces(spark, sf_dir))


def _weights(spark: SparkSession, n: int) -> DataFrame:
    """The fixed weights of checked queries."""
    return spark.range(n).selectExpr("id AS idx", "CAST((id * 37) % 101 - 50 AS DOUBLE) AS mg", "CAST((id * 53) % 97 - 48 AS DOUBLE) AS eg")


POS, MEN, ROWS, SPARSE = f"pos AS ({X.POSITIONS})", f"men AS ({X.PIECES})", f"rws AS ({X.ROWS})", f"sp AS ({X.SPARSE})"
#: The same, each made once.
ONCE = f"pos AS MATERIALIZED ({X.POSITIONS}), men AS MATERIALIZED ({X.PIECES.replace(f'WITH k AS ({X.POSITIONS})', 'WITH k AS (SELECT * FROM pos)')})"
BASE = Q.BASE

# Feature families, each by itself; X0 is their union.
for _family in features.FAMILIES:
    def _one(spark, sf_dir, family=_family):
        return features.values(_sides(spark, sf_dir), (family,)).select("pos_id", "side", "idx", F.round("value", 4).alias("value"))
    _one.__name__ = _family.name
    query(Q.family_sql(_family.name))(_one)


@query(f"{BASE} SELECT CAST(a.pos_id AS BIGINT) AS pos_id, CAST(a.idx AS INTEGER) AS idx, CAST(ROUND(SUM(CASE WHEN a.side=p.turn THEN v ELSE -v END),4) AS DOUBLE) AS value FROM ({Q.all_families()}) a JOIN pos p USING (pos_id) GROUP BY 1,2 HAVING ROUND(SUM(CASE WHEN a.side=p.turn THEN v ELSE -v END),4)<>0")
def x0_feature_rows(spark, sf_dir):
    return features.feature_rows(_sides(spark, sf_dir)).select("pos_id", "idx", F.round("value", 4).alias("value")).filter("value <> 0")


@query(f"{BASE} SELECT CAST(pos_id AS BIGINT) AS pos_id, CAST(side AS INTEGER) AS side, CAST(SUM(90000*(rr-1)//6) AS BIGINT) AS gain FROM unstop GROUP BY 1,2")
def x19_unstoppable_pawn(spark, sf_dir):
    return features.unstoppable(_sides(spark, sf_dir))


_STAGE = "greatest(24-SUM(CASE pc WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 0 END),0)"


@query(f"WITH {MEN} SELECT CAST(pos_id AS BIGINT) AS pos_id, CAST(24-{_STAGE} AS INTEGER) AS mg, CAST({_STAGE} AS INTEGER) AS eg FROM men GROUP BY 1")
def x24_phase(spark, sf_dir):
    return features.phases(_sides(spark, sf_dir))


_FLAGS = """flags AS MATERIALIZED (SELECT m.pos_id, m.side, any_value(m.turn) AS turn, SUM(CASE m.pc WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 0 END) AS force,
  COUNT(*) FILTER (m.pc=0) AS pawns, COUNT(*) FILTER (m.pc IN (1,2))>0 AS minors, COUNT(*) FILTER (m.pc BETWEEN 1 AND 4)=2 AND COUNT(*) FILTER (m.pc=1)=2 AS two_knights,
  COUNT(*) FILTER (m.pc BETWEEN 1 AND 4)=0 AS lone_king,
  COUNT(*) FILTER (m.pc=0)>0 AND COUNT(*) FILTER (m.pc=0 AND m.fl<>0)=0 AND COUNT(*) FILTER (m.pc IN (1,3,4))=0 AND greatest(any_value(m.xking)//8, abs(any_value(m.xking)%8-7*(1-m.side)))<=1
    AND COUNT(*) FILTER (m.pc=2 AND (m.fl+m.rk)%2=(7*(1-m.side))%2)=0 AS rook_a,
  COUNT(*) FILTER (m.pc=0)>0 AND COUNT(*) FILTER (m.pc=0 AND m.fl<>7)=0 AND COUNT(*) FILTER (m.pc IN (1,3,4))=0 AND greatest(7-any_value(m.xking)//8, abs(any_value(m.xking)%8-7*(1-m.side)))<=1
    AND COUNT(*) FILTER (m.pc=2 AND (m.fl+m.rk)%2=(7+7*(1-m.side))%2)=0 AS rook_h,
  COUNT(*) FILTER (m.pc=0)=1 AND MAX(CASE WHEN m.pc=0 THEN m.fl END)=any_value(m.xking)//8 AND (any_value(m.xking)%8-MAX(CASE WHEN m.pc=0 THEN m.rk END))*(1-2*m.side)>0 AS blocked,
  CASE WHEN COUNT(*) FILTER (m.pc BETWEEN 1 AND 4)=1 AND COUNT(*) FILTER (m.pc=2)=1 THEN MAX(CASE WHEN m.pc=2 THEN (m.fl+m.rk)%2 END) END AS one_bishop FROM men m GROUP BY 1,2)"""


@query(f"{BASE}, {_FLAGS} SELECT CAST(pos_id AS BIGINT) AS pos_id, CAST(side AS INTEGER) AS side, CAST(force AS INTEGER) AS force, CAST(pawns AS INTEGER) AS pawns, minors, two_knights, lone_king, rook_a, rook_h, coalesce(blocked, false) AS blocked, CAST(coalesce(one_bishop,-1) AS INTEGER) AS one_bishop FROM flags")
def x25_endgame_flags(spark, sf_dir):
    return scoring.endgame_flags(_sides(spark, sf_dir)).select("pos_id", "side", "force", "pawns", "minors", "two_knights", "lone_king", "rook_a", "rook_h", "blocked", F.coalesce("one_bishop", F.lit(-1)).alias("one_bishop"))


# Geometry.
@query(f"{BASE} SELECT CAST(p.pos_id AS BIGINT) AS pos_id, CAST(p.sq AS INTEGER) AS sq, CAST(COUNT(l.dst) AS BIGINT) AS n_lines, CAST(SUM(CASE WHEN p.pc IN (2,3,4) THEN greatest(abs(l.sq//8-l.dst//8),abs(l.sq%8-l.dst%8))-1 ELSE 0 END) AS BIGINT) AS n_between FROM men0 p JOIN ln l ON l.pc=p.pc AND l.side=p.side AND l.sq=p.sq GROUP BY 1,2")
def g1_geometry(spark, sf_dir):
    d = X.pieces(spark, sf_dir).join(F.broadcast(geometry.lines(spark)), ["pc", "side", "sq"])
    return d.groupBy("pos_id", "sq").agg(F.count("dst").alias("n_lines"), F.sum(F.expr("CAST(bit_count(between) AS BIGINT)")).alias("n_between"))


@query(f"{BASE} SELECT CAST(pos_id AS BIGINT) AS pos_id, CAST(side AS INTEGER) AS side, CAST(pc AS INTEGER) AS pc, CAST(sq AS INTEGER) AS sq, CAST(dst AS INTEGER) AS dst FROM att")
def g2_attack_edges(spark, sf_dir):
    return geometry.attack_edges(X.pieces(spark, sf_dir))


@query(f"{BASE} SELECT CAST(b.pos_id AS BIGINT) AS pos_id, {Q._IN_CHECK} AS in_check FROM both_sides b WHERE b.side=b.turn")
def g3_in_check(spark, sf_dir):
    return moves.in_check(_sides(spark, sf_dir))


@query(f"{BASE} SELECT CAST(b.pos_id AS BIGINT) AS pos_id, CAST(b.side AS INTEGER) AS side, CAST((SELECT COUNT(*) FROM hit h WHERE h.pos_id=b.pos_id AND h.side=b.side) AS BIGINT) AS n_all, CAST((SELECT COUNT(*) FROM patt h WHERE h.pos_id=b.pos_id AND h.side=b.side) AS BIGINT) AS n_pawn, CAST((SELECT COUNT(*) FROM hit h WHERE h.pos_id=b.pos_id AND h.side=b.side AND h.least_pc<=4) AS BIGINT) AS n_queen, CAST((SELECT COUNT(*) FROM hit h WHERE h.pos_id=b.pos_id AND h.side=b.side AND h.n>=2) AS BIGINT) AS n_twice, CAST((SELECT COUNT(*) FROM qsafe h WHERE h.pos_id=b.pos_id AND h.side=b.side) AS BIGINT) AS n_safe FROM both_sides b")
def g4_attack_maps(spark, sf_dir):
    count = lambda e: f"CAST(bit_count({e}) AS BIGINT)"
    return _sides(spark, sf_dir).selectExpr("pos_id", "side", f"{count('o_hit_all')} AS n_all", f"{count('o_hit_pawn')} AS n_pawn", f"{count('o_hit_queen')} AS n_queen", f"{count('o_twice')} AS n_twice", f"{count('queen_safe')} AS n_safe")


@query(f"{BASE} SELECT CAST(m.pos_id AS BIGINT) AS pos_id, CAST(e.side AS INTEGER) AS side, CAST(p.sq AS INTEGER) AS sq, CAST(p.pinner AS INTEGER) AS pinner FROM pins p JOIN men e ON e.pos_id=p.pos_id AND e.sq=p.pinner_sq JOIN men m ON m.pos_id=p.pos_id AND m.sq=p.sq")
def g5_pins(spark, sf_dir):
    d = _sides(spark, sf_dir).select("pos_id", (1 - F.col("side")).alias("side"), F.explode("pins").alias("p"))
    return d.selectExpr("pos_id", "side", "CAST(bit_count(CASE WHEN p.pin < 0 THEN 9223372036854775807L ELSE p.pin - 1 END) AS INT) AS sq", "p.pc AS pinner")


@query(f"{BASE} SELECT CAST(z.pos_id AS BIGINT) AS pos_id, CAST(z.side AS INTEGER) AS side, CAST(COUNT(*) AS BIGINT) AS n_zone, CAST(COUNT(m.sq) AS BIGINT) AS n_own FROM zone z LEFT JOIN men m ON m.pos_id=z.pos_id AND m.side=z.side AND m.sq=z.s GROUP BY 1,2")
def g6_king_zone(spark, sf_dir):
    return _sides(spark, sf_dir).selectExpr("pos_id", "side", "CAST(bit_count(zone) AS BIGINT) AS n_zone", "CAST(bit_count(zone & own_all) AS BIGINT) AS n_own")


@query(f"{BASE} SELECT CAST(p.pos_id AS BIGINT) AS pos_id, CAST(p.sq AS INTEGER) AS sq, EXISTS (SELECT 1 FROM passed x WHERE x.pos_id=p.pos_id AND x.sq=p.sq) AS passed, EXISTS (SELECT 1 FROM pawn x WHERE x.pos_id=p.pos_id AND x.side=p.side AND x.rk=p.rk AND abs(x.fl-p.fl)=1) AS duo, EXISTS (SELECT 1 FROM prot x WHERE x.pos_id=p.pos_id AND x.sq=p.sq) AS protected, EXISTS (SELECT 1 FROM pawn x WHERE x.pos_id=p.pos_id AND x.side<>p.side AND x.sq=p.sq+1-2*p.side) AS ram, NOT EXISTS (SELECT 1 FROM pawn x WHERE x.pos_id=p.pos_id AND x.side<>p.side AND x.fl=p.fl) AS half_open FROM pawn p")
def g7_pawn_relations(spark, sf_dir):
    d = features.piece_rows(_sides(spark, sf_dir)).filter("pc = 0")
    return d.selectExpr("pos_id", "sq", "passed", f"{B.has(B.beside('op'), 'sq')} AS duo", f"{features._PROTECTED} AS protected", f"{B.has('xp', features._STOP)} AS ram", f"(xp & {B.file_set('sq')}) = 0 AS half_open")


@query(f"{BASE} SELECT CAST(b.pos_id AS BIGINT) AS pos_id, CAST(b.side AS INTEGER) AS side, CAST((SELECT COUNT(*) FROM weak w WHERE w.pos_id=b.pos_id AND w.side=b.side) AS BIGINT) AS n_weak, CAST(64-(SELECT COUNT(*) FROM xreach x WHERE x.pos_id=b.pos_id AND x.side=b.side) AS BIGINT) AS n_strong, CAST((SELECT COUNT(*) FROM pawn p JOIN shut u ON u.pos_id=p.pos_id AND u.side=p.side AND u.s=p.sq+1-2*p.side WHERE p.pos_id=b.pos_id AND p.side=b.side AND p.r<7) AS BIGINT) AS n_blocked FROM both_sides b")
def g8_pawn_reach(spark, sf_dir):
    return _sides(spark, sf_dir).selectExpr("pos_id", "side", "CAST(bit_count(weak) AS BIGINT) AS n_weak", "CAST(bit_count(strong) AS BIGINT) AS n_strong", "CAST(bit_count(blocked) AS BIGINT) AS n_blocked")


# Moves and scalar rules.
_TURN = lambda s: f"(({s})&7)*8+(({s})>>3)"
_MV = f"mv AS (SELECT *, CAST({_TURN('(CAST(move AS BIGINT)>>6)&63')} AS INT) AS frm, CAST({_TURN('CAST(move AS BIGINT)&63')} AS INT) AS dst, CASE (CAST(move AS BIGINT)>>14)&3 WHEN 1 THEN ((CAST(move AS BIGINT)>>12)&3)+1 WHEN 2 THEN 0 WHEN 3 THEN 5 ELSE 6 END AS prom FROM pos)"
_CLS = "cls AS (SELECT v.*, o.pc AS moved, CASE WHEN v.prom=5 THEN NULL WHEN v.prom=0 THEN 0 ELSE t.pc END AS captured FROM mv v LEFT JOIN {m} o ON o.pos_id=v.pos_id AND o.sq=v.frm LEFT JOIN {m} t ON t.pos_id=v.pos_id AND t.sq=v.dst)"


@query(f"WITH {POS}, {_MV} SELECT CAST(pos_id AS BIGINT) AS pos_id, CAST(frm AS INTEGER) AS frm, CAST(dst AS INTEGER) AS dst, CAST(prom AS INTEGER) AS prom FROM mv")
def f1_decode_move(spark, sf_dir):
    return moves.decode_moves(X.positions(spark, sf_dir)).select("pos_id", "frm", "dst", "prom")


def _classified(spark, sf_dir):
    return moves.classify_moves(moves.decode_moves(X.positions(spark, sf_dir)), X.pieces(spark, sf_dir))


@query(f"WITH {ONCE}, {_MV}, {_CLS.format(m='men')} SELECT CAST(pos_id AS BIGINT) AS pos_id, CAST(coalesce(moved,-1) AS INTEGER) AS moved, CAST(coalesce(captured,-1) AS INTEGER) AS captured, captured IS NOT NULL AS is_capture, prom BETWEEN 1 AND 4 AS is_promotion, prom BETWEEN 1 AND 3 AS is_underpromotion, prom=5 AS is_castling, prom=0 AS is_en_passant, captured IS NOT NULL OR prom BETWEEN 1 AND 4 AS is_tactical, coalesce(moved=0,false) OR captured IS NOT NULL AS is_conversion FROM cls")
def f2_move_class(spark, sf_dir):
    d = _classified(spark, sf_dir)
    return d.select("pos_id", F.coalesce("moved", F.lit(-1)).alias("moved"), F.coalesce("captured", F.lit(-1)).alias("captured"), "is_capture", "is_promotion", "is_underpromotion", "is_castling", "is_en_passant", "is_tactical", "is_conversion")


_QUIET = f"{_MV}, {_CLS.format(m='men0')}, quiet AS MATERIALIZED (SELECT c.* FROM cls c JOIN both_sides b ON b.pos_id=c.pos_id AND b.side=b.turn WHERE c.captured IS NULL AND c.prom NOT BETWEEN 1 AND 4 AND NOT {Q._IN_CHECK})"


@query(f"{BASE}, {_QUIET} SELECT CAST(pos_id AS BIGINT) AS pos_id FROM quiet")
def f3_filter_quiet(spark, sf_dir):
    return moves.quiet(_classified(spark, sf_dir), moves.in_check(_sides(spark, sf_dir))).select("pos_id")


@query(f"WITH {POS}, {_MV}, nm AS (SELECT *, CASE WHEN prom=5 THEN CASE WHEN dst//8>frm//8 THEN 48 ELSE 16 END + dst%8 ELSE dst END AS t FROM mv) SELECT CAST(pos_id AS BIGINT) AS pos_id, chr(CAST(97+frm//8 AS INT))||chr(CAST(49+frm%8 AS INT))||chr(CAST(97+t//8 AS INT))||chr(CAST(49+t%8 AS INT))||CASE prom WHEN 1 THEN 'n' WHEN 2 THEN 'b' WHEN 3 THEN 'r' WHEN 4 THEN 'q' ELSE '' END AS text FROM nm")
def f4_move_text(spark, sf_dir):
    return moves.move_text(moves.decode_moves(X.positions(spark, sf_dir))).select("pos_id", "text")


def _labelled(spark, sf_dir):
    """row_id, idx, value with the factors, label and result of the row."""
    return X.sparse(spark, sf_dir).join(X.rows(spark, sf_dir).withColumnRenamed("row_ord", "row_id"), "row_id")


LAB = f"{SPARSE}, {ROWS}, lab AS (SELECT sp.*, r.y, r.mg, r.eg, r.result FROM sp JOIN rws r ON r.row_ord=sp.row_id)"


@query(f"WITH {LAB} SELECT row_id, CAST(idx AS BIGINT) AS idx, CAST(ROUND(value*mg/24.0,6) AS DOUBLE)+0.0 AS value FROM lab UNION ALL SELECT row_id, CAST(idx+40 AS BIGINT), CAST(ROUND(value*eg/24.0,6) AS DOUBLE)+0.0 FROM lab")
def f5_phase_expand(spark, sf_dir):
    return linear.phase_expand(_labelled(spark, sf_dir), 40).selectExpr("row_id", "idx", "CAST(round(value, 6) AS DOUBLE) + 0.0D AS value")


_SC = "sc AS (SELECT CAST(range AS BIGINT) AS idx, ceil(greatest(1.0, coalesce((SELECT MAX(abs(value)) FROM sp WHERE sp.idx=range.range),0))) AS scale FROM range(40))"


def _scales(d):
    """One number a feature."""
    return [r["scale"] for r in metrics.feature_scale(d, 40).orderBy("idx").collect()]


@query(f"WITH {SPARSE}, {_SC} SELECT row_id, CAST(sp.idx AS BIGINT) AS idx, CAST(ROUND(value/scale,6) AS DOUBLE) AS value FROM sp JOIN sc USING (idx)")
def f6_scale_features(spark, sf_dir):
    d = X.sparse(spark, sf_dir)
    return linear.scale_features(d, _scales(d)).selectExpr("row_id", "idx", "CAST(round(value, 6) AS DOUBLE) AS value")


@query(f"WITH {SPARSE} SELECT a.row_id, CAST(SUM(a.value*((a.idx*37)%101-50)) AS DOUBLE) AS dot, CAST(SUM(a.value*a.value) AS DOUBLE) AS norm2, CAST(SUM(2*a.value+a.idx) AS DOUBLE) AS combined FROM sp a GROUP BY 1")
def f7_sparse_algebra(spark, sf_dir):
    v = training.vectors(X.sparse(spark, sf_dir), "row_id").select("row_id", sparse.vector(F.col("indices"), F.col("vals")).alias("v")).withColumn("dense", sparse.densify(F.col("v"), 40))
    weights = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: ((i * 37) % 101 - 50).cast("double"))
    present = sparse.total(F.transform("v.indices", lambda i: i.cast("double")))
    return v.select("row_id", sparse.dot(F.col("v"), weights).alias("dot"), sparse.dot(F.col("v"), F.col("dense")).alias("norm2"), (sparse.total(sparse.multiply(F.col("dense"), 2.0)) + present).alias("combined"))


@query(f"WITH {POS} SELECT CAST(pos_id AS BIGINT) AS pos_id, CAST(least(wk//8,7-wk//8) AS INTEGER) AS w_file, CAST(7-bk%8 AS INTEGER) AS b_rank, CAST(greatest(abs(wk//8-bk//8),abs(wk%8-bk%8)) AS INTEGER) AS dist, CAST((wk//8+wk%8)%2 AS INTEGER) AS colour, CAST(CASE WHEN wk%8<7 THEN wk+1 ELSE -1 END AS INTEGER) AS front FROM pos")
def f8_relative_coords(spark, sf_dir):
    return X.positions(spark, sf_dir).selectExpr("pos_id", f"CAST({B.mirror_file('wk')} AS INT) AS w_file", f"CAST({B.side_rank('bk', '1')} AS INT) AS b_rank", f"CAST({B.distance('wk', 'bk')} AS INT) AS dist", "CAST((shiftright(wk, 3) + wk) & 1 AS INT) AS colour", "CAST(CASE WHEN (wk & 7) < 7 THEN wk + 1 ELSE -1 END AS INT) AS front")


@query(f"WITH {ROWS} SELECT row_ord, CAST(floor(y/7.0) AS BIGINT) AS floored, CAST(floor((y+3.5)/7.0) AS BIGINT) AS rounded, CAST(floor(y/4.0+0.5) AS BIGINT) AS half_up FROM rws")
def f9_round_div(spark, sf_dir):
    return X.rows(spark, sf_dir).selectExpr("row_ord", "CAST(floor(y / 7.0) AS BIGINT) AS floored", f"{S.round_div('y', '7.0')} AS rounded", f"{S.round_half_up('y / 4.0')} AS half_up")


@query(f"WITH {POS} SELECT CAST(pos_id AS BIGINT) AS pos_id, CAST(CASE WHEN turn=0 THEN score ELSE -score END AS BIGINT) AS white_score, CAST(least(greatest(score*6,-9900),9900) AS BIGINT) AS clamped, CASE WHEN score*6>9900 THEN 'win' WHEN score*6<-9900 THEN 'loss' ELSE 'eval' END AS verdict FROM pos")
def f10_score_view(spark, sf_dir):
    return X.positions(spark, sf_dir).selectExpr("pos_id", "CASE WHEN turn = 0 THEN score ELSE -score END AS white_score", f"{S.clamp_score('score * 6')} AS clamped", f"{S.verdict('score * 6')} AS verdict")


@query(f"WITH {ROWS} SELECT row_ord, CAST(ROUND(1.0/(1.0+exp(-CAST(y AS DOUBLE)/206/4*ln(CAST(10 AS DOUBLE)))),6) AS DOUBLE) AS p FROM rws")
def f11_win_probability(spark, sf_dir):
    return X.rows(spark, sf_dir).selectExpr("row_ord", f"CAST(round({S.win_probability('y')}, 6) AS DOUBLE) AS p")


# Order, chunks, batches.
_TOTAL = "(SELECT MAX(row_ord)+1 FROM rws)"


@query(f"WITH {ROWS} SELECT row_ord, CAST(place AS BIGINT) AS place FROM {batching.place_sql('rws', 'row_ord', _TOTAL, 7)}")
def a1_shuffle_rows(spark, sf_dir):
    return batching.shuffle_rows(X.rows(spark, sf_dir), 7).select("row_ord", "place")


@query(f"WITH {ROWS} SELECT row_ord, CAST(row_ord//1000*1000+place AS BIGINT) AS place FROM {batching.place_sql('rws', 'row_ord%1000', f'least(1000, {_TOTAL}-row_ord//1000*1000)', 3, 'row_ord//1000')}")
def a2_shuffle_windows(spark, sf_dir):
    return batching.shuffle_within_windows(X.rows(spark, sf_dir), 1000, 3).select("row_ord", "place")


def _deal_sql(epoch):
    ids = "(SELECT DISTINCT row_ord//500 AS chunk_id FROM rws)"
    return f"deal AS (SELECT * FROM {batching.place_sql(ids, 'chunk_id', '(SELECT MAX(row_ord)//500+1 FROM rws)', batching.epoch_seed(5, epoch))})"


def _dealt(spark, sf_dir):
    return batching.deal_chunks(batching.chunks(X.rows(spark, sf_dir), 500).select("chunk_id").distinct(), 2, 5, 4)


@query(f"WITH {ROWS}, {_deal_sql(2)} SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(place AS BIGINT) AS place FROM deal")
def a3_shuffle_chunks(spark, sf_dir):
    return _dealt(spark, sf_dir).select("chunk_id", "place")


@query(f"WITH {ROWS}, {_deal_sql(2)} SELECT CAST(row_ord//500 AS BIGINT) AS chunk_id, CAST(place%4 AS BIGINT) AS worker, COUNT(*) AS n_rows, CAST(place%4 AS INTEGER) AS task FROM rws JOIN deal ON chunk_id=row_ord//500 GROUP BY ALL")
def a4_assign_workers(spark, sf_dir):
    """Rows of chunks at their workers; task is the partition that they are in."""
    d = batching.chunks(X.rows(spark, sf_dir), 500).join(_dealt(spark, sf_dir).select("chunk_id", "worker"), "chunk_id")
    d = batching.by_worker(d, 4).withColumn("task", F.spark_partition_id())
    return d.groupBy("chunk_id", "worker", "task").agg(F.count("*").alias("n_rows"))


@query(f"WITH {ROWS} SELECT row_ord, CAST(row_ord//1000 AS BIGINT) AS batch_id, CAST(least((row_ord%1000)//333,2) AS BIGINT) AS worker, CAST(row_ord//2 AS BIGINT) AS tiny_batch, CAST(row_ord%2 AS BIGINT) AS tiny_worker FROM rws")
def a5_mini_batches(spark, sf_dir):
    """Batches of 1000 rows for three workers, and of two rows, fewer than workers."""
    d = batching.mini_batches(X.rows(spark, sf_dir), 1000, 3).select("row_ord", "batch_id", "worker")
    return d.join(batching.mini_batches(X.rows(spark, sf_dir), 2, 3).select("row_ord", F.col("batch_id").alias("tiny_batch"), F.col("worker").alias("tiny_worker")), "row_ord")


@query(f"WITH {ROWS} SELECT row_ord, CAST(row_ord//500 AS BIGINT) AS chunk_id, CAST(y AS BIGINT) AS y FROM rws WHERE y>0")
def s5_feature_chunks(spark, sf_dir):
    return batching.chunks(X.rows(spark, sf_dir), 500).filter("y > 0").select("row_ord", "chunk_id", "y")


@query(f"WITH {ROWS} SELECT CAST(row_ord//500 AS BIGINT) AS chunk_id, 'feat-'||CAST(row_ord//500 AS BIGINT)||'.bin' AS name, COUNT(*) AS n_rows, MIN(row_ord) AS first_ord, MAX(row_ord) AS last_ord FROM rws GROUP BY 1,2")
def s6_chunk_manifest(spark, sf_dir):
    return batching.chunk_manifest(X.rows(spark, sf_dir), 500, "feat.bin").select("chunk_id", "name", "n_rows", "first_ord", "last_ord")


@query(f"WITH {ROWS} SELECT CAST(row_ord//500 AS BIGINT) AS chunk_id, COUNT(*) AS n_rows, COUNT(*) FILTER (y>0) AS n_kept FROM rws GROUP BY 1")
def m8_filter_counters(spark, sf_dir):
    return batching.chunk_manifest(X.rows(spark, sf_dir), 500, "feat.bin", F.col("y") > 0).select("chunk_id", "n_rows", "n_kept")


# The linear model, on integral values: sums stay exact with factors left undivided.
_W1 = "CAST(idx*37%101-50 AS DOUBLE)"


def _w(spark):
    return _weights(spark, 40).selectExpr("idx", "mg AS w")


_PRED = "pr AS (SELECT row_id, SUM(value*((idx*37)%101-50)) AS y_hat FROM sp GROUP BY 1), res AS (SELECT pr.*, r.y, r.result, r.y-pr.y_hat AS residual FROM pr JOIN rws r ON r.row_ord=pr.row_id)"


def _predicted(spark, sf_dir):
    p = linear.predict_with_values(X.sparse(spark, sf_dir), _w(spark))
    return p.join(X.rows(spark, sf_dir).withColumnRenamed("row_ord", "row_id"), "row_id").withColumn("residual", F.col("y") - F.col("y_hat"))


@query(f"WITH {SPARSE}, {ROWS}, {_PRED} SELECT row_id, CAST(y_hat AS DOUBLE) AS y_hat FROM pr")
def l1_predict(spark, sf_dir):
    return linear.predict(X.sparse(spark, sf_dir), _w(spark)).select("row_id", "y_hat")


_GRAD = "gr AS (SELECT idx, SUM(value*residual)/(SELECT COUNT(*) FROM res) AS g FROM sp JOIN res USING (row_id) GROUP BY 1)"


def _grad(spark, sf_dir):
    return linear.gradient(_predicted(spark, sf_dir))


@query(f"WITH {SPARSE}, {ROWS}, {_PRED}, {_GRAD} SELECT CAST(idx AS BIGINT) AS idx, CAST(ROUND(g,4) AS DOUBLE) AS g FROM gr")
def l2_squared_gradient(spark, sf_dir):
    return _grad(spark, sf_dir).select("idx", F.round("g", 4).alias("g"))


@query(f"WITH {SPARSE}, {ROWS}, {_PRED}, {_GRAD} SELECT CAST(idx AS BIGINT) AS idx, CAST(ROUND(g-0.01*((idx*37)%101-50),4) AS DOUBLE) AS g FROM gr")
def l3_l2_shrink(spark, sf_dir):
    return linear.l2_shrink(_grad(spark, sf_dir), _w(spark), 0.01).select("idx", F.round("g", 4).alias("g"))


@query(f"WITH {SPARSE}, {ROWS}, {_PRED}, {_GRAD} SELECT CAST(idx AS BIGINT) AS idx, CAST(ROUND(((idx*37)%101-50)+0.0001*(g-0.01*((idx*37)%101-50)),4) AS DOUBLE) AS w FROM gr")
def l4_sgd_step(spark, sf_dir):
    return linear.step(linear.l2_shrink(_grad(spark, sf_dir), _w(spark), 0.01), 0.0001).select("idx", F.round("w", 4).alias("w"))


_P = lambda x: f"(1/(1+exp(-CAST({x} AS DOUBLE)/206/4*ln(CAST(10 AS DOUBLE)))))"


@query(f"WITH {SPARSE}, {ROWS}, {_PRED}, lr AS (SELECT row_id, 0.7*({_P('y_hat')}-{_P('y')})+0.3*({_P('y_hat')}-(result+1)/2.0) AS residual FROM res) SELECT CAST(idx AS BIGINT) AS idx, CAST(ROUND(SUM(value*residual)/(SELECT COUNT(*) FROM lr),4) AS DOUBLE) AS g FROM sp JOIN lr USING (row_id) GROUP BY 1")
def l5_logistic_gradient(spark, sf_dir):
    return linear.gradient(linear.logistic_residuals(_predicted(spark, sf_dir), 0.7)).select("idx", F.round("g", 4).alias("g"))


_SCORES = f"""fam AS MATERIALIZED ({Q.all_families()}), wsum AS (SELECT a.pos_id, SUM(CASE WHEN a.side=p.turn THEN v ELSE -v END*((a.idx*37)%101-50)) AS ms, SUM(CASE WHEN a.side=p.turn THEN v ELSE -v END*((a.idx*53)%97-48)) AS es FROM fam a JOIN pos p USING (pos_id) GROUP BY 1),
stg AS (SELECT pos_id, {_STAGE} AS stage FROM men0 GROUP BY 1), gain AS (SELECT pos_id, SUM(CASE WHEN side=turn THEN 1 ELSE -1 END*(90000*(rr-1)//6)) AS gain FROM unstop GROUP BY 1),
stat AS MATERIALIZED (SELECT p.pos_id, p.turn, CAST(floor((ROUND(w.ms*(24-s.stage)+w.es*s.stage+24*coalesce(g.gain,0),4)+1200)/2400) AS BIGINT) AS score FROM pos p JOIN wsum w USING (pos_id) JOIN stg s USING (pos_id) LEFT JOIN gain g USING (pos_id))"""


@query(f"{BASE}, {_SCORES} SELECT CAST(pos_id AS BIGINT) AS pos_id, score FROM stat")
def l8_static_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("pos_id", "score")


_SCALED = f"""{_FLAGS}, vw AS (SELECT t.pos_id, t.turn, CASE WHEN t.turn=0 THEN t.score ELSE -t.score END AS v FROM stat t), led AS (SELECT v.pos_id, v.turn, v.v, x.force AS xf, x.pawns AS xp, x.rook_a OR x.rook_h AS rook, x.two_knights AS tk, coalesce(x.blocked,false) AS bl, y.force AS yf, y.pawns AS yp, y.minors AS ym, x.one_bishop AS xb, y.one_bishop AS yb
  FROM vw v JOIN flags x ON x.pos_id=v.pos_id AND x.side=CASE WHEN v.v>=0 THEN 0 ELSE 1 END JOIN flags y ON y.pos_id=v.pos_id AND y.side<>x.side),
dv AS (SELECT *, CASE WHEN xf>=6 THEN 1 WHEN xf=0 AND xp=0 THEN 0 WHEN rook THEN 64 WHEN xp=0 AND xf<=1 THEN 16 WHEN xp=0 AND xf=2 AND tk AND yp=0 THEN 16 WHEN xp=0 AND xf-yf<=1 THEN 4 WHEN xp=0 THEN 1
  WHEN xp=1 AND xf<=1 AND ym THEN 8 WHEN xp=1 AND xf=2 AND tk AND yp=0 AND ym THEN 8 WHEN xp=1 AND xf=yf AND bl THEN 4 WHEN xp=1 AND xf=yf AND ym THEN 2 WHEN xp=1 THEN 1 WHEN xb<>yb AND abs(xp-yp)<=2 THEN 2 ELSE 1 END AS k FROM led),
sc9 AS (SELECT pos_id, CAST(least(greatest(CASE WHEN turn=0 THEN 1 ELSE -1 END*CASE WHEN k=0 THEN 0 ELSE trunc(v/CAST(k AS DOUBLE)) END,-9900),9900) AS BIGINT) AS score FROM dv)"""


def _scores(spark, sf_dir):
    return scoring.scores(_sides(spark, sf_dir), _weights(spark, 759))


def _scaled(spark, sf_dir):
    return scoring.scaled_scores(_scores(spark, sf_dir))


@query(f"{BASE}, {_SCORES}, {_SCALED} SELECT CAST(pos_id AS BIGINT) AS pos_id, score FROM sc9")
def l9_endgame_scaled_score(spark, sf_dir):
    return _scaled(spark, sf_dir).select("pos_id", "score")


@query(f"{BASE}, {_SCORES}, {_SCALED} SELECT CAST(p.pos_id AS BIGINT) AS pos_id, CAST(s.score AS BIGINT) AS score, CAST(p.move AS INTEGER) AS move, CAST(p.game_result AS INTEGER) AS game_result FROM pos p JOIN sc9 s USING (pos_id)")
def s10_relabel_records(spark, sf_dir):
    return X.positions(spark, sf_dir).drop("score").join(_scaled(spark, sf_dir).select("pos_id", "score"), "pos_id").selectExpr("pos_id", "score", "move", "CAST(game_result AS INT) AS game_result")


# Text and packed positions.
_FEN = """fen AS (SELECT p.pos_id, (SELECT string_agg(line, '/' ORDER BY r DESC) FROM (SELECT q.r, replace(replace(replace(replace(replace(replace(replace(string_agg(coalesce(CASE WHEN m.side=0 THEN substr('PNBRQK',m.pc+1,1) ELSE lower(substr('PNBRQK',m.pc+1,1)) END,'1'),'' ORDER BY q.f),'11111111','8'),'1111111','7'),'111111','6'),'11111','5'),'1111','4'),'111','3'),'11','2') AS line
  FROM (SELECT CAST(range//8 AS INT) AS f, CAST(range%8 AS INT) AS r FROM range(64)) q LEFT JOIN men m ON m.pos_id=p.pos_id AND m.sq=q.f*8+q.r GROUP BY q.r))||CASE WHEN p.turn=0 THEN ' w ' ELSE ' b ' END||CASE WHEN p.rights=0 THEN '-' ELSE CASE WHEN p.rights&1<>0 THEN 'K' ELSE '' END||CASE WHEN p.rights&2<>0 THEN 'Q' ELSE '' END||CASE WHEN p.rights&4<>0 THEN 'k' ELSE '' END||CASE WHEN p.rights&8<>0 THEN 'q' ELSE '' END END
  ||' '||CASE WHEN p.ep>=0 THEN chr(CAST(97+p.ep//8 AS INT))||chr(CAST(49+p.ep%8 AS INT)) ELSE '-' END||' 0 1' AS fen FROM pos p)"""


@query(f"WITH {POS}, {MEN}, {_FEN} SELECT CAST(pos_id AS BIGINT) AS pos_id, fen FROM fen")
def s8_write_text_positions(spark, sf_dir):
    return text_positions.write_text(X.positions(spark, sf_dir), X.pieces(spark, sf_dir))


@query(f"WITH {MEN} SELECT CAST(pos_id AS BIGINT) AS pos_id, CAST(sq AS INTEGER) AS sq, CAST(side AS INTEGER) AS side, CAST(pc AS INTEGER) AS pc FROM men")
def s7_read_text_positions(spark, sf_dir):
    return text_positions.read_text(s8_write_text_positions(spark, sf_dir))[1]


@query(f"{BASE}, {_SCORES}, {_SCALED}, {_FEN.replace('JOIN men m', 'JOIN men0 m')} SELECT CAST(f.pos_id AS BIGINT) AS pos_id, f.fen||' '||CAST(s.score AS VARCHAR) AS line FROM fen f JOIN sc9 s USING (pos_id)")
def s9_score_text_positions(spark, sf_dir):
    p, m, _ = text_positions.read_text(s8_write_text_positions(spark, sf_dir))
    scores = scoring.scaled_scores(scoring.scores(geometry.sides(p, m), _weights(spark, 759)))
    return s8_write_text_positions(spark, sf_dir).join(scores, "pos_id").selectExpr("pos_id", "concat(fen, ' ', CAST(score AS STRING)) AS line")


#: Positions of over 256 bits have no packed form: 19 bits, one a square, four more and a colour bit a piece but kings.
@query(f"WITH {ONCE}, sizes AS MATERIALIZED (SELECT pos_id, COUNT(*) AS n FROM men GROUP BY 1) SELECT CAST(pos_id AS BIGINT) AS pos_id, CAST(sq AS INTEGER) AS sq, CAST(side AS INTEGER) AS side, CAST(pc AS INTEGER) AS pc FROM men WHERE pos_id IN (SELECT s.pos_id FROM sizes s JOIN pos p ON p.pos_id=s.pos_id WHERE 13+62+4*(n-2)+4+1+CASE WHEN ep>=0 THEN 6 ELSE 0 END+14<=256)")
def s3_decode_positions(spark, sf_dir):
    packed = records.encode_positions(X.positions(spark, sf_dir), X.pieces(spark, sf_dir))
    return records.decode_positions(packed, "pos_id")[1]


def _records(spark, sf_dir):
    """Records of positions that have a packed form, to be written: row_ord is pos_id. And one more than the greatest pos_id."""
    p = X.positions(spark, sf_dir)
    packed = records.encode_positions(p, X.pieces(spark, sf_dir)).filter("sfen IS NOT NULL")
    return p.join(packed, "pos_id").selectExpr("pos_id AS row_ord", "sfen", "score", "move", "CAST(pos_id % 1000 AS INT) AS game_ply", "game_result"), batching.ordinals(p.withColumnRenamed("pos_id", "row_ord"))


_FITS = "SELECT p.*, row_number() OVER (ORDER BY p.pos_id)-1 AS ord FROM pos p WHERE pos_id IN (SELECT pos_id FROM men JOIN pos USING (pos_id) GROUP BY 1 HAVING 13+62+4*(COUNT(*)-2)+4+1+CASE WHEN MAX(ep)>=0 THEN 6 ELSE 0 END+14<=256)"


@query(f"WITH {ONCE}, fits AS ({_FITS}) SELECT CAST(ord AS BIGINT) AS row_ord, CAST(score AS INTEGER) AS score, CAST(move AS INTEGER) AS move, CAST(pos_id%1000 AS INTEGER) AS game_ply, CAST(game_result AS INTEGER) AS game_result FROM fits")
def s1_read_records(spark, sf_dir):
    """Records written as 40-byte files and read back by byte ranges, numbered over all files."""
    path = shared.new_path(spark, "records")
    rows, total = _records(spark, sf_dir)
    records.write_records(rows, path, rows_per_file=1000, total=total)
    return records.read_records(spark, [path], rows_per_split=300).selectExpr("row_ord", "CAST(score AS INT) AS score", "move", "game_ply", "CAST(game_result AS INT) AS game_result")


@query(f"WITH {ONCE}, fits AS ({_FITS}), n AS (SELECT COUNT(*) FILTER (turn=0) AS a, COUNT(*) FILTER (turn=1) AS b FROM fits), o AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY pos_id)-1 AS k FROM fits) SELECT CAST(CASE WHEN turn=1 THEN k+t.nth*(a+b) ELSE k+b END AS BIGINT) AS row_ord, CAST(score AS INTEGER) AS score FROM o, n, (VALUES (0),(1)) t(nth) WHERE turn=1 OR t.nth=0")
def s2_read_file_list(spark, sf_dir):
    """A list file of folders by the side to move, the second one twice: their records as one sequence in list order."""
    rows, total = _records(spark, sf_dir)
    d = shared.settled(rows.join(X.positions(spark, sf_dir).selectExpr("pos_id AS row_ord", "turn"), "row_ord"))
    path = shared.new_path(spark, "records")
    for turn in (0, 1):
        records.write_records(d.filter(F.col("turn") == turn), f"{path}/{turn}", rows_per_file=700, total=total)
    shared.release(d)
    spark.createDataFrame([(f"{path}/1",), (f"{path}/0",), (f"{path}/1",)], "value string").coalesce(1).write.text(f"{path}/list")
    return records.read_records(spark, records.read_list(spark, f"{path}/list")).selectExpr("row_ord", "CAST(score AS INT) AS score")


@query(f"{BASE}, {_SCORES}, fits AS ({_FITS.replace('FROM men JOIN', 'FROM men0 JOIN')}) SELECT CAST(ord AS BIGINT) AS row_ord, CAST(least(greatest(t.score,-32768),32767) AS INTEGER) AS score, CAST(move AS INTEGER) AS move, CAST(f.pos_id%1000 AS INTEGER) AS game_ply, CAST(game_result AS INTEGER) AS game_result FROM fits f JOIN stat t ON t.pos_id=f.pos_id")
def s10_relabel_files(spark, sf_dir):
    """Record files, and those with static scores as labels: read back from the latter."""
    path = shared.new_path(spark, "records")
    rows, total = _records(spark, sf_dir)
    records.write_records(rows, f"{path}/old", rows_per_file=1000, total=total)
    jobs.relabel_files(spark, [f"{path}/old"], f"{path}/new", _weights(spark, 759), rows_per_file=700)
    return records.read_records(spark, [f"{path}/new"]).selectExpr("row_ord", "CAST(score AS INT) AS score", "move", "game_ply", "CAST(game_result AS INT) AS game_result")


@query(f"{BASE}, {_QUIET}, x0 AS (SELECT a.pos_id, a.idx, SUM(CASE WHEN a.side=p.turn THEN v ELSE -v END) AS value FROM ({Q.all_families()}) a JOIN pos p USING (pos_id) GROUP BY 1,2), xs AS (SELECT pos_id, COUNT(*) FILTER (value<>0) AS n, SUM(value) AS total FROM x0 GROUP BY 1), stg AS (SELECT pos_id, {_STAGE} AS stage FROM men0 GROUP BY 1) SELECT CAST(p.pos_id AS BIGINT) AS row_ord, CAST(24-s.stage AS INTEGER) AS mg, CAST(s.stage AS INTEGER) AS eg, CAST(p.score AS DOUBLE) AS y, CAST(p.game_result AS DOUBLE) AS result, CAST(coalesce(xs.n,0) AS INTEGER) AS n, CAST(ROUND(coalesce(xs.total,0),3) AS DOUBLE)+0.0 AS total FROM quiet p JOIN stg s USING (pos_id) LEFT JOIN xs ON xs.pos_id=p.pos_id")
def s4_write_features(spark, sf_dir):
    """Feature rows of quiet positions as files, read back."""
    path = shared.new_path(spark, "features")
    jobs.write_features(jobs.feature_vectors(X.positions(spark, sf_dir), X.pieces(spark, sf_dir)), path, quiet_only=True)
    return spark.read.parquet(path).selectExpr("row_ord", "mg", "eg", "y", "result", "size(indices) AS n", "round(aggregate(vals, 0D, (a, x) -> a + x), 3) + 0.0D AS total")


@query(f"WITH {POS}, {MEN}, {_FEN} SELECT CAST(row_number() OVER (ORDER BY pos_id)-1 AS BIGINT) AS pos_id, fen FROM fen")
def s7_read_text_files(spark, sf_dir):
    """Text positions written in order and read from their files again, numbered over all lines."""
    path = shared.new_path(spark, "text")
    s8_write_text_positions(spark, sf_dir).repartitionByRange("pos_id").sortWithinPartitions("pos_id").select("fen").write.text(path)
    return text_positions.read_lines(spark, [path]).select("pos_id", "fen")


# Weights as text, from per-feature means.
_WT = "wt AS (SELECT CAST(idx AS BIGINT) AS idx, ROUND(AVG(value),3) AS mg, ROUND(MAX(value)/8,3) AS eg FROM sp GROUP BY 1)"


def _means(spark, sf_dir):
    return X.sparse(spark, sf_dir).groupBy("idx").agg(F.round(F.avg("value"), 3).alias("mg"), F.round(F.max("value") / 8, 3).alias("eg"))


_CUT = lambda x: f"CAST(CAST(CASE WHEN {x}<0 THEN -floor(-({x})*100) ELSE floor(({x})*100) END AS BIGINT) AS VARCHAR)"


@query(f"WITH {SPARSE}, {_WT} SELECT idx, chr(9)||'Score_Pair('||printf('%.6f',mg)||','||printf('%.6f',eg)||'),' AS line FROM wt")
def s12_write_weights(spark, sf_dir):
    return weight_text.weight_lines(_means(spark, sf_dir))


@query(f"WITH {SPARSE}, {_WT} SELECT idx, chr(9)||'Score_Pair('||{_CUT('mg')}||','||{_CUT('eg')}||'),' AS line FROM wt")
def s13_write_weights_x100(spark, sf_dir):
    return weight_text.weight_lines_x100(_means(spark, sf_dir))


@query(f"WITH {SPARSE}, {_WT}, {_SC} SELECT wt.idx, chr(9)||'Score_Pair('||{_CUT('mg/scale')}||','||{_CUT('eg/scale')}||'),' AS line FROM wt JOIN sc USING (idx)")
def s14_write_weights_scaled(spark, sf_dir):
    return weight_text.weight_lines_x100(_means(spark, sf_dir), metrics.feature_scale(X.sparse(spark, sf_dir), 40))


@query(f"WITH {SPARSE}, {_WT}, n AS (SELECT *, row_number() OVER (ORDER BY idx)-1 AS k FROM wt) SELECT CAST(k AS BIGINT) AS idx, CAST(ROUND({_CUT('mg')}/100.0,2) AS DOUBLE) AS mg, CAST(ROUND({_CUT('eg')}/100.0,2) AS DOUBLE) AS eg FROM n".replace(f"ROUND({_CUT('mg')}/100.0", f"ROUND(CAST({_CUT('mg')} AS BIGINT)/100.0").replace(f"ROUND({_CUT('eg')}/100.0", f"ROUND(CAST({_CUT('eg')} AS BIGINT)/100.0"))
def s11_read_weights(spark, sf_dir):
    lines = weight_text.weight_lines_x100(_means(spark, sf_dir))
    whole = lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n\n").alias("value"))
    return weight_text.read_weights(whole).select("idx", F.round("mg", 2).alias("mg"), F.round("eg", 2).alias("eg"))


# Metrics.
@query(f"WITH {SPARSE}, {ROWS}, {_PRED} SELECT COUNT(*) AS n, CAST(SUM(CAST(residual*residual AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS sse, CAST(ROUND(AVG(residual*residual),2) AS DOUBLE) AS mse FROM res")
def m1_mse(spark, sf_dir):
    return metrics.mse(_predicted(spark, sf_dir), whole=True).select("n", "sse", F.round("mse", 2).alias("mse"))


@query(f"{BASE}, {_QUIET}, {_SCORES} SELECT COUNT(*) AS n, CAST(coalesce(SUM((q.score-t.score)*(q.score-t.score)),0) AS BIGINT) AS sse FROM quiet q JOIN stat t USING (pos_id)")
def m2_mse_quiet(spark, sf_dir):
    s = _scores(spark, sf_dir).select("pos_id", "in_check", F.col("score").alias("y_hat"))
    calm = _classified(spark, sf_dir).filter("NOT is_tactical").select("pos_id", F.col("score").alias("y"))
    return metrics.mse(calm.join(s.filter("NOT in_check"), "pos_id")).select("n", F.col("sse").cast("long").alias("sse"))


_H = lambda a, b: f"(-{a}*ln({b}+1e-6)-(1-{a})*ln(1-{b}+1e-6))"


@query(f"WITH {SPARSE}, {ROWS}, {_PRED}, c AS (SELECT {_P('y')} AS p, {_P('y_hat')} AS q, (result+1)/2.0 AS t, 0.3*(result+1)/2.0+0.7*{_P('y')} AS m FROM res) SELECT CAST(ROUND(AVG({_H('m','q')}),4) AS DOUBLE) AS loss, CAST(ROUND(AVG({_H('t','q')}),4) AS DOUBLE) AS loss_result, CAST(ROUND(AVG({_H('p','q')}),4) AS DOUBLE) AS loss_label, CAST(ROUND(AVG({_H('p','p')}),4) AS DOUBLE) AS h_label, CAST(ROUND(AVG({_H('t','t')}),4) AS DOUBLE) AS h_result, CAST(ROUND(AVG({_H('m','m')}),4) AS DOUBLE) AS h_mixed FROM c")
def m3_cross_entropy(spark, sf_dir):
    d = metrics.cross_entropy(_predicted(spark, sf_dir), 0.7)
    return d.select(*[F.round(c, 4).alias(c) for c in d.columns])


@query(f"{BASE}, {_MV}, {_CLS.format(m='men0')}, f AS (SELECT c.captured IS NULL AND c.prom NOT BETWEEN 1 AND 4 AS calm, NOT {Q._IN_CHECK} AS safe FROM cls c JOIN both_sides b ON b.pos_id=c.pos_id AND b.side=b.turn) SELECT COUNT(*) AS n, COUNT(*) FILTER (calm) AS n_calm, COUNT(*) FILTER (safe) AS n_safe, COUNT(*) FILTER (calm AND safe) AS n_quiet, CAST(ROUND(COUNT(*) FILTER (calm AND safe)/COUNT(*),4) AS DOUBLE) AS share FROM f")
def m4_quiet_profile(spark, sf_dir):
    d = _classified(spark, sf_dir).join(moves.in_check(_sides(spark, sf_dir)), "pos_id").selectExpr("NOT is_tactical AS calm", "NOT in_check AS safe")
    return d.agg(F.count("*").alias("n"), F.count_if("calm").alias("n_calm"), F.count_if("safe").alias("n_safe"), F.count_if(F.col("calm") & F.col("safe")).alias("n_quiet"), F.round(F.count_if(F.col("calm") & F.col("safe")) / F.count("*"), 4).alias("share"))


@query(f"WITH {SPARSE}, {_SC} SELECT idx, CAST(scale AS DOUBLE) AS scale FROM sc")
def m5_feature_scale(spark, sf_dir):
    return metrics.feature_scale(X.sparse(spark, sf_dir), 40)


@query(f"WITH {SPARSE}, {ROWS} SELECT CAST(idx AS BIGINT) AS idx, CAST(CASE WHEN COUNT(*)<(SELECT COUNT(*) FROM rws) THEN 0 ELSE MIN(abs(value)) END AS DOUBLE) AS low, CAST(MAX(abs(value)) AS DOUBLE) AS high FROM sp GROUP BY 1")
def m6_feature_range(spark, sf_dir):
    return metrics.feature_range(X.sparse(spark, sf_dir), X.rows(spark, sf_dir))


@query(f"WITH {SPARSE}, v AS (SELECT value AS v FROM sp UNION ALL SELECT value/4 FROM sp) SELECT CASE WHEN v<>floor(v) THEN 'fraction' WHEN abs(v)<=127 THEN 'int8' WHEN abs(v)<=32767 THEN 'int16' ELSE 'int32' END AS width, COUNT(*) AS n FROM v GROUP BY 1")
def m7_value_widths(spark, sf_dir):
    d = X.sparse(spark, sf_dir).selectExpr("CAST(value AS DOUBLE) AS value")
    return metrics.value_widths(d.union(d.selectExpr("value / 4 AS value")))


@query(f"{BASE}, {_SCORES}, rw AS (SELECT a.pos_id, SUM(CASE WHEN a.side=p.turn THEN 1 ELSE -1 END*round(v)*((a.idx*37)%101-50)) AS ms, SUM(CASE WHEN a.side=p.turn THEN 1 ELSE -1 END*round(v)*((a.idx*53)%97-48)) AS es FROM (SELECT pos_id, side, idx, floor(ROUND(SUM(v),4)+0.5) AS v FROM fam GROUP BY 1,2,3) a JOIN pos p USING (pos_id) GROUP BY 1) SELECT CAST(t.pos_id AS BIGINT) AS pos_id, t.score, CAST(floor((w.ms*(24-s.stage)+w.es*s.stage+24*coalesce(g.gain,0)+1200)/2400) AS BIGINT) AS rounded FROM stat t JOIN rw w USING (pos_id) JOIN stg s USING (pos_id) LEFT JOIN gain g USING (pos_id) WHERE t.score<>CAST(floor((w.ms*(24-s.stage)+w.es*s.stage+24*coalesce(g.gain,0)+1200)/2400) AS BIGINT)")
def m9_score_mismatch(spark, sf_dir):
    """Positions where rounding each feature value first moves the score."""
    return _scores(spark, sf_dir).select("pos_id", "score", "rounded").filter("score <> rounded")


# Training: one epoch of two mini-batches each; penalty 1e-5 and 1e-3.
def _epoch_sql(rate, penalty):
    """From ex (row, b, idx, v) and lab (row, b, y): the weights after batches 0 and 1."""
    return f"""n AS (SELECT b, COUNT(*) AS n FROM lab GROUP BY 1), w1 AS (SELECT idx, {rate}*SUM(y*v)/(SELECT n FROM n WHERE b=0) AS w FROM ex JOIN lab USING (row, b) WHERE b=0 GROUP BY 1),
yh AS (SELECT l.row, l.y-coalesce(SUM(w1.w*e.v),0) AS r FROM lab l LEFT JOIN ex e ON e.row=l.row LEFT JOIN w1 ON w1.idx=e.idx WHERE l.b=1 GROUP BY l.row, l.y),
g2 AS (SELECT idx, SUM(r*v)/(SELECT n FROM n WHERE b=1) AS g FROM ex JOIN yh USING (row) GROUP BY 1),
fin AS (SELECT coalesce(w1.idx, g2.idx) AS idx, coalesce(w1.w,0)+{rate}*(coalesce(g2.g,0)-{penalty}*coalesce(w1.w,0)) AS w FROM w1 FULL JOIN g2 ON w1.idx=g2.idx)"""


_L6 = f"""x0 AS (SELECT a.pos_id, a.idx, SUM(CASE WHEN a.side=p.turn THEN v ELSE -v END) AS value FROM ({Q.all_families()}) a JOIN pos p USING (pos_id) GROUP BY 1,2), stg AS (SELECT pos_id, {_STAGE} AS stage FROM men0 GROUP BY 1),
lab AS (SELECT pos_id AS row, pos_id//((SELECT MAX(pos_id) FROM pos)//2+1) AS b, CAST(score AS DOUBLE) AS y FROM quiet),
ex AS (SELECT l.row, l.b, x.idx, x.value*(24-s.stage)/24.0 AS v FROM x0 x JOIN lab l ON l.row=x.pos_id JOIN stg s ON s.pos_id=x.pos_id UNION ALL SELECT l.row, l.b, x.idx+759, x.value*s.stage/24.0 FROM x0 x JOIN lab l ON l.row=x.pos_id JOIN stg s ON s.pos_id=x.pos_id)"""


@query(f"{BASE}, {_QUIET}, {_L6}, {_epoch_sql('0.001', '1e-5')} SELECT CAST(0 AS INTEGER) AS epoch, CAST(k.range AS INTEGER) AS idx, CAST(ROUND(coalesce(fin.w,0),5) AS DOUBLE)+0.0 AS w FROM range(1518) k LEFT JOIN fin ON fin.idx=k.range")
def l6_fit_records(spark, sf_dir):
    """Quiet positions' features with their phases, 1518 weights."""
    positions, men = X.positions(spark, sf_dir), X.pieces(spark, sf_dir)
    rows = jobs.feature_vectors(positions, men, quiet_moves=True).select("row_ord", "mg", "eg", "y", "quiet", "indices", "vals")
    top = positions.agg(F.max("pos_id")).first()[0] or 0
    path = shared.new_path(spark, "training")
    rows = shared.settled(rows)
    w, _ = training.fit_records(rows, rows, path, 759, training.Plan(1, top // 2 + 1, 0.001, 1e-5), quiet_only=True)
    shared.release_path(spark, path)
    shared.release(rows)
    return _weight_rows(spark, w, 5)


def _weight_rows(spark, w, digits):
    return spark.createDataFrame([(e, i, float(round(x, digits)) + 0.0) for e, ws in enumerate(w) for i, x in enumerate(ws)], "epoch int, idx int, w double")


_L7 = f"""{_deal_sql(0)},
dealt AS (SELECT r.*, d.place%4 AS worker, row_number() OVER (PARTITION BY d.place%4 ORDER BY d.place, r.row_ord)-1 AS rn FROM rws r JOIN deal d ON d.chunk_id=r.row_ord//500),
lab AS (SELECT row_ord AS row, CAST(rn//CASE WHEN worker=3 THEN t.n-3*(t.n//4) ELSE t.n//4 END AS BIGINT) AS b, CAST(y AS DOUBLE) AS y, mg, eg FROM dealt, (SELECT COUNT(*) AS n FROM rws) t),
ex AS (SELECT l.row, l.b, sp.idx, sp.value/sc.scale*l.mg/24.0 AS v FROM sp JOIN sc USING (idx) JOIN lab l ON l.row=sp.row_id UNION ALL SELECT l.row, l.b, sp.idx+40, sp.value/sc.scale*l.eg/24.0 FROM sp JOIN sc USING (idx) JOIN lab l ON l.row=sp.row_id)"""


@query(f"WITH {SPARSE}, {ROWS}, {_SC}, {_L7}, {_epoch_sql('0.5', '1e-3')} SELECT CAST(0 AS INTEGER) AS epoch, CAST(k.range AS INTEGER) AS idx, CAST(ROUND(coalesce(fin.w,0)/(SELECT scale FROM sc WHERE sc.idx=k.range%40),5) AS DOUBLE)+0.0 AS w FROM range(80) k LEFT JOIN fin ON fin.idx=k.range")
def l7_fit_features(spark, sf_dir):
    """Scaled features, read by chunk in a new order and dealt to four workers; weights of both phases, for features as they are."""
    values, labels = X.sparse(spark, sf_dir), X.rows(spark, sf_dir)
    scales = _scales(values)
    v = training.vectors(values, "row_id").withColumnRenamed("row_id", "row_ord")
    empty = F.array().cast("array<int>"), F.array().cast("array<double>")
    rows = labels.join(v, "row_ord", "left").select("row_ord", "mg", "eg", F.col("y").cast("double").alias("y"), F.lit(True).alias("quiet"), *[F.coalesce(c, e).alias(c) for c, e in zip(("indices", "vals"), empty, strict=True)])
    rows, path = shared.settled(rows), shared.new_path(spark, "training")
    plan = training.Plan(1, rows.count(), 0.5, 1e-3)
    w, _ = training.fit_chunks(rows, rows, path, 40, plan, chunk=500, workers=4, seed=5, scales=scales)
    shared.release_path(spark, path)
    shared.release(rows)
    return _weight_rows(spark, w, 5)


def _fit_rows(spark, sf_dir):
    v = training.vectors(X.sparse(spark, sf_dir), "row_id").withColumnRenamed("row_id", "row_ord")
    return X.rows(spark, sf_dir).join(v, "row_ord").select("row_ord", "mg", "eg", F.col("y").cast("double").alias("y"), F.col("result").cast("double").alias("result"), F.lit(True).alias("quiet"), "indices", "vals")


def _steps_sql(rate, penalty, steps):
    """From ex (row, idx, v) and lab (row, y): the weights w1, w2, .. after steps over all rows."""
    out = ["w0 AS (SELECT DISTINCT idx, CAST(0 AS DOUBLE) AS w FROM ex)"]
    for k in range(1, steps + 1):
        out.append(f"r{k} AS (SELECT l.row, any_value(l.y)-SUM(w.w*e.v) AS r FROM lab l JOIN ex e ON e.row=l.row JOIN w{k - 1} w ON w.idx=e.idx GROUP BY 1), w{k} AS (SELECT w.idx, any_value(w.w)+{rate}*(SUM(r.r*e.v)/(SELECT COUNT(*) FROM lab)-{penalty}*any_value(w.w)) AS w FROM w{k - 1} w JOIN ex e ON e.idx=w.idx JOIN r{k} r ON r.row=e.row GROUP BY 1)")
    return ", ".join(out)


_FULL = "lab AS (SELECT row_ord AS row, CAST(y AS DOUBLE) AS y, mg, eg FROM rws WHERE row_ord IN (SELECT row_id FROM sp)), ex AS (SELECT l.row, sp.idx, CAST(sp.value AS DOUBLE)*l.mg/24 AS v FROM sp JOIN lab l ON l.row=sp.row_id UNION ALL SELECT l.row, sp.idx+40, CAST(sp.value AS DOUBLE)*l.eg/24 FROM sp JOIN lab l ON l.row=sp.row_id)"
_EPOCHS = " UNION ALL ".join(f"SELECT CAST({k - 1} AS INTEGER) AS epoch, CAST(idx AS BIGINT) AS idx, CAST(ROUND(w,5) AS DOUBLE)+0.0 AS w FROM w{k}" for k in (1, 2, 3))


@query(f"WITH {SPARSE}, {ROWS}, {_FULL}, {_steps_sql('0.0005', '1e-3', 3)} SELECT * FROM ({_EPOCHS})")
def s15_weight_snapshots(spark, sf_dir):
    """Snapshots of a fit that stopped after two epochs and went on to a third: each epoch once."""
    rows, path = shared.settled(_fit_rows(spark, sf_dir)), shared.new_path(spark, "training")
    for epochs in (2, 3):
        training.fit_records(rows, rows, path, 40, training.Plan(epochs, 1 << 40, 0.0005, 1e-3), resume=True)
    shared.release(rows)
    both = spark.read.parquet(f"{path}/weights").select("epoch", F.explode(F.array(F.struct("idx", F.col("mg").alias("w")), F.struct((F.col("idx") + 40).alias("idx"), F.col("eg").alias("w")))).alias("x"))
    return both.select("epoch", "x.idx", (F.round("x.w", 5) + F.lit(0.0)).alias("w"))


@query(None)
def l5_newton_fit(spark, sf_dir):
    """Weights of chances to win by Newton steps; tests hold them against NumPy."""
    rows = shared.settled(_fit_rows(spark, sf_dir))
    w, _ = training.fit_newton(training.expand(rows, 40), 80, 1e-3, 0.7)
    shared.release(rows)
    return _weight_rows(spark, [w], 6)


@query(f"WITH {SPARSE}, {_WT}, wr AS (SELECT idx, CAST({_CUT('mg')} AS BIGINT) AS w100 FROM wt) SELECT sp.row_id, CAST(ROUND(SUM(value*w100)/100.0,2) AS DOUBLE) AS y_hat FROM sp JOIN wr USING (idx) GROUP BY 1")
def l10_load_then_predict(spark, sf_dir):
    names = _means(spark, sf_dir).select("idx")
    w = s11_read_weights(spark, sf_dir)
    ranked = names.agg(F.sort_array(F.collect_list("idx")).alias("f")).select(F.posexplode("f").alias("idx", "feature"))
    named = shared.settled(w.join(ranked, "idx").select(F.col("feature").alias("idx"), F.col("mg").alias("w")))
    return linear.predict(X.sparse(spark, sf_dir), named).select("row_id", F.round("y_hat", 2).alias("y_hat"))


@query(f"WITH {LAB}, pr AS (SELECT row_id, any_value(y) AS y, SUM(value*mg*((idx*37)%101-50)+value*eg*((idx*53)%97-48)) AS y24 FROM lab GROUP BY 1) SELECT COUNT(*) AS n, CAST(SUM(CAST((24*y-y24)*(24*y-y24) AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS sse576 FROM pr")
def slice_phase_loss(spark, sf_dir):
    """Expansion by phase, prediction and squared loss, times 24 squared to stay whole."""
    d = _labelled(spark, sf_dir).join(F.broadcast(_weights(spark, 40).withColumnsRenamed({"mg": "w_mg", "eg": "w_eg"})), "idx")
    p = d.groupBy("row_id").agg(F.first("y").alias("y"), F.sum(F.col("value") * (F.col("mg") * F.col("w_mg") + F.col("eg") * F.col("w_eg"))).alias("y24"))
    e = (24 * F.col("y") - F.col("y24")).cast("decimal(18,0)")
    return p.agg(F.count("*").alias("n"), F.sum((e * e).cast("decimal(28,0)")).cast("decimal(38,0)").alias("sse576"))
