"""Golden positions, round trips and properties of the position engine."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.operators import features, geometry, metrics, moves, scoring, sparse, training
from rookery.plans import jobs
from rookery.sources import records, text_positions, weight_text

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
FLIPPED = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR b KQkq - 0 1"


def load(spark, *fens):
    return text_positions.read_text(spark.createDataFrame(list(enumerate(fens)), "pos_id long, fen string"))


def test_start_position(spark):
    p, m, bad = load(spark, START, FLIPPED)
    assert bad.count() == 0 and m.count() == 64
    s = geometry.sides(p, m)
    assert sorted(map(tuple, features.feature_rows(s).collect())) == [(0, 758, 1.0), (1, 758, 1.0)]
    assert {tuple(r) for r in features.phases(s).collect()} == {(0, 24, 0), (1, 24, 0)}
    pair = spark.createDataFrame([(758, 1361.0, 1467.0)], "idx int, mg double, eg double")
    assert {r.score for r in scoring.scores(s, pair).collect()} == {14}


def test_two_kings_are_a_draw(spark):
    p, m, _ = load(spark, "4k3/8/8/8/8/8/8/4K3 w - - 0 1")
    s = geometry.sides(p, m)
    w = spark.range(759).selectExpr("CAST(id AS INT) AS idx", "1000.0D AS mg", "1000.0D AS eg")
    assert scoring.scaled_scores(scoring.scores(s, w)).first().score == 0


def test_colour_flip_leaves_features(spark):
    fens = ["r1bqk2r/ppp2ppp/2n2n2/2bpp3/4P3/2PP1N2/PP3PPP/RNBQKB1R w KQkq - 0 1"]
    ranks, _, *rest = fens[0].split(" ")
    flipped = " ".join(["/".join(x.swapcase() for x in reversed(ranks.split("/"))), "b", *rest])
    p, m, _ = load(spark, fens[0], flipped)
    rows = features.feature_rows(geometry.sides(p, m)).collect()
    a, b = ({(r.idx, round(r.value, 6)) for r in rows if r.pos_id == k} for k in (0, 1))
    # Knight and king distances to the pawns' middle are by absolute rank; they mirror too.
    assert a == b and len(a) > 5


def test_bad_boards(spark):
    _, _, bad = load(spark, START.replace("8/8/8/8", "8/8/8/7"), START.replace("8/8/8/8", "8/8/8/9"), "x", None, START)
    assert bad.count() == 4


def test_records_round_trip(spark, tmp_path):
    p, m, _ = load(spark, START, "8/8/4k3/8/2p5/8/B2KP3/8 b - - 0 1")
    packed = {r.pos_id: bytes(r.sfen) for r in records.encode_positions(p, m).collect()}
    raw = np.zeros(7, dtype=records.RECORD)
    for k in range(7):
        raw[k]["sfen"] = np.frombuffer(packed[k % 2], dtype=np.uint8)
        raw[k]["score"], raw[k]["move"], raw[k]["result"] = -k, 12 | (28 << 6), k % 3 - 1
    one, two = tmp_path / "a.bin", tmp_path / "b.bin"
    one.write_bytes(raw[:3].tobytes() + b"xx")
    two.write_bytes(raw[3:].tobytes())
    got = records.read_records(spark, [str(one), str(two)], rows_per_split=2)
    rows = sorted(got.collect(), key=lambda r: r.row_ord)
    assert [r.row_ord for r in rows] == list(range(7)) and [r.score for r in rows] == [-k for k in range(7)]
    pos, men, bad = records.decode_positions(got)
    assert bad.count() == 0
    want = {(r.sq, r.side, r.pc) for r in m.filter("pos_id = 0").collect()}
    assert {(r.sq, r.side, r.pc) for r in men.filter("pos_id = 6").collect()} == want
    row = pos.filter("pos_id = 0").first()
    assert row.turn == 0 and row.ep == -1 and row.castling & ((1 << 56) | 1 | (1 << 7)) == (1 << 56) | 1 | (1 << 7)


def test_truncated_weights(spark):
    w = spark.createDataFrame([(0, -1.999, 2.999)], "idx long, mg double, eg double")
    line = weight_text.weight_lines_x100(w).first().line
    assert line == "\tScore_Pair(-199,299),"
    back = weight_text.read_weights(spark.createDataFrame([(line + "\n\n" + line,)], "value string")).orderBy("idx").collect()
    assert [(r.idx, r.mg, r.eg) for r in back] == [(0, -1.99, 2.99), (1, -1.99, 2.99)]


def test_gram_fit_is_gradient_descent(spark):
    r = np.random.default_rng(0)
    x, y = r.normal(size=(60, 4)), r.normal(size=60)
    d = spark.createDataFrame([(list(range(4)), [float(v) for v in a], float(b)) for a, b in zip(x, y)], "indices array<int>, vals array<double>, y double")
    w = np.zeros(4)
    for _ in range(5):
        w = w + 0.1 * (x.T @ (y - x @ w) / 60 - 0.01 * w)
    assert np.allclose(training.fit_gram(d, 4, 5, 0.1, 0.01)[-1], w)
    assert training.gram(d.limit(0), 4)[3] == 0


def vector_rows(spark, n=60, dim=4, seed=0):
    """Rows with phases, labels, results and half of them quiet, and the same as NumPy arrays."""
    r = np.random.default_rng(seed)
    x, y, eg = r.integers(-3, 4, (n, dim)).astype(float), r.normal(size=n) * 50, r.integers(0, 25, n)
    result, quiet = r.integers(-1, 2, n).astype(float), r.random(n) < 0.5
    d = spark.createDataFrame([(i, int(24 - eg[i]), int(eg[i]), float(y[i]), float(result[i]), bool(quiet[i]), list(range(dim)), [float(v) for v in x[i]]) for i in range(n)],
                              "row_ord long, mg int, eg int, y double, result double, quiet boolean, indices array<int>, vals array<double>")
    return d, np.hstack([x * (24 - eg)[:, None] / 24, x * eg[:, None] / 24]), y, result, quiet


@pytest.mark.parametrize("mix", [None, 0.7])
def test_fit_records(spark, tmp_path, mix):
    """Batches are cut before the filter; two epochs, losses and snapshots as NumPy has them."""
    d, x, y, result, quiet = vector_rows(spark)
    plan = training.Plan(2, 25, 0.01, 0.1, mix)
    got, losses = training.fit_records(d, d, str(tmp_path / "job"), 4, plan, quiet_only=True)
    chance = lambda v: 1 / (1 + 10 ** (-v / 206 / 4))
    w, want = np.zeros(8), []
    for _ in range(2):
        for at in range(0, 60, 25):
            k = np.flatnonzero(quiet[at : at + 25]) + at
            q = x[k] @ w
            r = y[k] - q if mix is None else mix * chance(y[k]) + (1 - mix) * (result[k] + 1) / 2 - chance(q)
            w = w + 0.01 * (x[k].T @ r / len(k) - 0.1 * w)
        want.append(w)
    assert np.allclose(got, want)
    e = (y - x @ want[-1]) ** 2
    assert losses[-1]["n"] == 60 and losses[-1]["mse"] == pytest.approx(e.mean()) and losses[-1]["mse_quiet"] == pytest.approx(e[quiet].mean())
    shots = spark.read.parquet(str(tmp_path / "job/weights")).filter("epoch = 1").orderBy("idx").collect()
    assert np.allclose([r.mg for r in shots] + [r.eg for r in shots], want[-1])
    assert training.losses(training.expand(d.limit(0), 4), w)["mse"] == 0.0
    assert not np.any(training.fit_records(d.limit(0), d, str(tmp_path / "none"), 4, plan)[0])


def test_sparse_algebra(spark):
    d = spark.sql("SELECT named_struct('indices', array(1, 3, 1), 'vals', array(2.0D, 5.0D, 7.0D)) AS v, array(1.0D, 2.0D, 3.0D, 4.0D) AS w, named_struct('indices', array(), 'vals', array()) AS none")
    v, w = F.col("v"), F.col("w")
    r = d.select(sparse.dot(v, w).alias("dot"), sparse.densify(v, 4).alias("dense"), sparse.add_sparse(w, v, 2.0).alias("plus"), sparse.add_dense(w, w).alias("twice"), sparse.multiply(w, 3.0).alias("times"), sparse.divide(w, 2.0).alias("half"), sparse.total(w).alias("total")).first()
    assert r.dot == 2 * 2 + 5 * 4 + 7 * 2 and r.dense == [0, 7, 0, 5] and r.plus == [1, 2 + 18, 3, 4 + 10]
    assert r.twice == [2, 4, 6, 8] and r.times == [3, 6, 9, 12] and r.half == [0.5, 1, 1.5, 2] and r.total == 10


def record_file(spark, path, fens, labels):
    p, m, _ = load(spark, *fens)
    packed = {r.pos_id: bytes(r.sfen) for r in records.encode_positions(p, m).collect()}
    raw = np.zeros(len(fens), dtype=records.RECORD)
    for k, (score, move) in enumerate(labels):
        raw[k]["sfen"], raw[k]["score"], raw[k]["move"] = np.frombuffer(packed[k], dtype=np.uint8), score, move
    path.write_bytes(raw.tobytes() + b"part")


QUIET_MOVE, CAPTURE = 28 | (12 << 6), 35 | (28 << 6)


def test_jobs_from_records(spark, tmp_path):
    """Record files to feature files and chunks, and the losses of a weight file on them."""
    fens = [START, FLIPPED, "4k3/8/8/3p4/4P3/8/8/4K3 w - - 0 1"]
    record_file(spark, tmp_path / "a.bin", fens[:2], [(10, QUIET_MOVE), (-20, QUIET_MOVE)])
    record_file(spark, tmp_path / "b.bin", fens[2:], [(30, CAPTURE)])
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.bin\n\n{tmp_path}/b.bin\n")
    paths = records.read_list(spark, str(tmp_path / "list.txt"))
    spark.dataSource.register(records.RecordSource)
    ranged = spark.read.format("labelled_records").option("files", str(tmp_path / "list.txt")).option("rows_per_split", "1").load()
    stored = records.read_stored_records(spark, paths)
    assert sorted(map(tuple, ranged.collect())) == sorted(map(tuple, stored.collect())) and stored.count() == 3
    v = jobs.feature_vectors(*jobs.record_tables(stored))
    rows = {r.row_ord: r for r in v.collect()}
    assert [rows[k].quiet for k in range(3)] == [True, True, False] and [rows[k].y for k in range(3)] == [10, -20, 30]
    assert rows[0].indices == [758] and rows[0].vals == [1.0] and (rows[0].mg, rows[0].eg) == (24, 0)
    jobs.write_features(v, str(tmp_path / "features"), quiet_only=True)
    assert spark.read.parquet(str(tmp_path / "features")).count() == 2
    manifest = {r.chunk_id: (r.name, r.n_rows, r.n_kept) for r in jobs.write_feature_chunks(v, str(tmp_path / "chunks.d"), 2, quiet_only=True)[0].collect()}
    assert manifest == {0: ("chunks-0.bin", 2, 2), 1: ("chunks-1.bin", 1, 0)}
    assert {(r.row_ord, r.chunk_id) for r in spark.read.parquet(str(tmp_path / "chunks.d")).collect()} == {(0, 0), (1, 0)}
    weights = spark.range(759).selectExpr("id AS idx", "CASE id WHEN 758 THEN 4.0D ELSE 0.0D END AS mg", "0.0D AS eg")
    weight_text.save_lines(weight_text.weight_lines_x100(weights), str(tmp_path / "weights"))
    got = jobs.validate_files(spark, paths, str(tmp_path / "weights"))
    assert got["n"] == 3 and got["n_quiet"] == 2 and got["sse_quiet"] == (10 - 4) ** 2 + (-20 - 4) ** 2
    assert jobs.validate(v, weights) == got


def test_positions_view_has_rights(spark):
    """Rights and en-passant squares go through packed and text form."""
    from rookery.sources import fixtures as X

    p, m = X.positions(spark, "/root/testdata/sf0.001"), X.pieces(spark, "/root/testdata/sf0.001")
    want = {r.pos_id: (r.turn, r.wk, r.bk, r.castling, r.ep) for r in p.collect()}
    assert len({x[3] for x in want.values()}) == 16 and any(x[4] >= 0 for x in want.values())
    for back in (records.decode_positions(records.encode_positions(p, m), "pos_id"), text_positions.read_text(text_positions.write_text(p, m))):
        got = {r.pos_id: (r.turn, r.wk, r.bk, r.castling, r.ep) for r in back[0].collect()}
        assert got and all(want[k] == v for k, v in got.items())


def test_empty_metrics(spark):
    e = spark.createDataFrame([], "y double, y_hat double, result int")
    assert tuple(metrics.mse(e).first()) == (0, 0.0, 0.0)
    assert set(metrics.cross_entropy(e, 0.5).first()) == {0.0}


def test_quiet_and_text(spark):
    d = spark.createDataFrame([(0, 12 | (28 << 6)), (1, (4 << 6) | 6 | (3 << 14)), (2, (48 << 6) | 56 | (1 << 14) | (3 << 12))], "pos_id long, move int")
    rows = moves.move_text(moves.decode_moves(d)).orderBy("pos_id").collect()
    assert [r.text for r in rows] == ["e4e2", "e1g1", "a7a8q"]


@pytest.mark.parametrize("name", ["x10_pinned", "f2_move_class", "f3_filter_quiet", "m1_mse", "s6_chunk_manifest", "a1_shuffle_rows", "a2_shuffle_windows", "a3_shuffle_chunks", "a4_assign_workers", "a5_mini_batches", "s1_read_records", "s2_read_file_list", "s4_write_features", "s7_read_text_files", "s15_weight_snapshots", "f7_sparse_algebra", "l6_fit_records", "l7_fit_features", "l9_endgame_scaled_score"])
def test_registered_sql(spark, name):
    import duckdb

    from rookery.plans.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf).toPandas()
    want = c.execute(SQL[name]).df()[list(got.columns)]
    norm = lambda d: sorted(tuple(str(float(x)) if not isinstance(x, (str, bool)) else str(x) for x in r) for r in d.itertuples(index=False))
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", ["f3_filter_quiet", "l6_fit_records", "m2_mse_quiet", "m4_quiet_profile", "s4_write_features", "s9_score_text_positions"])
def test_registered_sql_without_broadcasts(spark, name):
    """Joins of tables too large for a broadcast, in which the union of pieces meets its parts again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_registered_sql(spark, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["s1_read_records", "s2_read_file_list", "s10_relabel_files"])
def test_registered_sql_in_many_tasks(spark, name, monkeypatch):
    """Records written and read by many tasks that each take several files or ranges."""
    monkeypatch.setattr(records, "ROWS_PER_TASK", 20)
    monkeypatch.setattr(jobs, "POSITIONS_PER_TASK", 50)
    test_registered_sql(spark, name)


def test_parts_grow_with_the_tables(spark, monkeypatch):
    """A task has as many positions in a large table as in a small one, whatever the session's number of partitions."""
    from rookery.plans import queries
    from rookery.sources import fixtures as X

    sf = "/root/testdata/sf0.001"
    n = sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("orders", "lineitem"))
    for per_task in (n, n // 8):
        monkeypatch.setattr(X, "ROWS_PER_TASK", per_task)
        for name in ("x0_feature_rows", "x3_piece_square", "l8_static_score", "l9_endgame_scaled_score", "m9_score_mismatch", "s10_relabel_records", "s9_score_text_positions"):
            assert queries.QUERIES[name](spark, sf).rdd.getNumPartitions() == -(-n // per_task), name


def test_groupings_have_parts_by_table_size(spark, monkeypatch):
    """Orders and lineitem are grouped into positions and pieces in parts by the tables' rows too, not in those of the session."""
    from rookery.sources import fixtures as X

    monkeypatch.setattr(X, "ROWS_PER_TASK", 500)
    sf, old = "/root/testdata/sf0.001", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    n = sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("orders", "lineitem"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for d in (X.positions(spark, sf), X.pieces(spark, sf)):
            plan = d._jdf.queryExecution().executedPlan().toString()
            assert f", {-(-n // 2000)}), REPARTITION_BY_NUM" in plan and f", {-(-n // 500)}), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["s10_relabel_records", "x0_feature_rows", "x5_piece_mobility", "l9_endgame_scaled_score", "m9_score_mismatch", "l8_static_score", "x3_piece_square", "x18_passed_pawn", "x7_piece_captures", "x1_material", "x22_pawn_centre", "x13_defended_piece", "x21_weak_pawn", "x11_king_attack", "x14_minor_outpost", "x4_pawn_mobility", "x15_bad_bishop", "feature_vectors"])
def test_no_step_has_the_sessions_parts(spark, name, monkeypatch):
    """Every shuffle of a query on positions, and of the vectors that s4 and l6 store, has as many parts as the tables' rows ask for."""
    from rookery.plans.queries import QUERIES
    from rookery.sources import fixtures as X

    monkeypatch.setattr(X, "ROWS_PER_TASK", 300)
    sf, old = "/root/testdata/sf0.001", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    n = sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("orders", "lineitem"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = jobs.feature_vectors(X.positions(spark, sf), X.pieces(spark, sf)) if name == "feature_vectors" else QUERIES[name](spark, sf)
        plan = d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    parts = {int(x) for x in re.findall(r"hashpartitioning\(.*, (\d+)\)", plan)}
    assert parts == {-(-n // 1200), -(-n // 300)} and "ENSURE_REQUIREMENTS" not in plan


def test_streamed_steps(spark, tmp_path):
    from rookery.streaming.ingest import current_weights, learn_from_folder

    chunks = str(tmp_path / "chunks")
    d = spark.createDataFrame([(0, 2.0, 0, 1.0), (1, 4.0, 0, 2.0)], "row_ord long, y double, idx long, value double")
    d.write.mode("append").parquet(chunks)
    learn_from_folder(spark, chunks, str(tmp_path / "w"), str(tmp_path / "c"), 0.1, 0.0).awaitTermination(60)
    assert current_weights(spark, str(tmp_path / "w")).first().w == pytest.approx(0.5)


def test_imports_without_the_text_operators(tmp_path):
    """With the text operators and their pipeline gone, all else is registered."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "rookery", tmp_path / "rookery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=tmp_path, env={"PATH": "", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    names = said.stdout.split()
    assert said.returncode == 0 and "x0_feature_rows" in names and not any(n.startswith("op") or n == "pipeline" for n in names), said.stderr
