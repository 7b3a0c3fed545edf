"""Shuffles, record files, training stages and snapshots, against NumPy and plain Python."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_positions import CAPTURE, FLIPPED, QUIET_MOVE, START, load, record_file, vector_rows

from rookery.operators import batching, features, geometry, linear, metrics, scoring, sparse, training
from rookery.plans import jobs
from rookery.sources import records, shared, text_positions, weight_text


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 100, 1000, 4097, 65535])
def test_places_are_permutations(n):
    for seed in (0, 7):
        assert sorted(batching.places(n, seed)) == list(range(n))


def test_orders_are_unlike():
    """Seeds and epochs give unlike orders: displacements as of random ones, neighbours apart, no order a turn of another."""
    n = 5000
    orders = [batching.places(n, batching.epoch_seed(3, e)) for e in range(6)] + [batching.places(n, s) for s in (0, 1, 7)]
    for k, p in enumerate(orders):
        assert abs(np.abs(p - np.arange(n)).mean() / n - 1 / 3) < 0.02
        assert np.mean(np.abs(np.diff(p)) < 10) < 0.02 and abs(np.corrcoef(p[:-1], p[1:])[0, 1]) < 0.06
        for q in orders[:k]:
            assert abs(np.corrcoef(p, q)[0, 1]) < 0.06
            assert np.bincount((p - q) % n, minlength=n).max() < 12


def test_shuffles_in_spark(spark):
    d = spark.range(2500).withColumnRenamed("id", "row_ord")
    rows = batching.with_place(d, "row_ord", "2500", 9).orderBy("row_ord").collect()
    assert [r.place for r in rows] == list(batching.places(2500, 9))
    got = {r.row_ord: r.place for r in batching.shuffle_within_windows(d, 1000, 1).collect()}
    assert sorted(got.values()) == list(range(2500)) and all(a // 1000 == b // 1000 for a, b in got.items())
    assert np.mean([got[k] == got[k + 1000] - 1000 for k in range(1000)]) < 0.05, "windows have orders of their own"
    order = [r.row_ord for r in batching.shuffle_rows(d, 1).collect()]
    assert sorted(order) == list(range(2500)) and [r.row_ord for r in sorted(batching.with_place(d, "row_ord", "2500", 1).collect(), key=lambda r: r.place)] == order
    dealt = batching.deal_chunks(d.select(F.col("row_ord").alias("chunk_id")).filter("chunk_id < 10"), 0, 5, 3).collect()
    assert sorted(r.place for r in dealt) == list(range(10)) and all(r.worker == r.place % 3 for r in dealt)


@pytest.mark.parametrize(("size", "workers"), [(2, 3), (1, 4), (7, 3)])
def test_small_batches(spark, size, workers):
    got = batching.mini_batches(spark.range(20).withColumnRenamed("id", "row_ord"), size, workers).collect()
    assert len(got) == 20 and all(r.batch_id == r.row_ord // size and 0 <= r.worker < workers for r in got)
    d, _, _, _, _ = vector_rows(spark, 20)
    rows = batching.chunks(d, 5).withColumn("i", F.col("row_ord") % 5)
    dealt = training.worker_batches(rows, np.array([5, 5, 5, 5]), size, workers, 0, 1).collect()
    assert len(dealt) == 20 and len({(r.worker, r.batch_id) for r in dealt if size <= workers}) in (0, 20)


def test_a_worker_is_a_task(spark):
    d = batching.by_worker(spark.range(100).selectExpr("id", "id % 5 AS worker"), 5).withColumn("task", F.spark_partition_id())
    assert {(r.worker, r.task) for r in d.select("worker", "task").distinct().collect()} == {(k, k) for k in range(5)}


def test_an_epoch_is_one_job(spark):
    d, x, y, _, _ = vector_rows(spark)
    v = training.expand(d, 4).withColumn("batch_id", F.expr("row_ord DIV 7"))
    layout = training.spread(v, "row_ord % 3", 3, "row_ord")
    spark.sparkContext.setJobGroup("epoch", "one epoch")
    w = training.train_epoch(layout, np.zeros(8), training.Plan(1, 7, 0.001, 0.1), 9)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("epoch")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = np.zeros(8)
    for at in range(0, 60, 7):
        k = slice(at, at + 7)
        want = want + 0.001 * (x[k].T @ (y[k] - x[k] @ want) / len(y[k]) - 0.1 * want)
    assert np.allclose(w, want)
    layout.unpersist()


def test_shuffled_epochs(spark, tmp_path):
    d, x, y, _, _ = vector_rows(spark)
    got, _ = training.fit_records(d, d, str(tmp_path / "job"), 4, training.Plan(3, 16, 0.001, 0.1), seed=4, tasks=3)
    w = np.zeros(8)
    for epoch in range(3):
        batch = batching.places(60, batching.epoch_seed(4, epoch)) // 16
        for b in range(4):
            k = batch == b
            w = w + 0.001 * (x[k].T @ (y[k] - x[k] @ w) / k.sum() - 0.1 * w)
        assert np.allclose(got[epoch], w)


def test_fit_chunks(spark, tmp_path):
    """Every row is in one batch of an epoch, a share from each worker; weights come back for unscaled features."""
    d, x, y, _, _ = vector_rows(spark)
    rows, sizes = batching.chunks(d, 10).withColumn("i", F.col("row_ord") % 10), np.full(6, 10)
    dealt = training.worker_batches(rows, sizes, 20, 3, 1, 9).collect()
    assert sorted(r.row_ord for r in dealt) == list(range(60))
    first = [r.worker for r in dealt if r.batch_id == 0]
    assert [first.count(k) for k in range(3)] == [6, 6, 8]
    scales = [2.0, 1.0, 4.0, 3.0]
    s = np.tile(scales, 2)
    got, losses = training.fit_chunks(d, d, str(tmp_path / "job"), 4, training.Plan(2, 20, 0.01, 0.1), 10, 3, 9, scales, tasks=2)
    w = np.zeros(8)
    for epoch in range(2):
        batch = {r.row_ord: r.batch_id for r in training.worker_batches(rows, sizes, 20, 3, epoch, 9).collect()}
        at = np.array([batch[k] for k in range(60)])
        for b in range(at.max() + 1):
            k = at == b
            w = w + 0.01 * ((x[k] / s).T @ (y[k] - x[k] / s @ w) / k.sum() - 0.1 * w)
        assert np.allclose(got[epoch], w / s)
    assert losses[1]["mse"] == pytest.approx(((y - x @ got[1]) ** 2).mean())


@pytest.mark.parametrize("job", ["records", "chunks"])
def test_a_fit_holds_no_rows(spark, tmp_path, monkeypatch, job):
    """Executors keep no rows, for training or for losses, while a fit runs; afterwards the shared folder has none left."""
    d, _, _, _, _ = vector_rows(spark)
    held, folder = [], shared.shared_dir(spark).removeprefix("file:")
    count = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    files = lambda: {os.path.join(at, f) for at, _, names in os.walk(folder) for f in names}
    before, lay = count(), files()
    for step in ("train_epoch", "losses"):
        def watched(*a, f=getattr(training, step)):
            got = f(*a)
            held.append((count() - before, len(files() - lay) > 0))
            return got
        monkeypatch.setattr(training, step, watched)
    if job == "records":
        training.fit_records(d, d, str(tmp_path / "job"), 4, training.Plan(2, 25, 0.01, 0.1), quiet_only=True, seed=3, tasks=3)
    else:
        training.fit_chunks(d, d, str(tmp_path / "job"), 4, training.Plan(2, 20, 0.01, 0.1), 10, 3, 9, tasks=2)
    assert held == [(0, True)] * 4
    assert files() == lay


@pytest.mark.parametrize("batch", [25, 1000])
def test_a_stopped_fit_goes_on(spark, tmp_path, batch):
    """Epochs 0 and 1, then the rest: the weights of one run, each epoch once; an epoch whose marker is missing is done again."""
    d, _, _, _, _ = vector_rows(spark)
    plan = lambda epochs: training.Plan(epochs, batch, 0.001, 0.1)
    whole, _ = training.fit_records(d, d, str(tmp_path / "one"), 4, plan(4), seed=2)
    training.fit_records(d, d, str(tmp_path / "two"), 4, plan(3), seed=2)
    os.remove(tmp_path / "two/weights/epoch=2/_SUCCESS")
    rest, _ = training.fit_records(d, d, str(tmp_path / "two"), 4, plan(4), seed=2, resume=True)
    assert len(rest) == 2 and np.allclose(rest, whole[2:], rtol=1e-12)
    shots = spark.read.parquet(str(tmp_path / "two/weights")).groupBy("epoch").agg(F.count("*").alias("n")).collect()
    assert {(r.epoch, r.n) for r in shots} == {(k, 4) for k in range(4)}
    assert weight_text.last_snapshot(spark, str(tmp_path / "none")) is None


def test_newton_fit(spark):
    """Where the logistic gradient vanishes, in a dozen passes; plain steps come to the same weights."""
    d, x, y, result, _ = vector_rows(spark, 200, 3)
    chance = lambda v: 1 / (1 + 10 ** (-v / 206 / 4))
    w, loss = training.fit_newton(training.expand(d, 3), 6, 1e-4, 0.7)
    m = 0.7 * chance(y) + 0.3 * (result + 1) / 2
    assert len(loss) <= 12 and loss == sorted(loss, reverse=True)
    assert np.abs(x.T @ (m - chance(x @ w)) / 200 - 1e-4 * w).max() < 1e-9
    plain = np.zeros(6)
    for _ in range(60_000):
        plain = plain + 100 * (x.T @ (m - chance(x @ plain)) / 200 - 1e-4 * plain)
    assert np.allclose(w, plain, rtol=1e-3, atol=1e-3)
    assert not training.fit_newton(training.expand(d.limit(0), 3), 6, 1e-4, 0.7)[0].any()


def test_record_paths(spark, tmp_path, monkeypatch):
    """Relative, repeated and patterned paths, folders and list files lose no row and have one order; what isn't there is an error."""
    for k, name in enumerate(("b", "a", "c")):
        record_file(spark, tmp_path / f"{name}.bin", [START, FLIPPED], [(10 * k, QUIET_MOVE), (10 * k + 1, CAPTURE)])
    score = lambda d: [r.score for r in sorted(d.collect(), key=lambda r: r.row_ord)]
    b, a, c = ([0, 1], [10, 11], [20, 21])
    path = lambda x: f"{tmp_path}/{x}"
    for read in (records.read_records, records.read_stored_records):
        assert score(read(spark, [path("b.bin"), path("a.bin"), path("b.bin")])) == b + a + b
        assert score(read(spark, [f"file:{tmp_path}/c.bin", path("[ab].bin")])) == c + a + b
        assert score(read(spark, [path("")])) == a + b + c
        assert score(read(spark, [os.path.relpath(tmp_path / "a.bin")])) == a
        with pytest.raises(FileNotFoundError):
            read(spark, [path("a.bin"), path("missing.bin")])
        assert read(spark, []).count() == 0
    plain = spark.read.format("labelled_records").option("paths", f"{tmp_path}/b.bin\n{os.path.relpath(tmp_path / 'a.bin')}").load()
    assert score(plain) == b + a


def test_large_record_file(tmp_path):
    """A sparse file of 5 GB is split; the last records are read from where they are."""
    big = tmp_path / "big.bin"
    tail = np.zeros(3, dtype=records.RECORD)
    tail["score"] = [1, 2, 3]
    n = 5_000_000_000 // 40
    with open(big, "wb") as f:
        f.truncate((n - 3) * 40)
        f.seek(0, 2)
        f.write(tail.tobytes() + b"part")
    reader = records.RecordReader({"paths": str(big)})
    parts = reader.partitions()
    assert len(parts) == n // 1_000_000 and parts[-1].last == n
    got = list(reader.read(records.Range(0, parts[-1].uri, n - 5, n, 7)))
    assert [r for b in got for r in b.column("score").to_pylist()] == [0, 0, 1, 2, 3] and got[0].column("row_ord").to_pylist() == list(range(n + 2, n + 7))


def test_written_records(spark, tmp_path):
    """Rewritten files are the old ones but for the label; a failed task leaves nothing and the old files stay."""
    fens = [START, FLIPPED, "4k3/8/8/3p4/4P3/8/8/4K3 w - - 0 1"] * 3
    record_file(spark, tmp_path / "a.bin", fens[:4], [(k, QUIET_MOVE) for k in range(4)])
    record_file(spark, tmp_path / "b.bin", fens[4:], [(k, CAPTURE) for k in range(5)])
    old = b"".join((tmp_path / x).read_bytes()[: n * 40] for x, n in (("a.bin", 4), ("b.bin", 5)))
    paths = [str(tmp_path / "a.bin"), str(tmp_path / "b.bin")]
    files = lambda: sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith("crc"))
    whole = lambda: b"".join((tmp_path / "out" / x).read_bytes() for x in files() if x.endswith(".bin"))
    records.write_records(records.read_records(spark, paths), str(tmp_path / "out"), 4)
    assert whole() == old and files() == ["_SUCCESS", "part-000000.bin", "part-000001.bin", "part-000002.bin"]
    weights = spark.range(759).selectExpr("id AS idx", "CAST(id * 37 % 101 AS DOUBLE) AS mg", "CAST(id * 53 % 97 AS DOUBLE) AS eg")
    jobs.relabel_files(spark, paths, str(tmp_path / "out"), weights, 1000)
    assert files() == ["_SUCCESS", "part-000000.bin"]
    p, m, _ = load(spark, *fens)
    want = {r.pos_id: r.score for r in scoring.scores(geometry.sides(p, m), weights).collect()}
    new, before = np.frombuffer(whole(), records.RECORD), np.frombuffer(old, records.RECORD)
    assert list(new["score"]) == [want[k] for k in range(9)]
    assert all((new[c] == before[c]).all() for c in ("sfen", "move", "ply", "result", "pad"))
    bad = records.read_records(spark, paths).withColumn("sfen", F.when(F.col("row_ord") != 7, F.col("sfen")))
    with pytest.raises(Exception, match="without a position"):
        records.write_records(bad, str(tmp_path / "out"), 2)
    assert files() == ["_SUCCESS", "part-000000.bin"] and (np.frombuffer(whole(), records.RECORD) == new).all()


def test_lines_of_text_files(spark, tmp_path):
    """Lines are numbered over files in list order and in splits; bad rows name file and line."""
    names = {"b.fen": [START] * 400, "a.fen": ["bad", FLIPPED, ""]}
    for name, lines in names.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = sorted(text_positions.read_lines(spark, [f"{tmp_path}/b.fen", f"{tmp_path}/a.fen", f"{tmp_path}/b.fen"]).collect())
        _, _, bad = text_positions.read_files(spark, [f"{tmp_path}/b.fen", f"{tmp_path}/a.fen"])
        where = {(os.path.basename(r.path), r.line, r.pos_id) for r in bad.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.pos_id for r in got] == list(range(803)) and [r.fen for r in got] == names["b.fen"] + names["a.fen"] + names["b.fen"]
    assert [r.line for r in got] == [*range(1, 401), 1, 2, 3, *range(1, 401)]
    assert where == {("a.fen", 1, 400), ("a.fen", 3, 402)}


def test_sparse_algebra_is_linear(spark):
    """1518 places and 60 entries a row: ten thousand rows in seconds; as NumPy has them, with repeated and foreign indices."""
    d = spark.range(10_000).selectExpr("named_struct('indices', transform(sequence(0, 59), i -> CAST((id * 31 + i * 26) % 1530 AS INT)), 'vals', transform(sequence(0, 59), i -> CAST(i + 1 AS DOUBLE))) AS v")
    t = time.perf_counter()
    total = d.select(sparse.total(sparse.add_sparse(sparse.densify(F.col("v"), 1518), F.col("v"), 2.0)).alias("t")).agg(F.sum("t")).first()[0]
    assert time.perf_counter() - t < 30
    want = sum(3.0 * (i + 1) for k in range(10_000) for i in range(60) if (k * 31 + i * 26) % 1530 < 1518)
    assert total == pytest.approx(want)
    rows = [([3, 1, 3, 9, -1, 1], [1.0, 2.0, 4.0, 5.0, 6.0, 8.0]), ([], []), ([0], [7.0])]
    got = spark.createDataFrame([({"indices": i, "vals": x},) for i, x in rows], "v struct<indices:array<int>,vals:array<double>>").select(sparse.densify(F.col("v"), 5).alias("d"), sparse.add_sparse(F.array(*[F.lit(1.0)] * 4), F.col("v"), 2.0).alias("s")).collect()
    assert [r.d for r in got] == [[0, 8, 0, 4, 0], [0] * 5, [7, 0, 0, 0, 0]]
    assert [r.s for r in got] == [[1, 21, 1, 11], [1] * 4, [15, 1, 1, 1]]


def test_counts_of_one_write(spark, tmp_path):
    """What is counted while features are written is what the queries count in another scan."""
    d, x, _, _, quiet = vector_rows(spark)
    d = d.withColumn("vals", F.transform("vals", lambda v, i: F.when(i == 0, v / 4).when(i == 1, v * 100).when(i == 2, v * 40000).otherwise(v)))
    got = jobs.write_features(d, str(tmp_path / "f"), quiet_only=True)
    stored = d.filter("quiet").select(F.explode("vals").alias("value"))
    widths = {r.width: r.n for r in metrics.value_widths(stored).collect()}
    assert {w: n for w, n in got.items() if n and w in metrics.WIDTHS} == widths and (got["seen"], got["kept"]) == (60, quiet.sum())
    assert sum(widths.values()) == 4 * quiet.sum() == 4 * spark.read.parquet(str(tmp_path / "f")).count()
    for rows in (d, d.filter("row_ord % 9 <> 4")):
        manifest, counts = jobs.write_feature_chunks(rows, str(tmp_path / "c.d"), 7, quiet_only=True)
        want = batching.chunk_manifest(rows, 7, "c.d", F.col("quiet")).select("chunk_id", "name", "n_rows", "n_kept")
        assert sorted(manifest.collect()) == sorted(want.collect()) and counts["kept"] == rows.filter("quiet").count()


def test_many_weights_are_joined(spark, monkeypatch):
    """Beyond the bound of a broadcast, weights come by shuffle, with the same sums."""
    d = spark.range(300).selectExpr("id % 30 AS row_id", "id AS idx", "1.0D AS value")
    w = spark.range(300).selectExpr("id AS idx", "CAST(id AS DOUBLE) AS w")
    few = sorted(linear.predict(d, w).collect())
    monkeypatch.setattr(linear, "small", lambda x: w if x.limit(11).count() > 10 else F.broadcast(x))
    assert sorted(linear.predict(d, w).collect()) == few
    monkeypatch.undo()
    assert linear.small(w, 10) is w


def test_feature_count():
    assert features.N_FEATURES == 759


def test_small_record_files_share_tasks(spark, tmp_path, monkeypatch):
    """Many small files and ranges take few tasks: the files and rows stay what they are."""
    record_file(spark, tmp_path / "a.bin", [START, FLIPPED] * 30, [(k, QUIET_MOVE) for k in range(60)])
    rows = records.read_records(spark, [str(tmp_path / "a.bin")], rows_per_split=2)
    assert rows.rdd.getNumPartitions() == 1
    records.write_records(rows, str(tmp_path / "out"), 4)
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.endswith(".bin"))
    assert names == [f"part-{k:06d}.bin" for k in range(15)]
    assert b"".join((tmp_path / "out" / n).read_bytes() for n in names) == (tmp_path / "a.bin").read_bytes()[: 60 * 40]
    monkeypatch.setattr(records, "ROWS_PER_TASK", 8)
    back = records.read_records(spark, [str(tmp_path / "out")], rows_per_split=3)
    assert back.rdd.getNumPartitions() == 8
    assert [(r.file_idx, r.row_ord, r.score) for r in sorted(back.collect(), key=lambda r: r.row_ord)] == [(k // 4, k, k) for k in range(60)]
