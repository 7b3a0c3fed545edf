"""The jobs users come for: feature generation, training and validation from positions, records or feature files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators import batching, features, geometry, metrics, moves, scoring, training
from rookery.sources import records, shared, weight_text

#: Positions of records that one task takes.
POSITIONS_PER_TASK = 4_000


def record_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """positions (pos_id is row_ord; score, move and game_result) and pieces of labelled records that decode; others are left out."""
    positions, pieces, _ = records.decode_positions(rows)
    labels = rows.select(F.col("row_ord").alias("pos_id"), F.col("score").cast("long").alias("score"), "move", F.col("game_result").cast("long").alias("game_result"))
    return positions.join(labels, "pos_id"), pieces


def feature_vectors(positions: DataFrame, pieces: DataFrame, quiet_moves: bool = True) -> DataFrame:
    """row_ord, mg, eg, y (score), result, quiet, indices and vals of every position: side to move less the other side.

    quiet: the best move is no capture or promotion and the side to move isn't in check; true for all without quiet_moves.
    A row for each position, to be stored; all steps share the partitioning by pos_id.
    """
    s = geometry.sides(positions, pieces)
    d = features.signed_values(s).groupBy("pos_id").agg(
        F.sort_array(F.collect_list(F.when((F.col("idx") < features.N_FEATURES) & (F.col("value") != 0), F.struct("idx", "value")))).alias("v"),
        F.max("checked").alias("checked"), F.expr(f"greatest(24 - sum(CASE WHEN idx = {features.FORCE} THEN force ELSE 0 END), 0)").alias("eg"))
    labels = moves.classify_moves(moves.decode_moves(positions), pieces).select("pos_id", "score", "game_result", "is_tactical") if quiet_moves else positions.select("pos_id", "score", "game_result", F.lit(False).alias("is_tactical"))
    calm: Column = ~F.col("is_tactical") & ~F.col("checked") if quiet_moves else F.lit(True)
    d = d.join(labels, "pos_id")
    return d.select(F.col("pos_id").alias("row_ord"), (24 - F.col("eg")).cast("int").alias("mg"), F.col("eg").cast("int").alias("eg"), F.col("score").cast("double").alias("y"), F.col("game_result").cast("double").alias("result"),
                    calm.alias("quiet"), F.transform("v", lambda x: x["idx"]).alias("indices"), F.transform("v", lambda x: x["value"]).alias("vals"))


def write_features(vectors: DataFrame, path: str, quiet_only: bool = False) -> dict[str, int]:
    """Feature rows as Parquet in one folder; rows seen and kept, and stored values by width, counted in the one pass."""
    d, seen = metrics.observed(vectors, F.col("quiet") if quiet_only else F.lit(True))
    d.write.mode("overwrite").parquet(path)
    return {k: v or 0 for k, v in seen.get.items() if k != "last"}


def write_feature_chunks(vectors: DataFrame, path: str, size: int, quiet_only: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Feature rows as Parquet by chunk, the manifest (chunk_id, name, n_rows, n_kept) and the counts of write_features().

    Chunks count rows before the filter. Vectors are made once: kept rows are counted by chunk from the files, those seen follow
    from the ordinals if none is missing; else ordinals are counted again.
    """
    d, seen = metrics.observed(vectors, F.col("quiet") if quiet_only else F.lit(True))
    spark = vectors.sparkSession
    records.write_feature_chunks(d, path, size)
    counts = {k: v or 0 for k, v in seen.get.items()}
    total = counts["last"] + 1 if counts["seen"] else 0
    kept = spark.read.parquet(path).groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.count("*").alias("n_kept")) if counts["kept"] else spark.createDataFrame([], "chunk_id long, n_kept long")
    if counts["seen"] == total:
        every = spark.range(-(-total // size)).select(F.col("id").alias("chunk_id"), F.expr(f"least({size}, {total} - id * {size})").alias("n_rows"))
    else:
        every = batching.chunks(vectors, size).groupBy("chunk_id").agg(F.count("*").alias("n_rows"))
    name = batching.chunk_name(path.rstrip("/").rpartition("/")[2]).alias("name")
    manifest = every.join(kept, "chunk_id", "left").select("chunk_id", name, "n_rows", F.coalesce("n_kept", F.lit(0).cast("long")).alias("n_kept"))
    return manifest, {k: v for k, v in counts.items() if k != "last"}


def validate(vectors: DataFrame, weights: DataFrame) -> dict[str, float]:
    """Losses over all rows and over quiet rows of weights (idx, mg, eg), as from a weight file by read_weights()."""
    w = training.weight_array(weights, features.N_FEATURES)
    return training.losses(training.expand(vectors, features.N_FEATURES), w, "quiet")


def relabel_files(spark: SparkSession, record_paths: list[str], target: str, weights: DataFrame, rows_per_file: int = 1_000_000) -> None:
    """Record files with the static score of weights (idx, mg, eg) as label, all else as it was, in the folder target.

    The files of target by name are the records of record_paths in order. Records that don't decode keep their label; scores are cut to 16 bits.
    """
    rows = records.read_records(spark, record_paths)
    total = batching.ordinals(rows)
    positions, pieces, _ = records.decode_positions(rows)
    positions, pieces = (shared.dealt(d, "pos_id", total, POSITIONS_PER_TASK) for d in (positions, pieces))
    scores = scoring.scores(geometry.sides(positions, pieces), weights).select(F.col("pos_id").alias("row_ord"), F.expr("CAST(greatest(least(score, 32767), -32768) AS SHORT)").alias("label"))
    d = rows.join(scores, "row_ord", "left").withColumn("score", F.coalesce("label", "score"))
    records.write_records(d.select("row_ord", "sfen", "score", "move", "game_ply", "game_result"), target, rows_per_file, total)


def validate_files(spark: SparkSession, record_paths: list[str], weight_path: str) -> dict[str, float]:
    """Losses of a weight file on record files."""
    rows = feature_vectors(*record_tables(records.read_records(spark, record_paths)))
    return validate(rows, weight_text.read_weights(spark.read.text(weight_path, wholetext=True)))
