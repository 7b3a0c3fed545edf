"""Positions as text lines, read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.functions import board as B
from rookery.sources import stores

LETTERS = "PNBRQK"


def write_text(positions: DataFrame, pieces: DataFrame) -> DataFrame:
    """pos_id and fen: ranks from the eighth, files from A, runs of empty squares as digits; castling rights, the square
    of an en-passant capture if positions have an ep that isn't -1, and '0 1'."""
    letter = F.expr(f"CASE WHEN side = 0 THEN substring('{LETTERS}', pc + 1, 1) ELSE lower(substring('{LETTERS}', pc + 1, 1)) END")
    men = pieces.groupBy("pos_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sq"), letter.alias("l")))).alias("at"))
    ranks = "array_join(transform(sequence(7, 0, -1), r -> array_join(transform(sequence(0, 7), f -> coalesce(at[f * 8 + r], '1')), '')), '/')"
    d = positions.join(men, "pos_id").withColumn("board", F.expr(ranks))
    for n in range(8, 1, -1):
        d = d.withColumn("board", F.expr(f"replace(board, '{'1' * n}', '{n}')"))
    rights = "concat_ws('', " + ", ".join(f"CASE WHEN {B.has('castling', str(sq))} THEN '{x}' END" for sq, x in ((56, "K"), (0, "Q"), (63, "k"), (7, "q"))) + ")"
    ep = "CASE WHEN ep >= 0 THEN concat(substring('abcdefgh', shiftright(ep, 3) + 1, 1), CAST((ep & 7) + 1 AS STRING)) ELSE '-' END" if "ep" in positions.columns else "'-'"
    return d.select("pos_id", F.expr(f"concat(board, ' ', CASE WHEN turn = 0 THEN 'w' ELSE 'b' END, ' ', CASE WHEN castling = 0 THEN '-' ELSE {rights} END, ' ', {ep}, ' 0 1')").alias("fen"))


def read_text(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (pos_id, fen): positions (turn, castling, ep, wk, bk), pieces and bad_records.

    A board must have eight ranks of eight squares in known letters and one king a side; ep is -1 or its square.
    """
    d = lines.withColumn("p", F.split("fen", " "))
    full = F.col("p")[0]
    for n in range(1, 9):
        full = F.replace(full, F.lit(str(n)), F.lit("." * n))
    d = d.withColumn("ranks", F.split(full, "/")).withColumn("cells", F.array_join("ranks", ""))
    good = F.coalesce((F.size("ranks") == 8) & F.forall("ranks", lambda r: F.length(r) == 8) & F.col("cells").rlike(r"^[PNBRQKpnbrqk.]{64}$") & F.col("p")[1].isin("w", "b") & F.col("cells").rlike("^[^K]*K[^K]*$") & F.col("cells").rlike("^[^k]*k[^k]*$"), F.lit(False))
    d = d.withColumn("good", good)
    square = "(i % 8) * 8 + 7 - i DIV 8"
    where = lambda k: f"CAST((locate('{k}', cells) - 1) % 8 * 8 + 7 - (locate('{k}', cells) - 1) DIV 8 AS INT)"
    rights = " + ".join(f"CASE WHEN contains(p[2], '{x}') THEN {B._mask([sq])}L ELSE 0L END" for sq, x in ((56, "K"), (0, "Q"), (63, "k"), (7, "q")))
    ep = "CASE WHEN p[3] RLIKE '^[a-h][1-8]$' THEN (ascii(p[3]) - 97) * 8 + CAST(substring(p[3], 2, 1) AS INT) - 1 ELSE -1 END"
    ok = d.filter("good")
    positions = ok.selectExpr("pos_id", "CASE WHEN p[1] = 'w' THEN 0 ELSE 1 END AS turn", f"{rights} AS castling", f"CAST({ep} AS INT) AS ep", f"{where('K')} AS wk", f"{where('k')} AS bk")
    cells = ok.select("pos_id", F.posexplode(F.split("cells", "")).alias("i", "c")).filter("c <> '.' AND c <> ''")
    pieces = cells.selectExpr("pos_id", f"CAST({square} AS INT) AS sq", "CASE WHEN c = upper(c) THEN 0 ELSE 1 END AS side", f"locate(upper(c), '{LETTERS}') - 1 AS pc")
    return positions, pieces, d.filter("NOT good").select("pos_id", "fen")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """pos_id, path, line and fen of the lines of text files in list order: pos_id counts all lines from 0, line those of a file from 1.

    Files are read in splits. A line's place is its place in its split, which the scan has in order, and the lines of the splits before,
    a count for each; so nothing is sorted but the table of splits. A path that is listed twice is read twice.
    """
    files = stores.find(spark, paths)
    if not files:
        return spark.createDataFrame([], "pos_id long, path string, line long, fen string")
    d = spark.read.text(sorted({f.path for f in files})).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("m"))
    splits = d.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    listed = spark.createDataFrame([(k, f.path) for k, f in enumerate(files)], "file_idx int, path string")
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("file_idx", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = splits.join(listed, "path").select("path", "start", "first", before(F.lit(0)).alias("ahead"), before("file_idx").alias("above"))
    i = F.col("m") - F.col("first")
    return d.join(F.broadcast(places), ["path", "start"]).select((F.col("ahead") + i).alias("pos_id"), "path", (F.col("above") + i + 1).alias("line"), F.col("value").alias("fen"))


def read_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """read_text() of the lines of files in list order; bad_records also have the path and the line."""
    lines = read_lines(spark, paths)
    positions, pieces, bad = read_text(lines.select("pos_id", "fen"))
    return positions, pieces, lines.join(bad.select("pos_id"), "pos_id", "left_semi").select("pos_id", "path", "line", "fen")
