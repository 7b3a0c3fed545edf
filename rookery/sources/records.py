"""Fixed 40-byte labelled records: read in byte ranges, decoded a batch at a time, and written."""

from __future__ import annotations

import glob
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as compute
from pyarrow import fs as fs_types
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from rookery.sources import stores

#: Fixed values of the format: record layout, prefix codes by piece (value, with the colour bit after it).
RECORD = np.dtype([("sfen", "u1", 32), ("score", "<i2"), ("move", "<u2"), ("ply", "<u2"), ("result", "i1"), ("pad", "u1")])
CODES = {0: 1, 1: 3, 2: 5, 3: 7, 4: 9}
ROOKS = (56, 0, 63, 7)
SCHEMA = "file_idx int, row_ord long, sfen binary, score short, move int, game_ply int, game_result byte"


#: Rows of small files or ranges that one task reads or writes at least, if there are as many.
ROWS_PER_TASK = 50_000


class Range(InputPartition):
    def __init__(self, file_idx: int, uri: str, first: int, last: int, before: int):
        self.file_idx, self.uri, self.first, self.last, self.before = file_idx, uri, first, last, before


class Ranges(InputPartition):
    """Ranges that one task reads, one after the other."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def _batch(file_idx: int, ords: np.ndarray, raw: bytes) -> pa.RecordBatch:
    r = np.frombuffer(raw, dtype=RECORD)
    n = len(r)
    sfen = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), n, [None, pa.py_buffer(np.ascontiguousarray(r["sfen"]).tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, file_idx, np.int32)), pa.array(ords), sfen, pa.array(r["score"]), pa.array(r["move"].astype(np.int32)), pa.array(r["ply"].astype(np.int32)), pa.array(r["result"])], ["file_idx", "row_ord", "sfen", "score", "move", "game_ply", "game_result"])


class RecordSource(DataSource):
    """spark.read.format("labelled_records").option("paths", "a\\nb").load(), and .write with the same columns but file_idx.

    Files are one sequence in list order; a part record at a file's end is left out. Options to read: paths (one a
    line), or files, a list file with one path a line; rows_per_split; rows_per_task, up to which a task takes several ranges. Paths are local, mounted, or URIs that pyarrow opens; read_records()
    finds those of Spark's stores. To write: target, a folder. A task writes one file, of rows in its order, or one for each value of a column file_idx.
    """

    @classmethod
    def name(cls) -> str:
        return "labelled_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(self.options["target"], overwrite)


class RecordReader(DataSourceReader):
    def __init__(self, options):
        if "found" in options:
            self.files = [tuple(x) for x in json.loads(options["found"])]
        else:
            paths = options.get("paths", "").split("\n")
            if "files" in options:
                fs, path = stores.opened(options["files"])
                with fs.open_input_file(path) as f:
                    paths += f.read().decode().split("\n")
            self.files = [x for p in paths if p.strip() for x in self._here(p.strip())]
        self.split = int(options.get("rows_per_split", "1000000"))
        self.task = int(options.get("rows_per_task", "0"))

    @staticmethod
    def _here(path: str) -> list[tuple[str, int]]:
        """A path's file and size, or those that a local pattern names."""
        if not re.match(r"\w[\w+.-]+:", path):
            found = sorted(glob.glob(os.path.abspath(path))) or [path]
            return [(os.path.abspath(p), os.path.getsize(p)) for p in found]
        fs, p = stores.opened(path)
        info = fs.get_file_info(p)
        if not info.is_file:
            raise FileNotFoundError(path)
        return [(path, info.size)]

    def partitions(self):
        out, before = [], 0
        for k, (uri, size) in enumerate(self.files):
            n = size // RECORD.itemsize
            out += [Range(k, uri, a, min(n, a + self.split), before) for a in range(0, n, self.split)]
            before += n
        return self._packed(out) or [Range(0, "", 0, 0, 0)]

    def _packed(self, ranges: list[Range]) -> list[InputPartition]:
        """Neighbouring ranges by task: none is cut, and several come to rows_per_task at most."""
        tasks, rows = [], 0
        for r in ranges:
            if tasks and rows + r.last - r.first <= self.task:
                tasks[-1].append(r)
                rows += r.last - r.first
            else:
                tasks.append([r])
                rows = r.last - r.first
        return [t[0] if len(t) == 1 else Ranges(t) for t in tasks]

    def read(self, part: Range | Ranges) -> Iterator[pa.RecordBatch]:
        if isinstance(part, Ranges):
            for r in part.ranges:
                yield from self.read(r)
            return
        if part.first >= part.last:
            return
        fs, path = stores.opened(part.uri)
        with fs.open_input_file(path) as f:
            f.seek(part.first * RECORD.itemsize)
            for at in range(part.first, part.last, 50_000):
                n = min(50_000, part.last - at)
                raw = f.read(n * RECORD.itemsize)
                if len(raw) < n * RECORD.itemsize:
                    raise EOFError(f"{part.uri} ends before record {at + n}")
                yield _batch(part.file_idx, part.before + np.arange(at, at + n), raw)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its temporary files and the names that they get."""

    files: list[tuple[str, str]]


class RecordWriter(DataSourceArrowWriter):
    """Tasks write to a folder of their own; files get their names when all tasks are done, and the marker _SUCCESS comes last. A task that failed, or ran twice, leaves nothing."""

    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite, self.run = target, overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, folder = stores.opened(self.target)
        files: list[tuple[str, str]] = []
        fs.create_dir(f"{folder}/{self.run}", recursive=True)
        f = None
        try:
            for b in batches:
                for k, rows in _by_file(b, task.partitionId()):
                    name = f"part-{k:06d}.bin"
                    if not files or files[-1][1] != name:
                        if f:
                            f.close()
                        files.append((f"{folder}/{self.run}/{task.taskAttemptId()}-{name}", name))
                        f = fs.open_output_stream(files[-1][0])
                    f.write(_raw(rows))
        finally:
            if f:
                f.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = stores.opened(self.target)
        if self.overwrite:
            for old in fs.get_file_info(fs_types.FileSelector(folder)):
                if re.fullmatch(r"(part-.*\.bin|_SUCCESS)", old.base_name):
                    fs.delete_file(old.path)
        for m in messages:
            for temporary, name in m.files if m else ():
                fs.move(temporary, f"{folder}/{name}" if self.overwrite else f"{folder}/{self.run[11:]}-{name}")
        fs.delete_dir(f"{folder}/{self.run}")
        with fs.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = stores.opened(self.target)
        if fs.get_file_info(f"{folder}/{self.run}").type != fs_types.FileType.NotFound:
            fs.delete_dir(f"{folder}/{self.run}")


def _by_file(b: pa.RecordBatch, default: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one file_idx, or all rows for default without that column."""
    if "file_idx" not in b.schema.names:
        if b.num_rows:
            yield default, b
        return
    idx = np.asarray(b.column("file_idx"))
    cuts = [0, *(np.flatnonzero(np.diff(idx)) + 1).tolist(), len(idx)]
    for first, last in zip(cuts, cuts[1:], strict=False):
        if first < last:
            yield int(idx[first]), b.slice(first, last - first)


def _raw(b: pa.RecordBatch) -> bytes:
    """Records of a batch; positions that aren't packed in 32 bytes and numbers that don't fit are an error."""
    out = np.zeros(b.num_rows, dtype=RECORD)
    packed = b.column("sfen").cast(pa.binary(32))
    if packed.null_count:
        raise ValueError("a record without a position can't be written")
    out["sfen"] = np.frombuffer(packed.buffers()[1], np.uint8, 32 * b.num_rows, 32 * packed.offset).reshape(-1, 32)
    for name, column, kind in (("score", "score", pa.int16()), ("move", "move", pa.uint16()), ("ply", "game_ply", pa.uint16()), ("result", "game_result", pa.int8())):
        out[name] = np.asarray(b.column(column).cast(kind))
    return out.tobytes()


def read_records(spark: SparkSession, paths: list[str], rows_per_split: int = 1_000_000) -> DataFrame:
    """Records by byte ranges, of files in any store that pyarrow opens, mounts of Spark's file systems resolved: relative, repeated and patterned paths in list order.

    A task reads a range, or neighbouring small ones: at least ROWS_PER_TASK rows of them, then as many as keep all cores busy.
    """
    spark.dataSource.register(RecordSource)
    files = stores.find(spark, paths)
    share = sum(f.size for f in files) // RECORD.itemsize // (4 * spark.sparkContext.defaultParallelism)
    per_task = max(ROWS_PER_TASK, min(share, 1_000_000))
    found = json.dumps([(f.uri, f.size) for f in files])
    return spark.read.format("labelled_records").option("found", found).option("rows_per_split", str(rows_per_split)).option("rows_per_task", str(per_task)).load()


def read_list(spark: SparkSession, list_path: str) -> list[str]:
    """Paths in a list file, one a line; read by Spark, so the list may be in any store."""
    return [p for r in spark.read.text(list_path, wholetext=True).collect() for line in r["value"].split("\n") if (p := line.strip())]


def read_stored_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of read_records() from stores that only Spark's readers open: a file is one row of bytes, of at most 2 GB, and one
    task's work. Larger files are an error."""
    files, before, starts = stores.find(spark, paths), 0, []
    for k, f in enumerate(files):
        starts.append((k, f.path, before))
        before += f.size // RECORD.itemsize
    order = spark.createDataFrame(starts, "file_idx int, path string, before long")
    content = spark.read.format("binaryFile").load(sorted({f.path for f in files})).select("path", "content") if files else spark.createDataFrame([], "path string, content binary")

    def run(batches):
        for b in batches:
            for k, start, raw in zip(b.column("file_idx").to_pylist(), b.column("before").to_pylist(), b.column("content"), strict=True):
                whole = memoryview(raw.as_buffer())
                for first in range(0, len(whole) // RECORD.itemsize, 50_000):
                    n = min(50_000, len(whole) // RECORD.itemsize - first)
                    yield _batch(k, start + np.arange(first, first + n), whole[first * RECORD.itemsize : (first + n) * RECORD.itemsize])

    return content.join(F.broadcast(order), "path").select("file_idx", "before", "content").mapInArrow(run, SCHEMA)


def write_records(rows: DataFrame, path: str, rows_per_file: int = 1_000_000, total: int | None = None) -> None:
    """Rows (row_ord, sfen, score, move, game_ply, game_result) as 40-byte files in the folder path, in place of those there.

    File k has the rows with row_ord from k * rows_per_file on, in order, so the files by name are the rows in order. A task writes
    a file, or several small ones. total: one more than the greatest row_ord, or more than that; without it, rows are computed twice.
    """
    spark = rows.sparkSession
    spark.dataSource.register(RecordSource)
    if total is None:
        total = (rows.agg(F.max("row_ord")).first()[0] or 0) + 1
    per_task = max(1, ROWS_PER_TASK // rows_per_file) * rows_per_file
    d = rows.repartitionById(-(-total // per_task), F.expr(f"CAST(row_ord DIV {per_task} AS INT)")).sortWithinPartitions("row_ord")
    d.select(F.expr(f"CAST(row_ord DIV {rows_per_file} AS INT)").alias("file_idx"), "sfen", "score", "move", "game_ply", "game_result").write.format("labelled_records").option("target", stores.folder(spark, path)).mode("overwrite").save()


def _turned(s):
    return (s & 7) * 8 + (s >> 3)


def encode_batch(turn: np.ndarray, castling: np.ndarray, ep: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x 32 packed bytes, and whether the position fits in 256 bits with one king a side.

    piece: n x 64, file by file, piece * 2 + side or -1. One bit cursor a row, as in decode_batch().
    """
    n = len(turn)
    bits, rows, cur = np.zeros((n, 512), dtype=np.uint8), np.arange(n), np.zeros(n, dtype=np.int64)

    def put(value, width) -> None:
        width = np.broadcast_to(width, n)
        for k in range(int(width.max(initial=0))):
            on = width > k
            bits[rows[on], cur[on] + k] = (np.broadcast_to(value, n)[on] >> k) & 1
        cur[:] = cur + width

    kings = [piece == 10, piece == 11]
    put(turn, 1)
    for k in kings:
        put(_turned(k.argmax(axis=1)), 6)
    codes = np.array([CODES[p // 2] | (p % 2) << 4 if p < 10 else 0 for p in range(12)])
    for r in range(7, -1, -1):
        for f in range(8):
            p = piece[:, f * 8 + r].astype(np.int64)
            full = (p >= 0) & (p < 10)
            put(np.where(full, codes[p], 0), np.where(full, 5, np.where(p < 0, 1, 0)))
    for sq in ROOKS:
        put((castling >> np.int64(sq)) & 1, 1)
    put(ep >= 0, 1)
    put(_turned(np.maximum(ep, 0)), np.where(ep >= 0, 6, 0))
    put(0, 6)
    put(1, 8)
    good = (cur <= 256) & (kings[0].sum(axis=1) == 1) & (kings[1].sum(axis=1) == 1)
    return np.packbits(bits[:, :256], axis=1, bitorder="little"), good


def encode(turn: int, men: list[tuple[int, int, int]], castling: int = 0, ep: int = -1) -> bytes:
    """A packed position from (square, side, piece) of 64 squares, file by file."""
    piece = np.full((1, 64), -1, dtype=np.int8)
    for sq, side, pc in men:
        piece[0, sq] = pc * 2 + side
    packed, good = encode_batch(np.array([turn]), np.array([castling], dtype=np.int64), np.array([ep]), piece)
    if not good[0]:
        raise ValueError("more than 256 bits, or not one king a side")
    return packed[0].tobytes()


def decode_batch(sfen: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of n packed positions (n x 32 bytes), decoded side by side with one bit cursor a row."""
    n = len(sfen)
    bits = np.pad(np.unpackbits(sfen, axis=1, bitorder="little"), ((0, 0), (0, 16)))
    rows, cur = np.arange(n), np.zeros(n, dtype=np.int64)

    def take(width: int, where=None) -> np.ndarray:
        v = sum(bits[rows, np.minimum(cur + k, 271)].astype(np.int64) << k for k in range(width))
        cur[:] = cur + (width if where is None else np.where(where, width, 0))
        return v

    turn, wk, bk = take(1), _turned(take(6)), _turned(take(6))
    piece = np.full((n, 64), -1, dtype=np.int8)
    bad = wk == bk
    of_code = np.full(16, -1)
    for p, c in CODES.items():
        of_code[c] = p
    for r in range(7, -1, -1):
        for f in range(8):
            sq = f * 8 + r
            king = (wk == sq) | (bk == sq)
            piece[:, sq] = np.where(wk == sq, 10, np.where(bk == sq, 11, -1))
            full = (bits[rows, np.minimum(cur, 271)] == 1) & ~king
            code = of_code[take(4, full)]
            side = take(1, full)
            cur += np.where(full | king, 0, 1)
            bad |= full & (code < 0)
            piece[:, sq] = np.where(full, code * 2 + side, piece[:, sq])
    castling = np.zeros(n, dtype=np.int64)
    for sq in ROOKS:
        castling |= take(1) << np.int64(sq)
    has_ep = take(1) == 1
    ep = np.where(has_ep, _turned(take(6, has_ep)), -1)
    bad |= cur + 14 > 256
    return {"turn": turn, "wk": wk, "bk": bk, "castling": castling, "ep": ep, "piece": piece, "bad": bad}


def decode_positions(records: DataFrame, key: str = "row_ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """positions (turn, wk, bk, castling, ep), pieces and bad_records of packed positions; key becomes pos_id."""
    def run(batches):
        for b in batches:
            raw = b.column("sfen").to_pylist()
            whole = [x is not None and len(x) == 32 for x in raw]
            d = decode_batch(np.frombuffer(b"".join(x if w else bytes(32) for x, w in zip(raw, whole, strict=True)), dtype=np.uint8).reshape(-1, 32))
            row, sq = np.nonzero(d["piece"] >= 0)
            p = d["piece"][row, sq].astype(np.int32)
            men = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(raw) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(sq.astype(np.int32)), pa.array(p & 1), pa.array(p >> 1)], ["sq", "side", "pc"]))
            yield pa.RecordBatch.from_arrays([b.column("pos_id"), *[pa.array(d[c].astype(np.int32)) for c in ("turn", "wk", "bk")], pa.array(d["castling"]), pa.array(d["ep"].astype(np.int32)), men, pa.array(d["bad"] | ~np.array(whole, dtype=bool))], ["pos_id", "turn", "wk", "bk", "castling", "ep", "men", "bad"])

    src = records.select(F.col(key).cast("long").alias("pos_id"), "sfen")
    d = src.mapInArrow(run, "pos_id long, turn int, wk int, bk int, castling long, ep int, men array<struct<sq:int,side:int,pc:int>>, bad boolean")
    good = d.filter("NOT bad")
    return good.drop("men", "bad"), good.select("pos_id", F.explode("men").alias("m")).select("pos_id", "m.*"), d.filter("bad").select("pos_id")


def encode_positions(positions: DataFrame, pieces: DataFrame) -> DataFrame:
    """pos_id and sfen of positions (turn, castling and, if there, ep) and pieces; positions of over 256 bits get null."""
    def run(batches):
        for b in batches:
            piece = np.full((b.num_rows, 64), -1, dtype=np.int8)
            men = b.column("men")
            sq, side, pc = (np.asarray(men.flatten().field(c)) for c in ("sq", "side", "pc"))
            piece[np.repeat(np.arange(b.num_rows), np.diff(np.asarray(men.offsets))), sq] = pc * 2 + side
            packed, good = encode_batch(*(np.asarray(b.column(c), dtype=np.int64) for c in ("turn", "castling", "ep")), piece)
            whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), b.num_rows, [None, pa.py_buffer(np.ascontiguousarray(packed).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("pos_id"), compute.if_else(pa.array(good), whole, pa.scalar(None, pa.binary()))], ["pos_id", "sfen"])

    men = pieces.groupBy("pos_id").agg(F.collect_list(F.struct("sq", "side", "pc")).alias("men"))
    ep = F.col("ep").cast("long") if "ep" in positions.columns else F.lit(-1).cast("long")
    return positions.select("pos_id", "turn", "castling", ep.alias("ep")).join(men, "pos_id").mapInArrow(run, "pos_id long, sfen binary")


def write_feature_chunks(feature_rows: DataFrame, path: str, size: int, rows_per_task: int = 1_000_000) -> None:
    """feature rows (row_ord, ..) as Parquet by chunk of size ordinals; rows that a filter left out before count in theirs.

    Ranges of ordinals, several whole chunks or a part of a large one, are dealt to tasks in turn: none gets two by a hash while another has none.
    """
    parts = int(feature_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows_per_task if size > rows_per_task else size * (rows_per_task // size)
    d = feature_rows.withColumn("chunk_id", F.expr(f"row_ord DIV {size}"))
    d.repartitionById(parts, F.expr(f"CAST(row_ord DIV {rows} % {parts} AS INT)")).write.mode("overwrite").partitionBy("chunk_id").parquet(path)
