"""Line deduplication: levelled sorted runs of line hashes, against which each batch is merge-anti-joined."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import release, settled, sliced, texts
from rookery.sources.shared import new_path, release_path

#: White space that a key loses at both ends.
BLANK = " \t\n\x0b\x0c\r"
#: Runs of a level that are compacted into one of the next.
FANOUT = 4
#: Rows (24 bytes each, for ids of 8) that may be broadcast to the scan that drops lines; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def _line_keys(column: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, place and 128-bit hash (two longs) of every line with a key of min_chars code points or more; and the lines by row."""
    lines = pc.split_pattern(pc.fill_null(column, ""), "\n")
    keys = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=BLANK))
    at = np.flatnonzero(np.asarray(pc.greater_equal(pc.utf8_length(keys), min_chars)))
    digests = b"".join(xxhash.xxh3_128_digest(k) for k in keys.take(pa.array(at)).cast(pa.binary()).to_pylist())
    starts = np.asarray(lines.offsets)
    row = np.searchsorted(starts, at + starts[0], side="right") - 1
    return row, at, np.frombuffer(digests, dtype="<i8").reshape(-1, 2), lines


def line_hashes(docs: DataFrame, min_chars: int, *more: str) -> DataFrame:
    """doc_id, further columns, h and g (128 bits together): once for each distinct key of a row."""
    d = texts(docs, *more)
    names = [c for c in d.columns if c != "text"]
    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for b in sliced(batches):
            row, _, hashes, _ = _line_keys(b.column("text"), min_chars)
            found = np.unique(np.column_stack([row, hashes]), axis=0) if len(row) else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(found[:, 0])) for c in names], pa.array(found[:, 1]), pa.array(found[:, 2])], [*names, "h", "g"])

    return d.mapInArrow(run, f"{kinds}, h long, g long")


@dataclass(frozen=True)
class Run:
    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"run-{self.level}-{self.first:08d}-{self.last:08d}"


class Runs:
    """Sorted runs of (h, g, n, top) in a shared folder: how many documents hold a line, and the largest id among them.

    A run is a bucketed Parquet table, sorted inside its buckets. All runs have the same buckets, so a batch is shuffled once,
    by its own hashes, and runs are joined with it where they lie. FANOUT runs of a level become one of the next, so a hash is
    rewritten as often as there are levels, the logarithm of the batches. A run's name tells the batches it covers: one that
    a larger run covers is left over from a compaction that was cut short and is ignored, and a batch that was added is not
    added again, so a job that was lost can be started anew on the same folder.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, min_docs: int):
        self.spark, self.path, self.buckets, self.min_docs = spark, path, buckets, min_docs
        self.tables: dict[Run, str] = {}
        self.runs = self._stored()

    def _stored(self) -> list[Run]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        named = [m for n in names if (m := re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", n)) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        found = [Run(*map(int, m.groups())) for m in named]
        return sorted((r for r in found if not any(o.level > r.level and o.first <= r.first and r.last <= o.last for o in found)), key=lambda r: r.first)

    def _table(self, run: Run) -> DataFrame:
        """The run with its buckets; the catalog's entry lives as long as the session."""
        if run not in self.tables:
            self.tables[run] = f"rookery_{xxhash.xxh3_64_hexdigest(f'{self.path}/{run.name}')}"
            schema = self.spark.read.parquet(f"{self.path}/{run.name}").schema
            columns = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in schema)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.tables[run]} ({columns}) USING parquet CLUSTERED BY (h, g) SORTED BY (h, g) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run.name}'")
        return self.spark.table(self.tables[run])

    def _write(self, entries: DataFrame, run: Run) -> None:
        name = f"rookery_{xxhash.xxh3_64_hexdigest(f'{self.path}/{run.name}')}"
        entries.write.mode("overwrite").bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", f"{self.path}/{run.name}").saveAsTable(name)
        self.tables[run] = name
        self.runs.append(run)

    def _forget(self, run: Run) -> None:
        self.runs.remove(run)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")
        release_path(self.spark, f"{self.path}/{run.name}")

    def add(self, number: int, hashes: DataFrame) -> None:
        """Adds batch number, rows (doc_id, h, g). Lines that a run already decides, found in min_docs documents up to an id that the
        batch doesn't exceed, are left out; others become the batch's own run."""
        if any(r.first <= number <= r.last for r in self.runs):
            return
        own = hashes.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        for run in self.runs:
            done = self._table(run).filter(F.col("n") >= self.min_docs).select("h", "g", F.col("top").alias("had")).hint("merge")
            own = own.join(done, (own["h"] == done["h"]) & (own["g"] == done["g"]) & (own["top"].isNull() | (own["top"] <= done["had"])), "left_anti")
        self._write(own, Run(0, number, number))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while True:
            full = sorted((r for r in self.runs if r.level == level), key=lambda r: r.first)[:FANOUT]
            if len(full) < FANOUT:
                return
            self._write(self._merged(full), Run(level + 1, full[0].first, full[-1].last))
            for r in full:
                self._forget(r)
            level += 1

    def _merged(self, runs: list[Run]) -> DataFrame:
        """The runs as one: outer merge joins over equal buckets, without a shuffle."""
        out = self._table(runs[0])
        for r in runs[1:]:
            other = self._table(r).withColumnsRenamed({"n": "m", "top": "other"}).hint("merge")
            none = F.lit(0).cast("long")
            out = out.join(other, ["h", "g"], "full_outer").select("h", "g", (F.coalesce("n", none) + F.coalesce("m", none)).alias("n"), F.greatest("top", "other").alias("top"))
        return out

    def repeated(self) -> DataFrame:
        """h, g and top of the lines in min_docs documents or more; top is the largest id, null if no holder has one."""
        return self._merged(self.runs).filter(F.col("n") >= self.min_docs).select("h", "g", "top")

    def drop(self) -> None:
        for r in list(self.runs):
            self._table(r)
            self._forget(r)
        release_path(self.spark, self.path)


def drop_lines(docs: DataFrame, repeated: DataFrame, min_chars: int, own: bool = False) -> DataFrame:
    """doc_id, text, n_lines and n_dropped of every row: without lines whose keys are repeated (h, g, top), but for rows whose doc_id is top.

    Few repeated lines go to the scan by broadcast. Many are joined by shuffle with the hashes of all lines, and only the hashes to drop come back to a row.
    own: repeated is a settled table that nothing else reads, and is deleted if it was broadcast.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        known = repeated.sort("h", "g").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(known)
        if own:
            release(repeated)
        d = texts(docs)
    else:
        keys = (F.xxhash64(F.col("doc_id").isNull(), "doc_id").alias("_i"), F.xxhash64(F.col("text").cast("string")).alias("_t"))
        met = line_hashes(docs.select("doc_id", "text", *keys), min_chars, "_i", "_t").join(repeated.hint("merge"), ["h", "g"]).filter(~F.col("doc_id").eqNullSafe(F.col("top")))
        gone = met.groupBy("_i", "_t").agg(F.collect_set(F.struct("h", "g")).alias("gone"))
        d = texts(docs, *keys).join(gone, ["_i", "_t"], "left").select("doc_id", "text", "gone")

    def dropped(b: pa.RecordBatch, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which of the lines go."""
        if few:
            known = shared.value
            h, g = np.asarray(known.column("h")), np.asarray(known.column("g"))
            out = np.zeros(len(row), dtype=bool)
            at = np.searchsorted(h, hashes[:, 0])
            for k in np.flatnonzero(h[np.minimum(at, len(h) - 1)] == hashes[:, 0]) if len(h) else ():
                j = at[k]
                while j < len(h) and h[j] == hashes[k, 0]:
                    if g[j] == hashes[k, 1]:
                        out[k] = known.column("top")[int(j)].as_py() != b.column("doc_id")[int(row[k])].as_py()
                    j += 1
            return out
        sets = b.column("gone")
        count = np.asarray(pc.fill_null(pc.list_value_length(sets), 0))
        flat = sets.flatten()
        listed = np.column_stack([np.repeat(np.arange(b.num_rows), count), np.asarray(flat.field("h")), np.asarray(flat.field("g"))])
        pair = np.dtype([("row", "i8"), ("h", "i8"), ("g", "i8")])
        plain = lambda x: np.ascontiguousarray(x, dtype=np.int64).view(pair).ravel()
        return np.isin(plain(np.column_stack([row, hashes])), plain(listed))

    def run(batches):
        for b in sliced(batches):
            row, at, hashes, lines = _line_keys(b.column("text"), min_chars)
            gone = at[dropped(b, row, hashes)] if len(at) else at
            starts = np.asarray(lines.offsets) - lines.offsets[0].as_py()
            n = np.diff(starts)
            lost = np.bincount(np.searchsorted(starts, gone, side="right") - 1, minlength=b.num_rows) if len(gone) else np.zeros(b.num_rows, np.int64)
            whole = pc.fill_null(b.column("text"), "").to_pylist()
            flat = lines.flatten()
            away = set(gone.tolist())
            for k in np.flatnonzero(lost):
                first = int(starts[k])
                mine = flat.slice(first, int(n[k])).to_pylist()
                whole[k] = "\n".join(x for j, x in enumerate(mine, first) if j not in away)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(whole, pa.string()), pa.array(n.astype(np.int64)), pa.array(lost.astype(np.int64))], ["doc_id", "text", "n_lines", "n_dropped"])

    return d.mapInArrow(run, f"doc_id {kind}, text string, n_lines long, n_dropped long")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 5) -> DataFrame:
    """doc_id, text, n_lines (before) and n_dropped of every row: lines that min_docs documents hold stay in the one of the largest doc_id only.

    A line's key is the line without ASCII white space at both ends, A-Z in lower case; shorter keys than min_chars code points always stay.
    Hashes of 128 bits stand for keys. Batches of documents go through Runs, then lines are dropped in one more scan.

    Null and empty texts are one empty line. Every row is a document: repeated rows count each, and rows of the largest doc_id all keep the
    line. Rows without doc_id count too, as less than any other; if no holder has an id, all keep the line. An empty table
    gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    stored = settled(line_hashes(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "lines")
    runs = Runs(spark, new_path(spark, "runs"), int(spark.conf.get("spark.sql.shuffle.partitions")), min_docs)
    for k in range(batches):
        runs.add(k, stored.filter(F.col("batch") == k).drop("batch"))
    repeated = settled(runs.repeated(), "repeated")
    runs.drop()
    release(stored)
    return drop_lines(docs, repeated, min_chars, own=True)
