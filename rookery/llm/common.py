"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.sources.shared import release, settled

__all__ = ["FOLD", "LOWER", "UPPER", "fresh", "release", "settled", "sliced", "table", "texts"]

#: ASCII upper case and its lower case: the only letters that word contracts fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: For str.translate.
FOLD = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and nothing else, so that clashing extra columns of a caller do no harm."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *more)


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about that many bytes of one string column, so that few Python strings live at a time."""
    for b in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)))
        cuts = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if end > start or not b.num_rows:
                yield b.slice(start, end - start)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it no column of df."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name
