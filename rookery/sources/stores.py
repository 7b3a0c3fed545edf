"""Files of any store: found once by the driver through Spark's file systems, read and written by tasks in ranges."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyarrow import fs as stores
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Stored:
    """A file: its path as Spark gives it back, the path behind any mount, and its bytes."""

    path: str
    uri: str
    size: int


def _hadoop(spark: SparkSession, path: str):
    """Path and file system of the session's own configuration."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def find(spark: SparkSession, paths: list[str]) -> list[Stored]:
    """The files of paths in list order: relative paths, paths of the default store, patterns (by name) and folders (their files by name).

    A path that is listed twice is there twice; one that names nothing is an error.
    """
    out = []
    for wanted in paths:
        p, fs = _hadoop(spark, wanted)
        found = list(fs.globStatus(p) or [])
        files = [f for s in found for f in (sorted((x for x in fs.listStatus(s.getPath()) if not re.match(r"[._]", x.getPath().getName())), key=lambda x: x.getPath().toString()) if s.isDirectory() else [s])]
        if not found:
            raise FileNotFoundError(wanted)
        ordered = files if len(found) == 1 else sorted(files, key=lambda x: x.getPath().toString())
        out += [Stored(f.getPath().toString(), fs.resolvePath(f.getPath()).toString(), f.getLen()) for f in ordered if not f.isDirectory()]
    return out


def folder(spark: SparkSession, path: str) -> str:
    """The path of a folder, made if it isn't there, behind any mount."""
    p, fs = _hadoop(spark, path)
    fs.mkdirs(p)
    return fs.resolvePath(p).toString()


def opened(uri: str) -> tuple[stores.FileSystem, str]:
    """File system and path in it, for a task. Local and mounted paths have no scheme or file:."""
    if re.match(r"file:|/", uri):
        return stores.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return stores.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))
