"""Benchmark decontamination: Wu-Manber search for the word windows of benchmark items."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import FOLD, release, settled, sliced, texts

#: After ASCII lower-casing: letters, digits and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a block in the shift table.
BLOCK = 2
#: Characters of benchmark text that one pass holds in a worker, in about 120 MB; longer benchmarks take several passes.
PASS_CHARS = 2_000_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(FOLD)) if text else []


class WuManber:
    """Patterns of one length, over words.

    Patterns are places in runs of words, so windows that overlap share their words. shift: for a block of words, how
    far the window can move before the block could end a pattern position; blocks of no pattern move it by the
    most. suffixes: places of patterns by the hash of their last block and, as such blocks can be
    frequent, of their first and middle word. The words there are then compared directly.
    """

    def __init__(self, length: int):
        self.length = length
        self.block = min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.suffixes: dict[int, list[tuple[int, int]]] = {}
        self.runs: dict[int, list[str]] = {}

    def _bucket(self, text: list[str], at: int, key: tuple[str, ...]) -> int:
        return hash((key, text[at], text[at + self.length // 2]))

    def add(self, number: int, run: list[str]) -> None:
        """All windows of a run of words; number is given back with what is found."""
        self.runs[number] = run
        for end in range(self.block, len(run) + 1):
            key = tuple(run[end - self.block : end])
            # In the first window that holds the block, it stands last.
            by = max(0, self.length - end)
            self.shift[key] = min(self.shift.get(key, self.most), by)
            if not by:
                self.suffixes.setdefault(self._bucket(run, end - self.length, key), []).append((number, end - self.length))

    def find(self, text: list[str]):
        """(start, number) of every occurrence of a run's window, overlapping ones included."""
        n, length, most = len(text), self.length, self.most
        shift, pairs = self.shift.get, self.block == 2
        end = length
        while end <= n:
            key = (text[end - 2], text[end - 1]) if pairs else (text[end - 1],)
            by = shift(key, most)
            if by:
                end += by
                continue
            at = end - length
            for number, place in self.suffixes.get(self._bucket(text, at, key), ()):
                if self.runs[number][place : place + length] == text[at:end]:
                    yield at, number
            end += 1


class Search:
    """The windows of some items, one WuManber for each length. Items of equal words are searched once."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.engines: dict[int, WuManber] = {}
        self.items: list[list[str]] = []
        numbers: dict[tuple[str, ...], int] = {}
        for item, text in items:
            w = words(text)
            if not w:
                continue
            number = numbers.setdefault(tuple(w), len(numbers))
            if number == len(self.items):
                self.items.append([])
                length = min(window, len(w))
                self.engines.setdefault(length, WuManber(length)).add(number, w)
            self.items[number].append(item)

    def scan(self, text: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans (end exclusive) inside occurrences, and the items of those."""
        spans, items = [], set()
        for e in self.engines.values():
            for at, number in e.find(text):
                if not spans or spans[-1] != (at, at + e.length):
                    spans.append((at, at + e.length))
                items.update(self.items[number])
        return merged(spans), items


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, pass_chars: int = PASS_CHARS) -> DataFrame:
    """doc_id, n_words, spans (of hit words, merged, end exclusive), item_ids (sorted as strings).

    An item's windows are its runs of window words; an item of fewer words, but not none, is one
    window. Case differs only by ASCII letters. Null and empty texts have no words and no hits;
    null item texts and null item_ids match nothing; repeated item rows count once; repeated
    documents are searched each for itself; an empty benchmark hits nothing; extra columns are
    ignored.

    The size of the benchmark is summed first. One pass ships at most about pass_chars characters
    of items (hashed into groups) to the driver and the workers; a benchmark beyond that takes more passes over
    the documents, each adding to the spans of the one before, which are written out in between, so that one index at a
    time lives in a worker. There is no join and no shuffle.
    """
    d = texts(docs)
    parts = _parts(benchmark, pass_chars)
    kind = d.schema["doc_id"].dataType.simpleString()
    columns = "n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>"
    before = None
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        d = d.mapInArrow(_pass([tuple(r) for r in part.collect()], window, last), f"doc_id {kind}, " + ("" if last else "text string, ") + columns)
        if not last:
            d = settled(d)
            release(*([before] if before else []))
            before = d
    return d


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows, with all their columns, in which find_contamination() finds nothing."""
    d = docs
    parts = _parts(benchmark, pass_chars)
    for k, part in enumerate(parts):
        d = d.mapInArrow(_clean_rows([tuple(r) for r in part.collect()], window), docs.schema)
        d = d if k == len(parts) - 1 else settled(d)
    return d


def _parts(benchmark: DataFrame, pass_chars: int) -> list[DataFrame]:
    """The benchmark in parts of about pass_chars characters, by its measured size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-int(total) // pass_chars))
    return [items if passes == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) for k in range(passes)]


#: Of a worker: one pass's search at a time.
_searches: dict[str, Search] = {}


def _key(items: list[tuple[str, str]], window: int) -> str:
    return hashlib.sha256(repr((items, window)).encode()).hexdigest()


def _search(key: str, items: list[tuple[str, str]], window: int) -> Search:
    if key not in _searches:
        _searches.clear()
        _searches[key] = Search(items, window)
    return _searches[key]


def _clean_rows(items: list[tuple[str, str]], window: int):
    key = _key(items, window)

    def run(batches):
        search = _search(key, items, window)
        for b in sliced(batches):
            yield b.filter(pa.array([not search.scan(words(x.as_py()))[0] for x in b.column("text")], pa.bool_()))

    return run


def _pass(items: list[tuple[str, str]], window: int, last: bool):
    key = _key(items, window)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        search = _search(key, items, window)
        for b in sliced(batches):
            n, spans, ids = [], [], []
            more = "spans" in b.schema.names
            before = zip(b.column("spans").to_pylist(), b.column("item_ids").to_pylist(), strict=True) if more else None
            for text in b.column("text"):
                w = words(text.as_py())
                s, i = search.scan(w)
                if before is not None:
                    old_spans, old_ids = next(before)
                    s, i = merged(s + [(x["start"], x["end"]) for x in old_spans]), i | set(old_ids)
                n.append(len(w))
                spans.append([{"start": x, "end": y} for x, y in s])
                ids.append(sorted(i))
            cols = {"doc_id": b.column("doc_id")} | ({} if last else {"text": b.column("text")})
            cols |= {"n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, span_type), "item_ids": pa.array(ids, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(cols)

    return run
