"""Near-duplicate detection: MinHash with tensored banding, verified links, connected components."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import UPPER, fresh, release, settled, sliced, texts

#: 64-bit factors for words of a shingle and for the final mix.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Shingles whose minhashes are taken at once, and bytes of text whose words are.
BLOCK = 1 << 11
TEXT_BYTES = 1 << 20
#: Rows (24 bytes each) that may be broadcast to a scan of documents; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Counts of shingles, by slot.
SLOTS = 1 << 20
#: Rounds in which a bucket is compared with one of its members only, before all open pairs are considered;
#: left out as soon as those are at most PLAIN_FACTOR times the open rows.
STAR_ROUNDS = 3
PLAIN_FACTOR = 4


#: Tables of nodes and pairs of nodes are written in PARTS parts and one more for PART_NODES nodes that met another one.
PARTS, PART_NODES = 8, 5_000


@dataclass(frozen=True)
class Banding:
    """Keys of tables are pairs of one half-key from each of two collections.

    Each collection has side half-keys of width minhashes. side * side tables of 2 * width
    minhashes then take 2 * side * width minhashes, not 2 * side * side * width. Texts of similarity s share a
    table with probability (1 - (1 - s ** width) ** side) ** 2: 0.9985 at 0.8, over 0.99999 at 0.9, 0.005 at 0.2.
    """

    side: int = 10
    width: int = 3
    seed: int = 20

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.Generator(np.random.PCG64(self.seed))
        n = 2 * self.side * self.width
        draw = lambda top: r.integers(0, top, size=(n, 1), dtype=np.uint32)
        return draw(1 << 32), draw(1 << 31) * np.uint32(2) + np.uint32(1)


@functools.cache
def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, equal for either case of A-Z; which bytes are ASCII white space."""
    values = np.random.Generator(np.random.PCG64(41)).integers(0, 1 << 64, size=256, dtype=np.uint64)
    for c in UPPER.encode():
        values[c] = values[c + 32]
    blank = np.zeros(256, dtype=bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return values, blank


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)
    up = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]))
    return up(base), up(inverse)


def _hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of data: sums of byte values times powers of their place in the word."""
    values, blank = _byte_values()
    up, down = _powers(TEXT_BYTES) if len(data) <= TEXT_BYTES else _powers.__wrapped__(len(data))
    b = np.frombuffer(data, dtype=np.uint8)
    gap = np.concatenate([[True], blank[b], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(values[b] * up[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h ^= h >> np.uint64(32)
    return h * MIX


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words; long texts are read in pieces that end at white space."""
    data = text.encode() if text else b""
    if len(data) <= TEXT_BYTES:
        return _hashes(data)
    parts, at = [], 0
    while at < len(data):
        end = at + TEXT_BYTES
        if end < len(data):
            cut = max(data.rfind(bytes([c]), at, end) for c in (0x20, *range(0x09, 0x0E)))
            following = [x for c in (0x20, *range(0x09, 0x0E)) if (x := data.find(bytes([c]), end)) >= 0] if cut < 0 else []
            end = cut + 1 if cut >= 0 else min(following, default=len(data))
        parts.append(_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, of the whole sequence."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    width = min(k, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = out * STEP + h[j : n - width + 1 + j]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def half_keys(s: np.ndarray, flips: np.ndarray, factors: np.ndarray, banding: Banding) -> np.ndarray:
    """The 2 * side half-keys of a set that isn't empty, each in a key space of its own."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(factors), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(x), BLOCK):
        y = x[None, at : at + BLOCK] ^ flips
        y *= factors
        np.minimum(low, y.min(axis=1), out=low)
    low = low.reshape(2 * banding.side, banding.width).astype(np.uint64)
    out = np.arange(2 * banding.side, dtype=np.uint64)
    for j in range(banding.width):
        out = (out ^ (out >> np.uint64(31))) * STEP + low[:, j]
    return (out ^ (out >> np.uint64(29))) * MIX


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _id_key() -> Column:
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id")


def signatures(docs: DataFrame, k: int, banding: Banding) -> DataFrame:
    """doc_id, t (hash of the text), n (set size), set_key (128-bit hash of the set), a and b (half-keys of either collection)."""
    d = texts(docs, _text_key().alias("t"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        flips, factors = banding.factors()
        longs = pa.list_(pa.int64())
        for batch in sliced(batches):
            n, keys, a, b = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), k)
                h = half_keys(s, flips, factors, banding).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                a.append(h[: banding.side])
                b.append(h[banding.side :])
            columns = [batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(a, longs), pa.array(b, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n", "set_key", "a", "b"])

    return d.mapInArrow(run, f"doc_id {kind}, t long, n long, set_key binary, a array<long>, b array<long>")


def _few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return df.limit(most + 1).count() <= most


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, repeated: bool) -> DataFrame:
    """node and the full set of each wanted (node, h, t), computed again from the text.

    What is wanted goes to the scan by broadcast if it is few rows; else both sides are shuffled. repeated: some of
    the rows are there more than once, and one of them is taken.
    """
    d = docs.select(F.col("text").cast("string").alias("text"), _id_key().alias("h"), _text_key().alias("t"))
    d = d.join(F.broadcast(wanted) if _few(wanted) else wanted, ["h", "t"]).select("node", "text")

    def run(batches):
        for batch in sliced(batches):
            sets = [shingle_set(x.as_py(), k).view(np.int64) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return (d.dropDuplicates(["node"]) if repeated else d).mapInArrow(run, "node long, s array<long>")


def _could_reach(n: Column, m: Column, threshold: int) -> Column:
    """Sizes alone rule the other pairs out."""
    return 100 * F.least(n, m) >= threshold * F.greatest(n, m)


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those pairs (x, y) of nodes whose full sets reach the threshold. Only sets that a pair names are shuffled."""

    def named(side: str, values: str) -> DataFrame:
        ids = pairs.select(F.col(side).alias("node")).distinct()
        return sets.join(F.broadcast(ids) if _few(ids) else ids, "node", "left_semi").select(F.col("node").alias(side), F.col("s").alias(values))

    both = pairs.join(named("y", "t"), "y").join(named("x", "s"), "x")
    common = F.size(F.array_intersect("s", "t")).cast("long")
    union = F.size("s") + F.size("t") - common
    return both.filter(100 * common >= threshold * union).select("x", "y")


def prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """node, key and i: the rarest shingles of each set, as many as a set can lack and one more, by place.

    Sets that reach the threshold share one of them, in any order that all sets agree on; and behind the places
    of the first one they share, both have room for the overlap that the threshold asks for. The order is by the
    count of a shingle's slot in a table of SLOTS counts, over these sets; that table's
    size is fixed, so it is broadcast.
    """
    counts = np.zeros(SLOTS, dtype=np.int64)
    got = sets.select(F.explode("s").alias("x")).groupBy(F.pmod("x", F.lit(SLOTS)).alias("slot")).agg(F.count("*").alias("n")).toArrow()
    counts[np.asarray(got.column("slot"))] = np.asarray(got.column("n"))
    order = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at, keys, places = [], [], []
            for row, s in enumerate(batch.column("s")):
                x = np.asarray(s.values)
                size = len(x) - -(-threshold * len(x) // 100) + 1
                keys.append(x[np.lexsort((x, order.value[x % SLOTS]))[:size]])
                at.append(np.full(len(keys[-1]), row))
                places.append(np.arange(len(keys[-1])))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(np.concatenate(at))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], ["node", "key", "i"])

    return sets.mapInArrow(run, "node long, key long, i long")


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """node and component (its smallest node) of every node of the links (x, y).

    Every node takes the least label around it, then its label's label, until nothing changes: a
    number of rounds like the logarithm of the longest chain. Each round is written out.
    """
    both = settled(links.select("x", "y").union(links.select("y", "x")).distinct(), most=parts)
    labels = settled(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("component")), most=parts)
    while True:
        seen = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("component").alias("near"))
        least = labels.join(seen, labels["node"] == seen["x"]).select("node", F.least("component", "near").alias("c"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("far"))
        new = settled(least.join(jump, "c").select("node", F.least("c", "far").alias("component"), "was"), most=parts)
        release(labels)
        labels = new.select("node", "component")
        if new.filter("component < was").isEmpty():
            release(both)
            return labels


def _meeting_nodes(classes: DataFrame, side: int) -> DataFrame:
    """node, n, weight, a and b: for each class the half-keys that another class has too.

    A table key can only be shared if both its halves are, so classes with a lone collection meet nobody and
    most table keys need never be written. weight is the number of classes that share a half, summed.
    """
    half = classes.select("node", F.posexplode(F.concat("a", "b")).alias("at", "h")).select("node", (F.col("at") < side).alias("left"), "h")
    shared = half.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
    live = half.join(shared, "h").groupBy("node").agg(F.collect_list(F.when(F.col("left"), F.col("h"))).alias("a"), F.collect_list(F.when(~F.col("left"), F.col("h"))).alias("b"), F.sum("m").alias("weight"))
    return live.filter("size(a) > 0 and size(b) > 0").join(classes.select("node", "n"), "node").select("node", "n", "weight", "a", "b")


def _tables(nodes: DataFrame, turn: int) -> DataFrame:
    """key, node, n, c and rank: a row for each table. In the first turn the rank is by weight, later by chance."""
    chance = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20))
    rank = (F.col("weight") * (1 << 20) + chance if not turn else chance).alias("rank")
    return nodes.select(F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))).alias("key"), "node", "n", "c", rank)


def _open(rows: DataFrame, apart: bool = False) -> DataFrame:
    """key, s and top: rows of each key with more than one component, and those of its largest. apart: each row is a component."""
    if apart:
        return rows.groupBy("key").agg(F.count("*").alias("s")).filter("s > 1").select("key", "s", F.lit(1).cast("long").alias("top"))
    return rows.groupBy("key", "c").agg(F.count("*").alias("part")).groupBy("key").agg(F.sum("part").alias("s"), F.max("part").alias("top")).filter("s > top")


def _ordered(pairs: DataFrame) -> DataFrame:
    """(x, y), once, of (p, q)."""
    return pairs.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()


def _by_prefixes(sets: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """All pairs (x, y) of nodes (node, n, c) in different components that prefixes of their sets and sizes allow to be linked.

    The smaller set of a pair has the shared shingle at a place that leaves room for a set of its own size, so
    keys without such an early row make no pairs. Where a key has one large component, its members meet the
    other rows of the key only, never one another.
    """
    n, i, m, j = (F.col(x) for x in ("n", "i", "m", "j"))
    early = (100 + threshold) * (n - i) >= 2 * threshold * n
    rows = settled(prefixes(sets.join(nodes.select("node"), "node", "left_semi"), threshold).join(nodes, "node"))
    parts = rows.groupBy("key", "c").agg(F.count("*").alias("part"), F.count_if(early).alias("early"))
    top = parts.groupBy("key").agg(F.max(F.struct("part", "c")).alias("top"), F.count("*").alias("parts"), F.sum("early").alias("early")).filter("parts > 1 and early > 0")
    live = settled(rows.join(top.select("key", F.col("top.c").alias("major")), "key").withColumn("minor", F.col("c") != F.col("major")).drop("major"))
    release(rows)
    small = live.filter(early).select("key", F.col("node").alias("p"), "n", "i", F.col("c").alias("cp"), "minor")
    large = live.select("key", F.col("node").alias("q"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("cq"), F.col("minor").alias("other"))
    fits = (n <= m) & (100 * n >= threshold * m) & (F.col("cp") != F.col("cq")) & ((100 + threshold) * F.least(n - i, m - j) >= threshold * (n + m))
    met = [a.join(b, (a["key"] == b["key"]) & fits).select("p", "q") for a, b in ((small.filter("minor"), large), (small.filter("not minor"), large.filter("other")))]
    return _ordered(met[0].union(met[1]))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, banding: Banding = Banding()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id) and kept (doc_id is component_id) of every row.

    Words are runs of anything but ASCII white space, ASCII case folded. A set is a text's
    distinct k-word shingles; with fewer words, the whole sequence. Documents are linked if 100 *
    intersection >= threshold * union; links are confirmed on the full sets of 64-bit shingle hashes.

    Rows of equal sets form a class, a node of 8 bytes; copies never meet as pairs. Nodes meet in tables by
    tensored keys, of which only those are formed whose halves are both shared. First each bucket is compared
    with its member that shares most, then with random ones while buckets with several components would still make
    many pairs. At last all nodes of such buckets that lie in different components are compared, but for pairs
    that share none of the rare shingles one of which any linked pair shares. So no link between nodes that met in
    a bucket is missed, and pairs known to be connected cost nothing. There is no cap on buckets or partners.

    Null and empty texts have empty sets and are linked with nothing. Repeated rows and rows of one doc_id with
    different texts are each returned, by their own sets. Rows without doc_id are linked like others, but name a
    component (null) only if all of it is without. An empty table gives an empty result; extra columns are ignored.
    """
    return _judged(docs, k, threshold, banding).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("best.doc_id", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("best.doc_id", "doc_id")).alias("kept"))


def _judged(docs: DataFrame, k: int, threshold: int, banding: Banding) -> DataFrame:
    """doc_id, t and n of every row, and best (none, doc_id, t): the first row of its component, null for empty sets."""
    signed = settled(signatures(docs, k, banding))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    classes = signed.filter("n > 0").groupBy("set_key").agg(first, F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = settled(classes.withColumn("node", F.monotonically_increasing_id()))
    nodes = settled(_meeting_nodes(classes, banding.side).withColumn("c", F.col("node")))
    found = sets = tested = None
    for turn in range(STAR_ROUNDS + 1):
        keys = _tables(nodes, turn)
        rows = settled(keys.join(_open(keys, apart=not turn), "key"))
        some = rows.select("node", "n", "c").distinct()
        if sets is None:
            wanted = settled(classes.join(some, "node", "left_semi").select("node", F.xxhash64("first.none", "first.doc_id").alias("h"), F.col("first.t").alias("t")))
            here, n = signed.select(_id_key().alias("h"), "t").join(wanted, ["h", "t"], "left_semi").count(), wanted.count()
            parts = PARTS + n // PART_NODES
            sets = settled(full_sets(docs, wanted, k, repeated=here > n))
            release(wanted)
        if turn:
            size = rows.agg(F.count("*").alias("rows"), F.sum((F.col("s") - F.col("top")) * 1.0).alias("pairs")).first()
            if turn == STAR_ROUNDS or (size["pairs"] or 0) <= PLAIN_FACTOR * size["rows"]:
                break
        leaders = rows.groupBy("key").agg(*[F.max_by(x, "rank").alias(y) for x, y in (("node", "q"), ("n", "m"), ("c", "cq"))])
        met = rows.join(leaders, "key").filter((F.col("c") != F.col("cq")) & _could_reach(F.col("n"), F.col("m"), threshold))
        pairs = _ordered(met.select(F.col("node").alias("p"), "q"))
        pairs = settled(pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti"), most=parts)
        tested = pairs if tested is None else tested.union(pairs)
        links = settled(confirm(pairs, sets, threshold))
        known = found
        found = components(links if known is None else links.union(known.select("node", "component")), parts)
        old, nodes = nodes, settled(nodes.drop("c").join(some.select("node"), "node", "left_semi").join(found, "node", "left").select("node", "n", "weight", "a", "b", F.coalesce("component", "node").alias("c")), most=parts)
        release(old, rows, links, *([known] if known is not None else []))

    some = settled(some, most=parts)
    pairs = settled(_by_prefixes(sets, some, threshold).join(tested, ["x", "y"], "left_anti"))
    links = settled(confirm(pairs, sets, threshold).union(found.select("node", "component")))
    known, found = found, components(links, parts)
    release(nodes, rows, some, links, known, pairs, tested, sets)

    homes = classes.join(found, "node", "left").select("set_key", "first", F.coalesce("component", "node").alias("c"))
    # Written first, so that a join with a component of very many nodes can be split.
    best = settled(homes.groupBy("c").agg(F.min("first").alias("best")))
    homes = homes.join(best, "c").select("set_key", "best")
    return signed.select("doc_id", "t", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(homes, "set_key", "left").drop("set_key")


def survivors(docs: DataFrame, k: int = 5, threshold: int = 80, banding: Banding = Banding()) -> DataFrame:
    """The rows of docs, with all their columns, but for those that near_duplicates() links with an earlier one.

    One row of each component stays: that of the smallest doc_id, rows without doc_id last, of several of its texts
    the one with the least hash, of repeated rows any one. Rows of one doc_id whose texts aren't linked all stay, and so does every null or empty
    text. Rows are told apart by doc_id and text alone. An empty table stays empty.
    """
    judged = settled(_judged(docs, k, threshold, banding).select(_id_key().alias("h"), "t", "doc_id", "best"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t").eqNullSafe(F.col("best"))
    h, t = fresh(docs, "h"), fresh(docs, "t")
    named = lambda d: d.select(F.col("h").alias(h), F.col("t").alias(t))
    gone = settled(named(judged.filter(F.col("best").isNotNull() & ~first)).distinct())
    repeated = settled(named(judged.filter(first).groupBy("h", "t").count().filter("count > 1")))
    d = docs.select(*docs.columns, _id_key().alias(h), _text_key().alias(t))

    def without(d: DataFrame, rows: DataFrame) -> DataFrame:
        return d.join(F.broadcast(rows) if _few(rows) else rows, [h, t], "left_anti")

    d = without(d, gone)
    if not repeated.isEmpty():
        d = without(d, repeated).unionByName(d.join(repeated, [h, t], "left_semi").dropDuplicates([h, t]))
    return d.select(*docs.columns)
