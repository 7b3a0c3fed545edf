"""Phrase collocations: counts of word sequences as streams in prefix and in suffix order, merge-joined for parts and extensions."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import release, settled, sliced, texts
from rookery.llm.dedup import MIX, STEP, _byte_values, _powers

#: What ends a piece, and what ends a word inside it.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: Bytes of text whose words are hashed at once, and places of the power tables.
BLOCK = 1 << 20
PLACES = BLOCK + (1 << 16)
#: Words of a stored row of the word stream, but for pieces that are longer; rows whose phrases are counted at once.
ROW_WORDS = 256
ROWS = 2048
#: Places of the filter of frequent phrases: a fixed number of bits, whatever the input. A fuller filter lets more phrases be counted, never fewer.
FILTER_BITS = 1 << 26
#: Phrases that a task holds before it sends a sorted run, and that a merge takes in before it sums, or as many as it holds.
RUN_ROWS = MERGE_ROWS = 1 << 20
#: Spelled words that a task remembers to have sent.
SENT_WORDS = 1 << 20
#: Parts of a language that are ranked by themselves before their best meet.
RANK_PARTS = 64

_END = re.compile(rb"[ \t.,;:!?\n-\r]")


@functools.cache
def _kinds() -> np.ndarray:
    """0 for bytes of words, 1 for blanks, 2 for ends of pieces."""
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[list(BLANKS)], kinds[list(BREAKS)] = 1, 2
    return kinds


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (never 0), whether it starts a piece, first and last byte of every word; long data is read in blocks that end behind a word."""
    values, (up, down), parts, at, before = _byte_values()[0], _powers(PLACES), [], 0, -1
    while at < len(data):
        cut = _END.search(data, at + BLOCK)
        end = cut.end() if cut else len(data)
        b = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        raised, lowered = (up, down) if len(b) <= PLACES else _powers.__wrapped__(len(b))
        kind = _kinds()[b]
        gap = np.concatenate([[True], kind > 0, [True]])
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(values[b] * raised[: len(b)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * lowered[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= MIX
        piece = np.cumsum(kind == 2)[starts] if len(starts) else starts
        offset = max(before, 0) if len(parts) else 0
        parts.append((np.maximum(h, np.uint64(1)), piece + offset, starts + at, ends + at))
        before, at = offset + int(np.count_nonzero(kind == 2)), end
    if not parts:
        return (np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))
    h, piece, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, np.diff(piece, prepend=-1) != 0, starts, ends


def phrase_hashes(words: list[np.ndarray], lang: str) -> np.ndarray:
    """Hashes of phrases from the hashes of their words, word by word, and the language."""
    out = np.full(len(words[0]), xxhash.xxh3_64_intdigest(lang), dtype=np.uint64)
    for w in words:
        out = (out ^ (out >> np.uint64(31))) * STEP + w
    out ^= out >> np.uint64(29)
    return out * MIX


def _by_lang(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Each language of a batch with its rows."""
    langs = b.column("lang").dictionary_encode()
    at = np.asarray(langs.indices)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, np.flatnonzero(at == k)


def _data(b: pa.RecordBatch, rows: np.ndarray) -> bytes:
    return "\n".join(x or "" for x in b.column("text").take(pa.array(rows)).to_pylist()).encode("utf-8", "surrogatepass").lower()


def _known(bits: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    at = phrases & np.uint64(FILTER_BITS - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, w (one hash) and f of every word, and under a null w the words of the language together."""
    def run(batches):
        for b in sliced(batches):
            for lang, rows in _by_lang(b):
                h, _, _, _ = words_of(_data(b, rows))
                word, n = np.unique(h, return_counts=True)
                keys = pa.concat_arrays([_longs(word), pa.nulls(1, pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), keys, pa.array(np.append(n, len(h)).astype(np.int64))], ["lang", "h", "n"])

    return docs.mapInArrow(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("f"))


def word_stream(docs: DataFrame, words: Broadcast) -> DataFrame:
    """lang and w, runs of two or more frequent words of a piece, each followed by 0; and h and word, the spellings of a slice's frequent words."""
    def run(batches):
        for b in sliced(batches):
            for lang, rows in _by_lang(b):
                data = _data(b, rows)
                h, new, starts, ends = words_of(data)
                good = _known(words.value, phrase_hashes([h], lang))
                flat = np.zeros(len(h) + int(new.sum()) + 1, dtype=np.uint64)
                flat[np.arange(len(h)) + np.cumsum(new)] = np.where(good, h, np.uint64(0))
                full = flat != 0
                beside = full & (np.append(full[1:], False) | np.append(False, full[:-1]))
                flat = flat[beside | (~full & np.append(False, beside[:-1]))]
                ends_at = np.flatnonzero(flat == 0) + 1
                cuts = ends_at[np.diff(ends_at // ROW_WORDS, prepend=0) > 0]
                offsets = np.unique(np.concatenate([[0], cuts, [len(flat)]])).astype(np.int32) if len(flat) else np.zeros(2, np.int32)
                some, first = np.unique(h[good], return_index=True)
                at = np.flatnonzero(good)[first]
                spelled = [data[starts[k] : ends[k]].decode("utf-8", "replace") for k in at]
                n = len(offsets) - 1
                listed = lambda x: pa.ListArray.from_arrays(pa.array(np.array([0] + [len(x)] * n, np.int32)), x)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), _longs(flat)), listed(_longs(some)), listed(pa.array(spelled, pa.string()))], ["lang", "w", "h", "word"])

    return docs.mapInArrow(run, "lang string, w array<long>, h array<long>, word array<string>")


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Phrases once each, in prefix order, with their counts together."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.logical_or.reduce([np.diff(c, prepend=~c[:1]) != 0 for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(n[order], first) if len(first) else n[:0]


Hot = dict[str, tuple[np.ndarray, np.ndarray]]


def hot_words(words: DataFrame, parts: int) -> Hot:
    """For each language its words with more than a part's share of all, fewer than parts, and the parts that each of them is dealt to."""
    total = words.filter("h is null").select("lang", F.col("f").alias("n"))
    found: dict[str, list[tuple[int, int]]] = {}
    for r in words.filter("h is not null").join(total, "lang").filter(F.col("f") * parts > F.col("n")).collect():
        found.setdefault(r["lang"], []).append((r["h"] % (1 << 64), min(parts, -(-r["f"] * parts // r["n"]))))
    return {lang: (np.array(sorted(x for x, _ in rows), np.uint64), np.array([n for _, n in sorted(rows)], np.uint64)) for lang, rows in found.items()}


def _homes(columns: list[np.ndarray], lang: str, parts: int, hot: Hot) -> np.ndarray:
    """The part of each phrase: that of its first word; phrases that begin with a hot word are dealt to several by the others."""
    home = ((columns[0] * STEP >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    if lang in hot:
        known, spread = hot[lang]
        at = np.minimum(np.searchsorted(known, columns[0]), len(known) - 1)
        often = known[at] == columns[0]
        home[often] = (home[often] + phrase_hashes([c[often] for c in columns[1:]], lang) % spread[at[often]]) % np.uint64(parts)
    return home


def _packed(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """A run of phrases: sizes, the words, the place of each phrase's words among them, and counts. Most runs hold the same words again and again."""
    words, at = np.unique(np.concatenate(columns), return_inverse=True)
    kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
    return b"".join([np.array([len(words), len(n)], np.int64).tobytes(), words.tobytes(), at.astype(kind).tobytes(), n.astype(np.uint32).tobytes()])


def _unpacked(block: bytes, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    size, rows = (int(x) for x in np.frombuffer(block, np.int64, 2))
    words, kind = np.frombuffer(block, np.uint64, size, 16), np.uint16 if size <= 1 << 16 else np.uint32
    start = 16 + 8 * size
    at = np.frombuffer(block, kind, k * rows, start).reshape(k, rows)
    n = np.frombuffer(block[start + k * rows * np.dtype(kind).itemsize :], np.uint32, rows)
    return [words[x] for x in at], n.astype(np.int64)


def _runs(stream: DataFrame, k: int, known: Broadcast | None, parts: int, hot: Hot) -> DataFrame:
    """lang, part and block: sorted runs of phrases and counts, cut into parts.

    known: the filter of frequent phrases of k - 1 words, which the first and the last of a phrase have to pass.
    """
    def run(batches):
        held: dict[str, list[list[np.ndarray]]] = {}
        waiting: dict[str, int] = {}

        def sent(lang: str) -> pa.RecordBatch:
            runs = held.pop(lang)
            columns = [np.concatenate([r[j] for r in runs]) for j in range(k)]
            columns, n = _summed(columns, np.ones(len(columns[0]), np.int64))
            home = _homes(columns, lang, parts, hot)
            order = np.argsort(home, kind="stable")
            columns, n, waiting[lang] = [c[order] for c in columns], n[order], 0
            cuts = np.searchsorted(home[order], np.arange(parts + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(cuts))
            blocks = [_packed([c[cuts[p] : cuts[p + 1]] for c in columns], n[cuts[p] : cuts[p + 1]]) for p in some]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(blocks, pa.binary())], ["lang", "part", "block"])

        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                for lang, rows in _by_lang(b):
                    w = np.asarray(b.column("w").take(pa.array(rows)).flatten()).view(np.uint64)
                    size = len(w) - k + 1
                    if size <= 0:
                        continue
                    full = w != 0
                    at = np.flatnonzero(np.logical_and.reduce([full[j : size + j] for j in range(k)]))
                    columns = [w[at + j] for j in range(k)]
                    if known is not None:
                        good = _known(known.value, phrase_hashes(columns[:-1], lang)) & _known(known.value, phrase_hashes(columns[1:], lang))
                        columns = [c[good] for c in columns]
                    held.setdefault(lang, []).append(columns)
                    waiting[lang] = waiting.get(lang, 0) + len(columns[0])
                    if waiting[lang] >= RUN_ROWS:
                        yield sent(lang)
        for lang in list(held):
            yield sent(lang)

    return stream.select("lang", "w").mapInArrow(run, "lang string, part int, block binary")


def count_phrases(stream: DataFrame, k: int, known: Broadcast | None, min_count: int, parts: int, hot: Hot) -> DataFrame:
    """lang, w (k hashes) and f of phrases of k words that occur min_count times.

    Sorted runs meet by part and are merged there; most phrases are rare and leave no row. A merge holds the phrases of a part once each.
    """
    def run(batches):
        held: dict[str, list[tuple[list[np.ndarray], np.ndarray]]] = {}
        waiting: dict[str, int] = {}

        def merge(lang: str) -> None:
            runs = held[lang]
            held[lang] = [_summed([np.concatenate([r[0][j] for r in runs]) for j in range(k)], np.concatenate([r[1] for r in runs]))]
            waiting[lang] = 0

        for b in batches:
            for lang, block in zip(b.column("lang").to_pylist(), b.column("block").to_pylist(), strict=True):
                columns, n = _unpacked(block, k)
                held.setdefault(lang, []).append((columns, n))
                waiting[lang] = waiting.get(lang, 0) + len(n)
                if waiting[lang] > max(MERGE_ROWS, len(held[lang][0][1])):
                    merge(lang)
        for lang in held:
            merge(lang)
            columns, n = held[lang][0]
            often = n >= min_count
            flat = np.column_stack([c[often] for c in columns]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * int(often.sum()), pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(often.sum() + 1, dtype=np.int32) * k), _longs(flat)), pa.array(n[often])], ["lang", "w", "f"])

    return _runs(stream, k, known, parts, hot).repartitionById(parts, F.col("part")).select("lang", "block").mapInArrow(run, "lang string, w array<long>, f long")


def _joined_bits(spark: SparkSession, bits: DataFrame) -> Broadcast:
    """The filter from rows (slot, bits), joined by executors: at most a row for each 64 places reaches the driver."""
    got = bits.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    out[np.asarray(got.column("slot"))] = np.asarray(got.column("bits")).view(np.uint64)
    return spark.sparkContext.broadcast(out)


def known_phrases(spark: SparkSession, phrases: DataFrame) -> Broadcast:
    """The filter of phrases (lang, w)."""
    def run(batches):
        for b in batches:
            for lang, rows in _by_lang(b):
                lists = b.column("w").take(pa.array(rows))
                w = np.asarray(lists.flatten()).view(np.uint64).reshape(len(rows), -1)
                at = phrase_hashes([w[:, j] for j in range(w.shape[1])], lang) & np.uint64(FILTER_BITS - 1)
                yield pa.RecordBatch.from_arrays([_longs(at >> np.uint64(6)), _longs(np.uint64(1) << (at & np.uint64(63)))], ["slot", "bits"])

    return _joined_bits(spark, phrases.select("lang", "w").mapInArrow(run, "slot long, bits long"))


def _cut_scores(stream: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, w, a, l, r, n and score of phrases of two words or more, by their lowest-scoring cut, the first of several.

    Two merge joins over sorted streams: in prefix order first parts meet their counts, in suffix order (words backwards)
    last parts do. Products are decimals of 38 digits.
    """
    cut = stream.filter("size(w) > 1").select("lang", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("*", F.slice("w", F.lit(1), F.col("k")).alias("first"), F.reverse(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("last"))
    prefix = stream.select("lang", F.col("w").alias("first"), F.col("f").alias("l")).hint("merge")
    suffix = stream.select("lang", F.reverse("w").alias("last"), F.col("f").alias("r")).hint("merge")
    both = cut.join(prefix, ["lang", "first"]).join(suffix, ["lang", "last"]).join(totals, "lang")
    whole = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    score = F.expr(f"CAST({whole('a')} * {whole('n')} AS DECIMAL(34,0)) * 1000BD DIV ({whole('l')} * {whole('r')})").alias("score")
    return both.groupBy("lang", "w", "a", "n").agg(F.min(F.struct(score, "k", "l", "r")).alias("c")).select("lang", "w", "a", "c.l", "c.r", "n", "c.score")


def _without_parts(found: DataFrame, stream: DataFrame) -> DataFrame:
    """found but for phrases that never occur without one and the same word before or behind: an extension has their count.

    A longer phrase that holds another has at most its count, and so have all between them; so one word more on either side tells it all.
    """
    longer = stream.filter("size(w) > 2")
    right = longer.select("lang", F.expr("slice(w, 1, size(w) - 1)").alias("w"), F.col("f").alias("a"))
    left = longer.select("lang", F.expr("slice(w, 2, size(w) - 1)").alias("w"), F.col("f").alias("a"))
    return found.join(right.hint("merge"), ["lang", "w", "a"], "left_anti").join(left.hint("merge"), ["lang", "w", "a"], "left_anti")


def best_found(found: DataFrame, top: int) -> DataFrame:
    """found but for rows with top better ones in their language by score and a alone: all that may be among the best, whatever their spelling."""
    place = lambda by: F.expr(f"rank() OVER (PARTITION BY {by} ORDER BY score DESC, a DESC)")
    d = found.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(RANK_PARTS))).withColumn("rank", place("lang, part")).filter(F.col("rank") <= top)
    return d.withColumn("rank", place("lang")).filter(F.col("rank") <= top).drop("part", "rank")


def needed_words(spark: SparkSession, found: DataFrame) -> Broadcast:
    """A filter of the words of phrases, of any language."""
    place = F.expr(f"h & {FILTER_BITS - 1}L")
    return _joined_bits(spark, found.select(F.explode("w").alias("h")).select(F.shiftright(place, 6).alias("slot"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bits")))


def spellings(stream: DataFrame, needed: Broadcast) -> DataFrame:
    """h and word, one spelling of every word that the filter lets through. A task sends a word once, or again after SENT_WORDS others."""
    def run(batches):
        sent = np.zeros(0, np.uint64)
        for b in batches:
            h, word = (b.column(c).flatten() for c in ("h", "word"))
            h = np.asarray(h).view(np.uint64)
            some, first = np.unique(h, return_index=True)
            first = first[_known(needed.value, some) & ~np.isin(some, sent)]
            sent = np.union1d(sent if len(sent) < SENT_WORDS else sent[:0], h[first])
            yield pa.RecordBatch.from_arrays([_longs(h[first]), word.take(pa.array(first))], ["h", "word"])

    return stream.select("h", "word").mapInArrow(run, "h long, word string").groupBy("h").agg(F.min("word").alias("word"))


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of two to max_words words that occur min_count times.

    A-Z count as a-z. Pieces end at . , ; : ! ? and line ends, words at blanks and tabs. n is the language's words, a the
    phrase's occurrences, l and r those of the parts of its lowest-scoring cut, score floor(1000 a n / (l r)). Phrases inside a
    longer one that occurs as often are left out. Ranks go by score, a, then phrase.

    Only phrases whose shorter parts are frequent are counted, one length after the other: texts are read twice, then a stream of
    their frequent words (64-bit hashes, runs split by 0). A filter of fixed size tells which parts are frequent; it may pass
    others, which then fail by their exact counts. Runs of counts in prefix order are merged; counts of all lengths are one stream of (lang, words, f) from there on.

    A null language is und, null texts are empty. Repeated rows all count. An empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    d = texts(docs, F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).select("text", "lang")
    words = settled(count_words(d).filter((F.col("f") >= min_count) | F.col("h").isNull()), "words")
    counts = [words.filter("h is not null").select("lang", F.array("h").alias("w"), "f")]
    known = known_phrases(spark, counts[0])
    stream = settled(word_stream(d, known), "stream")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_words(words, parts)
    for k in range(2, max_words + 1):
        counts.append(settled(count_phrases(stream, k, known if k > 2 else None, min_count, parts, hot), "phrases"))
        known.unpersist()
        known = known_phrases(spark, counts[-1])
    known.unpersist()
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    every = settled(every, "counts")
    release(*counts[1:])
    totals = words.filter("h is null").select("lang", F.col("f").alias("n"))
    found = settled(best_found(_without_parts(_cut_scores(every, totals), every), top), "found")
    needed = needed_words(spark, found)
    spelled = settled(spellings(stream, needed), "spelled")
    needed.unpersist()
    release(stream, every)
    said = found.select("*", F.posexplode("w").alias("i", "h")).join(spelled, "h").groupBy("lang", "w", "a", "l", "r", "n", "score").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("said"))
    said = said.select("lang", F.array_join(F.transform("said", lambda x: x["word"]), " ").alias("phrase"), "a", "l", "r", "n", "score", F.pmod(F.xxhash64("w"), F.lit(RANK_PARTS)).alias("part"))
    best = F.expr("row_number() OVER (PARTITION BY lang, part ORDER BY score DESC, a DESC, phrase)")
    said = said.withColumn("rank", best).filter(F.col("rank") <= top)
    last = F.expr("CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT)")
    done = settled(said.withColumn("rank", last).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(words, found, spelled)
    return done
