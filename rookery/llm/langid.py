"""Language identification with a bit-sliced Bloom filter over character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import release, settled, sliced

#: Characters of an n-gram; one blank stands for everything between two words.
N = 4
#: Slots of the filter and hashes of an n-gram: 4 Mi slots of 8 bytes, 32 MiB for each PLANE languages.
SLOTS = 1 << 22
HASHES = 4
#: An n-gram belongs to a language if it makes up this share of that language's n-grams at least.
MIN_SHARE = 2e-5
#: Languages of one 64-bit mask; more take more masks.
PLANE = 63
#: Characters that are taken at once.
CHARS = 1_000_000
#: Odd 64-bit factors for the characters and the slots.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all other code points."""
    fold = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            fold[c] = ord(low) if len(low) == 1 else c
    return fold


#: With fewer n-grams than these that occur twice, a language keeps those that occur once.
FEW_OFTEN = 100
#: Where a long text may be cut.
NO_LETTER = re.compile(r"[\W\d_]")
_fold: list[np.ndarray] = []


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, the text each belongs to, and whether a text has a letter.

    Runs of other characters than letters are one blank, and blanks stand around a text; n-grams of whole texts, repeats included.
    """
    if not _fold:
        _fold.append(_letters())
    codes = [np.frombuffer((x or "").encode("utf-32-le"), dtype=np.uint32) for x in texts]
    gap = np.zeros(1, dtype=np.uint32)
    flat = _fold[0][np.concatenate([gap, *[y for x in codes for y in (x, gap)]])]
    owner = np.repeat(np.arange(len(codes) + 1), [1, *[len(x) + 1 for x in codes]])
    owner = np.maximum(owner - 1, 0)
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
    flat, owner = flat[keep].astype(np.uint64), owner[keep]
    has = np.zeros(len(codes), dtype=bool)
    has[owner[flat != 0]] = True
    m = max(0, len(flat) - N + 1)
    h = np.zeros(m, dtype=np.uint64)
    inner = np.zeros(m, dtype=bool)
    for k in range(N):
        part = flat[k : k + m]
        h = (h ^ (part + np.uint64(k + 1))) * FACTORS[k]
        h ^= h >> np.uint64(29)
        if 0 < k < N - 1:
            inner |= part == 0  # n-grams over a word's bound say little
    # The end blank of a text belongs to it; an n-gram starts at the text of its second character.
    at = owner[1 : m + 1] if m else owner[:0]
    return h[~inner], at[~inner], has


def slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h * (FACTORS[k] | np.uint64(1))) >> np.uint64(40)).astype(np.int64) % SLOTS for k in range(HASHES)]


def parts(texts: list[str | None], chars: int = CHARS) -> Iterator[list[tuple[int, str]]]:
    """The texts in lists of (number, part) of about so many characters. Long texts are cut between two words, where no
    n-gram that counts is lost. A word that is itself that long is cut with an overlap of N - 1 letters, so that its n-grams
    are all there; each such cut adds one of a word's end and one of its start."""
    held, size = [], 0
    for k, text in enumerate(texts):
        text = text or ""
        at = 0
        while True:
            end = min(len(text), at + chars)
            gap = NO_LETTER.search(text, end, end + chars) if end < len(text) else None
            inside = end < len(text) and gap is None and end + chars < len(text)
            end = gap.end() if gap else end + chars if inside else len(text)
            held.append((k, text[at:end]))
            size, at = size + end - at, end - (N - 1) * inside
            if size >= chars:
                yield held
                held, size = [], 0
            if at >= len(text):
                break
    if held:
        yield held


@dataclass(frozen=True)
class Model:
    """names[k] has bit k % PLANE of masks[k // PLANE]; masks: for each slot, the languages that have set it; fill: share of slots each has set."""

    names: list[str]
    masks: np.ndarray
    fill: np.ndarray
    default: str

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        n = len(texts)
        hits, total, has = np.zeros((len(self.names), n)), np.zeros(n), np.zeros(n, dtype=bool)
        for held in parts(texts):
            h, owner, letters = grams([x for _, x in held])
            number = np.array([k for k, _ in held])
            has[number[letters]] = True
            owner = number[owner]
            total += np.bincount(owner, minlength=n)
            at = slots(h)
            for plane, masks in enumerate(self.masks):
                found = np.full(len(h), -1, dtype=np.int64)
                for s in at:
                    found &= masks[s]
                for k in range(plane * PLANE, min(len(self.names), (plane + 1) * PLANE)):
                    hits[k] += np.bincount(owner, weights=(found >> (k % PLANE)) & 1, minlength=n)
        if not self.names:
            return [("und", 0.0)] * n
        # Popcount of each language, less what a filter of that fill lets through by chance.
        false = (self.fill**HASHES)[:, None]
        shares = np.clip((hits / np.maximum(total, 1) - false) / np.maximum(1e-9, 1 - false), 0.0, 1.0)
        best = shares.argmax(axis=0)
        out = []
        for i in range(n):
            if not has[i]:
                out.append(("und", 0.0))
            elif shares[best[i], i] <= 0:
                out.append((self.default, 0.0))
            else:
                out.append((self.names[best[i]], float(shares[best[i], i])))
        return out


def learn(labelled: DataFrame, min_share: float = MIN_SHARE) -> Model:
    """The filter from all rows (text, lang) with a language.

    Workers count n-grams by slice and Spark sums the counts; n-grams of enough share, and of two occurrences, set their
    slots; a language with hardly any n-gram twice keeps all it has. What reaches the driver is one mask for each set slot and PLANE languages, at most SLOTS rows each however many the
    documents.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")

    def count(batches):
        for b in sliced(batches):
            all_texts, all_langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for held in parts(all_texts):
                h, owner, _ = grams([x for _, x in held])
                names = sorted({all_langs[k] for k, _ in held})
                number = {x: k for k, x in enumerate(names)}
                lang = np.array([number[all_langs[k]] for k, _ in held])[owner]
                for k, name in enumerate(names):
                    values, counts = np.unique(h[lang == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = settled(counts)
    sizes = {r["lang"]: r for r in counts.groupBy("lang").agg(F.sum("n").alias("t"), F.count_if(F.col("n") >= 2).alias("often")).collect()}
    totals = sorted((x, r["t"]) for x, r in sizes.items())
    names = [x for x, _ in totals]
    default = max(totals, key=lambda x: (x[1], x[0]))[0] if totals else "und"
    masks = np.zeros((-(-len(names) // PLANE), SLOTS), dtype=np.int64)
    if names:
        number = F.create_map(*[y for k, (x, _) in enumerate(totals) for y in (F.lit(x), F.lit(k))])[F.col("lang")]
        least = F.create_map(*[y for x, t in totals for y in (F.lit(x), F.lit(max(2.0, t * min_share) if sizes[x]["often"] >= FEW_OFTEN else 1.0))])[F.col("lang")]

        def set_slots(batches):
            for b in batches:
                h = np.asarray(b.column("gram")).view(np.uint64)
                for s in slots(h):
                    yield pa.RecordBatch.from_arrays([pa.array(s), b.column("plane"), b.column("bit")], ["slot", "plane", "bit"])

        chosen = counts.filter(F.col("n") >= least).withColumn("k", number).select("gram", F.expr(f"CAST(k DIV {PLANE} AS INT)").alias("plane"), F.expr(f"shiftleft(1L, CAST(k % {PLANE} AS INT))").alias("bit"))
        filled = chosen.mapInArrow(set_slots, "slot long, plane int, bit long").groupBy("slot", "plane").agg(F.bit_or("bit").alias("mask"))
        got = filled.toArrow()
        masks[np.asarray(got.column("plane"), dtype=np.int64), np.asarray(got.column("slot"), dtype=np.int64)] = np.asarray(got.column("mask"), dtype=np.int64)
    release(counts)
    fill = np.array([np.count_nonzero((masks[k // PLANE] >> (k % PLANE)) & 1) / SLOTS for k in range(len(names))])
    return Model(names, masks, fill, default)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (corrected share of the text's n-grams, 0 to 1) of every row.

    Null texts and texts without a letter are 'und' with score 0; texts with letters of which no
    n-gram is known get the language with most training text, with score 0; ties go to the
    first name in order. Repeated rows are judged each for itself; an empty table gives an empty
    result; extra columns are ignored; without training rows everything is 'und'. The filter
    that workers get is at most 8 * SLOTS bytes for each PLANE languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in sliced(batches):
            found = m.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
