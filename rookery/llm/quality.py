"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import texts

#: Frequent function words of the languages that the rules should let through. Fixed values.
STOP_WORDS = (
    "the of and to in is it for on with as that this be are was by from at or an a have not "
    "der die das und ist zu den mit ein eine von für auf nicht im "
    "le la les de des et un une est que qui du en dans pour sur pas au "
    "el los las y es por con una para se su del no lo"
).split()

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
_OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Rule:
    """A document stays if 'measure op bound' holds."""

    name: str
    measure: str
    op: str
    bound: float


#: Ratios are per word, or per non-blank line for dup_line_ratio.
DEFAULT_RULES = (
    Rule("mean_word_min", "mean_word", ">=", 2.0),
    Rule("mean_word_max", "mean_word", "<=", 12.0),
    Rule("symbols", "symbol_ratio", "<=", 0.1),
    Rule("stop_words", "stop_ratio", ">=", 0.01),
    Rule("dup_lines", "dup_line_ratio", "<=", 0.4),
)


#: Bits of a packed window that hold its position; the others hold its hash.
POSITION_BITS = 24


def _repeated_at(d: DataFrame) -> DataFrame:
    """d, which has words w, with spots: the ordered positions of 3-word windows found twice or more.

    Hash and position of a window share a long, so a sort of plain longs puts equal windows side
    by side; their words confirm them. Where two different windows share the short hash, or
    positions don't fit, the row sorts the windows themselves instead. No window leaves its row.
    """
    at = lambda i: F.get("w", i)
    packed = lambda k: F.get("p", k)
    position = lambda k: packed(k).bitwiseAND((1 << POSITION_BITS) - 1).cast("int")
    same = lambda i, j: (at(i) == at(j)) & (at(i + 1) == at(j + 1)) & (at(i + 2) == at(j + 2))
    n = F.greatest(F.size("w") - 2, F.lit(0))
    windows = F.slice("w", F.lit(1), n)
    pack = lambda x, i: F.shiftleft(F.shiftright(F.xxhash64(x, at(i + 1), at(i + 2)), POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long"))
    d = d.withColumn("p", F.sort_array(F.transform(windows, pack)))
    # Places whose hash is that of the place before.
    beside = F.filter(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.shiftrightunsigned(packed(k).bitwiseXOR(packed(k - 1)), POSITION_BITS) == 0)
    d = d.withColumn("k", F.when(F.size("p") > 1, beside).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("sure", F.filter("k", lambda k: same(position(k), position(k - 1))))
    unsure = (n >= (1 << POSITION_BITS)) | (F.size("sure") < F.size("k"))
    d = d.withColumn("q", F.when(unsure, F.sort_array(F.transform(windows, lambda x, i: F.struct(F.concat_ws(" ", x, at(i + 1), at(i + 2)).alias("s"), i.alias("i"))))))
    whole = lambda x, k: F.coalesce(x["s"] == F.get("q", k)["s"], F.lit(False))
    exact = F.transform(F.filter("q", lambda x, k: whole(x, k - 1) | whole(x, k + 1)), lambda x: x["i"])
    both = F.transform(F.array_distinct(F.concat("sure", F.transform("sure", lambda k: k - 1))), position)
    return d.withColumn("spots", F.sort_array(F.coalesce(exact, both))).drop("p", "q", "k", "sure")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and, as a struct, the whole row, with every count that rules refer to; a null text counts as empty."""
    d = texts(docs, F.struct(*docs.columns).alias("row")).select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("row", "doc_id", "text", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("w"),
                 F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    d = d.select(
        "row", "doc_id", "w", F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    # A window at a spot covers three words, less what the one before it has covered.
    covers = F.transform("spots", lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get("spots", k - 1))))
    # The id makes the count one that the optimizer evaluates once, here. A filter on a verdict would else be
    # moved down to the scan, with all that it rests on repeated inside it many times over.
    here = F.monotonically_increasing_id() >= 0
    d = _repeated_at(d).withColumn("n_repeat_words", F.when(here, F.aggregate(covers, F.lit(0), lambda a, x: a + x).cast("long")))
    return d.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _judged(docs: DataFrame, rules: tuple[Rule, ...], min_words: int, max_repeat: int) -> DataFrame:
    m = measures(docs)
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    ratio = {
        "mean_word": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "stop_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "n_words": F.col("n_words"),
    }
    failed = F.filter(F.array(*[F.when(~_OPS[r.op](ratio[r.measure], F.lit(r.bound)), F.lit(r.name)) for r in rules], F.lit(None).cast("string")), lambda x: x.isNotNull())
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return m.withColumns({"base_failed": base, "failed_rules": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """One row a document: counts, base_failed, the names of the failed rules, and kept.

    base_failed: fewer than min_words words, or over max_repeat per cent of the words in
    repeated 3-word windows. kept: not base_failed and every rule holds.
    Null and empty texts have zero counts, fail the base and so aren't kept. Repeated rows are
    judged row by row; an empty table gives an empty result; extra columns are ignored.
    """
    return _judged(docs, rules, min_words, max_repeat).drop("row")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """The rows, with all their columns, of the documents that judge() keeps."""
    return _judged(docs, rules, min_words, max_repeat).filter("kept").select("row.*")
