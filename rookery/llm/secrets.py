"""Secret scan: spans of credentials, and weak parts that are credentials only beside one another."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """Matches of pattern, leftmost and without overlap, whose group has from least to most characters.

    guard is a cheaper expression that every match implies.
    """

    name: str
    pattern: str
    group: int
    least: int
    most: int
    guard: str


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: In the order in which spans of one start are listed. Runs are greedy, so asking for the least length inside
#: the pattern finds the same ones as dropping short matches; for assignments it doesn't, so those are dropped after.
BASE = (
    Kind("assign", ASSIGN, 2, 12, 1 << 30, "(?i:password|passwd|secret|token|api_?key)"),
    Kind("access", r"(AKIA[A-Z0-9]{14,})", 1, 18, 1 << 30, "AKIA[A-Z0-9]{14}"),
    Kind("hex", r"([0-9a-f]{16,})", 1, 16, 1 << 30, "[0-9a-f]{16}"),
)
#: Parts that mean nothing alone.
WEAK = (
    Kind("secret", r"([A-Za-z0-9+/]{40,})", 1, 40, 40, "AKIA[A-Z0-9]{14}"),
    Kind("endpoint", r"(https?://[A-Za-z0-9.-]+)", 1, 10, 1 << 30, "AKIA[A-Z0-9]{14}"),
)
KINDS = BASE + WEAK
#: Code points between the parts of one credential: from the end of the one to the start of the other, at most.
SCOPE = 256


def _matches(text: Column, order: int, k: Kind) -> Column:
    """Match number, code points since the match before, of the match, and of its group."""
    pattern = F.lit(k.pattern)
    between = F.split(text, k.pattern, -1)
    # The whole match and its group, one beside the other.
    zipped = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"), F.regexp_extract_all(text, pattern, F.lit(k.group)).alias("part"))
    found = F.transform(
        F.filter(zipped, lambda x: x["all"].isNotNull()),
        lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("all"), F.length(x["part"]).alias("part")),
    )
    return F.when(text.rlike(k.guard), found)


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and spans, array of (start, kind number in KINDS, end, id_start), ordered; code points, end exclusive.

    Base spans always stay. A weak secret is listed if an access identifier lies within its scope: beside it,
    at most scope code points away. An endpoint is listed if both an access identifier and a
    secret do; that may be a weak secret, an assignment or a hex run, but none that overlaps an identifier. So no part
    is its own complement: parts of a credential never overlap. id_start is where the identifier starts
    that a weak span goes with, the nearest one, of two equally near the earlier; null for base spans.

    That interval join is a range frame on either side over the spans of a row: parts in the order of their ends
    before the span's start, in the order of their starts behind its end. No pair is ever written out.

    Null and empty texts have no spans. Every input row gives one row, repeated rows too; an
    empty table gives an empty result; extra columns are ignored. Texts do not leave the scan:
    only spans are shuffled.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,all:int,part:int>>")
    found = [F.coalesce(_matches(F.col("text"), n, k), empty) for n, k in enumerate(KINDS)]
    d = d.select("row", "doc_id", F.explode_outer(F.concat(*found)).alias("m")).select("row", "doc_id", "m.*")
    # Where a match ends: all that stands up to it, summed over the matches of its kind.
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    least, most = (F.create_map(*[F.lit(x) for n, k in enumerate(KINDS) for x in (n, getattr(k, side))])[F.col("kind")] for side in ("least", "most"))
    d = d.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("all")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("all"))
    real = F.coalesce(F.col("part").between(least, most), F.lit(False))
    d = d.filter(real | F.col("kind").isNull() | (F.col("i") == 0))

    number = {k.name: n for n, k in enumerate(KINDS)}
    is_id, is_weak = real & (F.col("kind") == number["access"]), real & (F.col("kind") >= len(BASE))
    # A weak span asks for parts; all spans but endpoints are parts. A weak secret is both, in two rows.
    d = d.withColumn("asks", F.explode(F.when(is_weak & (F.col("kind") == number["secret"]), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.coalesce(is_weak, F.lit(False))))))
    d = d.withColumns({"before": F.when(F.col("asks"), F.col("start")).otherwise(F.col("end")), "behind": F.when(F.col("asks"), F.col("end")).otherwise(F.col("start"))})
    ordered = lambda by: Window.partitionBy("row").orderBy(by)
    overlap = ordered(F.when(is_id, F.col("start")).otherwise(F.col("end"))).rangeBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("id_end", F.last(F.when(is_id, F.col("end")), True).over(overlap))
    near, far = ordered("before").rangeBetween(-scope, 0), ordered("behind").rangeBetween(0, scope)
    is_secret = real & ~F.col("asks") & ~is_id & (F.coalesce("id_end", F.lit(0)) <= F.col("start"))
    the_id = F.when(is_id, F.struct("start", "end"))
    d = d.withColumns({"id_before": F.last(the_id, True).over(near), "secret_before": F.max(is_secret).over(near), "id_behind": F.first(the_id, True).over(far), "secret_behind": F.max(is_secret).over(far)})
    earlier = F.col("id_behind").isNull() | (F.col("start") - F.col("id_before.end") <= F.col("id_behind.start") - F.col("end"))
    with_id = F.when(F.col("asks"), F.when(F.col("id_before").isNotNull() & earlier, F.col("id_before.start")).otherwise(F.col("id_behind.start")))
    complete = with_id.isNotNull() & ((F.col("kind") == number["secret"]) | F.col("secret_before") | F.col("secret_behind"))
    listed = real & F.when(F.col("asks"), complete).otherwise(F.col("kind") < len(BASE))
    spans = F.sort_array(F.collect_list(F.when(listed, F.struct("start", "kind", "end", with_id.alias("id_start")))))
    return d.groupBy("row").agg(F.first("doc_id").alias("doc_id"), spans.alias("spans")).drop("row")


def spelled(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))
