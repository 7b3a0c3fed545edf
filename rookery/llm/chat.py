"""Chat formatting: conversations of typed content parts as one string with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Placeholder of each kind of part, and tokens for one and for each of its units
#: (image tiles, seconds of audio, document pages).
ATTACHMENTS = {"image": ("<|image|>", 85, 170), "audio": ("<|audio|>", 0, 25), "document": ("<|document|>", 16, 512)}
#: What learns.
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    """No control string is left: each '<', then backslashes, then '|' gets one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _flat(parts: Column) -> Column:
    """Visits the parts in order: escaped text, or the placeholder of an attachment; an unknown type counts as text."""
    def visit(p: Column) -> Column:
        out = F.coalesce(escape(p["text"]), F.lit(""))
        for kind, (mark, _, _) in ATTACHMENTS.items():
            out = F.when(p["type"] == kind, F.lit(mark)).otherwise(out)
        return out

    return F.array_join(F.transform(parts, visit), "")


def _attached(parts: Column) -> Column:
    """Attachments in order, with their tokens when expanded."""
    def tokens(p: Column) -> Column:
        out = F.lit(0).cast("long")
        for kind, (_, base, each) in ATTACHMENTS.items():
            out = F.when(p["type"] == kind, F.lit(base) + F.coalesce(p["units"], F.lit(0)) * each).otherwise(out)
        return out.cast("long")

    return F.transform(F.filter(parts, lambda p: p["type"].isin(*ATTACHMENTS)), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("n_tokens")))


def text_part(text: Column) -> Column:
    """A text as the only part of its turn."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("units")))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row a conversation from rows (conv_id, turn, role, parts array<struct<type, text, ref, units>>).

    formatted: for each turn the start mark, role, line feed, content, end mark, line feed.
    loss_spans: (start, end), code points of each assistant content in formatted, end exclusive.
    attachments: type, ref and expanded n_tokens of each placeholder, in the order of the placeholders.
    n_expanded: their tokens together.

    Turns are in order of turn, nulls first; of equal turns role and content decide, and
    repeated rows all stay. Null roles, texts and parts are empty. An empty table gives an empty
    result; extra columns are ignored. A conversation is one string, so it meets in one row;
    nothing larger ever does.
    """
    role = F.regexp_replace(escape(F.coalesce(F.col("role").cast("string"), F.lit(""))), "\n", LINE)
    flat = F.coalesce(_flat(F.col("parts")), F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), flat.alias("content"), _attached(F.col("parts")).alias("attached"))
    # Where a turn starts: the lengths of those before it.
    size = F.length("role") + F.length("content") + len(START) + len(END) + 2
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "attached").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int"))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "content", "attached"))).alias("turns"))
    said = F.transform("turns", lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["content"], F.lit(END + "\n")))
    c = c.withColumn("formatted", F.array_join(said, ""))
    start = lambda x: x["at"] + len(START) + F.length(x["role"]) + 1
    spans = F.transform(F.filter("turns", lambda x: x["role"].isin(*LEARNED)), lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["content"])).alias("end")))
    c = c.withColumn("loss_spans", spans)
    c = c.withColumn("attachments", F.flatten(F.transform("turns", lambda x: F.coalesce(x["attached"], F.array().cast("array<struct<type:string,ref:string,n_tokens:bigint>>")))))
    return c.select("conv_id", "formatted", "loss_spans", "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("n_expanded"))


def read_turns(formatted: Column) -> Column:
    """Back from formatted: array of (role, text), unescaped; placeholders stay as they are."""
    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(head) + 2, F.length(x) - F.length(head) - 2 - len(END))
        return F.struct(unescape(F.replace(head, F.lit(LINE), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    pieces = F.split(formatted, START.replace("|", r"\|"), -1)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
