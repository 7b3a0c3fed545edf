"""Conversation structure repair: a rank-convergence parallel Viterbi over chunks of turns, traced to the least audit."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.llm.common import release, settled

#: Rows of a chunk, a power of two. Chunks also end with conversations and with the ranges in which rows are sorted.
CHUNK = 4096
#: Costs of an edit, and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, system, user, assistant. From each, the state of the next user or assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs behind the last row: a system or user turn still needs answers.
END = (0, 2 * INSERT, INSERT, 0)
#: Key of a row: its role's initial, in upper case if truncated; x for other roles, D for rows that must go.
WHITE = r" \t\n\u000B\f\r"

Vector = tuple[int, int, int, int]


class Step(NamedTuple):
    """Costs before a row, less those of the state assistant, and that difference."""

    before: Vector
    constant: int


class Viterbi:
    """Backward costs and traces of rows. Costs that differ by a constant are one vector, and only a few vectors exist, so both are looked up."""

    def __init__(self):
        self.steps: dict[tuple[Vector, str], Step] = {}
        self.moves: dict[tuple[Vector, str, int], tuple[str, int]] = {}

    def _uses(self, code: str, state: int) -> Iterator[tuple[str, int, int]]:
        """Edits of a row in their order as letters, each with its cost and the state it leads to."""
        yield "D", DELETE, state
        if code != "D":
            extra, role = (TRUNCATED if code.isupper() else 0), code.lower()
            fits = {"s": state == NOTHING, "u": state != USER, "a": state == USER}.get(role, False)
            if fits:
                yield "K", extra, SYSTEM if role == "s" else NEXT[state]
            yield "R", REROLE + extra, NEXT[state]

    def _costs(self, after: Vector, code: str) -> list[int]:
        """Costs before a row, with inserted turns before it."""
        own = [min(cost + after[to] for _, cost, to in self._uses(code, s)) for s in range(4)]
        return [min(own[s], INSERT + own[NEXT[s]], 2 * INSERT + own[NEXT[NEXT[s]]]) for s in range(4)]

    def step(self, after: Vector, code: str) -> Step:
        known = self.steps.get((after, code))
        if known is None:
            v = self._costs(after, code)
            known = self.steps[after, code] = Step(tuple(x - v[ASSISTANT] for x in v), v[ASSISTANT])
        return known

    def backward(self, codes: str, after: Vector) -> tuple[list[Vector], int]:
        """Vectors before each row and behind the last, and the constants together."""
        vectors, total = [after], 0
        for code in reversed(codes):
            after, constant = self.step(after, code)
            vectors.append(after)
            total += constant
        vectors.reverse()
        return vectors, total

    def move(self, after: Vector, code: str, state: int) -> tuple[str, int]:
        """The least letters among the cheapest edits up to and with a row, and the state behind it."""
        known = self.moves.get((after, code, state))
        if known is None:
            costs, letters, at = self._costs(after, code), "", state
            while True:
                ways = [(o, to) for o, cost, to in self._uses(code, at) if cost + after[to] == costs[at]]
                if INSERT + costs[NEXT[at]] == costs[at]:
                    ways.append(("I", NEXT[at]))
                letter, at = min(ways)
                letters += letter
                if letter != "I":
                    break
            known = self.moves[after, code, state] = (letters, at)
        return known

    def forward(self, codes: str, after: Vector, state: int) -> tuple[list[str], int]:
        """The letters of each row from a state before the first one, and the state behind the last."""
        vectors, out = self.backward(codes, after)[0], []
        for k, code in enumerate(codes):
            letters, state = self.move(vectors[k + 1], code, state)
            out.append(letters)
        return out, state


def ordered(turns: DataFrame) -> DataFrame:
    """ord, conv_id, turn, role and text, nulls one space, written in the order of conv_id, turn, role and text: ord counts up in it.

    Rows are sorted in ranges, so a conversation of very many rows lies in several.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    return settled(turns.select("conv_id", "turn", space("role"), space("text")).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("ord", F.monotonically_increasing_id()), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """ord, conv_id, turn, initial and fault (blank, duplicate, truncated or null) of ordered rows.

    The first of equal rows is found by an aggregate and comes back by its ord, so a text that a conversation repeats often is no hot key.
    """
    ends = F.expr(f"trim(TRAILING '{WHITE}' FROM text)")
    d = rows.select("ord", "conv_id", "turn", "role", F.xxhash64("role", "text").alias("p"), F.xxhash64(F.lit(1), "text", "role").alias("q"), (ends == "").alias("blank"), (~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    first = d.groupBy("conv_id", "p", "q").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    return d.join(first, "ord", "left").select("ord", "conv_id", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault.alias("fault"))


def _chunks(found: DataFrame) -> DataFrame:
    """first (ord of the first row), conv_id, codes, initials and counts of each chunk of rows with their faults."""
    code = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    joined = lambda c: F.array_join(F.transform("l", lambda x: x[c]), "")
    count = lambda c: F.count_if(F.col("fault") == c).alias(c)
    d = found.groupBy("conv_id", F.expr(f"ord DIV {CHUNK}").alias("block")).agg(
        F.min("ord").alias("first"), F.sort_array(F.collect_list(F.struct("ord", code.alias("code"), "initial"))).alias("l"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"), *[count(c) for c in ("blank", "duplicate", "truncated")])
    return d.select("first", "conv_id", joined("code").alias("codes"), joined("initial").alias("initials"), "low", "high", "turns", "blank", "duplicate", "truncated")


def _following(c: Column | str, step: int = 1) -> Column:
    return F.lead(c, step).over(Window.partitionBy("conv_id").orderBy("first"))


def _costed(chunks: DataFrame) -> DataFrame:
    """Chunks with behind, the costs behind their last row, ahead, those before the first, and constant; vectors without their constants.

    Every chunk starts from a speculative vector, zeros, and a conversation's last one from END. A fix-up pass then
    gives each chunk what the following one found; it runs again if that is another vector. Passes end when none is.
    """
    kind = f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}"

    def run(batches):
        viterbi = Viterbi()
        for b in batches:
            out = []
            for codes, want, behind, ahead, constant in zip(*(b.column(c).to_pylist() for c in ("codes", "want", "behind", "ahead", "constant")), strict=True):
                if want != behind:
                    vectors, constant = viterbi.backward(codes, tuple(want))
                    ahead = list(vectors[0])
                out.append((want, ahead, constant))
            behind, ahead, constant = zip(*out, strict=True) if out else ((), (), ())
            vector = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("first"), b.column("codes"), pa.array(behind, vector), pa.array(ahead, vector), pa.array(constant, pa.int64())], ["conv_id", "first", "codes", "behind", "ahead", "constant"])

    def passed(d: DataFrame) -> DataFrame:
        return settled(d.mapInArrow(run, f"{kind}, first long, codes string, behind array<int>, ahead array<int>, constant long"), "costs")

    end = F.array(*[F.lit(x) for x in END])
    none = F.lit(None).cast("array<int>")
    d = passed(chunks.select("conv_id", "first", "codes", F.when(_following("first").isNull(), end).otherwise(F.array(*[F.lit(0)] * 4)).alias("want"), none.alias("behind"), none.alias("ahead"), F.lit(0).cast("long").alias("constant")))
    while True:
        wanted = d.withColumn("want", F.coalesce(_following("ahead"), end))
        if wanted.filter("want <> behind").isEmpty():
            return d
        before, d = d, passed(wanted)
        release(before)


def _entries(costed: DataFrame) -> DataFrame:
    """first and entry, the state before the first row, of the chunks of conversations of several.

    Each chunk tells where it leads from each of the four states; a conversation's chunks, one row for thousands of turns, are then followed in order.
    """
    size = F.count("*").over(Window.partitionBy("conv_id"))
    several = costed.withColumn("n", size).filter("n > 1").select("conv_id", "first", "codes", "behind")

    def leads(batches):
        viterbi = Viterbi()
        for b in batches:
            exits = [[viterbi.forward(codes, tuple(behind), s)[1] for s in range(4)] for codes, behind in zip(b.column("codes").to_pylist(), b.column("behind").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("first"), pa.array(exits, pa.list_(pa.int32()))], ["conv_id", "first", "exits"])

    def follow(batches):
        for b in batches:
            for chunks in b.column("chunks").to_pylist():
                state, entries = NOTHING, []
                for c in chunks:
                    entries.append(state)
                    state = c["exits"][state]
                yield pa.RecordBatch.from_arrays([pa.array([c["first"] for c in chunks], pa.int64()), pa.array(entries, pa.int32())], ["first", "entry"])

    led = several.mapInArrow(leads, f"conv_id {costed.schema['conv_id'].dataType.simpleString()}, first long, exits array<int>")
    return led.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", "exits"))).alias("chunks")).select("chunks").mapInArrow(follow, "first long, entry int")


def _traced(costed: DataFrame) -> DataFrame:
    """conv_id, ord, seq, edit and role of every edit: seq counts the edits of a row, which has its own as the last before inserts at the end."""
    d = costed.withColumn("last", _following("first").isNull()).join(_entries(costed), "first", "left").select("conv_id", "first", "codes", "behind", "last", F.coalesce("entry", F.lit(NOTHING)).alias("entry"))

    def run(batches):
        viterbi = Viterbi()
        for b in batches:
            at, ords, seqs, edits, roles = [], [], [], [], []
            for k, (first, codes, behind, last, state) in enumerate(zip(*(b.column(c).to_pylist() for c in ("first", "codes", "behind", "last", "entry")), strict=True)):
                letters, final = viterbi.forward(codes, tuple(behind), state)
                if last:
                    letters[-1] += "I" * (END[final] // INSERT)
                for j, (code, text) in enumerate(zip(codes, letters, strict=True)):
                    for n, letter in enumerate(text):
                        if letter in "IR":
                            state = NEXT[state]
                        elif letter == "K":
                            state = SYSTEM if code in "sS" else NEXT[state]
                        at.append(k)
                        ords.append(first + j)
                        seqs.append(n)
                        edits.append(letter)
                        roles.append(ROLE[state] if letter in "IR" else None)
            yield pa.RecordBatch.from_arrays([b.column("conv_id").take(pa.array(at, pa.int64())), pa.array(ords, pa.int64()), pa.array(seqs, pa.int32()), pa.array(edits, pa.string()), pa.array(roles, pa.string())], ["conv_id", "ord", "seq", "edit", "role"])

    return d.mapInArrow(run, f"conv_id {costed.schema['conv_id'].dataType.simpleString()}, ord long, seq int, edit string, role string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries of conversations and their cheapest edits, of rows (conv_id, turn, role, text).

    Summaries: conv_id, gaps (turns missing between the least and the greatest), rows whose first fault is blank,
    duplicate or truncated, illegal (neighbours whose initials aren't su, ua or au) and cost. Edits: conv_id, ord and seq (their order), edit
    (K keep, R other role, D delete, I insert), role and text after it. Edits of least cost make the
    initials of roles s?(ua)+ or nothing; of several the one whose letters come first.

    Rows go by turn, nulls first, then by role and text; repeated rows all count. Null roles and texts are one space. Null turns are in no
    gap, rows without conv_id are one conversation. An empty table gives empty results; extra columns are ignored.
    """
    rows = ordered(turns)
    chunks = settled(_chunks(faults(rows)), "chunks")
    costed = _costed(chunks)
    pairs = F.concat("initials", F.coalesce(F.substring(_following("initials"), 1, 1), F.lit("")))
    legal = sum((F.length("pairs") - F.length(F.replace("pairs", F.lit(p), F.lit("")))) / 2 for p in ("su", "ua", "au"))
    again = F.coalesce(_following("high", -1) == F.col("low"), F.lit(False)).cast("long")
    d = chunks.withColumns({"pairs": pairs, "again": again}).withColumn("illegal", F.length("pairs") - 1 - legal)
    d = d.join(costed.select("first", "ahead", "constant"), "first")
    total = lambda c: F.sum(c).cast("long").alias(c)
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.col("again")), F.lit(0)).cast("long").alias("gaps")
    cost = (F.sum("constant") + F.min_by(F.col("ahead")[NOTHING], "first")).cast("long").alias("cost")
    summary = d.groupBy("conv_id").agg(gaps, *[total(c) for c in ("blank", "duplicate", "truncated", "illegal")], cost)
    own = rows.select("ord", F.col("role").alias("own"), "text")
    edits = _traced(costed).join(own, "ord").select("conv_id", "ord", "seq", "edit", F.coalesce("role", "own").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
    return summary, edits


def as_text(edits: DataFrame) -> DataFrame:
    """conv_id, audit (letters in order) and repaired (role:text of the turns that stay, a line each) of edits. A conversation is one string, so it meets in one row."""
    d = edits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("ord", "seq", "edit", "role", "text"))).alias("l"))
    stay = F.transform(F.filter("l", lambda x: x["edit"] != "D"), lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return d.select("conv_id", F.array_join(F.transform("l", lambda x: x["edit"]), "").alias("audit"), F.array_join(stay, "\n").alias("repaired"))
