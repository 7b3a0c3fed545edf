"""Conversation repair, line deduplication and phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import line_dedup, phrases, queries, repair
from rookery.sources.shared import new_path

WHITE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}


def repaired(rows):
    """Rows (conv_id, turn, role, text) by the definition: a dynamic program over whole edit strings."""
    groups = defaultdict(list)
    for c, *row in rows:
        groups[c].append(row)
    out = {}
    for c, group in groups.items():
        turns = sorted(((t, " " if a is None else a, " " if x is None else x) for t, a, x in group), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, a, x in turns:
            end = x.rstrip(WHITE)
            faults.append("blank" if not end else "duplicate" if (a, x) in seen else "truncated" if end[-1] not in ".!?" else None)
            seen.add((a, x))
        known = {t for t, _, _ in turns} - {None}
        illegal = sum(p[1][:1] + q[1][:1] not in ("su", "ua", "au") for p, q in zip(turns, turns[1:], strict=False))

        def inserted(states):
            for _ in range(2):
                for s, (cost, audit, said) in list(states.items()):
                    way = (cost + 2, audit + "I", (*said, ROLE[NEXT[s]] + ":"))
                    states[NEXT[s]] = min(way, states.get(NEXT[s], way))
            return states

        states = {0: (0, "", ())}
        for (_, a, x), fault in zip(turns, faults, strict=True):
            new = {}
            for s, (cost, audit, said) in inserted(states).items():
                ways = [(s, (cost + 3, audit + "D", said))]
                if fault not in ("blank", "duplicate"):
                    more = cost + (fault == "truncated")
                    fits = {"s": s == 0, "u": s != 2, "a": s == 2}.get(a[:1], False)
                    ways += [(1 if a[:1] == "s" else NEXT[s], (more, audit + "K", (*said, f"{a}:{x}")))] if fits else []
                    ways.append((NEXT[s], (more + 2, audit + "R", (*said, f"{ROLE[NEXT[s]]}:{x}"))))
                for to, way in ways:
                    new[to] = min(way, new.get(to, way))
            states = new
        cost, audit, said = min(v for s, v in inserted(states).items() if s in (0, 3))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(said))
    return out


def by_operator(turns):
    summary, edits = repair.repair(turns)
    texts = {r.conv_id: (r.audit, r.repaired) for r in repair.as_text(edits).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, *texts[r.conv_id]) for r in summary.collect()}


TURNS = "conv_id long, turn long, role string, text string"
SAID = ["Ok.", "No", "", " \n", "Yes!", "x y z?", "Same.", None]


def random_turns(seed, sizes):
    r = random.Random(seed)
    return [(c, r.choice([None, j, j, j // 2]), r.choice(["user", "assistant", "system", "tool", "user", "assistant", None, "User", ""]), r.choice(SAID) if r.random() < 0.4 else f"text {j}" + r.choice([".", "", ".  "]))
            for c, n in sizes for j in range(n)]


@pytest.mark.parametrize("chunk", [2, 8, 4096])
def test_repair_is_the_least_of_all(spark, monkeypatch, chunk):
    """Chunks of any size give what one program over the whole conversation does; null ids, turns, roles and texts, ties and repeated rows."""
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = random_turns(chunk, [(None, 7), (1, 1), (2, 40), (3, 300), (4, 2)])
    rows += rows[:3] + [(5, 0, "system", "Alone."), (6, 0, "user", ""), (6, 1, "user", "")]
    d = spark.createDataFrame(rows, TURNS).withColumns({"first": F.lit("clash"), "ord": F.lit(1), "cost": F.lit(2)})
    assert by_operator(d) == repaired(rows)
    assert by_operator(d.limit(0)) == {}


def test_repair_of_a_long_conversation(spark, monkeypatch):
    """One conversation holds most rows: chunks of it agree after fix-up passes, whatever they started from."""
    monkeypatch.setattr(repair, "CHUNK", 64)
    rows = random_turns(9, [(1, 3000), (2, 5)]) + [(3, j, "user", f"u{j}.") for j in range(400)] + [(4, j, "assistant", "") for j in range(200)]
    assert by_operator(spark.createDataFrame(rows, TURNS)) == repaired(rows)


def test_repair_of_every_short_conversation(spark):
    """All role sequences up to four turns, with a truncated and a blank one."""
    rows, c = [], 0
    for n in range(1, 5):
        for code in range(5**n):
            for j in range(n):
                role, text = [("user", f"{j}."), ("assistant", f"{j}."), ("system", f"{j}."), ("user", f"{j}"), ("assistant", "")][code // 5**j % 5]
                rows.append((c, j, role, text))
            c += 1
    assert by_operator(spark.createDataFrame(rows, TURNS)) == repaired(rows)


def test_damage(spark):
    """Each kind of damage is there, by the checksum of conv_id and turn; conversations that lose all rows are returned."""
    import zlib

    rows = [(c, t, "assistant" if t % 2 else "user", f"Said {c} {t}. So!") for c in range(40) for t in range(3)] + [(40, None, None, None)]
    got = Counter(tuple(r) for r in queries.damaged(spark.createDataFrame(rows, TURNS)).collect())
    want = Counter()
    for c, t, a, x in rows:
        k = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        a, x = " " if a is None else a, " " if x is None else x
        row = (c, t, "user" if k == 4 else a, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)
        want[row] += {0: 0, 3: 2}.get(k, 1)
    assert got == +want and {zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, *_ in rows} >= {0, 1, 2, 3, 4}


def deduped(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(WHITE).translate(FOLD)
    holders = defaultdict(set)
    for k, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(k)
    top = {k: max((rows[j][0] for j in v if rows[j][0] is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in top and top[key(x)] != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def line_rows(seed):
    r = random.Random(seed)
    pool = ["A line that many documents share, of more than forty code points", "  another ONE of them, é and ü, with blanks at both of its ends\t", "short line", "", "x" * 39, "x" * 40, "Ünicode ÄÖ stays as it is, only A to Z are folded here"]
    pool += [f"line {k} of few documents, with over forty code points in it" for k in range(20)]
    rows = [(k, "\n".join(r.choice([x, x, x.upper() if x.isascii() else x, x + " "]) for x in r.choices(pool, k=r.randint(0, 12)))) for k in range(60)]
    return rows + [(None, pool[0]), (None, pool[0]), (7, None), (8, ""), (59, pool[0] + "\n" + pool[0]), (59, "x" * 40), rows[3], (61, "\n".join(f"a long text's line number {k} is unlike any other" for k in range(30_000)) + "\n" + pool[0])]


@pytest.mark.parametrize("few", [True, False])
def test_line_dedup(spark, monkeypatch, few):
    """By broadcast or by shuffle: what the definition says, for nulls, ties, repeated rows and a text of 1.5 MB."""
    if not few:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 1)
    rows = line_rows(3)
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("clash"), "n": F.lit(1), "top": F.lit(2)})
    for batches in (1, 5):
        assert Counter(map(tuple, line_dedup.dedup_lines(d, batches=batches).collect())) == deduped(rows)
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0
    named = spark.createDataFrame([(f"d{k}", t) for k, t in rows[:40]], "doc_id string, text string")
    assert Counter(map(tuple, line_dedup.dedup_lines(named).collect())) == deduped([(f"d{k}", t) for k, t in rows[:40]])


def test_line_runs_by_batch(spark):
    """Runs are compacted, a batch that comes again isn't counted again, and a store that is opened again goes on."""
    rows = line_rows(5)[:60]
    hashes = line_dedup.line_hashes(spark.createDataFrame(rows, "doc_id long, text string"), 40).cache()
    path = new_path(spark, "runs")
    runs = line_dedup.Runs(spark, path, 4, 5)
    for k in range(3):
        runs.add(k, hashes.filter(F.col("doc_id") % 6 == k))
    runs = line_dedup.Runs(spark, path, 4, 5)
    for k in range(6):
        runs.add(k, hashes.filter(F.col("doc_id") % 6 == k))
    assert [(r.level, r.first, r.last) for r in runs.runs] == [(1, 0, 3), (0, 4, 4), (0, 5, 5)] or sorted((r.first, r.last) for r in runs.runs) == [(0, 3), (4, 4), (5, 5)]
    want = {tuple(r) for r in hashes.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).filter("n >= 5").select("h", "g", "top").collect()}
    assert want and {tuple(r) for r in runs.repeated().collect()} == want
    runs.drop()
    hashes.unpersist()


def collocated(rows, min_count, max_words, top):
    counts, total = defaultdict(Counter), Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(FOLD)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if a >= min_count and len(p) > 1}
        inside = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * c[p[i:j]]}
        found = []
        for p, a in often.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, n, p.decode(), -a, left, right, total[lang], -score) for n, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_collocations(spark, monkeypatch, block):
    """Small blocks of text and of the word stream give the same; overlaps, ties, nulls, odd bytes and a text of a megabyte without an end of a piece."""
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "MERGE_ROWS", 10)
    monkeypatch.setattr(phrases, "RUN_ROWS", 50)
    r = random.Random(block)
    words = ["the", "The", "of", "new", "york", "times", "ÉTÉ", "a", "a", "b-c", " x", "中", "😀"]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 60))) + r.choice([".", "\n", ", ", "\t"]) + " ".join(r.choices(words[:6], k=20)), r.choice(["en", "fr", None])) for _ in range(60)]
    rows += [(None, "en"), ("", "en"), (None, None), ("a a a a a a", "aa"), rows[0], ("x" * 3000 + " y", "fr"), (" ".join(f"w{k % 7}" for k in range(300_000)), "en")]
    d = spark.createDataFrame(rows, "text string, lang string").withColumns({"doc_id": F.lit(None).cast("long"), "w": F.lit("clash"), "f": F.lit(1), "n": F.lit(2)})
    got = sorted(map(tuple, phrases.collocations(d, 3, 5, 25).collect()))
    assert got == collocated(rows, 3, 5, 25) and len({x[0] for x in got}) == 4
    assert phrases.collocations(d.limit(0), 3).count() == 0


def test_only_words_of_the_best_are_spelled(spark, monkeypatch):
    """Frequent words that no best phrase holds are not spelled, and ties by score and count still go by spelling."""
    rows = [(" ".join(f"{x}{k}" for x in "abc") + ". " + " ".join(f"p{i} q{i}." for i in range(40)), "en") for k in range(4) for _ in range(4)]
    seen, kept = {}, phrases.settled

    def noted(df, name, *more):
        d = kept(df, name, *more)
        seen[name] = d.collect()
        return d

    monkeypatch.setattr(phrases, "settled", noted)
    got = sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, "text string, lang string").withColumn("doc_id", F.lit(1)), 4, 5, 4).collect()))
    assert got == collocated(rows, 4, 5, 4) and len(got) == 4
    assert {r["word"] for r in seen["spelled"]} == {f"{x}{k}" for x in "abc" for k in range(4)}


def test_scores_beyond_64_bits(spark):
    """1000 a n and l r may both pass 64 bits; the score is exact."""
    a, n = 3_000_000_000_000_000, 9_000_000_000_000_000
    stream = spark.createDataFrame([("x", [1], a + 7), ("x", [2], a + 11), ("x", [1, 2], a)], "lang string, w array<long>, f long")
    r = phrases._cut_scores(stream, spark.createDataFrame([("x", n)], "lang string, n long")).first()
    assert r.score == 1000 * a * n // ((a + 7) * (a + 11)) and (r.l, r.r) == (a + 7, a + 11)


def test_word_hashes_of_blocks(monkeypatch):
    """Cuts between blocks change neither words nor pieces."""
    r = np.random.default_rng(1)
    data = bytes(r.choice(list(b"abc  \t.\n"), 5000).astype(np.uint8).tolist())
    whole = phrases.words_of(data)
    monkeypatch.setattr(phrases, "BLOCK", 37)
    for a, b in zip(whole, phrases.words_of(data), strict=True):
        assert (a == b).all()
    spelled = [data[s:e] for s, e in zip(whole[2], whole[3], strict=True)]
    assert spelled == re.findall(rb"[^ \t.,;:!?\n-\r]+", data) and len(set(spelled)) == len(set(whole[0].tolist()))
