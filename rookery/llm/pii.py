"""Personal data: detected entities get keyed surrogates of the same type, format, gender and script."""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rookery.llm.common import fresh, settled, sliced, texts

#: Entities with another surrogate than their first one that may be broadcast; more are joined.
BROADCAST_ENTITIES = 100_000
#: Surrogates that are tried for an entity.
ATTEMPTS = 200

#: Titles by gender; the name after one is a person's. Fixed values.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "Г-н", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Fräulein", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Signora", "Г-жа", "Госпожа", "Κυρία"),
    "x": ("Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Доктор", "Профессор"),
}
#: Syllable parts of invented names by script, and endings by gender. Fixed values.
SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"m": ("an", "or", "es"), "f": ("a", "ia", "e"), "x": ("en", "is", "o")}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": ("ов", "ин", "ев"), "f": ("ова", "ина", "ева"), "x": ("ко", "ян", "их")}),
    "greek": ("βγδζκλμνπρστ", "αεηιο", {"m": ("ος", "ης", "ας"), "f": ("α", "η", "ου"), "x": ("ου", "ι", "ων")}),
}

_TITLE = "|".join(sorted((re.escape(t) for v in TITLES.values() for t in v), key=len, reverse=True))
_GENDER = {t: g for g, v in TITLES.items() for t in v}
_NAME = r"[^\W\d_a-zß-öø-ÿа-яёα-ωά-ώ][^\W\d_]+"
#: Titles without gender may stand between another title and the name.
_RANK = "|".join(re.escape(t) for t in TITLES["x"])
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: In order of precedence: an entity never overlaps one of an earlier kind. A text without the hint has none.
PATTERNS: tuple[tuple[str, str, re.Pattern], ...] = (
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")),
    ("ip", ".", re.compile(rf"(?<![\w.-]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w-]|\.\d)")),
    ("ipv6", ":", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")),
    ("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("card", "", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("ssn", "-", re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")),
    ("phone", "", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?![\w-])|(?<![\w.+-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.+/-])0\d{1,4}(?:([ .-])\d{2,4})(?:\1\d{2,4}){1,3}(?![\w-]|[./]\d)")),
    ("name", "", re.compile(rf"(?<!\w)({_TITLE})\.? (?:(?:{_RANK})\.? )*((?!(?:{_RANK})(?!\w))(?:{_NAME})(?: (?:{_NAME}))?)")),
)
_DIGIT = re.compile(r"\d")
#: Separators at which a match that isn't valid as a whole may end, by kind.
CUTS = {"card": re.compile("[ -]"), "iban": re.compile(" "), "phone": re.compile("[ .-]")}
#: Issuer numbers, and how cards are grouped; parts of a longer run of digits have to look like one.
_ISSUER = re.compile(r"3[04-9]|[456]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)")
_CARD_SHAPE = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5}")
#: Characters of an IBAN by country. Fixed values; other countries have 15 to 34.
IBAN_CHARS = {k: int(n) for k, n in (x.split(":") for x in (
    "AD:24 AE:23 AT:20 BE:16 BG:22 BR:29 CH:21 CY:28 CZ:24 DE:22 DK:18 EE:20 ES:24 FI:18 FR:27 GB:22 GR:27 HR:21 HU:28 IE:22 IL:23 IS:26 IT:27 LI:21 LT:20 "
    "LU:20 LV:21 MC:27 MT:31 NL:18 NO:15 PL:28 PT:25 RO:24 RS:22 SA:24 SE:24 SI:19 SK:24 TR:26 UA:29"
).split())}
#: Digits of a whole number, least and most, by country code. Fixed values; other codes have 8 to 15.
PHONE_DIGITS = {
    "1": (11, 11), "7": (11, 11), "20": (11, 12), "27": (11, 11), "30": (12, 12), "31": (11, 11), "32": (10, 11), "33": (11, 11), "34": (11, 11), "36": (10, 11),
    "39": (8, 13), "40": (11, 11), "41": (11, 11), "43": (8, 15), "44": (11, 12), "45": (10, 10), "46": (9, 12), "47": (10, 10), "48": (11, 11), "49": (8, 13),
    "51": (10, 11), "52": (12, 13), "54": (12, 13), "55": (12, 13), "56": (11, 11), "57": (12, 12), "58": (12, 12), "60": (10, 12), "61": (11, 11), "62": (10, 14),
    "63": (11, 12), "64": (10, 12), "65": (10, 10), "66": (10, 11), "81": (11, 12), "82": (10, 12), "84": (11, 12), "86": (12, 13), "90": (12, 12), "91": (12, 12),
    "92": (11, 12), "98": (12, 12), "351": (12, 12), "353": (10, 12), "380": (12, 12), "420": (12, 12), "421": (12, 12), "852": (11, 11), "971": (11, 12), "972": (11, 12),
}
_WORD = re.compile(r"[^\W\d_]+")
_BARE = re.compile(_NAME)
_TITLED = re.compile(rf"(?<!\w)(?:{_TITLE})\.? ")


@dataclass(frozen=True)
class Entity:
    """kind is a pattern's name, for names with gender and script; key is equal for all ways to write the entity."""

    start: int
    end: int
    kind: str
    key: str
    surface: str


def luhn(digits: str) -> int:
    """The last digit that makes digits a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return next((s for s in ("cyrillic", "greek") if name.startswith(s.upper())), "latin")


def _ipv6(surface: str) -> str | None:
    """The address in full, if surface is one and no clock time, path or lone prefix."""
    if not any(c.isdigit() for c in surface) or sum(map(bool, surface.split(":"))) < 3:
        return None
    try:
        return ipaddress.IPv6Address(surface).exploded
    except ValueError:
        return None


def _valid(kind: str, surface: str) -> str | None:
    """The entity's key, or None if its check digits or its length are wrong."""
    plain = re.sub(r"[^A-Za-z0-9]", "", surface)
    if kind == "card":
        return plain if len(set(plain)) > 1 and luhn(plain[:-1]) == int(plain[-1]) else None
    if kind == "iban":
        return plain if 15 <= len(plain) <= 34 and mod97(plain) == 1 else None
    if kind == "phone":
        # A number of ten digits without a country code or a trunk zero is of the numbering plan that has code 1.
        key = plain if surface[0] in "+0" else "1" + plain
        return key if (10 <= len(plain) <= 11 if surface[0] == "0" else 8 <= len(plain) <= 15) else None
    if kind == "ipv6":
        return _ipv6(surface)
    return surface.lower() if kind == "email" else surface if kind == "ip" else plain


def _plausible(kind: str, surface: str) -> bool:
    """Whether a part of a match may be the entity, by what its kind has besides check digits."""
    plain = re.sub(r"[^A-Za-z0-9]", "", surface)
    if kind == "card":
        return 13 <= len(plain) <= 19 and bool(_ISSUER.match(plain))
    if kind == "phone":
        least, most = next((PHONE_DIGITS[plain[:n]] for n in (1, 2, 3) if plain[:n] in PHONE_DIGITS), (8, 15)) if surface[0] == "+" else (10, 11) if surface[0] == "0" else (10, 10)
        return least <= len(plain) <= most
    return len(plain) == IBAN_CHARS.get(plain[:2], len(plain))


def _accepted(kind: str, surface: str, free: Callable[[int], bool], inside: bool) -> tuple[int, str] | None:
    """Length and key of the entity that surface begins with.

    That is the whole of it or, where a neighbouring number or word was matched with it, a part
    that ends at a separator: the longest valid one, grouped cards and lengths that are known first. free says whether a length overlaps nothing; inside, whether the match starts within one that failed.
    """
    whole = len(surface)
    ends = [whole, *sorted((m.start() for m in CUTS[kind].finditer(surface)), reverse=True)] if kind in CUTS else [whole]
    tries = [n for n in ends if n == whole or _plausible(kind, surface[:n])]
    if kind == "card":
        shaped = [n for n in tries if _CARD_SHAPE.fullmatch(surface[:n]) and _ISSUER.match(surface)]
        tries = shaped if inside else shaped + [n for n in tries if n not in shaped]
    elif kind in CUTS:
        tries.sort(key=lambda n: not _plausible(kind, surface[:n]))
    for n in tries:
        key = _valid(kind, surface[:n])
        if key is not None and free(n):
            return n, key
    return None


#: Names that are words or months as well. Fixed values.
WORDS_TOO = frozenset("will may mark bill rose hope grace faith dawn joy art frank june april august summer chance young long rich".split())
#: The end of what comes before a sentence.
_SENTENCE = re.compile(r"(?:\A|[.!?:]|\n)[\s\"'(\u201c\u00ab]*\Z")


class Taken:
    """Spans that don't overlap, for quick questions whether another one is free of them."""

    def __init__(self, found: list[Entity]):
        spans = sorted((e.start, e.end) for e in found)
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def free(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end) - 1
        return k < 0 or self.ends[k] <= start


def _names(text: str, pattern: re.Pattern, taken: Taken) -> list[Entity]:
    """Every mention, with a title or bare, of the words that stand behind a title somewhere in the text.

    A word has the gender of its titles in the text; x, if they differ or none has one. A bare mention
    is the whole word with a capital; one of WORDS_TOO only inside a sentence, as a plain word begins one with a capital.
    """
    genders: dict[str, set[str]] = {}
    starts: set[int] = set()
    for m in pattern.finditer(text):
        at = m.start(2)
        for word in m[2].split(" "):
            if taken.free(at, at + len(word)):
                genders.setdefault(word.casefold(), set()).update({_GENDER[m[1]]} - {"x"})
                starts.add(at)
            at += len(word) + 1
    found = []
    if not genders:
        return found
    for m in _WORD.finditer(text):
        key = m[0].casefold()
        if key in genders and (m.start() in starts or (_BARE.match(m[0]) and not (key in WORDS_TOO and _SENTENCE.search(text, max(0, m.start() - 8), m.start())))) and taken.free(m.start(), m.end()):
            gender = next(iter(genders[key])) if len(genders[key]) == 1 else "x"
            found.append(Entity(m.start(), m.end(), f"name/{gender}/{script_of(m[0])}", key, m[0]))
    return found


def find_entities(text: str | None) -> list[Entity]:
    """Entities of a text in order, without overlap."""
    if not text:
        return []
    found: list[Entity] = []
    digits, taken = bool(_DIGIT.search(text)), Taken([])
    for kind, hint, pattern in PATTERNS:
        if (hint and hint not in text) or (kind not in ("email", "name") and not digits) or (kind == "name" and not _TITLED.search(text)):
            continue
        if kind == "name":
            found += _names(text, pattern, taken)
            continue
        at = failed = 0
        while m := pattern.search(text, at):
            start = m.start()
            done = _accepted(kind, m[0], lambda n, s=start: taken.free(s, s + n), start < failed)
            if done:
                at = start + done[0]
                found.append(Entity(start, at, kind, done[1], text[start:at]))
            else:
                at, failed = (start + 1, max(failed, m.end())) if kind in CUTS else (m.end(), 0)
        taken = Taken(found)
    return sorted(found, key=lambda e: e.start)


class Stream:
    """Numbers that depend on the secret, the entity and the attempt alone."""

    def __init__(self, secret: bytes, *what: str):
        self.seed, self.what, self.left, self.turn = secret, "\x00".join(what).encode(), b"", 0

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.seed, self.what + self.turn.to_bytes(4, "big"), hashlib.sha256).digest()
            self.turn += 1
        head, self.left = self.left[:4], self.left[4:]
        return int.from_bytes(head, "big") % n

    def alike(self, plain: str) -> str:
        """Digits for digits, letters for letters of the same case; other characters stay."""
        out = []
        for c in plain:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha() and c.isascii():
                x = chr(97 + self.below(26))
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def surrogate_key(kind: str, key: str, secret: bytes, attempt: int = 0) -> str:
    """The surrogate of an entity, as a key of the same kind. From the fourth attempt on, e-mail addresses and names,
    which have no fixed length, grow by a character each time."""
    s = Stream(secret, kind, key, str(attempt))
    more = max(0, attempt - 3)
    if kind == "email":
        local, domain = key.rsplit("@", 1)
        labels = domain.split(".")
        d = Stream(secret, "domain", domain)  # one domain, one surrogate
        return s.alike(local + "a" * more) + "@" + ".".join([*(d.alike(x) for x in labels[:-1]), labels[-1]])
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "ipv6":  # groups of nothing stay so, and with them the places that can be left out
        return ":".join(g if g == "0000" else f"{1 + s.below(0xFFFF):04x}" for g in key.split(":"))
    if kind == "card":
        body = key[0] + s.alike(key[1:-1])
        return body + str(luhn(body))
    if kind == "iban":
        body = s.alike(key[4:])
        return key[:2] + f"{98 - mod97(key[:2] + '00' + body):02d}" + body
    if kind == "ssn":
        return f"{1 + s.below(665):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "phone":
        head = key[: max(int(key[0] == "0"), len(key) - 10)]
        rest = key[len(head) :]
        return head + str(2 + s.below(8)) + s.alike(rest[1:])
    _, gender, script = kind.split("/")
    consonants, vowels, endings = SYLLABLES[script]
    syllables = 2 + (len(key) > 6) + more
    return "".join(consonants[s.below(len(consonants))] + vowels[s.below(len(vowels))] for _ in range(syllables)) + consonants[s.below(len(consonants))] + endings[gender][s.below(len(endings[gender]))]


def pour(surface: str, kind: str, new: str) -> str:
    """new in the format of surface: its separators, its case."""
    if kind == "email":
        return new.upper() if surface.isupper() else new
    if kind == "ip":
        return new
    if kind == "ipv6":
        address = ipaddress.IPv6Address(new)
        full = len(surface) == len(new)
        return (address.exploded if full else address.compressed).upper() if surface.isupper() else address.exploded if full else address.compressed
    if kind == "phone":  # the same last digits with and without the country code
        new = new[-sum(map(str.isdigit, surface)) :]
    if kind.startswith("name"):
        return new.upper() if surface.isupper() and len(surface) > 1 else new[0].upper() + new[1:]
    chars = iter(new)
    return "".join(next(chars) if c.isalnum() else c for c in surface)


def _surrogate(e: Entity, secret: bytes, attempts: dict[tuple[str, str], tuple[str, int]]) -> str:
    kind, attempt = attempts.get((e.kind, e.key), (e.kind, 0))
    return surrogate_key(kind, e.key, secret, attempt)


def replace(text: str | None, secret: bytes, attempts: dict[tuple[str, str], tuple[str, int]]) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and its entities with the offsets they have in it before."""
    if text is None:
        return None, []
    out, at, listed = [], 0, []
    for e in find_entities(text):
        new = pour(e.surface, e.kind, _surrogate(e, secret, attempts))
        out += [text[at : e.start], new]
        at = e.end
        listed.append({"kind": e.kind, "start": e.start, "end": e.end, "surrogate": new})
    return "".join([*out, text[at:]]), listed


def entities_of(docs: DataFrame) -> DataFrame:
    """doc_id, kind and key of the entities of every row."""
    d = texts(docs)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in sliced(batches):
            rows = [(n, *x) for n, t in enumerate(b.column("text").to_pylist()) for x in sorted({(e.kind, e.key) for e in find_entities(t)})]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "kind", "key"])

    return d.mapInArrow(run, f"doc_id {kind}, kind string, key string")


def _with_surrogates(entities: DataFrame, secret: bytes) -> DataFrame:
    """entities (kind, key, attempt) with the surrogate's key."""

    def run(batches):
        for b in batches:
            new = [surrogate_key(k, x, secret, a) for k, x, a in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("key"), b.column("attempt"), pa.array(new, pa.string())], ["kind", "key", "attempt", "new"])

    return entities.mapInArrow(run, "kind string, key string, attempt int, new string")


def one_kind(entities: DataFrame) -> DataFrame:
    """kind, key and use of distinct entities. use is the kind whose surrogate serves: for names, with the
    gender all texts agree on, so that a word has one surrogate in all of them."""
    part = lambda n: F.split_part("kind", F.lit("/"), F.lit(n))
    named = F.col("kind").startswith("name/")
    of = lambda g: F.max(F.coalesce(named & (part(2) == g), F.lit(False))).alias(g)
    words = entities.groupBy("key", F.when(named, F.concat(F.lit("name/"), part(3))).otherwise(F.col("kind")).alias("group")).agg(*map(of, "mfx"))
    name = lambda g: F.concat(F.lit("name/"), g, F.substring("group", 5, 100))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("x")
    kinds = F.filter(F.array(*(F.when(F.col(g), name(F.lit(g))) for g in "mfx")), lambda k: k.isNotNull())
    is_name = F.col("group").startswith("name/")
    return words.select("key", F.when(is_name, name(gender)).otherwise(F.col("group")).alias("use"), F.explode(F.when(is_name, kinds).otherwise(F.array("group"))).alias("kind")).select("kind", "key", "use")


def settle_collisions(entities: DataFrame, secret: bytes) -> DataFrame:
    """kind, key, use and attempt of the entities whose own first surrogate doesn't serve.

    A surrogate doesn't serve if another entity of its kind has it (the smallest key keeps
    it) or if it is a real entity itself. Those entities try again until none collides; an error says if
    that takes over ATTEMPTS rounds, as when a corpus has most of all numbers of a kind. Names
    count as one kind, whatever their gender, and a name has the surrogate of one_kind().
    """
    group = F.when(F.col("kind").startswith("name"), "name").otherwise(F.col("kind"))
    ways = settled(one_kind(entities))
    real = ways.select(F.col("use").alias("kind"), "key").distinct().withColumn("g", group)
    taken, open_rows = None, real.select("kind", "key", F.lit(0).cast("int").alias("attempt"))
    changed = None
    for _ in range(ATTEMPTS):
        tried = settled(_with_surrogates(open_rows, secret).withColumn("g", group))
        first = tried.groupBy("g", "new").agg(F.min(F.struct("kind", "key")).alias("w"))
        good = tried.join(first, ["g", "new"]).filter((F.col("w.kind") == F.col("kind")) & (F.col("w.key") == F.col("key"))).drop("w")
        good = good.join(real.select("g", F.col("key").alias("new")).distinct(), ["g", "new"], "left_anti")
        if taken is not None:
            good = good.join(taken.select("g", "new"), ["g", "new"], "left_anti")
        good = settled(good.select("kind", "key", "attempt", "g", "new"))
        taken = good if taken is None else taken.union(good)
        later = good.filter("attempt > 0").select("kind", "key", "attempt")
        changed = later if changed is None else changed.union(later)
        open_rows = settled(tried.join(good, ["kind", "key"], "left_anti").select("kind", "key", (F.col("attempt") + 1).alias("attempt")))
        if open_rows.isEmpty():
            own = ways.join(changed.withColumnRenamed("kind", "use"), ["use", "key"], "left")
            return own.filter("attempt IS NOT NULL OR kind != use").select("kind", "key", "use", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    raise ValueError(f"entities are left without a surrogate of their own after {ATTEMPTS} attempts")


def _with_attempts(d: DataFrame, secret: bytes):
    """d with a column more, its name, and a broadcast: kinds and attempts of the surrogates that aren't the first of an entity's own kind, in the one or in the other."""
    changed = settled(settle_collisions(entities_of(d).select("kind", "key"), secret))
    context, own_name = d.sparkSession.sparkContext, fresh(d, "own")
    if changed.limit(BROADCAST_ENTITIES + 1).count() <= BROADCAST_ENTITIES:
        few = {(r["kind"], r["key"]): (r["use"], r["attempt"]) for r in changed.collect()}
        return d.withColumn(own_name, F.lit(None).cast("array<struct<kind:string,key:string,use:string,attempt:int>>")), own_name, context.broadcast(few)
    id_name = fresh(d, "id")
    own = entities_of(d).distinct().join(changed, ["kind", "key"]).groupBy(F.col("doc_id").alias(id_name)).agg(F.collect_set(F.struct("kind", "key", "use", "attempt")).alias(own_name))
    return d.join(own, d["doc_id"].eqNullSafe(own[id_name]), "left").drop(own[id_name]), own_name, context.broadcast({})


def rewrite(docs: DataFrame, secret: bytes) -> DataFrame:
    """docs with the texts of pseudonymize(), and n_chars, if there is one, counted anew."""
    d, own_name, shared = _with_attempts(docs, secret)

    def run(batches):
        for b in sliced(batches):
            own = b.column(own_name).to_pylist()
            done = [replace(t, secret, _attempts(o, shared.value))[0] for t, o in zip(b.column("text").to_pylist(), own, strict=True)]
            new = {"text": done, "n_chars": [None if t is None else len(t) for t in done]}
            names = [n for n in b.schema.names if n != own_name]
            yield pa.RecordBatch.from_arrays([pa.array(new[n], b.schema.field(n).type) if n in new else b.column(n) for n in names], names)

    # n_chars of a null text is null, whatever it was before.
    return d.mapInArrow(run, StructType([StructField(f.name, f.dataType, True, f.metadata) for f in docs.schema]))


def _attempts(own, shared: dict) -> dict[tuple[str, str], tuple[str, int]]:
    return {(x["kind"], x["key"]): (x["use"], x["attempt"]) for x in own} if own else shared


def pseudonymize(docs: DataFrame, secret: bytes) -> DataFrame:
    """doc_id, text with surrogates, and entities (kind, start, end, surrogate; offsets in the old text).

    One entity has one surrogate in the whole corpus, however it is written, and no two share one.
    Surrogates keep digits, letters, separators and case; cards and IBANs stay valid; names
    keep script, and the gender of their titles where all texts agree on it. Null texts stay null; empty texts and texts without entities are
    left alone; repeated rows are each rewritten, alike; an empty table gives an empty result;
    extra columns are ignored.
    """
    d, own_name, shared = _with_attempts(texts(docs), secret)
    kind = d.schema["doc_id"].dataType.simpleString()
    listed = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))

    def run(batches):
        for b in sliced(batches):
            own = b.column(own_name).to_pylist()
            done = [replace(t, secret, _attempts(o, shared.value)) for t, o in zip(b.column("text").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array([e for _, e in done], listed)], ["doc_id", "text", "entities"])

    return d.mapInArrow(run, f"doc_id {kind}, text string, entities array<struct<kind:string,start:int,end:int,surrogate:string>>")
