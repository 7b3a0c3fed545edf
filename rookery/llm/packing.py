"""Harmonic packing: a document of at most capacity / k tokens, but more than capacity / (k + 1), is one of k in a sequence."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rookery.llm.common import sliced, texts

#: Bytes of words and ids that a task remembers, twice: since the last change and before; ENTRY is what an entry takes besides.
MEMORY = 24 << 20
ENTRY = 180
#: Longest word that is remembered.
LONG = 256
#: Bytes of ids in an output batch.
OUT_BYTES = 8 << 20


#: Chunks that need no library: ASCII without "'" and "<", and Latin-1 letters, which are composed and have
#: one lower-case letter each.
PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
#: What the pre-tokenizer makes of them.
PLAIN_PART = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies spell each byte: itself where it prints, else the next free one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in prints)
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordCoder:
    """Ids of the tokenizer at path, as little-endian 32-bit integers.

    The tokenizer drops white space and never joins what it separates, so texts are cut at ASCII
    white space and each distinct chunk is encoded once: plain ones by the library's merges
    alone, the others by the whole library. Tokenizers of another kind encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        spec = json.loads(self.model.to_str())
        self.chunked = self._drops_blanks(spec)
        self.letters = byte_letters()
        self.core = self.model.model  # one object: each access copies
        self.merge = self.core.tokenize
        self.spelled = [i.to_bytes(4, "little") for i in range(self.model.get_vocab_size(with_added_tokens=True))]
        self.forget()

    def forget(self) -> None:
        """Leaves nothing in a worker that waits for its next task."""
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    @staticmethod
    def _drops_blanks(spec: dict) -> bool:
        """Lower case, then letters, single digits and runs of the rest, without blanks, by bytes."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        kinds = [s["type"] for s in steps]
        return (
            kinds == ["Split", "ByteLevel"] and normal == ["NFC", "Replace", "Lowercase"] and spec["model"]["type"] == "BPE"
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<") or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        )

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merge(self, part: str) -> bytes:
        spelled = self.spelled
        return b"".join([spelled[t.id] for t in self.merge(part)])

    def _chunk(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            return self._merge(word.decode().lower())
        if word[:-1].isalpha() and word[-1:] in b".,":
            known = self.young.get(word[:-1])
            return (known if known is not None else self._merge(word[:-1].decode().lower())) + self._merge(chr(word[-1]))
        text = word.decode()
        if not PLAIN.fullmatch(text):
            return self._whole(text)
        letters = self.letters
        return b"".join([self._merge(x if x.isascii() else "".join([letters[b] for b in x.encode()])) for x in PLAIN_PART.findall(text.lower())])

    def encode(self, text: str) -> bytes:
        if not self.chunked:
            return self._whole(text)
        words = text.encode().split()
        try:
            return b"".join(map(self.young.__getitem__, words))
        except KeyError:
            once: dict[bytes, bytes] = {}
            for w in set(words):
                if w not in self.young:
                    self._remember(w, once)
            # What went over to the old ones meanwhile is there.
            young, old = self.young, self.old
            return b"".join([young[w] if w in young else once[w] if w in once else old[w] if w in old else self._chunk(w) for w in words])

    def _remember(self, w: bytes, once: dict[bytes, bytes]) -> None:
        """Frequent words come back from the old ones; long ones are kept for this text only."""
        ids = self.old.get(w) or self._chunk(w)
        if len(w) > LONG:
            once[w] = ids
            return
        self.held += len(w) + len(ids) + ENTRY
        if self.held > MEMORY:
            self.old, self.young, self.held = self.young, {}, len(w) + len(ids) + ENTRY
        self.young[w] = ids


@functools.cache
def _coder(path: str) -> WordCoder:
    return WordCoder(path)


class Bins:
    """One worker's open sequences: one for each reciprocal class, closed when it has its k documents.

    The class of a length is k = capacity // length: capacity / (k + 1) < length <= capacity / k. There are about
    2 * sqrt(capacity) of them, each open in one sequence. A closed sequence waits until its rest is
    filled, with pieces of a document that is cut for it: one over capacity, or the next one that comes once
    the rests are worth a whole sequence. Ids of sequences are (worker, running number), so no worker needs another one's.

    Pieces are (doc_id, start, ids, doc_tokens); rows are pieces with sequence_id, offset and class, 0 for none.
    """

    #: Closed sequences that wait at most.
    WAITING = 64

    def __init__(self, worker: int, capacity: int):
        self.base, self.capacity, self.last = worker << 40, capacity, 0
        self.open: dict[int, list] = {}
        self.waiting: list[list] = []  # rest, class, pieces
        self.room = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        """Rows of the sequences that a document fills."""
        total, at, capacity = len(ids) // 4, 0, self.capacity
        if total > capacity or self.room >= capacity or len(self.waiting) >= self.WAITING:
            at = yield from self._fill((doc_id, 0, ids, total))
        while total - at >= capacity:
            yield from self._emit([(doc_id, at, ids[4 * at : 4 * (at + capacity)], total)], 1)
            at += capacity
        if at == total:
            return
        k = capacity // (total - at)
        held = self.open.setdefault(k, [])
        held.append((doc_id, at, ids[4 * at :], total))
        if len(held) == k:
            del self.open[k]
            rest = capacity - sum(len(p[2]) for p in held) // 4
            if rest:
                self.waiting.append([rest, k, held])
                self.room += rest
            else:
                yield from self._emit(held, k)

    def _fill(self, piece: tuple) -> Iterator[tuple]:
        """Cuts the piece into the rests, largest first, and returns how much of it is gone."""
        doc_id, start, ids, total = piece
        at, size = 0, len(ids) // 4
        self.waiting.sort(key=lambda w: w[0])
        while self.waiting and at < size:
            w = self.waiting[-1]
            cut = min(size - at, w[0])
            w[2].append((doc_id, start + at, ids[4 * at : 4 * (at + cut)], total))
            w[0] -= cut
            at, self.room = at + cut, self.room - cut
            if not w[0]:
                self.waiting.pop()
                yield from self._emit(w[2], w[1])
        return at

    def _emit(self, held: list, k: int) -> Iterator[tuple]:
        offset = 0
        for piece in held:
            yield (*piece, self.base + self.last, offset, k)
            offset += len(piece[2]) // 4
        self.last += 1

    def finish(self) -> Iterator[tuple]:
        """What is still open: its documents fill the waiting sequences, smallest last; those left follow one another
        in sequences that end where they are full and, at the end, at powers of two, so that none needs padding."""
        left = []
        for piece in sorted((p for held in self.open.values() for p in held), key=lambda p: len(p[2]), reverse=True):
            at = yield from self._fill(piece)
            if 4 * at < len(piece[2]):
                left.append((piece[0], piece[1] + at, piece[2][4 * at :], piece[3]))
        left += [p for w in self.waiting for p in w[2]]
        self.open, self.waiting, self.room = {}, [], 0
        total = sum(len(p[2]) for p in left) // 4
        room = min(self.capacity, 1 << max(0, total.bit_length() - 1))
        now: list = []
        for doc_id, start, ids, n in left:
            while ids:
                cut = min(len(ids) // 4, room)
                now.append((doc_id, start, ids[: 4 * cut], n))
                start, ids, room, total = start + cut, ids[4 * cut :], room - cut, total - cut
                if not room:
                    yield from self._emit(now, 0)
                    now, room = [], min(self.capacity, 1 << max(0, total.bit_length() - 1))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Pieces of all documents, laid into sequences of at most capacity tokens.

    A document is its ids and end_id. Documents of the same reciprocal class fill a sequence, a fixed number to each;
    what is left of it is filled with a document that is cut for that, as are the ones over capacity. Each
    partition does so for itself, without any shuffle. Its last sequences are cut at powers of two, so that padding
    is zero if a sequence of such a length is not padded. Columns: doc_id, start (ids of the document before
    the piece), length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, docs_of_class (k, or 0
    for the last sequences of a partition).

    Null and empty texts are end_id alone; repeated rows are packed each for itself; an empty
    table gives an empty result; extra columns are ignored. A worker holds one Arrow batch, the ids of one document, and
    for each class and waiting sequence less than one sequence.
    """
    d = texts(docs)
    kind = d.schema["doc_id"].dataType.simpleString()
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches):
        coder, bins = _coder(tokenizer_path), Bins(TaskContext.get().partitionId(), capacity)
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "docs_of_class"]
        id_type = None
        rows: list[tuple] = []

        def out():
            ids, starts, parts, totals, sequences, offsets, classes = zip(*rows, strict=True)
            lengths = [len(x) // 4 for x in parts]
            columns = [pa.array(ids, id_type), *(pa.array(x, t) for x, t in ((starts, pa.int64()), (lengths, pa.int64()), (parts, pa.binary()), (totals, pa.int64()), (sequences, pa.int64()), (offsets, pa.int64()), (classes, pa.int64())))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        try:
            held = 0
            for b in sliced(batches):
                id_type = b.column("doc_id").type
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    for row in bins.add(doc_id, coder.encode(text.as_py() or "") + end):
                        rows.append(row)
                        held += len(row[2])
                        if held > OUT_BYTES:
                            yield out()
                            held = 0
            rows.extend(bins.finish())
            if rows:
                yield out()
        finally:
            coder.forget()

    return d.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, docs_of_class long")
