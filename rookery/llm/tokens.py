"""Token counts: vocabulary strings that are one token by themselves are counted without merging."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import sliced, texts

#: Bytes of pieces that a task remembers, with ENTRY for each; older ones are forgotten all at once.
MEMORY = 48 << 20
ENTRY = 150
#: Longest piece that is remembered.
LONG = 256
#: A pre-token: blanks, as pieces spell them, then what follows up to the next blank.
MARK = "▁"
PRETOKEN = re.compile(f"{MARK}+[^{MARK}]*")


class PieceCounter:
    """Counts as the sentencepiece model at path does.

    No piece of a model of this kind has a blank after another character, so no merge crosses
    the start of a blank run and pre-tokens count apart. The first call proves that for the model, and proves
    offline which vocabulary strings encode alone as one token. A model with a normalizer, with
    user-defined pieces or with crossing pieces is counted by the library on whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            blob = f.read()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        spec = proto.ModelProto()
        spec.ParseFromString(blob)
        plain = spec.normalizer_spec
        pieces = [x.piece for x in spec.pieces if x.type == proto.ModelProto.SentencePiece.NORMAL]
        self.splits = (
            not plain.precompiled_charsmap and plain.add_dummy_prefix and not plain.remove_extra_whitespaces and plain.escape_whitespaces
            and spec.trainer_spec.model_type == proto.TrainerSpec.BPE
            and not any(x.type == proto.ModelProto.SentencePiece.USER_DEFINED for x in spec.pieces)
            and not any(MARK in x.lstrip(MARK) or "\n" in x for x in pieces)
        )
        self.known: dict[str, int] = {}
        if self.splits:
            whole = [x for x in pieces if x.startswith(MARK)]
            coded = self.model.encode([self._text(x) for x in whole], num_threads=1)
            self.known = {x: 1 for x, ids in zip(whole, coded, strict=True) if len(ids) == 1}
            # Words by blanks: the piece of a word is the mark and the word.
            self.known = {x[1:]: n for x, n in self.known.items() if not x.startswith(MARK * 2)}
        self.forget()

    def forget(self) -> None:
        """Leaves nothing but the vocabulary in a worker that waits for its next task."""
        self.memory: dict[str, int] = dict(self.known)
        self.held = 0

    @staticmethod
    def _text(pretoken: str) -> str:
        """The text that the model reads as this pre-token; it puts one blank in front itself."""
        return pretoken[1:].replace(MARK, " ")

    def _lookup(self, words: list[str]) -> int:
        """Tokens of words, after merging those that no vocabulary string settles. "\\nx" stands for a line feed and an x
        without a blank before; the model's own blank, a token by itself there, is taken off."""
        new = list({x for x in words if x not in self.memory})
        counts = {x: len(ids) - (x[:1] == "\n") if x else 1 for x, ids in zip(new, self.model.encode(new, num_threads=1), strict=True)}
        memory = self.memory
        total = sum([memory[x] if x in memory else counts[x] for x in words])
        for x, n in counts.items():
            if len(x) <= LONG:
                self.held += len(x) + ENTRY
                if self.held > MEMORY:
                    self.forget()
                self.memory[x] = n
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.model.encode(text, num_threads=1))
        if text[0] == " " or "  " in text or MARK in text:  # runs of blanks
            return sum(len(self.model.encode(self._text(x), num_threads=1)) if x[1:] else 1 for x in PRETOKEN.findall(MARK + text.replace(" ", MARK)))
        words = text.replace("\n", " \n").split(" ")
        try:
            return sum(map(self.memory.__getitem__, words))
        except KeyError:
            return self._lookup(words)


@functools.cache
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted row by row, an
    empty table gives an empty result, extra columns are ignored. model_path must be readable on
    every executor. A worker holds one Arrow batch, the vocabulary and, while
    a task runs, at most about MEMORY bytes of pieces.
    """

    def run(batches):
        counter = _counter(model_path)
        try:
            for b in sliced(batches):
                counts = [counter.count(x.as_py() or "") for x in b.column("text")]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        finally:
            counter.forget()

    d = texts(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
