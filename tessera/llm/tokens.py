"""Token counts of a public subword model, by whole-token shortcut.

No piece of the vocabulary holds a space mark after another character, nor a
newline, so merges never cross the places where a space run follows a
character or a newline stands: a text falls into pre-tokens whose counts add
up. Both facts are checked when a model is loaded. Before counting, every
vocabulary string is encoded alone; those that come out as one token are
counted straight from a table, and only other pre-tokens are merged (by the
library, each distinct one once while it stays in a bounded memo).

Defined cases: null and empty texts have 0 bytes and 0 tokens. Rows are
independent; the work needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessera.llm.textkit import pieces

SPACE = "▁"
#: pre-tokens of one text that are strings at one time
AT_A_TIME = 500_000
#: pre-tokens that a worker remembers at most
MEMO = 300_000
#: a longer pre-token is merged but not remembered
LONGEST = 64

_PRE = re.compile(r" *[^ \n]+| +|\n")


class Counter(dict):
    """Pre-token -> tokens; what is missing is merged."""

    def __init__(self, proto: bytes, single: list[str] | None = None):
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        normal = [p.replace(SPACE, " ") for i, p in enumerate(pieces) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        if any(re.search(r"[^ ] |\n", p) for p in normal):
            raise ValueError("this vocabulary merges across spaces or newlines")
        self.base = len(self.library.encode("\n"))
        self.single = self._prove(normal) if single is None else single
        self._reset()

    def _prove(self, strings: list[str]) -> list[str]:
        """The vocabulary strings that encode alone as one token."""
        return [s for s, got in zip(strings, self.library.encode(["\n" + s for s in strings]), strict=True) if len(got) == self.base + 1]

    def _reset(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.single, 1))

    def _merge(self, pres: list[str]) -> list[int]:
        return [len(x) - self.base for x in self.library.encode(["\n" + p for p in pres], num_threads=1)]

    def __missing__(self, pre: str) -> int:
        return self._merge([pre])[0]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. Pre-tokens of a longer text are made and counted AT_A_TIME, so they take bounded memory."""
        out, waiting, owners = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            # a space mark in a text is a space to the model, and every text begins with one
            text = " " + text.replace(SPACE, " ")
            if len(text) <= AT_A_TIME:
                some = _PRE.findall(text)
                waiting += some
                owners.append((i, len(some)))
                continue
            rest = _PRE.finditer(text)
            while some := [m[0] for m in islice(rest, AT_A_TIME)]:
                self._add(out, some, [(i, len(some))])
        self._add(out, waiting, owners)
        return out

    def _add(self, out: list[int], pres: list[str], owners: list[tuple[int, int]]) -> None:
        here = {p for p in set(pres) if len(p) <= LONGEST}
        rest = list(here - self.keys())
        if len(self) + len(rest) > MEMO:
            self._reset()
            rest = list(here - self.keys())
        for begin in range(0, len(rest), 50_000):
            some = rest[begin : begin + 50_000]
            self.update(zip(some, self._merge(some), strict=True))
        at = 0
        for i, n in owners:
            out[i] += sum(map(self.__getitem__, pres[at : at + n]))
            at += n


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit. ``model`` is the serialised sentencepiece model."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, Counter(model).single))  # the size of the vocabulary
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(*shared.value)
            for part in pieces(iter([batch]), "text"):
                texts = part.column("text")
                n = np.array(counter.count(texts.to_pylist()), np.int64)
                size = pc.binary_length(texts).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
