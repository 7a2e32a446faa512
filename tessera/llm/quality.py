"""Quality scores from gradient-boosted trees over statistics of a whole text.

Defined cases: null and empty texts have all statistics 0 and get the score
the trees give to those; labels without a text, or null labels, teach nothing;
without labels every score is 0.5. Repeated rows get equal scores. A doc_id
labelled twice teaches once with each label, and one that several documents
share teaches by one of them, so what is fitted is bounded by SAMPLE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.gbdt import Forest, fit
from tessera.llm.textkit import NON_SPACE, U64, Words, bytes_of, mix, pieces

#: labelled rows that teach, in expectation at most: the bound of the fitting sample
SAMPLE = 30_000
THRESHOLD = 0.3

_CLASSES = {
    "symbols": b"#*$%&|<>",
    "bangs": b"!?",
    "stops": b".",
    "commas": b",;:",
    "pipes": b"|",
    "digits": b"0123456789",
    "upper": bytes(range(0x41, 0x5B)),
    "lower": bytes(range(0x61, 0x7B)),
    "newlines": b"\n",
    "brackets": b"()[]{}<>\"'=/\\_",
}
_TABLES = {}
for _name, _chars in _CLASSES.items():
    _TABLES[_name] = np.zeros(256, bool)
    _TABLES[_name][np.frombuffer(_chars, np.uint8)] = True
_NOT_NEWLINE = ~_TABLES["newlines"]

FEATURES = ["log_words", "word_length", "long_words", *(f"{k}_share" for k in _CLASSES), "wide_share", "distinct_words", "top_word", "distinct_lines", "line_words", "short_words", "stop_words", "run_words"]


def statistics(texts: pa.Array) -> np.ndarray:
    """The features of each text, one row per text."""
    data, offsets = bytes_of(texts)
    w = Words(data, offsets, NON_SPACE, lower=True)
    size, count = np.diff(offsets), w.counts
    per_byte, per_word = np.maximum(size, 1), np.maximum(count, 1)

    def of_bytes(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[offsets])

    def of_words(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1)
        np.cumsum(values, out=total[1:])
        return np.diff(total[w.first])

    length = w.ends - w.starts
    doc = w.doc()
    words = w.hashes()
    own = np.sort(mix(words ^ (doc.astype(np.uint64) * U64(0xA24BAED4963EE407))))
    # runs of equal fingerprints are the words of a text with their counts; which text they are of is found by order of first use
    keyed = mix(words ^ (doc.astype(np.uint64) * U64(0xA24BAED4963EE407)))
    heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    times = np.diff(np.r_[heads, len(own)])
    often = times[np.searchsorted(own[heads], keyed)] if len(own) else np.zeros(0)
    top = np.zeros(len(count))
    np.maximum.at(top, doc, often)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])

    lines = Words(data, offsets, _NOT_NEWLINE, lower=False)
    where = lines.doc()
    line_keys = np.unique(np.stack([where.astype(np.uint64), lines.hashes()]), axis=1)[0].astype(np.int64) if len(where) else where
    n_lines = np.maximum(lines.counts, 1)
    columns = [np.log1p(count), of_words(length) / per_word, of_words(length > 15) / per_word]
    columns += [of_bytes(t[data]) / per_byte for t in _TABLES.values()]
    columns += [
        of_bytes(data >= 0x80) / per_byte,
        of_words(1 / np.maximum(often, 1)) / per_word,
        top / per_word,
        np.bincount(line_keys, minlength=len(count)) / n_lines,
        count / n_lines,
        of_words(length <= 2) / per_word,
        of_words((length <= 4) & (often > 1)) / per_word,
        of_words(again) / per_word,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, learns: Column, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """A model from labelled rows whose id satisfies ``learns`` (a condition on a column named doc_id)."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learns).distinct()
    n = known.count()
    limit = F.lit(min(1.0, sample / max(n, 1)) * float(1 << 30))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < limit)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known), "doc_id")  # at most about ``sample`` ids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    measured = rows.mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, x array<double>")
    got = measured.groupBy("doc_id", "label").agg(F.min("x").alias("x")).toPandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["label"].to_numpy()))  # the same model whatever order the rows came in
    return fit(x[order], got["label"].to_numpy(np.float64)[order])


def score(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.probability(statistics(part.column("text"))))], names=["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
