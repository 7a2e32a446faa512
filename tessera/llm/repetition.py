"""Quality rules from the repetition inside a text.

A suffix array over a text's words puts equal passages side by side; where
neighbours share ``window`` words or more, their common prefix is a repeated
substring, and the union of those spans is the covered part of the text.

Null texts and texts without words have no words, no repetition and fail the
rule on length. Texts are independent of each other, so repeated rows give
repeated results, and the work needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.suffix import Prefixes, spans_union, suffix_array
from tessera.llm.textkit import NON_SPACE, U64, Words, bytes_of, mix, pieces, shingles


@dataclass(frozen=True)
class Rules:
    #: shortest repeated substring, in words
    window: int = 8
    #: fewest words of a text
    least_words: int = 20
    #: largest share of words in repeated windows, in percent
    most_repeated: int = 30
    #: largest share of word characters in repeated substrings, in percent
    most_covered: int = 30
    #: longest repeated substring that is let pass, in words
    longest: int = 50


_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[0x0A] = False
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "covered_chars", "n_repeats"]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[edges])


def measure(texts: pa.Array, rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """The measures of each text of a batch."""
    data, offsets = bytes_of(texts)
    w = Words(data, offsets, NON_SPACE, lower=False)
    n_docs, n = len(texts), len(w)
    lead = (data & 0xC0) != 0x80
    chars_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead & NON_SPACE[data], out=chars_before[1:])
    out = {
        "n_words": w.counts.astype(np.int64),
        "word_chars": np.diff(chars_before[offsets]),
        "n_symbols": _sums(_SYMBOL[data], offsets),
    }

    lines = Words(data, offsets, _NOT_NEWLINE, lower=False)
    filled = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    where = lines.doc()[filled]
    pairs = np.unique(np.stack([where.astype(np.uint64), lines.hashes()[filled]]), axis=1)[0].astype(np.int64) if len(where) else where
    out["n_dup_lines"] = np.bincount(where, minlength=n_docs) - np.bincount(pairs, minlength=n_docs)

    doc = w.doc()
    own = mix(w.hashes() + doc.astype(np.uint64) * U64(0xA24BAED4963EE407))  # equal words of different texts differ
    ends = np.repeat(w.first[1:], w.counts)
    grams, whole = shingles(own, w.first, rules.window)
    order = suffix_array(own, ends)
    a, b = order[:-1], order[1:]
    near = whole[a] & whole[b] & (grams[a] == grams[b]) if n else np.zeros(0, bool)
    a, b = a[near], b[near]
    common = Prefixes(own, ends).common(a, b, rules.window) if len(a) else np.zeros(0, np.int64)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    at = np.flatnonzero(longest)
    covered = spans_union(at, longest[at], n)
    in_words = chars_before[w.ends] - chars_before[w.starts]
    out["n_repeat_words"] = _sums(covered, w.first)
    out["covered_chars"] = _sums(np.where(covered, in_words, 0), w.first)
    best = np.zeros(n_docs, np.int64)
    np.maximum.at(best, doc[at], longest[at])
    out["longest_repeat"] = best
    # a repeat is maximal where it does not just continue the one a word before
    starts = longest > 0
    continues = np.zeros(n, bool)
    continues[1:] = starts[1:] & (doc[1:] == doc[:-1]) & (longest[:-1] == longest[1:] + 1)
    out["n_repeats"] = _sums(starts & ~continues, w.first)
    return out


def failed(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Base rule and suffix-array rule."""
    base = (m["n_words"] < rules.least_words) | (100 * m["n_repeat_words"] > rules.most_repeated * m["n_words"])
    method = (100 * m["covered_chars"] > rules.most_covered * m["word_chars"]) | (m["longest_repeat"] > rules.longest)
    return base, method


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs``: its id, the measures, ``base_failed`` and ``kept``."""
    from pyspark.sql import functions as F

    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            m = measure(part.column("text"), rules)
            base, method = failed(m, rules)
            cols = [part.column("doc_id"), *(pa.array(m[k], pa.int64()) for k in MEASURES), pa.array(base), pa.array(~(base | method))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *MEASURES, "base_failed", "kept"])

    schema = f"doc_id {kind}, " + ", ".join(f"{k} long" for k in MEASURES) + ", base_failed boolean, kept boolean"
    return src.mapInArrow(run, schema)
