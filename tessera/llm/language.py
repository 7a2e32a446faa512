"""Language identification by a mixture over languages, fitted to each document.

Character n-gram counts of labelled documents give each language's log
likelihood of a word. A document is a mixture of languages; expectation
maximisation estimates the proportions from its words' likelihoods. The set of
languages is then thinned: a language goes while dropping it costs less
likelihood than the penalty for keeping it.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
null languages teach nothing; without any labelled text every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tessera.errors import EngineError
from tessera.llm import scratch
from tessera.llm.textkit import NON_SPACE, U64, Words, bytes_of, mix, pieces

#: n-gram buckets of a model
BUCKETS = 1 << 16
GRAM = 4
#: rows per language that teach at most, in expectation: a bound on the sample for fitting
SAMPLE = 20_000
#: languages of a model at most, more are an error (a model's table has BUCKETS floats for each)
LANGUAGES = 256
ITERATIONS = 8
#: log likelihood, per added language and log of the words, that a further language must bring
PENALTY = 2.0

# bytes that count as letters: a-z and all of multi-byte characters (whether a text has a letter at all is decided by Unicode, see _letters)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


def _word_grams(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of letters, and the buckets of their n-grams with the word of each.

    A gram is up to GRAM bytes that end at a byte of the word, with the word's begin as a mark.
    """
    data, offsets = bytes_of(texts)
    w = Words(data, offsets, _LETTER, lower=True)
    n = w.ends - w.starts
    word = np.repeat(np.arange(len(w)), n)
    at = np.repeat(w.starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    code = w.data[at].astype(np.uint64)
    depth = at - w.starts[word]
    key = code.copy()
    for t in range(1, GRAM):
        before = np.where(depth >= t, w.data[at - np.minimum(depth, t)].astype(np.uint64), U64(1))
        key = key | np.where(depth >= t - 1, before, U64(0)) << U64(8 * t)
    return w, (mix(key) >> U64(48)).astype(np.int64) % BUCKETS, word


def _letters(texts: pa.Array) -> np.ndarray:
    """Which texts have a letter, as Unicode defines it."""
    return np.asarray(pc.match_substring_regex(texts, r"\p{L}").fill_null(False))


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        #: bytes of text at a time: a word takes a float for each language
        self.batch = 8_000_000 // max(8, len(languages))
        rest = 0.1
        self.table = np.log((counts + rest) / (counts.sum(axis=0) + rest * BUCKETS)).astype(np.float32) if languages else np.zeros((BUCKETS, 0), np.float32)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its share, and the shares of all languages, for each text."""
        n_docs, n_lang = len(texts), len(self.languages)
        if not n_lang:
            return ["und"] * n_docs, np.zeros(n_docs), np.zeros((n_docs, 0))
        w, gram, word = _word_grams(texts)
        doc = w.doc()
        likelihood = np.zeros((len(w), n_lang), np.float32)
        if len(w):
            starts = np.r_[0, np.cumsum(w.ends - w.starts)[:-1]]
            for k in range(n_lang):
                likelihood[:, k] = np.add.reduceat(self.table[gram, k], starts)
        top = likelihood.max(axis=1, initial=-np.inf) if n_lang else np.zeros(len(w))
        p = np.exp(np.maximum(likelihood - top[:, None], -30.0))
        cost = PENALTY * np.log(np.maximum(w.counts, 2))
        filled = np.flatnonzero(w.counts > 0)
        alone = np.zeros((n_docs, n_lang))
        if len(filled):
            alone[filled] = np.add.reduceat(np.log(p), w.first[:-1][filled], axis=0, dtype=np.float64)
        one = alone.argmax(axis=1)
        single = alone[np.arange(n_docs), one]
        shares = np.zeros((n_docs, n_lang))
        shares[np.arange(n_docs), one] = 1.0
        # no mixture fits better than 0; where one language comes that near, further ones cannot pay
        live = filled[single[filled] + cost[filled] < 0]
        allowed = np.ones((len(live), n_lang), bool)
        mixed, fit = self._among(p, doc, live, w.counts, allowed)
        open_ = single[live] < fit - cost[live]
        live, allowed, mixed, fit = live[open_], allowed[open_], mixed[open_], fit[open_]
        # of the rest, every language but the largest is tried for removal, the smallest share first
        shares[live] = mixed
        for _ in range(n_lang - 1):
            test = allowed.sum(axis=1) > 1
            live, allowed, mixed, fit = live[test], allowed[test], mixed[test], fit[test]
            if not len(live):
                break
            trial = allowed.copy()
            trial[np.arange(len(live)), np.where(allowed, mixed, np.inf).argmin(axis=1)] = False
            mixed2, fit2 = self._among(p, doc, live, w.counts, trial)
            better = fit2 + cost[live] >= fit
            live, allowed, mixed, fit = live[better], trial[better], mixed2[better], fit2[better]
            shares[live] = mixed
        best = shares.argmax(axis=1) if n_docs else np.zeros(0, np.int64)
        known = _letters(texts) & (w.counts > 0)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, shares[np.arange(n_docs), best].clip(0, 1), 0.0), shares

    def _among(self, p: np.ndarray, doc: np.ndarray, docs: np.ndarray, counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log likelihood of some texts, with the languages allowed to each."""
        number = np.full(len(counts), -1)
        number[docs] = np.arange(len(docs))
        mine = number[doc]
        pick = mine >= 0
        return self._em(p if pick.all() else p[pick], mine[pick], counts[docs], allowed)

    def _em(self, p: np.ndarray, doc: np.ndarray, counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = (allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)).astype(np.float32)
        fit = np.zeros(len(counts))
        if not len(counts):
            return share, fit
        starts = np.cumsum(counts) - counts
        for _ in range(ITERATIONS):
            mass = p * share[doc]
            mass *= (1 / np.maximum(mass.sum(axis=1), 1e-30))[:, None]
            share = (np.add.reduceat(mass, starts, axis=0) / counts[:, None]).astype(np.float32)
        total = np.einsum("ij,ij->i", p, share[doc])
        return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)), starts, dtype=np.float64)


def train(docs: DataFrame, learns: Column, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE, id_col: str = "doc_id") -> Model:
    """A model from the rows where ``learns`` holds; of languages with more than ``sample`` such rows, a sample by a hash of id and text."""
    lang, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`") if id_col in docs.columns else F.lit(0)
    rows = docs.filter(learns & lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"), same.alias("id"))
    sizes = sorted(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect())
    if len(sizes) > LANGUAGES:
        raise EngineError(f"more than {LANGUAGES} languages to learn")
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    number = {x: i for i, x in enumerate(languages)}
    share = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(min(1.0, sample / r["count"]))) for r in sizes), F.lit(0.0))
    chosen = rows.filter(F.pmod(F.xxhash64("id", "text", F.lit(5)), F.lit(1 << 30)) < share * F.lit(float(1 << 30))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in pieces(batches, "text"):
            w, gram, word = _word_grams(part.column("text"))
            mine = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
            some, times = np.unique(mine[w.doc()[word]] * BUCKETS + gram, return_counts=True)
            codes, where = np.unique(np.r_[codes, some], return_inverse=True)
            n = np.bincount(where.reshape(-1), np.r_[n, times], len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["cell", "n"])

    cells = chosen.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return Model(languages, counts.reshape(len(languages), BUCKETS).T)


def identify(docs: DataFrame, model: Model, carry: dict[str, Column] | None = None, text_col: str = "text", mixture: bool = True) -> DataFrame:
    """One row per row of ``docs``: the ``carry`` columns, lang_pred, score, and, if asked for, ``mixture`` (languages with their shares)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = scratch.free_name(carry or (), "__text")
    src = docs.select(*(c.alias(k) for k, c in (carry or {}).items()), F.col(f"`{text_col}`").alias(text))
    kept = [f.name for f in src.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in pieces(batches, text, m.batch):
            names, score, shares = m.predict(part.column(text))
            columns = [*(part.column(k) for k in kept), pa.array(names, pa.string()), pa.array(score, pa.float64())]
            if mixture:
                some = [[{"lang": m.languages[k], "share": float(row[k])} for k in np.argsort(-row, kind="stable").tolist() if row[k] >= 0.005] if ok != "und" else [] for row, ok in zip(shares, names, strict=True)]
                columns.append(pa.array(some, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score", *["mixture"] * mixture])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != text), "lang_pred string", "score double", *["mixture array<struct<lang: string, share: double>>"] * mixture])
    return src.mapInArrow(run, schema)


def known_language(docs: DataFrame, model: Model, keep: set[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows whose text is in a learned language (one of ``keep``, if given), all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text_col, shared.value.batch):
            names = shared.value.predict(part.column(text_col))[0]
            yield part.filter(pa.array([x != "und" and (keep is None or x in keep) for x in names]))

    return docs.mapInArrow(run, docs.schema)
