"""Statistics, language mixtures and long token counts against plain Python, one text and one word at a time."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, quality, tokens
from tessera.llm.textkit import mix
from tessera.shipping import ship

TEXTS = [
    None, "", " \n\t", "a", "One two, two THREE three! | $5 * 3", "the the the\nthe end\n\nthe end\n \n", "Ünïcödé wörter über alles, 日本語 テキスト",
    "x" * 40 + " averyveryverylongword " + "é" * 9, "(a) [b] {c} <d> \"e\" 'f' =/\\_ ;: .", "0123 456 7\r\n89", "word " * 500, "\x85\xa0nbsp line",
]


def plain_statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    low = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in raw)
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    lines = re.findall(rb"[^\n]+", raw)
    n, size, n_lines, often = max(len(words), 1), max(len(raw), 1), max(len(lines), 1), Counter(words)
    share = lambda chars: sum(raw.count(c) for c in chars) / size
    classes = ["#*$%&|<>", "!?", ".", ",;:", "|", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "\n", "()[]{}<>\"'=/\\_"]
    return [
        math.log(1 + len(words)), sum(map(len, words)) / n, sum(len(w) > 15 for w in words) / n,
        *(share([c.encode() for c in kind]) for kind in classes),
        sum(b >= 0x80 for b in raw) / size, len(often) / n, max(often.values(), default=0) / n, len(set(lines)) / n_lines, len(words) / n_lines,
        sum(len(w) <= 2 for w in words) / n, sum(len(w) <= 4 and often[w] > 1 for w in words) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
    ]


def test_statistics_by_brute_force():
    got = quality.statistics(pa.array(TEXTS, pa.string()))
    assert got.shape == (len(TEXTS), len(quality.FEATURES))
    np.testing.assert_allclose(got, [plain_statistics(t) for t in TEXTS], rtol=1e-12, atol=1e-12)


def test_labelled_copies_teach_once(spark):
    """An id that is repeated in the documents teaches once, whatever its copies are."""
    ship(spark)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "text", "here"] if i % 2 else ["$$", "buy", "!!!"]) for _ in range(30 + i))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.lit(True))
    many = quality.train(spark.createDataFrame(rows + rows[:5] * 40, "doc_id long, text string"), labels, F.lit(True))
    for a, b in zip((once.feature, once.cut, once.leaf), (many.feature, many.cut, many.leaf), strict=True):
        np.testing.assert_array_equal(a, b)


def plain_words(text: str) -> list[bytes]:
    return re.findall(rb"[a-z\x80-\xff]+", bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in text.encode()))


def plain_grams(word: bytes) -> list[int]:
    marked = b"\x01" + word
    keys = [int.from_bytes(bytes(reversed(marked[max(0, i - language.GRAM + 1) : i + 1])), "little") for i in range(1, len(marked))]
    return [int(mix(np.array([k], np.uint64))[0] >> np.uint64(48)) % language.BUCKETS for k in keys]


def plain_em(p: list[list[float]], allowed: list[int]) -> tuple[dict[int, float], float]:
    share = {k: 1 / len(allowed) for k in allowed}
    for _ in range(language.ITERATIONS):
        total = dict.fromkeys(allowed, 0.0)
        for word in p:
            mass = sum(word[k] * share[k] for k in allowed)
            for k in allowed:
                total[k] += word[k] * share[k] / max(mass, 1e-30)
        share = {k: v / len(p) for k, v in total.items()}
    return share, sum(math.log(max(sum(w[k] * share[k] for k in allowed), 1e-30)) for w in p)


def plain_mixture(text: str, table: np.ndarray) -> list[float]:
    n_lang = table.shape[1]
    logs = [[sum(float(table[g, k]) for g in plain_grams(w)) for k in range(n_lang)] for w in plain_words(text)]
    p = [[math.exp(max(x - max(row), -30.0)) for x in row] for row in logs]
    cost = language.PENALTY * math.log(max(len(p), 2))
    alone = [sum(math.log(w[k]) for w in p) for k in range(n_lang)]
    one = max(range(n_lang), key=alone.__getitem__)
    single = [float(k == one) for k in range(n_lang)]
    if alone[one] + cost >= 0:
        return single
    allowed = list(range(n_lang))
    share, fit = plain_em(p, allowed)
    if alone[one] >= fit - cost:
        return single
    while len(allowed) > 1:
        fewer = [k for k in allowed if k != min(allowed, key=share.__getitem__)]
        share2, fit2 = plain_em(p, fewer)
        if fit2 + cost < fit:
            break
        allowed, share, fit = fewer, share2, fit2
    return [share.get(k, 0.0) for k in range(n_lang)]


def _tongues(seed: int) -> list[list[str]]:
    rng = random.Random(seed)
    letters = ["abcdeimnrt", "ghijklopsu", "éèàüößñabc"]
    return [["".join(rng.choice(x) for _ in range(rng.randint(2, 7))) for _ in range(60)] for x in letters]


def test_language_by_brute_force(spark):
    ship(spark)
    rng, words = random.Random(5), _tongues(1)
    taught = [(i, " ".join(rng.choices(words[i % 3], k=40)), "abc"[i % 3]) for i in range(60)] + [(100, None, "a"), (101, "text", None)]
    model = language.train(spark.createDataFrame(taught, "doc_id long, text string, lang string"), F.lit(True))
    counts = np.zeros((language.BUCKETS, 3))
    for _, text, lang in taught[:60]:
        for w in plain_words(text):
            np.add.at(counts, (plain_grams(w), "abc".index(lang)), 1)
    assert model.languages == ["a", "b", "c"]
    np.testing.assert_allclose(model.table, np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * language.BUCKETS)), rtol=1e-5)

    texts = [" ".join(rng.choices(words[k], k=n)) for k in range(3) for n in (1, 3, 30)]
    texts += [" ".join(rng.choices(words[a], k=m) + rng.choices(words[b], k=n)) for a, b, m, n in ((0, 1, 20, 20), (1, 2, 30, 6), (0, 2, 2, 50), (2, 0, 1, 1))]
    texts += [" ".join(sum((rng.choices(w, k=25) for w in words), []))]
    names, score, shares = model.predict(pa.array(texts))
    want = np.array([plain_mixture(t, model.table) for t in texts])
    np.testing.assert_allclose(shares, want, atol=2e-3)
    clear = np.flatnonzero(np.sort(want, axis=1)[:, -1] - np.sort(want, axis=1)[:, -2] > 0.01)
    assert len(clear) >= 11 and [names[i] for i in clear] == ["abc"[k] for k in want[clear].argmax(axis=1)]  # elsewhere a tie decides
    assert (np.count_nonzero(want, axis=1) == np.count_nonzero(shares, axis=1)).all() and (np.count_nonzero(want[:9], axis=1) == 1).all()
    assert np.count_nonzero(want[9]) == 2 and np.count_nonzero(want[-1]) == 3  # mixtures are really found
    np.testing.assert_allclose(score, want.max(axis=1), atol=2e-3)


def test_long_texts_are_counted_in_parts(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    raw = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    monkeypatch.setattr(tokens, "AT_A_TIME", 7)
    counter = tokens.Counter(raw)
    rng = random.Random(9)
    alphabet = ["a", "the", " ", "  ", "\n", "\n\n", "é", "日本", "▁", "0", "-", "\t", "Zq", "…"]
    texts = ["".join(rng.choices(alphabet, k=n)) for n in (0, 1, 5, 50, 500, 5_000)] + [None, " ", "\n", "x" * 5_000]
    assert counter.count(texts) == [len(library.encode(t or "")) for t in texts]
