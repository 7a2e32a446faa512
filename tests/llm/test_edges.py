"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import hashlib

import mixing_twin
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import components, decontaminate, gbdt, language, licenses, mixing, neardup, quality, repetition, scratch, secrets, tokens, warc
from tessera.shipping import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, token int, rep long, row long, _row string, hits int"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
LONG = " ".join(f"w{i % 5000}x{i}" for i in range(60_000))


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), "x", 1, 2, 3, "y", 4)


ROWS = [
    doc(1, "The quick brown fox jumps over the lazy dog again and again and again today"),
    doc(2, "The quick brown fox jumps over the lazy dog again and again and again today"),
    doc(2, "The quick brown fox jumps over the lazy dog again and again and again today"),
    doc(3, None),
    doc(4, ""),
    doc(5, " \n\t "),
    doc(6, "12345 67890", None, None),
    doc(7, LONG, "en", "t"),
    doc(None, "no id but quite some text of ordinary words is here to read", None, "t"),
    doc(8, f"Before. {PASSAGE.upper()} after that", "de", None),
    doc(9, 'config token = "0123456789abcdef0123456789abcdef01234567" and all rights reserved', "en", "u"),
    doc(10, "two words", "fr", "u"),
]
BENCHMARK = [(1, PASSAGE), (2, ""), (3, None), (None, PASSAGE), (4, "two words"), (4, "two words")]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def complete(df, docs):
    got = by_id(df)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in by_id(docs).items()}
    return got


def test_secrets(docs, none):
    got = complete(secrets.scan(docs, keep=["doc_id"]), docs)
    found = {k: len(v[0]["_tessera_found"]["findings"]) for k, v in got.items()}
    assert found.pop(9) == 1 and not any(found.values())
    assert secrets.MARK in got[9][0]["_tessera_found"]["redacted"]
    assert secrets.redact(none).count() == 0 and secrets.redact(docs).schema == docs.schema


def test_decontamination(docs, none, benchmark):
    got = complete(decontaminate.contamination(docs, benchmark), docs)
    assert got[8][0]["n_hit"] == 12 and got[8][0]["item_ids"] == ["1"] and got[8][0]["longest_match"] == 12
    assert got[10][0]["item_ids"] == ["4"] and got[3][0]["n_words"] == 0 and got[7][0]["n_words"] == 60_000
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.filter("false")).agg(F.sum("n_hit")).first()[0] == 0
    kept = decontaminate.clean(docs, benchmark)
    assert kept.schema == docs.schema and kept.count() == len(ROWS) - 2


def test_benchmark_in_blocks_gives_the_same(docs, benchmark):
    columns = ["doc_id", "n_words", "n_hit", "longest_match", "item_ids"]
    one = sorted((tuple(r) for r in decontaminate.contamination(docs, benchmark).select(columns).collect()), key=repr)
    many = sorted((tuple(r) for r in decontaminate.contamination(docs, benchmark, block_words=10).select(columns).collect()), key=repr)
    assert one == many


def test_licenses(docs, none):
    got = complete(licenses.scan(docs), docs)
    assert got[9][0]["labels"] == "reserved" and got[9][0]["n_base"] == 1 and got[3][0]["labels"] == ""
    assert licenses.scan(none).count() == 0


def test_licence_template_needs_its_key_phrase(spark):
    ship(spark)
    rows = [(1, "x Released under the MIT License y"), (2, "under the license of mit released"), (3, "the mit license"), (4, "CC BY\nCC-BY cc by")]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1][0]["labels"] == "mit" and got[1][0]["found"][0]["begin"] == 1
    assert got[2][0]["labels"] == ""
    assert (got[4][0]["n_base"], got[4][0]["first_word"], got[4][0]["last_word"]) == (3, 0, 4)


def test_near_duplicates(docs, none):
    got = complete(neardup.near_duplicates(docs), docs)
    assert [r["component_id"] for k in (1, 2) for r in got[k]] == [1, 1, 1] and not got[2][0]["kept"]
    assert got[4][0]["n_shingles"] == 0 and got[4][0]["kept"] and got[4][0]["component_id"] == 4
    assert got[None][0]["kept"] and got[None][0]["component_id"] is None and got[10][0]["n_shingles"] == 1
    assert neardup.near_duplicates(none).count() == 0 and neardup.deduplicate(none).count() == 0
    left = neardup.deduplicate(docs)
    assert left.schema == docs.schema and left.count() == len(ROWS) - 2


def test_one_row_of_an_id_stays(spark):
    ship(spark)
    rows = [(1, "some text of its own that is long enough"), (1, "some text of its own that is long enough"), (1, "another one entirely with other words in it"), (2, "different again from all of those up there")]
    assert sorted(r["doc_id"] for r in neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 2]


def brute_components(texts):
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = components.UnionFind()
    for i, x in enumerate(sets):
        for j in range(i):
            n = len(x & sets[j])
            if n and 100 * n >= 75 * (len(x) + len(sets[j]) - n):
                up.join(i, j)
    return [up.find(i) for i in range(len(texts))]


def test_near_copies_by_brute_force(spark):
    """A large group of copies with few to many edits, around the threshold, chains and a shared passage."""
    ship(spark)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)]
    for _ in range(220):
        w = list(base)
        for at in rng.integers(0, len(w), int(rng.integers(0, 9))):
            w[at] = f"n{rng.integers(10**9)}"
        texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):
        texts.append(" ".join([f"k{k}_{i}" if i < 0 else c for i, c in enumerate(chain[k * 6 : 140 + k * 6])]))
    for k in range(60):
        texts.append(" ".join(base[:40] + [f"p{k}_{i}" for i in range(60)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    want = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert 1 < len(set(want[:221])) and len(set(want[221:233])) == 1


def test_difference_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(300):
        c = rng.choice(400, 100, replace=False).astype(np.uint64)
        x, y = (np.unique(np.r_[rng.choice(c, int(rng.integers(50, 100)), replace=False), rng.choice(400, int(rng.integers(0, 40))).astype(np.uint64)]) for _ in "xy")
        ex, ey = np.setxor1d(x, c), np.setxor1d(y, c)
        w = [4 * len(np.setdiff1d(c, z)) + 3 * len(np.setdiff1d(z, c)) for z in (x, y)]
        both = len(np.intersect1d(x, y))
        links = 100 * both >= 75 * (len(x) + len(y) - both)
        assert links == (7 * len(np.intersect1d(ex, ey)) >= sum(w) - len(c))


def test_superminhash_estimates_and_stops():
    rng = np.random.default_rng(0)
    for n, shared in ((1, 1), (40, 32), (3000, 2600)):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.r_[a[:shared], rng.integers(0, 1 << 63, n - shared, dtype=np.uint64)]
        s = neardup.superminhash([a, b])
        assert abs((s[0] == s[1]).mean() - shared / (2 * n - shared)) < 0.12
        assert (s >> np.uint64(52) < neardup.SLOTS).all()


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components(spark, n):
    ship(spark)
    rng = np.random.default_rng(n)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (n, 2))] + [(i, i + 1) for i in range(100, 130)]
    up = components.UnionFind()
    for a, b in edges:
        up.join(a, b)
    got = {r["v"]: r["m"] for r in components.stars(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {v: up.find(v) for e in edges for v in e if up.find(v) != v}


def test_no_edges(spark):
    ship(spark)
    assert components.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language(docs, none):
    model = language.train(docs, F.lit(True))
    got = complete(language.identify(docs, model, {"doc_id": F.col("doc_id")}), docs)
    for k in (3, 4, 5, 6):
        assert (got[k][0]["lang_pred"], got[k][0]["score"], got[k][0]["mixture"]) == ("und", 0.0, [])
    assert got[7][0]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for v in got.values() for r in v)
    empty = language.train(none, F.lit(True))
    assert {r["lang_pred"] for r in language.identify(docs, empty, {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert language.identify(none, model).count() == 0
    left = language.known_language(docs, model)
    assert left.schema == docs.schema and left.count() == len(ROWS) - 4


def test_mixed_document_gets_both_languages():
    rng = np.random.default_rng(0)
    words = {"a": ["".join(rng.choice(list("abcdef"), 5)) for _ in range(200)], "b": ["".join(rng.choice(list("tuvwxy"), 5)) for _ in range(200)]}
    counts = np.zeros((language.BUCKETS, 2))
    for k, x in enumerate("ab"):
        _, gram, _ = language._word_grams(pa.array([" ".join(words[x])]))
        counts[:, k] = np.bincount(gram, minlength=language.BUCKETS)
    model = language.Model(["a", "b"], counts)
    names, score, shares = model.predict(pa.array([" ".join(words["a"][:70] + words["b"][:30]), " ".join(words["b"]), "1 2", None]))
    assert names == ["a", "b", "und", "und"]
    assert abs(shares[0][0] - 0.7) < 0.02 and shares[1].tolist() == [0, 1] and score[2] == 0


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    got = complete(quality.score(docs, quality.train(docs, labels, F.lit(True))), docs)
    assert all(0 <= r["score"] <= 1 for v in got.values() for r in v)
    constant = quality.train(docs, labels.filter("false"), F.lit(True))
    assert {r["score"] for r in quality.score(docs, constant).collect()} == {0.5}
    assert quality.score(none, constant).count() == 0


def test_trees_learn_and_walk_like_a_loop():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    f = gbdt.fit(x[:600], y[:600])
    assert ((f.probability(x[600:]) > 0.5) == (y[600:] == 1)).mean() > 0.95
    for row in x[:5]:
        total = f.base
        for feature, cut, leaf in zip(f.feature, f.cut, f.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(total - f.raw(row[None])[0]) < 1e-9
    assert gbdt.fit(x, np.ones(800)).probability(x[:1])[0] > 0.99


def test_quality_rules(docs, none):
    got = complete(repetition.quality_rules(docs), docs)
    assert got[3][0]["n_words"] == 0 and got[3][0]["base_failed"] and not got[3][0]["kept"]
    assert got[7][0]["kept"] and got[7][0]["n_words"] == 60_000
    assert repetition.quality_rules(none).count() == 0
    m = repetition.measure(pa.array([" ".join(["same"] * 40_000), " ".join(map(str, range(60))) + "\n" + " ".join(map(str, range(60)))]))
    assert m["longest_repeat"].tolist() == [39_999, 60] and m["n_repeat_words"].tolist() == [40_000, 120] and m["covered_chars"][1] == m["word_chars"][1]


def test_tokens(docs, none):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    model = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    got = complete(tokens.token_counts(docs, model), docs)
    assert (got[3][0]["n_bytes"], got[3][0]["n_tokens"]) == (0, 0) and got[7][0]["over_limit"]
    assert tokens.token_counts(none, model).count() == 0
    c = tokens.Counter(model)
    odd = ["", "  ", " a", "a  b\n\n c ", "▁x ▁", "<s>hi</s> <unk>", "\r\nx\t y", "\x00\x01", "😀  x", "a\n", " \n ", "日本語 <0x0A>", "​﻿", "y" * 5000, "  \n  x"]
    assert c.count(odd) == [len(c.library.encode(t)) for t in odd]


def test_warc_round_trip(spark):
    ship(spark)
    big = "é" * 600 + "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "u1", big), (5, "u\n5", big), (5, "u5", big), (None, "u", big), (2, None, "short"), (3, "u3", "short"), (4, "u4", None), (6, "u6", "x" * 1000), (None, "n", "y" * 1000), (None, "n", "y" * 1000)]
    out = warc.deduplicated(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    size, digest = len(big.encode()), hashlib.sha1(big.encode()).hexdigest()
    mine = sorted(((r["page_id"] or -1), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out if r["payload_digest"] == digest)
    assert mine == [(-1, "revisit", 5, size), (1, "revisit", 5, size), (5, "response", None, size), (5, "response", None, size)]
    assert all(r["record_type"] == "response" for r in out if r["payload_digest"] != digest)
    assert warc.deduplicated(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_payloads_survive(spark, tmp_path):
    ship(spark)
    pages = spark.createDataFrame([(i, f"u{i}", f"p{i}\r\n\r\n" * 50) for i in range(30)], "page_id long, url string, html string").repartition(3)
    warc.archive(pages, str(tmp_path / "a"))
    assert {r["page_id"]: r["payload"] for r in warc.read(spark, str(tmp_path / "a"), payloads=True).collect()} == {r["page_id"]: r["html"] for r in pages.collect()}


def test_warc_archives_are_bounded_and_ids_unique(spark, tmp_path, monkeypatch):
    """Many small and some large payloads in one partition; several shelves."""
    import gzip

    ship(spark)
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = [(i, f"u{i}", "".join(rng.choice(letters, 300_000 if i % 50 == 0 else 40))) for i in range(600)] + [(7, "again", "z" * 2000)] * 3 + [(8, "v", "z" * 2000), (601, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500_000)
    monkeypatch.setattr(warc, "SHELF_RECORDS", 100)
    raw, done = str(tmp_path / "raw"), str(tmp_path / "done")
    warc.archive(pages, raw)
    assert len(warc._shelves(spark, raw)) > 3
    warc.resolve(spark, raw, done)
    ids, kinds = [], {}
    for folder in (raw, done):
        for f in sorted((tmp_path / folder).rglob("part-*")):
            plain = gzip.decompress(f.read_bytes())
            assert len(plain) <= 500_000 + 1_000 and plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
            heads = [h for h, _ in warc._records(memoryview(f.read_bytes()))]
            ids += [h["WARC-Record-ID"] for h in heads]
            kinds.setdefault(folder, []).extend(h["WARC-Type"] for h in heads if h["WARC-Type"] != "warcinfo")
            assert all(h["Content-Type"] for h in heads)
    assert len(ids) == len(set(ids))
    assert kinds[raw] == ["response"] * len(rows) and sorted(kinds[done]) == ["response"] * (len(rows) - 3) + ["revisit"] * 3
    got = {(r["page_id"], r["payload"]) for r in warc.read(spark, done, payloads=True).filter("record_type = 'response'").collect()}
    assert got == {(i, h or "") for i, _, h in rows if (i, len(h or "")) != (7, 2000)}


def test_mixing(docs, none):
    got = complete(mixing.taken(docs), docs)
    assert got[3][0]["size"] == 0 and got[3][0]["taken"] == 0 and got[7][0]["size"] == 60_000
    assert all(r["taken"] <= 2 * r["size"] for v in got.values() for r in v)
    assert got[6][0]["source_size"] == got[8][0]["source_size"]  # the null source
    assert mixing.taken(none).count() == 0
    assert {r["taken"] for r in mixing.taken(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


def test_mix_of_many_shards_and_sources_by_brute_force(spark, monkeypatch):
    """Null, equal and missing ids, empty texts and sources, more sources than a part of a running sum holds."""
    rng = np.random.default_rng(4)
    rows = [(int(i) if i % 11 else None, " ".join(f"w{x}" for x in rng.integers(0, 90, int(rng.integers(0, 300)))) if i % 13 else None, f"s{rng.integers(0, 9)}" if i % 7 else None) for i in range(200)]
    rows += [(500, "one text that is here twice", "s1")] * 2 + [(501, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want, drawn = mixing_twin.taken(rows, 32)
    assert len({shard for shard, _ in drawn}) > 20
    close = lambda x: (*x[:3], round(x[3], 6), x[4])
    for part in (mixing.PART, 3):
        monkeypatch.setattr(mixing, "PART", part)
        got = mixing.taken(df, 32).collect()
        assert sorted(map(close, got), key=repr) == sorted(map(close, want), key=repr)
    sources = mixing.layout(df)[1]
    counts = {(r["shard"], r["number"] - 1): r["count"] for r in mixing.draw(sources, 32).collect()}
    assert counts == dict(drawn)
    # the counts of a shard vary as draws do, and come to each source's slots
    total = sum(counts.values())
    shares = [counts.get((s, 1), 0) / 32 for s in range(total // 32)]
    p = sum(n for (_, k), n in counts.items() if k == 1) / total
    assert 0.3 < np.var(shares) / (p * (1 - p) / 32) < 3


def test_permutation_is_one(spark):
    for a, b in ((1, 1), (1, 7), (5, 13), (31, 33)):
        df = mixing.permute(spark.range(a * b).withColumns({"a": F.lit(a).cast("long"), "b": F.lit(b).cast("long"), "k": F.lit(3)}), "id", "a", "b", ["k"], "p")
        assert sorted(r["p"] for r in df.collect()) == list(range(a * b))


def test_targets_share_the_excess(spark):
    rows = [("a", 10), ("b", 1000), ("c", 100), (None, 50), ("z", 0)]
    ship(spark)
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long"), (3, 1, 2), 1.5, 2.0).collect()}
    # by rounds of resharing
    weight = {"a": 3, "b": 1, "c": 2, "z": 3, None: 1}
    size, left, want, free = dict(rows), 1.5 * 1160, dict.fromkeys(weight, 0.0), set(weight)
    while left > 1e-9 and free:
        level = left / sum(weight[s] for s in free)
        for s in free:
            want[s] += level * weight[s]
        left = sum(max(0, want[s] - 2 * size[s]) for s in free)
        free = {s for s in free if want[s] < 2 * size[s]}
        want = {s: min(v, 2 * size[s]) for s, v in want.items()}
    assert got == pytest.approx(want)


def test_mixed_texts_hold_the_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "s"), (2, "f g", "s"), (3, "h", "t")], "doc_id long, text string, source string")
    out = [w for r in mixing.mixed_texts(docs).collect() for w in r["text"].split()]
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect()}
    assert len(out) == sum(taken.values()) and set(out) <= set("abcdefgh")


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, none, tmp_path, k):
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, none, str(tmp_path)).count() == 0
    out = stage(spark, docs, str(tmp_path))
    assert out.count() > 0 and (name == "mixing" or out.schema == docs.schema)


def test_scratch_goes_with_its_group(spark):
    ship(spark)
    with scratch.step(spark, "check"):
        kept = scratch.table(spark.range(3), "a")
    assert kept.count() == 3
    other = scratch.table(spark.range(2), "b")
    with scratch.step(spark, "check"):
        pass
    assert other.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_names_of_inner_columns_are_free(spark):
    ship(spark)
    token = 'config token = "0123456789abcdef0123456789abcdef01234567" set'
    near = "the quick brown fox jumps over the lazy dog again and again today"
    rows = [(1, near), (2, near), (3, token), (4, None), (5, "two words"), (5, "two words")]
    rest = ["_id", "_ID_", "_row", "_tessera_found", "__text", "_tokens", "a", "component_id"]
    plain = spark.createDataFrame([(*r, "en", "s", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    model = language.train(plain, F.lit(True))
    docs = plain.select("*", *(F.lit(i).alias(n) for i, n in enumerate(rest)))
    whole = lambda df: sorted(df.select("doc_id", "text").collect(), key=repr)
    for step in (neardup.deduplicate, secrets.redact, lambda d: language.known_language(d, model)):
        got = step(docs)
        assert got.columns == docs.columns and whole(got) == whole(step(plain))
        assert got.select(*rest).distinct().collect() == [tuple(range(len(rest)))]
    carried = language.identify(docs, model, {n: F.col(n) for n in ("doc_id", "__text")}, mixture=False)
    assert carried.columns == ["doc_id", "__text", "lang_pred", "score"] and {r["__text"] for r in carried.collect()} == {rest.index("__text")}
    assert scratch.free_name(["A", "a_"], "a") == "a__"
