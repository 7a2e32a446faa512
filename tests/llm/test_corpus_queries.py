"""The corpus queries against SQL, brute force, round trips and held-out rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from pathlib import Path

import mixing_twin
import pytest
from licence_twin import licence_labels

duckdb = pytest.importorskip("duckdb")

import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import licenses, mixing, queries, secrets  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in ("documents", "benchmark", "pages", "labels"):
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_licenses_base(spark, texts):
    for r in queries.op3_licenses(spark, SF).collect():
        w = licenses.words_of(texts[r["doc_id"]])
        places = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in licenses.BASE}
        every = sum(places.values(), [])
        labels = {licenses.BASE[p] for p, x in places.items() if x}
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(every), min(every, default=None), max(every, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_language_held_out(spark, duck):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = queries.op5_language(spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_quality_held_out(spark, duck):
    label = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    rows = queries.op6_quality(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_tokens_are_the_library_s(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.op8_token_counts(spark, SF).collect():
        text = texts[r["doc_id"]]
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_mix_meets_its_targets(spark, texts):
    rows = queries.op10_mixing(spark, SF).collect()
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"] for r in rows)
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{SF}/documents.parquet'").fetchall())
    for s in set(source.values()):
        mine = [r for r in rows if source[r["doc_id"]] == s]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.03 * mine[0]["target"]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op10_mixing(spark, SF).collect()))


def test_mix_by_brute_force(spark, duck):
    rows = duck.sql("SELECT doc_id, text, source FROM documents").fetchall()
    want, _ = mixing_twin.taken(rows, mixing.SHARD_SLOTS)
    got = queries.op10_mixing(spark, SF).select("doc_id", "size", "source_size", "target", "taken").collect()
    close = lambda x: (*x[:3], round(x[3], 6), x[4])
    assert sorted(map(close, got)) == sorted(map(close, want))


def test_secrets_found_and_masked(spark):
    """On tables that hold secrets: each of them and nothing else is found, and the masked text is what a plain replacement gives."""
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    planted = re.compile(r'(?i)(?<=token = ")[0-9a-f]{40}(?=")')
    some = 0
    for r in queries.op1_secrets(spark, folder).collect():
        want = [m.start() for m in planted.finditer(texts[r["doc_id"]])]
        assert (list(r["starts"]), r["n_findings"]) == (want, len(want))
        assert r["redacted_sha256"] == hashlib.sha256(planted.sub(secrets.MARK, texts[r["doc_id"]]).encode()).hexdigest()
        some += len(want)
    assert some


def test_secrets_forest_on_findings_it_never_saw(spark):
    """Recall and precision on labelled findings of other seeds."""
    forest = secrets.train(spark)
    for rows in (secrets.labelled_findings(1_000, 101), secrets.assigned_findings(1_000, 102)):
        table = spark.createDataFrame(rows, "value string, before string, after string, path string, label int")
        x = secrets.features(*(F.col(c) for c in ("value", "before", "after", "path")))
        got = table.select("label", (secrets.forest_score(x, forest) >= secrets.THRESHOLD).alias("said")).collect()
        true = sum(r["label"] and r["said"] for r in got)
        assert true >= 0.97 * sum(r["label"] for r in got) and true >= 0.97 * sum(r["said"] for r in got)


def test_pipeline_by_brute_force(spark, duck, texts):
    """What each stage keeps, recomputed from SQL and plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == docs.columns and out.schema == docs.schema
        rows = out.collect()
        seen.append((name, {r["doc_id"] for r in rows}, rows))
        docs = spark.createDataFrame(rows, out.schema)
    ids = {n: k for n, k, _ in seen}
    assert ids["language"] == {d for d, t in texts.items() if re.search(r"[^\W\d_]", t)}
    graph = {r[0]: r[1] for r in duck.sql(f"SELECT doc_id, component_id FROM ({queries.ORACLE['op4_near_duplicates']})").fetchall()}
    assert ids["near_duplicates"] == {min(d for d in ids["language"] if graph[d] == c) for c in {graph[d] for d in ids["language"]}}
    hit = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({queries.ORACLE['op2_decontamination']}) WHERE contaminated").fetchall()}
    assert ids["decontamination"] == ids["near_duplicates"] - hit == ids["secrets"] == ids["mixing"]
    for r in seen[3][2]:
        assert not re.search(r'(?i)token = "[0-9a-f]{40}"', r["text"]) and r["n_chars"] == len(r["text"])


def test_licenses_method_by_brute_force(spark, texts):
    """Labels and scores from every offset of every template in every file."""
    got = {r["doc_id"]: r for r in queries.op3_licenses(spark, SF).collect()}
    want = licence_labels(texts)
    assert {d: (r["n_words"], r["labels"], round(r["score"], 9)) for d, r in got.items()} == want
    assert any(labels for _, labels, _ in want.values())


#: the columns that the contract names, with their types; more may follow
CONTRACT = {
    "op2_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op4_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op5_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op9_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op10_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_are_the_contract_s(spark, name):
    got = dict(queries.QUERIES[name](spark, SF).dtypes)
    assert got["page_id" if name == "op9_warc" else "doc_id"] == "bigint"
    for column in CONTRACT.get(name, "doc_id bigint").split(", "):
        field, kind = column.split()
        assert got[field] == kind
