"""The operators of this subpackage bound to the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, language, licenses, mixing, neardup, quality, repetition, secrets, tokens, warc
from tessera.shipping import ship

LEARNS_LANGUAGE = "pmod(crc32(cast(doc_id as string)), 4) <> 2"
LEARNS_QUALITY = "pmod(crc32(cast(doc_id as string)), 5) <> 0"
#: folder of public tokenizer files; None takes the installed one
TOKENIZERS: str | None = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    f = F.col("_tessera_found")
    return found.select(
        "doc_id",
        f["n_candidates"].alias("n_candidates"),
        F.size(f["findings"]).cast("long").alias("n_findings"),
        F.transform(f["findings"], lambda x: x["start"].cast("long")).alias("starts"),
        F.coalesce(F.array_max(F.transform(f["findings"], lambda x: x["score"])), F.lit(0.0)).alias("score"),
        F.sha2(F.coalesce(f["redacted"], "text", F.lit("")), 256).alias("redacted_sha256"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match",
        F.array_min("spans").cast("long").alias("first_hit"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("found")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs, F.expr(LEARNS_LANGUAGE))
    held_out = F.coalesce(~F.expr(LEARNS_LANGUAGE), F.lit(False))
    return language.identify(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out}, mixture=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), F.expr(LEARNS_QUALITY))
    held_out = F.coalesce(~F.expr(LEARNS_QUALITY), F.lit(False))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    if TOKENIZERS is None:
        import public_tokenizers

        path = Path(public_tokenizers.path("piece_bpe_32k.model"))
    else:
        path = Path(TOKENIZERS) / "piece_bpe_32k.model"
    return tokens.token_counts(_table(spark, sf_dir, "documents"), path.read_bytes())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_decontamination": op2_decontamination,
    "op3_licenses": op3_licenses,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
}

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_NON_SPACE = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT row_number() OVER () AS b, item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
bp AS (SELECT b, item_id, i AS j, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT b, item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
bw AS (SELECT DISTINCT item_id, k, g FROM bp),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
runs AS (SELECT r, b, i - j AS g, i - row_number() OVER (PARTITION BY r, b, i - j ORDER BY i) AS s, dw.k FROM dw JOIN bp ON dw.k = bp.k AND dw.g = bp.g),
far AS (SELECT r, max(n) AS n FROM (SELECT r, count(*) + k - 1 AS n FROM runs GROUP BY r, b, g, s, k) GROUP BY r),
hit AS (SELECT r, count(DISTINCT p) AS n, min(p) - 1 AS a FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, CAST(coalesce(far.n, 0) AS BIGINT) AS longest_match, CAST(hit.a AS BIGINT) AS first_hit
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN far USING (r)""",
    "op4_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_NON_SPACE}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(comp.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(comp.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""",
    "op7_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_NON_SPACE}) AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
pos AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again)),
cov AS (SELECT r, count(*) AS n, sum(length(w[p])) AS chars FROM pos JOIN d USING (r) GROUP BY r),
h AS (SELECT r, array_to_string(w[i:i + 50], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 51)),
far AS (SELECT DISTINCT r FROM (SELECT r FROM h GROUP BY r, g HAVING count(*) > 1)),
ln AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, {_NON_SPACE}) GROUP BY r),
m AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(cov.chars, 0) AS chars, far.r IS NOT NULL AS far
      FROM d LEFT JOIN cov USING (r) LEFT JOIN ln USING (r) LEFT JOIN far USING (r)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * chars > 30 * word_chars OR far) AS kept FROM v""",
    "op9_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000""",
}

_POSTINGS = ", ".join(f"({k}, '{label}', '{key}', {licenses.indexed(text)}, '{w}', {i})" for k, (label, text, key) in enumerate(licenses.TEMPLATES) for i, w in enumerate(licenses.words_of(text)))
_PHRASES = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in licenses.BASE.items())

ORACLE["op3_licenses"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
post AS (SELECT * FROM (VALUES {_POSTINGS}) AS v(template, label, key, most, word, place)),
places AS (SELECT r, word, pos FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d) WHERE word IN (SELECT word FROM post)),
files AS (SELECT word, count(DISTINCT r) AS n FROM places GROUP BY word),
ranked AS (SELECT post.*, dense_rank() OVER (PARTITION BY template ORDER BY coalesce(n, 0), post.word) AS rk FROM post LEFT JOIN files ON post.word = files.word),
idx AS (SELECT *, count(*) OVER (PARTITION BY template) AS size FROM ranked WHERE rk <= most),
likely AS (SELECT r, template, any_value(label) AS label, any_value(key) AS key, count(*) / any_value(size) AS share FROM places JOIN idx ON places.word = idx.word
           GROUP BY r, template, pos - place HAVING count(*) / any_value(size) >= {licenses.AGREE}),
method AS (SELECT likely.* FROM likely JOIN d USING (r) WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || key || ' ')),
base AS (SELECT r, label, i - 1 AS pos FROM (SELECT r, w, label, phrase, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (VALUES {_PHRASES}) AS p(phrase, label, n) WHERE len(w) >= n) WHERE array_to_string(w[i:i + n - 1], ' ') = phrase),
b AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
l AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION SELECT r, label FROM method) GROUP BY r),
m AS (SELECT r, max(share) AS share FROM method GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.a AS BIGINT) AS first_word, CAST(b.z AS BIGINT) AS last_word, coalesce(b.labels, '') AS base_labels,
       coalesce(l.labels, '') AS labels, CAST(least(1, greatest(CASE WHEN b.n > 0 THEN 1 ELSE 0 END, coalesce(m.share, 0))) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN m USING (r)"""
