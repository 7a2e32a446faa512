"""License scans by a positional index of rare licence words.

The words of the templates are the licence words; their document frequency in
the scanned corpus gives their idf. Of each template the words of the
highest idf are indexed, with all their positions. A file's words that are in
this index are looked up, every one of them; where a word's place in the file
less its place in a template agrees for enough of the template's postings, the
template is a candidate at that place, and it is found if its mandatory key
phrase stands in the file, too.

Base phrases are reported wherever their words stand consecutively, whatever
the method finds.

A text is read once: what the later steps need are the places of its licence
words, which are written down. Nothing is capped per file; a file of many
licences gets all their labels.

Defined cases: a null text is empty, has no words and nothing is found in it;
files of any length are read whole; repeated rows give repeated results; no
rows give no rows. The index is bounded by the templates, so it is broadcast.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import scratch
from tessera.llm.licence_texts import BASE, TEMPLATES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: words of a template that are indexed, those of the highest idf: so many at most, and at most half of them
INDEXED = 12
#: share of a template's postings that must agree on its position
AGREE = 0.6


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


VOCABULARY = sorted({w for t in (*(text for _, text, _ in TEMPLATES), *BASE) for w in words_of(t)})


def indexed(text: str) -> int:
    """How many words of a template are indexed."""
    return min(INDEXED, -(-len(set(words_of(text))) // 2))


def _places(phrase: str) -> str:
    """SQL: where the words of ``phrase`` stand consecutively, from the columns ``words`` and ``places`` of a file's licence words."""
    parts = phrase.split()
    at = " AND ".join([f"get(words, i) = '{parts[0]}'", *(f"get(words, i + {k}) = '{p}' AND get(places, i + {k}) = get(places, i) + {k}" for k, p in enumerate(parts[1:], 1))])
    some = f"array_contains(words, '{max(parts, key=len)}') AND size(words) >= {len(parts)}"
    return f"CASE WHEN {some} THEN transform(filter(sequence(0, size(words) - {len(parts)}), i -> coalesce({at}, false)), i -> get(places, i)) ELSE CAST(array() AS array<int>) END"


def _verified() -> str:
    """SQL: the templates whose key phrase stands in the file, of those in ``likely``."""
    phrases: dict[str, list[int]] = {}
    for k, (_, _, phrase) in enumerate(TEMPLATES):
        phrases.setdefault(phrase, []).append(k)
    held = (f"CASE WHEN arrays_overlap(transform(likely, c -> c.template), array({', '.join(map(str, of))})) AND size({_places(phrase)}) > 0 THEN array({', '.join(map(str, of))}) ELSE CAST(array() AS array<int>) END" for phrase, of in phrases.items())
    return f"CASE WHEN likely IS NOT NULL THEN flatten(array({', '.join(held)})) ELSE CAST(array() AS array<int>) END"


def _index(spark, frequency: DataFrame) -> DataFrame:
    """``template, label, word, at, size``: the postings of each template's rarest words, and how many they are."""
    rows = [{"template": k, "label": label, "most": indexed(text), "word": w, "at": i} for k, (label, text, _) in enumerate(TEMPLATES) for i, w in enumerate(words_of(text))]
    postings = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<template: int, label: string, most: int, word: string, at: int>>")))
    postings = postings.join(F.broadcast(frequency), "word", "left")  # at most one row per licence word
    rare = postings.withColumn("rank", F.dense_rank().over(Window.partitionBy("template").orderBy(F.coalesce("files", F.lit(0)), "word"))).filter("rank <= most")
    return rare.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("template"))).select("template", "label", "word", "at", "size")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    ``found`` lists the templates found: label, the word at which the template begins, and its agreeing share.
    """
    spark = docs.sparkSession
    low = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.split(low, _BREAK, -1).alias("w"))
    # a text that begins or ends with a break has an empty string there
    lead, n = "CAST(get(w, 0) = '' AS int)", "size(w) - CAST(get(w, 0) = '' AS int) - CAST(size(w) > 1 AND get(w, size(w) - 1) = '' AS int)"
    some = ", ".join(f"'{w}'" for w in VOCABULARY)
    hits = f"filter(sequence(0, size(w) - 1), i -> get(w, i) IN ({some}))"
    src = src.select("doc_id", F.expr(n).cast("long").alias("n_words"), F.expr(lead).alias("lead"), "w", F.expr(hits).alias("hits"))
    src = src.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.expr("transform(hits, i -> i - lead)").alias("places"), F.expr("transform(hits, i -> get(w, i))").alias("words"))
    src = scratch.table(src, "licence_words")

    files = src.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("files"))
    index = F.broadcast(scratch.table(_index(spark, files), "licence_index"))
    each = src.select("row", F.explode(F.arrays_zip("words", "places")).alias("hit")).select("row", F.col("hit.words").alias("word"), F.col("hit.places").alias("pos"))
    agreed = each.join(index, "word").groupBy("row", "template", (F.col("pos") - F.col("at")).alias("begin")).agg(F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("size").alias("size"))
    likely = agreed.withColumn("share", F.col("n") / F.col("size")).filter(F.col("share") >= AGREE)
    likely = likely.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("template", "label", "begin", "share"))).alias("likely"))

    joined = src.join(likely, "row", "left")
    named = joined.select("row", "doc_id", "n_words", "likely", *(F.expr(_places(phrase)).alias(f"base{k}") for k, phrase in enumerate(BASE)), F.expr(_verified()).alias("verified"))
    found = F.coalesce(F.transform(F.filter("likely", lambda c: F.array_contains("verified", c["template"])), lambda c: F.struct(c["label"].alias("label"), c["begin"].alias("begin"), c["share"].alias("share"))), F.array().cast("array<struct<label: string, begin: int, share: double>>"))
    base = [F.col(f"base{k}") for k in range(len(BASE))]
    labels = F.array_compact(F.array(*(F.when(F.size(b) > 0, F.lit(name)) for b, name in zip(base, BASE.values(), strict=True))))
    out = named.select("doc_id", "n_words", F.concat(*base).alias("at"), labels.alias("base"), found.alias("found"))
    n = F.size("at")
    return out.select(
        "doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("found", lambda x: x["label"]))), ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.when(n > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)))).alias("score"),
        "found",
    )

