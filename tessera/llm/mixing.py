"""Mixing sources to target weights, block by block.

Each source's words are packed, document after document, into blocks of one
length. The mix is dealt over output shards of one length in slots: of each
shard the number of slots per source is a multinomial draw, made without
replacement, so that the counts of a source over all shards come to its target
(the draw is conditioned on the totals). For that the slots of all sources are
numbered through, a pseudorandom permutation of these numbers gives each its
shard, and the counts of a shard and source are what the mix is made from:
the running sum of a source's counts numbers its slots shard after shard, and
slot j takes block p(j mod n) of the source's n blocks, where p is a
pseudorandom permutation of the block indices (Feistel networks over the
residues of two factors). Slots meet blocks in a join by index.

Running sums (word offsets, slot numbers, ranks and ticket ranges of sources)
are made in two levels, so that no task needs all rows of a source, all sources
or all shards.

Defined cases: null or empty texts have size 0 and are taken 0 times; a null
source is a source of its own, last in order; sources without words have
target 0; rows with equal ids are separate documents. Results depend on the
rows only, not on their order or partitions. No column of the input is
reserved; ids may be of any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: words of a block; a source of fewer than LEAST_BLOCKS such blocks has shorter ones
BLOCK = 128
LEAST_BLOCKS = 64
#: slots of an output shard at most
SHARD_SLOTS = 8192
SLOTS_A_ROW = 4096
#: rows of one part of a running sum, about
PART = 1 << 20
WEIGHTS = (3, 1, 2)
SEED = 20240229
_UP_TO_BEFORE = (Window.unboundedPreceding, -1)


def _before(value: str, by: list[str], order: list) -> Column:
    """The sum of ``value`` in the rows before."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*_UP_TO_BEFORE)), F.lit(0).cast("long"))


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (one per ``key``) with ``part``, which follows the key's order, and ``number``, the rank from 1; nulls last."""
    order = F.asc_nulls_last(key)
    parts = max(1, -(-rows.count() // PART))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)).cast("long")
    if parts == 1:
        return scratch.table(rows.withColumn("part", F.lit(0)).withColumn("number", inside), "numbered")
    dealt = scratch.table(rows.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "ranked")
    sums = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per PART rows
    sums = sums.select("part", _before("n", [], ["part"]).alias("_base"))
    return scratch.table(dealt.join(F.broadcast(sums), "part").withColumn("number", F.col("_base") + inside).drop("_base"), "numbered")


def targets(sources: DataFrame, weights: tuple[int, ...], total: float, most: float) -> DataFrame:
    """Adds ``part, number, target`` to ``source, source_size``: shares by weight, at most ``most`` times a source's size.

    The level of a unit of weight rises from round to round: what sources at their cap leave goes to the others, until none is above its cap.
    """
    rows = ranked(sources, "source")
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    level, at = 0.0, -1
    while True:  # sums of whole numbers, so that the order of addition cannot show
        full = F.col("source_size") * F.lit(float(most)) <= F.col("weight") * F.lit(level)
        got = rows.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if got[3] == at or not got[2]:
            break
        at, level = got[3], (total * got[0] - most * (got[1] or 0)) / got[2]
    cap = F.col("source_size") * F.lit(float(most))
    return rows.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if got[2] else cap).drop("weight")


def permute(df: DataFrame, index: str, a: str, b: str, keys: list[str], out: str, rounds: int = 4, seed: int = SEED) -> DataFrame:
    """Adds ``out``: the image of ``index`` in [0, a * b) under the pseudorandom permutation that ``keys`` name.

    Each half round is a column of its own, so that no round is computed more than once.
    """
    named = [F.col(k) for k in keys]
    df = df.withColumn("_x", F.col(index) % F.col(a)).withColumn("_y", F.expr(f"{index} div {a}"))
    for r in range(rounds):
        df = df.withColumn("_x", F.pmod(F.col("_x") + F.pmod(F.xxhash64("_y", F.lit(2 * r + seed), *named), F.col(a)), F.col(a)))
        df = df.withColumn("_y", F.pmod(F.col("_y") + F.pmod(F.xxhash64("_x", F.lit(2 * r + 1 + seed), *named), F.col(b)), F.col(b)))
    return df.withColumn(out, F.col("_x") + F.col(a) * F.col("_y")).drop("_x", "_y")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def layout(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents and sources as written tables.

    Documents: one row per row of ``docs``: row, doc_id, size, its source's figures, and ``offset``, the document's first word in its source.
    Sources: number, part, source_size, target, and how many blocks (n = a * b, the first r of q + 1 words, the others of q) and slots they have.
    """
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), _key(F.col(f"`{source_col}`").cast("string")).alias("key"), size.alias("size"), F.xxhash64(text).alias("print"))
    sizes = scratch.table(sizes, "sizes")
    # documents without an id, or with one id, are told apart by their texts
    buckets = int(sizes.count() ** 0.5) + 1
    sizes = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "print"), F.lit(buckets)))
    sums = scratch.table(sizes.groupBy("key", "bucket").agg(F.sum("size").alias("words")), "sums")
    sources = sums.groupBy("key").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("key") != "n", F.substring("key", 2, (1 << 31) - 1)))
    sources = targets(sources, weights, total, most).drop("source")
    wanted = F.greatest(F.lit(1.0), F.col("source_size") / F.greatest(F.lit(1.0), F.least(F.lit(float(block)), F.floor(F.col("source_size") / LEAST_BLOCKS).cast("double"))))
    sources = sources.withColumn("a", F.floor(F.sqrt(wanted)).cast("long")).withColumn("b", F.greatest(F.lit(1).cast("long"), F.floor(wanted / F.col("a")).cast("long")))
    sources = sources.withColumn("n", F.col("a") * F.col("b")).withColumn("q", F.expr("source_size div n")).withColumn("r", F.col("source_size") % F.col("n"))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n") / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    sources = scratch.table(sources.withColumn("slots", slots), "sources")
    known = sums.withColumn("base", _before("words", ["key"], ["bucket"])).drop("words").join(sources.drop("part", "slots"), "key")
    placed = sizes.withColumn("inside", _before("size", ["key", "bucket"], ["doc_id", "print", "size", "row"])).join(known, ["key", "bucket"])
    placed = placed.select("row", "doc_id", "size", "number", "source_size", "target", "n", "q", "r", (F.col("base") + F.col("inside")).alias("offset"))
    return scratch.table(placed, "placed"), sources


def _start(i: Column) -> Column:
    return i * F.col("q") + F.least(i, F.col("r"))


def _block_of(word: Column) -> Column:
    long = F.col("r") * (F.col("q") + 1)
    return F.when(word < long, F.floor(word / (F.col("q") + 1))).otherwise(F.col("r") + F.floor((word - long) / F.greatest(F.lit(1).cast("long"), F.col("q")))).cast("long")


def pieces(placed: DataFrame) -> DataFrame:
    """Of each block the parts of documents in it: number, block, row, doc_id, first (word of the document), words."""
    last = F.col("offset") + F.col("size") - 1
    spread = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(_block_of(F.col("offset")), _block_of(last))))
    begin = F.greatest(F.col("offset"), _start(F.col("block")))
    end = F.least(last + 1, _start(F.col("block") + 1))
    return spread.select("number", "block", "row", "doc_id", (begin - F.col("offset")).alias("first"), (end - begin).alias("words"))


def _spread(rows: DataFrame, count: str, total: int) -> DataFrame:
    """One row, with ``index`` from 0, for each of the ``count`` of a row; the number of tasks follows what comes out, not the rows."""
    parts = rows.filter(F.col(count) > 0).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {SLOTS_A_ROW}"))))
    parts = parts.repartition(max(1, -(-total // (16 * SLOTS_A_ROW))), "number", "_part", *(c for c in rows.columns if c == "shard"))
    first = F.col("_part") * SLOTS_A_ROW
    return parts.withColumn("index", F.explode(F.sequence(first, F.least(first + SLOTS_A_ROW, F.col(count)) - 1))).drop("_part")


def draw(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``shard, number, count``: how many slots of a shard each source fills, a multinomial draw conditioned on the sources' totals."""
    total = int(sources.agg(F.sum("slots")).first()[0] or 0)
    shards = max(1, -(-total // shard_slots))
    length = max(1, -(-total // shards))
    parts = sources.groupBy("part").agg(F.sum("slots").alias("n"))  # one row per PART sources
    parts = parts.select("part", _before("n", [], ["part"]).alias("base"))
    tickets = sources.select("part", "number", "slots").join(F.broadcast(parts), "part")
    tickets = tickets.select("number", "slots", (F.col("base") + _before("slots", ["part"], ["number"])).alias("first"))
    each = _spread(tickets, "slots", total).select("number", (F.col("first") + F.col("index")).alias("ticket"), F.lit(shards).cast("long").alias("a"), F.lit(length).cast("long").alias("b"))
    # a ticket's place among the shards * length places of the mix; places beyond the total stay empty
    dealt = permute(each, "ticket", "a", "b", [], "place", seed=SEED + 100).select((F.col("place") % F.lit(shards)).alias("shard"), "number")
    return scratch.table(dealt.groupBy("shard", "number").agg(F.count(F.lit(1)).alias("count")), "drawn")


def slots(sources: DataFrame, drawn: DataFrame) -> DataFrame:
    """Every slot of the mix: shard, number, slot (in its source, shard after shard), block."""
    got = drawn.agg(F.sum("count"), F.max("shard")).first()
    group = F.expr(f"shard div {int(((got[1] or 0) + 1) ** 0.5) + 1}")
    cells = drawn.withColumn("group", group)
    sums = cells.groupBy("number", "group").agg(F.sum("count").alias("n"))
    sums = sums.select("number", "group", _before("n", ["number"], ["group"]).alias("base"))
    cells = cells.withColumn("inside", _before("count", ["number", "group"], ["shard"])).join(sums, ["number", "group"])
    cells = cells.join(sources.select("number", "a", "b", "n"), "number").select("shard", "number", "count", "a", "b", "n", (F.col("base") + F.col("inside")).alias("first"))
    every = _spread(cells, "count", int(got[0] or 0)).withColumn("slot", F.col("first") + F.col("index"))
    every = every.withColumn("index", F.col("slot") % F.col("n")).withColumn("epoch", F.expr("slot div n"))
    return permute(every, "index", "a", "b", ["number", "epoch"], "block").select("shard", "number", "slot", "block")


def mix(placed: DataFrame, sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as parts of documents: shard, number (source), slot, block, row, doc_id, first, words."""
    # both sides grow beyond what their sources' sizes tell the planner, so neither may be broadcast
    return slots(sources, draw(sources, shard_slots)).hint("merge").join(pieces(placed).hint("merge"), ["number", "block"])


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix with its words, one row per slot: shard, number, slot, text. Ids must be unique here."""
    parts = mix(*layout(docs, id_col=id_col, text_col=text_col, **options))
    words = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.split(F.regexp_replace(F.col(f"`{text_col}`"), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+").alias("w"))
    cut = parts.join(words, "doc_id").select("shard", "number", "slot", F.struct("row", "first", F.array_join(F.slice("w", (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ").alias("t")).alias("part"))
    return cut.groupBy("shard", "number", "slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["t"]), " ").alias("text"))


def taken(docs: DataFrame, shard_slots: int = SHARD_SLOTS, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words of it in the slots of all shards)."""
    placed, sources = layout(docs, **options)
    got = mix(placed, sources, shard_slots).groupBy("row").agg(F.sum("words").alias("taken"))
    return placed.join(got, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
