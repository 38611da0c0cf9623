"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

The mix is a row of slots, each of one block of words. Slot i has the golden-ratio point frac((i + 1/2) * 0.618...), which
is mapped through the sources' cumulative shares; so every stretch of the mix holds each source nearly in proportion. The
k-th slot of a source takes the k-th block of that source's stream: its documents in shuffled order, laid end to end and
repeated up to three times, cut into blocks of equal word counts.

No step collects a source in one task: both rankings (slots of a source, words before a document within its source) count
within bounded buckets first and add the sums of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termspark.llm.common import WORD, cut, partitions, row_key, table

GOLDEN = 0.6180339887498949
#: A source is repeated this many times at most.
MAX_REPEATS = 3
#: Buckets that a source's documents are shuffled into.
BUCKETS = 4096


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """key (of doc_id, text and source), doc_id, source and size; written once, so that the texts are read once."""
    return cut(docs.select(row_key("doc_id", "text", "source").alias("key"), "doc_id", "source", word_count("text").alias("size")))


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, target, source_rank: one row per source (few rows).

    Sources weigh 1, 2, 3, repeating, by code point order with null last, and share the size of everything. A target stops
    at three times its source's size; the excess is shared again by weight. In the order of limit over weight, the sources
    that stop are a prefix: a source stops if the share for a unit of weight, after all before it have stopped, reaches its
    limit.
    """
    one = W.partitionBy(F.lit(1))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("source_rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.select("*", ((F.col("source_rank") - 1) % 3 + 1).alias("weight"), (MAX_REPEATS * F.col("source_size")).alias("limit"))
    by_limit = one.orderBy(F.col("limit") / F.col("weight"), "source_rank")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    left = weighed.select(
        "*",
        (F.sum("source_size").over(one) - F.coalesce(F.sum("limit").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"),
    )
    stops = left.select("*", (F.col("left").cast("double") / F.col("weights") * F.col("weight") >= F.col("limit")).alias("stops"))
    level = stops.select("*", F.min(F.when(~F.col("stops"), F.struct(F.col("limit") / F.col("weight"), "source_rank", "left", "weights"))).over(one).alias("first_free"))
    share = F.col("first_free.left").cast("double") / F.col("first_free.weights") * F.col("weight")
    return level.select("source", "source_size", F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(share).alias("target"), "source_rank")


def golden_point(slot: Column) -> Column:
    """frac((slot + 1/2) * GOLDEN). The slot's low 26 bits and the rest are multiplied apart, so that no slot below 2 ** 52 loses
    more than about eight decimals; a product of all bits would be too large for its fraction."""
    low, high = F.pmod(slot, F.lit(1 << 26)), F.floor(slot / (1 << 26))
    sum_ = (low + 0.5) * GOLDEN + high * ((GOLDEN * (1 << 26)) % 1.0)
    return sum_ - F.floor(sum_)


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """slot, source_rank, block_no: which block of which source each slot of the mix takes.

    There are ceil(total / block) slots. Slots are ranked within their source by chunks of 4096 slots.
    """
    spark = goals.sparkSession
    one = W.partitionBy(F.lit(1))
    upper = F.sum("target").over(one.orderBy("source_rank"))
    spans = goals.where("target > 0").select("source_rank", F.sum("target").over(one).alias("total"), upper.alias("high"))
    total, steps = spans.agg(F.max("total"), F.array_sort(F.collect_list(F.struct("high", "source_rank")))).first()
    slots = spark.range(0, -int(-(total or 0) // block), 1, partitions(spark)).withColumnRenamed("id", "slot")
    passed = F.size(F.filter(F.lit([h for h, _ in steps[:-1]] or [float("inf")]), lambda h: h <= golden_point(F.col("slot")) * (total or 0)))
    placed = slots.select("slot", F.element_at(F.lit([r for _, r in steps] or [0]), passed + 1).alias("source_rank"), F.floor(F.col("slot") / 4096).alias("chunk"))
    inner = placed.select("*", F.row_number().over(W.partitionBy("chunk", "source_rank").orderBy("slot")).alias("nth"))
    sums = placed.groupBy("chunk", "source_rank").agg(F.count("*").alias("n"))
    before = W.partitionBy("source_rank").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("chunk", "source_rank", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return inner.join(sums, ["chunk", "source_rank"]).select("slot", "source_rank", (F.col("earlier") + F.col("nth") - 1).alias("block_no"))


def placed_documents(rows: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """rows with source_rank, source_size, target and `begin`: the words before the document in its source's shuffled order."""
    known = rows.join(goals, rows.source.eqNullSafe(goals.source)).select(rows["*"], "source_size", "target", "source_rank")
    mixed = known.withColumn("draw", F.xxhash64(F.lit(seed), "key"))
    mixed = mixed.withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)))
    inside = W.partitionBy("source_rank", "bucket").orderBy("draw", "key").rowsBetween(W.unboundedPreceding, -1)
    sums = mixed.groupBy("source_rank", "bucket").agg(F.sum("size").alias("n"))
    before = W.partitionBy("source_rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source_rank", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return (
        mixed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, ["source_rank", "bucket"])
        .withColumn("begin", F.col("earlier") + F.col("within"))
        .drop("draw", "bucket", "earlier", "within")
    )


def mix(docs: DataFrame, block: int = 128, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, segments) of the mix.

    documents: key, doc_id, source, size, source_size, target, source_rank, begin. segments: slot, source_rank,
    begin, pass_no, words: the words that a slot takes of one repeat of a document; source_rank and begin name a document
    with a word uniquely, even where rows are repeated.

    A null text has size 0; documents without words have no segment; a null source is a source of its own, the last one.
    If nothing has words there are no slots. The last block of a source may be short. Reruns agree, as the shuffle depends
    on doc_id, text and seed alone; equal rows are interchangeable.
    """
    rows = sized(docs)
    goals = cut(targets(rows).repartition(1))
    placed = cut(placed_documents(rows, goals, seed))
    slots = schedule(goals, block)
    repeats = (
        placed.where("size > 0")
        .select("source_rank", "begin", "size", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))).alias("pass_no"))
        .withColumn("at", F.col("begin") + F.col("pass_no") * F.col("source_size"))
        .where(F.col("at") < F.col("target") + 8 * block * F.log2(F.col("target") + 4))  # far more than the slots of the source can reach
    )
    pieces = repeats.select("*", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block_no"))
    words = F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * block) - F.greatest(F.col("at"), F.col("block_no") * block)
    segments = pieces.join(slots, ["source_rank", "block_no"]).select("slot", "source_rank", "begin", "pass_no", words.cast("long").alias("words"))
    return placed, segments


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, segments = mix(table(spark, sf_dir, "documents"))
    taken = segments.groupBy("source_rank", "begin").agg(F.sum("words").alias("taken"))
    with_words = placed.where("size > 0").join(taken, ["source_rank", "begin"], "left")
    both = with_words.unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return both.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: once for each repeat of which it takes half the words or more.

    Documents that the mix does not take go; so do those without words.
    """
    placed, segments = mix(docs)
    taken = segments.groupBy("source_rank", "begin", "pass_no").agg(F.sum("words").alias("words"))
    copies = (
        placed.where("size > 0")
        .join(taken, ["source_rank", "begin"])
        .where("2 * words >= size")
        .groupBy("key")
        .agg(F.count("*").alias("copies"), F.countDistinct("begin").alias("rows"))
    )
    each = docs.select(row_key("doc_id", "text", "source").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(copies, "key")
    times = F.explode(F.sequence(F.lit(1), F.ceil(F.col("copies") / F.col("rows")).cast("int")))
    return each.select("row", times.alias("time")).select("row.*")
