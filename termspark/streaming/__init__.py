"""The change feed of provisional terms: latest state in batch and as a stream (M1 to M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termspark.sources import cut, discard


def summary(feed: DataFrame) -> DataFrame:
    """feed (term_key, ts, seq, op, label, weight) to one row per key that tells all that later changes can depend on: when it
    was last created or deleted, the last label and weight and when they were set, and the last change. Late rows are placed
    by (ts, seq). All are maxima, so they combine on the map side, and summaries combine by `merged`."""
    order = F.struct("ts", "seq")
    set_ = lambda c: F.max(F.when(F.col(c).isNotNull() & (F.col("op") != "delete"), F.struct("ts", "seq", F.col(c).alias("value")))).alias(c)
    return feed.groupBy("term_key").agg(F.max(F.when(F.col("op").isin("create", "delete"), order)).alias("since"), set_("label"), set_("weight"), F.max(F.struct("ts", "seq", "op")).alias("last"))


def merged(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("term_key").agg(*[F.max(c).alias(c) for c in ("since", "label", "weight", "last")])


def live(summaries: DataFrame) -> DataFrame:
    """term_key, label, weight, seq of the keys that are there: each field's last non-null value since the last create or
    delete; keys whose last change is a delete go, a later create revives them."""
    now = lambda c: F.when(F.col("since").isNull() | (F.struct(F.col(c)["ts"], F.col(c)["seq"]) >= F.col("since")), F.col(c)["value"]).alias(c)
    return summaries.where("last.op <> 'delete'").select("term_key", now("label"), now("weight"), F.col("last.seq").alias("seq"))


def latest_state(feed: DataFrame) -> DataFrame:
    """The live keys of a whole feed."""
    return live(summary(feed))


#: Folders that summaries are dealt to by key; a batch writes those that its keys are in.
BUCKETS = 16


def _manifest(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int]:
    """bucket to the batch that wrote it, as of the last batch (before the given one); as many rows as buckets."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    found = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/{n}/_SUCCESS"))]
    ids = [int(n.removeprefix("batch=")) for n in found if before is None or int(n.removeprefix("batch=")) < before]
    return {r["bucket"]: r["batch"] for r in spark.read.parquet(f"{folder}/manifest/batch={max(ids)}").collect()} if ids else {}


def _summaries(spark: SparkSession, folder: str, buckets: dict[int, int], schema: StructType) -> DataFrame:
    paths = [f"{folder}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(buckets.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def fold(folder: str, buckets: int = BUCKETS):
    """What a stream does with each batch (feed, batch_id): the summary of the batch is merged into the buckets that its keys are
    in, these are written below the batch's own id, and a manifest then names for each bucket the batch to read.

    A batch that is run again replaces itself: it starts from the manifest of the batch before. Readers see the last manifest
    that is complete. Data that neither this manifest nor the one before names is deleted.
    """

    def run(feed: DataFrame, batch_id: int) -> None:
        spark, place = feed.sparkSession, F.pmod(F.xxhash64("term_key"), F.lit(buckets)).cast("int")
        old, now = _manifest(spark, folder, batch_id), cut(summary(feed))
        touched = [r[0] for r in now.select(place).distinct().collect()]
        before = _summaries(spark, folder, {b: old[b] for b in touched if b in old}, now.schema)
        whole = merged(now.unionByName(before)).withColumn("bucket", place)
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/batch={batch_id}")
        named = old | dict.fromkeys(touched, batch_id)
        spark.createDataFrame(sorted(named.items()), "bucket int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch_id}")
        _forget(spark, folder, {*old.values(), *named.values()}, batch_id)
        discard(now)

    return run


def _forget(spark: SparkSession, folder: str, named: set[int], batch_id: int) -> None:
    """Delete the data that is not named and the manifests of before the last batch."""
    for part, keeps in (("data", named), ("manifest", {batch_id, batch_id - 1})):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(path):
            if int(status.getPath().getName().removeprefix("batch=")) not in keeps:
                fs.delete(status.getPath(), True)


def stream_summaries(spark: SparkSession, files: str, schema: StructType, to_feed, folder: str, files_per_batch: int = 100, buckets: int = BUCKETS) -> DataFrame:
    """The summaries of all changes in the files that are there now. The folder holds the checkpoint and the state, so a later call,
    in this session or another one, takes new files only and goes on from what is there. to_feed makes changes (term_key, ts,
    seq, op, label, weight) of rows."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(files)
    query = to_feed(rows).writeStream.foreachBatch(fold(folder, buckets)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    none = summary(to_feed(spark.createDataFrame([], schema)))
    return _summaries(spark, folder, _manifest(spark, folder), none.schema)


def stream_state(spark: SparkSession, files: str, schema: StructType, to_feed, folder: str, files_per_batch: int = 100) -> DataFrame:
    """M5: the same as latest_state, from a stream of files."""
    return live(stream_summaries(spark, files, schema, to_feed, folder, files_per_batch))


def refresh_catalog(spark: SparkSession, files: str, schema: StructType, to_feed, folder: str, files_per_batch: int = 100) -> DataFrame:
    """ld_id, pref_label, ord of a catalog that changes keep, from a stream of files.

    An entry has its last label; its place is that of its creation, which later changes keep, and one that is created again
    after it was deleted goes to the end. A service would trigger it by the hour; readers see whole versions only.
    """
    known = stream_summaries(spark, files, schema, to_feed, folder, files_per_batch)
    now = live(known).select(F.col("term_key").alias("ld_id"), F.col("label").alias("pref_label"))
    return now.join(known.select(F.col("term_key").alias("ld_id"), F.col("since.seq").alias("ord")), "ld_id")
