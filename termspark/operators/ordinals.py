"""Rows numbered within their sources, and pages that fetch only their slice.

A source is (source_type, acronym, uri), with an empty uri for a whole ontology. Numbers come from counts: rows are sorted
into ranges, numbered within range and source, and begin where the ranges before end. So no task holds a whole source,
however large it is. A page is then a few numbers of a source, met by equality.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termspark.sources import bucketed, cut, discard

SOURCE = ["source_type", "acronym", "uri"]
#: Rows of a source in a slice; pages read the slices that they touch.
SLICE = 256


def numbered(rows: DataFrame, by: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with nth, from 0 by the keys within each source; the sources with their totals), both written. Columns in `by` must
    not be null, and the keys must tell the rows of a source apart."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(ranges, *by, *keys).withColumn("_range", F.spark_partition_id()))
    sizes = cut(dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n")))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*keys))
    placed = dealt.withColumn("_own", own).join(starts, [*by, "_range"]).withColumn("nth", F.col("_start") + F.col("_own") - 1)
    out = cut(placed.drop("_range", "_own", "_start")), cut(sizes.groupBy(*by).agg(F.sum("_n").alias("total")))
    discard(dealt, sizes)
    return out


def slice_key(nth) -> F.Column:
    """Where a row of a source is kept: sources are spread over their slices, so a large one is not one key."""
    return F.xxhash64(*SOURCE, F.floor(nth / SLICE).cast("long"))


@dataclass
class Ordinals:
    """rows: SOURCE, nth, ld_id, pref_label, in buckets by slice; totals: SOURCE, total."""

    rows: DataFrame
    totals: DataFrame


def ordinals(rows: DataFrame, keys: list[str]) -> Ordinals:
    """The stored numbers of rows (SOURCE, ld_id, pref_label and the keys)."""
    placed, totals = numbered(rows, SOURCE, keys)
    kept = bucketed(placed.select(*SOURCE, "nth", "ld_id", "pref_label").withColumn("slice", slice_key(F.col("nth"))), "slice")
    discard(placed)
    return Ordinals(kept, totals)


def source_list(terms: DataFrame, below: DataFrame, types: tuple[int, int, int, int]) -> DataFrame:
    """SOURCE, ld_id, pref_label, ord, is_provisional of the classes of every ontology, of what is below each class, of the values
    of each value set, and of the value sets of each collection.

    terms: acronym, ld_id, pref_label, ord, is_provisional, entity; below: acronym, root_id, node_id. types: the numbers of
    ontologies, branches, value sets and collections.
    """
    ontologies, branches, sets, collections = types
    row = ["ld_id", "pref_label", "ord", "is_provisional"]
    kind = F.when(F.col("entity") == "class", ontologies).otherwise(collections)
    own = terms.where("entity <> 'value'").select(kind.alias("source_type"), "acronym", F.lit("").alias("uri"), *row)
    named = below.select("acronym", F.col("root_id").alias("uri"), F.col("node_id").alias("ld_id")).join(terms, ["acronym", "ld_id"])
    return own.unionByName(named.select(F.when(F.col("entity") == "class", branches).otherwise(sets).alias("source_type"), "acronym", "uri", *row))


def fetched(wanted: DataFrame, stored: Ordinals) -> DataFrame:
    """wanted (SOURCE, first, last and any other columns) with nth, ld_id and pref_label of the rows from first to last.

    The numbers wanted are listed and meet the stored rows in their buckets, so other slices' rows do not travel.
    """
    each = wanted.where("last >= first").withColumn("nth", F.explode(F.sequence("first", "last")))
    met = each.withColumn("slice", slice_key(F.col("nth")))
    return met.join(stored.rows, ["slice", *SOURCE, "nth"]).drop("slice", "first", "last")


def laid_out(sources: DataFrame, totals: DataFrame) -> DataFrame:
    """sources (request_id, SOURCE, source_idx) with total and start, the number of rows that the request's sources before
    them have; a request's sources are few."""
    sized = sources.join(totals, SOURCE, "left").withColumn("total", F.coalesce("total", F.lit(0)))
    before = W.partitionBy("request_id").orderBy("source_type", "source_idx").rowsBetween(W.unboundedPreceding, -1)
    return sized.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0)))


def retrieve_pages(requests: DataFrame, sources: DataFrame, stored: Ordinals) -> DataFrame:
    """Requests (request_id, page, page_size) to request_id, pos, source_type, ld_id, pref_label: the sources end to end,
    in their order, of which a page reads only its own rows. A page past the end is page 1.

    sources: request_id, source_type (0: an enumerated class, of which uri and label are all), source_idx, acronym, uri, label.
    """
    own = sources.withColumn("uri", F.coalesce("uri", F.lit("")))
    classes = own.where("source_type = 0").select(*SOURCE, F.lit(1).cast("long").alias("total")).distinct()
    placed = laid_out(own, stored.totals.unionByName(classes))
    sums = placed.groupBy("request_id").agg(F.sum("total").alias("all"))
    paged = requests.select("request_id", "page", "page_size").join(sums, "request_id")
    begin = F.when((F.col("page") - 1) * F.col("page_size") < F.col("all"), (F.col("page") - 1) * F.col("page_size")).otherwise(0)
    cuts = placed.join(paged.select("request_id", begin.alias("begin"), (begin + F.col("page_size")).alias("end")), "request_id")
    first = F.greatest(F.col("begin") - F.col("start"), F.lit(0)).cast("long")
    last = (F.least(F.col("end") - F.col("start"), F.col("total")) - 1).cast("long")
    wanted = cuts.select("request_id", "start", "begin", "label", *SOURCE, first.alias("first"), last.alias("last"))
    at = (F.col("start") + F.col("nth") - F.col("begin") + 1).cast("int").alias("pos")
    shown = fetched(wanted.where("source_type > 0"), stored).select("request_id", at, "source_type", "ld_id", "pref_label")
    ones = wanted.where("source_type = 0 AND last >= first").withColumn("nth", F.col("first"))
    return shown.unionByName(ones.select("request_id", at, "source_type", F.col("uri").alias("ld_id"), F.col("label").alias("pref_label")))


def source_pages(requests: DataFrame, stored: Ordinals) -> DataFrame:
    """L9, L11, L13 with the page that each request (request_id, SOURCE, page, page_size) asks for: request_id, pos, ld_id,
    pref_label, total; a page past the end has no rows."""
    asked = requests.join(stored.totals, SOURCE)
    first = ((F.col("page") - 1) * F.col("page_size")).cast("long")
    wanted = asked.withColumns({"first": first, "last": F.least(first + F.col("page_size"), F.col("total")) - 1, "begin": first})
    return fetched(wanted, stored).select("request_id", (F.col("nth") - F.col("begin") + 1).cast("int").alias("pos"), "ld_id", "pref_label", "total")
