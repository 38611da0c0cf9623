"""Ranking, cutting and paging per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_PAGE_SIZE = 50


def with_defaults(requests: DataFrame) -> DataFrame:
    """Page and page size of zero or less get their defaults; blank text becomes null, other text is not trimmed."""
    size = F.when(F.col("page_size") > 0, F.col("page_size")).otherwise(DEFAULT_PAGE_SIZE)
    text = F.when(F.length(F.trim("input_text")) > 0, F.col("input_text"))
    return requests.withColumns({"page": F.greatest("page", F.lit(1)), "page_size": size, "input_text": text})


def closest(label: Column, query: Column) -> list[Column]:
    """Labels that contain the query first, then by edit distance; both without regard to case.

    The distance to a label that contains the query is the difference of their lengths, so it is computed for the others only.
    """
    low, q = F.lower(label), F.lower(query)
    near = F.when(F.contains(low, q), F.length(low) - F.length(q)).otherwise(F.levenshtein(low, q))
    return [(~F.contains(low, q)).cast("int"), near]


def ranked(rows: DataFrame, keys: list[Column], name: str = "pos", by: str = "request_id") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*keys)))


def page_of(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of the request's page; a page past the end is page 1. Needs page, page_size and total; pos restarts at 1."""
    page = F.when((F.col("page") - 1) * F.col("page_size") < F.col("total"), F.col("page")).otherwise(1)
    start = (page - 1) * F.col("page_size")
    return rows.where((F.col(pos) > start) & (F.col(pos) <= start + F.col("page_size"))).withColumn(pos, (F.col(pos) - start).cast("int"))


def envelope(requests: DataFrame, totals: DataFrame, compat_next_page: bool = True) -> DataFrame:
    """request_id, page, page_count, page_size (rows returned), total_count, prev_page, next_page.

    With compat_next_page a last page that is exactly full still names a next one.
    """
    joined = requests.join(totals, "request_id", "left").withColumn("n", F.coalesce("total", F.lit(0)))
    past = (F.col("page") - 1) * F.col("page_size") >= F.col("n")
    page = F.when(F.col("n") == 0, None).when(past, 1).otherwise(F.col("page"))
    more = page * F.col("page_size") <= F.col("n") if compat_next_page else page * F.col("page_size") < F.col("n")
    return joined.select(
        "request_id",
        page.alias("page"),
        F.when(F.col("n") > 0, F.ceil(F.col("n") / F.col("page_size"))).cast("long").alias("page_count"),
        F.greatest(F.least(F.col("page_size"), F.col("n") - (page - 1) * F.col("page_size")), F.lit(0)).cast("long").alias("page_size"),
        F.col("n").cast("long").alias("total_count"),
        F.when(page > 1, page - 1).alias("prev_page"),
        F.when(more, page + 1).alias("next_page"),
    )


def page_within(rows: DataFrame, by: list[str], keys: list[str], page: int, size: int) -> DataFrame:
    """rows with pos and total: one page of each group, in the order of the keys; a page past the end is page 1.

    Only the first `page` pages of a group are ranked; each task drops the others before the shuffle.
    """
    totals = rows.groupBy(*by).agg(F.count("*").alias("total"))
    first = rows.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy(*keys))).where(F.col("pos") <= page * size).join(totals, by)
    start = F.when(F.col("total") > (page - 1) * size, (page - 1) * size).otherwise(0)
    return first.where((F.col("pos") > start) & (F.col("pos") <= start + size)).withColumn("pos", (F.col("pos") - start).cast("int"))


def last_shown(requests: DataFrame) -> int:
    """The last row that any request's page shows, a limit for ranking."""
    return requests.agg(F.max(F.col("page") * F.col("page_size"))).first()[0] or 0


def limited(hits: DataFrame, requests: DataFrame, keys: list[Column]) -> DataFrame:
    """hits with pos and total, those behind the last row that any page shows left out: every task drops them before the
    shuffle, and totals are counts of their own, which combine before theirs."""
    totals = hits.groupBy("request_id").agg(F.count("*").alias("total"))
    return ranked(hits, keys).where(F.col("pos") <= last_shown(requests)).join(totals, "request_id")


def first_ranked(hits: DataFrame, most: int, keys: list[Column], by: str) -> DataFrame:
    """hits with pos and total, the first `most` rows of each group in the order of the keys.

    hits should be written, as it is read twice: totals are counts, which combine before they are shuffled, and rows are ranked
    behind the limit, which every task applies first. Keys that begin with those of `closest` are evaluated for hits that contain
    the query; for the others only where those do not fill the pages.
    """
    far = keys[0] != 0
    totals = hits.groupBy(by).agg(F.count("*").alias("total"), F.count(F.when(keys[0] == 0, F.lit(1))).alias("_inside"))
    sized = hits.join(totals, by).where((F.col("_inside") < most) | ~F.coalesce(far, F.lit(True))).drop("_inside")
    return ranked(sized, keys, by=by).where(F.col("pos") <= most)


def first_pages(hits: DataFrame, requests: DataFrame, keys: list[Column]) -> DataFrame:
    """hits with pos and total: each request's page (page, page_size) of its hits in the order of the keys; see first_ranked.
    hits has request_id, page, page_size."""
    return page_of(first_ranked(hits, last_shown(requests), keys, "request_id"))
