"""The whole integrated search in one plan: every request takes its own route.

Requests of one source and of several (C5), with and without text, with and without actions are separate sets of rows: each
step works on those that it is for. A source without text gives a slice of its stored numbers (C1 to C4, R3), one with text the
first hits of a search in the stored index; equal searches of different requests are ranked once. Pages of several sources
are ranked together (C7, C8), and pages of requests with actions are arranged (U3) with terms that are resolved as L18 says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termspark.functions import is_provisional_id
from termspark.operators.index import Names, TermIndex, matches
from termspark.operators.ordinals import SOURCE, Ordinals, fetched
from termspark.operators.paging import closest, ranked, with_defaults
from termspark.operators.search import BRANCHES, CLASSES, ONTOLOGIES, VALUE_SETS, arranged
from termspark.operators.terms import resolve_actions, source_counts
from termspark.sources import cut, discard

#: The routes of requests of one source, by its type.
ROUTES = {CLASSES: "classes", ONTOLOGIES: "ontology", BRANCHES: "branch", VALUE_SETS: "value_set"}
PART = ["request_id", "source_type", "source_idx"]


@dataclass(frozen=True)
class Store:
    """What is written once and serves all requests: the terms or their index, the numbers of sources' rows, and what is below branches and
    value sets (acronym, root_id, node_id)."""

    index: TermIndex | Names
    ordinals: Ordinals
    below: DataFrame


def routed(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """requests with input_text (null if blank), many, route, and the page that counts: 1 for several sources."""
    kinds = sources.groupBy("request_id").agg(F.max("source_type").alias("kind"))
    known = with_defaults(requests).join(source_counts(sources), "request_id").join(kinds, "request_id")
    single = F.element_at(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv]), F.col("kind"))
    route = F.when(F.col("many"), "several").otherwise(single)
    return known.select("request_id", "input_text", "many", route.alias("route"), F.when(F.col("many"), 1).otherwise(F.col("page")).alias("page"), "page_size")


def first_row(page: Column, total: Column) -> Column:
    """The number, from 0, of a page's first row; a page past the end is the first."""
    start = (page - 1) * F.col("page_size")
    return F.when(start < total, start).otherwise(0).cast("long")


def picked(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages of enumerated classes, which come from the request: by label, or those that contain the text, closest first."""
    own = sources.where(F.col("source_type") == CLASSES).select("request_id", "source_idx", F.col("uri").alias("ld_id"), F.col("label").alias("pref_label"))
    text = F.col("input_text")
    held = own.join(asked, "request_id").where(text.isNull() | F.contains(F.lower("pref_label"), F.lower(text)))
    near = F.coalesce(closest(F.col("pref_label"), text)[1], F.lit(0))
    label = F.when(text.isNull(), F.lower("pref_label")).asc_nulls_last()
    own_rows = W.partitionBy("request_id")
    placed = ranked(held, [near, label, F.col("source_idx")], "nth").withColumn("total", F.count("*").over(own_rows))
    start = first_row(F.col("page"), F.col("total"))
    shown = placed.withColumn("shown", (F.col("nth") > start) & (F.col("nth") <= start + F.col("page_size")))
    return shown.select("request_id", F.lit(CLASSES).alias("source_type"), F.lit(0).alias("source_idx"), "nth", "ld_id", "pref_label", "total", "shown")


def blank_pages(asked: DataFrame, sources: DataFrame, ordinals: Ordinals) -> tuple[DataFrame, DataFrame]:
    """C2 to C4 without text: (PART, nth, ld_id, pref_label; PART, total). Ontologies and branches always give their first page."""
    own = sources.where(F.col("source_type") > CLASSES).withColumn("uri", F.coalesce("uri", F.lit("")))
    sized = own.join(asked.where("input_text IS NULL"), "request_id").join(ordinals.totals, SOURCE)
    start = F.when(F.col("source_type") == VALUE_SETS, first_row(F.col("page"), F.col("total"))).otherwise(F.lit(0).cast("long"))
    wanted = sized.select("request_id", "source_idx", *SOURCE, start.alias("first"), (F.least(start + F.col("page_size"), F.col("total")) - 1).alias("last"))
    return fetched(wanted, ordinals).select(*PART, "nth", "ld_id", "pref_label"), sized.select(*PART, "total")


def text_searches(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """PART, text, search (what tells searches apart), acronyms, root: all ontologies of a request are one search."""
    own = sources.where(F.col("source_type") > CLASSES).join(asked.where("input_text IS NOT NULL"), "request_id")
    text = F.lower(F.trim("input_text")).alias("text")
    whole = own.where(F.col("source_type") == ONTOLOGIES).groupBy("request_id", text).agg(F.sort_array(F.collect_set("acronym")).alias("acronyms"))
    whole = whole.select("request_id", F.lit(ONTOLOGIES).alias("source_type"), F.lit(0).alias("source_idx"), "text", "acronyms", F.lit("").alias("root"))
    rest = own.where(F.col("source_type") > ONTOLOGIES).select(*PART, text, F.array("acronym").alias("acronyms"), F.col("uri").alias("root"))
    key = F.to_json(F.struct("source_type", "text", "acronyms", "root"))
    return whole.unionByName(rest).withColumn("search", key)


def ranked_searches(searches: DataFrame, store: Store, most: int) -> tuple[DataFrame, DataFrame]:
    """(search, nth, ld_id, pref_label of the first `most` hits of each distinct search; search, total).

    Ontologies and branches (C2, C3): classes with a name that the text begins, as it is typed. Value sets (C4, Q3): values
    whose label contains it.
    """
    few = cut(searches.select("search", "source_type", "text", F.explode("acronyms").alias("acronym"), "root").distinct())
    ahead = F.col("source_type") < VALUE_SETS
    met = matches(store.index, few.select("text", ahead.alias("ahead")).distinct())
    fits = F.when(F.col("ahead"), F.col("entity") == "class").otherwise((F.col("entity") == "value") & (F.col("match_type") == "prefLabel"))
    hits = cut(met.where(fits).select("text", "ahead", "acronym", "ld_id", "pref_label", "ord"))
    asked, told = few.withColumn("ahead", ahead), ["search", "text", "acronym", "ld_id", "pref_label", "ord"]
    free = asked.where(F.col("source_type") == ONTOLOGIES).join(hits, ["text", "ahead", "acronym"])
    roots = asked.where(F.col("source_type") > ONTOLOGIES)
    inside = store.below.select("acronym", F.col("root_id").alias("root"), F.col("node_id").alias("ld_id")).join(roots.select("acronym", "root").distinct(), ["acronym", "root"], "left_semi")
    rooted = hits.join(inside, ["acronym", "ld_id"]).join(roots, ["text", "ahead", "acronym", "root"])
    found = cut(free.select(*told).unionByName(rooted.select(*told)))
    discard(hits)
    keys = [*[c.asc_nulls_last() for c in closest(F.col("pref_label"), F.col("text"))], F.col("acronym"), F.col("ord"), F.col("ld_id")]
    placed = ranked(found, keys, "nth", "search").where(F.col("nth") <= most)
    return placed.select("search", "nth", "ld_id", "pref_label"), found.groupBy("search").agg(F.count("*").alias("total"))


def text_pages(asked: DataFrame, sources: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """C2 to C4 with text: (PART, nth, ld_id, pref_label; PART, total). Hits without a label count, but are not shown."""
    most = asked.agg(F.max(F.col("page") * F.col("page_size"))).first()[0] or 0
    searches = cut(text_searches(asked, sources))
    first, totals = ranked_searches(searches, store, most)
    sized = searches.select(*PART, "search").join(totals, "search", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    start = first_row(F.col("page"), F.col("total"))
    paged = sized.join(asked.select("request_id", "page", "page_size"), "request_id").select(*PART, "search", start.alias("start"), (start + F.col("page_size")).alias("end"))
    shown = paged.join(first, "search").where("nth > start AND nth <= end AND pref_label IS NOT NULL")
    return shown.select(*PART, "nth", "ld_id", "pref_label"), sized.select(*PART, "total")


def merged_pages(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """request_id, pos, ld_id, pref_label: the pages of each request's sources as one."""
    text, low = F.col("input_text"), F.lower("pref_label")
    together = F.col("many") & text.isNotNull()
    far = [F.when(together, c).otherwise(0).asc_nulls_last() for c in closest(F.col("pref_label"), text)]
    by_label = F.when(text.isNull(), low).asc_nulls_last()
    placed = ranked(rows.join(asked, "request_id"), [*far, by_label, F.col("source_type"), F.col("source_idx"), F.col("nth")])
    return placed.where("pos <= page_size").select("request_id", "pos", "ld_id", "pref_label")


def envelopes(asked: DataFrame, sizes: DataFrame, totals: DataFrame, provisional: DataFrame, acted: DataFrame) -> DataFrame:
    """request_id, route, page, page_count, page_size (rows shown), total_count, prev_page, next_page of every request.

    Several sources and arranged pages have no page count and no neighbours; a page in label order is one page. A list paged
    here has no page if empty, one paged by a search has page 1 of 0.
    """
    known = asked.join(totals, "request_id", "left").join(sizes, "request_id", "left").join(provisional, "request_id", "left").join(acted, "request_id", "left")
    total, page = F.coalesce("total", F.lit(0)), F.col("page")
    lone = ~F.col("many") & F.col("deletes").isNull()
    resorted = lone & F.col("input_text").isNull() & (F.col("route") != ROUTES[CLASSES])
    listed = (F.col("route") == ROUTES[CLASSES]) | F.coalesce("provisional", F.lit(False))
    forced = resorted & F.col("route").isin(ROUTES[ONTOLOGIES], ROUTES[BRANCHES])
    there = F.when(forced | ((page - 1) * F.col("page_size") >= total), 1).otherwise(page)
    number = F.when(~lone, 1).when((total == 0) & listed & ~resorted, None).otherwise(there).cast("int")
    count = F.when(~lone, None).when(resorted, 1).when(total == 0, F.when(~listed, 0)).otherwise(F.ceil(total / F.col("page_size")))
    more = lone & ~resorted & (total > 0)
    return known.select(
        "request_id",
        F.concat("route", F.when(F.col("deletes").isNotNull(), "+actions").otherwise("")).alias("route"),
        number.alias("page"),
        count.cast("long").alias("page_count"),
        F.coalesce("n", F.lit(0)).cast("long").alias("page_size"),
        (total - F.coalesce("deletes", F.lit(0))).cast("long").alias("total_count"),
        F.when(more & (there > 1), there - 1).cast("int").alias("prev_page"),
        F.when(more & (there * F.col("page_size") <= total), there + 1).cast("int").alias("next_page"),
    )


def whole_search(requests: DataFrame, sources: DataFrame, actions: DataFrame, store: Store) -> DataFrame:
    """A row for each shown term, with its request's envelope: request_id, route, page, page_count, page_size, total_count,
    prev_page, next_page, pos, ld_id, pref_label; a request without rows has one with null pos.

    requests: request_id, input_text, page, page_size. sources: request_id, source_type, source_idx, acronym, uri, label.
    actions: request_id, action (move, delete), term_uri, type, position. A moved term that is nowhere to be found, or of another
    type than a class or a value, is left out.
    """
    asked = cut(routed(requests, sources))
    chosen = picked(asked, sources)
    blank, blank_totals = blank_pages(asked, sources, store.ordinals)
    typed, typed_totals = text_pages(asked, sources, store)
    rows = chosen.where("shown").select(*PART, "nth", "ld_id", "pref_label").unionByName(blank).unionByName(typed)
    each = chosen.select(*PART, "total").distinct().unionByName(blank_totals).unionByName(typed_totals)
    totals = each.groupBy("request_id").agg(F.sum("total").alias("total"))
    pages = cut(merged_pages(asked, rows))

    acted = actions.groupBy("request_id").agg(F.count(F.when(F.col("action") == "delete", F.lit(1))).alias("deletes"))
    told = pages.join(acted.select("request_id"), "request_id", "left_semi")
    classes = sources.where(F.col("source_type") == CLASSES).select("request_id", F.col("uri").alias("ld_id"), F.col("label").alias("pref_label"), F.col("source_idx").alias("ord"))
    moves = actions.where("action = 'move'")
    named = resolve_actions(moves.select("request_id", "term_uri", "type").distinct(), told, classes, store.index.terms())
    known = moves.join(named.where("pref_label IS NOT NULL").select("request_id", "term_uri", "type", "pref_label"), ["request_id", "term_uri", "type"])
    shown = pages.join(acted.select("request_id"), "request_id", "left_anti").unionByName(arranged(told, actions, known))
    shown = cut(shown)

    made = sources.where(F.col("source_type") == VALUE_SETS).groupBy("request_id").agg(F.bool_or(is_provisional_id(F.col("uri"))).alias("provisional"))
    sizes = shown.groupBy("request_id").agg(F.count("*").alias("n"))
    return envelopes(asked, sizes, totals, made, acted).join(shown, "request_id", "left")
