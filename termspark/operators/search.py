"""Term search and constraint resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termspark.operators.index import Names, TermIndex, matches
from termspark.operators.ordinals import SOURCE, Ordinals, ordinals, retrieve_pages
from termspark.operators.paging import closest, first_pages, limited, page_of, ranked, with_defaults
from termspark.sources import cut

CLASSES, ONTOLOGIES, BRANCHES, VALUE_SETS, COLLECTIONS = range(5)


def texts_of(requests: DataFrame, text: str, ahead: Column | None = None) -> DataFrame:
    """text, ahead: what an index is asked for, each once."""
    low = requests.select(F.lower(F.trim(text)).alias("text"), (F.lit(False) if ahead is None else ahead).alias("ahead"))
    return low.where("text <> ''").distinct()


def term_search(requests: DataFrame, index: TermIndex | Names) -> DataFrame:
    """requests (request_id, q, acronym, page, page_size), a row for each source, to ranked hits among regular terms, by their
    labels and synonyms."""
    met = matches(index, texts_of(requests, "q")).where("match_type <> 'property' AND NOT is_provisional").withColumn("synonym", F.try_element_at("synonyms", F.lit(1)))
    asked = requests.withColumn("text", F.lower(F.trim("q")))
    hits = cut(asked.join(met.select("text", "acronym", "ld_id", "pref_label", "synonym", "ord", "match_type"), ["text", "acronym"]))
    placed = first_pages(hits, requests, [*closest(F.col("pref_label"), F.col("q")), F.col("acronym"), F.col("ord")])
    matched = F.when((F.col("match_type") == "synonym") & (F.lower("synonym") != F.lower("pref_label")), F.col("synonym"))
    return placed.select("request_id", "pos", "ld_id", "pref_label", "match_type", matched.alias("matched_synonym"), "total")


def source_rows(requests: DataFrame, sources: DataFrame, concepts: DataFrame, closure: DataFrame, index: TermIndex | Names | None = None) -> DataFrame:
    """All rows of each (request, source) before text and rank: request_id, source_type, source_idx, ld_id, pref_label, ord.

    Enumerated classes come from the request with their labels, whatever the table holds; an ontology gives all its concepts, a branch the descendants of its root, a
    value set the values below it. Duplicates across sources stay. With an index, an ontology gives a request that has a text only
    what contains it.
    """
    asked = sources.join(requests.select("request_id"), "request_id", "left_semi")
    terms = concepts.select("acronym", "ld_id", "pref_label", "ord")
    picked = asked.where(F.col("source_type") == CLASSES).select("*", F.col("uri").alias("ld_id"), F.col("label").alias("pref_label"), F.col("source_idx").cast("long").alias("ord"))
    ontologies = asked.where(F.col("source_type") == ONTOLOGIES).drop("uri")
    if index is not None:
        texts = with_defaults(requests).where("input_text IS NOT NULL").select("request_id", F.lower("input_text").alias("text"))
        met = matches(index, texts.select("text", F.lit(False).alias("ahead")).distinct()).where("match_type = 'prefLabel' AND NOT is_provisional")
        some = ontologies.join(texts, "request_id").join(met.select("text", "acronym", "ld_id", "pref_label", "ord"), ["text", "acronym"])
        blank = ontologies.join(texts, "request_id", "left_anti").join(terms, "acronym")
        whole = blank.unionByName(some.select(*blank.columns))
    else:
        whole = ontologies.join(terms, "acronym")
    below = asked.where(F.col("source_type").isin(BRANCHES, VALUE_SETS)).withColumnRenamed("uri", "root_id").join(closure, ["acronym", "root_id"]).withColumnRenamed("node_id", "ld_id").join(terms, ["acronym", "ld_id"])
    names = ["request_id", "source_type", "source_idx", "ld_id", "pref_label", "ord"]
    return picked.select(*names).unionByName(whole.select(*names)).unionByName(below.select(*names))


def integrated_search(requests: DataFrame, rows: DataFrame, sort_scope: str = "global") -> DataFrame:
    """request_id, pos, source_type, ld_id, pref_label, total: the rows of all sources, ranked together, first page_size of them.

    With text, rows are those whose label contains it, closest first; without, all, by label. sort_scope 'page' ranks only
    the first page_size rows of each source, as they come; 'global' ranks all. Several sources always give page 1.
    """
    asked = with_defaults(requests)
    found = cut(rows.join(asked, "request_id").where("input_text IS NULL OR contains(lower(pref_label), lower(input_text))"))
    totals = found.groupBy("request_id").agg(F.count("*").alias("total"))
    most = asked.agg(F.max("page_size")).first()[0] or 0
    if sort_scope == "page":
        nth = F.row_number().over(W.partitionBy("request_id", "source_type", "source_idx").orderBy("ord", "ld_id"))
        found = found.withColumn("nth", nth).where(F.col("nth") <= most).where("nth <= page_size")
    near = F.when(F.col("input_text").isNull(), 0).otherwise(closest(F.col("pref_label"), F.col("input_text"))[1])
    by_label = F.when(F.col("input_text").isNull(), F.lower("pref_label")).asc_nulls_last()
    placed = ranked(found, [near, by_label, F.col("source_type"), F.col("source_idx"), F.col("ord"), F.col("ld_id")]).where(F.col("pos") <= most)
    return placed.where("pos <= page_size").join(totals, "request_id").select("request_id", "pos", "source_type", "ld_id", "pref_label", "total")


def single_source(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """request_id, pos, source_type, ld_id, pref_label, total, page, page_count, next_page of requests of one source each.

    With text: what contains it, closest first. Without: enumerated classes by label; the other sources as they come, and the
    page is then put in label order (R3), which leaves one page without a next one. The page asked for is honoured, but an
    ontology or a branch without text always gives page 1.
    """
    asked = with_defaults(requests)
    found = cut(rows.join(asked, "request_id").where("input_text IS NULL OR contains(lower(pref_label), lower(input_text))"))
    blank, kind = F.col("input_text").isNull(), F.col("source_type")
    near = F.when(blank, 0).otherwise(closest(F.col("pref_label"), F.col("input_text"))[1])
    by_label = F.when(blank & (kind == CLASSES), F.lower("pref_label"))
    placed = limited(found, asked, [near, by_label.asc_nulls_last(), F.col("ord"), F.col("ld_id")])
    page = F.when(blank & kind.isin(ONTOLOGIES, BRANCHES) | ((F.col("page") - 1) * F.col("page_size") >= F.col("total")), 1).otherwise(F.col("page"))
    shown = page_of(placed.withColumn("page", page))
    inside = ranked(shown.where(blank & (kind != CLASSES)), [F.lower("pref_label"), F.col("pos")], "place").drop("pos").withColumnRenamed("place", "pos")
    one = inside.select("request_id", "pos", "source_type", "ld_id", "pref_label", "total", "page", F.lit(1).cast("long").alias("page_count"), F.lit(None).cast("int").alias("next_page"))
    more = F.when(F.col("page") * F.col("page_size") <= F.col("total"), F.col("page") + 1)
    rest = shown.where(~(blank & (kind != CLASSES))).select("request_id", "pos", "source_type", "ld_id", "pref_label", "total", "page", F.ceil(F.col("total") / F.col("page_size")).cast("long").alias("page_count"), more.alias("next_page"))
    return one.unionByName(rest)


def integrated_retrieve(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """request_id, pos, source_type, ld_id, pref_label: the sources end to end, unsorted, with true paging."""
    asked = with_defaults(requests)
    placed = limited(rows.join(asked, "request_id"), asked, [F.col(c) for c in ("source_type", "source_idx", "ord", "ld_id")])
    return page_of(placed).select("request_id", "pos", "source_type", "ld_id", "pref_label")


def numbered_sources(sources: DataFrame, concepts: DataFrame, closure: DataFrame) -> Ordinals:
    """The numbers of the rows of the ontologies, branches and value sets that sources name, each source once, by ord and ld_id."""
    named = cut(sources.where(F.col("source_type") > CLASSES).select("source_type", "acronym", F.coalesce("uri", F.lit("")).alias("uri")).distinct())
    terms, row = concepts.select("acronym", "ld_id", "pref_label", "ord"), [*SOURCE, "ld_id", "pref_label", "ord"]
    # There is one row for each ontology, which all of its terms share.
    whole = F.broadcast(named.where(F.col("source_type") == ONTOLOGIES)).join(terms, "acronym").select(*row)
    inside = closure.select("acronym", F.col("root_id").alias("uri"), F.col("node_id").alias("ld_id"))
    below = named.where(F.col("source_type").isin(BRANCHES, VALUE_SETS)).join(inside, ["acronym", "uri"]).join(terms, ["acronym", "ld_id"]).select(*row)
    return ordinals(whole.unionByName(below), ["ord", "ld_id"])


def retrieved(requests: DataFrame, sources: DataFrame, concepts: DataFrame, closure: DataFrame) -> DataFrame:
    """What integrated_retrieve gives, from the sources themselves instead of all their rows.

    A source is numbered once, whatever requests name it, in tasks of sorted ranges; pages read the numbers that they show.
    """
    asked = sources.join(requests.select("request_id"), "request_id", "left_semi")
    named = asked.withColumn("uri", F.when(F.col("source_type") != ONTOLOGIES, F.col("uri")))
    return retrieve_pages(with_defaults(requests), named, numbered_sources(named, concepts, closure))


def classified(hits: DataFrame, catalog: DataFrame, collections: list[str]) -> DataFrame:
    """Hits (acronym, ld_id, pref_label) with type and total: in a collection, what the catalog of value sets has is a
    value set, the rest a value; elsewhere a class. The totals of each ontology count rows without a label, which then go."""
    sets = catalog.select("acronym", "ld_id", F.lit(True).alias("is_set")).distinct()
    totals = hits.groupBy("acronym").agg(F.count("*").alias("total"))
    kind = F.when(~F.col("acronym").isin(collections), "OntologyClass").when(F.col("is_set"), "ValueSet").otherwise("Value")
    typed = hits.join(sets, ["acronym", "ld_id"], "left").join(totals, "acronym")
    return typed.where(F.col("pref_label").isNotNull()).select("acronym", "ld_id", kind.alias("type"), "total")


def source_totals(requests: DataFrame, sources: DataFrame, concepts: DataFrame, closure: DataFrame) -> DataFrame:
    """request_id, source_type, source_idx, total: how many rows each source gives, from counts by ontology and by branch;
    no source's rows are listed. A source without rows does not appear."""
    asked = sources.join(requests.select("request_id"), "request_id", "left_semi")
    one = asked.where(F.col("source_type") == CLASSES).withColumn("total", F.lit(1).cast("long"))
    whole = asked.where(F.col("source_type") == ONTOLOGIES).join(concepts.groupBy("acronym").agg(F.count("*").alias("total")), "acronym")
    known = closure.join(concepts.select("acronym", F.col("ld_id").alias("node_id")), ["acronym", "node_id"])
    below = known.groupBy("acronym", F.col("root_id").alias("uri")).agg(F.count("*").alias("total"))
    named = asked.where(F.col("source_type").isin(BRANCHES, VALUE_SETS)).join(below, ["acronym", "uri"])
    keys = ["request_id", "source_type", "source_idx"]
    each = one.select(*keys, "total").unionByName(whole.select(*keys, "total")).unionByName(named.select(*keys, "total"))
    return each.groupBy(*keys).agg(F.sum("total").alias("total"))


def apply_actions(results: DataFrame, actions: DataFrame, terms: DataFrame) -> DataFrame:
    """results (request_id, pos, ld_id, pref_label) after deletes and moves; moved terms get their labels from terms (ld_id, pref_label)."""
    moved = actions.where("action = 'move'").join(terms.select(F.col("ld_id").alias("term_uri"), "pref_label"), "term_uri")
    return arranged(results, actions, moved)


def arranged(results: DataFrame, actions: DataFrame, moved: DataFrame) -> DataFrame:
    """results (request_id, pos, ld_id, pref_label) after actions (request_id, term_uri); moved: request_id, term_uri, position,
    pref_label of the terms to put in.

    Every row that an action names goes; then the moved terms are put in by ascending position, those beyond the end are
    dropped, and the list is cut to its former length. A page is short, so each is folded in one array.
    """
    left = results.join(actions.select("request_id", F.col("term_uri").alias("ld_id")).distinct(), ["request_id", "ld_id"], "left_anti")
    bare = lambda r: F.struct(r["ld_id"], r["pref_label"])
    lists = left.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ld_id", "pref_label"))), bare).alias("rows"))
    sizes = results.groupBy("request_id").agg(F.count("*").cast("int").alias("size"))
    put = F.struct("position", F.col("term_uri").alias("ld_id"), "pref_label")
    moves = moved.groupBy("request_id").agg(F.array_sort(F.collect_list(put)).alias("moves"))
    empty = "cast(array() AS array<struct<ld_id:string,pref_label:string>>)"
    folded = f"""aggregate(coalesce(moves, array()), coalesce(rows, {empty}), (acc, m) -> CASE WHEN m.position < size(acc)
        THEN array_insert(acc, cast(m.position + 1 AS int), named_struct('ld_id', m.ld_id, 'pref_label', m.pref_label)) ELSE acc END)"""
    both = sizes.join(lists, "request_id", "left").join(moves, "request_id", "left")
    done = both.select("request_id", F.slice(F.expr(folded), F.lit(1), F.col("size")).alias("rows"))
    return done.select("request_id", F.posexplode("rows").alias("pos", "r")).select("request_id", (F.col("pos") + 1).alias("pos"), "r.ld_id", "r.pref_label")
