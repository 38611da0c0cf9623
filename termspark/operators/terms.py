"""Regular and provisional terms together: union, resolution, records and searches.

terms: acronym, ld_id, pref_label, synonym, ord, is_provisional, entity (class, value_set, value), parent_id (of provisional
terms), and what the records need: creator, definition, notation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspark.functions import is_provisional_id, is_url, short_id, uri_key
from termspark.operators.index import TERM, Names, TermIndex, matches
from termspark.operators.paging import closest, first_ranked, last_shown, limited, page_of
from termspark.operators.search import texts_of
from termspark.operators.validate import creations
from termspark.sources import cut

#: The names of the kinds of terms in records.
TYPES = {"class": "OntologyClass", "value_set": "ValueSet", "value": "Value"}


def type_name(entity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), entity)


def union_terms(concepts: DataFrame, provisional: DataFrame, edges: DataFrame, collections: list[str]) -> DataFrame:
    """One table of terms; a regular term of a collection is a value set without a parent, else a value."""
    below = edges.select("acronym", F.col("child_id").alias("ld_id"), F.lit(True).alias("below")).distinct()
    entity = F.when(~F.col("acronym").isin(collections), "class").when(F.col("below"), "value").otherwise("value_set")
    none = F.lit(None).cast("string")
    regular = concepts.join(below, ["acronym", "ld_id"], "left").select(
        "acronym", "ld_id", "pref_label", "synonym", "ord", F.lit(False).alias("is_provisional"), entity.alias("entity"), none.alias("parent_id"), none.alias("creator"), none.alias("definition"), "notation")
    made = provisional.select("acronym", "ld_id", "pref_label", "synonym", "ord", F.lit(True).alias("is_provisional"), "entity", F.col("subclass_of").alias("parent_id"), "creator", "definition", none.alias("notation"))
    return regular.unionByName(made)


def all_edges(edges: DataFrame, provisional: DataFrame) -> DataFrame:
    """The regular edges, and those of provisional terms to what they are subclasses of; both ends as canonical keys."""
    old = edges.select("acronym", uri_key(F.col("child_id")).alias("child_key"), uri_key(F.col("parent_id")).alias("parent_key"), "child_id", "ord")
    new = provisional.where("subclass_of IS NOT NULL").select("acronym", uri_key(F.col("ld_id")).alias("child_key"), uri_key(F.col("subclass_of")).alias("parent_key"), F.col("ld_id").alias("child_id"), "ord")
    return old.unionByName(new)


def resolve_sets(requests: DataFrame, terms: DataFrame) -> DataFrame:
    """L2: requests (request_id, acronym, vs_id) with set_id, pref_label, origin; regular sets first, then provisional ones."""
    sets = terms.where("entity = 'value_set'").withColumn("key", uri_key(F.col("ld_id")))
    regular = sets.where("NOT is_provisional").select("acronym", "key", F.col("ld_id").alias("one"), F.col("pref_label").alias("label_one"))
    made = sets.where("is_provisional").select("key", F.col("ld_id").alias("two"), F.col("pref_label").alias("label_two"))
    both = requests.withColumn("key", uri_key(F.col("vs_id"))).join(regular, ["acronym", "key"], "left").join(made, "key", "left")
    origin = F.when(F.col("one").isNotNull(), "regular").when(F.col("two").isNotNull(), "provisional").otherwise("not_found")
    return both.select(*requests.columns, F.coalesce("one", "two").alias("set_id"), F.coalesce("label_one", "label_two").alias("pref_label"), origin.alias("origin"))


def resolve_values(requests: DataFrame, terms: DataFrame) -> DataFrame:
    """L3: requests (request_id, acronym, value_id) with pref_label, notation, origin. The shape of the id says where to look: no fallback."""
    values = terms.where("entity = 'value'").withColumn("key", uri_key(F.col("ld_id")))
    asked = requests.withColumns({"key": uri_key(F.col("value_id")), "made": is_provisional_id(F.col("value_id"))})
    keep = [*requests.columns, "pref_label", "notation"]
    regular = asked.where("NOT made").join(values.where("NOT is_provisional").select("acronym", "key", "pref_label", "notation", F.lit("regular").alias("origin")), ["acronym", "key"], "left")
    made = asked.where("made").join(values.where("is_provisional").select("key", "pref_label", "notation", F.lit("provisional").alias("origin")), "key", "left")
    return regular.select(*keep, "origin").unionByName(made.select(*keep, "origin")).withColumn("origin", F.coalesce("origin", F.lit("not_found")))


def collection_of(vs_id: Column, collections: list[str]) -> Column:
    """The first of the collections whose acronym stands between slashes in the id."""
    return F.try_element_at(F.filter(F.array(*[F.lit(c) for c in collections]), lambda c: F.contains(vs_id, F.concat(F.lit("/"), c, F.lit("/")))), F.lit(1))


def values_beside(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Values (acronym, value_id) with set_id, sibling_id: all values of the set that is the value's first parent."""
    first = edges.groupBy("acronym", F.col("child_id").alias("value_id")).agg(F.min_by("parent_id", "ord").alias("set_id"))
    owned = values.join(first, ["acronym", "value_id"])
    return owned.join(edges.select("acronym", F.col("parent_id").alias("set_id"), F.col("child_id").alias("sibling_id")), ["acronym", "set_id"])


def class_records(terms: DataFrame) -> DataFrame:
    """Classes; a regular one has no creator and no subclass_of."""
    return terms.where("entity = 'class'").select(
        "ld_id", short_id(F.col("ld_id")).alias("short_id"), F.lit(TYPES["class"]).alias("type"), "pref_label", F.when(F.col("is_provisional"), F.col("creator")).alias("creator"), F.col("acronym").alias("ontology"),
        F.array_compact(F.array("definition")).alias("definitions"), F.array_compact(F.array("synonym")).alias("synonyms"), F.col("parent_id").alias("subclass_of"), "is_provisional")


def value_records(terms: DataFrame) -> DataFrame:
    """Value sets and values; vs_id of a provisional value is what it is a subclass of."""
    return terms.where("entity <> 'class'").select(
        "ld_id", short_id(F.col("ld_id")).alias("short_id"), type_name(F.col("entity")).alias("type"), "pref_label", "creator", F.col("acronym").alias("vs_collection"),
        F.when(F.col("entity") == "value", F.col("parent_id")).alias("vs_id"), "notation", "is_provisional")


def search_results(terms: DataFrame) -> DataFrame:
    """A search result of each term, with its first definition, and the notation of values."""
    return terms.select(short_id(F.col("ld_id")).alias("short_id"), "ld_id", type_name(F.col("entity")).alias("type"), "pref_label", F.when(F.col("entity") == "value", F.col("notation")).alias("notation"), "definition", F.col("acronym").alias("source"))


def enumerated_results(classes: DataFrame, type_base: str, source_base: str) -> DataFrame:
    """Classes (request_id, c: uri, prefLabel, type, source) as search results, from the request alone; type and source get their bases unless they are URLs."""
    based = lambda x, base: F.when(is_url(x), x).otherwise(F.concat(F.lit(base), x))
    return classes.select("request_id", short_id(F.col("c.uri")).alias("short_id"), F.col("c.uri").alias("ld_id"), based(F.col("c.type"), type_base).alias("ld_type"), F.col("c.type").alias("type"), F.col("c.prefLabel").alias("pref_label"), based(F.col("c.source"), source_base).alias("source"))


RELATION = "array<struct<relation_type:string,target_class_id:string,creator:string>>"


def write_records(made: DataFrame, relations: DataFrame) -> DataFrame:
    """A record per created class, value set or value (entity, ld_id, creator, ...) with its relations. A relation without a
    creator takes that of its class; relations of value sets and values stay as they are."""
    own = relations.groupBy(F.col("source_class_id").alias("ld_id")).agg(F.array_sort(F.collect_list(F.struct("relation_type", "target_class_id", "creator"))).alias("relations"))
    creator = lambda r: F.when(F.col("entity") == "class", F.coalesce(r["creator"], F.col("creator"))).otherwise(r["creator"])
    filled = F.transform("relations", lambda r: F.struct(r["relation_type"], r["target_class_id"], creator(r).alias("creator")))
    return made.join(own, "ld_id", "left").withColumn("relations", F.coalesce(filled, F.array().cast(RELATION)))


def matched_synonyms(label: Column, synonyms: Column, query: Column) -> Column:
    """The synonyms that contain the trimmed query and differ from the label, without regard to case."""
    return F.filter(synonyms, lambda s: (F.lower(s) != F.lower(label)) & F.contains(F.lower(s), F.lower(F.trim(query))))


def scoped(entity: Column, scope: Column) -> Column:
    """Whether a kind of term is in the scope, a comma-joined list of all, classes, value_sets, values."""
    words = F.split(scope, ",")
    plural = F.element_at(F.create_map(*[F.lit(x) for x in ("class", "classes", "value_set", "value_sets", "value", "values")]), entity)
    return F.array_contains(words, "all") | F.array_contains(words, plural)


def unknown_sources(requests: DataFrame, ontologies: DataFrame) -> DataFrame:
    """request_id, unknown of the requests whose source list (sources, an array, null for all) names an ontology that is not
    there; they are rejected as not found."""
    named = requests.select("request_id", F.explode("sources").alias("acronym"))
    return named.join(ontologies.select("acronym"), "acronym", "left_anti").groupBy("request_id").agg(F.sort_array(F.collect_set("acronym")).alias("unknown"))


def bulk_search(requests: DataFrame, index: TermIndex | Names, closure: DataFrame) -> DataFrame:
    """Q1: requests (request_id, q, scope, suggest, subtree_root, max_depth, page, page_size) to ranked, paged hits.

    A term matches by its label, a synonym or a property value (P10) that contains the trimmed query; with `suggest` (P11), if
    the last word of the query begins a word of the label and all before it are words of the label. A subtree keeps what lies
    below its root, up to max_depth levels (0: all). A column `sources` (P8), an array or null, keeps the terms of these
    ontologies. Rows without a label count, but do not appear (P5). Equal searches of different requests are made and ranked once,
    so that the hits follow the searches that differ.
    """
    asked = requests.withColumn("text", F.lower(F.trim("q"))).where("text <> ''").withColumnRenamed("suggest", "ahead")
    if "sources" not in asked.columns:
        asked = asked.withColumn("sources", F.lit(None).cast("array<string>"))
    told = ["text", "ahead", "scope", "sources", "subtree_root", "max_depth"]
    asked = cut(asked.select("request_id", "q", "page", "page_size", *told, F.to_json(F.struct(*told)).alias("key")))
    searches = cut(asked.select("key", *told).dropDuplicates(["key"]).withColumn("search", F.monotonically_increasing_id()))
    met = matches(index, searches.select("text", "ahead").distinct())
    named = met.where("NOT ahead OR match_type = 'prefLabel'").select("text", "ahead", "match_type", *TERM)
    found = searches.drop("key").join(named, ["text", "ahead"]).where(F.col("sources").isNull() | F.array_contains("sources", F.col("acronym")))
    inside = closure.select("acronym", F.col("root_id").alias("subtree_root"), F.col("node_id").alias("ld_id"), "depth")
    kept = found.where(scoped(F.col("entity"), F.col("scope"))).join(inside, ["acronym", "subtree_root", "ld_id"], "left")
    kept = cut(kept.where("subtree_root IS NULL OR (depth IS NOT NULL AND (max_depth = 0 OR depth <= max_depth))").drop("properties", "sources"))
    outside, near = closest(F.col("pref_label"), F.col("text"))
    keys = [F.coalesce(outside, F.lit(2)), near.asc_nulls_last(), F.col("acronym"), F.col("ord"), F.col("ld_id")]
    first = first_ranked(kept, last_shown(requests), keys, "search")
    paged = asked.select("request_id", "q", "page", "page_size", "key").join(searches.select("key", "search"), "key").drop("key")
    shown = page_of(paged.join(first, "search")).where("pref_label IS NOT NULL")
    synonyms = F.when(F.col("match_type") == "synonym", matched_synonyms(F.coalesce("pref_label", F.lit("")), F.col("synonyms"), F.col("q"))).otherwise(F.array().cast("array<string>"))
    return shown.select("request_id", "pos", "ld_id", type_name(F.col("entity")).alias("type"), "pref_label", "match_type", synonyms.alias("matched_synonyms"), "is_provisional", "total")


def search_in_sets(requests: DataFrame, terms: DataFrame, edges: DataFrame) -> DataFrame:
    """Q3: requests (request_id, acronym, vs_id, q, page, page_size) to the values of the set whose label contains q, closest first.

    The set is found as by resolve_sets; its values are met on the canonical key of their parent (P15), regular or not.
    """
    known = resolve_sets(requests, terms).where("origin <> 'not_found'").withColumn("parent_key", uri_key(F.col("set_id"))).drop("pref_label")
    values = terms.where("entity = 'value'").select("acronym", F.col("ld_id").alias("child_id"), "pref_label")
    hits = known.join(edges.select("acronym", "parent_key", "child_id", "ord"), ["acronym", "parent_key"]).join(values, ["acronym", "child_id"]).where(F.contains(F.lower("pref_label"), F.lower("q")))
    placed = limited(hits, requests, [*closest(F.col("pref_label"), F.col("q")), F.col("ord"), F.col("child_id")])
    return page_of(placed).select("request_id", "pos", F.col("child_id").alias("ld_id"), "pref_label", "origin", "total")


def resolve_actions(actions: DataFrame, results: DataFrame, enumerated: DataFrame, terms: DataFrame) -> DataFrame:
    """Actions (request_id, term_uri, type) with pref_label and origin: from the results, else the request's enumerated
    classes (of type class), else the table of terms by type; another type is rejected. Where an id is there twice, the first counts."""
    one = results.groupBy("request_id", F.col("ld_id").alias("term_uri")).agg(F.min_by("pref_label", "pos").alias("one"))
    two = enumerated.groupBy("request_id", F.col("ld_id").alias("term_uri")).agg(F.min_by("pref_label", "ord").alias("two"))
    three = terms.where("entity <> 'value_set'").select(F.col("ld_id").alias("term_uri"), type_name(F.col("entity")).alias("type"), F.col("pref_label").alias("three"))
    both = actions.join(one, ["request_id", "term_uri"], "left").join(two, ["request_id", "term_uri"], "left").join(three, ["term_uri", "type"], "left")
    is_class = F.col("type") == TYPES["class"]
    origin = F.when(F.col("one").isNotNull(), "result").when(~F.col("type").isin(TYPES["class"], TYPES["value"]), "rejected").when(is_class & F.col("two").isNotNull(), "enumerated").when(F.col("three").isNotNull(), "term").otherwise("not_found")
    label = F.coalesce("one", F.when(is_class, F.col("two")), "three")
    return both.select("request_id", "term_uri", "type", F.when(origin != "rejected", label).alias("pref_label"), origin.alias("origin"))


def source_counts(sources: DataFrame) -> DataFrame:
    """request_id, n_sources, many; all enumerated classes of a request are one source."""
    n = (F.sum((F.col("source_type") > 0).cast("long")) + F.max((F.col("source_type") == 0).cast("long"))).alias("n_sources")
    return sources.groupBy("request_id").agg(n).withColumn("many", F.col("n_sources") > 1)


def create(feed: DataFrame, base: str) -> DataFrame:
    """M1: created terms (seq, ts, acronym, label) with their id, short id, creation time and path."""
    path = F.concat_ws("/", F.lit("ontologies"), "acronym", F.lit("classes"), F.col("seq"))
    return feed.select(F.concat(F.lit(f"{base}/provisional_classes/"), F.col("seq")).alias("ld_id"), F.col("seq").cast("string").alias("short_id"), F.col("ts").alias("created"), "acronym", F.col("label").alias("pref_label"), path.alias("path"))


def create_all(feed: DataFrame, base: str, writable: list[str]) -> DataFrame:
    """M1, V4: entity, ld_id, created, path, rejected of creations (entity, seq, ts, collection, vs_id, source_class_id).

    Classes and relations go where they say; value sets and values only into a collection that can be written, and a value needs
    its set. A rejected creation has no id and no path.
    """
    checked = creations(feed.withColumn("op", F.lit("create")), writable, base)
    seq, good = F.col("seq").cast("string"), F.col("rejected").isNull()
    collection = short_id(F.col("collection"))
    root = F.when(F.col("entity") == "relation", "provisional_relations").otherwise("provisional_classes")
    path = F.when(F.col("entity") == "class", F.concat_ws("/", F.lit("ontologies"), collection, F.lit("classes"), seq)).when(F.col("entity") == "relation", F.concat_ws("/", F.lit("relations"), seq))
    path = path.when(F.col("entity") == "value_set", F.concat_ws("/", F.lit("vs-collections"), collection, F.lit("value-sets"), seq))
    path = path.otherwise(F.concat_ws("/", F.lit("vs-collections"), collection, F.lit("value-sets"), short_id(F.col("vs_id")), F.lit("values"), seq))
    return checked.select("entity", "seq", F.when(good, F.concat_ws("/", F.lit(base), root, seq)).alias("ld_id"), F.when(good, F.col("ts")).alias("created"), F.when(good, path).alias("path"), "rejected")


def set_nodes(sets: DataFrame, terms: DataFrame, below: DataFrame) -> DataFrame:
    """Sets (acronym, set_id) to set_id, node_id, pref_label, type, has_children: the set, then its values, which are
    leaves. below: acronym, root_id, node_id."""
    known = terms.where("entity <> 'class'").select("acronym", F.col("ld_id").alias("node_id"), "pref_label", type_name(F.col("entity")).alias("type"))
    values = sets.join(below.withColumnRenamed("root_id", "set_id"), ["acronym", "set_id"]).select("acronym", "set_id", "node_id", F.lit(False).alias("has_children"))
    held = values.select("acronym", "set_id", F.lit(True).alias("has")).distinct()
    own = sets.join(held, ["acronym", "set_id"], "left").select("acronym", "set_id", F.col("set_id").alias("node_id"), F.coalesce("has", F.lit(False)).alias("has_children"))
    return own.unionByName(values).join(known, ["acronym", "node_id"]).select("set_id", "node_id", "pref_label", "type", "has_children")


def drop_relations(relations: DataFrame, deleted: DataFrame) -> DataFrame:
    """M3: the relations that stay when the classes in deleted (ld_id) go."""
    return relations.join(deleted.select(F.col("ld_id").alias("source_class_id")).distinct(), "source_class_id", "left_anti")
