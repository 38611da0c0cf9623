"""Bulk resolution of identifiers and memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termspark.functions import is_provisional_id, short_id, uri_key


def normalise(concepts: DataFrame) -> DataFrame:
    """concepts with short_id, uri_key, label_lower and is_provisional, so that joins compare stored keys."""
    return concepts.withColumns({"short_id": short_id(F.col("ld_id")), "uri_key": uri_key(F.col("ld_id")), "label_lower": F.lower("pref_label"), "is_provisional": is_provisional_id(F.col("ld_id"))})


def resolve(requests: DataFrame, regular: DataFrame, provisional: DataFrame) -> DataFrame:
    """requests (request_id, acronym, term_id) to request_id, pref_label, origin: regular first, then provisional, else not_found."""
    asked = requests.withColumns({"uri_key": uri_key(F.col("term_id")), "short_id": short_id(F.col("term_id"))})
    one = regular.select("acronym", "uri_key", F.col("pref_label").alias("regular_label"), F.lit(True).alias("found"))
    two = provisional.select("short_id", F.col("pref_label").alias("provisional_label"), F.lit(True).alias("also"))
    both = asked.join(one, ["acronym", "uri_key"], "left").join(two, "short_id", "left")
    origin = F.when(F.col("found"), "regular").when(F.col("also"), "provisional").otherwise("not_found")
    return both.select("request_id", F.coalesce("regular_label", "provisional_label").alias("pref_label"), origin.alias("origin"))


def members(edges: DataFrame, concepts: DataFrame, collections: list[str]) -> DataFrame:
    """acronym, set_id, value_id, pref_label, pos: the values of the value sets of the collections, in order."""
    own = edges.where(F.col("acronym").isin(collections))
    named = own.join(concepts.select("acronym", F.col("ld_id").alias("child_id"), "pref_label"), ["acronym", "child_id"])
    return named.select("acronym", F.col("parent_id").alias("set_id"), F.col("child_id").alias("value_id"), "pref_label", "ord")


def notation_values(concepts: DataFrame, collection: str) -> DataFrame:
    """Values of the notation collection: the id gives way to the related match; the short id stays that of the original."""
    own = concepts.where((F.col("acronym") == collection) & F.col("notation").isNotNull())
    return own.select(F.coalesce("related_match", "ld_id").alias("ld_id"), short_id(F.col("ld_id")).alias("short_id"), "pref_label", "notation")


def details(ontologies: DataFrame, metrics: DataFrame, categories: DataFrame, submissions: DataFrame) -> DataFrame:
    """acronym, classes, categories, metrics_available, has_submissions; the flags are set only with a submission."""
    names = categories.groupBy("acronym").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]), ",").alias("categories"))
    both = ontologies.join(metrics, "acronym", "left").join(names, "acronym", "left").join(submissions.select("acronym", F.lit(True).alias("sub")).distinct(), "acronym", "left")
    ok = F.coalesce("sub", F.lit(False)) & F.col("classes").isNotNull()
    return both.select("acronym", F.coalesce(F.col("classes").cast("long"), F.lit(0)).alias("classes"), "categories", ok.alias("metrics_available"), ok.alias("has_submissions"))


def resolve_relations(requests: DataFrame, relations: DataFrame) -> DataFrame:
    """requests (request_id, ld_id) to request_id, relation_type, target_class_id, found, by the short identifier."""
    known = relations.select(short_id(F.col("ld_id")).alias("key"), "relation_type", "target_class_id", F.lit(True).alias("hit"))
    asked = requests.withColumn("key", short_id(F.col("ld_id")))
    return asked.join(known, "key", "left").select("request_id", "relation_type", "target_class_id", F.coalesce("hit", F.lit(False)).alias("found"))


def set_of_value(values: DataFrame, edges: DataFrame) -> DataFrame:
    """values (acronym, value_id) with set_id: the first parent, null without one."""
    first = edges.groupBy("acronym", F.col("child_id").alias("value_id")).agg(F.min_by("parent_id", "ord").alias("set_id"))
    return values.join(first, ["acronym", "value_id"], "left")


def resolve_ontologies(requests: DataFrame, ontologies: DataFrame) -> DataFrame:
    """requests (request_id, acronym) with the record of the ontology and whether it is there (L4, S12); the catalog is a row an ontology."""
    return requests.join(ontologies.withColumn("hit", F.lit(True)), "acronym", "left").withColumn("found", F.coalesce("hit", F.lit(False))).drop("hit")


def all_value_sets(terms: DataFrame, ontologies: DataFrame) -> DataFrame:
    """acronym, ld_id, pref_label, collection_ord, ord of every value set, provisional ones too."""
    order = ontologies.select("acronym", F.col("ord").alias("collection_ord"))
    return terms.where("entity = 'value_set'").join(order, "acronym").select("acronym", "ld_id", "pref_label", "collection_ord", "ord")


def class_page(classes: DataFrame, page: int, size: int) -> DataFrame:
    """acronym, pos, ld_id, pref_label, total: one page of the classes of each ontology, regular ones first.

    The page is a constant, so that every task keeps its first rows only, before they are shuffled.
    """
    totals = classes.groupBy("acronym").agg(F.count("*").alias("total"))
    rank = F.row_number().over(W.partitionBy("acronym").orderBy("is_provisional", "ord", "ld_id"))
    placed = classes.withColumn("pos", rank).where(F.col("pos") <= page * size).where(F.col("pos") > (page - 1) * size)
    return placed.join(totals, "acronym").select("acronym", (F.col("pos") - (page - 1) * size).cast("int").alias("pos"), "ld_id", "pref_label", "total")
