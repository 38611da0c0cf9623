"""Properties: lookup and search (L5, Q2). Their hierarchies are those of `hierarchy` over edges between properties (H6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.functions import preferred_label, short_id
from termspark.operators.index import TermIndex, matches
from termspark.operators.paging import closest, first_pages
from termspark.operators.search import texts_of
from termspark.sources import cut


def labelled(properties: DataFrame) -> DataFrame:
    return properties.withColumn("pref_label", preferred_label(F.col("pref_label"), F.col("labels"), F.col("ld_id")))


def resolve_properties(requests: DataFrame, properties: DataFrame) -> DataFrame:
    """requests (request_id, acronym, ld_id) to request_id, pref_label, found."""
    known = labelled(properties).select("acronym", "ld_id", "pref_label", F.lit(True).alias("hit"))
    return requests.join(known, ["acronym", "ld_id"], "left").select("request_id", "pref_label", F.coalesce("hit", F.lit(False)).alias("found"))


def property_terms(properties: DataFrame) -> DataFrame:
    """Properties as the terms of an index: their labels are synonyms."""
    named = labelled(properties).withColumn("synonyms", F.array_compact("labels"))
    none = F.create_map().cast("map<string,array<string>>")
    return named.select("acronym", "ld_id", F.lit("property").alias("entity"), "pref_label", "synonyms", none.alias("properties"), "ord", F.lit(False).alias("is_provisional"))


def property_search(requests: DataFrame, properties: DataFrame, index: TermIndex) -> DataFrame:
    """requests (request_id, q, acronym, exact_match, require_definitions, page, page_size) to ranked, paged hits.

    Exact requests meet properties on an equal key: the short identifier, the label or one of the labels, without regard to
    case. The others look for the text in the label and the labels of the properties of their source, in the index of
    property_terms.
    """
    named = labelled(properties)
    wanted = ~F.col("require_definitions") | (F.size("definitions") > 0)
    out = ["request_id", "q", "page", "page_size", "acronym", "ld_id", "pref_label", "ord"]
    names = F.array_distinct(F.transform(F.concat(F.array(short_id(F.col("ld_id")), F.col("pref_label")), "labels"), lambda x: F.lower(x)))
    exact = requests.where("exact_match").withColumn("name", F.lower("q")).join(named.withColumn("name", F.explode(names)), ["acronym", "name"])
    loose_asked = requests.where("NOT exact_match").withColumn("text", F.lower(F.trim("q")))
    met = matches(index, texts_of(loose_asked, "q")).select("text", "acronym", "ld_id")
    loose = loose_asked.join(met, ["text", "acronym"]).join(named, ["acronym", "ld_id"])
    hits = cut(exact.where(wanted).select(*out).unionByName(loose.where(wanted).select(*out)))
    placed = first_pages(hits, requests, [*closest(F.col("pref_label"), F.col("q")), F.col("acronym"), F.col("ord"), F.col("ld_id")])
    return placed.select("request_id", "pos", "ld_id", "pref_label", "total")
