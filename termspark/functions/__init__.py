"""Column expressions for identifiers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_url(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^(?i)(https?|ftp|file|mailto):"), F.lit(False))


def short_id(x: Column) -> Column:
    """What follows the last slash, then the last hash sign; anything but a URL stays as it is."""
    return F.when(is_url(x), F.substring_index(F.substring_index(x, "/", -1), "#", -1)).otherwise(x)


def short_type(x: Column) -> Column:
    return F.when(is_url(x), F.substring_index(x, "#", -1)).otherwise(x)


def uri_key(x: Column) -> Column:
    """Encoded exactly once: a text that decoding changes is kept, another one is encoded."""
    return F.when(F.coalesce(F.try_url_decode(x), F.lit("")) == x, F.url_encode(x)).otherwise(x)


def is_provisional_id(x: Column) -> Column:
    return F.lower(x).contains("provisional_classes") | ~x.contains("http")


def preferred_label(label: Column, labels: Column, ld_id: Column) -> Column:
    """The label, else the first of the labels, else the short identifier, else a fixed text."""
    return F.coalesce(F.nullif(label, F.lit("")), F.try_element_at(labels, F.lit(1)), short_id(ld_id), F.lit("Label not available"))


def is_property_type(x: Column) -> Column:
    return short_type(x).isin("ObjectProperty", "AnnotationProperty", "DatatypeProperty")


def acronym_of(uri: Column, base: str) -> Column:
    """The acronym in the URI of an ontology below `base`, null for another URI."""
    return F.when(F.startswith(uri, F.lit(base)), F.substring_index(F.substring(uri, F.lit(len(base) + 1), F.length(uri)), "/", 1))
