"""Checks of request tables as data quality: a status and the violations of each request (V1 to V5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspark.sources.documents import requests

#: The fields that a body, its parameter object and its enumerated classes may have, and the words of a scope.
BODY = ("parameterObject", "page", "pageSize")
PARAMETER = ("inputText", "valueConstraints")
CLASS = ("uri", "prefLabel", "type", "label", "source")
ACTIONS = ("move", "delete")
SCOPES = ("all", "classes", "value_sets", "values")
#: Fields that must not be empty, by list.
REQUIRED = {"ontologies": ("acronym",), "branches": ("uri", "acronym"), "valueSets": ("uri", "vsCollection"), "classes": ("uri", "prefLabel", "type", "source"), "actions": ("action", "termUri", "type", "source")}


def _strange(text: Column, allowed: tuple) -> Column:
    return F.size(F.array_except(F.json_object_keys(text), F.array(*[F.lit(x) for x in allowed]))) > 0


def _blank(field: str):
    return lambda x: F.coalesce(x[field], F.lit("")) == ""


def violations(r: Column, collections: list[str]) -> Column:
    """Codes of what is missing, empty or not allowed; a missing object hides what would be in it."""
    at = r["parameterObject"]["valueConstraints"]
    there = at.isNotNull()
    codes = [(r["parameterObject"].isNull(), "parameterObject"), (r["parameterObject"].isNotNull() & at.isNull(), "valueConstraints")]
    codes += [(there & at[name].isNull(), name) for name in list(REQUIRED)[:4]]
    for name, fields in REQUIRED.items():
        codes += [(F.exists(at[name], _blank(f)), f"{name}.{f} empty") for f in fields]
    codes.append((F.exists(at["actions"], lambda x: ~x["action"].isin(*ACTIONS)), "actions.action"))
    codes.append((F.exists(at["actions"], lambda x: (x["action"] == "move") & x["to"].isNull()), "actions.to"))
    codes.append((F.exists(at["valueSets"], lambda x: ~F.element_at(F.split(x["vsCollection"], "/"), -1).isin(*collections)), "valueSets.vsCollection"))
    return F.array_compact(F.array(*[F.when(c, code) for c, code in codes]))


def check_requests(bodies: DataFrame, collections: list[str]) -> DataFrame:
    """bodies (request_id, body) to request_id, r (parsed), status, violations.

    400: no JSON object, or unknown fields in the body, its parameter object or an enumerated class; 422: violations; else
    200. A null body has status 400.
    """
    parsed = requests(bodies)
    classes = F.from_json(F.get_json_object("body", "$.parameterObject.valueConstraints.classes"), "array<string>")
    strange = F.json_object_keys("body").isNull() | _strange(F.col("body"), BODY)
    strange = strange | F.coalesce(_strange(F.get_json_object("body", "$.parameterObject"), PARAMETER), F.lit(False))
    strange = strange | F.coalesce(F.exists(classes, lambda c: _strange(c, CLASS)), F.lit(False))
    found = F.when(strange, F.array(F.lit("unknown field"))).otherwise(violations(F.col("r"), collections))
    checked = parsed.withColumns({"violations": found, "strange": strange})
    return checked.select("request_id", "r", F.when(F.col("strange"), 400).when(F.size("violations") > 0, 422).otherwise(200).alias("status"), "violations")


def valid_collection(x: Column, collections: list[str], prefix: str) -> Column:
    """A bare acronym or the full URI of one of the collections."""
    return F.coalesce(x.isin(*collections, *[f"{prefix}/{c}" for c in collections]), F.lit(False))


def creations(feed: DataFrame, writable: list[str], prefix: str) -> DataFrame:
    """feed with `rejected`: why a created value set or value cannot be, or null. feed: op, entity, collection, vs_id."""
    made = F.col("op") == "create"
    bad = F.col("entity").isin("value_set", "value") & ~valid_collection(F.col("collection"), writable, prefix)
    orphan = (F.col("entity") == "value") & (F.coalesce("vs_id", F.lit("")) == "")
    return feed.withColumn("rejected", F.when(made & bad, "collection").when(made & orphan, "vs_id"))


def valid_scope(scope: Column) -> Column:
    return F.forall(scope, lambda s: s.isin(*SCOPES))


def in_scope(scope: Column, is_collection: Column, is_root: Column) -> Column:
    """Whether a concept is in one of the parts that the scope names; a scope without words or with `all` has them all."""
    has = lambda word: F.array_contains(scope, word)
    every = (F.size(scope) == 0) | has("all")
    return every | (has("classes") & ~is_collection) | (has("value_sets") & is_collection & is_root) | (has("values") & is_collection & ~is_root)
