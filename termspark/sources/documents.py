"""JSON documents to tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termspark.functions import preferred_label
from termspark.sources import cut

ONTOLOGY = "acronym string, `@id` string, name string, flat boolean, ontologyType string"
CLASS = "`@id` string, prefLabel string, definition array<string>, synonym array<string>, hasChildren boolean"
PROVISIONAL = "`@id` string, label string, creator string, ontology string, subclassOf string, definition array<string>, synonym array<string>, relations array<struct<`@id`:string,relationType:string,targetClassId:string>>"
PROPERTY = "`@id` string, `@type` string, prefLabel string, label array<string>, definition array<string>, hasChildren boolean"
CONSTRAINTS = (
    "ontologies array<struct<acronym:string>>, branches array<struct<uri:string,acronym:string>>, valueSets array<struct<uri:string,vsCollection:string>>,"
    " classes array<struct<uri:string,prefLabel:string,type:string,label:string,source:string>>,"
    " actions array<struct<to:int,action:string,termUri:string,type:string,source:string,sourceUri:string>>"
)
SEARCH_BODY = f"parameterObject struct<inputText:string,valueConstraints:struct<{CONSTRAINTS.replace(' array', ':array')}>>, page int, pageSize int"


def order_of(page: Column, pos: Column) -> Column:
    """Ascends as pages and the places within them do; no sort is needed to compute it."""
    return F.shiftleft(page.cast("long"), 32) + pos


def empty_if_null(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array each: file, pos and the element's fields."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"array<struct<{_colons(schema)}>>").alias("all"))
    return whole.select("file", F.posexplode("all").alias("pos", "d")).select("file", "pos", "d.*")


def _colons(schema: str) -> str:
    """The fields of a table's schema as those of a struct."""
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    return ",".join(f"{name}:{kind}" for name, kind in fields)


def ontologies(spark: SparkSession, path: str) -> DataFrame:
    d = documents(spark, path, ONTOLOGY)
    return d.select("acronym", F.col("@id").alias("ld_id"), "name", F.coalesce("flat", F.lit(False)).alias("is_flat"), F.col("ontologyType").alias("ontology_type"), F.col("pos").cast("long").alias("ord"))


def class_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page envelopes, one a line, to acronym, ld_id, pref_label, definitions, synonyms, has_children, ord (upstream order)."""
    pages = spark.read.schema(f"acronym string, page int, collection array<struct<{_colons(CLASS)}>>").json(path)
    rows = pages.select("acronym", "page", F.posexplode("collection").alias("pos", "c"))
    return rows.select(
        "acronym", F.col("c.`@id`").alias("ld_id"), F.col("c.prefLabel").alias("pref_label"), empty_if_null(F.col("c.definition")).alias("definitions"),
        empty_if_null(F.col("c.synonym")).alias("synonyms"), F.col("c.hasChildren").alias("has_children"), order_of(F.col("page"), F.col("pos")).alias("ord"),
    )


def properties(spark: SparkSession, path: str) -> DataFrame:
    """Properties, one a line, with the acronym as a field or as a folder acronym=X."""
    d = spark.read.schema(f"{PROPERTY}, acronym string").json(path)
    labels = empty_if_null(F.col("label"))
    return d.select("acronym", F.col("@id").alias("ld_id"), F.col("@type").alias("ld_type"), preferred_label(F.col("prefLabel"), labels, F.col("@id")).alias("pref_label"), labels.alias("labels"), empty_if_null(F.col("definition")).alias("definitions"), "hasChildren")


def provisional_classes(spark: SparkSession, paged: str | None, plain: str | None) -> DataFrame:
    """Envelopes of pages, and plain arrays per ontology, in one table."""
    parts = []
    if paged:
        parts.append(spark.read.schema(f"collection array<struct<{_colons(PROVISIONAL)}>>").json(paged).select(F.explode("collection").alias("c")).select("c.*"))
    if plain:
        parts.append(documents(spark, plain, PROVISIONAL).drop("file", "pos"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.select(F.col("@id").alias("ld_id"), F.col("label").alias("pref_label"), "creator", "ontology", F.col("subclassOf").alias("subclass_of"), empty_if_null(F.col("definition")).alias("definitions"), empty_if_null(F.col("synonym")).alias("synonyms"), "relations")


def details(spark: SparkSession, metrics: str, categories: str, submissions: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics (acronym, classes), categories (acronym, name, ord) and submissions (acronym) of ontologies (S5); what is not there upstream has no row."""
    read = lambda path, schema: spark.read.schema(schema).json(path)
    return read(metrics, "acronym string, classes string"), read(categories, "acronym string, name string, ord long"), read(submissions, "acronym string, creationDate string").select("acronym")


def flatten_trees(docs: DataFrame) -> DataFrame:
    """docs (doc_id, body) to doc_id, parent_id, node_id, depth: each round opens the children of all documents at once.

    As many rounds as the deepest document has levels; each is written out as variants, so text is parsed once.
    """
    level = docs.select("doc_id", F.lit(None).cast("string").alias("parent_id"), F.parse_json("body").alias("node"))
    depth, found = 0, None
    while True:
        below = F.try_variant_get("node", "$.children", "array<variant>").alias("below")
        rows = cut(level.select("doc_id", "parent_id", F.try_variant_get("node", "$['@id']", "string").alias("node_id"), F.lit(depth).alias("depth"), below))
        here = rows.drop("below")
        found = here if found is None else found.unionByName(here)
        opened = rows.where(F.size("below") > 0)
        if opened.isEmpty():
            return found
        level = opened.select("doc_id", F.col("node_id").alias("parent_id"), F.explode("below").alias("node"))
        depth += 1


def requests(bodies: DataFrame) -> DataFrame:
    """bodies (request_id, body) with the parsed request; the text stays for the table of rejects."""
    return bodies.select("request_id", "body", F.from_json("body", SEARCH_BODY).alias("r"))


def write_pages(rows: DataFrame, pages: DataFrame, path: str) -> None:
    """One JSON document per request: its envelope and its rows in order. rows: request_id, pos and more, a page at most."""
    names = [c for c in rows.columns if c not in ("request_id", "pos")]
    lists = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("collection"))
    pages.join(lists, "request_id", "left").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_pages(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    whole = spark.read.schema(f"request_id long, collection array<struct<pos:int,{_colons(row_schema)}>>").json(path)
    return whole.select("request_id", F.inline("collection"))
