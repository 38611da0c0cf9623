"""Queries on the variants of records, documents and lists: pages of sets and values, creations, nodes, types."""

from __future__ import annotations

from pyspark.sql import functions as F

from termspark.functions import acronym_of, short_id, short_type, uri_key
from termspark.operators import ordinals, terms
from termspark.operators.search import COLLECTIONS, VALUE_SETS
from termspark.plans import SHORT, query
from termspark.plans.store import below, source_rows, term_rows
from termspark.plans.terms import BASES, TERMS, WRITE
from termspark.sources import BASE, documents, shared_folder, views

SETS = f"""asked AS (SELECT p_partkey AS request_id, CASE WHEN p_partkey % 3 = 0 THEN concat('{BASE}/VSN/', p_type) WHEN p_partkey % 3 = 1 THEN url_encode(concat('{BASE}/VSN/', p_type)) ELSE concat('{BASE}/provisional_classes/S', p_partkey * 10) END AS vs_id,
    1 + p_partkey % 4 AS page, 1 + p_partkey % 5 AS page_size FROM part)"""
VALUES = """value AS (SELECT e.parent_id AS set_id, t.ld_id, t.pref_label, t.ord, false AS is_provisional FROM edges e JOIN terms t ON t.acronym = e.acronym AND t.ld_id = e.child_id AND t.entity = 'value'
    UNION ALL SELECT url_decode(subclass_of), ld_id, pref_label, ord, true FROM provisional WHERE entity = 'value' AND subclass_of IS NOT NULL)"""


@query(
    TERMS
    + f""", {SETS}, {VALUES}, p AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY is_provisional, ord, ld_id) AS rn, count(*) OVER (PARTITION BY set_id) AS total FROM value)
    SELECT request_id, CAST(rn - (page - 1) * page_size AS INT) AS pos, ld_id, pref_label, total FROM asked JOIN p ON set_id = url_decode(vs_id) AND rn > (page - 1) * page_size AND rn <= page * page_size""",
    *BASES,
)
def l9_value_pages(spark, sf_dir):
    """Any page of the values of a set, regular or provisional, whose id may be encoded."""
    part, stored = spark.read.parquet(f"{sf_dir}/part.parquet"), source_rows(spark, sf_dir)
    k, regular = F.col("p_partkey"), F.concat(F.lit(f"{BASE}/VSN/"), "p_type")
    vs_id = F.when(k % 3 == 0, regular).when(k % 3 == 1, F.url_encode(regular)).otherwise(F.concat(F.lit(f"{BASE}/provisional_classes/S"), k * 10))
    asked = part.select(k.alias("request_id"), uri_key(vs_id).alias("key"), (1 + k % 4).alias("page"), (1 + k % 5).alias("page_size"))
    known = stored.totals.where(F.col("source_type") == VALUE_SETS).select(*ordinals.SOURCE, uri_key(F.col("uri")).alias("key"))
    return ordinals.source_pages(asked.join(known, "key").drop("key"), stored)


@query(
    TERMS
    + f""", {VALUES}, own AS (SELECT ld_id AS value_id, arg_min(set_id, ord) AS set_id FROM value GROUP BY ld_id),
    asked AS (SELECT value_id, set_id, 1 + length(value_id) % 3 AS page, 3 AS page_size FROM own),
    p AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY is_provisional, ord, ld_id) AS rn, count(*) OVER (PARTITION BY set_id) AS total FROM value)
    SELECT value_id, a.set_id, CAST(rn - (page - 1) * page_size AS INT) AS pos, ld_id, total FROM asked a JOIN p ON p.set_id = a.set_id AND rn > (page - 1) * page_size AND rn <= page * page_size
      WHERE a.set_id IN (SELECT ld_id FROM terms WHERE entity = 'value_set')""",
    *BASES,
)
def l10_sibling_pages(spark, sf_dir):
    """Every value, regular or provisional, asks for a page of the values of its set."""
    stored = source_rows(spark, sf_dir)
    own = below(spark, sf_dir).join(stored.totals.where(F.col("source_type") == VALUE_SETS).select("acronym", F.col("uri").alias("root_id")), ["acronym", "root_id"])
    source = [F.lit(VALUE_SETS).alias("source_type"), "acronym", F.col("root_id").alias("uri")]
    asked = own.select(F.col("node_id").alias("request_id"), *source, (1 + F.length("node_id") % 3).alias("page"), F.lit(3).alias("page_size"))
    found = ordinals.source_pages(asked, stored).join(asked.select("request_id", "uri"), "request_id")
    return found.select(F.col("request_id").alias("value_id"), F.col("uri").alias("set_id"), "pos", "ld_id", "total")


@query(
    TERMS
    + """, asked AS (SELECT s_suppkey AS request_id, CASE s_suppkey % 4 WHEN 0 THEN 'VSN' WHEN 1 THEN 'VSA' WHEN 2 THEN 'VSW' ELSE 'GEO' END AS acronym, 1 + s_suppkey % 9 AS page, 2 + s_suppkey % 5 AS page_size FROM supplier),
    p AS (SELECT *, row_number() OVER (PARTITION BY acronym ORDER BY is_provisional, ord, ld_id) AS rn, count(*) OVER (PARTITION BY acronym) AS total FROM terms WHERE entity = 'value_set')
    SELECT request_id, CAST(rn - (page - 1) * page_size AS INT) AS pos, ld_id, pref_label, total FROM asked JOIN p ON p.acronym = asked.acronym AND rn > (page - 1) * page_size AND rn <= page * page_size""",
    *BASES,
)
def l11_collection_pages(spark, sf_dir):
    """Any page of the sets of a collection, regular and provisional; what is no collection has none."""
    k = F.col("s_suppkey")
    acronym = F.when(k % 4 == 0, "VSN").when(k % 4 == 1, "VSA").when(k % 4 == 2, "VSW").otherwise("GEO")
    source = [F.lit(COLLECTIONS).alias("source_type"), acronym.alias("acronym"), F.lit("").alias("uri")]
    asked = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("request_id"), *source, (1 + k % 9).alias("page"), (2 + k % 5).alias("page_size"))
    return ordinals.source_pages(asked, source_rows(spark, sf_dir))


@query(
    TERMS
    + f""", {VALUES}, sets AS (SELECT ld_id FROM terms WHERE entity = 'value_set')
    SELECT ld_id AS set_id, ld_id AS node_id, pref_label, 'ValueSet' AS type, EXISTS (SELECT 1 FROM value v WHERE v.set_id = terms.ld_id) AS has_children FROM terms WHERE entity = 'value_set'
    UNION ALL SELECT set_id, ld_id, pref_label, 'Value', false FROM value WHERE set_id IN (SELECT ld_id FROM sets)""",
    *BASES,
)
def h7_value_set_nodes(spark, sf_dir):
    """The tree of every value set, regular or provisional, as nodes."""
    every = term_rows(spark, sf_dir)
    sets = every.where("entity = 'value_set'").select("acronym", F.col("ld_id").alias("set_id"))
    return terms.set_nodes(sets, every, below(spark, sf_dir))


@query(
    f"""SELECT p.ld_id, p.entity, p.creator, concat('{BASE}/FLAT/S', l_suppkey) AS target_class_id, CASE WHEN l_linenumber % 2 = 0 THEN 'someone' WHEN p.entity = 'class' THEN p.creator END AS relation_creator
    FROM provisional p JOIN lineitem l ON l_orderkey = p.ord""",
    "provisional",
)
def n26_all_write_records(spark, sf_dir):
    """Write records of classes, value sets and values; only relations of classes take the creator of their term."""
    (made,) = views(spark, sf_dir, "provisional")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    named = made.select("ld_id", F.col("ord").alias("l_orderkey")).join(lines, "l_orderkey")
    target, creator = F.concat(F.lit(f"{BASE}/FLAT/S"), "l_suppkey").alias("target_class_id"), F.when(F.col("l_linenumber") % 2 == 0, "someone").alias("creator")
    relations = named.select(F.col("ld_id").alias("source_class_id"), F.lit("suppliedBy").alias("relation_type"), target, creator)
    found = terms.write_records(made.select("ld_id", "entity", "creator"), relations)
    each = found.select("ld_id", "entity", "creator", F.explode("relations").alias("r"))
    return each.select("ld_id", "entity", "creator", "r.target_class_id", F.col("r.creator").alias("relation_creator"))


@query(
    f"""WITH c AS (SELECT o_orderkey AS seq, o_orderdate AS ts, CASE o_orderkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'value_set' WHEN 2 THEN 'value' ELSE 'relation' END AS entity,
      CASE WHEN o_orderkey % 4 = 0 THEN 'NEW' WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'VSN' WHEN o_orderkey % 5 = 1 THEN '{BASE}/VSW' ELSE 'VSW' END AS collection, CASE WHEN o_orderkey % 3 > 0 THEN concat('{BASE}/provisional_classes/S', o_orderkey - o_orderkey % 10) END AS vs_id FROM orders),
    r AS (SELECT *, CASE WHEN entity IN ('value_set', 'value') AND collection = 'VSN' THEN 'collection' WHEN entity = 'value' AND vs_id IS NULL THEN 'vs_id' END AS rejected FROM c)
    SELECT entity, seq, CASE WHEN rejected IS NULL THEN concat('{BASE}/', CASE WHEN entity = 'relation' THEN 'provisional_relations' ELSE 'provisional_classes' END, '/', seq) END AS ld_id, CASE WHEN rejected IS NULL THEN ts END AS created,
      CASE WHEN rejected IS NULL THEN CASE entity WHEN 'class' THEN concat('ontologies/NEW/classes/', seq) WHEN 'relation' THEN concat('relations/', seq) WHEN 'value_set' THEN concat('vs-collections/VSW/value-sets/', seq)
        ELSE concat('vs-collections/VSW/value-sets/S', seq - seq % 10, '/values/', seq) END END AS path, rejected FROM r"""
)
def m1_all_creations(spark, sf_dir):
    """M1, V4: classes, value sets, values and relations are created, or rejected."""
    orders, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    entity = F.element_at(F.array(*[F.lit(x) for x in ("class", "value_set", "value", "relation")]), (k % 4 + 1).cast("int"))
    collection = F.when(k % 4 == 0, "NEW").when(k % 4 == 3, None).when(k % 5 == 0, "VSN").when(k % 5 == 1, f"{BASE}/VSW").otherwise("VSW")
    vs_id = F.when(k % 3 > 0, F.concat(F.lit(f"{BASE}/provisional_classes/S"), k - k % 10))
    feed = orders.select(k.alias("seq"), F.col("o_orderdate").alias("ts"), entity.alias("entity"), collection.alias("collection"), vs_id.alias("vs_id"))
    return terms.create_all(feed, BASE, WRITE)


@query(
    "SELECT concat('S', s_suppkey) AS acronym, concat('http://example.org/o/S', s_suppkey) AS ld_id, s_name AS name, s_nationkey % 3 = 0 AS is_flat, CASE WHEN s_nationkey % 4 = 0 THEN 'VALUE_SET_COLLECTION' WHEN s_nationkey % 4 = 1 THEN 'ONTOLOGY' END AS ontology_type, s_suppkey % 40 AS ord FROM supplier"
)
def s1_ontology_documents(spark, sf_dir):
    """Ontology documents, arrays of forty in a file, written and read back; flat is left out where it is false."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    kind = F.when(nation % 4 == 0, "VALUE_SET_COLLECTION").when(nation % 4 == 1, "ONTOLOGY")
    one = F.struct(k.alias("nr"), F.concat(F.lit("S"), k).alias("acronym"), F.concat(F.lit("http://example.org/o/S"), k).alias("@id"), F.col("s_name").alias("name"), F.when(nation % 3 == 0, True).alias("flat"), kind.alias("ontologyType"))
    files, folder = F.floor(k / 40).alias("file"), shared_folder(spark)
    body = F.to_json(F.sort_array(F.collect_list(one))).alias("value")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(files).agg(body).repartition("file").write.partitionBy("file").text(folder)
    return documents.ontologies(spark, f"{folder}/*/*").select("acronym", "ld_id", "name", "is_flat", "ontology_type", "ord")


@query(
    """SELECT ld_id, concat('http://www.w3.org/2002/07/owl#', CASE ord % 3 WHEN 0 THEN 'ObjectProperty' WHEN 1 THEN 'AnnotationProperty' ELSE 'DatatypeProperty' END) AS ld_type, CASE ord % 3 WHEN 0 THEN 'ObjectProperty' WHEN 1 THEN 'AnnotationProperty' ELSE 'DatatypeProperty' END AS type,
    coalesce(pref_label, label) AS pref_label, label AS labels, coalesce(definition, '') AS definitions, acronym AS ontology, EXISTS (SELECT 1 FROM property_edges e WHERE e.parent_id = p.ld_id) AS has_children FROM properties p""",
    "properties", "property_edges",
)
def n17_property_records(spark, sf_dir):
    """Whole records of properties, from documents that are written and read back."""
    found, edges = views(spark, sf_dir, "properties", "property_edges")
    kind = F.element_at(F.array(*[F.lit(f"http://www.w3.org/2002/07/owl#{k}") for k in ("ObjectProperty", "AnnotationProperty", "DatatypeProperty")]), (F.col("ord") % 3 + 1).cast("int"))
    parents = edges.select("acronym", F.col("parent_id").alias("ld_id"), F.lit(True).alias("has")).distinct()
    body = found.join(parents, ["acronym", "ld_id"], "left").select(
        "acronym", F.col("ld_id").alias("@id"), kind.alias("@type"), F.col("pref_label").alias("prefLabel"), F.array("label").alias("label"), F.when(F.col("definition").isNotNull(), F.array("definition")).alias("definition"),
        F.coalesce("has", F.lit(False)).alias("hasChildren"))
    folder = shared_folder(spark)
    body.write.json(folder)
    read = documents.properties(spark, folder)
    return read.select("ld_id", "ld_type", short_type(F.col("ld_type")).alias("type"), "pref_label", F.array_join("labels", ",").alias("labels"), F.array_join("definitions", ",").alias("definitions"), F.col("acronym").alias("ontology"), F.col("hasChildren").alias("has_children"))


@query(
    f"""SELECT {SHORT.format(x="concat('http://example.org/r/', ld_id)")} AS short_id, concat('http://example.org/r/', ld_id) AS ld_id, source_class_id, relation_type, target_class_id, split_part(target_class_id, '/', 5) AS target_ontology FROM relations""",
    "relations",
)
def n16_relation_records(spark, sf_dir):
    """Whole records of relations."""
    (found,) = views(spark, sf_dir, "relations")
    uri = F.concat(F.lit("http://example.org/r/"), "ld_id")
    return found.select(short_id(uri).alias("short_id"), uri.alias("ld_id"), "source_class_id", "relation_type", "target_class_id", acronym_of(F.col("target_class_id"), f"{BASE}/").alias("target_ontology"))
