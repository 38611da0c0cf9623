"""Queries on requests, properties, relations, documents and catalogs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from termspark.operators import hierarchy, index, lookup, properties, search, validate
from termspark.plans import ORACLES, _asked, query, recursive, store
from termspark.sources import BASE, documents, shared_folder, views


@query(
    """WITH b AS (SELECT request_id, body, json_extract(body, '$.parameterObject') AS p, json_extract(body, '$.parameterObject.valueConstraints') AS c FROM bodies),
    k AS (SELECT *, len(list_filter(json_keys(body), lambda x: x NOT IN ('parameterObject', 'page', 'pageSize'))) > 0 AS strange FROM b)
    SELECT request_id, CASE WHEN strange THEN 400 WHEN codes <> '' THEN 422 ELSE 200 END AS status, CASE WHEN strange THEN 'unknown field' ELSE codes END AS violations FROM (
      SELECT *, concat_ws(',', CASE WHEN p IS NULL THEN 'parameterObject' END, CASE WHEN p IS NOT NULL AND c IS NULL THEN 'valueConstraints' END,
        CASE WHEN c IS NOT NULL AND json_extract(c, '$.ontologies') IS NULL THEN 'ontologies' END, CASE WHEN c IS NOT NULL AND json_extract(c, '$.branches') IS NULL THEN 'branches' END,
        CASE WHEN c IS NOT NULL AND json_extract(c, '$.valueSets') IS NULL THEN 'valueSets' END, CASE WHEN c IS NOT NULL AND json_extract(c, '$.classes') IS NULL THEN 'classes' END,
        CASE WHEN json_extract_string(c, '$.ontologies[0].acronym') = '' THEN 'ontologies.acronym empty' END,
        CASE WHEN json_extract_string(c, '$.actions[0].action') NOT IN ('move', 'delete') THEN 'actions.action' END) AS codes FROM k) t""",
    "bodies",
)
def v1_check_requests(spark, sf_dir):
    checked = validate.check_requests(views(spark, sf_dir, "bodies")[0], ["VSA", "VSN"])
    return checked.select("request_id", "status", F.array_join("violations", ",").alias("violations"))


def _properties(spark, sf_dir):
    (found,) = views(spark, sf_dir, "properties")
    return found.select("acronym", "ld_id", "pref_label", F.array("label").alias("labels"), F.array_compact(F.array("definition")).alias("definitions"), "ord")


@query(
    """WITH asked AS (SELECT min(p_partkey) AS request_id, concat(lower(p_type), ' ', p_size) AS q, p_size % 2 = 0 AS exact_match, p_size % 5 = 0 AS require_definitions, 1 + p_size % 2 AS page, 4 AS page_size FROM part GROUP BY p_type, p_size),
    hits AS (SELECT a.*, p.ld_id, p.ord, coalesce(pref_label, label) AS name FROM asked a JOIN properties p
      ON CASE WHEN exact_match THEN q IN (lower(coalesce(pref_label, label)), lower(label), lower(split_part(split_part(ld_id, '/', -1), '#', -1)))
         ELSE contains(lower(coalesce(pref_label, label)), q) OR contains(lower(label), q) END WHERE NOT require_definitions OR definition IS NOT NULL),
    r AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS total, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN contains(lower(name), q) THEN 0 ELSE 1 END, levenshtein(lower(name), q), ord, ld_id) AS rn FROM hits),
    s AS (SELECT *, CASE WHEN (page - 1) * page_size < total THEN (page - 1) * page_size ELSE 0 END AS start FROM r)
    SELECT request_id, CAST(rn - start AS INT) AS pos, ld_id, name AS pref_label, total FROM s WHERE rn > start AND rn <= start + page_size""",
    "properties",
)
def q2_property_search(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size")
    asked = part.groupBy("p_type", "p_size").agg(F.min("p_partkey").alias("request_id")).select(
        "request_id", F.concat(F.lower("p_type"), F.lit(" "), size).alias("q"), F.lit("PART").alias("acronym"), (size % 2 == 0).alias("exact_match"),
        (size % 5 == 0).alias("require_definitions"), (1 + size % 2).alias("page"), F.lit(4).alias("page_size"))
    known = _properties(spark, sf_dir)
    stored = store.kept(spark, sf_dir, "properties", lambda: index.build(properties.property_terms(known)))
    return properties.property_search(asked, known, stored)


@query(
    f"""SELECT p_partkey AS request_id, coalesce(pref_label, label) AS pref_label, ld_id IS NOT NULL AS found FROM part
    LEFT JOIN properties ON ld_id = concat('{BASE}/PART/prop#', p_type, '_', p_size + p_partkey % 2)""",
    "properties",
)
def l5_resolve_properties(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    asked = part.select(F.col("p_partkey").alias("request_id"), F.lit("PART").alias("acronym"), F.concat(F.lit(f"{BASE}/PART/prop#"), "p_type", F.lit("_"), F.col("p_size") + F.col("p_partkey") % 2).alias("ld_id"))
    return properties.resolve_properties(asked, _properties(spark, sf_dir))


@query()
def h6_property_descendants(spark, sf_dir):
    return hierarchy.descendants(*views(spark, sf_dir, "property_edges")).select("acronym", "root_id", "node_id", "depth")


ORACLES["h6_property_descendants"] = recursive(
    " SELECT acronym, root_id, node_id, CASE WHEN root_id LIKE '%/kind#%' AND node_id LIKE '%/brand#%' THEN 2 ELSE 1 END AS depth FROM closure", "property_edges"
).replace("FROM edges", "FROM property_edges").replace("JOIN edges", "JOIN property_edges")


@query(
    "SELECT o_orderkey AS request_id, relation_type, target_class_id, ld_id IS NOT NULL AS found FROM orders LEFT JOIN relations ON ld_id = concat('R', o_orderkey * 10 + 1 + o_orderkey % 7)",
    "relations",
)
def l6_resolve_relations(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    asked = orders.select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("R"), F.col("o_orderkey") * 10 + 1 + F.col("o_orderkey") % 7).alias("ld_id"))
    return lookup.resolve_relations(asked, *views(spark, sf_dir, "relations"))


@query("SELECT c.acronym, ld_id AS value_id, arg_min(e.parent_id, e.ord) AS set_id FROM concepts c LEFT JOIN edges e ON e.acronym = c.acronym AND e.child_id = ld_id WHERE c.acronym IN ('VSA', 'VSN') GROUP BY c.acronym, ld_id", "concepts", "edges")
def l7_value_to_set(spark, sf_dir):
    concepts, edges = views(spark, sf_dir, "concepts", "edges")
    return lookup.set_of_value(concepts.where(F.col("acronym").isin("VSA", "VSN")).select("acronym", F.col("ld_id").alias("value_id")), edges)


CATALOG = """SELECT o.acronym, o.name, CAST(coalesce(m.n, 0) AS BIGINT) AS classes FROM ontologies o LEFT JOIN (SELECT acronym, count(*) AS n FROM concepts GROUP BY acronym) m USING (acronym) WHERE """


def _catalog(spark, sf_dir, keep):
    ontologies, concepts = views(spark, sf_dir, "ontologies", "concepts")
    counts = concepts.groupBy("acronym").agg(F.count("*").alias("classes"))
    return ontologies.where(keep).join(counts, "acronym", "left").select("acronym", "name", F.coalesce("classes", F.lit(0)).alias("classes"))


@query(CATALOG + "ontology_type IS NULL OR ontology_type <> 'VALUE_SET_COLLECTION'", "ontologies", "concepts")
def l16_all_ontologies(spark, sf_dir):
    return _catalog(spark, sf_dir, "ontology_type IS NULL OR ontology_type <> 'VALUE_SET_COLLECTION'")


@query(CATALOG + "ontology_type = 'VALUE_SET_COLLECTION'", "ontologies", "concepts")
def l17_all_collections(spark, sf_dir):
    return _catalog(spark, sf_dir, "ontology_type = 'VALUE_SET_COLLECTION'")


@query(
    """WITH f AS (SELECT c.acronym, c.acronym IN ('VSA', 'VSN') AS coll, e.child_id IS NULL AS root FROM concepts c LEFT JOIN (SELECT DISTINCT acronym, child_id FROM edges) e ON e.acronym = c.acronym AND e.child_id = c.ld_id),
    s AS (SELECT unnest(['all', 'classes', 'value_sets', 'values', 'classes,value_sets', 'classes,values', 'value_sets,values']) AS scope)
    SELECT scope, acronym, count(*) AS n FROM s, f WHERE scope = 'all' OR (contains(scope, 'classes') AND NOT coll) OR (contains(scope, 'value_sets') AND coll AND root) OR (contains(scope, 'values') AND coll AND NOT root) GROUP BY scope, acronym""",
    "concepts", "edges",
)
def p7_search_scopes(spark, sf_dir):
    concepts, edges = views(spark, sf_dir, "concepts", "edges")
    below = edges.select("acronym", F.col("child_id").alias("ld_id"), F.lit(False).alias("root")).distinct()
    flagged = concepts.join(below, ["acronym", "ld_id"], "left").select("acronym", F.col("acronym").isin("VSA", "VSN").alias("coll"), F.coalesce("root", F.lit(True)).alias("root"))
    sizes = flagged.groupBy("acronym", "coll", "root").agg(F.count("*").alias("m"))
    scopes = F.array(*[F.lit(s) for s in ("all", "classes", "value_sets", "values", "classes,value_sets", "classes,values", "value_sets,values")])
    each = sizes.withColumn("scope", F.explode(scopes)).where(validate.in_scope(F.split("scope", ","), F.col("coll"), F.col("root")))
    return each.groupBy("scope", "acronym").agg(F.sum("m").alias("n"))


@query()
def s11_result_pages(spark, sf_dir):
    """The pages of c10, written as one JSON document per request and read back."""
    found = search.retrieved(*_asked(spark, sf_dir))
    folder = shared_folder(spark)
    documents.write_pages(found, found.select("request_id").distinct(), folder)
    return documents.read_pages(spark, folder, "source_type int, ld_id string, pref_label string")


ORACLES["s11_result_pages"] = ORACLES["c10_integrated_retrieve"]


@query(
    """SELECT o_orderkey AS doc_id, CAST(NULL AS VARCHAR) AS parent_id, concat('O', o_orderkey) AS node_id, 0 AS depth FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT l_orderkey, concat('O', l_orderkey), concat('L', l_linenumber), 1 FROM lineitem
    UNION ALL SELECT l_orderkey, concat('L', l_linenumber), concat('S', l_suppkey), 2 FROM lineitem""",
)
def s6_tree_documents(spark, sf_dir):
    """A tree document per order, its lines below it and a supplier below each, taken apart again."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.expr("l_orderkey = o_orderkey"), "left_semi")
    leaf = F.array(F.struct(F.concat(F.lit("S"), "l_suppkey").alias("@id")))
    nodes = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("L"), "l_linenumber").alias("@id"), leaf.alias("children"))).alias("children"))
    return documents.flatten_trees(nodes.select(F.col("l_orderkey").alias("doc_id"), F.to_json(F.struct(F.concat(F.lit("O"), "l_orderkey").alias("@id"), "children")).alias("body")))


@query("SELECT acronym, ld_id, pref_label, ord // 100 AS page, row_number() OVER (PARTITION BY acronym, ord // 100 ORDER BY ord, ld_id) - 1 AS place FROM concepts", "concepts")
def s2_class_pages(spark, sf_dir):
    """The concepts as page envelopes of a hundred orders each, written as JSON and read back in upstream order."""
    (concepts,) = views(spark, sf_dir, "concepts")
    each = F.array_sort(F.collect_list(F.struct("ord", F.col("ld_id").alias("@id"), F.col("pref_label").alias("prefLabel"))))
    pages = concepts.groupBy("acronym", F.expr("cast(ord div 100 AS int)").alias("page")).agg(each.alias("collection"))
    folder = shared_folder(spark)
    pages.write.json(folder)
    read = documents.class_pages(spark, folder)
    return read.select("acronym", "ld_id", "pref_label", F.shiftright("ord", 32).alias("page"), F.col("ord").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"))
