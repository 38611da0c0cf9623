"""Terminology tables derived from the supplied star schema, and the shared folder for intermediate tables.

Each view is one SELECT in the SQL that Spark and DuckDB have in common, so the same text also stands in front of the
queries that results are compared with.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BASE = "http://example.org/onto"

#: concepts: acronym, ld_id, pref_label, synonym, notation, related_match, ord. edges: acronym, child_id, parent_id, ord.
VIEWS = {
    "ontologies": f"""
SELECT acronym, concat('{BASE}/', acronym) AS ld_id, name, is_flat, ontology_type, ord FROM (
  SELECT 'GEO' AS acronym, 'Places' AS name, false AS is_flat, 'ONTOLOGY' AS ontology_type, 0 AS ord
  UNION ALL SELECT 'PART', 'Parts', false, 'ONTOLOGY', 1 UNION ALL SELECT 'FLAT', 'Suppliers', true, NULL, 2
  UNION ALL SELECT 'VSA', 'Segments', false, 'VALUE_SET_COLLECTION', 3
  UNION ALL SELECT 'VSN', 'Part types', false, 'VALUE_SET_COLLECTION', 4
  UNION ALL SELECT 'NEW', 'Proposals', false, 'ONTOLOGY', 5 UNION ALL SELECT 'VSW', 'Own sets', false, 'VALUE_SET_COLLECTION', 6) t""",
    "concepts": f"""
SELECT 'GEO' AS acronym, concat('{BASE}/GEO/region#R', r_regionkey) AS ld_id, r_name AS pref_label, CAST(NULL AS VARCHAR(1)) AS synonym,
       CAST(NULL AS VARCHAR(1)) AS notation, CAST(NULL AS VARCHAR(1)) AS related_match, CAST(r_regionkey AS BIGINT) AS ord FROM region
UNION ALL SELECT 'GEO', concat('{BASE}/GEO/nation#N', n_nationkey), n_name, NULL, NULL, NULL, CAST(100 + n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT 'GEO', concat('{BASE}/GEO/customer#C', c_custkey), c_name, c_mktsegment, NULL, NULL, CAST(1000 + c_custkey AS BIGINT) FROM customer
UNION ALL SELECT 'PART', concat('{BASE}/PART/type#', p_type), p_type, NULL, NULL, NULL, min(p_partkey) FROM part GROUP BY p_type
UNION ALL SELECT 'PART', concat('{BASE}/PART/brand#', p_type, '_', p_brand), p_brand, p_type, NULL, NULL, 1000000000 + min(p_partkey) FROM part GROUP BY p_type, p_brand
UNION ALL SELECT 'PART', concat('{BASE}/PART/part#P', p_partkey), p_name, p_brand, NULL, NULL, 2000000000 + p_partkey FROM part
UNION ALL SELECT 'FLAT', concat('{BASE}/FLAT/S', s_suppkey), s_name, NULL, NULL, NULL, s_suppkey FROM supplier
UNION ALL SELECT 'VSA', concat('{BASE}/VSA/', c_mktsegment), c_mktsegment, NULL, NULL, NULL, min(c_custkey) FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'VSA', concat('{BASE}/VSA/C', c_custkey), c_name, NULL, NULL, NULL, 1000000000 + c_custkey FROM customer
UNION ALL SELECT 'VSN', concat('{BASE}/VSN/', p_type), p_type, NULL, NULL, NULL, min(p_partkey) FROM part GROUP BY p_type
UNION ALL SELECT 'VSN', concat('{BASE}/VSN/P', p_partkey), p_name, NULL, p_brand, concat('{BASE}/PART/part#P', p_partkey), 1000000000 + p_partkey FROM part""",
    "edges": f"""
SELECT 'GEO' AS acronym, concat('{BASE}/GEO/nation#N', n_nationkey) AS child_id, concat('{BASE}/GEO/region#R', n_regionkey) AS parent_id, CAST(n_nationkey AS BIGINT) AS ord FROM nation
UNION ALL SELECT 'GEO', concat('{BASE}/GEO/customer#C', c_custkey), concat('{BASE}/GEO/nation#N', c_nationkey), CAST(1000 + c_custkey AS BIGINT) FROM customer
UNION ALL SELECT 'PART', concat('{BASE}/PART/brand#', p_type, '_', p_brand), concat('{BASE}/PART/type#', p_type), min(p_partkey) FROM part GROUP BY p_type, p_brand
UNION ALL SELECT 'PART', concat('{BASE}/PART/part#P', p_partkey), concat('{BASE}/PART/brand#', p_type, '_', p_brand), 1000000000 + p_partkey FROM part
UNION ALL SELECT 'VSA', concat('{BASE}/VSA/C', c_custkey), concat('{BASE}/VSA/', c_mktsegment), c_custkey FROM customer
UNION ALL SELECT 'VSN', concat('{BASE}/VSN/P', p_partkey), concat('{BASE}/VSN/', p_type), p_partkey FROM part""",
    #: One row per request: a word of the part names each, and one request without text per region.
    "requests": """
SELECT CAST(1000 + min(p_partkey) AS BIGINT) AS request_id, split_part(p_name, ' ', 1) AS input_text, 1 + CAST(min(p_partkey) % 2 AS INT) AS page, 7 AS page_size FROM part GROUP BY split_part(p_name, ' ', 1)
UNION ALL SELECT CAST(r_regionkey AS BIGINT), '', 1 + r_regionkey % 3, 5 + r_regionkey FROM region""",
    #: One row per request and source: type 0 classes, 1 ontologies, 2 branches, 3 value sets.
    "sources": f"""
SELECT CAST(1000 + min(p_partkey) AS BIGINT) AS request_id, 1 AS source_type, 0 AS source_idx, 'PART' AS acronym, CAST(NULL AS VARCHAR(1)) AS uri, CAST(NULL AS VARCHAR(1)) AS label FROM part GROUP BY split_part(p_name, ' ', 1)
UNION ALL SELECT CAST(1000 + min(p_partkey) AS BIGINT), 2, 0, 'PART', concat('{BASE}/PART/type#', min(p_type)), NULL FROM part GROUP BY split_part(p_name, ' ', 1)
UNION ALL SELECT CAST(1000 + min(p_partkey) AS BIGINT), 3, 0, 'VSN', concat('{BASE}/VSN/', max(p_type)), NULL FROM part GROUP BY split_part(p_name, ' ', 1)
UNION ALL SELECT CAST(r_regionkey AS BIGINT), 0, CAST(n_nationkey AS INT), 'GEO', concat('{BASE}/GEO/nation#N', n_nationkey), concat('Nation ', n_name) FROM region JOIN nation ON r_regionkey = n_regionkey
UNION ALL SELECT CAST(r_regionkey AS BIGINT), 0, 100, 'GEO', concat('{BASE}/GEO/nowhere#', r_regionkey), 'In no table' FROM region
UNION ALL SELECT CAST(r_regionkey AS BIGINT), 1, 0, 'FLAT', NULL, NULL FROM region
UNION ALL SELECT CAST(r_regionkey AS BIGINT), 2, 0, 'GEO', concat('{BASE}/GEO/region#R', r_regionkey), NULL FROM region""",
    #: Deletes and moves on the results of the requests without text.
    "actions": f"""
SELECT CAST(n_regionkey AS BIGINT) AS request_id, CASE WHEN n_nationkey % 2 = 0 THEN 'delete' ELSE 'move' END AS action,
       concat('{BASE}/GEO/nation#N', n_nationkey) AS term_uri, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_nationkey % 4 END AS position FROM nation""",
    #: One integrated search for each part, on every route: text for odd keys, by the last digit enumerated classes, an
    #: ontology, a branch, a value set or several of them.
    "calls": """
SELECT p_partkey AS request_id,
       CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN '  ' WHEN p_partkey % 20 = 7 THEN 'Term 1'
            WHEN p_partkey % 8 = 1 THEN concat(split_part(p_name, ' ', 1), ' ', substr(split_part(p_name, ' ', 2), 1, 2))
            WHEN p_partkey % 8 = 3 THEN concat('brand ', p_size % 10) WHEN p_partkey % 8 = 5 THEN concat(' alias ', p_size) ELSE concat('USER', p_size) END AS input_text,
       1 + CAST(p_partkey % 3 AS INT) AS page, 3 + CAST(p_partkey % 5 AS INT) AS page_size FROM part""",
    "call_sources": f"""
SELECT p_partkey AS request_id, 0 AS source_type, 0 AS source_idx, 'PART' AS acronym, concat('{BASE}/PART/part#P', p_partkey) AS uri, p_name AS label FROM part WHERE p_partkey % 10 IN (0, 1, 8, 9)
UNION ALL SELECT p_partkey, 0, 1, 'PART', concat('{BASE}/PART/brand#', p_type, '_', p_brand), upper(p_brand) FROM part WHERE p_partkey % 10 IN (0, 1, 8, 9)
UNION ALL SELECT p_partkey, 0, 2, 'PART', concat('{BASE}/PART/part#P', p_partkey + 1), concat(p_name, ' ', p_size) FROM part WHERE p_partkey % 10 IN (0, 1, 8, 9)
UNION ALL SELECT p_partkey, 1, 0, CASE WHEN p_partkey % 3 = 0 THEN 'NEW' ELSE 'PART' END, CAST(NULL AS VARCHAR(1)), CAST(NULL AS VARCHAR(1)) FROM part WHERE p_partkey % 10 IN (2, 3)
UNION ALL SELECT p_partkey, 1, 0, 'PART', NULL, NULL FROM part WHERE p_partkey % 10 IN (8, 9)
UNION ALL SELECT p_partkey, 1, 1, 'NEW', NULL, NULL FROM part WHERE p_partkey % 10 IN (8, 9)
UNION ALL SELECT p_partkey, 2, 0, 'PART', concat('{BASE}/PART/type#', p_type), NULL FROM part WHERE p_partkey % 10 IN (4, 5, 8, 9)
UNION ALL SELECT p_partkey, 3, 0, 'VSN', concat('{BASE}/VSN/', p_type), NULL FROM part WHERE p_partkey % 10 IN (8, 9) OR p_partkey % 10 IN (6, 7) AND p_partkey % 20 NOT IN (6, 7)
UNION ALL SELECT p_partkey, 3, 1, 'VSW', concat('{BASE}/provisional_classes/S', p_partkey * 10), NULL FROM part WHERE p_partkey % 10 IN (8, 9) OR p_partkey % 20 IN (6, 7)""",
    "call_actions": f"""
SELECT p_partkey AS request_id, 'move' AS action, concat('{BASE}/PART/part#P', p_partkey) AS term_uri, 'OntologyClass' AS type, CAST(p_partkey % 4 AS INT) AS position FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, 'move', concat('{BASE}/VSN/P', p_partkey), 'Value', 4 + CAST(p_partkey % 2 AS INT) FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, 'move', concat('{BASE}/nowhere#', p_partkey), 'OntologyClass', 0 FROM part WHERE p_partkey % 9 = 1
UNION ALL SELECT p_partkey, 'delete', concat('{BASE}/PART/part#P', p_partkey + 1), 'OntologyClass', NULL FROM part WHERE p_partkey % 3 = 1""",
    #: A feed of changes to provisional terms, one key per user.
    "change_feed": """
SELECT user_id AS term_key, ts, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, event_type AS label,
       CASE WHEN event_type = 'view' THEN NULL ELSE value END AS weight FROM events""",
    #: Provisional terms: value sets and values of the writable collection VSW, classes of NEW (which has no others) and of
    #: PART. Some values name their set by its encoded id; some classes have no label.
    "provisional": f"""
SELECT concat('{BASE}/provisional_classes/', CASE WHEN k % 10 = 0 THEN 'S' WHEN k % 10 < 5 THEN 'V' ELSE 'C' END, k) AS ld_id,
       CASE WHEN k % 10 = 0 THEN 'value_set' WHEN k % 10 < 5 THEN 'value' ELSE 'class' END AS entity, CASE WHEN k % 10 < 5 THEN 'VSW' WHEN k % 2 = 0 THEN 'NEW' ELSE 'PART' END AS acronym,
       CASE WHEN k % 50 <> 7 THEN concat(split_part(priority, '-', 2), ' term ', k) END AS pref_label, concat('user', custkey) AS creator,
       CASE WHEN k % 10 IN (1, 3, 4) THEN concat('{BASE}/provisional_classes/S', k - k % 10) WHEN k % 10 = 2 THEN url_encode(concat('{BASE}/provisional_classes/S', k - k % 10)) WHEN k % 10 = 5 THEN '{BASE}/PART/type#ECONOMY' END AS subclass_of,
       CASE WHEN k % 3 = 0 THEN concat('Term number ', k) END AS definition, CASE WHEN k % 4 = 0 THEN concat('alias ', k) END AS synonym, k AS ord
FROM (SELECT o_orderkey AS k, o_orderpriority AS priority, o_custkey AS custkey FROM orders) o""",
    #: One request per provisional value and per value of a regular set, for the set that it is in; every seventh of the
    #: regular ones names a set that is not there.
    "set_requests": f"""
SELECT concat('{BASE}/VSN/P', p_partkey) AS request_id, 'VSN' AS acronym, concat('{BASE}/VSN/', p_type, CASE WHEN p_partkey % 7 = 3 THEN '?' ELSE '' END) AS vs_id FROM part
UNION ALL SELECT concat('{BASE}/VSA/C', c_custkey), 'VSA', url_encode(concat('{BASE}/VSA/', c_mktsegment)) FROM customer
UNION ALL SELECT concat('{BASE}/provisional_classes/V', o_orderkey), 'VSW', concat('{BASE}/provisional_classes/S', o_orderkey - o_orderkey % 10) FROM orders WHERE o_orderkey % 10 BETWEEN 1 AND 4""",
    #: Term searches over regular and provisional terms: words of part names, and words of priorities.
    "term_requests": f"""
SELECT CAST(min(p_partkey) AS BIGINT) AS request_id, split_part(p_name, ' ', 1) AS q, CASE min(p_partkey) % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'classes' WHEN 2 THEN 'value_sets,values' ELSE 'values' END AS scope, min(p_partkey) % 3 = 1 AS suggest,
       CASE WHEN min(p_partkey) % 5 = 2 THEN concat('{BASE}/PART/type#', min(p_type)) END AS subtree_root, CAST(min(p_partkey) % 3 AS INT) AS max_depth, 1 + CAST(min(p_partkey) % 2 AS INT) AS page, 6 AS page_size FROM part GROUP BY split_part(p_name, ' ', 1)
UNION ALL SELECT 1000000 + CAST(min(o_orderkey) AS BIGINT), concat(split_part(o_orderpriority, '-', 2), ' ter'), 'all', true, NULL, 0, 1, 9 FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 2000000 + CAST(min(o_orderkey) AS BIGINT), concat(' ', lower(split_part(o_orderpriority, '-', 2))), CASE WHEN min(o_orderkey) % 2 = 0 THEN 'classes' ELSE 'value_sets' END, false, NULL, 0, 2, 5 FROM orders GROUP BY o_orderpriority""",
    #: Properties of the ontology of parts; some have no preferred label, some no definition.
    "properties": f"""
SELECT 'PART' AS acronym, concat('{BASE}/PART/prop#', p_type, '_', p_size) AS ld_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat(p_type, ' ', p_size, ' measure') END AS pref_label,
       concat(p_type, ' ', p_size) AS label, CASE WHEN p_size % 2 = 0 THEN concat('Parts of size ', p_size) END AS definition, min(p_partkey) AS ord FROM part GROUP BY p_type, p_size""",
    "property_edges": f"""
SELECT 'PART' AS acronym, concat('{BASE}/PART/prop#', p_type, '_', p_size) AS child_id, concat('{BASE}/PART/kind#', p_type) AS parent_id, min(p_partkey) AS ord FROM part GROUP BY p_type, p_size
UNION ALL SELECT 'PART', concat('{BASE}/PART/brand#', p_type, '_', p_size, '_', p_brand), concat('{BASE}/PART/prop#', p_type, '_', p_size), 1000000000 + min(p_partkey) FROM part GROUP BY p_type, p_size, p_brand""",
    #: One relation per order line, from a part to its supplier.
    "relations": f"""
SELECT concat('R', l_orderkey * 10 + l_linenumber) AS ld_id, concat('{BASE}/PART/part#P', l_partkey) AS source_class_id, 'suppliedBy' AS relation_type, concat('{BASE}/FLAT/S', l_suppkey) AS target_class_id FROM lineitem""",
    #: Search bodies, one per event; six of seven kinds break a rule. Angle brackets stand for braces.
    "bodies": """
SELECT event_id AS request_id, replace(replace(CASE event_id % 7
  WHEN 0 THEN concat('<"parameterObject":<"inputText":"', event_type, '","valueConstraints":<"ontologies":[<"acronym":"PART">],"branches":[],"valueSets":[],"classes":[],"actions":[]>>,"page":1,"pageSize":', user_id, '>')
  WHEN 1 THEN concat('<"page":', user_id, '>') WHEN 2 THEN '<"parameterObject":<"inputText":"x">>' WHEN 3 THEN '<"parameterObject":<"valueConstraints":<"branches":[]>>>'
  WHEN 4 THEN concat('<"parameterObject":<"valueConstraints":<"ontologies":[],"branches":[],"valueSets":[],"classes":[]>>,"', event_type, '":1>')
  WHEN 5 THEN '<"parameterObject":<"valueConstraints":<"ontologies":[<"acronym":"">],"branches":[],"valueSets":[],"classes":[]>>>'
  ELSE concat('<"parameterObject":<"valueConstraints":<"ontologies":[],"branches":[],"valueSets":[],"classes":[],"actions":[<"action":"', event_type, '","termUri":"t","type":"Value","source":"s">]>>>')
  END, '<', chr(123)), '>', chr(125)) AS body FROM events""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views over the tables in sf_dir; nothing is registered in the session."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    out = []
    for name in names:
        text = VIEWS[name]
        used = {t: f for t, f in frames.items() if f" {t}" in text}
        for t in used:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        out.append(spark.sql(text, **used) if used else spark.sql(text))
    return out


def with_views(sql: str, *names: str) -> str:
    """`sql` with the named views in front; `sql` may start with further common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (", " + sql[5:] if sql.lstrip().upper().startswith("WITH ") else " " + sql)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir.

    If none is named, a session on one machine gets a temporary one, for tests; elsewhere executors would not share it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/termspark-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int | None = None, distinct: bool = False) -> DataFrame:
    """df written to the shared folder in buckets by `key`, sorted in each: a join on the key moves only its other side.
    distinct: equal rows are written once."""
    spark, path, name = df.sparkSession, shared_folder(df.sparkSession), f"termspark_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, key)
    (dealt.distinct() if distinct else dealt).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` has written and that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
