"""Queries on regular and provisional terms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from termspark.functions import acronym_of, is_property_type, short_type
from termspark.operators import hierarchy, lookup, paging, properties, search, terms, validate
from termspark.plans import NAMES, ORACLES, ROWS, SHORT, _sources, query, recursive, store
from termspark.sources import BASE, documents, shared_folder, views, with_views
from termspark.streaming import refresh_catalog

READ, WRITE = ["VSA", "VSN", "VSW"], ["VSW"]
KIND = "CASE entity WHEN 'class' THEN 'OntologyClass' WHEN 'value_set' THEN 'ValueSet' ELSE 'Value' END"
TERMS = """WITH below AS (SELECT DISTINCT acronym, child_id FROM edges),
terms AS (SELECT c.acronym, c.ld_id, pref_label, synonym, c.ord, false AS is_provisional, CASE WHEN c.acronym NOT IN ('VSA', 'VSN', 'VSW') THEN 'class' WHEN b.child_id IS NOT NULL THEN 'value' ELSE 'value_set' END AS entity,
    CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS creator, CAST(NULL AS VARCHAR) AS definition, notation FROM concepts c LEFT JOIN below b ON b.acronym = c.acronym AND b.child_id = c.ld_id
  UNION ALL SELECT acronym, ld_id, pref_label, synonym, ord, true, entity, subclass_of, creator, definition, NULL FROM provisional)"""
BASES = ("concepts", "edges", "provisional")


def _terms(spark, sf_dir):
    """(terms, edges, provisional) of the tables in sf_dir."""
    concepts, edges, provisional = views(spark, sf_dir, *BASES)
    return terms.union_terms(concepts, provisional, edges, READ), edges, provisional


@query(TERMS + " SELECT acronym, ld_id, pref_label, entity, is_provisional FROM terms", *BASES)
def u2_all_terms(spark, sf_dir):
    return _terms(spark, sf_dir)[0].select("acronym", "ld_id", "pref_label", "entity", "is_provisional")


ASKED_SETS = TERMS + """, sets AS (SELECT * FROM terms WHERE entity = 'value_set'),
  known AS (SELECT r.*, coalesce(s.ld_id, p.ld_id) AS set_id, coalesce(s.pref_label, p.pref_label) AS pref_label, CASE WHEN s.ld_id IS NOT NULL THEN 'regular' WHEN p.ld_id IS NOT NULL THEN 'provisional' ELSE 'not_found' END AS origin
    FROM set_requests r LEFT JOIN sets s ON NOT s.is_provisional AND s.acronym = r.acronym AND s.ld_id = url_decode(r.vs_id) LEFT JOIN sets p ON p.is_provisional AND p.ld_id = url_decode(r.vs_id))"""


@query(ASKED_SETS + " SELECT request_id, set_id, pref_label, origin FROM known", *BASES, "set_requests")
def l2_resolve_value_sets(spark, sf_dir):
    return terms.resolve_sets(*views(spark, sf_dir, "set_requests"), _terms(spark, sf_dir)[0]).select("request_id", "set_id", "pref_label", "origin")


@query(
    TERMS + """, asked AS (SELECT acronym, ld_id AS value_id FROM terms WHERE entity <> 'class' OR is_provisional)
    SELECT a.value_id, v.pref_label, v.notation, CASE WHEN v.ld_id IS NULL THEN 'not_found' WHEN v.is_provisional THEN 'provisional' ELSE 'regular' END AS origin
    FROM asked a LEFT JOIN terms v ON v.entity = 'value' AND v.ld_id = a.value_id AND v.is_provisional = contains(a.value_id, 'provisional_classes') AND (v.is_provisional OR v.acronym = a.acronym)""",
    *BASES,
)
def l3_resolve_values(spark, sf_dir):
    every, *_ = _terms(spark, sf_dir)
    asked = every.where("entity <> 'class' OR is_provisional").select("acronym", F.col("ld_id").alias("value_id"))
    return terms.resolve_values(asked, every).select("value_id", "pref_label", "notation", "origin")


@query(
    """WITH asked AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, CASE l_linenumber % 5 WHEN 0 THEN 'GEO' WHEN 1 THEN 'PART' WHEN 2 THEN 'NEW' WHEN 3 THEN 'NONE' ELSE 'VSA' END AS acronym FROM lineitem)
    SELECT request_id, a.acronym, ld_id, name, is_flat, o.acronym IS NOT NULL AS found FROM asked a LEFT JOIN ontologies o ON o.acronym = a.acronym""",
    "ontologies",
)
def l4_resolve_ontologies(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("GEO", "PART", "NEW", "NONE", "VSA")])
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    asked = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.element_at(names, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("acronym"))
    return lookup.resolve_ontologies(asked, *views(spark, sf_dir, "ontologies")).select("request_id", "acronym", "ld_id", "name", "is_flat", "found")


@query(ASKED_SETS + " SELECT ld_id AS value_id, set_id, known.pref_label, origin FROM known JOIN provisional p ON p.ld_id = request_id AND p.entity = 'value'", *BASES, "set_requests")
def l7_set_of_provisional_value(spark, sf_dir):
    """The writable branch: a value's own set id, resolved as any value set."""
    every, _, provisional = _terms(spark, sf_dir)
    values = provisional.where("entity = 'value'").select(F.col("ld_id").alias("value_id"), "acronym", F.col("subclass_of").alias("vs_id"))
    return terms.resolve_sets(values, every).select("value_id", "set_id", "pref_label", "origin")


@query(
    TERMS + """, asked AS (SELECT request_id, url_decode(vs_id) AS vs_id, request_id AS value_id FROM set_requests),
    named AS (SELECT *, CASE WHEN contains(vs_id, '/VSA/') THEN 'VSA' WHEN contains(vs_id, '/VSN/') THEN 'VSN' WHEN contains(vs_id, '/VSW/') THEN 'VSW' END AS collection FROM asked)
    SELECT n.value_id, collection, v.pref_label, CASE WHEN v.ld_id IS NULL THEN 'not_found' WHEN v.is_provisional THEN 'provisional' ELSE 'regular' END AS origin
    FROM named n LEFT JOIN terms v ON v.entity = 'value' AND v.ld_id = n.value_id AND v.is_provisional = contains(n.value_id, 'provisional_classes') AND (v.is_provisional OR v.acronym = n.collection)""",
    *BASES, "set_requests",
)
def l8_value_by_set(spark, sf_dir):
    (asked,) = views(spark, sf_dir, "set_requests")
    named = asked.select(F.col("request_id").alias("value_id"), terms.collection_of(F.expr("url_decode(vs_id)"), READ).alias("acronym"))
    return terms.resolve_values(named, _terms(spark, sf_dir)[0]).select("value_id", F.col("acronym").alias("collection"), "pref_label", "origin")


FIRST_VALUES = "SELECT acronym, arg_min(child_id, ord) AS value_id FROM edges WHERE acronym IN ('VSA', 'VSN') GROUP BY acronym, parent_id"


def _first_values(edges):
    """One value of each regular value set: that which comes first."""
    return edges.where(F.col("acronym").isin("VSA", "VSN")).groupBy("acronym", "parent_id").agg(F.min_by("child_id", "ord").alias("value_id")).select("acronym", "value_id")


@query(f"WITH v AS ({FIRST_VALUES}) SELECT v.value_id, o.parent_id AS set_id, s.child_id AS sibling_id FROM v JOIN edges o ON o.acronym = v.acronym AND o.child_id = v.value_id JOIN edges s ON s.acronym = o.acronym AND s.parent_id = o.parent_id", "edges")
def l10_values_beside(spark, sf_dir):
    (edges,) = views(spark, sf_dir, "edges")
    return terms.values_beside(_first_values(edges), edges).select("value_id", "set_id", "sibling_id")


@query(TERMS + " SELECT acronym, ld_id, pref_label, o.ord AS collection_ord, terms.ord FROM terms JOIN ontologies o USING (acronym) WHERE entity = 'value_set'".replace("acronym, ld_id", "terms.acronym, terms.ld_id"), *BASES, "ontologies")
def l12_all_value_sets(spark, sf_dir):
    """Every value set in catalog order, which is (collection_ord, ord)."""
    (ontologies,) = views(spark, sf_dir, "ontologies")
    every, *_ = _terms(spark, sf_dir)
    return lookup.all_value_sets(every, ontologies)


@query(TERMS + """, p AS (SELECT *, row_number() OVER (PARTITION BY acronym ORDER BY is_provisional, ord, ld_id) AS rn, count(*) OVER (PARTITION BY acronym) AS total FROM terms WHERE entity = 'class')
    SELECT acronym, CAST(rn - 20 AS INT) AS pos, ld_id, pref_label, total FROM p WHERE rn > 20 AND rn <= 40""", *BASES)
def l13_classes_in_ontology(spark, sf_dir):
    """The second page of twenty classes of every ontology, regular ones first."""
    every, *_ = _terms(spark, sf_dir)
    return lookup.class_page(every.where("entity = 'class'"), 2, 20)


@query("SELECT acronym, ld_id, coalesce(pref_label, label) AS pref_label, definition FROM properties", "properties")
def l13_properties_in_ontology(spark, sf_dir):
    (found,) = views(spark, sf_dir, "properties")
    labelled = properties.labelled(found.withColumn("labels", F.array("label")))
    return labelled.where("acronym = 'PART'").select("acronym", "ld_id", "pref_label", "definition")


@query("SELECT acronym, ld_id, pref_label, creator, subclass_of FROM provisional WHERE entity = 'class'", "provisional")
def l14_provisional_classes(spark, sf_dir):
    (made,) = views(spark, sf_dir, "provisional")
    return made.where("entity = 'class'").select("acronym", "ld_id", "pref_label", "creator", "subclass_of")


ACTIONS = "SELECT request_id, term_uri, CASE WHEN position = 3 THEN 'Thing' WHEN position = 2 THEN 'Value' ELSE 'OntologyClass' END AS type FROM actions"


@query()
def l18_action_terms(spark, sf_dir):
    requests, rows = _sources(spark, sf_dir)
    (actions,) = views(spark, sf_dir, "actions")
    kind = F.when(F.col("position") == 3, "Thing").when(F.col("position") == 2, "Value").otherwise("OntologyClass")
    page = search.integrated_retrieve(requests, rows)
    return terms.resolve_actions(actions.select("request_id", "term_uri", kind.alias("type")), page, rows.where("source_type = 0"), _terms(spark, sf_dir)[0])


PAGED = """, p AS (SELECT r.*, page, page_size, count(*) OVER (PARTITION BY r.request_id) AS total, row_number() OVER (PARTITION BY r.request_id ORDER BY source_type, source_idx, ord, ld_id) AS rn FROM r JOIN requests q ON q.request_id = r.request_id),
    s AS (SELECT *, CASE WHEN (page - 1) * page_size < total THEN (page - 1) * page_size ELSE 0 END AS start FROM p), shown AS (SELECT request_id, ld_id, arg_min(pref_label, rn) AS pref_label FROM s WHERE rn > start AND rn <= start + page_size GROUP BY request_id, ld_id)"""
ORACLES["l18_action_terms"] = recursive(
    ROWS + PAGED + f""", a AS ({ACTIONS}), e AS (SELECT request_id, ld_id, arg_min(pref_label, ord) AS pref_label FROM r WHERE source_type = 0 GROUP BY request_id, ld_id),
    j AS (SELECT a.*, s.pref_label AS one, e.pref_label AS two, c.pref_label AS three FROM a LEFT JOIN shown s ON s.request_id = a.request_id AND s.ld_id = term_uri LEFT JOIN e ON e.request_id = a.request_id AND e.ld_id = term_uri
      LEFT JOIN concepts c ON c.ld_id = term_uri AND type = CASE WHEN c.acronym IN ('VSA', 'VSN') THEN 'Value' ELSE 'OntologyClass' END)
    SELECT request_id, term_uri, type, CASE WHEN one IS NULL AND type = 'Thing' THEN NULL ELSE coalesce(one, CASE WHEN type = 'OntologyClass' THEN two END, three) END AS pref_label,
      CASE WHEN one IS NOT NULL THEN 'result' WHEN type = 'Thing' THEN 'rejected' WHEN type = 'OntologyClass' AND two IS NOT NULL THEN 'enumerated' WHEN three IS NOT NULL THEN 'term' ELSE 'not_found' END AS origin FROM j""", *NAMES, "actions")


@query(
    TERMS + f""" SELECT ld_id, {SHORT.format(x='ld_id')} AS short_id, 'OntologyClass' AS type, pref_label, creator, acronym AS ontology, coalesce(definition, '') AS definitions, coalesce(synonym, '') AS synonyms, parent_id AS subclass_of, is_provisional FROM terms WHERE entity = 'class'""",
    *BASES,
)
def n11_class_records(spark, sf_dir):
    found = terms.class_records(_terms(spark, sf_dir)[0])
    return found.withColumns({c: F.array_join(c, ",") for c in ("definitions", "synonyms")})


@query(
    TERMS + f""" SELECT ld_id, {SHORT.format(x='ld_id')} AS short_id, {KIND} AS type, pref_label, creator, acronym AS vs_collection, CASE WHEN entity = 'value' THEN parent_id END AS vs_id, notation, is_provisional FROM terms WHERE entity <> 'class'""",
    *BASES,
)
def n13_value_records(spark, sf_dir):
    return terms.value_records(_terms(spark, sf_dir)[0])


@query(
    TERMS + f""" SELECT {SHORT.format(x='ld_id')} AS short_id, ld_id, {KIND} AS type, pref_label, CASE WHEN entity = 'value' THEN notation END AS notation, definition, acronym AS source FROM terms""",
    *BASES,
)
def n18_search_results(spark, sf_dir):
    return terms.search_results(_terms(spark, sf_dir)[0])


@query(
    f"""WITH c AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 = 0 THEN concat('obo:', c_custkey) ELSE concat('http://purl.example.org/x#', c_custkey) END AS uri, c_name AS label, CASE WHEN c_custkey % 2 = 0 THEN 'OntologyClass' ELSE 'http://example.org/kinds/OntologyClass' END AS type,
      CASE WHEN c_custkey % 5 = 0 THEN 'https://example.org/o/GEO' ELSE 'GEO' END AS source FROM customer)
    SELECT request_id, {SHORT.format(x='uri')} AS short_id, uri AS ld_id, CASE WHEN contains(type, ':') THEN type ELSE concat('{BASE}/types/', type) END AS ld_type, type, label AS pref_label, CASE WHEN contains(source, ':') THEN source ELSE concat('{BASE}/', source) END AS source FROM c""",
)
def n20_enumerated_results(spark, sf_dir):
    k = F.col("c_custkey")
    uri = F.when(k % 3 == 0, F.concat(F.lit("obo:"), k)).otherwise(F.concat(F.lit("http://purl.example.org/x#"), k))
    kind, source = F.when(k % 2 == 0, "OntologyClass").otherwise("http://example.org/kinds/OntologyClass"), F.when(k % 5 == 0, "https://example.org/o/GEO").otherwise("GEO")
    classes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("request_id"), F.struct(uri.alias("uri"), F.col("c_name").alias("prefLabel"), kind.alias("type"), source.alias("source")).alias("c"))
    return terms.enumerated_results(classes, f"{BASE}/types/", f"{BASE}/")


@query(
    f"""SELECT p.ld_id, p.creator, concat('{BASE}/FLAT/S', l_suppkey) AS target_class_id, CASE WHEN l_linenumber % 2 = 0 THEN 'someone' ELSE p.creator END AS relation_creator
    FROM provisional p JOIN lineitem l ON l_orderkey = p.ord WHERE p.entity = 'class'""",
    "provisional",
)
def n26_write_records(spark, sf_dir):
    classes = views(spark, sf_dir, "provisional")[0].where("entity = 'class'")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    named = classes.select("ld_id", F.col("ord").alias("l_orderkey")).join(lines, "l_orderkey")
    relations = named.select(F.col("ld_id").alias("source_class_id"), F.lit("suppliedBy").alias("relation_type"), F.concat(F.lit(f"{BASE}/FLAT/S"), "l_suppkey").alias("target_class_id"), F.when(F.col("l_linenumber") % 2 == 0, "someone").alias("creator"))
    made = terms.write_records(classes.select("ld_id", "entity", "creator"), relations)
    return made.select("ld_id", "creator", F.explode("relations").alias("r")).select("ld_id", "creator", "r.target_class_id", F.col("r.creator").alias("relation_creator"))


@query("SELECT request_id, coalesce(array_to_string(CAST(json_extract_string(body, '$.parameterObject.valueConstraints.ontologies[*].acronym') AS VARCHAR[]), ','), '') AS acronyms FROM bodies", "bodies")
def n27_acronym_lists(spark, sf_dir):
    parsed = documents.requests(*views(spark, sf_dir, "bodies"))
    own = F.transform(F.col("r.parameterObject.valueConstraints.ontologies"), lambda o: o["acronym"])
    return parsed.select("request_id", F.coalesce(F.array_join(own, ","), F.lit("")).alias("acronyms"))


@query(
    """SELECT ld_id, CASE ord % 4 WHEN 0 THEN 'ObjectProperty' WHEN 1 THEN 'AnnotationProperty' WHEN 2 THEN 'Class' ELSE 'DatatypeProperty' END AS short_type, ord % 4 <> 2 AS is_property, CASE WHEN ord % 3 > 0 THEN acronym END AS acronym FROM properties""",
    "properties",
)
def n3_types_and_acronyms(spark, sf_dir):
    """The short type, whether it is one of a property, and the acronym from the URI of the ontology."""
    (found,) = views(spark, sf_dir, "properties")
    kind = F.element_at(F.array(*[F.lit(f"http://www.w3.org/2002/07/owl#{k}") for k in ("ObjectProperty", "AnnotationProperty", "Class")], F.lit("DatatypeProperty")), (F.col("ord") % 4 + 1).cast("int"))
    uri = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("http://elsewhere.org/"), "acronym")).otherwise(F.concat(F.lit(f"{BASE}/"), "acronym"))
    return found.select("ld_id", short_type(kind).alias("short_type"), is_property_type(kind).alias("is_property"), acronym_of(uri, f"{BASE}/").alias("acronym"))


@query(TERMS + " SELECT acronym, ld_id, CASE WHEN entity = 'class' THEN 'OntologyClass' WHEN acronym IN ('VSA', 'VSN', 'VSW') AND entity = 'value_set' THEN 'ValueSet' ELSE 'Value' END AS type, count(*) OVER (PARTITION BY acronym) AS total FROM terms QUALIFY pref_label IS NOT NULL", *BASES)
def p4_classified_hits(spark, sf_dir):
    """Every hit gets its type by the catalog of value sets; those without a label go, but the totals count them."""
    every, *_ = _terms(spark, sf_dir)
    (ontologies,) = views(spark, sf_dir, "ontologies")
    catalog = lookup.all_value_sets(every, ontologies)
    return search.classified(every.select("acronym", "ld_id", "pref_label"), catalog, READ)


@query("SELECT s.ld_id AS set_id, v.ld_id AS value_id, v.pref_label FROM provisional s JOIN provisional v ON s.entity = 'value_set' AND v.entity = 'value' AND url_decode(v.subclass_of) = s.ld_id", "provisional")
def p15_children_of_sets(spark, sf_dir):
    _, edges, provisional = _terms(spark, sf_dir)
    sets = provisional.where("entity = 'value_set'").select(F.col("ld_id").alias("set_id"), lookup.uri_key(F.col("ld_id")).alias("parent_key"))
    below = terms.all_edges(edges, provisional).select("parent_key", F.col("child_id").alias("value_id"))
    values = provisional.where("entity = 'value'").select(F.col("ld_id").alias("value_id"), "pref_label")
    return sets.join(below, "parent_key").join(values, "value_id").select("set_id", "value_id", "pref_label")


@query()
def q1_bulk_search(spark, sf_dir):
    """The whole bulk search over regular and provisional terms."""
    (requests,) = views(spark, sf_dir, "term_requests")
    found = terms.bulk_search(requests, store.names(spark, sf_dir), store.closure(spark, sf_dir))
    return found.withColumn("matched_synonyms", F.array_join("matched_synonyms", ","))


ORACLES["q1_bulk_search"] = with_views(
    TERMS + f""", sub AS (SELECT acronym, parent_id AS root_id, child_id AS node_id, 1 AS depth FROM edges UNION ALL SELECT e.acronym, e.parent_id, f.child_id, 2 FROM edges e JOIN edges f ON f.acronym = e.acronym AND f.parent_id = e.child_id),
    a AS (SELECT *, lower(trim(q)) AS t, regexp_split_to_array(lower(trim(q)), '[^\\p{{L}}\\p{{N}}]+') AS typed FROM term_requests),
    hits AS (SELECT a.*, x.*, CASE WHEN suggest OR contains(lower(pref_label), t) THEN 'prefLabel' WHEN contains(lower(synonym), t) THEN 'synonym' ELSE 'property' END AS match_type FROM a JOIN terms x
      ON CASE WHEN suggest THEN list_has_all(regexp_split_to_array(lower(pref_label), '[^\\p{{L}}\\p{{N}}]+'), typed[:-2]) AND len(list_filter(regexp_split_to_array(lower(pref_label), '[^\\p{{L}}\\p{{N}}]+'), lambda w: starts_with(w, typed[-1]))) > 0
         ELSE coalesce(contains(lower(pref_label), t), false) OR coalesce(contains(lower(synonym), t), false) OR coalesce(contains(lower(notation), t), false) END
      WHERE (scope = 'all' OR list_contains(string_split(scope, ','), CASE entity WHEN 'class' THEN 'classes' WHEN 'value' THEN 'values' ELSE 'value_sets' END))
        AND (subtree_root IS NULL OR EXISTS (SELECT 1 FROM sub WHERE sub.acronym = x.acronym AND root_id = subtree_root AND node_id = ld_id AND (max_depth = 0 OR depth <= max_depth)))),
    p AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS total, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN pref_label IS NULL THEN NULL WHEN contains(lower(pref_label), t) THEN 0 ELSE 1 END NULLS LAST, levenshtein(lower(pref_label), t) NULLS LAST, acronym, ord, ld_id) AS rn FROM hits),
    s AS (SELECT *, CASE WHEN (page - 1) * page_size < total THEN (page - 1) * page_size ELSE 0 END AS start FROM p)
    SELECT request_id, CAST(rn - start AS INT) AS pos, ld_id, {KIND} AS type, pref_label, match_type, CASE WHEN match_type = 'synonym' AND lower(synonym) <> lower(coalesce(pref_label, '')) THEN synonym ELSE '' END AS matched_synonyms, is_provisional, total
    FROM s WHERE rn > start AND rn <= start + page_size AND pref_label IS NOT NULL""", *BASES, "term_requests")




@query(
    ASKED_SETS.replace("FROM set_requests r", "FROM few r").replace("sets AS (", "few AS (SELECT min(request_id) AS request_id, acronym, vs_id, CASE WHEN acronym = 'VSW' THEN 'Term' ELSE 'Widget' END AS q, 1 AS page, 4 AS page_size FROM set_requests GROUP BY acronym, vs_id), sets AS (", 1) + """,
    links AS (SELECT acronym, child_id, parent_id, ord FROM edges UNION ALL SELECT acronym, ld_id, url_decode(subclass_of), ord FROM provisional WHERE subclass_of IS NOT NULL),
    hits AS (SELECT k.request_id, k.q, k.page, k.page_size, k.origin, v.ld_id, v.pref_label, l.ord FROM known k JOIN links l ON l.acronym = k.acronym AND l.parent_id = k.set_id JOIN terms v ON v.entity = 'value' AND v.acronym = l.acronym AND v.ld_id = l.child_id WHERE contains(lower(v.pref_label), lower(q))),
    p AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS total, row_number() OVER (PARTITION BY request_id ORDER BY levenshtein(lower(pref_label), lower(q)), ord, ld_id) AS rn FROM hits)
    SELECT request_id, CAST(rn AS INT) AS pos, ld_id, pref_label, origin, total FROM p WHERE rn <= page_size""",
    *BASES, "set_requests",
)
def q3_search_in_sets(spark, sf_dir):
    """One request for each set that is asked for."""
    every, edges, provisional = _terms(spark, sf_dir)
    text = F.when(F.col("acronym") == "VSW", "Term").otherwise("Widget")
    (asked,) = views(spark, sf_dir, "set_requests")
    few = asked.groupBy("acronym", "vs_id").agg(F.min("request_id").alias("request_id")).withColumns({"q": text, "page": F.lit(1), "page_size": F.lit(4)})
    return terms.search_in_sets(few, every, terms.all_edges(edges, provisional))


@query("SELECT request_id, CAST(count(*) FILTER (source_type > 0) + max(CASE WHEN source_type = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_sources, count(*) FILTER (source_type > 0) + max(CASE WHEN source_type = 0 THEN 1 ELSE 0 END) > 1 AS many FROM sources GROUP BY request_id", "sources")
def c5_source_counts(spark, sf_dir):
    return terms.source_counts(*views(spark, sf_dir, "sources"))


@query()
def c6_single_source(spark, sf_dir):
    """Every source of every request as a request of its own; all enumerated classes are one source."""
    requests, rows = _sources(spark, sf_dir)
    own = F.col("request_id") * 10 + F.col("source_type")
    kinds = rows.select("request_id", "source_type").distinct()
    asked = requests.join(kinds, "request_id").withColumn("request_id", own).drop("source_type")
    return search.single_source(asked, rows.withColumn("request_id", own))


ORACLES["c6_single_source"] = recursive(
    ROWS + """, one AS (SELECT r.request_id * 10 + source_type AS request_id, source_type, ld_id, pref_label, ord, page, page_size, nullif(input_text, '') AS t FROM r JOIN requests q ON q.request_id = r.request_id WHERE input_text = '' OR contains(lower(pref_label), lower(input_text))),
    p AS (SELECT *, count(*) OVER w AS total, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN t IS NULL THEN 0 ELSE levenshtein(lower(pref_label), lower(t)) END, CASE WHEN t IS NULL AND source_type = 0 THEN lower(pref_label) END NULLS LAST, ord, ld_id) AS rn FROM one WINDOW w AS (PARTITION BY request_id)),
    g AS (SELECT *, CASE WHEN (t IS NULL AND source_type IN (1, 2)) OR (page - 1) * page_size >= total THEN 1 ELSE page END AS pg, t IS NULL AND source_type > 0 AS sorted FROM p),
    s AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN sorted THEN lower(pref_label) END, rn) AS place FROM g WHERE rn > (pg - 1) * page_size AND rn <= pg * page_size)
    SELECT request_id, CAST(place AS INT) AS pos, source_type, ld_id, pref_label, total, pg AS page, CASE WHEN sorted THEN 1 ELSE CAST(ceil(total / page_size) AS BIGINT) END AS page_count, CASE WHEN NOT sorted AND pg * page_size <= total THEN pg + 1 END AS next_page FROM s""", *NAMES)


@query(TERMS + """, kinds AS (SELECT acronym, bool_and(is_provisional) AS only_new FROM terms GROUP BY acronym)
    SELECT acronym, ld_id, pref_label, false AS has_children FROM terms JOIN kinds USING (acronym) WHERE only_new AND entity = 'class'
    UNION ALL SELECT t.acronym, t.ld_id, pref_label, EXISTS (SELECT 1 FROM edges e WHERE e.acronym = t.acronym AND e.parent_id = t.ld_id) FROM terms t JOIN kinds USING (acronym) JOIN ontologies o USING (acronym)
      WHERE NOT only_new AND NOT is_provisional AND NOT is_flat AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.acronym = t.acronym AND e.child_id = t.ld_id)""", *BASES, "ontologies")
def h1_provisional_roots(spark, sf_dir):
    every, edges, _ = _terms(spark, sf_dir)
    return hierarchy.provisional_roots(every, edges, *views(spark, sf_dir, "ontologies"))


@query("""WITH p AS (SELECT acronym, parent_id AS ld_id, child_id, row_number() OVER (PARTITION BY acronym, parent_id ORDER BY ord, child_id) AS rn, count(*) OVER (PARTITION BY acronym, parent_id) AS total FROM edges)
    SELECT acronym, ld_id, CAST(rn - start AS INT) AS pos, child_id, total FROM (SELECT *, CASE WHEN 3 < total THEN 3 ELSE 0 END AS start FROM p) WHERE rn > start AND rn <= start + 3""", "edges")
def h2_children_page(spark, sf_dir):
    """The second page of three children of each node; a page past the end is the first."""
    concepts, edges = views(spark, sf_dir, "concepts", "edges")
    below = hierarchy.children(concepts.select("acronym", "ld_id"), edges)
    return paging.page_within(below, ["acronym", "ld_id"], ["ord", "child_id"], 2, 3).select("acronym", "ld_id", "pos", "child_id", "total")


@query()
def h4_descendants_page(spark, sf_dir):
    """The first page of four descendants of the roots of branches that requests name."""
    sources, edges = views(spark, sf_dir, "sources", "edges")
    asked = sources.where("source_type > 1").select("acronym", F.col("uri").alias("root_id")).distinct()
    below = hierarchy.descendants(edges, asked=asked)
    return paging.page_within(below, ["acronym", "root_id"], ["depth", "node_id"], 1, 4).select("acronym", "root_id", "pos", "node_id", "depth", "total")


ORACLES["h4_descendants_page"] = with_views(
    """WITH sub AS (SELECT acronym, parent_id AS root_id, child_id AS node_id, 1 AS depth FROM edges UNION ALL SELECT e.acronym, e.parent_id, f.child_id, 2 FROM edges e JOIN edges f ON f.acronym = e.acronym AND f.parent_id = e.child_id),
    p AS (SELECT sub.*, row_number() OVER (PARTITION BY acronym, root_id ORDER BY depth, node_id) AS pos, count(*) OVER (PARTITION BY acronym, root_id) AS total FROM sub WHERE (acronym, root_id) IN (SELECT (acronym, uri) FROM sources WHERE source_type > 1))
    SELECT acronym, root_id, CAST(pos AS INT) AS pos, node_id, depth, total FROM p WHERE pos <= 4""", "sources", "edges")


@query("""WITH tops AS (SELECT DISTINCT acronym, parent_id AS ld_id FROM property_edges p WHERE NOT EXISTS (SELECT 1 FROM property_edges q WHERE q.acronym = p.acronym AND q.child_id = p.parent_id))
    SELECT 'root' AS kind, acronym, ld_id, CAST(NULL AS VARCHAR) AS other_id FROM tops UNION ALL SELECT 'child', acronym, parent_id, child_id FROM property_edges UNION ALL SELECT 'parent', acronym, child_id, parent_id FROM property_edges""", "property_edges")
def h6_property_neighbours(spark, sf_dir):
    """Roots, children and parents of all properties, in one table by kind."""
    (edges,) = views(spark, sf_dir, "property_edges")
    nodes = edges.select("acronym", F.col("parent_id").alias("ld_id")).union(edges.select("acronym", "child_id")).distinct()
    tops = hierarchy.roots(nodes, edges, nodes.select("acronym", F.lit(False).alias("is_flat")).distinct())
    down, up = hierarchy.children(nodes, edges), hierarchy.parents(nodes, edges)
    none = F.lit(None).cast("string").alias("other_id")
    found = tops.select(F.lit("root").alias("kind"), "acronym", "ld_id", none).unionByName(down.select(F.lit("child").alias("kind"), "acronym", "ld_id", F.col("child_id").alias("other_id")))
    return found.unionByName(up.select(F.lit("parent").alias("kind"), "acronym", "ld_id", F.col("parent_id").alias("other_id")))


@query(f"WITH v AS ({FIRST_VALUES}) SELECT v.value_id, o.parent_id AS set_id, s.child_id AS node_id, s.child_id = v.value_id AS on_path FROM v JOIN edges o ON o.acronym = v.acronym AND o.child_id = v.value_id JOIN edges s ON s.acronym = o.acronym AND s.parent_id = o.parent_id", "edges")
def h8_value_tree(spark, sf_dir):
    (edges,) = views(spark, sf_dir, "edges")
    return hierarchy.value_tree(_first_values(edges), edges)


@query(
    """SELECT ld_id, CASE WHEN entity <> 'class' AND ord % 3 = 1 THEN 'collection' WHEN entity = 'value' AND subclass_of IS NULL THEN 'vs_id' WHEN entity = 'value' AND ord % 7 = 0 THEN 'vs_id' END AS rejected FROM provisional""",
    "provisional",
)
def v4_creation_rules(spark, sf_dir):
    """Created sets and values in a collection that cannot be written, and values without a set, are rejected."""
    (made,) = views(spark, sf_dir, "provisional")
    feed = made.select("ld_id", F.lit("create").alias("op"), "entity", F.when(F.col("ord") % 3 == 1, "VSN").when(F.col("ord") % 3 == 2, f"{BASE}/VSW").otherwise("VSW").alias("collection"), F.when(F.col("ord") % 7 != 0, F.col("subclass_of")).alias("vs_id"))
    return validate.creations(feed, WRITE, BASE).select("ld_id", "rejected")


@query("SELECT event_id AS request_id, event_type NOT IN ('click', 'error') AS valid FROM events")
def v5_scope_words(spark, sf_dir):
    """A scope of the word all and the event's type, where view, signup and purchase stand for words that are known."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    word = F.when(F.col("event_type").isin("click", "error"), F.col("event_type")).otherwise("values")
    return events.select(F.col("event_id").alias("request_id"), validate.valid_scope(F.array(F.lit("all"), word)).alias("valid"))


@query(f"SELECT concat('{BASE}/provisional_classes/', seq) AS ld_id, CAST(seq AS VARCHAR) AS short_id, ts AS created, 'NEW' AS acronym, label AS pref_label, concat('ontologies/NEW/classes/', seq) AS path FROM change_feed WHERE op = 'create'", "change_feed")
def m1_created_terms(spark, sf_dir):
    (feed,) = views(spark, sf_dir, "change_feed")
    return terms.create(feed.where("op = 'create'").withColumn("acronym", F.lit("NEW")), BASE)


@query(f"SELECT ld_id, source_class_id, target_class_id FROM relations WHERE source_class_id NOT IN (SELECT concat('{BASE}/PART/part#P', user_id) FROM events WHERE event_type = 'error')", "relations")
def m3_relations_after_deletes(spark, sf_dir):
    relations, feed = views(spark, sf_dir, "relations", "change_feed")
    gone = feed.where("op = 'delete'").select(F.concat(F.lit(f"{BASE}/PART/part#P"), "term_key").alias("ld_id"))
    return terms.drop_relations(relations, gone).select("ld_id", "source_class_id", "target_class_id")


CATALOG = TERMS + " SELECT t.acronym, t.ld_id, pref_label, o.ord AS collection_ord, t.ord FROM terms t JOIN ontologies o ON o.acronym = t.acronym WHERE entity = 'value_set'"


@query(CATALOG, *BASES, "ontologies")
def s9_snapshot(spark, sf_dir):
    """The catalog of value sets, written by collection and read back."""
    (ontologies,) = views(spark, sf_dir, "ontologies")
    catalog, folder = lookup.all_value_sets(_terms(spark, sf_dir)[0], ontologies), shared_folder(spark)
    catalog.write.mode("overwrite").partitionBy("acronym").parquet(folder)
    return spark.read.schema(catalog.schema).parquet(folder).select(*catalog.columns)


def _catalog(spark, sf_dir, to_feed):
    """The regular value sets, and those of VSW as a stream of orders in files keeps them: acronym, ld_id, pref_label,
    collection_ord, ord."""
    (ontologies,) = views(spark, sf_dir, "ontologies")
    orders, files = spark.read.parquet(f"{sf_dir}/orders.parquet"), shared_folder(spark)
    orders.repartition(6, "o_orderkey").write.parquet(files)
    made = refresh_catalog(spark, files, orders.schema, to_feed, shared_folder(spark), files_per_batch=2)
    regular = lookup.all_value_sets(_terms(spark, sf_dir)[0].where("NOT is_provisional"), ontologies)
    place = ontologies.where("acronym = 'VSW'").select("acronym", F.col("ord").alias("collection_ord"))
    return regular.unionByName(made.withColumn("acronym", F.lit("VSW")).join(place, "acronym").select(*regular.columns))


def _set_feed(orders, op, label):
    """Changes to the provisional sets, ten orders each, by order key; the rest of the orders change nothing."""
    k = F.col("o_orderkey")
    key = F.concat(F.lit(f"{BASE}/provisional_classes/S"), k - k % 10)
    none = F.lit(None).cast("double").alias("weight")
    return orders.select(key.alias("term_key"), F.timestamp_seconds(k).alias("ts"), k.alias("seq"), op.alias("op"), label.alias("label"), none).where("op IS NOT NULL")


@query(CATALOG, *BASES, "ontologies")
def m6_catalog_refresh(spark, sf_dir):
    """M6: created sets arrive as a stream of files; the catalog is kept from the rows of each batch."""
    k = F.col("o_orderkey")
    label = F.concat(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)), F.lit(" term "), k)
    return _catalog(spark, sf_dir, lambda orders: _set_feed(orders, F.when(k % 10 == 0, "create"), label))


@query(
    TERMS
    + f""", c AS (SELECT o_orderkey - o_orderkey % 10 AS k, o_orderkey AS seq, CASE WHEN o_orderkey % 10 = 0 THEN 'create' WHEN o_orderkey % 10 = 3 THEN 'update' WHEN o_orderkey % 10 = 7 AND o_orderkey // 10 % 3 = 0 THEN 'delete' WHEN o_orderkey % 10 = 9 AND o_orderkey // 10 % 2 = 0 THEN 'create' END AS op FROM orders),
    since AS (SELECT k, max(seq) AS ord FROM c WHERE op IN ('create', 'delete') GROUP BY k),
    now AS (SELECT k, s.ord, max(seq) AS last, arg_max(op, seq) AS op FROM c JOIN since s USING (k) WHERE op IS NOT NULL AND seq >= s.ord GROUP BY k, s.ord)
    SELECT t.acronym, t.ld_id, pref_label, o.ord AS collection_ord, t.ord FROM terms t JOIN ontologies o ON o.acronym = t.acronym WHERE entity = 'value_set' AND NOT is_provisional
    UNION ALL SELECT 'VSW', concat('{BASE}/provisional_classes/S', k), concat(op, ' ', last), (SELECT ord FROM ontologies WHERE acronym = 'VSW'), ord FROM now WHERE op <> 'delete'""",
    *BASES, "ontologies",
)
def m6_catalog_changes(spark, sf_dir):
    """Sets are created, renamed, deleted and created again, in three batches whose order is not that of the changes."""
    k = F.col("o_orderkey")
    digit, group = k % 10, F.floor(k / 10)
    op = F.when(digit == 0, "create").when(digit == 3, "update").when((digit == 7) & (group % 3 == 0), "delete").when((digit == 9) & (group % 2 == 0), "create")
    return _catalog(spark, sf_dir, lambda orders: _set_feed(orders, op, F.concat(op, F.lit(" "), k)))


@query("SELECT acronym, ld_id, coalesce(nullif(pref_label, ''), label) AS pref_label, coalesce(definition, '') AS definitions FROM properties", "properties")
def s3_property_documents(spark, sf_dir):
    """The properties as JSON documents, written and read back."""
    (found,) = views(spark, sf_dir, "properties")
    folder = shared_folder(spark)
    body = found.select("acronym", F.col("ld_id").alias("@id"), F.lit("http://www.w3.org/2002/07/owl#ObjectProperty").alias("@type"), F.col("pref_label").alias("prefLabel"), F.array("label").alias("label"), F.when(F.col("definition").isNotNull(), F.array("definition")).alias("definition"))
    body.write.json(folder)
    return documents.properties(spark, folder).select("acronym", "ld_id", "pref_label", F.array_join("definitions", ",").alias("definitions"))


@query("SELECT ld_id, pref_label, creator, acronym AS ontology, subclass_of, coalesce(definition, '') AS definitions, coalesce(synonym, '') AS synonyms FROM provisional", "provisional")
def s4_provisional_documents(spark, sf_dir):
    """Provisional terms as page envelopes of a hundred orders each, written as JSON and read back."""
    (made,) = views(spark, sf_dir, "provisional")
    folder = shared_folder(spark)
    one = F.struct(F.col("ld_id").alias("@id"), F.col("pref_label").alias("label"), "creator", F.col("acronym").alias("ontology"), F.col("subclass_of").alias("subclassOf"), F.array_compact(F.array("definition")).alias("definition"), F.array_compact(F.array("synonym")).alias("synonym"))
    made.groupBy(F.expr("ord div 100").alias("page")).agg(F.collect_list(one).alias("collection")).write.json(folder)
    found = documents.provisional_classes(spark, folder, None)
    return found.select("ld_id", "pref_label", "creator", "ontology", "subclass_of", F.array_join("definitions", ",").alias("definitions"), F.array_join("synonyms", ",").alias("synonyms"))


@query(ORACLES["l15_ontology_details"])
def s5_detail_documents(spark, sf_dir):
    """Metrics, categories and submissions as JSON documents, written, read back and joined."""
    ontologies, concepts = views(spark, sf_dir, "ontologies", "concepts")
    folder = shared_folder(spark)
    concepts.where("acronym <> 'FLAT'").groupBy("acronym").agg(F.count("*").alias("classes")).write.json(f"{folder}/metrics")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("GEO").alias("acronym"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord")).write.json(f"{folder}/categories")
    ontologies.where("acronym <> 'VSA'").select("acronym", F.current_date().cast("string").alias("creationDate")).write.json(f"{folder}/submissions")
    return lookup.details(ontologies, *documents.details(spark, f"{folder}/metrics", f"{folder}/categories", f"{folder}/submissions"))


_DETAILED = """SELECT o.acronym, o.name, CAST(coalesce(m.n, 0) AS BIGINT) AS classes, CASE WHEN o.acronym = 'GEO' THEN (SELECT string_agg(n_name, ',' ORDER BY n_nationkey) FROM nation) END AS categories, m.n IS NOT NULL AS has_submissions, o.ontology_type = 'VALUE_SET_COLLECTION' AS is_collection
    FROM ontologies o LEFT JOIN (SELECT acronym, count(*) AS n FROM concepts GROUP BY acronym) m USING (acronym)"""


@query(_DETAILED.replace("o.ontology_type = 'VALUE_SET_COLLECTION'", "coalesce(o.ontology_type = 'VALUE_SET_COLLECTION', false)"), "ontologies", "concepts")
def l16_catalog_details(spark, sf_dir):
    """Every ontology and collection with its details."""
    ontologies, concepts = views(spark, sf_dir, "ontologies", "concepts")
    metrics = concepts.groupBy("acronym").agg(F.count("*").alias("classes"))
    categories = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("GEO").alias("acronym"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    found = lookup.details(ontologies, metrics, categories, metrics.select("acronym"))
    return ontologies.join(found, "acronym").select("acronym", "name", "classes", "categories", "has_submissions", F.coalesce(F.col("ontology_type") == "VALUE_SET_COLLECTION", F.lit(False)).alias("is_collection"))
