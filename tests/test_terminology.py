"""Operators on small literal tables, the list model of arrangements, and every query against its SQL."""

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from termspark import functions as X
from termspark.operators import hierarchy, paging, search, validate
from termspark.plans import ORACLES, QUERIES
from termspark.sources import TABLES, documents
from termspark.streaming import latest_state

SF = "/root/testdata/sf0.001"
TERMS = [(1, "cutaneous mycosis"), (2, "chromosomal disease"), (3, "benign neoplasm")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain(values):
    norm = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(norm(v) for v in r) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF).toPandas()
    wanted = con.sql(ORACLES[name]).df()
    cols = sorted(found.columns)
    assert cols == sorted(wanted.columns)
    assert plain(found[cols].astype(object).values.tolist()) == plain(wanted[cols].astype(object).values.tolist())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_identifiers(spark):
    values = ["http://a/b#c", "http://a/b/", "obo:X_1", "HTTPS://a b", None, "x/y", "http%3A%2F%2Fa", "50% off"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [tuple(r) for r in df.select(X.is_url(F.col("x")), X.short_id(F.col("x")), X.uri_key(F.col("x"))).collect()]
    assert [g[0] for g in got] == [True, True, False, True, False, False, False, False]
    assert [g[1] for g in got] == ["c", "", "obo:X_1", "a b", None, "x/y", "http%3A%2F%2Fa", "50% off"]
    assert got[0][2] == "http%3A%2F%2Fa%2Fb%23c" and got[6][2] == "http%3A%2F%2Fa"


def _requests(spark, text, page, size):
    return spark.createDataFrame([(7, text, page, size)], "request_id int, input_text string, page int, page_size int")


def _terms(spark):
    return spark.createDataFrame([(7, 0, i, f"t{i}", label, i) for i, label in TERMS], "request_id int, source_type int, source_idx int, ld_id string, pref_label string, ord long")


def test_enumerated_classes_by_label_and_text(spark):
    found = search.integrated_search(_requests(spark, " ", 1, 10), _terms(spark)).orderBy("pos").collect()
    assert [r.pref_label for r in found] == ["benign neoplasm", "chromosomal disease", "cutaneous mycosis"]
    found = search.integrated_search(_requests(spark, "Mycosis", 1, 10), _terms(spark)).collect()
    assert [(r.pref_label, r.total) for r in found] == [("cutaneous mycosis", 1)]
    assert search.integrated_search(_requests(spark, "aaabbbcccddd", 1, 10), _terms(spark)).count() == 0


def test_two_pages(spark):
    total = spark.createDataFrame([(7, 3)], "request_id int, total long")
    first = paging.envelope(_requests(spark, None, 1, 2), total).first()
    second = paging.envelope(_requests(spark, None, 2, 2), total).first()
    assert (first.page, first.page_count, first.page_size, first.prev_page, first.next_page) == (1, 2, 2, None, 2)
    assert (second.page, second.page_size, second.prev_page, second.next_page) == (2, 1, 1, None)
    pages = [search.integrated_retrieve(_requests(spark, None, p, 2), _terms(spark)).orderBy("pos").collect() for p in (1, 2)]
    assert [r.ld_id for p in pages for r in p] == ["t1", "t2", "t3"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=12))
def test_closure_on_random_graphs(spark, pairs):
    edges = spark.createDataFrame([("A", f"n{c}", f"n{p}", 0) for c, p in pairs], "acronym string, child_id string, parent_id string, ord long")
    reach = {(p, c) for c, p in pairs}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    got = {(r.root_id, r.node_id) for r in hierarchy.descendants(edges).collect()}
    assert got == {(f"n{a}", f"n{b}") for a, b in reach if a != b}


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 6), st.lists(st.tuples(st.integers(1, 9), st.one_of(st.none(), st.integers(0, 7))), max_size=5, unique_by=(lambda a: a[0], lambda a: a[1] if a[1] is not None else a)))
def test_actions_equal_a_list(spark, size, acts):
    results = spark.createDataFrame([(1, i, f"t{i}", f"L{i}") for i in range(1, size + 1)], "request_id int, pos int, ld_id string, pref_label string")
    actions = spark.createDataFrame([(1, "delete" if at is None else "move", f"t{t}", at) for t, at in acts], "request_id int, action string, term_uri string, position int")
    terms = spark.createDataFrame([(f"t{i}", f"L{i}") for i in range(1, 10)], "ld_id string, pref_label string")
    want = [f"t{i}" for i in range(1, size + 1) if i not in {t for t, _ in acts}]
    for at, t in sorted((at, t) for t, at in acts if at is not None):
        if at < len(want):
            want.insert(at, f"t{t}")
    got = search.apply_actions(results, actions, terms).orderBy("pos").collect()
    assert [r.ld_id for r in got] == want[:size]


def test_latest_state_revives_after_delete(spark):
    feed = spark.createDataFrame([(1, 1, 1, "create", "a", 1.0), (1, 2, 2, "delete", None, None), (1, 3, 3, "create", "b", None), (2, 1, 4, "create", "c", 2.0), (2, 2, 5, "update", None, 3.0), (3, 1, 6, "delete", None, None)], "term_key int, ts int, seq int, op string, label string, weight double")
    assert rows(latest_state(feed)) == [(1, "b", None, 3), (2, "c", 3.0, 5)]


def test_documents(spark, tmp_path):
    (tmp_path / "o.json").write_text('[{"acronym": "A", "@id": "http://x/A", "name": "a", "flat": true}, {"acronym": "B", "@id": "http://x/B", "more": 1}]')
    assert rows(documents.ontologies(spark, str(tmp_path / "o.json")).select("acronym", "is_flat", "ord")) == [("A", True, 0), ("B", False, 1)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text('{"acronym": "A", "page": 2, "collection": [{"@id": "c3"}]}\n{"acronym": "A", "page": 1, "collection": [{"@id": "c1", "synonym": ["s"]}, {"@id": "c2"}]}')
    assert [r.ld_id for r in documents.class_pages(spark, str(tmp_path / "p")).orderBy("ord").collect()] == ["c1", "c2", "c3"]
    trees = spark.createDataFrame([(1, '{"@id":"a","children":[{"@id":"b","children":[]},{"@id":"c","children":[{"@id":"d"}]}]}'), (2, '{"@id":"z"}')], "doc_id long, body string")
    assert rows(documents.flatten_trees(trees).select("doc_id", F.coalesce("parent_id", F.lit("-")), "node_id", "depth")) == [(1, "-", "a", 0), (1, "a", "b", 1), (1, "a", "c", 1), (1, "c", "d", 2), (2, "-", "z", 0)]


def test_requests_are_checked(spark):
    good = '{"parameterObject":{"valueConstraints":{"ontologies":[],"branches":[],"valueSets":[%s],"classes":[%s],"actions":[%s]}}}'
    bodies = ["{}", None, "no json", good % ("", "", ""), good % ('{"uri":"u","vsCollection":"ZZ"}', "", ""), good % ("", '{"uri":"u","prefLabel":"p","type":"t","source":"s","odd":1}', ""), good % ("", "", '{"action":"move","termUri":"t","type":"x","source":"s"}')]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string")
    got = {r.request_id: (r.status, r.violations) for r in validate.check_requests(df, ["VSA"]).collect()}
    assert [got[i][0] for i in range(7)] == [422, 400, 400, 200, 422, 400, 422]
    assert got[0][1] == ["parameterObject"] and got[4][1] == ["valueSets.vsCollection"] and got[6][1] == ["actions.to"]
