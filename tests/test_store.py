"""The stored index, numbers, closure and streams against plain versions, with changes, restarts and repeated batches."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from termspark import plans
from termspark.operators import hierarchy, index, integrated, ordinals, paging, search, terms
from termspark.plans import store
from termspark.sources import cut, discard
from termspark.streaming import latest_state, stream_state

WORDS = ["Red", "ring", "reddish", "É", "blood", "cell", "b", "x-ray", "Brand#1", "12"]
TERM = "acronym string, ld_id string, entity string, pref_label string, synonyms array<string>, properties map<string,array<string>>, ord long, is_provisional boolean"


def _term(rng, i, acronym="A"):
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    label = None if rng.random() < 0.1 else text(rng.randint(1, 3))
    synonyms = None if rng.random() < 0.2 else [text(rng.randint(1, 2)) for _ in range(rng.randint(0, 2))] + [None] * (rng.random() < 0.1)
    properties = None if rng.random() < 0.3 else {"p": [text(1)], "q": []}
    return (acronym, f"t{i}", "class", label, synonyms, properties, i, False)


def _plain(rows, text, ahead):
    words = lambda t: re.split(r"[^\w]+", t)

    def hit(name):
        if not ahead:
            return text in name
        *first, last = words(text)
        return set(first) <= set(words(name)) and any(w.startswith(last) for w in words(name))

    out = set()
    for acronym, ld_id, _, label, synonyms, properties, *_ in rows:
        kinds = {"prefLabel": [label], "synonym": synonyms or [], "property": [v for vs in (properties or {}).values() for v in vs]}
        kind = next((k for k, names in kinds.items() if any(n is not None and hit(n.lower()) for n in names)), None)
        if kind:
            out.add((text, ahead, acronym, ld_id, kind))
    return out


TEXTS = [(t, a) for t in ("red", "re", "r", "red ri", "ring b", "é", "brand#1", "cell blood", "zzz", "12", "x-r") for a in (False, True)]


def _found(spark, now):
    texts = spark.createDataFrame(TEXTS, "text string, ahead boolean")
    return {(r.text, r.ahead, r.acronym, r.ld_id, r.match_type) for r in index.matches(now, texts).collect()}


def test_index_finds_what_a_scan_finds_through_changes(spark):
    rng = random.Random(4)
    rows = {i: _term(rng, i) for i in range(120)}
    now = index.build(spark.createDataFrame(list(rows.values()), TERM))
    want = lambda: set().union(*(_plain(rows.values(), t, a) for t, a in TEXTS))
    assert _found(spark, now) == want()
    for begin in (100, 110):
        new = {i: _term(rng, i) for i in range(begin, begin + 25)}
        gone = [i for i in range(begin - 60, begin - 40)]
        rows = {i: r for i, r in (rows | new).items() if i not in gone}
        now = index.changed(now, spark.createDataFrame(list(new.values()), TERM), spark.createDataFrame([("A", f"t{i}") for i in gone], "acronym string, ld_id string"))
        assert _found(spark, now) == want()
    assert {r.ld_id for r in now.terms().collect()} == {f"t{i}" for i in rows} and _found(spark, index.compact(now)) == want()


@pytest.mark.parametrize("few", [0, 100])
def test_names_are_found_through_changes(spark, monkeypatch, few):
    """Names take what an index takes: terms that come, are replaced, go and come back, in two rounds; the base stays."""
    monkeypatch.setattr(index, "FEW_TEXTS", few, raising=False)
    rng = random.Random(6)
    rows = {i: _term(rng, i) for i in range(120)}
    now = base = index.Names(cut(spark.createDataFrame(list(rows.values()), TERM)))
    for begin in (100, 110):
        new = {i: _term(rng, i) for i in [*range(begin, begin + 25), 45]}
        gone = range(begin - 60, begin - 45)
        rows = {i: r for i, r in (rows | {i: r for i, r in new.items() if i != 45}).items() if i not in gone} | {45: new[45]}
        now = index.changed(now, spark.createDataFrame(list(new.values()), TERM), spark.createDataFrame([("A", f"t{i}") for i in gone], "acronym string, ld_id string"))
        assert _found(spark, now) == set().union(*(_plain(rows.values(), t, a) for t, a in TEXTS)) and now.table is base.table
    assert {r.ld_id for r in now.terms().collect()} == {f"t{i}" for i in rows}


def test_changed_terms_are_found_without_an_index(spark, monkeypatch):
    monkeypatch.setattr(index, "build", lambda *_: pytest.fail("an index is made"))
    monkeypatch.setattr(store, "_KEPT", {})
    assert plans.QUERIES["m7_read_your_writes"](spark, "/root/testdata/sf0.001").count() > 0


def test_a_search_moves_requests_and_not_the_index(spark):
    now = index.build(spark.createDataFrame([_term(random.Random(i), i) for i in range(50)], TERM))
    texts = cut(spark.createDataFrame(TEXTS, "text string, ahead boolean"))
    plan = index.candidates(now, texts).hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") >= 1 or "BroadcastHashJoin" in plan


def test_numbers_within_sources(spark):
    rows = [(1, "A", "", f"t{i:04}", i % 7) for i in range(500)] + [(2, "A", f"u{i % 9}", f"t{i:04}", i) for i in range(90)]
    df = spark.createDataFrame(rows, "source_type int, acronym string, uri string, ld_id string, ord long")
    placed, totals = ordinals.numbered(df, ordinals.SOURCE, ["ord", "ld_id"])
    got = {(r.source_type, r.uri, r.nth): r.ld_id for r in placed.collect()}
    want = {}
    for source in {r[:3] for r in rows}:
        for nth, r in enumerate(sorted((r for r in rows if r[:3] == source), key=lambda r: (r[4], r[3]))):
            want[source[0], source[2], nth] = r[3]
    assert got == want and {(r.source_type, r.uri): r.total for r in totals.collect()} == {(1, ""): 500} | {(2, f"u{i}"): 10 for i in range(9)}


def test_pages_of_sources_laid_end_to_end(spark):
    own = [(1, "A", "", f"a{i}", f"A {i}", i) for i in range(5)] + [(3, "S", "s", f"s{i}", None, i) for i in range(3)]
    stored = ordinals.ordinals(spark.createDataFrame(own, "source_type int, acronym string, uri string, ld_id string, pref_label string, ord long"), ["ord", "ld_id"])
    sources = [(k, 0, i, "A", f"c{i}", f"C {i}") for k in range(9) for i in range(2)] + [(k, 1, 0, "A", None, None) for k in range(9)]
    sources += [(k, 2, 0, "A", "nowhere", None) for k in range(9)] + [(k, 3, 0, "S", "s", None) for k in range(9)]
    asked = [(k, k, 3) for k in range(1, 5)] + [(5, 1, 100), (6, 2, 9), (7, 9, 9), (8, 1, 1)]
    requests = spark.createDataFrame(asked, "request_id int, page int, page_size int")
    shown = ordinals.retrieve_pages(requests, spark.createDataFrame(sources, "request_id int, source_type int, source_idx int, acronym string, uri string, label string"), stored)
    whole = ["c0", "c1", *[f"a{i}" for i in range(5)], *[f"s{i}" for i in range(3)]]
    got = {}
    for r in shown.orderBy("request_id", "pos").collect():
        got.setdefault(r.request_id, []).append(r.ld_id)
    want = {}
    for k, page, size in asked:
        start = (page - 1) * size if (page - 1) * size < len(whole) else 0
        want[k] = whole[start : start + size]
    assert got == want


def _reach(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in out if b == c} - out:
        out |= more
    return {(a, b) for a, b in out if a != b}


def test_closure_after_changes_and_ways_up(spark):
    rng = random.Random(1)
    edge = lambda: (f"n{rng.randint(0, 7)}", f"n{rng.randint(0, 7)}")
    frame = lambda pairs: spark.createDataFrame([("A", c, p) for p, c in pairs], "acronym string, child_id string, parent_id string")
    edges = {edge() for _ in range(8)}
    stored = hierarchy.stored_closure(frame(edges))
    for _ in range(3):
        gone, came = set(rng.sample(sorted(edges), 2)), {edge() for _ in range(2)}
        edges = (edges - gone) | came
        stored = hierarchy.maintained(stored, frame(edges), frame(gone | came))
        assert {(r.root_id, r.node_id) for r in stored.collect()} == _reach(edges)
    stored = hierarchy.maintained(stored, frame(edges).where("false"), frame(edges))
    assert stored.count() == 0
    targets = spark.createDataFrame([("A", f"n{i}") for i in range(8)], "acronym string, target_id string")
    assert {(r.node_id, r.target_id) for r in hierarchy.ancestors(targets, frame(edges)).collect()} == _reach(edges)


FEED = "term_key long, ts long, seq long, op string, label string, weight double"


def test_stream_goes_on_after_a_restart_and_a_repeated_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randint(0, 30), rng.randint(0, 90), i, rng.choice(["create", "update", "update", "delete"]), rng.choice(["a", "b", None]), rng.choice([1.0, None])) for i in range(400)]
    files, folder = str(tmp_path / "files"), str(tmp_path / "state")
    own = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    schema = spark.createDataFrame([], FEED).schema
    for k in range(3):
        part = spark.createDataFrame(rows[: (k + 1) * 120][k * 120 :], FEED)
        part.repartition(3).write.mode("append").parquet(files)
        state = stream_state(spark, files, schema, lambda b: b, folder, files_per_batch=2)
        assert own(state) == own(latest_state(spark.createDataFrame(rows[: (k + 1) * 120], FEED)))
    batches = sorted(int(n) for n in os.listdir(f"{folder}/checkpoint/commits") if n.isdigit())
    assert len(batches) == 6 and len(os.listdir(f"{folder}/manifest")) <= 2 + 2
    for name in (str(batches[-1]), f".{batches[-1]}.crc"):  # as if the last batch had been lost before its commit
        if os.path.exists(f"{folder}/checkpoint/commits/{name}"):
            os.remove(f"{folder}/checkpoint/commits/{name}")
    again = stream_state(spark, files, schema, lambda b: b, folder, files_per_batch=2)
    assert own(again) == own(latest_state(spark.createDataFrame(rows[:360], FEED)))


def _store(spark):
    rows = [("O", f"o{i}", "class", f"term {i:02}", [f"alias {i}"], {"code": [f"k{i}"]}, i, False) for i in range(20)] + [("V", "http://x/V/s", "value_set", "set", [], {}, 0, False)]
    rows += [("V", f"http://x/V/v{i}", "value", f"value {i}", [], {}, i, False) for i in range(4)]
    every = spark.createDataFrame(rows, TERM)
    below = spark.createDataFrame([("O", "o0", f"o{i}") for i in range(1, 6)] + [("V", "http://x/V/s", f"http://x/V/v{i}") for i in range(4)], "acronym string, root_id string, node_id string")
    numbers = ordinals.ordinals(ordinals.source_list(every, below, (1, 2, 3, 4)), ["is_provisional", "ord", "ld_id"])
    return integrated.Store(index.build(every), numbers, below)


def test_whole_search_by_hand(spark):
    requests = [(1, "", 1, 3), (2, "al", 2, 3), (3, None, 5, 2), (4, "term", 1, 4), (5, "", 1, 10), (6, "value 1", 1, 9), (7, "zzz", 3, 2), (8, "Term 0", 1, 3), (9, " ", 2, 3)]
    sources = [(1, 1, 0, "O", None, None), (2, 1, 0, "O", None, None), (3, 2, 0, "O", "o0", None), (4, 2, 0, "O", "o0", None), (5, 0, 0, "O", "o3", "Bbb"), (5, 0, 1, "O", "o9", "aaa"), (5, 2, 0, "O", "o0", None)]
    sources += [(6, 3, 0, "V", "http://x/V/s", None), (7, 0, 0, "O", "o1", "x"), (8, 0, 0, "O", "e1", "term 0 enumerated"), (8, 1, 0, "O", None, None), (9, 3, 0, "V", "http://x/V/s", None)]
    actions = [(1, "delete", "o1", "OntologyClass", None), (1, "move", "o19", "OntologyClass", 0), (8, "move", "nowhere", "OntologyClass", 0), (8, "move", "o2", "Thing", 0)]
    found = integrated.whole_search(
        spark.createDataFrame(requests, "request_id int, input_text string, page int, page_size int"),
        spark.createDataFrame(sources, "request_id int, source_type int, source_idx int, acronym string, uri string, label string"),
        spark.createDataFrame(actions, "request_id int, action string, term_uri string, type string, position int"),
        _store(spark),
    )
    got = {}
    for r in found.orderBy("request_id", "pos").collect():
        got.setdefault((r.request_id, r.route, r.page, r.page_count, r.page_size, r.total_count, r.prev_page, r.next_page), []).append(r.ld_id)
    value = [f"http://x/V/v{i}" for i in range(4)]
    assert got == {
        (1, "ontology+actions", 1, None, 3, 19, None, None): ["o19", "o0", "o2"],
        (2, "ontology", 2, 7, 3, 20, 1, 3): ["o3", "o4", "o5"],
        (3, "branch", 1, 1, 2, 5, None, None): ["o1", "o2"],
        (4, "branch", 1, 2, 4, 5, None, 2): ["o1", "o2", "o3", "o4"],
        (5, "several", 1, None, 7, 7, None, None): ["o9", "o3", "o1", "o2", "o3", "o4", "o5"],
        (6, "value_set", 1, 1, 1, 1, None, None): [value[1]],
        (7, "classes", None, None, 0, 0, None, None): [None],
        (8, "several+actions", 1, None, 3, 11, None, None): ["o2", "o0", "o1"],  # what is on the page is found whatever its type
        (9, "value_set", 2, 1, 1, 4, None, None): [value[3]],
    }


def test_pages_rank_only_what_they_show(spark):
    rng = random.Random(2)
    hits = [(k, rng.choice(["red ring", "ring", "a red one", "blue", None]), i) for k in range(4) for i in range(30 * k)]
    requests = spark.createDataFrame([(k, "red", 1 + k % 3, 4) for k in range(5)], "request_id int, q string, page int, page_size int")
    df = cut(spark.createDataFrame(hits, "request_id int, pref_label string, ord int").join(requests, "request_id"))
    outside, near = paging.closest(F.col("pref_label"), F.col("q"))
    keys = [F.coalesce(outside, F.lit(2)), near.asc_nulls_last(), F.col("ord")]
    whole = paging.page_of(paging.ranked(df, keys).join(df.groupBy("request_id").agg(F.count("*").alias("total")), "request_id"))
    own = lambda d: sorted(map(str, d.select("request_id", "pos", "ord", "total").collect()))
    assert own(paging.first_pages(df, requests, keys)) == own(whole)
    near_all = df.where("pref_label IS NOT NULL").select(near.alias("near"), F.levenshtein(F.lower("pref_label"), F.lower("q")).alias("plain"))
    assert near_all.where("near <> plain").count() == 0


def test_unknown_sources(spark):
    asked = spark.createDataFrame([(1, ["A"]), (2, ["A", "N"]), (3, None), (4, []), (5, ["M", "N", "N"])], "request_id int, sources array<string>")
    got = terms.unknown_sources(asked, spark.createDataFrame([("A",)], "acronym string")).collect()
    assert sorted(map(tuple, got)) == [(2, ["N"]), (5, ["M", "N"])]


@pytest.mark.parametrize("empty", [True, False])
def test_an_index_without_terms(spark, empty):
    none = spark.createDataFrame([], TERM)
    now = index.build(none)
    assert _found(spark, now) == set()
    if not empty:
        now = index.changed(now, spark.createDataFrame([("A", "t", "class", "red", None, None, 0, True)], TERM), none.select("acronym", "ld_id"))
        assert {r[3] for r in _found(spark, now)} == {"t"}


def test_what_is_kept_is_made_again_if_it_is_gone(spark):
    sf_dir, made = "/root/testdata/sf0.001", []

    def make():
        made.append(index.build(spark.createDataFrame([_term(random.Random(1), 1)], TERM)))
        return made[-1]

    one = store.kept(spark, sf_dir, "test", make)
    assert store.kept(spark, sf_dir, "test", make) is one and len(store.written(one)) == 3
    discard(one.base.postings)
    assert store.kept(spark, sf_dir, "test", make) is not one and len(made) == 2


def test_rows_of_trees_are_not_shuffled(spark):
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges = spark.createDataFrame([("A", f"n{i}", f"n{i // 400}", i) for i in range(1, 400)], "acronym string, child_id string, parent_id string, ord long")
    tree = hierarchy.tree_to(edges.select("acronym", F.col("child_id").alias("target_id")), spark.createDataFrame([("A", "n0")], "acronym string, ld_id string"), edges)
    tracker = spark.sparkContext._jsc.sc().statusStore()
    before = _shuffled(spark, tracker)
    rows = tree.collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)
    assert len(rows) == 399 * 400 and sum(r.on_path for r in rows) == 2 * 399
    assert _shuffled(spark, tracker) - before < 20 * 400


def test_one_parents_rows_are_dealt(spark, monkeypatch):
    """A parent's children, as targets of trees with all of them, are the work of many tasks, also without broadcasts."""
    monkeypatch.setattr(hierarchy, "SHARE", 500, raising=False)
    monkeypatch.setattr(hierarchy, "LISTED", 16, raising=False)
    plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    edges = spark.createDataFrame([("A", f"n{i}", "n0", i) for i in range(1, 201)], "acronym string, child_id string, parent_id string, ord long")
    tree = hierarchy.tree_to(edges.select("acronym", F.col("child_id").alias("target_id")), spark.createDataFrame([("A", "n0")], "acronym string, ld_id string"), edges)
    held = [r["count"] for r in tree.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plain)
    assert sum(held) == 200 * 201 and max(held) < 10_000


def test_trees_of_odd_edges(spark, monkeypatch):
    """Several parents, cycles, repeated edges, a root and an empty id as targets, facts; roots and children in several lists."""
    monkeypatch.setattr(hierarchy, "LISTED", 2)
    monkeypatch.setattr(hierarchy, "SHARE", 3)
    edges = [("a", "r"), ("b", "r"), ("b", "r"), ("c", "a"), ("c", "b"), ("d", "c"), ("e", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("x", "x"), ("f", ""), ("", "r"), ("g", "r")]
    tops, targets = ["r", "s", "t"], ["c", "d", "r", "x", "f", "", "none", "c"]
    up = lambda n: {p for c, p in edges if c == n}
    want = []
    for t in set(targets):
        above, front = set(), {t}
        while front := {p for n in front for p in up(n)} - above - {t}:
            above |= front
        way = above | {t}
        want += [(t, None, n, n in way, n * 2) for n in tops] + [(t, p, n, n in way, n * 2) for n, p in edges if p in above]
    frame = spark.createDataFrame([("A", c, p) for c, p in edges] + [("B", "a", "c")], "acronym string, child_id string, parent_id string")
    asked = spark.createDataFrame([("A", t) for t in targets] + [("C", "a")], "acronym string, target_id string")
    facts = spark.createDataFrame([("A", n, n * 2) for n in {n for e in edges for n in e} | set(tops)], "acronym string, node_id string, twice string")
    got = hierarchy.tree_to(asked, spark.createDataFrame([("A", n) for n in tops] + [("B", "c")], "acronym string, ld_id string"), frame, facts).collect()
    assert sorted((tuple(r)[1:] for r in got), key=str) == sorted(want, key=str) and {r.acronym for r in got} == {"A"}


def _shuffled(spark, tracker):
    """Rows that all stages of the session have written to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = tracker.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["l9_value_pages", "l10_sibling_pages", "l11_collection_pages", "l13_class_pages", "c10_retrieve_slices", "h7_value_set_nodes"])
def test_pages_and_nodes_need_no_index(spark, monkeypatch, name):
    def build(*_):
        raise AssertionError("an index is built")

    monkeypatch.setattr(index, "build", build)
    monkeypatch.setattr(store, "_KEPT", {})
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_equal_searches_are_ranked_once(spark, monkeypatch):
    rng = random.Random(5)
    now = index.build(spark.createDataFrame([_term(rng, i) for i in range(60)], TERM))
    below = spark.createDataFrame([], hierarchy.CLOSURE)
    columns = "request_id int, q string, scope string, suggest boolean, subtree_root string, max_depth int, page int, page_size int, sources array<string>"
    asked = [(i, "Red" if i % 2 else " red", "all", False, None, 0, 1 + i % 3, 3, None if i % 5 else ["A"]) for i in range(40)]
    seen, plain = [], terms.first_ranked
    monkeypatch.setattr(terms, "first_ranked", lambda hits, *rest: seen.append(hits.count()) or plain(hits, *rest))
    own = lambda rows: sorted(map(str, terms.bulk_search(spark.createDataFrame(rows, columns), now, below).collect()))
    got = own(asked)
    few = own(asked[:10])
    assert seen[0] == seen[1] and few == [x for x in got if int(re.search(r"request_id=(\d+)", x)[1]) < 10]


def test_a_large_delta_has_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(index, "DELTA_ROWS", 10)
    now = index.build(spark.createDataFrame([_term(random.Random(i), i) for i in range(50)], TERM))
    none = spark.createDataFrame([], "acronym string, ld_id string")
    after = index.changed(now, spark.createDataFrame([_term(random.Random(i + 90), i) for i in range(40)], TERM), none)
    assert after.delta.terms.rdd.getNumPartitions() > 1 and after.delta.terms.select("no").distinct().count() == 40


@pytest.mark.parametrize("texts", [TEXTS, [t for t in TEXTS if t[1]], [("red", False)], [("-", True), ("zzz", False)]])
def test_a_scan_finds_what_an_index_finds_and_stores_no_pieces(spark, monkeypatch, texts):
    rng = random.Random(4)
    rows = [_term(rng, i) for i in range(120)] + [("A", "twice", "class", "red red ring", ["reddish ring", "red"], {"p": ["RED", None]}, 500, False), ("A", "bare", "class", None, None, None, 501, False)]
    table, asked = cut(spark.createDataFrame(rows, TERM)), spark.createDataFrame(texts, "text string, ahead boolean")
    want = sorted(tuple(map(str, r)) for r in index.matches(index.build(table), asked).select("text", "ahead", "match_type", *index.TERM).collect())
    look = lambda: sorted(tuple(map(str, r)) for r in index.matches(index.Names(table), asked).select("text", "ahead", "match_type", *index.TERM).collect())
    with monkeypatch.context() as m:
        m.setattr(index, "build", lambda *_: pytest.fail("an index was made"))
        assert look() == want
    monkeypatch.setattr(index, "HELD_BYTES", 0)
    assert look() == want


def test_sources_that_requests_share_are_numbered_once(spark, monkeypatch):
    concepts = spark.createDataFrame([("A", f"t{i:02}", f"term {i}", i % 5) for i in range(40)], "acronym string, ld_id string, pref_label string, ord long")
    closure = spark.createDataFrame([("A", "t00", f"t{i:02}") for i in range(1, 9)], "acronym string, root_id string, node_id string")
    asked = [(r, 1 + r % 3, 3 + r) for r in range(6)] + [(6, 50, 2), (7, 0, 0)]
    requests = spark.createDataFrame([(r, None, page, size) for r, page, size in asked], "request_id long, input_text string, page int, page_size int")
    listed = [(r, 0, 0, "A", "t99", "In no table") for r in range(0, 8, 2)] + [(r, 1, 0, "A", None, None) for r in range(8)] + [(r, 2, 1, "A", "t00", None) for r in range(0, 8, 3)]
    sources = spark.createDataFrame(listed, "request_id long, source_type int, source_idx int, acronym string, uri string, label string")
    counted, real = [], ordinals.numbered
    monkeypatch.setattr(ordinals, "numbered", lambda rows, *a: counted.append(rows.count()) or real(rows, *a))
    want = search.integrated_retrieve(requests, search.source_rows(requests, sources, concepts, closure))
    found = search.retrieved(requests, sources, concepts, closure)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(*found.columns).collect())) and counted == [48]
