"""License scans, source divergences and whitening against plain versions, on odd rows and on whole small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from termspark.llm import ann, bpe, divergence, langid, licenses, queries, secrets, substrings, whitening

SF = "/root/testdata/sf0.001"
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
ODD = "doc_id long, text string, lang string, source string, key string, words string, n int, term string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "k", "w", 1, "t") for r in rows], ODD)


LICENSED = [
    (1, "Released under the MIT License. mit license; MIT  LICENSE", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "Licensed under the Apache License, Version 2.0.", "en", "b"),
    (4, "Licensed under the Apache License, Version 2.0.", "en", "b"),
    (4, "cc-by nc", "en", "b"),
    (None, "gnu general public license gnu general public licence", None, "a"),
    (None, "GNU GENERAL public license\n" * 3 + "cc by" * 2, None, "a"),
    (7, GRANT, "en", "c"),
    (8, GRANT.replace("hereby granted", "hereby also granted").replace("person", "one person"), "en", "c"),
    (9, " ".join(GRANT.split()[:7]) + " elsewhere", "en", "c"),
    (10, ("word " * 30_000 + "apache license ") * 3, "en", "c"),
    (11, "cc", "en", "c"),
    (12, "ccé by cc byK cc by", "en", "c"),
]


def _base(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(licenses.WORD, low)
    at = [(i, label) for phrase, label in licenses.PHRASES for m in [phrase.split()] for i in range(len(words)) if words[i : i + len(m)] == m]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), sorted({b for _, b in at})


def test_licenses(spark):
    got = licenses.scan_licenses(_docs(spark, LICENSED)).collect()
    shown = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, list(r.base_labels)) for r in got), key=str)
    assert shown == sorted(((d, *_base(t)) for d, t, *_ in LICENSED), key=str)
    labels = {r.doc_id: (set(r.labels) - set(r.base_labels), round(r.score, 2)) for r in got if r.doc_id in (1, 3, 4, 7, 8, 9) and r.labels or r.doc_id in (3, 9)}
    assert labels[1] == ({"mit-release"}, 1.0) and labels[3] == (set(), 0.0) and labels[7] == ({"mit-grant"}, 1.0)
    assert labels[8] == ({"mit-grant"}, 1.0) and labels[9][0] == set() and 0 < labels[9][1] < 0.5


def test_licenses_many_places(spark):
    text = " ".join(["mit license cc by x"] * 20_000)
    row = licenses.scan_licenses(_docs(spark, [(1, text, "en", "a")] * 3)).collect()
    assert [(r.n_base, r.first_word, r.last_word) for r in row] == [(40_000, 0, 5 * 19_999 + 2)] * 3


def _divergences(rows, least, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    df, counts, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        df.update({(lang, t) for t in set(terms(text))})
        counts.update((lang, source, t) for t in terms(text))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), n in df.items() if g == lang and n >= least]
        own = sorted(s for g, s in groups if g == lang)

        def shares(per, kept=kept):
            n = sum(per[t] for t in kept)
            return {t: 1 + 10**9 * (per[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = shares({t: sum(counts[lang, s, t] for s in own) for t in kept})
        p = {s: shares({t: counts[lang, s, t] for t in kept}) for s in own}
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            over = [(-(p[s][t] - q[t]), t.encode(), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"stripe_entries": 50, "pair_entries": 40, "pair_sources": 3}])
def test_divergences(spark, limits):
    """limits: small ones, so that stripes are spilled and pairs are dealt to several salts and blocks of sources."""
    rng = np.random.default_rng(3)
    words = ["Alpha", "ÉCOLE", "b4c", "x-y", "naïve", "z", "ß", "the", "😀"]
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 12))), ["en", "fr", None][rng.integers(3)], [None, "a", "b", "é", "c"][rng.integers(5)]) for i in range(300)]
    rows += [(1, "the the", "xx", "only"), (1, "the the", "xx", "only"), (None, None, "yy", "p"), (2, "12 34", "yy", "q"), (3, "the " * 50_000, "en", "a"), (4, "", None, None)]
    got = divergence.divergences(_docs(spark, rows), least=2, top=4, **limits).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == _divergences(rows, 2, 4)


def _whitened(vectors, components=4):
    x = np.floor(256 * np.asarray(vectors, dtype=float))
    fitted = np.unique(x, axis=0)
    y = fitted - fitted.mean(axis=0)
    e, u = np.linalg.eigh(y.T @ y / len(fitted))
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return len(fitted), ((len(fitted) * x - fitted.sum(axis=0)) ** 2).sum(axis=1), (x - fitted.mean(axis=0)) @ u / np.sqrt(e), e / np.trace(y.T @ y / len(fitted))


def test_whitening(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(500, 9)) * np.arange(1, 10)).astype(np.float32)
    x[100:150] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [float("nan")] * 9), (902, [1.0, None] + [1.0] * 7), (903, [float("inf")] * 9), (904, [1.0]), (905, [])]
    more = [(None, x[3].tolist()), (7, x[7].tolist()), (7, [0.0] * 9)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows + odd + more], "vec_id long, embedding array<float>, component int, n double")
    got = whitening.whitened(df).toPandas()
    every = rows + more
    n, deviation, white, explained = _whitened([v for _, v in every])
    assert len(got) == 4 * len(every) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    for k in range(4):
        own = got[got.component == k + 1]
        want = collections.Counter((i, int(d)) for (i, _), d in zip(every, deviation, strict=True))
        assert collections.Counter((None if np.isnan(i) else int(i), d) for i, d in zip(own.vec_id, own.deviation, strict=True)) == want
        np.testing.assert_allclose(own.explained, explained[k], rtol=1e-10)
        np.testing.assert_allclose(np.sort(np.abs(own.whitened)), np.sort(np.abs(white[:, k])), rtol=1e-9, atol=1e-9)


def test_whitening_is_one_projection(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whitening.op13_whitening(spark, SF).toPandas()
    source = table.toPandas()
    n, deviation, white, explained = _whitened(source.embedding.tolist())
    for k in range(4):
        own = got[got.component == k + 1].set_index("vec_id").loc[source.vec_id]
        assert own.deviation.tolist() == deviation.astype(int).tolist() and set(own.n) == {n}
        sign = np.sign(own.whitened.iloc[0] * white[0, k])
        np.testing.assert_allclose(own.whitened * sign, white[:, k], rtol=1e-8, atol=1e-9)
        np.testing.assert_allclose(own.explained, explained[k], rtol=1e-10)
    assert got.identity_error.max() < 1e-10


def test_whitening_of_few_and_wide_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    line = whitening.whitened(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])], kind)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.component, r.deviation) for r in line] == [(1, 1, 2 * 768**2), (2, 1, 0), (3, 1, 2 * 768**2)]
    assert abs(abs(line[0].whitened) - 1.5**0.5) < 1e-12 and line[0].explained == pytest.approx(1.0)
    wide = whitening.whitened(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e10, 3.0]), (3, [0.0, 1.0])], kind)).collect()
    assert len(wide) == 3 and {r.deviation for r in wide if r.vec_id == 1} == {None} and all(np.isfinite(r.whitened) for r in wide)


def test_factor_and_rotation():
    rng = np.random.default_rng(7)
    for size, rank in ((1, 1), (5, 5), (8, 3), (33, 33)):
        a = rng.normal(size=(size, rank)) * 10.0 ** rng.integers(-3, 3, rank)
        c = a @ a.T
        g = whitening.pivoted_cholesky(c)
        assert g.shape[1] >= rank - 1 and np.allclose(g @ g.T, c, rtol=1e-9, atol=1e-9 * abs(c).max())
        turned = whitening.one_sided_jacobi(g)
        norms = np.sort((turned**2).sum(axis=0))[::-1]
        np.testing.assert_allclose(norms, np.sort(np.linalg.eigvalsh(c))[::-1][: len(norms)], rtol=1e-7, atol=1e-9 * abs(c).max())


def test_empty_documents(spark):
    none = _docs(spark, LICENSED).where(F.lit(False))
    assert licenses.scan_licenses(none).count() == 0
    assert divergence.divergences(none).count() == 0


def test_substrings_of_many_copies_without_id(spark):
    """Copies of one row have one key; each is removed whole, in time that follows their number."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(None, text)] * 3000 + [(i, text) for i in range(5)] + [(9, text + " tail"), (10, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.substring_dedup(docs, 35).groupBy("doc_id", "n_words", "kept").count().collect()
    want = [(None, 300, "", 3000), *[(i, 300, "", 1) for i in range(5)], (9, 301, "tail", 1), (10, 1, "short", 1)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_neighbours_among_repeated_rows(spark):
    """Repeated rows of one vec_id hide no other row with their vector."""
    rows = [(0, [1.0, 0.0])] + [(5, [1.0, 0.1])] * 30 + [(7, [1.0, 0.1]), (8, [1.0, 0.1]), (9, [0.0, 3.0]), (9, [0.0, 3.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 5), (0, 7), (0, 8), (0, 9)]


@pytest.mark.parametrize("rows,dim", [(1000, 16), (5000, 64)])
def test_neighbours_recall(spark, rows, dim):
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(rows, dim)).astype(np.float32)
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for q in range(0, rows, 100):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id))
    assert hits >= 0.95 * rows / 10


def test_secrets_of_one_text_with_many_matches(spark):
    text = " ".join(f"token=abcdef{i:05d} deadbeefdeadbeefdeadbeef{i % 7}" for i in range(50_000))
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("base").alias("n"), F.col("base")[0].alias("first"), F.element_at("base", -1).alias("last")).first()
    assert row.n == 100_000 and tuple(row.first) == (0, 17, 0) and row.last.end == len(text)


def test_language_stage_without_labels(spark):
    docs = _docs(spark, [(1, "a clean text", None, "a"), (2, "another one", None, "b"), (3, None, None, None)])
    assert langid.stage(spark, docs, SF).count() == 3


@pytest.mark.parametrize("name,columns", [("op1_simhash", {"fingerprint"}), ("op5_media", {"payload_sha256", "tail_crc32"}), ("op6_secrets", {"base_sha256", "n_hex"}), ("op7_bpe", {"ids_sha256"})])
def test_registered_queries_against_plain_python(spark, name, columns):
    """What the registered queries add to their operators: hex forms, counts, digests."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert set(got) == set(texts) and all(columns <= set(r.asDict()) for r in got.values())
    theirs = None
    if name == "op7_bpe":
        tokens = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
        theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for d, text in texts.items():
        r, data = got[d], text.encode()
        if name == "op1_simhash":
            w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in data))
            shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
            bits = collections.Counter(j for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for j in range(64) if h >> j & 1)
            assert r.fingerprint == f"{sum(1 << j for j, n in bits.items() if 2 * n > len(shingles)):016x}"
        elif name == "op5_media":
            padded = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        elif name == "op6_secrets":
            spans = [(m.start(), 0, m.end()) for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", text, re.A) if len(m[2]) >= 6]
            spans += [(m.start(), k, m.end()) for k, p, n in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)) for m in re.finditer(p, text) if len(m[0]) >= n]
            told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
            assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        else:
            ids = theirs.encode_ordinary(text)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(data).hexdigest())
