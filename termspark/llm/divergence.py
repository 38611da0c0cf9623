"""Source divergence audit by in-mapper stripes.

Every partition folds its whole documents into hash stripes, term to (document frequency, counts by source) for each
language. When they hold STRIPE_ENTRIES entries they are spilled, that is handed to the shuffle, and begun anew. Stripes are
merged by (language, term); a term's merged stripe has all that its divergences need, so these are emitted from it:
for the terms of a group against its language straight from each entry, for pairs of sources by adding up stripes, blocks of
sources at a time, in tasks of a bounded number of entries.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termspark.llm.common import bounded, cut, discard, table, text_batches

#: Least number of a language's documents that a kept term is in; terms reported for each group.
LEAST_DOCUMENTS, TOP = 30, 50
#: Added to each count; shares are in parts of SCALE.
PRIOR, SCALE = 5, 1_000_000_000
#: Entries that a partition's stripes hold before they are spilled.
STRIPE_ENTRIES = 400_000
#: Entries of merged stripes that one task of the pairs takes, and sources whose rows of the pair matrix it holds.
PAIR_ENTRIES, PAIR_SOURCES = 131_072, 256
_BATCH = 2 << 20
_ROWS = 1 << 15
#: Bytes of terms: A-Z become a-z, other letters of ASCII and all bytes of other characters stay, the rest are spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_STRIPE = "array<struct<source:string,n:bigint>>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _rows(lang: str, frequency: Counter, counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """The stripes of one language: lang, term, df, stripe."""
    place = {t: i for i, t in enumerate(frequency)}
    at = np.fromiter((place[t] for own in counts.values() for t in own), dtype=np.int64)
    n = np.fromiter((k for own in counts.values() for k in own.values()), dtype=np.int64)
    source = np.repeat(np.arange(len(counts)), [len(own) for own in counts.values()])
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(np.bincount(at, minlength=len(place)))
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(list(counts), pa.string()).take(pa.array(source[order])), pa.array(n[order])], names=["source", "n"])
    whole = pa.RecordBatch.from_arrays(
        [
            pa.array([lang], pa.string()).take(pa.array(np.zeros(len(place), dtype=np.int64))),
            pa.array(list(frequency), pa.binary()).cast(pa.string()),
            pa.array(list(frequency.values()), pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), entries),
        ],
        names=["lang", "term", "df", "stripe"],
    )
    for i in range(0, whole.num_rows, _ROWS):
        yield whole.slice(i, _ROWS)


def stripes(docs: DataFrame, entries: int) -> DataFrame:
    """lang, term, df, stripe: partial stripes of documents (lang, source, text, none of them null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Counter, dict[str, Counter]]] = {}
        for batch in text_batches(batches, "text", _BATCH):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                if words := terms_of(text):
                    frequency, counts = held.setdefault(lang, (Counter(), defaultdict(Counter)))
                    counts[source].update(words)
                    frequency.update(set(words))
            if sum(len(f) + sum(map(len, c.values())) for f, c in held.values()) > entries:
                for lang, (frequency, counts) in held.items():
                    yield from _rows(lang, frequency, counts)
                held.clear()
        for lang, (frequency, counts) in held.items():
            yield from _rows(lang, frequency, counts)

    return docs.mapInArrow(run, f"lang string, term string, df bigint, stripe {_STRIPE}")


def merged(parts: DataFrame, least: int) -> DataFrame:
    """lang, term, n (in all sources), stripe of the terms that `least` documents of their language have.

    Partial stripes meet by language and term; their entries are added up one by one, so that no task gathers the parts of a
    frequent term. A merged stripe has an entry for each source at most. The document frequency goes as an entry without a
    source.
    """
    dealt = parts.repartition("lang", "term")
    whole = F.struct(F.lit(None).cast("string").alias("source"), F.col("df").alias("n"))
    each = dealt.select("lang", "term", F.inline(F.concat(F.array(whole), "stripe")))
    summed = each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    own = F.col("source").isNotNull()
    found = summed.groupBy("lang", "term").agg(
        F.max(F.when(~own, F.col("n"))).alias("df"),
        F.sum(F.when(own, F.col("n"))).alias("n"),
        F.collect_list(F.when(own, F.struct("source", "n"))).alias("stripe"),
    )
    return found.where(F.col("df") >= least).select("lang", "term", "n", "stripe")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), in whole numbers of 38 digits; null without kept terms."""
    digits = lambda c: c.cast("decimal(19,0)")
    up, down = digits(count + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), digits(F.nullif(total + kept * PRIOR, F.lit(0)))
    return F.call_function("div", up, down) + 1


def groups_of(docs: DataFrame, kept: DataFrame, pair_entries: int) -> DataFrame:
    """lang, source, place (among the language's sources), sources, total, all, terms, base (the share of a term that is not
    there), salts of every group; written."""
    totals = kept.select("lang", F.inline("stripe")).groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    pairs = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "entries", "terms"])
    whole = W.partitionBy("lang")
    place = (F.row_number().over(whole.orderBy("source")) - 1).alias("place")
    salts = F.greatest(F.ceil(F.sum("entries").over(whole) / pair_entries), F.lit(1)).cast("int").alias("salts")
    sized = pairs.select("lang", "source", place, F.count("*").over(whole).cast("int").alias("sources"), "total", F.sum("total").over(whole).alias("all"), "terms", salts)
    return cut(sized.withColumn("base", F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(0).cast("long"))))


def pair_sums(left: pa.Table, right: pa.Table, pair_sources: int) -> pa.Table:
    """lang, source, item, value: what these terms add to the divergences of a block of sources from all others.

    left: entries (term, place, p); right: all groups of the language (source, place, base, block).
    """
    right = right.sort_by("place")
    base, names = right.column("base").to_numpy(), right.column("source").combine_chunks()
    block = right.column("block")[0].as_py()
    rows = np.arange(block * pair_sources, min(len(base), (block + 1) * pair_sources))
    sums = np.zeros((len(rows), len(base)), dtype=np.int64)
    if left.num_rows:
        term = left.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        place, p = left.column("place").to_numpy(), left.column("p").to_numpy()
        step = max(1, (1 << 21) // len(base))
        order = np.argsort(term, kind="stable")
        term, place, p = term[order], place[order], p[order]
        for low in range(0, int(term[-1]) + 1, step):
            i, j = np.searchsorted(term, [low, low + step])
            shares = np.tile(base, (int(term[j - 1]) - low + 1, 1))
            shares[term[i:j] - low, place[i:j]] = p[i:j]
            for k, a in enumerate(rows):
                sums[k] += np.abs(shares - shares[:, a : a + 1]).sum(axis=0)
    a, b = np.nonzero(rows[:, None] != np.arange(len(base))[None, :])
    lang = right.column("lang").combine_chunks()
    return pa.table({"lang": lang.take(pa.array(np.zeros(len(a), dtype=np.int64))), "source": names.take(pa.array(rows[a])), "item": names.take(pa.array(b)), "value": sums[a, b]})


def divergences(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, stripe_entries: int = STRIPE_ENTRIES, pair_entries: int = PAIR_ENTRIES, pair_sources: int = PAIR_SOURCES
) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of a language differ in their kept terms.

    Part `pair`: the summed differences of shares from each other source; part `term`: the terms with the largest excess of
    the group's share over the language's, `top` at most. Null text, lang and source count as empty; repeated rows count
    each; a document without terms still makes its group occur; a group without kept terms has every prior share alike; a
    language without kept terms has values of zero. The limits on entries and sources change no result. An empty table gives no rows; other columns are ignored. Exact below
    10^18 occurrences.
    """
    own = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = cut(merged(stripes(own, stripe_entries), least))
    groups = groups_of(own, kept, pair_entries)
    known = bounded(groups, F.length("lang") + F.length("source") + 96)
    entries = kept.select("lang", "term", F.col("n").alias("n_all"), F.inline("stripe")).join(known, ["lang", "source"])
    entries = entries.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    q = share(F.col("n_all"), F.col("all"), F.col("terms"))
    over = entries.select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    salt = F.pmod(F.xxhash64("term"), F.col("salts")).cast("int").alias("salt")
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / pair_sources).cast("int"))).alias("block")
    left = entries.select("lang", "term", "place", "p", salt, blocks)
    right = groups.toDF(*groups.columns).select("lang", "source", "place", "base", "salts", blocks).select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    keys = ["lang", "salt", "block"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: pair_sums(a, b, pair_sources), "lang string, source string, item string, value bigint")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    out = cut(pairs.select(*names).unionByName(terms.select(*names)))
    discard(kept, groups)
    return out


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}
), langs AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM kept GROUP BY lang
), entry AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), grp AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN entry USING (lang, source) GROUP BY lang, source
), every AS (
  SELECT g.lang, g.source, k.term, coalesce(e.n, 0) AS n, 1 + ({SCALE} * (coalesce(e.n, 0) + {PRIOR})::HUGEINT) // (g.total + {PRIOR} * v) AS p,
    1 + ({SCALE} * (k.n + {PRIOR})::HUGEINT) // (langs.total + {PRIOR} * v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN entry e ON e.lang = g.lang AND e.source = g.source AND e.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN every x ON x.lang = a.lang AND x.source = a.source LEFT JOIN every y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), both_ AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM every WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
