"""License scans by diagonal voting, with DataFrame operations only.

All rolling word k-grams of the documents meet the positions of the templates' k-grams in a hash join; the templates are a
fixed table of some two hundred rows, so that side is broadcast. A match votes for the diagonal, its offset in the document
less that in the template. Votes are bits of template positions, so they combine before the shuffle and repeated votes count
once. Phrases (k = 2) are places where all grams vote for one diagonal. Notices (k = 3) may be changed a little:
neighbouring diagonals, apart by words that were put in or left out, are merged into a span, which is verified by the share
of the template's words that its matched grams cover and by its extent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termspark.llm.common import cut, row_key, table

#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices, their labels and the share of their words that must be covered.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", 1.0),
    ("licensed under the gnu general public license version 2", "gpl-2", 1.0),
    ("licensed under the gnu general public license version 3", "gpl-3", 1.0),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", 1.0),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", 1.0),
    ("licensed under cc by 4 0", "cc-by-4.0", 1.0),
    ("released under the mit license", "mit-release", 1.0),
    ("gnu lesser general public license", "lgpl", 1.0),
    ("mozilla public license v 2 0", "mpl-2.0", 1.0),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-grant", 0.75),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-grant", 0.75),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-grant", 0.75),
    ("software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-warranty", 0.75),
    ("this is free and unencumbered software released into the public domain", "unlicense", 0.75),
)
PHRASE_GRAM, NOTICE_GRAM = 2, 3
#: Diagonals of one span differ by so many words at most from the next; a span has so many times its template's words at most.
GAP, EXTENT = 3, 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_rows() -> str:
    """VALUES of g0, g1, g2 (null in phrases), template, nth, label, words, least, is_base: a row for each gram of a template."""
    rows = []
    for number, (text, label, *least) in enumerate((*PHRASES, *NOTICES)):
        words, k = text.split(), NOTICE_GRAM if least else PHRASE_GRAM
        for at in range(len(words) - k + 1):
            third = f"'{words[at + 2]}'" if least else "CAST(NULL AS VARCHAR(99))"
            rows.append(f"('{words[at]}', '{words[at + 1]}', {third}, {number}, {at}, '{label}', {len(words)}, {least[0] if least else 1.0}, {str(not least).lower()})")
    return f"(VALUES {', '.join(rows)}) AS v(g0, g1, g2, template, nth, label, words, least, is_base)"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_words, pos, and the template's columns: a row for each gram that a template has, and one of pos -1 for each
    document; written, so that texts are read once. Words are compared, not only their hashes."""
    spark = docs.sparkSession
    templates = spark.sql(f"SELECT * FROM {template_rows()}").select("*", F.xxhash64("g0", "g1").alias("lead"))
    split = docs.select("doc_id", row_key("doc_id", "text").alias("key"), words_of(F.col("text")).alias("w"))
    places = F.sequence(F.lit(-1), F.greatest(F.size("w") - PHRASE_GRAM, F.lit(-1)))
    each = split.select("doc_id", "key", "w", F.size("w").cast("long").alias("n_words"), F.explode_outer(places).alias("pos"))
    word = lambda i: F.get("w", F.col("pos") + i)
    grams = each.select("doc_id", "key", "n_words", "pos", F.xxhash64(word(0), word(1)).alias("lead"), *[word(i).alias(f"w{i}") for i in range(3)])
    same = (F.col("w0") == F.col("g0")) & (F.col("w1") == F.col("g1")) & (F.col("is_base") | (F.col("w2") == F.col("g2")))
    met = grams.alias("d").join(F.broadcast(templates).alias("t"), (F.col("d.lead") == F.col("t.lead")) & same, "left")
    return cut(met.where("template IS NOT NULL OR pos = -1").select("doc_id", "key", "n_words", "pos", "template", "nth", "label", "words", "least", "is_base"))


def votes(found: DataFrame) -> DataFrame:
    """key, template, label, words, least, is_base, diagonal, mask (of the template's positions that vote for it)."""
    own = ["key", "template", "label", "words", "least", "is_base"]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("nth"))
    return found.where("template IS NOT NULL").groupBy(*own, (F.col("pos") - F.col("nth")).alias("diagonal")).agg(F.bit_or(bit).alias("mask"))


def spans(voted: DataFrame) -> DataFrame:
    """key, template, label, is_base, start, covered (the share of the template's words), verified.

    A phrase's span is a diagonal with all votes. A notice's is a run of neighbouring diagonals.
    """
    full = F.bit_count("mask") == F.col("words") - PHRASE_GRAM + 1
    places = voted.where(F.col("is_base") & full).select("key", "template", "label", "is_base", F.col("diagonal").alias("start"), F.lit(1.0).alias("covered"), F.lit(True).alias("verified"))
    order = W.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True))
    runs = voted.where("NOT is_base").withColumn("run", F.sum(apart.cast("int")).over(order))
    low = F.col("diagonal") + F.length(F.substring_index(F.reverse(F.bin("mask")), "1", 1))
    high = F.col("diagonal") + F.length(F.bin("mask")) + NOTICE_GRAM - 2
    merged = runs.groupBy("key", "template", "label", "words", "least", "is_base", "run").agg(F.bit_or("mask").alias("mask"), F.min(low).alias("start"), F.max(high).alias("last"))
    wide = F.col("mask")
    for i in range(1, NOTICE_GRAM):
        wide = wide.bitwiseOR(F.shiftleft("mask", i))
    covered = merged.withColumn("covered", F.bit_count(wide) / F.col("words"))
    good = (F.col("covered") >= F.col("least")) & (F.col("last") - F.col("start") + 1 <= EXTENT * F.col("words"))
    return places.unionByName(covered.select("key", "template", "label", "is_base", "start", "covered", good.alias("verified")))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted), score of each document.

    score is the largest share of a template that a span of the document covers, 0 without any. A null text has no words.
    Repeated rows get equal results each; texts of one doc_id, or without one, do not mix. Other columns are ignored; an empty
    table gives no rows. Texts may be of any length: their matches are rows, and those of one text are not gathered.
    """
    found = matches(docs)
    spotted = spans(votes(found))
    sure, base = F.col("verified"), F.col("verified") & F.col("is_base")
    labels = lambda on: F.sort_array(F.collect_set(F.when(on, F.col("label"))))
    told = spotted.groupBy("key").agg(
        F.count(F.when(base, F.lit(1))).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        labels(base).alias("base_labels"), labels(sure).alias("labels"), F.max("covered").alias("score"))
    none = F.array().cast("array<string>")
    rows = found.where("pos = -1").select("doc_id", "key", "n_words").join(told, "key", "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


ORACLE = rf"""
WITH t AS (SELECT * FROM {template_rows()}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
g AS (SELECT r, unnest(w[:-2]) AS a, unnest(w[2:]) AS b, unnest(list_concat(w[3:], [''])) AS c, unnest(range(len(w) - 1)) AS pos FROM d WHERE len(w) > 1),
vote AS (SELECT r, template, label, words, least, is_base, pos - nth AS diagonal, bit_or(1::BIGINT << nth) AS mask, min(pos) AS low, max(pos) AS high
  FROM g JOIN t ON a = g0 AND b = g1 AND (is_base OR c = g2) GROUP BY ALL),
run AS (SELECT *, sum(step) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS step FROM vote WHERE NOT is_base)),
merged AS (SELECT r, label, words, least, bit_or(mask) AS m, max(high) + {NOTICE_GRAM} - min(low) AS extent FROM run GROUP BY r, template, label, words, least, run),
span AS (SELECT r, label, true AS is_base, diagonal AS start, 1.0::DOUBLE AS covered, true AS verified FROM vote WHERE is_base AND bit_count(mask) = words - 1
  UNION ALL SELECT r, label, false, NULL, bit_count(m | (m << 1) | (m << 2)) / words, bit_count(m | (m << 1) | (m << 2)) / words >= least AND extent <= {EXTENT} * words FROM merged)
SELECT doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified), '') AS labels,
  coalesce(max(covered), 0)::DOUBLE AS score
FROM d LEFT JOIN span USING (r) GROUP BY r, doc_id, len(w)
"""
