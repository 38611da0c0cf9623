"""Substring de-duplication by seed and extend: repeated runs of words, whatever documents they are in.

A window is `length` consecutive words. Seeds are winnowed anchors: of the `length // 2 + 1` word grams in a window, the
one with the smallest hash (the last, if equal). Equal windows choose equal anchors at equal offsets, so a window can only
repeat if its anchor does, and one gram in ten or so is an anchor.

The windows that choose one anchor lie side by side and cover a *block* of words. Anchors that repeat are extended both
ways in two steps: where the whole block repeats, all its windows do (the inside of a copy); else (the edges of a copy, and
one block for each distinct surrounding) the windows themselves are compared by 128-bit hashes. Adjacent repeated windows
make up the maximal repeats.

Documents are joined with what their anchors have in common, not with each other: blocks and windows are counted, which
combines on the map side, and the counts over one are joined back. So a passage that very many documents share costs a row
for each of its occurrences, in a join whose large partitions Spark splits, and no task gathers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspark.llm.common import bounded, cut, discard, table, text_batches

LENGTH = 35
_BATCH = 2 << 20
#: A document: its doc_id and two hashes of its text.
KEY = ["k0", "k1", "k2"]
_KEY_TYPES = "k0 bigint, k1 bigint, k2 bigint"
_U = np.uint64
#: Odd multipliers of the two hash lanes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a batch of texts, end to end, with rolling hashes in two lanes."""

    def __init__(self, texts: list[bytes | None]):
        split = [(t or b"").split() for t in texts]
        self.counts = np.array([len(w) for w in split], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        digest = xxhash.xxh3_128_digest
        raw = np.frombuffer(b"".join([digest(w) for words in split for w in words]), dtype="<u8").reshape(-1, 2)
        n = len(raw)
        self.sums, self.backs = [], []
        for lane, base in enumerate(_BASES):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(raw[:, lane] * _powers(base, n), out=total[1:])
            self.sums.append(total)
            self.backs.append(_powers(pow(base, -1, 1 << 64), n + 1))

    def hashes(self, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
        return mix64((self.sums[lane][end] - self.sums[lane][start]) * self.backs[lane][start])

    def anchors(self, length: int) -> tuple[np.ndarray, ...]:
        """(document, first window, number of windows, anchor hash, block hash) of each anchor; windows count from the document's first word."""
        gram = length - length // 2
        choices = length - gram + 1
        n = int(self.first[-1])
        none = np.zeros(0, dtype=np.int64)
        if n < length:
            return none, none, none, none.view(np.uint64), none.view(np.uint64)
        at = np.arange(n - gram + 1)
        grams = self.hashes(at, at + gram, 0)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        begin = np.nonzero(doc[: n - length + 1] == doc[length - 1 :])[0]
        seen = np.lib.stride_tricks.sliding_window_view(grams, choices)
        chosen = np.empty(len(begin), dtype=np.int64)
        for k in range(0, len(begin), 1 << 16):
            part = begin[k : k + (1 << 16)]
            chosen[k : k + len(part)] = part + choices - 1 - seen[part][:, ::-1].argmin(axis=1)
        new = np.ones(len(begin), dtype=bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (doc[begin[1:]] != doc[begin[:-1]])
        head = np.nonzero(new)[0]
        windows = np.diff(np.append(head, len(begin)))
        start = begin[head]
        block = self.hashes(start, start + windows - 1 + length, 1) ^ mix64(((chosen[head] - start) * 4096 + windows).astype(np.uint64))
        return doc[start], start - self.first[doc[start]], windows, grams[chosen[head]], block


def _bytes(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """anchor, block, the key, first, windows of every anchor of the documents (key and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", _BATCH):
            doc, first, windows, anchor, block = Words(_bytes(batch)).anchors(length)
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64)), *[batch.column(k).take(at) for k in KEY], pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32))],
                names=["anchor", "block", *KEY, "first", "windows"],
            )

    return docs.select(*KEY, "text").mapInArrow(run, f"anchor bigint, block bigint, {_KEY_TYPES}, first int, windows int")


def find_windows(docs: DataFrame, length: int) -> DataFrame:
    """h1, h2, the key, at, open of the windows of the blocks in `probes` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", _BATCH):
            words = Words(_bytes(batch))
            doc, at, open_ = [], [], []
            for d, probes in enumerate(batch.column("probes").to_pylist()):
                for p in probes:
                    doc += [d] * p["windows"]
                    at += range(p["first"], p["first"] + p["windows"])
                    open_ += [p["open"]] * p["windows"]
            rows = pa.array(doc, pa.int64())
            start = words.first[np.array(doc, dtype=np.int64)] + np.array(at, dtype=np.int64)
            lanes = [pa.array(words.hashes(start, start + length, k).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*lanes, *[batch.column(k).take(rows) for k in KEY], pa.array(at, pa.int32()), pa.array(open_, pa.bool_())], names=["h1", "h2", *KEY, "at", "open"])

    return docs.mapInArrow(run, f"h1 bigint, h2 bigint, {_KEY_TYPES}, at int, open boolean")


def cover(n: int, length: int, blocks: list[dict] | None, windows: list[int] | None) -> np.ndarray:
    """Which of a document's n words lie in a repeated window."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for b in blocks or ():
        edge[b["first"]] += 1
        edge[b["first"] + b["windows"] - 1 + length] -= 1
    for i in windows or ():
        edge[i] += 1
        edge[i + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, n_words, spans and kept of documents with `blocks` and `marks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text", _BATCH):
            counts, spans, kept = [], [], []
            for text, blocks, marks in zip(_bytes(batch), batch.column("blocks").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                words = (text or b"").split()
                counts.append(len(words))
                if blocks or marks:
                    gone = cover(len(words), length, blocks, marks)
                    turn = np.nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))[0].tolist()
                    spans.append([{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2], strict=True)])
                    words = [words[i] for i in np.nonzero(~gone)[0].tolist()]
                else:
                    spans.append([])
                kept.append(b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "blocks", "marks").mapInArrow(run, f"doc_id {kind}, n_words bigint, spans array<struct<start:int,end:int>>, kept string")


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, spans, kept: the maximal repeats of `length` words or more (word offsets, end exclusive) and the rest.

    A window repeats if its words also start anywhere else, in the same document or another; every occurrence is removed.
    A null text has no words; documents shorter than a window are kept whole; repeated rows repeat each other. Documents are
    told apart by doc_id (which may be null) and 128 bits of hashes of the text. Other columns are ignored; an empty table
    gives no rows.
    """
    text = F.coalesce("text", F.lit("\x00"))
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("k0"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(9), text).alias("k2"))
    seeds = cut(find_anchors(keyed, length))
    again = seeds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high")).where("n > 1")
    again = cut(again.select("anchor", (F.col("low") != F.col("high")).alias("edge")))
    met = cut(seeds.join(bounded(again, F.lit(32)), "anchor").withColumn("spot", F.xxhash64(*KEY, "first")))
    alike = met.groupBy("anchor", "block").agg(F.count("*").alias("alike"), F.min("spot").alias("one"))
    flags = met.join(alike, ["anchor", "block"]).groupBy(*KEY).agg(
        F.collect_set(F.when(F.col("alike") > 1, F.struct("first", "windows"))).alias("blocks"),  # a set: repeated rows have one key
        F.collect_set(F.when(F.col("edge") & (F.col("spot") == F.col("one")), F.struct("first", "windows", (F.col("alike") == 1).alias("open")))).alias("probes"),
    )
    flags = cut(flags)
    probed = keyed.join(flags.where(F.size("probes") > 0).select(*KEY, "probes"), KEY)
    windows = cut(find_windows(probed.select(*KEY, "text", "probes"), length))
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    marks = cut(windows.where("open").join(repeated, ["h1", "h2"]).groupBy(*KEY).agg(F.collect_set("at").alias("marks")))
    discard(seeds, again, met, windows)
    found = keyed.join(flags.select(*KEY, "blocks"), KEY, "left").join(marks, KEY, "left")
    return remove_repeats(found, length)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), LENGTH)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, i + o AS p FROM rep, (SELECT unnest(range(35)) AS o)
), word AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
), kept AS (
  SELECT word.r, string_agg(word, ' ' ORDER BY word.p) AS text, count(*) AS n FROM word ANTI JOIN gone ON word.r = gone.r AND word.p = gone.p GROUP BY word.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
