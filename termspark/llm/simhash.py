"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments of 22, 21 and 21 bits. Padded to 23 bits, a segment lies within three
bits of exactly one codeword of the perfect binary Golay code; that codeword's 12-bit message is the segment's index. The
*ball* of a segment is the set of indices of the segment and of all its one-bit neighbours (one to six values), so two
segments that differ in one bit at most meet: the index of one is in the ball of the other.

Two fingerprints with three differing bits or fewer either have a segment without an error, and then one of the other two
has one error at most (three errors over two segments), or have one error in each segment. Keys for both cases:

* for each ordered pair of segments: the first one exactly, with the index of the second (34 bits);
* the indices of all three segments (36 bits).

One side of the join gives indices, the other gives balls, so a link meets under at least one key. Every meeting is then
verified on the fingerprints themselves. Equal fingerprints are one node from the start; around one fingerprint there are
at most 43,744 others within three bits, however many documents a group of copies has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termspark.llm.common import bounded, cut, discard, partitions, row_key, table, text_batches
from termspark.llm.graph import connected_components

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the (23, 12) Golay code.
GENERATOR = 0b110001110101
#: (lowest bit, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 3
_CHUNK = 1 << 16
#: The pipeline's stage: Jaccard of the sets of shingles, and the MinHash bands that gather candidates. A pair at 0.8 shares a
#: band with a probability of 0.99993.
SIMILARITY = 0.8
BANDS, BAND_ROWS = 24, 5
_SALTS, _FACTORS = np.random.default_rng(8).integers(0, 2**64, (2, BANDS * BAND_ROWS), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


_BITS = [_remainder(1 << i) for i in range(23)]


def _xor(values: Iterable[int]) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


_BYTES = np.array([[_xor(_BITS[8 * k + i] for i in range(8) if v >> i & 1 and 8 * k + i < 23) for v in range(256)] for k in range(3)], dtype=np.uint32)
_ERRORS = np.zeros(2048, dtype=np.uint32)
for _weight in range(4):
    for _at in combinations(range(23), _weight):
        _ERRORS[_xor(_BITS[i] for i in _at)] = sum(1 << i for i in _at)


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit message of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    syndrome = _BYTES[0][words & 255] ^ _BYTES[1][words >> 8 & 255] ^ _BYTES[2][words >> 16]
    return (words ^ _ERRORS[syndrome]) >> 11


def golay_ball(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each word and its one-bit neighbours: (n, width + 1) sorted values and a mask of the distinct ones."""
    flips = np.array([0, *(1 << i for i in range(width))], dtype=np.uint32)
    found = np.sort(golay_index(words.astype(np.uint32)[:, None] ^ flips[None, :]), axis=1)
    keep = np.ones(found.shape, dtype=bool)
    keep[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, keep


def _pairs(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """All combinations of two (row, value) lists that belong to the same row; both are sorted by row."""
    (r1, v1), (r2, v2) = left, right
    n = int(max(r1.max(initial=-1), r2.max(initial=-1))) + 1
    counts, first = np.bincount(r2, minlength=n), np.zeros(n + 1, dtype=np.int64)
    np.cumsum(counts, out=first[1:])
    times = counts[r1]
    begin = np.repeat(first[r1], times)
    step = np.arange(len(begin)) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(r1, times), np.repeat(v1, times) << np.uint64(shift) | v2[begin + step]


def golay_keys(prints: np.ndarray, balls: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys of each fingerprint: those with balls, or those that balls are compared with."""
    rows = np.arange(len(prints))
    parts = [(prints >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in SEGMENTS]
    exact = [(rows, p) for p in parts]
    single = [(rows, golay_index(p).astype(np.uint64)) for p in parts]
    if balls:
        around = []
        for p, (_, width) in zip(parts, SEGMENTS, strict=True):
            found, keep = golay_ball(p, width)
            around.append((np.nonzero(keep)[0], found[keep].astype(np.uint64)))
    else:
        around = single
    out = []
    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        row, key = _pairs(exact[i], around[j], 12)
        out.append((row, key | np.uint64(tag << 40)))
    third = single if balls else [(np.nonzero(keep)[0], found[keep].astype(np.uint64)) for found, keep in [golay_ball(parts[2], SEGMENTS[2][1])] * 3]
    row, key = _pairs(_pairs(around[0], around[1], 12), third[2], 12)
    out.append((row, key | np.uint64(6 << 40)))
    return np.concatenate([r for r, _ in out]), np.concatenate([k for _, k in out])


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the word shingles: bit i is set if it is set in over half of their hashes. No word: zero."""
    words = text.lower().split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    text = b" ".join(words)
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    take = min(shingle, len(words))
    begin, end = start[: len(words) - take + 1], (start + size)[take - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(begin), _CHUNK):
        hashes = b"".join([digest(text[a:b], 42) for a, b in zip(begin[at : at + _CHUNK].tolist(), end[at : at + _CHUNK].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(begin)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id) with `fp`, the fingerprint as a signed 64-bit integer."""
    carry = carry or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            got = np.array([fingerprint(b or b"", shingle) for b in batch.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(got.view(np.int64))], names=[*carry, "fp"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(run, f"{fields}, fp bigint")


def links(prints: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct fingerprints in `fp` that differ in three bits or fewer."""

    def keys(balls: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column("fp").to_numpy().view(np.uint64)
                for at in range(0, len(values), 4096):
                    part = values[at : at + 4096]
                    row, key = golay_keys(part, balls)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[row].view(np.int64))], names=["key", "fp"])

        return prints.select("fp").mapInArrow(run, "key bigint, fp bigint")

    a, b = keys(True).withColumnRenamed("fp", "a"), keys(False).withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return a.join(b, "key").where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reached over links of three bits or fewer.

    Null texts and texts without words have fingerprint zero and link like any other. Documents shorter than a shingle use
    their whole word sequence. Repeated rows stay, each with its row. Null doc_ids never become a component_id unless the
    whole component has no other. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    prints = cut(fingerprints(docs, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(nodes.repartition(partitions(spark))))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def _hashes(text: bytes, shingle: int) -> tuple[bytes, np.ndarray]:
    """The lower-case words with single spaces between, and the distinct hashes of their shingles (fewer words: all as one)."""
    words = text.lower().split()
    take = min(shingle, len(words))
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + take]), 42) for i in range(len(words) - take + 1)} if words else set()
    return b" ".join(words), np.fromiter(found, dtype=np.uint64, count=len(found))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: a hash of the band's BAND_ROWS minima. Sets of Jaccard j share a key with 1 - (1 - j ** BAND_ROWS) ** BANDS."""
    least = np.full(len(_SALTS), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        mixed = (hashes[at : at + 512, None] ^ _SALTS) * _FACTORS
        np.minimum(least, ((mixed ^ (mixed >> np.uint64(29))) * _FACTORS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least.reshape(BANDS, BAND_ROWS))], dtype=np.uint64)


def _sketches(docs: DataFrame, carry: list[str], shingle: int) -> DataFrame:
    """The carried columns, node (a hash of the words), fp, n (distinct shingles) and bands (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            texts = [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = [_hashes(t, shingle) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(w) for w, _ in rows], dtype=np.uint64)
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            bands = pa.array([band_keys(h).view(np.int64) if len(h) else [] for _, h in rows], pa.list_(pa.int64()))
            made = [pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), pa.array([len(h) for _, h in rows], pa.int32()), bands]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *made], names=[*carry, "node", "fp", "n", "bands"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(run, f"{fields}, node bigint, fp bigint, n int, bands array<bigint>")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node and shingles, the distinct hashes, of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            sets = pa.array([_hashes(b or b"", shingle)[1].view(np.int64) for b in batch.column("text").cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """key (as row_key of doc_id and text) of each row, and first: the smallest key of its component.

    Components are reached over pairs whose sets of shingles have a Jaccard of `similarity` or more. Candidates share a MinHash
    band or have SimHashes within three bits; each is verified on the sets themselves. Texts of equal words are one node.
    Pairs within a bucket grow with its square, so they are not all formed: every node is verified against leaders of its
    buckets first, then only nodes of a bucket that are in different groups still are paired.
    """
    spark, tables = docs.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        tables.append(cut(df))
        return tables[-1]

    keyed = docs.select(row_key("doc_id", "text").alias("key"), "text")
    prints = kept(_sketches(keyed.select("key.id", "key.h0", "text"), ["id", "h0"], shingle)).withColumn("key", F.struct("id", "h0"))
    nodes = kept(prints.groupBy("node").agg(F.min("key").alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("bands").alias("bands")))
    me = F.struct("node", "n").alias("me")
    blocks = nodes.select(me, F.explode("bands").alias("block")).union(nodes.select(me, F.xxhash64(F.lit("fp"), "fp")))
    bucket = W.partitionBy("block")
    held = blocks.select("block", "me", F.min("me").over(bucket).alias("leader"), F.count("*").over(bucket).alias("held"))
    crowded = kept(held.where("held > 1").drop("held"))
    one = kept(nodes.groupBy("fp").agg(F.min(me).alias("me")))
    apart = links(one.select("fp").repartition(partitions(spark)))
    by_bits = kept(apart.join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b").where(_sizes_allow("x", "y", similarity)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    ends = crowded.select("me.node").union(by_bits.select("a")).union(by_bits.select("b")).distinct()
    fetched = kept(nodes.join(ends, "node", "left_semi").select("node", F.col("first").alias("key")))
    sets = kept(_shingle_sets(keyed.join(bounded(fetched, F.lit(64)), "key"), shingle).dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        sized = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("shared"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
        return kept(sized.where(F.col("shared") >= F.lit(similarity) * (F.col("sizes") - F.col("shared"))).select("a", "b"))

    led = crowded.where("me.node <> leader.node").where(_sizes_allow("me", "leader", similarity)).select(F.col("me.node").alias("a"), F.col("leader.node").alias("b")).distinct()
    found = verified(led.groupBy("a").agg(F.min("b").alias("b")))
    roots = connected_components(found)
    tables.append(roots)
    found = kept(found.union(verified(_across(led, roots))))
    roots = connected_components(found)
    tables.append(roots)
    grouped = crowded.join(roots, F.col("me.node") == F.col("node"), "left").select("block", "me", F.coalesce("root", "me.node").alias("group"))
    inside = grouped.toDF("block", "x", "group_x").join(grouped.toDF("block", "y", "group_y"), "block").where((F.col("group_x") < F.col("group_y")) & _sizes_allow("x", "y", similarity))
    inside = inside.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    rest = inside.union(_across(by_bits, roots).select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    roots = connected_components(found.union(verified(rest)))
    tables.append(roots)
    rooted = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = kept(rooted.select("node", "root").join(least, "root").select("node", "first"))
    out = cut(prints.select("key", "node").join(named, "node").select("key", "first"))
    discard(*tables)
    return out


def _sizes_allow(a: str, b: str, similarity: float) -> Column:
    """Whether sets of these sizes can have that Jaccard; none that has it is lost."""
    return F.least(f"{a}.n", f"{b}.n") >= F.lit(similarity) * F.greatest(f"{a}.n", f"{b}.n")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different groups."""
    both = pairs.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that with the smallest doc_id and text hash (one, if its row is repeated).

    Different texts that share a doc_id are documents of their own. Documents without a doc_id cannot be told apart and stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    found = similar_documents(named)
    flags = found.groupBy("key").agg(F.max(F.col("key") != F.col("first")).alias("gone"), F.count("*").alias("held")).where("gone OR held > 1")
    few = bounded(cut(flags), F.lit(64))
    discard(found)
    rows = named.select(row_key("doc_id", "text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(few, "key", "left").where("coalesce(NOT gone, true)")
    once = kept.where("held IS NULL").unionByName(kept.where("held > 1").dropDuplicates(["key"]))
    return once.select("row.*").unionByName(docs.where("doc_id IS NULL"))
