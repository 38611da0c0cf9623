"""Language identification by error-correcting output codes.

Each language has a codeword, a row of a Hadamard matrix; any two differ in half their bits, so a quarter of the bits less
one may be wrong. For each bit there is a binary classifier, a naive Bayes over hashed byte trigrams that tells the
languages with a one from those with a zero. Loss-weighted decoding sums, over the bits, the logistic loss of each
language's codeword under the classifiers' margins; the language with the least loss wins, and a small lead over the second
flags the document as ambiguous.

The trigram counts come from all labelled documents and are summed by Spark; the driver sees one row per language and
bucket, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspark.llm.common import cut, discard, table, text_batches

BUCKETS = 1 << 13
#: Added to each count.
SMOOTHING = 0.5
#: A document is ambiguous if the winner's probability is below this.
AMBIGUOUS = 0.55
#: At most this many trigrams count as evidence; a longer text's margin is scaled to it.
EVIDENCE = 60.0
#: Languages whose counts a task holds at a time, and those that a model can have (64 KB each on the driver).
HELD_LANGS, MAX_LANGS = 256, 4096
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are not letters become spaces.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_SPACE = np.frombuffer(b" ", dtype=np.uint8)


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the byte trigrams of the lower-cased letters, with one space between and around words."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" ", dtype=np.uint8)
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    b = raw[keep].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(19)).astype(np.int64)


def counts(labelled: DataFrame) -> DataFrame:
    """lang, bucket, n: how often each bucket's trigrams occur in the texts of each language. A task holds HELD_LANGS at a time."""

    def rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            some = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in text_batches(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                held[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
                if len(held) >= HELD_LANGS:
                    yield from rows(held)
                    held.clear()
        yield from rows(held)

    return labelled.select("lang", "text").mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(languages: int) -> np.ndarray:
    """One row of signs per language: rows of a Hadamard matrix, without the columns in which all agree."""
    matrix = np.ones((1, 1), dtype=np.int8)
    while len(matrix) <= languages or len(matrix) < 16:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    rows = matrix[1 : languages + 1]
    useful = (rows != rows[0]).any(axis=0)
    return rows[:, useful] if useful.any() else rows[:, :1]


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # (languages, bits), signs
    weights: np.ndarray  # (buckets, bits), log odds

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for text in texts:
            if text is None or not self.langs or not _LETTER.search(text):
                langs.append("und")
                scores.append(0.0)
                continue
            n = np.bincount(trigrams(text), minlength=BUCKETS)
            total = n.sum()
            used = np.nonzero(n)[0]
            margin = (n[used] @ self.weights[used]) * (min(total, EVIDENCE) / max(total, 1)) / 4
            loss = np.logaddexp(0, -self.codes * margin[None, :]).sum(axis=1)
            p = np.exp(loss.min() - loss)
            best = int(np.argmin(loss))
            langs.append(self.langs[best])
            scores.append(float(p[best] / p.sum()))
        return langs, scores


def fit(labelled: DataFrame) -> Model:
    """A model of the languages in `lang` of the rows whose lang and text are not null; without any, all is undetermined."""
    counted = cut(counts(labelled.where("lang IS NOT NULL AND text IS NOT NULL")))
    if (n := counted.select("lang").distinct().count()) > MAX_LANGS:
        raise ValueError(f"{n} languages: a model holds {MAX_LANGS} at most")
    rows = counted.toPandas()
    discard(counted)
    langs = sorted(rows["lang"].unique().tolist())
    table_ = np.full((len(langs), BUCKETS), SMOOTHING)
    table_[[langs.index(x) for x in rows["lang"]] if len(rows) else [], rows["bucket"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy(dtype=np.int64)
    share = table_ / table_.sum(axis=1, keepdims=True) if langs else table_
    codes = codewords(len(langs)) if langs else np.zeros((0, 1), dtype=np.int8)
    ones, zeros = (codes > 0).astype(float), (codes < 0).astype(float)
    mean = lambda side: (side.T @ share) / np.maximum(side.sum(axis=0), 1)[:, None]
    weights = np.log(np.maximum(mean(ones), 1e-12)) - np.log(np.maximum(mean(zeros), 1e-12))
    weights[~((ones.sum(axis=0) > 0) & (zeros.sum(axis=0) > 0))] = 0.0
    return Model(langs, codes, weights.T.astype(np.float32))


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id) with lang_pred, score and ambiguous. Only the text is looked at.

    A null text or one without a letter is `und` with score 0. Repeated rows get equal results; texts of any length are
    read whole.
    """
    carry = carry or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            langs, scores = shared.value.predict(batch.column("text").to_pylist())
            found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([s < AMBIGUOUS for s in scores], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *found], names=[*carry, "lang_pred", "score", "ambiguous"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, f"{fields}, lang_pred string, score double, ambiguous boolean")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit(docs.where(F.coalesce(fold, F.lit(0)) != 1))
    marked = docs.select("doc_id", "text", F.coalesce(fold == 1, F.lit(False)).alias("held_out"))
    return identify(marked, model, ["doc_id", "held_out"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters and the ambiguous ones go. Without any labelled document there
    is no language to tell, and all stay."""
    model = fit(docs)
    if not model.langs:
        return docs
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            langs, scores = shared.value.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([x != "und" and s >= AMBIGUOUS for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
