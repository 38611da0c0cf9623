"""Byte-level BPE through a sentencepiece model that is written directly from the vocabulary.

Each byte has a printable character of its own, and each token's bytes become a piece of such characters whose score is the
token's negative rank; with identity normalisation and no white space rules, sentencepiece then merges exactly the pairs
that byte-level BPE merges. Texts are first cut into pre-tokens; every pre-token is encoded on its own. Decoding looks up
each id's bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import sentencepiece_model_pb2 as proto

from termspark.llm.common import table, text_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers; when full, it starts anew. Longer ones are not remembered.
REMEMBERED, REMEMBERED_LENGTH = 150_000, 32
#: Bytes of texts that are encoded at a time.
BATCH_BYTES = 2 << 20


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens' bytes by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def build_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the unknown piece comes last."""
    chars = byte_characters()
    model = proto.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.unk_id = proto.TrainerSpec.BPE, len(tokens) + 1, len(tokens)
    spec.bos_id = spec.eos_id = spec.pad_id = -1
    spec.unk_piece = "<unk>"
    rules = model.normalizer_spec
    rules.name, rules.precompiled_charsmap = "identity", b""
    rules.add_dummy_prefix = rules.remove_extra_whitespaces = rules.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encodes texts to ids and ids to bytes."""

    def __init__(self, tokens: list[bytes], pattern: str = public_tokenizers.PATTERN, model: bytes | None = None):
        self.tokens = tokens
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model or build_model(tokens))
        self.find = regex.compile(pattern).findall
        self.chars = dict(enumerate(byte_characters()))
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        parts = self.find(text)
        known = self.known
        new = list({p for p in parts if p not in known})
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(parts))
            mapped = [p.encode("utf-8", "replace").decode("latin-1").translate(self.chars) for p in new]
            known.update(zip(new, self.pieces.encode(mapped, num_threads=1), strict=True))
        ids: list[int] = []
        extend = ids.extend
        for p in parts:
            extend(known[p])
        for p in new:
            if len(p) > REMEMBERED_LENGTH:
                known.pop(p, None)
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def worker_codec(path: str) -> Codec:
    """The codec of a Python worker, which its tasks share one after another."""
    return Codec(read_ranks(path))


def encode_documents(docs: DataFrame, path: str, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id) with ids (binary: little-endian unsigned 32-bit integers) and decoded (binary).

    A null text counts as empty: no ids. Repeated rows get equal results. Texts and pre-tokens may be of any length.
    `path` names the vocabulary's file, which every node has.
    """
    carry = carry or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path)
        for batch in text_batches(batches, "text", BATCH_BYTES):
            ids = [codec.encode(t) if t else [] for t in batch.column("text").to_pylist()]
            columns = [pa.array([np.array(x, dtype="<u4").tobytes() for x in ids], pa.binary()), pa.array([codec.decode(x) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *columns], names=[*carry, "ids", "decoded"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, f"{fields}, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """ids and decoded replaced by n_tokens, ids_sha256 and decoded_sha256."""
    rest = [c for c in encoded.columns if c not in ("ids", "decoded")]
    return encoded.selectExpr(*[f"`{c}`" for c in rest], "cast(length(ids) div 4 as bigint) AS n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with the digests of the ids and of what they decode to."""
    encoded = encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path(VOCABULARY), ["doc_id", "source"])
    found = "cast(length(ids) div 4 as bigint) AS n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256"
    return encoded.selectExpr("doc_id", "source", "ids", *found)
