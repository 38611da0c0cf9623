"""Media columns: a Spark data source over folders of archives.

An archive is a file of members, each a header (name and length) and its bytes, then an index of the members' offsets and a
footer. The data source `archive` plans byte ranges of the committed archives; a range reads the members that begin in it,
in batches through Arrow, and tries each member again on its own, from its offset, if it fails.

The payloads here are texts as 8-bit greyscale images, 64 samples wide, in PNG form.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from termspark.llm.archives import commit, committed, new_file, qualified, store
from termspark.llm.common import shared_folder, table, text_batches

WIDTH = 64
#: PNG's signature, and the header of a greyscale image of eight bits.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_MEMBER, _FOOTER = "<qqI", "<qq4s"
_NO_ID, _MAGIC = -(1 << 63), b"MARC"
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3


def pad(data: bytes) -> bytes:
    """Zeros appended up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """A greyscale image of rows of WIDTH samples; rows are not filtered."""
    rows = len(samples) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), dtype=np.uint8)
    raw[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png wrote; checks every chunk."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, width, height, data = 8, 0, 0, []
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit greyscale image")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def write_members(docs: DataFrame, folder: str, encode: Callable[[bytes], bytes]) -> DataFrame:
    """Archive encode(text) of each row under its doc_id; archive, members and bytes of each archive (one per partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, offset, index = None, "", 0, []
        for batch in text_batches(batches, "text", BATCH_BYTES):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if file is None:
                    name, fs, path = new_file(folder, ".members")
                    file = fs.open_output_stream(path)
                data = text or b""
                media = encode(data)
                file.write(struct.pack(_MEMBER, _NO_ID if doc_id is None else doc_id, len(data), len(media)) + media)
                index.append(offset)
                offset += struct.calcsize(_MEMBER) + len(media)
        if file is not None:
            file.write(np.array(index, dtype="<i8").tobytes() + struct.pack(_FOOTER, offset, len(index), _MAGIC))
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([offset], pa.int64())], names=["archive", "members", "bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, "archive string, members bigint, bytes bigint")


class Range(InputPartition):
    def __init__(self, archive: str, size: int, start: int, end: int):
        self.archive, self.size, self.start, self.end = archive, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, split: int, attempts: int):
        self.folder, self.split, self.attempts = folder, split, attempts

    def partitions(self) -> list[InputPartition]:
        """Byte ranges of the archives, from their names and sizes alone."""
        return [Range(name, size, at, min(at + self.split, size)) for name, size in committed(self.folder) for at in range(0, size, self.split)] or [Range("", 0, 0, 0)]

    def member(self, open_: Callable, offset: int) -> tuple:
        """(doc_id, offset, n_bytes, media, error) of the member at an offset; each attempt opens the archive anew."""
        error = None
        for _ in range(self.attempts):
            try:
                with open_() as f:
                    f.seek(offset)
                    doc_id, n_bytes, size = struct.unpack(_MEMBER, f.read(struct.calcsize(_MEMBER)))
                    media = f.read(size)
                    if len(media) != size:
                        raise OSError(f"{size} bytes expected, {len(media)} read")
                    return (None if doc_id == _NO_ID else doc_id, offset, n_bytes, media, None)
            except (OSError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
        return (None, offset, None, None, error)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        fs, path = store(self.folder)
        open_ = lambda: fs.open_input_file(f"{path}/{partition.archive}")
        with open_() as f:
            f.seek(partition.size - struct.calcsize(_FOOTER))
            begin, count, magic = struct.unpack(_FOOTER, f.read(struct.calcsize(_FOOTER)))
            if magic != _MAGIC:
                raise ValueError(f"{partition.archive} has no index")
            f.seek(begin)
            offsets = np.frombuffer(f.read(8 * count), dtype="<i8")
            low, high = np.searchsorted(offsets, [partition.start, partition.end])
            rows, held = [], 0
            for offset in offsets[low:high].tolist():
                row = self.member(lambda: _Keep(f), offset)
                if row[4] is not None:
                    row = self.member(open_, offset)
                rows.append(row)
                held += len(row[3] or b"")
                if held >= BATCH_BYTES:
                    yield self.batch(partition.archive, rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(partition.archive, rows)

    @staticmethod
    def batch(archive: str, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(rows)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["archive", "doc_id", "offset", "n_bytes", "media", "error"])


class _Keep:
    """Lends an open file without closing it."""

    def __init__(self, file):
        self.file = file

    def __enter__(self):
        return self.file

    def __exit__(self, *_):
        return None


class ArchiveSource(DataSource):
    """spark.read.format("archive").load(folder): archive, doc_id, offset, n_bytes, media, error of every member.

    Options: splitBytes, the length of a byte range; attempts per member. A member that fails each time has its error and
    no media; the others of its range are read.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, doc_id bigint, offset bigint, n_bytes bigint, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)), int(self.options.get("attempts", ATTEMPTS)))


def feature(samples: bytes) -> str:
    """Shares of sixteen equal ranges of sample values, in thousandths, and the mean."""
    values = np.frombuffer(samples, dtype=np.uint8)
    shares = np.bincount(values >> 4, minlength=16) * 1000 // max(len(values), 1)
    return ",".join(map(str, shares.tolist())) + f";{int(values.sum(dtype=np.int64)) * 1000 // max(len(values), 1)}"


def describe(members: DataFrame) -> DataFrame:
    """Digests and features of members of the archive source, from the bytes as they were read back."""
    fields = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, media, error in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "error")), strict=True):
                if error is not None:
                    raise OSError(error)
                payload = from_png(media)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return members.select("doc_id", "n_bytes", "media", "error").mapInArrow(run, fields)


def media_column(docs: DataFrame, folder: str) -> DataFrame:
    """Store each text (null: empty) as an image in the folder's archives, and read the members back.

    Repeated rows are members of their own; a null doc_id stays null. Other columns are ignored. An empty table gives no
    archive and no rows.
    """
    spark = docs.sparkSession
    folder = qualified(docs.sparkSession, folder)
    commit(folder, write_members(docs, folder, lambda data: to_png(pad(data))))
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").load(folder)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(media_column(table(spark, sf_dir, "documents"), shared_folder(spark)))
