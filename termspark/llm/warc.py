"""WARC archives, compressed record by record with a Zstandard dictionary of their own.

Each archive starts with a skippable frame that holds a dictionary built from the archive's first records; every record is
a frame of its own, compressed with it, so a record can be read alone from its offset. Records whose payload has been
archived already are revisit records: they carry the payload's digest and length and name the record they refer to.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspark.llm.archives import commit, committed, new_file, qualified, store
from termspark.llm.common import shared_folder, table, text_batches

#: The magic number of the skippable frame that holds a dictionary, and that of Zstandard's frames.
DICTIONARY_MAGIC = 0x184D2A5D
#: Payloads below so many bytes are always stored.
LEAST_REVISIT = 100
DICTIONARY_BYTES = 64 << 10
#: The dictionary is built from the records that come first, up to so many bytes.
SAMPLE_BYTES = 2 << 20
#: A new archive is begun beyond so many bytes.
ARCHIVE_BYTES = 1 << 30
DATE = "2000-01-01T00:00:00Z"
_READ = 1 << 20


def plan(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, refers_to: the page whose record holds the payload, or null for those that are stored."""
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    big = F.octet_length(F.coalesce("html", F.lit(""))) >= least
    first = pages.where(big).groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    known = pages.select("page_id", "url", "html", digest.alias("digest")).join(first, "digest", "left")
    return known.select("page_id", "url", "html", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(value: str) -> str:
    """A header value without line ends."""
    return "".join(c if c.isprintable() and not c.isspace() else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url or f'urn:page:{page_id}')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary of the records; where they are too few or too small to train on, their last bytes serve as content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:] or b"WARC/1.1"


class Writer:
    """One archive: takes records, gives (offset, length) of each."""

    def __init__(self, folder: str, sample: list[bytes]):
        self.name, fs, path = new_file(folder, ".warc.zst")
        self.file = fs.open_output_stream(path, compression=None)
        dictionary = build_dictionary(sample)
        self.file.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        self.offset = 8 + len(dictionary)
        self.pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)

    def add(self, data: bytes) -> tuple[int, int]:
        frame = self.pack.compress(data)
        self.file.write(frame)
        at, self.offset = self.offset, self.offset + len(frame)
        return at, len(frame)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive the rows of plan(); page_id, archive, offset, length of every record. One archive or more per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: Writer | None = None
        waiting: list[tuple[int | None, bytes]] = []
        held = 0

        def flush(rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            nonlocal writer
            out = []
            for page_id, data in rows:
                if writer is not None and writer.offset > archive_bytes:
                    writer.file.close()
                    writer = None
                writer = writer or Writer(folder, [d for _, d in rows])
                out.append((page_id, writer.name, *writer.add(data)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), *[pa.array([r[k] for r in out], pa.int64()) for k in (2, 3)]], names=["page_id", "archive", "offset", "length"])

        for batch in text_batches(batches, "html", SAMPLE_BYTES):
            htmls = batch.column("html").cast(pa.binary()).to_pylist()
            for page_id, url, html, ref in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url")), htmls, batch.column("refers_to").to_pylist(), strict=True):
                data = record(page_id, url, html or b"", ref)
                waiting.append((page_id, data))
                held += len(data)
                if held >= SAMPLE_BYTES:
                    yield flush(waiting)
                    waiting, held = [], 0
        if waiting:
            yield flush(waiting)
        if writer is not None:
            writer.file.close()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "page_id bigint, archive string, offset bigint, length bigint")


def frames(data: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the frames of an archive read in chunks; the leading dictionary is used and not returned."""
    source = iter(data)
    buffer, base = b"", 0

    def fill(n: int) -> bool:
        nonlocal buffer
        while len(buffer) < n:
            more = next(source, b"")
            if not more:
                return False
            buffer += more
        return True

    if not fill(8):
        return
    magic, size = struct.unpack("<II", buffer[:8])
    if magic != DICTIONARY_MAGIC or not fill(8 + size):
        raise ValueError("the archive does not start with a dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(buffer[8 : 8 + size]))
    buffer, base = buffer[8 + size :], 8 + size
    while fill(1):
        part, parts, at = unpack.decompressobj(), [], 0
        while True:
            parts.append(part.decompress(buffer[at:]))
            if part.eof:
                break
            at = len(buffer)
            if not fill(at + 1):
                raise ValueError(f"the archive ends within the frame at {base}")
        used = len(buffer) - len(part.unused_data)
        yield base, b"".join(parts)
        buffer, base = buffer[used:], base + used


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version!r}")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    return headers, rest[: int(headers["content-length"])]


def _page(identifier: str | None) -> int | None:
    number = (identifier or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive, offset of every record in the folder.

    Length and digest come from the payload of a response and are checked against its header; those of a revisit come from
    its header. One task reads one archive.
    """
    names = [(n,) for n, _ in committed(folder)]
    fields = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, archive string, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    rows = []
                    for offset, data in frames(iter(lambda f=f: f.read(_READ), b"")):
                        headers, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        if headers["warc-type"] == "response":
                            size = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{name} at {offset}: the payload differs from its digest")
                        else:
                            size = int(http.rpartition(b"Content-Length: ")[2])
                        rows.append((_page(headers["warc-record-id"]), size, digest, headers["warc-type"], _page(headers.get("warc-refers-to")), headers["warc-target-uri"], name, offset))
                        if len(rows) >= 4096:
                            yield to_batch(rows)
                            rows = []
                    if rows:
                        yield to_batch(rows)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    labels = [f.split()[0] for f in fields.split(", ")]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=labels)

    files = spark.createDataFrame(names, "archive string").repartition(max(1, len(names)))
    return files.mapInArrow(run, fields)


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into the folder and read all of them back.

    A null html is an empty payload; a null url is replaced by a name made of the page_id; a null page_id has an empty
    record id. Rows that repeat the smallest page_id of a payload are responses too. Other columns are ignored; an empty
    table gives no archive and no rows.
    """
    planned = plan(pages)
    folder = qualified(pages.sparkSession, folder)
    commit(folder, write_archives(planned, folder))
    return read_archives(pages.sparkSession, folder)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_pages(table(spark, sf_dir, "pages"), shared_folder(spark))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""
