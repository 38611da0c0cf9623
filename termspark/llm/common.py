"""What the operators of this subpackage share: reading tables, bounded broadcasts, row keys, byte-limited Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termspark.sources import cut, discard, shared_folder

__all__ = ["BROADCAST_BYTES", "WORD", "bounded", "cut", "discard", "partitions", "row_key", "shared_folder", "table", "text_batches"]

#: A word is a run of characters other than space, tab, LF, VT, FF and CR. bytes.split() splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A side of a join is broadcast if its rows take so many bytes at most; beyond that the join is shuffled.
BROADCAST_BYTES = 48 << 20


def bounded(df: DataFrame, row_bytes: Column) -> DataFrame:
    """df, marked for broadcast if the sum of row_bytes over its rows, which is computed, is BROADCAST_BYTES at most."""
    held = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def partitions(spark: SparkSession) -> int:
    """The number of partitions for work that is heavier than its input's bytes tell."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str) -> Column:
    """A struct that tells rows apart by id and text; it is never null, so that rows with null ids join as well."""
    first, *rest = cols
    return F.struct(
        F.coalesce(F.col(first), F.lit(-(1 << 62))).alias("id"),
        *[F.xxhash64(F.coalesce(F.col(c), F.lit("\x00"))).alias(f"h{i}") for i, c in enumerate(rest)],
    )


def text_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `limit` bytes at most (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
