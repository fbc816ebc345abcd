"""Helpers that the operators share: table reads, tables cut from lineage, size-checked joins, Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardsight.session import checkpoint_dir, ship_package

# Bytes that a broadcast side may take as rows of numbers; beyond them the join is left to the optimizer.
BROADCAST_BYTES = 8 << 20

# Bytes of the Arrow batches that a worker is given (of one row at least), however long the rows are.
BATCH_BYTES = 2 << 20

# ASCII white space: what separates words in every operator here.
WORD_GAP = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    The written table cuts the lineage: later stages and retries read it
    instead of computing ``df`` again.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder (set from the session when it names one)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_small(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a side of numbers that is usually small: broadcast when its counted rows take ``max_bytes`` or less.

    ``small`` should be a written or checkpointed table, as it is counted first.
    Beyond the bound the join shuffles, and AQE splits skewed keys.
    """
    max_rows = max_bytes // (8 * len(small.columns) + 32)  # a hashed row: its numbers, its header, its place in the table
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return left.join(small, on, how)


def arrow_ready(spark: SparkSession) -> None:
    """What a plan with Arrow workers needs: this package on the executors, and batches bounded by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
             ) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors, over batches of bounded bytes."""
    arrow_ready(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch on its own; partitions keep their order and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
    return in_arrow(df, run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, with null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def text_slices(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text (of one row at least), in order."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])
