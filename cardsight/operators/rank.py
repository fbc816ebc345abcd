"""Global ordering operators that do not funnel the table through one task.

A window with ``orderBy`` but no ``partitionBy`` runs in a single task. The
helpers here scan in two levels instead: rows are range-partitioned on the
ordering key and sorted, each partition takes its own running values in one
streaming pass, and what all earlier partitions hold is added to them. The rows are
shuffled once and written once. The driver sees one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardsight.session import checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id << 33 | row index


def _ranged(df: DataFrame, cols: list[Column], num_partitions: int | None) -> DataFrame:
    """Range partitions on the order, sorted, with each row's place; their number is Spark's (and AQE's) unless given."""
    dealt = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    return dealt.sortWithinPartitions(*cols).withColumn("_cs_mid", F.monotonically_increasing_id())


def _sort_cols(order_cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_cols]


def _before(placed: DataFrame, values: dict[str, Column]) -> tuple[DataFrame, dict]:
    """(what the partitions before each one hold, one row per partition; the totals)."""
    got = sorted(placed.groupBy(F.shiftright("_cs_mid", _LOCAL_BITS).alias("_cs_pid"))
                 .agg(*[v.alias(c) for c, v in values.items()]).collect())
    held, rows = dict.fromkeys(values, 0), []
    for r in got:
        rows.append((r["_cs_pid"], *held.values()))
        held = {c: held[c] + (r[c] or 0) for c in values}
    types = dict(placed.groupBy().agg(*[v.alias(c) for c, v in values.items()]).dtypes)
    schema = "_cs_pid long, " + ", ".join(f"`_cs_o_{c}` {types[c]}" for c in values)
    fit = {c: float if types[c] == "double" else int for c in values}
    rows = [(pid, *(fit[c](x) for c, x in zip(values, xs))) for pid, *xs in rows]
    return F.broadcast(placed.sparkSession.createDataFrame(rows, schema)), held


def global_row_number(df: DataFrame, order_cols, name: str = "rn",
                      num_partitions: int | None = None, total_name: str | None = None) -> DataFrame:
    """1-based ``row_number()`` over ``order_cols`` for the whole table.

    ``order_cols`` must be a total order (end with a unique key) so that a
    recomputed partition numbers its rows identically. The ranged, sorted,
    numbered table is checkpointed into the session's checkpoint folder: the
    per-partition counts and the rows then come from one materialisation.
    """
    checkpoint_dir(df.sparkSession)
    placed = _ranged(df, _sort_cols(order_cols), num_partitions).checkpoint(eager=True)
    offsets, held = _before(placed, {"n": F.count(F.lit(1))})
    local = F.col("_cs_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    out = (placed.withColumn("_cs_pid", F.shiftright("_cs_mid", _LOCAL_BITS)).join(offsets, "_cs_pid")
           .withColumn(name, F.col("_cs_o_n") + local + F.lit(1)))
    if total_name:
        out = out.withColumn(total_name, F.lit(held["n"]).cast("bigint"))
    return out.drop("_cs_mid", "_cs_pid", "_cs_o_n")


def _with_local_sums(placed: DataFrame, sum_cols: list[str]) -> DataFrame:
    """Running sums within each partition (``_cs_in_<col>``), in one pass over its batches."""
    types = {f.name: f.dataType for f in placed.schema}
    whole = {c: isinstance(types[c], (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for c in sum_cols}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: 0 if whole[c] else 0.0 for c in sum_cols}
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = []
            for c in sum_cols:
                kind = pa.int64() if whole[c] else pa.float64()
                values = pc.fill_null(batch.column(c).cast(kind), 0).to_numpy(zero_copy_only=False)
                running = np.cumsum(values) + held[c]
                held[c] = running[-1]
                sums.append(pa.array(running, kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], names=[*batch.schema.names,
                                                                             *(f"_cs_in_{c}" for c in sum_cols)])

    added = [T.StructField(f"_cs_in_{c}", T.LongType() if whole[c] else T.DoubleType()) for c in sum_cols]
    return placed.mapInArrow(run, T.StructType([*placed.schema.fields, *added]))


def _running(df: DataFrame, order_cols, sum_cols: list[str], suffix: str, num_partitions: int | None) -> tuple[DataFrame, dict]:
    """``df`` with running sums and each row's place (``_cs_mid``, ascending in the order); the totals."""
    checkpoint_dir(df.sparkSession)
    placed = _with_local_sums(_ranged(df, _sort_cols(order_cols), num_partitions), sum_cols).checkpoint(eager=True)
    offsets, held = _before(placed, {c: F.sum(c) for c in sum_cols})
    out = placed.withColumn("_cs_pid", F.shiftright("_cs_mid", _LOCAL_BITS)).join(offsets, "_cs_pid")
    out = out.withColumns({c + suffix: F.col(f"_cs_o_{c}") + F.col(f"_cs_in_{c}") for c in sum_cols})
    return out.drop("_cs_pid", *[f"_cs_o_{c}" for c in sum_cols], *[f"_cs_in_{c}" for c in sum_cols]), held


def global_running_sums(df: DataFrame, order_cols, sum_cols: list[str], suffix: str = "_cum",
                        num_partitions: int | None = None, totals: bool = False) -> DataFrame:
    """Running totals of ``sum_cols`` (numbers; null counts as 0) over ``order_cols``
    (rows unbounded preceding .. current row) for the whole table; with ``totals``
    also the grand total of each column (``<col>_total``)."""
    out, held = _running(df, order_cols, sum_cols, suffix, num_partitions)
    if totals:
        types = dict(out.dtypes)
        out = out.withColumns({c + "_total": F.lit(held[c]).cast(types[c + suffix]) for c in sum_cols})
    return out.drop("_cs_mid")


def running_sums_by(df: DataFrame, key: str, order_cols, sum_cols: list[str], suffix: str = "_cum",
                    num_partitions: int | None = None) -> DataFrame:
    """Running totals of ``sum_cols`` within each ``key`` group.

    A ``partitionBy(key)`` window would put a hot key in one task. Instead
    the running sums run over the global order (key, order_cols) and what precedes each
    key's first row (a grouped ``min_by``, one row per key) is subtracted. Rows without a
    key are a group of their own."""
    cum, _ = _running(df, [F.col(key).asc_nulls_first(), *order_cols], sum_cols, suffix, num_partitions)
    first = F.struct(*[(F.col(c + suffix) - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sum_cols])
    starts = (cum.groupBy(F.col(key).alias("_cs_key")).agg(F.min_by(first, "_cs_mid").alias("f"))
              .select("_cs_key", *[F.col(f"f.{c}").alias(f"_cs_s_{c}") for c in sum_cols]))
    out = cum.join(starts, cum[key].eqNullSafe(starts["_cs_key"]))
    for c in sum_cols:
        out = out.withColumn(c + suffix, F.col(c + suffix) - F.col(f"_cs_s_{c}"))
    return out.drop("_cs_key", "_cs_mid", *[f"_cs_s_{c}" for c in sum_cols])


def quantile_bin(rank: Column, n: Column, bins: int) -> Column:
    """Equal-frequency bin of a 1-based rank among n rows.

    Bin edges sit at ``1 + j (n - 1) / bins``; a rank falls in the first bin
    whose upper edge it does not exceed (lowest edge included). This equals
    quantile cutting of the ranks, which ``ntile`` does not when n is not a
    multiple of ``bins``.
    """
    raw = F.ceil(F.lit(bins) * (rank - F.lit(1)) / (n - F.lit(1))) - F.lit(1)
    return F.when(n <= F.lit(1), F.lit(0)).otherwise(F.greatest(F.lit(0), raw)).cast("int")
