"""File sources and sinks.

Outputs go under the session's shared checkpoint folder unless a path is
given; every write is a whole-table Spark job (no driver-side rows).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardsight.session import checkpoint_dir

# Raw transaction feed with text times (the incoming-transaction fields).
TXN_TEXT_SCHEMA = T.StructType([
    T.StructField("trans_num", T.StringType()),
    T.StructField("cc_num", T.LongType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("job", T.StringType()),
    T.StructField("amt", T.DoubleType()),
    T.StructField("state", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()),
    T.StructField("merch_lat", T.DoubleType()),
    T.StructField("merch_long", T.DoubleType()),
    T.StructField("city_pop", T.IntegerType()),
    T.StructField("is_fraud", T.IntegerType()),
    T.StructField("fraud_score", T.DoubleType()),
    T.StructField("trans_date_trans_time", T.StringType()),
    T.StructField("dob", T.StringType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/cardsight-out/{name}-{uuid.uuid4().hex[:12]}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TXN_TEXT_SCHEMA) -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass);
    input splits replace the row chunks. Columns are matched by position,
    so files must be written in schema order."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, compression: str = "snappy") -> str:
    """Parquet sink."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return path


def written(df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    """``df`` written to a scratch folder and read back (under ``schema``, if given): a table that several passes read. Unlike
    a checkpoint it is stored by column and compressed, a pass reads its own columns only, and Spark knows its bytes."""
    return df.sparkSession.read.schema(schema or df.schema).parquet(write_parquet(df, scratch_path(df.sparkSession, name), "zstd"))


def write_by_state(df: DataFrame, path: str, key: str = "state") -> str:
    """One folder per state. Rows are rebalanced by state before the
    write: AQE gathers small states and splits a hot one over several tasks."""
    (df.hint("rebalance", F.col(key)).write.mode("overwrite").option("maxRecordsPerFile", 5_000_000)
       .partitionBy(key).parquet(path))
    return path


def partition_counts(spark: SparkSession, path: str, key: str = "state") -> DataFrame:
    """Rows per state of a partitioned table."""
    return spark.read.parquet(path).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def partition_values(spark: SparkSession, path: str, key: str = "state") -> DataFrame:
    """Sorted states present (partition column only: no data files are
    read beyond their footers)."""
    return spark.read.parquet(path).select(key).distinct().orderBy(key)


def export_csv(table: DataFrame, path: str, limit: int = 1000, order_col: str = "trans_num") -> DataFrame:
    """The first ``limit`` rows (stable order) as CSV; ids as 32-digit
    hex when they are UUIDs; an empty export is an error. Returns the
    exported rows as read back."""
    from cardsight.operators.filters import normalise_id
    rows = table.orderBy(order_col).limit(limit)
    if "trans_num" in rows.columns:
        rows = rows.withColumn("trans_num", normalise_id(F.col("trans_num")))
    if not rows.limit(1).take(1):
        raise LookupError("nothing to export: the table has no rows")
    write_csv(rows, path)
    return table.sparkSession.read.option("header", True).schema(rows.schema).csv(path)


def save_lookups(path: str, **tables: DataFrame) -> dict[str, str]:
    """Every lookup table (encodings, rates) as Parquet."""
    out = {}
    for name, df in tables.items():
        out[name] = write_parquet(df, f"{path}/{name}")
    return out


def load_lookups(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(p) for name, p in paths.items()}
