"""Versioned reads, schemas and table upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_version(df: DataFrame, keys: Sequence[str], version: Sequence[str], deleted: str = "is_deleted") -> DataFrame:
    """The newest row of each key by the version columns, without keys whose newest row is a tombstone.

    One shuffle by key. Filters on key columns can be applied before; others only after, or an older row would come back.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(v) for v in version])
    ranked = df.withColumn("__rank", F.row_number().over(newest)).filter("__rank = 1").drop("__rank")
    return ranked.filter(F.coalesce(F.col(deleted), F.lit(0)) == 0)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of the schema: missing ones null, others cast; what is not in the schema goes."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def with_retention(df: DataFrame, column: str, as_of: str, days: int = 90) -> DataFrame:
    """Rows no older than `days` at as_of; 0 keeps all, 1 to 6 is refused."""
    if 0 < days < 7:
        raise ValueError("retention is 0 (keep all) or at least 7 days")
    return df.filter(F.to_date(column) >= F.date_sub(F.lit(as_of).cast("timestamp").cast("date"), days)) if days else df


def parts_health(df: DataFrame, most: int = 300) -> DataFrame:
    """Files and rows that a scan reads, and whether there are more files than is healthy."""
    files = df.select(F.input_file_name().alias("file")).groupBy("file").agg(F.count("*").alias("rows"))
    return files.agg(F.count("*").alias("parts"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).withColumn("unhealthy", F.col("parts") > most)


def fk_orphans(facts: Sequence[tuple[DataFrame, str]], dimension: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """Distinct UUID-shaped ids of the fact columns without a dimension row, lower-cased, sorted, the first `most` of them."""
    ids = None
    for df, column in facts:
        own = df.select(F.lower(F.col(column).cast("string")).alias("id"))
        ids = own if ids is None else ids.unionByName(own)
    uuid = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    return ids.filter(F.col("id").rlike(uuid)).distinct().join(dimension.select(F.lower(key).alias("id")), "id", "left_anti").orderBy("id").limit(most)


def content_checksum(df: DataFrame) -> DataFrame:
    """Rows and an order-insensitive checksum of a table."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("checksum"))
