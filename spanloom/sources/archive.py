"""Archives of tables by month or day: export with a manifest, checked and resumable import, reconciliation, selective compaction.

An archive is a folder with `data`, Parquet partitioned by `part`, and `manifest`, to which each export or import adds a row a part
that it wrote: row count, checksum whatever the order, first and last time, and when it was recorded; the last row counts. Both
ends keep one, so an import knows what it has; parts are written by dynamic overwrite and recorded afterwards, so a part that
broke off is written anew and none twice. There are as many parts as months or days; rows never pass the driver.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

#: A part with more files is compacted (a fixed value).
MOST_FILES = 300
_COLUMNS = ["part", "row_count", "checksum", "first_time", "last_time"]
_MANIFEST = "part int, row_count long, checksum string, first_time timestamp_ntz, last_time timestamp_ntz, recorded long"


def month(at: str) -> Column:
    return F.date_format(at, "yyyyMM").cast("int")


def day(at: str) -> Column:
    return F.date_format(at, "yyyyMMdd").cast("int")


def _manifest_of(data: DataFrame, at: str) -> DataFrame:
    own = sorted(c for c in data.columns if c != "part")
    checksum = F.sum(F.xxhash64(*own).cast("decimal(38,0)")).cast("string")
    when = F.col(at).cast("timestamp_ntz")
    return data.groupBy("part").agg(F.count("*").alias("row_count"), checksum.alias("checksum"), F.min(when).alias("first_time"), F.max(when).alias("last_time"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each part; empty where there is none."""
    try:
        every = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:
        every = spark.createDataFrame([], _MANIFEST)
    last = every.groupBy("part").agg(F.max_by(F.struct(*_COLUMNS[1:]), "recorded").alias("m"))
    return last.select("part", "m.*")


def _record(rows: DataFrame, path: str) -> None:
    stamped = rows.select(*_COLUMNS).withColumn("recorded", F.lit(time.time_ns()))
    stamped.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def data(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/data")


def _write(df: DataFrame, path: str, order: Sequence[str], mode: str) -> None:
    """Sorted by part and order over as many tasks as the rows need: a large part has several files, a small one few."""
    dealt = df.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("part").parquet(f"{path}/data")


def export(df: DataFrame, at: str, path: str, part: Column | None = None) -> DataFrame:
    """Writes df as an archive, with the manifest of what can be read back; returns the manifest.

    Rows without a time go to part 0. An archive that is there already gets the parts of df anew and keeps its others.
    """
    parted = df.withColumn("part", F.coalesce(month(at) if part is None else part, F.lit(0)))
    _write(parted, path, [at], "overwrite")
    spark = df.sparkSession
    _record(_manifest_of(data(spark, path, parted.schema), at), path)
    return manifest(spark, path)


def import_missing(spark: SparkSession, source: str, target: str, at: str) -> DataFrame:
    """Copies the source's parts that the target lacks or has in another state; returns part, row_count, state.

    state: present (the target's manifest has the same count and checksum), damaged (the source's rows are not what its manifest
    says; not copied), imported. The target's manifest is written last, so an import that broke off goes on with the parts that
    it had not recorded.
    """
    wanted, own = manifest(spark, source), manifest(spark, target).select("part", "row_count", "checksum")
    known = wanted.join(own.withColumn("present", F.lit(True)), ["part", "row_count", "checksum"], "left").collect()  # a row a month or day
    missing = [r["part"] for r in known if not r["present"]]
    rows = data(spark, source).filter(F.col("part").isin(missing))
    found = {r["part"]: (r["row_count"], r["checksum"]) for r in _manifest_of(rows, at).collect()} if missing else {}
    sound = [r["part"] for r in known if not r["present"] and found.get(r["part"]) == (r["row_count"], r["checksum"])]
    if sound:
        _write(data(spark, source).filter(F.col("part").isin(sound)), target, [at], "overwrite")
        _record(wanted.filter(F.col("part").isin(sound)), target)
    state = lambda r: "present" if r["present"] else "imported" if r["part"] in sound else "damaged"
    return spark.createDataFrame([(r["part"], r["row_count"], state(r)) for r in known], "part int, row_count long, state string")


def reconcile(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two manifests -> part, rows, other_rows, state: equal, missing, extra, count (another number of rows) or content (other rows)."""
    a = one.select("part", F.col("row_count").alias("rows"), "checksum")
    b = other.select("part", F.col("row_count").alias("other_rows"), F.col("checksum").alias("other_checksum"))
    state = F.when(F.col("other_rows").isNull(), "missing").when(F.col("rows").isNull(), "extra").when(F.col("rows") != F.col("other_rows"), "count").when(F.col("checksum") != F.col("other_checksum"), "content").otherwise("equal")
    return a.join(b, "part", "full").select("part", "rows", "other_rows", state.alias("state"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """part, files: the files of each part that hold rows."""
    return data(spark, path).groupBy("part").agg(F.countDistinct("_metadata.file_path").alias("files"))


def compact(spark: SparkSession, path: str, order: Sequence[str], most: int = MOST_FILES) -> DataFrame:
    """Rewrites the parts with more than `most` files, sorted, and leaves the others alone; returns part, before, after, rewritten.

    A part is copied beside the archive first and replaced from there, so it can be read at any time but while files are swapped.
    """
    before = {r["part"]: r["files"] for r in files(spark, path).collect()}
    crowded = [p for p, n in before.items() if n > most]
    if crowded:
        beside = f"{path}/compaction-{uuid.uuid4().hex}"
        _write(data(spark, path).filter(F.col("part").isin(crowded)), beside, order, "append")
        copied = data(spark, beside)
        copied.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("part").parquet(f"{path}/data")
        folder = spark._jvm.org.apache.hadoop.fs.Path(beside)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    after = {r["part"]: r["files"] for r in files(spark, path).collect()}
    return spark.createDataFrame([(p, n, after[p], p in crowded) for p, n in before.items()], "part int, before long, after long, rewritten boolean")
