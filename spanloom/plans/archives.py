"""Archive jobs over the driver tables, written to the shared folder and read back, and SQL for what they have to report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.sources import archive
from spanloom.sources.views import Views, checked_by
from spanloom.streaming.jobs import sink_folder


def exported(v: Views) -> DataFrame:
    found = archive.export(v.scores.filter("is_deleted = 0"), "timestamp", sink_folder(v.spark))
    return found.select(F.col("part").alias("month"), "row_count", "first_time", "last_time")


def imported(v: Views) -> DataFrame:
    """A second run of an import that broke off: even months are there; the first month has rows that its manifest doesn't know."""
    folder = sink_folder(v.spark)
    scores = v.scores
    archive.export(scores, "timestamp", f"{folder}/a")
    archive.export(scores.filter(F.month("timestamp") % 2 == 0), "timestamp", f"{folder}/b")
    data = archive.data(v.spark, f"{folder}/a")
    first = data.agg(F.min("part")).first()[0]
    data.filter(F.col("part") == first).write.mode("append").partitionBy("part").parquet(f"{folder}/a/data")
    report = archive.import_missing(v.spark, f"{folder}/a", f"{folder}/b", "timestamp")
    there = archive.data(v.spark, f"{folder}/b").groupBy("part").agg(F.count("*").alias("there"))
    return report.join(there, "part", "left").select("part", "row_count", "state", F.coalesce("there", F.lit(0)).alias("there"))


def reconciled(v: Views) -> DataFrame:
    """The traces against a copy: of one month a row is missing, of one month a name differs, one month is not there, one is new."""
    folder = sink_folder(v.spark)
    traces = v.traces.select("trace_id", "name", "start_time", F.month("start_time").alias("m"), F.year("start_time").alias("y"))
    other = traces.filter("not (y = 1996 and m = 3)")
    least = traces.filter("y = 1996 and m = 6").agg(F.min("trace_id")).first()[0]
    changed = F.when((F.col("trace_id") == least), "changed").otherwise(F.col("name"))
    gone = traces.filter("y = 1997 and m = 5").agg(F.min("trace_id")).first()[0]
    other = other.filter(F.col("trace_id") != F.lit(gone)).withColumn("name", changed).unionByName(traces.limit(1).withColumn("start_time", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")))
    one = archive.export(traces.drop("m", "y"), "start_time", f"{folder}/one")
    return archive.reconcile(one, archive.export(other.drop("m", "y"), "start_time", f"{folder}/other"))


def compacted(v: Views) -> DataFrame:
    """Events by day, odd days in nine files each: these are rewritten, the others stay; no row is lost."""
    folder = sink_folder(v.spark)
    events = v.events.withColumn("part", archive.day("ts"))
    events.filter("part % 2 = 1").repartition(9).write.partitionBy("part").parquet(f"{folder}/data")
    events.filter("part % 2 = 0").coalesce(1).write.mode("append").partitionBy("part").parquet(f"{folder}/data")
    report = archive.compact(v.spark, folder, ["ts", "event_id"], most=4)
    kept = archive.data(v.spark, folder).groupBy("part").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("ids"))
    return report.join(kept, "part").select("part", "rewritten", (F.col("after") < F.col("before")).alias("fewer"), "rows", "ids")


QUERIES = {"export_monthly_parquet": exported, "import_partitions": imported, "row_count_reconcile": reconciled, "compact_partitions": compacted}

ORACLES = {
    name: checked_by(text)
    for name, text in {
        "export_monthly_parquet": "select year(timestamp) * 100 + month(timestamp) as month, count(*) as row_count, min(timestamp) as first_time, max(timestamp) as last_time from scores where is_deleted = 0 group by 1",
        "import_partitions": """
            with months as (select year(timestamp) * 100 + month(timestamp) as part, count(*) as row_count from scores group by 1)
            select part, row_count, case when part % 2 = 0 then 'present' when part = (select min(part) from months) then 'damaged' else 'imported' end as state,
                case when part % 2 = 1 and part = (select min(part) from months) then 0 else row_count end as there
            from months""",
        "row_count_reconcile": """
            with months as (select year(start_time) * 100 + month(start_time) as part, count(*) as n from traces group by 1)
            select part, n as rows, case part when 199603 then null when 199705 then n - 1 else n end as other_rows,
                case part when 199603 then 'missing' when 199705 then 'count' when 199606 then 'content' else 'equal' end as state from months
            union all select 203001, null, 1, 'extra'""",
        "compact_partitions": """
            select cast(strftime(ts, '%Y%m%d') as int) as part, day(ts) % 2 = 1 as rewritten, day(ts) % 2 = 1 as fewer, count(*) as rows, count(distinct event_id) as ids
            from events group by 1, 2, 3""",
        "parts_health": "select count(distinct 1) as parts, count(*) as rows, false as unhealthy from events",
    }.items()
}
