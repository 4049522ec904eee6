"""Archives: what is written can be read back, imports go on where they stopped, compaction leaves sound parts alone."""

from datetime import datetime

from pyspark.sql import functions as F

from spanloom.sources import archive


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def table(spark, days):
    return spark.createDataFrame([(i, None if d is None else datetime(2024, m, d), f"x{i}") for i, (m, d) in enumerate(days)], "id long, at timestamp_ntz, name string")


DAYS = [(1, 5), (1, 6), (2, 1), (2, 1), (3, 9), (3, None)]


def test_export_has_a_manifest_and_can_be_done_again(spark, tmp_path):
    first = archive.export(table(spark, DAYS), "at", f"{tmp_path}/a")
    assert rows(first.drop("checksum"), "part") == [(0, 1, None, None), (202401, 2, datetime(2024, 1, 5), datetime(2024, 1, 6)), (202402, 2, datetime(2024, 2, 1), datetime(2024, 2, 1)), (202403, 1, datetime(2024, 3, 9), datetime(2024, 3, 9))]
    before = rows(first, "part")
    assert rows(archive.export(table(spark, DAYS).repartition(3), "at", f"{tmp_path}/a"), "part") == before  # nothing twice, whatever the order
    later = archive.export(table(spark, [(2, 7)]), "at", f"{tmp_path}/a")
    assert [r[:2] for r in rows(later, "part")] == [(0, 1), (202401, 2), (202402, 1), (202403, 1)]  # a part is written anew, the others stay
    assert rows(archive.export(table(spark, DAYS).limit(0), "at", f"{tmp_path}/none")) == []


def test_an_import_goes_on_and_reports_damage(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    archive.export(table(spark, DAYS), "at", a)
    # an import that broke off: a part was written, but not recorded; another was recorded in an older state
    archive.data(spark, a).filter("part = 202401").write.partitionBy("part").parquet(f"{b}/data")
    archive._record(archive.manifest(spark, a).filter("part = 202402").withColumn("checksum", F.lit("old")), b)
    archive.data(spark, a).filter("part = 202403").write.mode("append").partitionBy("part").parquet(f"{a}/data")
    assert rows(archive.import_missing(spark, a, b, "at"), "part") == [(0, 1, "imported"), (202401, 2, "imported"), (202402, 2, "imported"), (202403, 1, "damaged")]
    assert rows(archive.data(spark, b).groupBy("part").count(), "part") == [(0, 1), (202401, 2), (202402, 2)]
    assert {r[2] for r in rows(archive.import_missing(spark, a, b, "at").filter("part <> 202403"))} == {"present"}
    assert rows(archive.reconcile(archive.manifest(spark, a), archive.manifest(spark, b)), "part") == [(0, 1, 1, "equal"), (202401, 2, 2, "equal"), (202402, 2, 2, "equal"), (202403, 1, None, "missing")]


def test_manifests_differ_in_count_and_content(spark, tmp_path):
    one = archive.export(table(spark, DAYS), "at", f"{tmp_path}/a")
    other = archive.export(table(spark, DAYS[:3] + [(4, 1)] + DAYS[4:]).withColumn("name", F.when(F.col("id") == 4, "y").otherwise(F.col("name"))), "at", f"{tmp_path}/b")
    assert [r[3] for r in rows(archive.reconcile(one, other), "part")] == ["equal", "equal", "count", "content", "extra"]


def test_compaction_rewrites_crowded_parts_only(spark, tmp_path):
    parted = spark.range(400).select("id", F.when(F.col("id") < 300, 1).otherwise(2).alias("part"))
    parted.filter("part = 1").repartition(12).write.partitionBy("part").parquet(f"{tmp_path}/data")
    parted.filter("part = 2").coalesce(1).write.mode("append").partitionBy("part").parquet(f"{tmp_path}/data")
    untouched = {r[0] for r in rows(archive.data(spark, str(tmp_path)).filter("part = 2").select("_metadata.file_path").distinct())}
    [(_, before, after, _), other] = rows(archive.compact(spark, str(tmp_path), ["id"], most=11), "part")
    assert before == 12 and after < 12 and other == (2, 1, 1, False)
    assert {r[0] for r in rows(archive.data(spark, str(tmp_path)).filter("part = 2").select("_metadata.file_path").distinct())} == untouched
    assert rows(archive.data(spark, str(tmp_path)).groupBy("part").agg(F.count("*"), F.sum("id")), "part") == [(1, 300, sum(range(300))), (2, 100, sum(range(300, 400)))]
    assert [p.name for p in tmp_path.iterdir()] == ["data"]
