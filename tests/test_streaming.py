"""Streams give what the batch operators give on the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.operators import sequences
from spanloom.streaming import jobs

T0 = datetime(2024, 1, 1)


@pytest.fixture
def run(spark, tmp_path):
    """Writes each table as files and drains a stream over them into memory."""

    def drain(*tables, job, mode="append"):
        sources = []
        for i, df in enumerate(tables):
            df.coalesce(1).write.parquet(f"{tmp_path}/in{i}")
            sources.append(jobs.read_stream(spark, df.schema, f"{tmp_path}/in{i}"))
        name = f"out_{tmp_path.name.replace('-', '_')}"
        query = job(*sources).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    return drain


def shuffled_files(spark, tmp_path, rows, schema, last):
    """Rows at random over six files, none older than the watermark, and a last event that lets it pass them all; three triggers."""
    draw = random.Random(8)
    own = [draw.randrange(6) for _ in rows]
    for i in range(6):
        part = [r for r, o in zip(rows, own) if o == i] + ([last] if i == 5 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return jobs.read_stream(spark, spark.createDataFrame([], schema).schema, f"{tmp_path}/in/*", files=2)


def drained(spark, tmp_path, stream):
    progress = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    progress.awaitTermination()
    assert sum(p.numInputRows > 0 for p in progress.recentProgress) == 3
    return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))


def test_directories_as_in_batch_whatever_the_files(spark, tmp_path):
    draw = random.Random(9)
    schema = "cwd string, id long, at timestamp, session_id string"
    rows = [(draw.choice(["/a", "/b", None]), i, T0 + timedelta(minutes=draw.randrange(300), microseconds=draw.randrange(3)), draw.choice([None, None, "s1", "s2"])) for i in range(300)]
    stream = shuffled_files(spark, tmp_path, rows, schema, ("/z", 999, T0 + timedelta(days=3), None))
    batch = sequences.sessionize_by_cwd(spark.createDataFrame(rows, schema))
    assert drained(spark, tmp_path, jobs.stream_sessionize_by_cwd(stream, delay="1 day")) == sorted(map(tuple, batch.collect()))


def test_alarms_as_in_batch_whatever_the_files(spark, tmp_path):
    draw = random.Random(10)
    schema = "session_id string, at timestamp, flag double"
    rows = [(s, T0 + timedelta(seconds=i), draw.choice([0.0, None, 1.0] if s < "d" else [0.0])) for i in range(80) for s in "abcde"]
    options = {"limit": 1.0, "slack": 0.25, "window": 3, "alpha": 0.05}
    stream = shuffled_files(spark, tmp_path, rows, schema, ("z", T0 + timedelta(days=3), 0.0))
    batch = sequences.cusum_stuck(spark.createDataFrame(rows, schema), **options).filter("first_alarm is not null").collect()
    found = drained(spark, tmp_path, jobs.stream_cusum(stream, delay="1 day", **options))
    assert found == sorted(map(tuple, batch)) and {r[0] for r in found} == {"a", "b", "c"}


def test_many_directories_share_the_state_of_a_bucket(spark, tmp_path):
    draw = random.Random(11)
    schema = "cwd string, id long, at timestamp, session_id string"
    rows = [(f"/{draw.randrange(400)}", i, T0 + timedelta(minutes=draw.randrange(300)), draw.choice([None, None, "s1", "s2"])) for i in range(2000)]
    spark.createDataFrame([*rows, ("/z", 9999, T0 + timedelta(days=3), None)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.stream_sessionize_by_cwd(jobs.read_stream(spark, spark.createDataFrame([], schema).schema, f"{tmp_path}/in"), buckets=3)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p.stateOperators[0].numRowsUpdated for p in query.recentProgress) < 50  # a key of its own for each directory made over 400
    batch = sequences.sessionize_by_cwd(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, batch.collect()))


def test_many_sessions_share_the_detectors_of_a_bucket(spark, tmp_path):
    draw = random.Random(12)
    schema = "session_id string, at timestamp, flag double"
    rows = [(f"s{i % 400}", T0 + timedelta(seconds=i), draw.choice([0.0, None, 1.0])) for i in range(4000)]
    options = {"limit": 1.0, "slack": 0.25, "window": 3, "alpha": 0.05}
    spark.createDataFrame([*rows, ("z", T0 + timedelta(days=3), 0.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.stream_cusum(jobs.read_stream(spark, spark.createDataFrame([], schema).schema, f"{tmp_path}/in"), buckets=3, **options)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p.stateOperators[0].numRowsUpdated for p in query.recentProgress) < 50
    batch = sequences.cusum_stuck(spark.createDataFrame(rows, schema), **options).filter("first_alarm is not null").collect()
    assert batch and sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, batch))


def test_rows_behind_the_watermark_and_old_state_go(spark, tmp_path):
    schema = "cwd string, id long, at timestamp, session_id string"
    minutes = [(1, 0, "s"), (2, 10, None), (3, 100, None), (5, 130, None), (4, 5, "late"), (6, 400, None)]
    for n, (i, at, own) in enumerate(minutes):
        spark.createDataFrame([("/a", i, T0 + timedelta(minutes=at), own)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = jobs.read_stream(spark, spark.createDataFrame([], schema).schema, f"{tmp_path}/in/*", files=1)
    query = jobs.stream_sessionize_by_cwd(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(1, "s"), (2, "s"), (3, None), (5, None)]  # the last one still waits


def test_alerts_fire_over_the_threshold(spark, run):
    spans = spark.createDataFrame([("a", T0 + timedelta(seconds=i), "error" if i % 2 else "success", 10, 1) for i in range(60)] + [("z", T0 + timedelta(hours=3), "success", 1, 1)], "agent_id string, start_time timestamp, status string, latency_ms long, token_count_total long")
    rules = spark.createDataFrame([(1, "error_rate", "a", 0.4, "above"), (2, "error_rate", "a", 0.6, "above"), (3, "token_usage", "a", 1000.0, "below")], "rule_id int, metric string, agent_id string, threshold double, condition string")
    found = run(spans, job=lambda s: jobs.stream_alerts(s, rules))
    assert {r["rule_id"] for r in found.collect()} == {1, 3}


def test_session_activity_and_dedup(spark, run):
    events = spark.createDataFrame([("s", T0 + timedelta(minutes=m), i, "e") for i, m in enumerate([0, 10, 50, 50, 600])], "session_id string, timestamp timestamp, event_id long, event_name string")
    found = run(events, job=jobs.stream_session_activity)
    assert sorted(r["events"] for r in found.collect()) == [2, 2]  # the last burst still waits for the watermark


def test_rpc_pairs(spark, run):
    requests = spark.createDataFrame([("c", "1", "m", T0), ("c", "2", "m", T0)], "conn string, id string, method string, requested timestamp")
    responses = spark.createDataFrame([("c", "1", T0 + timedelta(seconds=3)), ("c", "2", T0 + timedelta(hours=1))], "conn string, id string, responded timestamp")
    assert [r["id"] for r in run(requests, responses, job=jobs.stream_rpc_pairing).collect()] == ["1"]


def test_ingest_and_filters(spark, tmp_path):
    df = spark.createDataFrame([("u", "t1", "s", T0, "e"), ("v", "t2", "", T0, "e")], "user_id string, trace_id string, session_id string, timestamp timestamp, event_name string")
    df.write.parquet(f"{tmp_path}/in")
    jobs.stream_ingest(jobs.read_stream(spark, df.schema, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c", "timestamp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").filter(F.col("day") == "2024-01-01").count() == 2
    assert jobs.traces_created(df, "u").count() == 1 and jobs.spans_of_trace(df, "t2").count() == 1 and jobs.sessions_updated(df).count() == 1
