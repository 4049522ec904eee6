"""The streaming jobs over the driver tables as files: each stream is drained and its sink read back.

A job with a watermark returns what is closed when the files end; the SQL beside it says the same of the whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.derived import DETECTOR
from spanloom.sources.views import SQL, Views, checked_by
from spanloom.streaming import jobs

USER, TRACE = "u3", "t100"


def stream_of(v: Views, table: str) -> DataFrame:
    """The table's file or folder (hence the pattern) as a stream; watermarks need times with a zone, the session's."""
    rows = jobs.read_stream(v.spark, getattr(v, table).schema, f"{v.sf_dir}/{table}.parque[t]")
    return rows.select(*(F.col(f.name).cast("timestamp") if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in rows.schema.fields))


def read_back(df: DataFrame) -> DataFrame:
    """Times without a zone again, as the tables have them."""
    return df.select(*(F.col(f.name).cast("timestamp_ntz") if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema.fields))


def drained(stream: DataFrame) -> DataFrame:
    return read_back(jobs.drained(stream))


def view_of(v: Views, view: str, table: str) -> DataFrame:
    """A view of which one table comes as a stream."""
    name = f"{table}_stream_{uuid.uuid4().hex[:8]}"
    stream_of(v, table).createOrReplaceTempView(name)
    return v.sql(SQL[view].replace(f"from {table}", f"from {name}"))


def ingest(v: Views) -> DataFrame:
    folder = jobs.sink_folder(v.spark)
    jobs.stream_ingest(stream_of(v, "events"), f"{folder}/out", f"{folder}/log", "ts").awaitTermination()
    return v.spark.read.parquet(f"{folder}/out").select("event_id", "event_type", F.col("day").cast("date").alias("day"))


def agent_events(v: Views) -> DataFrame:
    """Events as the calls of an agent each."""
    own = view_of(v, "otel_logs", "events")
    status = F.when(F.col("event_name") == "hook_posttoolusefailure", "error").otherwise("success")
    return own.filter("agent_name <> ''").select(F.col("agent_name").alias("agent_id"), F.col("timestamp").alias("start_time"), status.alias("status"), F.lit(0).cast("long").alias("latency_ms"), F.col("k").alias("token_count_total"))


def alerts(v: Views) -> DataFrame:
    rules = v.spark.createDataFrame([(1, "error_rate", "a0", 0.5, "above"), (2, "token_usage", "a1", 80.0, "above"), (3, "token_usage", "a2", 10.0, "below")], "rule_id int, metric string, agent_id string, threshold double, condition string")
    found = drained(jobs.stream_alerts(agent_events(v), rules))
    return read_back(found.select("rule_id", F.col("window.start").alias("window_start"), "agent_id", "metric", F.round("value", 6).alias("value")))


def activity(v: Views) -> DataFrame:
    found = drained(jobs.stream_session_activity(view_of(v, "otel_logs", "events")))
    return found.select("session_id", "first_seen", "last_seen", "events", "last_event")


def rpc_pairing(v: Views) -> DataFrame:
    events = stream_of(v, "events").withColumn("conn", F.col("user_id").cast("string")).withColumn("id", (F.col("event_id") % 3).cast("string"))
    requests = events.filter("event_type = 'view'").select("conn", "id", F.col("event_id").cast("string").alias("method"), F.col("ts").alias("requested"))
    responses = events.filter("event_type = 'click'").select("conn", "id", F.col("ts").alias("responded"))
    return drained(jobs.stream_rpc_pairing(requests, responses, "6 hours"))


def flags(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("session_id"), F.col("timestamp").alias("at"), (F.col("event_name") == "hook_posttoolusefailure").cast("double").alias("flag"))


def directories(events: DataFrame) -> DataFrame:
    own = F.when(F.col("event_id") % 3 == 0, F.col("session_id"))
    return events.select(F.concat("user_id", F.lit("/"), (F.col("k") % 7).cast("string")).alias("cwd"), F.col("event_id").alias("id"), F.col("timestamp").alias("at"), own.alias("session_id"))


QUERIES = {
    "stream_ingest": ingest,
    "stream_traces_created": lambda v: drained(jobs.traces_created(view_of(v, "traces", "orders"), USER).select("trace_id", "start_time", "agent_id")),
    "stream_spans_of_trace": lambda v: drained(jobs.spans_of_trace(view_of(v, "spans_raw", "lineitem"), TRACE).select("span_id", "event_ts", "status")),
    "stream_sessions_updated": lambda v: drained(jobs.sessions_updated(view_of(v, "otel_logs", "events"))),
    "stream_dedup": lambda v: drained(jobs.stream_dedup(stream_of(v, "events").union(stream_of(v, "events")), ["event_id"], "ts")).select("event_id", "event_type"),
    "stream_alerts": alerts,
    "stream_session_activity": activity,
    "stream_rpc_pairing": rpc_pairing,
    "stream_cusum": lambda v: drained(jobs.stream_cusum(flags(view_of(v, "otel_logs", "events")), **DETECTOR)),
    "stream_sessionize_by_cwd": lambda v: drained(jobs.stream_sessionize_by_cwd(directories(view_of(v, "otel_logs", "events")))),
}

#: Detectors and directories event by event, as recursive queries; a stream returns what its watermark has passed.
_CUSUM = f"""
    with recursive numbered as (
        select user_id as session_id, timestamp as at_time, case when event_name = 'hook_posttoolusefailure' then 1.0 else 0.0 end::double as flag,
            row_number() over (partition by user_id order by timestamp, event_id) as step
        from otel_logs
    ), walk as (
        select session_id, 0::bigint as step, 0.15::double as mean, 0::double as above, 0::double as below, null::double as before, false as fires, timestamp '1970-01-01' as at_time
        from numbered where step = 1
        union all
        select session_id, step, least(greatest(mean + {DETECTOR["alpha"]} * change, 0.01), 0.99), greatest(above + change2 - {DETECTOR["slack"]}, 0),
            greatest(below - change2 - {DETECTOR["slack"]}, 0), flag,
            greatest(greatest(above + change2 - {DETECTOR["slack"]}, 0), greatest(below - change2 - {DETECTOR["slack"]}, 0)) > {DETECTOR["limit"]}, at_time
        from (
            select w.session_id, n.step, w.mean, w.above, w.below, n.flag, n.at_time,
                case when w.before is null then n.flag else (w.before + n.flag) / 2 end - w.mean as change, case when w.before is null then n.flag else (w.before + n.flag) / 2 end - w.mean as change2
            from walk w join numbered n on n.session_id = w.session_id and n.step = w.step + 1
        )
    )"""
_DIRECTORIES = """
    with recursive numbered as (
        select user_id || '/' || cast(k % 7 as varchar) as cwd, event_id as id, timestamp as at_time, case when event_id % 3 = 0 then session_id end as own,
            row_number() over (partition by user_id || '/' || cast(k % 7 as varchar) order by timestamp, event_id) as step
        from otel_logs
    ), walk as (
        select cwd, 0::bigint as step, null::bigint as id, null::timestamp as at_time, null::varchar as now_session, null::timestamp as since, null::varchar as session_id from numbered where step = 1
        union all
        select cwd, step, id, at_time, coalesce(own, held), case when own is not null and own is distinct from held then at_time when held is not null then since end, coalesce(own, held)
        from (
            select w.cwd, n.step, n.id, n.at_time, n.own, w.since, case when n.at_time - w.since <= interval '30' minute then w.now_session end as held
            from walk w join numbered n on n.cwd = w.cwd and n.step = w.step + 1
        )
    )"""
_PASSED = "at_time <= (select max(timestamp) - interval '10' minute from otel_logs)"

ORACLES = {
    "cusum_stuck": checked_by(f"{_CUSUM} select session_id, min(step) filter (where fires) as first_alarm from walk group by session_id"),
    "stream_cusum": checked_by(f"{_CUSUM} select session_id, min(step) as first_alarm from walk where fires and {_PASSED} group by session_id"),
    "sessionize_by_cwd": checked_by(f"{_DIRECTORIES} select id, session_id from walk where step > 0"),
    "stream_sessionize_by_cwd": checked_by(f"{_DIRECTORIES} select id, session_id from walk where step > 0 and {_PASSED}"),
    "stream_ingest": "select event_id, event_type, cast(ts as date) as day from events",
    "stream_traces_created": checked_by(f"select trace_id, start_time, agent_id from traces where user_id = '{USER}'"),
    "stream_spans_of_trace": checked_by(f"select span_id, event_ts, status from spans_raw where trace_id = '{TRACE}'"),
    "stream_sessions_updated": checked_by("select session_id, timestamp, event_name from otel_logs where session_id <> ''"),
    "stream_dedup": "select event_id, event_type from events",
    "stream_alerts": checked_by("""
        with placed as (select *, date_trunc('minute', timestamp) - interval '1' minute * unnest(range(0, 5)) as window_start from otel_logs where agent_name <> ''),
        measured as (select window_start, agent_name as agent_id, cast(count_if(event_name = 'hook_posttoolusefailure') as double) / count(*) as error_rate, cast(sum(k) as double) as token_usage from placed
          where window_start + interval '5' minute <= (select max(timestamp) - interval '5' minute from otel_logs where agent_name <> '') group by window_start, agent_name)
        select 1 as rule_id, window_start, agent_id, 'error_rate' as metric, round(error_rate, 6) as value from measured where agent_id = 'a0' and error_rate > 0.5
        union all select 2, window_start, agent_id, 'token_usage', token_usage from measured where agent_id = 'a1' and token_usage > 80 union all select 3, window_start, agent_id, 'token_usage', token_usage from measured where agent_id = 'a2' and token_usage < 10"""),
    "stream_session_activity": checked_by("""
        with starts as (select *, case when timestamp < lag(timestamp) over (partition by session_id order by timestamp, event_id) + interval '30' minute then 0 else 1 end as is_start from otel_logs),
        bursts as (select *, sum(is_start) over (partition by session_id order by timestamp, event_id rows unbounded preceding) as burst from starts)
        select session_id, min(timestamp) as first_seen, max(timestamp) as last_seen, count(*) as events, arg_max(event_name, strftime(timestamp, '%Y%m%d%H%M%S%f') || lpad(cast(event_id as string), 12, '0')) as last_event from bursts
        group by session_id, burst having max(timestamp) + interval '30' minute <= (select max(timestamp) - interval '10' minute from otel_logs)"""),
    "stream_rpc_pairing": """
        select cast(a.user_id as string) as conn, cast(a.event_id % 3 as string) as id, cast(a.event_id as string) as method, a.ts as requested, b.ts as responded from events a join events b on a.user_id = b.user_id and a.event_id % 3 = b.event_id % 3
        where a.event_type = 'view' and b.event_type = 'click' and b.ts between a.ts and a.ts + interval '6' hour""",
}
