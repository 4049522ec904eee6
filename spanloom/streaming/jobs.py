"""Structured Streaming jobs: ingest, alerts, session activity, pairing, and detectors with state.

State is bounded by watermarks or timers. Machines get their rows in order of event time, whatever batch brought them.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from spanloom.operators.sequences import Cusum, Directory
from spanloom.sources.shared import shared_folder


#: Most files of one micro-batch: a backlog comes in several.
FILES_A_TRIGGER = 256
#: Buckets of keys that share their state; as many for a job's whole life.
BUCKETS = 512


def read_stream(spark, schema, path: str, fmt: str = "parquet", files: int = FILES_A_TRIGGER) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path)


def sink_folder(spark) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame) -> DataFrame:
    """What the stream appends until its present input ends, from a Parquet sink."""
    folder = sink_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_ingest(events: DataFrame, path: str, checkpoint: str, partition: str) -> StreamingQuery:
    """Appends each micro-batch to a Parquet table partitioned by day of the column; exactly once by the sink's own log."""
    dated = events.withColumn("day", F.to_date(partition))
    return dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()


def traces_created(traces: DataFrame, user: str | None = None) -> DataFrame:
    return traces.filter(F.col("user_id") == user) if user else traces


def spans_of_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.filter(F.col("trace_id") == trace_id)


def sessions_updated(events: DataFrame) -> DataFrame:
    return events.filter("session_id <> ''").select("session_id", "timestamp", "event_name")


def stream_dedup(events: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Without exact repeats within the delay; newer versions of a row still need latest_version when read."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stream_alerts(spans: DataFrame, rules: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Error rate, latency and tokens of each agent over 5 minutes, every minute, against the (small, static) rules."""
    windowed = spans.withWatermark("start_time", delay).groupBy(F.window("start_time", "5 minutes", "1 minute"), "agent_id")
    values = windowed.agg((F.count_if(F.col("status") == "error") / F.count("*")).alias("error_rate"), F.percentile_approx("latency_ms", 0.99).cast("double").alias("latency_p99"), F.sum("token_count_total").cast("double").alias("token_usage"))
    long = values.select("window", "agent_id", F.explode(F.create_map(*[x for m in ("error_rate", "latency_p99", "token_usage") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    fires = F.when(F.col("condition") == "above", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return long.join(F.broadcast(rules), ["metric", "agent_id"]).filter(fires & ~F.isnan("value")).select("rule_id", "window", "agent_id", "metric", "value")


def stream_session_activity(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Bursts of a session with gaps under 30 minutes: first and last event, number, and the last event's name."""
    grouped = events.withWatermark("timestamp", delay).groupBy("session_id", F.session_window("timestamp", gap))
    return grouped.agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("events"), F.max_by("event_name", F.struct("timestamp", "event_id")).alias("last_event"))


def stream_rpc_pairing(requests: DataFrame, responses: DataFrame, within: str = "5 minutes") -> DataFrame:
    """Responses with their request of the same connection and id, at most `within` apart."""
    a = requests.withWatermark("requested", within).alias("a")
    b = responses.withWatermark("responded", within).alias("b")
    near = F.expr(f"a.conn = b.conn and a.id = b.id and b.responded between a.requested and a.requested + interval {within}")
    return a.join(b, near).select("a.conn", "a.id", "a.method", "a.requested", "b.responded")


class _InOrder(StatefulProcessor):
    """Feeds each key's rows to a machine in order of (at, *order) once the watermark has passed them, whatever batch they came in.

    The keys of a bucket share their state, as every call of the state costs a trip between two processes. Rows wait as Arrow
    batches in a list state; a timer at the earliest of them wakes the bucket. Rows behind the watermark don't come (Spark drops
    them). What the machines know is one table; a key's row goes `idle` seconds after the key's last event.
    """

    def __init__(self, columns: StructType, known: StructType, order: list[str], work: Callable, out: list[str], idle: int):
        self.columns, self.known_columns, self.work, self.out, self.idle = columns, known, work, out, idle
        self.places = [columns.names.index(c) for c in ("at_micros", *order)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.known = handle.getValueState("known", "rows binary")

    @staticmethod
    def packed(table: pa.Table) -> tuple[bytes]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return (sink.getvalue().to_pybytes(),)

    @staticmethod
    def unpacked(rows: tuple) -> list[tuple]:
        return list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(bytes(rows[0])).read_all().columns)))

    @staticmethod
    def table(rows: list[tuple], schema: StructType) -> pa.Table:
        kinds = to_arrow_schema(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first, new = None, []
        for part in rows:
            new.append(self.packed(pa.Table.from_pandas(part[self.columns.names], to_arrow_schema(self.columns), preserve_index=False)))
            least = int(part["at_micros"].min())
            first = least if first is None else min(first, least)
        self.waiting.appendList(new)
        self.handle.registerTimer(first // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = defaultdict(list), []
        for part in self.waiting.get():
            for row in self.unpacked(part):
                if row[1] <= now:
                    ready[row[0]].append(row)
                else:
                    later.append(row)
        known = {k: state for k, *state in self.unpacked(self.known.get())} if self.known.exists() else {}
        out = []
        for k, own in ready.items():
            own.sort(key=lambda row: tuple(row[i] for i in self.places))
            found, after = self.work(k, [row[1:] for row in own], known[k][:-1] if k in known else None)
            out.extend(found)
            known[k] = [*after, own[-1][1] + self.idle * 1_000_000]
        awake = ready.keys() | {row[0] for row in later}
        known = {k: state for k, state in known.items() if k in awake or state[-1] > now}
        if ready and later:
            self.waiting.put([self.packed(self.table(later, self.columns))])
        elif ready:
            self.waiting.clear()
        if known:
            self.known.update(self.packed(self.table([(k, *state) for k, state in known.items()], self.known_columns)))
        elif self.known.exists():
            self.known.clear()
        wakes = [row[1] // 1000 + 1 for row in later] + [max(state[-1] // 1000, now // 1000) + 1 for state in known.values()]
        if wakes:
            self.handle.registerTimer(min(wakes))
        yield pd.DataFrame(out, columns=self.out)


def _ordered(events: DataFrame, key: str, delay: str, order: list[str], known: str, work: Callable, schema: str, idle: int, buckets: int) -> DataFrame:
    """work(key, rows of (at in microseconds, *other columns), known values or None) gives rows of the schema and the values to keep."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    others = [f for f in events.schema.fields if f.name not in ("at", key)]
    timed = events.filter("at is not null").withWatermark("at", delay).withColumns({"at_micros": F.unix_micros("at"), "bucket": F.pmod(F.xxhash64(key), F.lit(buckets))})
    columns = StructType([events.schema[key], StructField("at_micros", LongType()), *others])
    kept = StructType([events.schema[key], *StructType.fromDDL(known).fields, StructField("idle_from", LongType())])
    machine = _InOrder(columns, kept, order, work, StructType.fromDDL(schema).names, idle)
    return timed.groupBy("bucket").transformWithStateInPandas(machine, schema, "append", "eventTime")


def stream_cusum(events: DataFrame, delay: str = "10 minutes", buckets: int = BUCKETS, **options: float) -> DataFrame:
    """events(session_id, at, flag) -> a row at each session's first alarm; the detector's numbers are the state.

    Flags count in order of time across micro-batches, once the watermark has passed them; later ones are dropped. Sets the
    session's state store to RocksDB. A session's state goes a day after its last event.
    """

    def work(key: object, rows: list[tuple], known: list | None) -> tuple[list[tuple], tuple]:
        detector, fired, out = Cusum(**options), False, []
        if known:
            *numbers, fired = known
            detector.resume(*numbers)
        for _, flag in rows:
            if detector.step(float(flag or 0.0)) and not fired:
                out.append((key, detector.steps))
                fired = True
        return out, (*detector.state(), fired)

    kept = "mean double, above double, below double, steps long, seen double, last array<double>, fired boolean"
    kind = events.schema["session_id"].dataType.simpleString()
    return _ordered(events.select("session_id", "at", "flag"), "session_id", delay, [], kept, work, f"session_id {kind}, first_alarm long", 24 * 3600, buckets)


def stream_sessionize_by_cwd(events: DataFrame, minutes: int = 30, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """events(cwd, id, at, session_id) -> id, session_id: a directory's session holds for 30 minutes from its first event.

    Events count in order of (time, id) across micro-batches, once the watermark has passed them; later ones are dropped. Sets
    the session's state store to RocksDB. A directory's state goes when its session can't hold any more.
    """

    def work(key: object, rows: list[tuple], known: list | None) -> tuple[list[tuple], tuple]:
        directory = Directory(minutes, *(known or ()))
        return directory.feed(rows), (directory.now, directory.since)

    return _ordered(events.select("cwd", "at", "id", "session_id"), "cwd", delay, ["id"], "session string, since long", work, "id long, session_id string", 60 * minutes, buckets)
