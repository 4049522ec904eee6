"""Session algorithms whose next step depends on the last one.

All but two run over partitions sorted by group and time and carry a small state from batch to batch, so a group may be of any
length. `changesets` and `critical_path` hold a few numbers for each node of one session.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.sources.shared import kept, kept_in_turn

_NAMES = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}


def _in_order(events: DataFrame, keys: list[str], order: list[str], columns: list[str], machine: Callable, fields: dict[str, pa.DataType], dealt: bool = False) -> DataFrame:
    """The rows (*keys, *fields) that a machine of its own makes of each group's columns, in the given order, nulls last.

    machine() has feed(rows of columns) and end(), which return rows. A group's rows come in batches; only the machine is held.
    Several groups share a task, so small ones cost no call of their own. Events that are dealt by the keys are not dealt again.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{f} {_NAMES[t]}" for f, t in fields.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows = None, None, []

        def made(types: list[pa.DataType]) -> pa.RecordBatch:
            out = list(zip(*rows)) if rows else [()] * (len(keys) + len(fields))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [*types, *fields.values()])], [*keys, *fields])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            groups, values = (list(zip(*(batch.column(c).to_pylist() for c in names))) for names in (keys, columns))
            at = 0
            for group, run in groupby(groups):
                end = at + sum(1 for _ in run)
                if state is None or group != now:
                    if state is not None:
                        rows += [(*now, *r) for r in state.end()]
                    now, state = group, machine()
                rows += [(*now, *r) for r in state.feed(values[at:end])]
                at = end
            yield made(types)
            rows.clear()
        if state is not None:
            rows += [(*now, *r) for r in state.end()]
            yield made(types)

    own = events.select(*dict.fromkeys([*keys, *order, *columns]))
    ordered = (own if dealt else own.repartition(*keys)).sortWithinPartitions(*keys, *(F.col(c).asc_nulls_last() for c in order))
    return ordered.mapInArrow(work, schema)


class _Matcher:
    """Each driver, in order of (at, id), takes the nearest other that is free and near enough; of two as near the smaller id.

    Others come in order too. A driver is settled when no other that is near enough can come any more, so only the events of the
    last 2 * most are held.
    """

    def __init__(self, most: float, strict: bool):
        self.most, self.strict, self.free, self.waiting = most, strict, [], deque()

    def _settle(self) -> tuple:
        at, driver = self.waiting.popleft()
        del self.free[: bisect_left(self.free, (at - self.most,))]  # too old for this driver and all later ones
        i = bisect_left(self.free, (at,))
        near = [self.free[i]] if i < len(self.free) else []
        if i:
            near.append(self.free[bisect_left(self.free, (self.free[i - 1][0],))])  # of equal times the smallest id
        best = min(near, key=lambda o: (abs(o[0] - at), o[1]), default=None)
        if best is None or abs(best[0] - at) > self.most or self.strict and abs(best[0] - at) == self.most:
            return driver, None
        del self.free[bisect_left(self.free, best)]
        return driver, best[1]

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for at, i, is_driver in rows:
            while self.waiting and at > self.waiting[0][0] + self.most:
                out.append(self._settle())
            if is_driver:
                self.waiting.append((at, i))
            else:
                insort(self.free, (at, i))
        return out

    def end(self) -> list[tuple]:
        return [self._settle() for _ in range(len(self.waiting))]


def match_nearest(events: DataFrame, keys: list[str], most: float, strict: bool = True) -> DataFrame:
    """events(keys, id, is_driver, at) -> keys, driver_id, other_id: greedy one-to-one matches by least |difference of at|.

    Serves the merge of shim and hook events (500 ms, strict), of hook and log events (50 ms) and of decisions and results (by
    sequence number). Drivers go in order of (at, id).
    """
    fields = {"driver_id": pa.int64(), "other_id": pa.int64()}
    return _in_order(events, keys, ["at", "id"], ["at", "id", "is_driver"], lambda: _Matcher(most, strict), fields)


#: What a shim adds to the hook event of the same call (fixed values).
SHIM_KEYS = ("mcp_id", "mcp_method", "mcp_latency_ms", "tool_schema_valid", "tools_available", "mcp_input", "mcp_output", "mcp_error", "mcp_span_id", "mcp_trace_id", "mcp_status")


def merge_sources(events: DataFrame, most: int = 500) -> DataFrame:
    """events(session_id, id, timestamp, event_name, body, service_name, attributes) of hooks and shims, merged where they are one call.

    Each shim call, in order, takes the nearest free hook result of its tool within `most` ms. The hook's row then has the
    shim's values of SHIM_KEYS that aren't empty, source `merged`, and the shim's row goes. All other rows stay as they are.
    """
    attr = lambda name: F.coalesce(F.try_element_at("attributes", F.lit(name)), F.lit(""))
    event = F.coalesce(F.try_element_at("attributes", F.lit("event.name")), F.col("event_name"))
    is_shim = (attr("source") == "shim") & (event == "shim_tool_call")
    is_hook = (attr("source") == "hook") & event.isin("hook_posttooluse", "hook_posttoolusefailure")
    sides = events.filter(is_shim | is_hook).select("session_id", attr("tool_name").alias("tool"), "id", is_shim.alias("is_driver"), F.unix_millis(F.col("timestamp").cast("timestamp")).alias("at"))
    pairs = match_nearest(sides, ["session_id", "tool"], most).filter("other_id is not null").select("session_id", "driver_id", "other_id")
    extra = F.map_filter("attributes", lambda k, v: k.isin(*SHIM_KEYS) & (v != ""))
    enriched = pairs.join(events.select("session_id", F.col("id").alias("driver_id"), extra.alias("extra")), ["session_id", "driver_id"]).select("session_id", F.col("other_id").alias("id"), "extra")
    merged = F.map_concat(F.map_filter("attributes", lambda k, _: ~F.array_contains(F.map_keys("extra"), k) & ~k.isin("source", "_sources")), "extra", F.create_map(F.lit("source"), F.lit("merged"), F.lit("_sources"), F.lit("hook,shim")))
    rest = events.join(pairs.select("session_id", F.col("driver_id").alias("id")), ["session_id", "id"], "left_anti")
    joined = rest.join(enriched, ["session_id", "id"], "left")
    return joined.withColumn("attributes", F.when(F.col("extra").isNull(), F.col("attributes")).otherwise(merged)).select("session_id", "id", "timestamp", "event_name", "body", "service_name", "attributes")


class _Scopes:
    """The stack of agents that are open."""

    def __init__(self):
        self.open: list = []

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for i, name, agent in rows:
            if name == "hook_subagentstart":
                self.open.append(agent)
            out.append((i, agent or (self.open[-1] if self.open else None)))
            if name == "hook_subagentstop" and self.open:
                if agent in self.open:
                    while self.open.pop() != agent:
                        pass
                elif not agent:
                    self.open.pop()
        return out

    def end(self) -> list[tuple]:
        return []


def agent_scopes(events: DataFrame) -> DataFrame:
    """events(session_id, id, at, event_name, agent) -> session_id, id, scope: the innermost agent open at each event."""
    return _in_order(events, ["session_id"], ["at", "id"], ["id", "event_name", "agent"], _Scopes, {"id": pa.int64(), "scope": pa.string()})


class Directory:
    """The session that a directory remembers, and since when (microseconds)."""

    def __init__(self, minutes: float, now: str | None = None, since: int | None = None):
        self.most, self.now, self.since = minutes * 60_000_000, now, since

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for at, i, own in rows:
            if self.since is not None and at - self.since > self.most:
                self.now = self.since = None
            if own and own != self.now:
                self.now, self.since = own, at
            out.append((i, own or self.now))
        return out

    def end(self) -> list[tuple]:
        return []


def sessionize_by_cwd(events: DataFrame, minutes: float = 30) -> DataFrame:
    """events(cwd, id, at, session_id) -> id, session_id: an event without a session takes that of its directory.

    A directory remembers a session for `minutes` from the event that created the entry, not from the last one.
    """
    timed = events.withColumn("at", F.unix_micros(F.col("at").cast("timestamp"))).withColumnRenamed("session_id", "own")
    return _in_order(timed, ["cwd"], ["at", "id"], ["at", "id", "own"], lambda: Directory(minutes), {"id": pa.int64(), "session_id": pa.string()}).drop("cwd")


class Cusum:
    """A two-sided cumulative sum of flags, averaged over a window, about a baseline; `step` says whether it is beyond the limit.

    The baseline is the given rate, or the mean of the first `warmup` flags; with alpha it drifts as an exponential mean.
    """

    # fixed values: the defaults
    def __init__(self, rate: float = 0.15, limit: float = 4.0, slack: float = 0.5, warmup: int = 0, window: int = 1, alpha: float = 0.0):
        self.limit, self.slack, self.warmup, self.alpha = limit, slack, warmup, alpha
        self.mean, self.above, self.below, self.steps, self.seen = rate, 0.0, 0.0, 0, 0.0
        self.last: deque[float] = deque(maxlen=max(1, window))

    def step(self, flag: float) -> bool:
        self.steps += 1
        self.last.append(flag)
        if self.steps <= self.warmup:
            self.seen += flag
            if self.steps == self.warmup:
                self.mean = min(max(self.seen / self.steps, 0.01), 0.99)
            return False
        level = sum(self.last) / len(self.last)
        change = level - self.mean
        if self.alpha > 0:
            self.mean = min(max(self.mean + self.alpha * change, 0.01), 0.99)
        self.above = max(0.0, self.above + change - self.slack)
        self.below = max(0.0, self.below - change - self.slack)
        return max(self.above, self.below) > self.limit

    def state(self) -> tuple:
        return self.mean, self.above, self.below, self.steps, self.seen, list(self.last)

    def resume(self, mean: float, above: float, below: float, steps: int, seen: float, last: list) -> Cusum:
        self.mean, self.above, self.below, self.steps, self.seen = mean, above, below, steps, seen
        self.last.extend(last)
        return self


class _FirstAlarm:
    """The detector and the step of its first alarm, from 1; a null flag is no revert."""

    def __init__(self, options: dict):
        self.detector, self.first = Cusum(**options), None

    def feed(self, rows: list[tuple]) -> list[tuple]:
        for flag, in rows:
            if self.first is not None:
                break
            if self.detector.step(float(flag or 0.0)):
                self.first = self.detector.steps
        return []

    def end(self) -> list[tuple]:
        return [(self.first,)]


def cusum_stuck(events: DataFrame, **options: float) -> DataFrame:
    """events(session_id, at, flag) -> session_id, first_alarm: the first step, from 1, at which the detector fires, or null."""
    return _in_order(events, ["session_id"], ["at"], ["flag"], lambda: _FirstAlarm(options), {"first_alarm": pa.int64()})


def span_tree(spans: DataFrame) -> DataFrame:
    """spans(trace_id, span_id, parent_span_id) -> trace_id, span_id, root, depth, path, by doubling the way up.

    A span whose parent is missing is a root. After n rounds each span knows its way of up to 2^n steps, so a tree of depth d
    needs log2(d) joins; spans in or below a cycle stay out.
    """
    nodes = spans.select("trace_id", "span_id", "parent_span_id").distinct()
    known = nodes.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known")).distinct()
    # path: from the span up to, but without, `up`, which is null at the root
    ways = nodes.join(known, ["trace_id", "parent_span_id"], "left").select("trace_id", "span_id", F.when(F.col("known"), F.col("parent_span_id")).alias("up"), F.array("span_id").alias("path"))
    ways, open_before = kept(ways), None
    # a way that has reached its root is written once; only open ones are joined and written again
    closed, opened = ways.filter("up is null"), ways.filter("up is not null")
    while (open_now := opened.count()) and open_now != open_before:
        # a cycle never closes: it is what stays open when a round closes no way
        over = closed.unionByName(opened).select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("more"))
        moved = opened.join(over, ["trace_id", "up"], "left")
        ways = kept(moved.select("trace_id", "span_id", F.col("next").alias("up"), F.concat("path", F.coalesce("more", F.array().cast("array<string>"))).alias("path")))
        closed, opened, open_before = closed.unionByName(ways.filter("up is null")), ways.filter("up is not null"), open_now
    done = closed.select("trace_id", "span_id", F.reverse("path").alias("path"))
    return done.select("trace_id", "span_id", F.col("path")[0].alias("root"), (F.size("path") - 1).alias("depth"), "path")


class _Ways:
    """The ways from the roots down to each span of one small trace."""

    def __init__(self):
        self.rows: list[tuple] = []

    def feed(self, rows: list[tuple]) -> list[tuple]:
        self.rows += rows
        return []

    def end(self) -> list[tuple]:
        known, below, out = {span for span, _ in self.rows}, {}, []
        for span, up in self.rows:
            if up is None or up not in known:
                out.append((span, [span]))
            else:
                below.setdefault(up, []).append(span)
        for span, path in out:  # grows as it goes: a way is followed by those of the spans below
            out += [(child, [*path, child]) for child in below.get(span, ()) if child not in path]
        return out


def span_trees(slices: Iterable[DataFrame], most: int = 1000) -> DataFrame:
    """span_tree of slices(trace_id, span_id, parent_span_id), which hold whole traces and are dealt by trace.

    Each slice is written once as it is. A trace of at most `most` rows is held by a task and its ways are made there, without a
    join; larger traces double their ways.
    """

    def sized(spans: DataFrame) -> DataFrame:
        nodes = spans.select("trace_id", "span_id", "parent_span_id").distinct()
        return nodes.withColumn("rows", F.count("*").over(Window.partitionBy("trace_id")))

    nodes = kept_in_turn(sized(spans) for spans in slices)
    held = (F.col("rows") <= most) & F.col("trace_id").isNotNull()  # no span is below another one without a trace
    small, large = nodes.filter(held), nodes.filter(~held)
    ways = _in_order(small, ["trace_id"], ["span_id"], ["span_id", "parent_span_id"], _Ways, {"span_id": pa.string(), "path": pa.list_(pa.string())}, dealt=True)
    found = ways.select("trace_id", "span_id", F.col("path")[0].alias("root"), (F.size("path") - 1).alias("depth"), "path")
    return found if large.isEmpty() else found.unionByName(span_tree(large))
