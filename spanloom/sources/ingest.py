"""Wire documents to typed rows: OTLP traces, logs and metrics, hook events, JSON-RPC messages.

Every function takes a DataFrame of payloads (or reads) and only selects, explodes and joins, so the same code serves batch and
stream. Ids are digests of natural keys: a repeated run gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import read_map, redact, secret_count

_VALUE = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean, arrayValue: struct<values: array<struct<stringValue: string>>>>"
_ATTRS = f"array<struct<key: string, value: {_VALUE}>>"
_SPAN = f"struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string, attributes: {_ATTRS}, status: struct<code: int, message: string>, events: array<struct<name: string, timeUnixNano: string, attributes: {_ATTRS}>>>"
TRACES_JSON = f"resourceSpans array<struct<resource: struct<attributes: {_ATTRS}>, scopeSpans: array<struct<spans: array<{_SPAN}>>>>>"
_LOG = f"struct<timeUnixNano: string, severityText: string, severityNumber: int, body: struct<stringValue: string>, attributes: {_ATTRS}, traceId: string, spanId: string>"
LOGS_JSON = f"resourceLogs array<struct<resource: struct<attributes: {_ATTRS}>, scopeLogs: array<struct<logRecords: array<{_LOG}>>>>>"
_POINT = f"struct<timeUnixNano: string, asDouble: double, asInt: string, sum: double, count: string, attributes: {_ATTRS}>"
_POINTS = f"struct<dataPoints: array<{_POINT}>>"
METRICS_JSON = f"resourceMetrics array<struct<resource: struct<attributes: {_ATTRS}>, scopeMetrics: array<struct<metrics: array<struct<name: string, sum: {_POINTS}, gauge: {_POINTS}, histogram: {_POINTS}>>>>>>"

#: Part of a name that tells the tool an event comes from, and the tool (fixed values).
IDE_HINTS = (("claude", "claude-code"), ("cursor", "cursor"), ("kiro", "kiro"), ("gemini", "gemini-cli"), ("codex", "codex"), ("copilot", "copilot"), ("vscode", "vscode"), ("windsurf", "windsurf"))
TYPE_EVENTS = (("tool_call", "hook_posttooluse"), ("prompt", "hook_userpromptsubmit"), ("retrieval", "hook_posttooluse"))


def attrs_to_map(attributes: Column) -> Column:
    """[{key, value{stringValue...}}] as a map of strings; booleans lower-case, arrays as JSON. The last of equal keys stays."""
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), F.to_json(v["arrayValue"]["values"]), F.lit(""))
    entries = F.transform(F.coalesce(attributes, F.array()), lambda a: F.struct(a["key"], text(a["value"])))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def merged(resource: Column, own: Column) -> Column:
    """Resource attributes under the record's own."""
    base, top = attrs_to_map(resource), attrs_to_map(own)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)


def nanos(text: Column) -> Column:
    return F.timestamp_micros(F.try_divide(text.cast("decimal(38,0)"), F.lit(1000)).cast("bigint"))


def detect_ide(attributes: Column) -> Column:
    """The first hint in service.name, telemetry.sdk.name, process.runtime.name or terminal.type; else terminal.type itself."""
    found = F.lit(None).cast("string")
    for key in reversed(("service.name", "telemetry.sdk.name", "process.runtime.name", "terminal.type")):
        for hint, ide in reversed(IDE_HINTS):
            found = F.when(F.contains(F.lower(read_map(attributes, key)), F.lit(hint)), ide).otherwise(found)
    return F.coalesce(found, read_map(attributes, "terminal.type"))


def user_of(attributes: Column) -> Column:
    named = [F.nullif(read_map(attributes, k), F.lit("")) for k in ("user.id", "user.email", "user.account_uuid")]
    return F.coalesce(*named, F.lit("otlp"))


def otlp_spans(payloads: DataFrame, column: str = "json") -> DataFrame:
    """A row for each span of the payloads, in payload order, with merged attributes and derived fields."""
    parsed = payloads.select(F.from_json(column, TRACES_JSON).alias("p"))
    spans = parsed.select(F.explode("p.resourceSpans").alias("r")).select("r.resource", F.explode("r.scopeSpans").alias("s")).select("resource", F.posexplode("s.spans").alias("position", "span"))
    a = F.col("attributes")
    start, end = F.col("span.startTimeUnixNano").cast("decimal(38,0)"), F.col("span.endTimeUnixNano").cast("decimal(38,0)")
    model = F.coalesce(F.nullif(read_map(a, "gen_ai.request.model"), F.lit("")), F.nullif(read_map(a, "model"), F.lit("")))
    tokens = {n: F.coalesce(read_map(a, f"gen_ai.usage.{n}_tokens").try_cast("bigint"), read_map(a, f"{n}_tokens").try_cast("bigint")) for n in ("input", "output")}
    known = spans.withColumn("attributes", merged(F.col("resource.attributes"), F.col("span.attributes")))
    return known.select(
        F.col("span.traceId").alias("trace_id"), F.col("span.spanId").alias("span_id"), F.nullif("span.parentSpanId", F.lit("")).alias("parent_span_id"), F.col("span.name").alias("name"), "position",
        nanos(F.col("span.startTimeUnixNano")).alias("start_time"), nanos(F.col("span.endTimeUnixNano")).alias("end_time"),
        F.greatest(F.coalesce(F.try_divide(end - start, F.lit(1_000_000)).cast("bigint"), F.lit(0)), F.lit(0)).alias("latency_ms"),
        F.when(F.col("span.status.code") == 2, "error").otherwise("success").alias("status"), F.col("span.status.message").alias("error"),
        F.when((F.col("span.kind") == 3) & model.isNotNull(), "llm").when(F.col("span.kind") == 3, "client").when(F.col("span.kind") == 2, "server").otherwise("internal").alias("type"),
        model.alias("model"), tokens["input"].alias("token_count_input"), tokens["output"].alias("token_count_output"),
        F.when(tokens["input"].isNotNull() | tokens["output"].isNotNull(), F.coalesce(tokens["input"], F.lit(0)) + F.coalesce(tokens["output"], F.lit(0))).alias("token_count_total"),
        user_of(a).alias("user_id"), detect_ide(a).alias("ide"), read_map(a, "session.id").alias("session_id"), "attributes", F.col("span.events").alias("events"),
    )


def otlp_traces_to_rows(payloads: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(traces, spans): one trace for each trace_id, from its first root span."""
    spans = otlp_spans(payloads, column)
    first = F.struct("start_time", "position", "span_id")
    picked = [F.min_by(c, first).alias(c) for c in ("name", "user_id", "ide", "session_id", "start_time")]
    traces = spans.filter("parent_span_id is null").groupBy("trace_id").agg(*picked)
    return traces, spans.drop("events")


def otlp_span_events_to_spans(payloads: DataFrame, column: str = "json") -> DataFrame:
    """User prompts, tool results and API requests among the events of spans as child spans."""
    spans = otlp_spans(payloads, column).select("trace_id", F.col("span_id").alias("parent_span_id"), F.posexplode("events").alias("nth", "e"))
    name = F.col("e.name")
    kinds = F.when(F.contains(name, F.lit("user_prompt")), "user_prompt").when(F.contains(name, F.lit("tool_result")), "tool_call").when(F.contains(name, F.lit("api_request")), "llm")
    events = spans.withColumn("type", kinds).filter("type is not null").withColumn("attributes", attrs_to_map(F.col("e.attributes")))
    span_id = F.substring(F.sha2(F.concat_ws(":", "trace_id", "parent_span_id", "nth"), 256), 1, 16)
    return events.select("trace_id", "parent_span_id", span_id.alias("span_id"), "type", name.alias("name"), nanos(F.col("e.timeUnixNano")).alias("start_time"), "attributes")


def otlp_log_records(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Log records with merged attributes: the rows of the event table. Severity defaults to INFO, 9."""
    parsed = payloads.select(F.from_json(column, LOGS_JSON).alias("p"))
    logs = parsed.select(F.explode("p.resourceLogs").alias("r")).select("r.resource", F.explode("r.scopeLogs").alias("s")).select("resource", F.explode("s.logRecords").alias("log"))
    own = logs.withColumn("attributes", merged(F.col("resource.attributes"), F.col("log.attributes")))
    return own.select(nanos(F.col("log.timeUnixNano")).alias("timestamp"), F.coalesce("log.severityText", F.lit("INFO")).alias("severity"), F.coalesce("log.severityNumber", F.lit(9)).alias("severity_number"), F.col("log.body.stringValue").alias("body"), read_map(F.col("attributes"), "service.name").alias("service_name"), "attributes")


def otlp_logs_to_rows(payloads: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(traces, spans) of log records by prompt: the first record names the trace, the last user prompt is its input."""
    logs = otlp_log_records(payloads, column)
    a = F.col("attributes")
    logs = logs.withColumn("trace_id", F.sha2(F.concat_ws(":", read_map(a, "session.id"), read_map(a, "prompt.id")), 256)).withColumn("event", F.coalesce(F.nullif(read_map(a, "event.name"), F.lit("")), "body"))
    at = F.struct("timestamp", "event")
    prompt = F.when(F.contains("event", F.lit("user_prompt")), read_map(a, "prompt"))
    traces = logs.groupBy("trace_id").agg(F.min_by("event", at).alias("name"), F.max_by(prompt, F.when(prompt.isNotNull(), at)).alias("input"), F.min("timestamp").alias("start_time"), F.first(user_of(a)).alias("user_id"))
    kind = F.when(F.contains("event", F.lit("tool_result")), "tool_call").when(F.contains("event", F.lit("api_request")), "llm").otherwise("event")
    spans = logs.filter(~F.contains("event", F.lit("user_prompt"))).select("trace_id", F.sha2(F.concat_ws(":", "trace_id", "timestamp", "event"), 256).alias("span_id"), kind.alias("type"), F.col("event").alias("name"), F.col("timestamp").alias("start_time"), read_map(a, "duration_ms").try_cast("bigint").alias("latency_ms"))
    return traces, spans


def otlp_metrics_to_spans(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Points of sums, gauges and histograms as `metric` spans; tokens only where the name says so; points without value go."""
    parsed = payloads.select(F.from_json(column, METRICS_JSON).alias("p"))
    metrics = parsed.select(F.explode("p.resourceMetrics").alias("r")).select("r.resource", F.explode("r.scopeMetrics").alias("s")).select("resource", F.explode("s.metrics").alias("m"))
    points = metrics.select("resource", "m.name", F.explode(F.concat(*[F.coalesce(f"m.{k}.dataPoints", F.array()) for k in ("sum", "gauge", "histogram")])).alias("point"))
    value = F.coalesce("point.asDouble", F.col("point.asInt").cast("double"), "point.sum")
    own = points.withColumn("value", value).filter("value is not null").withColumn("attributes", merged(F.col("resource.attributes"), F.col("point.attributes")))
    return own.select(F.lit("metric").alias("type"), "name", nanos(F.col("point.timeUnixNano")).alias("start_time"), "value", F.when(F.contains("name", F.lit("token")), F.col("value").cast("bigint")).alias("token_count_total"), "attributes")


#: Raw event names of hooks by tool, and what they are called here (fixed values).
HOOK_EVENTS = {"beforeSubmitPrompt": "UserPromptSubmit", "userPromptSubmit": "UserPromptSubmit", "preToolUse": "PreToolUse", "beforeShellExecution": "PreToolUse", "postToolUse": "PostToolUse", "afterShellExecution": "PostToolUse", "agentSpawn": "SessionStart", "stop": "Stop", "sessionStart": "SessionStart", "subagentStop": "SubagentStop"}


def normalize_hook_events(hooks: DataFrame, column: str = "json") -> DataFrame:
    """Hook JSON of any tool as events: both key spellings are read, names unified, and a tool use without success is a failure."""
    field = lambda *names: F.coalesce(*[F.get_json_object(column, f"$.{n}") for n in names])
    raw = field("hook_event_name", "hookEventName", "event")
    names = F.create_map(*[F.lit(x) for pair in HOOK_EVENTS.items() for x in pair])
    event = F.coalesce(F.try_element_at(names, raw), raw)
    event = F.when((event == "PostToolUse") & (F.lower(field("success", "tool_response.success")) == "false"), "PostToolUseFailure").otherwise(event)
    tool_input, response = F.substring(redact(field("tool_input", "toolInput", "input")), 1, 64_000), F.substring(redact(field("tool_response", "toolResponse", "output", "result")), 1, 64_000)
    return hooks.select(
        F.concat(F.lit("hook_"), F.lower(event)).alias("event_name"), field("session_id", "sessionId", "conversation_id").alias("session_id"), field("cwd", "workspace_roots[0]").alias("cwd"), field("tool_name", "toolName", "tool").alias("tool_name"),
        tool_input.alias("tool_input"), response.alias("tool_response"), F.length(field("prompt", "user_prompt")).alias("prompt_length"), field("stop_reason", "stopReason").alias("stop_reason"), field("model").alias("model"),
        F.when(field("tool_name") == "Agent", F.get_json_object(field("tool_input"), "$.subagent_type")).alias("agent_type"), F.when(field("tool_name") == "Skill", F.get_json_object(field("tool_input"), "$.skill")).alias("skill_name"),
        secret_count(field("tool_input", "toolInput", "input")).alias("redactions"), normalize_hook_time(field("timestamp")).alias("timestamp"),
    )


def normalize_hook_time(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_millis(text.try_cast("bigint")))


def hook_body(event: Column, tool: Column, prompt: Column, response: Column) -> Column:
    return (
        F.when(event == "hook_userpromptsubmit", F.concat(F.lit("Prompt: "), F.substring(F.coalesce(prompt, F.lit("")), 1, 200)))
        .when(event.isin("hook_pretooluse", "hook_posttooluse"), F.concat(F.lit("Tool: "), F.coalesce(tool, F.lit("unknown"))))
        .when(event == "hook_posttoolusefailure", F.concat(F.lit("Tool failed: "), F.coalesce(tool, F.lit("unknown")), F.lit(" "), F.substring(F.coalesce(response, F.lit("")), 1, 200)))
        .otherwise(F.concat(F.lit("Event: "), event))
    )


def rpc_messages_to_spans(messages: DataFrame) -> DataFrame:
    """messages(conn, at, json) -> a span for each response with its request; a repeated request id replaces the pending one."""
    m = messages.select("conn", "at", F.get_json_object("json", "$.id").alias("id"), F.get_json_object("json", "$.method").alias("method"), F.get_json_object("json", "$.params.name").alias("tool"), F.get_json_object("json", "$.error.message").alias("error"), F.get_json_object("json", "$.params.arguments").alias("arguments"), F.get_json_object("json", "$.result.tools").alias("tools"))
    by_id = Window.partitionBy("conn", "id").orderBy("at")
    before = by_id.rowsBetween(Window.unboundedPreceding, -1)
    request = F.struct("at", "method", "tool", "arguments")
    paired = m.filter("id is not null").withColumn("request", F.last(F.when(F.col("method").isNotNull(), request), ignorenulls=True).over(before)).withColumn("previous", F.lag("method").over(by_id))
    spans = paired.filter("method is null and request is not null and previous is not null")
    kind = F.when(F.col("request.method") == "tools/call", "tool_call").when(F.col("request.method") == "tools/list", "tool_list").when(F.col("request.method").like("resources/%"), "resource").when(F.col("request.method").like("prompts/%"), "prompt").when(F.col("request.method") == "initialize", "initialize").otherwise("other")
    return spans.select("conn", "id", kind.alias("type"), F.coalesce("request.tool", "request.method").alias("name"), F.when(F.col("error").isNotNull(), "error").otherwise("success").alias("status"), (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("request.at").cast("timestamp"))).alias("latency_us"), F.col("request.at").alias("start_time"), F.col("request.arguments").alias("arguments"), "tools")


def schema_compliance(calls: DataFrame) -> DataFrame:
    """Calls with the last list of tools before them on their connection: null without a list, one of no tools, or a name; 0 for an
    unknown tool, a missing required argument, or one that is none of the named properties, if any are named; else 1."""
    listing = "array<struct<name: string, inputSchema: struct<required: array<string>, properties: map<string, string>>>>"
    last = Window.partitionBy("conn").orderBy("start_time", "id").rowsBetween(Window.unboundedPreceding, -1)
    known = calls.withColumn("known", F.last(F.from_json("tools", listing), ignorenulls=True).over(last)).filter("type = 'tool_call'")
    known = known.withColumn("known", F.when(F.size("known") > 0, F.col("known")))
    tool = F.get(F.filter("known", lambda t: t["name"] == F.col("name")), 0)
    given = F.map_keys(F.coalesce(F.from_json("arguments", "map<string, string>"), F.create_map().cast("map<string, string>")))
    missing = F.size(F.array_except(F.coalesce(tool["inputSchema"]["required"], F.array()), given)) > 0
    named = F.coalesce(F.map_keys(tool["inputSchema"]["properties"]), F.array())
    extra = (F.size(named) > 0) & (F.size(F.array_except(given, named)) > 0)
    return known.select("conn", "id", "name", F.when(F.col("known").isNull() | F.col("name").isNull(), None).when(tool.isNull() | missing | extra, 0).otherwise(1).alias("tool_schema_valid"), F.size("known").alias("tools_available"))
