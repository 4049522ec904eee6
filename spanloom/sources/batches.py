"""Ingest batches, JSON of {traces, spans, scores}, to typed rows with defaults and without secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import normalize_ts, redact

# fixed values: the fields of a batch and their types
TRACE = (
    "trace_id string, parent_trace_id string, trace_type string, mcp_id string, agent_id string, session_id string, ide string, name string, start_time string, end_time string, input string, output string, "
    "metadata map<string,string>, tags array<string>, tool_id string, sandbox_id string, graphrag_id string, hook_id string, skill_id string, prompt_id string"
)
SPAN = (
    "span_id string, trace_id string, parent_span_id string, type string, name string, method string, input string, output string, error string, start_time string, end_time string, latency_ms long, status string, ide string, "
    "metadata map<string,string>, token_count_input long, token_count_output long, token_count_total long, cost double, cpu_ms long, memory_mb double, hop_count int, entities_retrieved int, relationships_used int, retry_count int, "
    "tools_available int, tool_schema_valid boolean, container_id string, exit_code int, network_bytes_in long, network_bytes_out long, disk_read_bytes long, disk_write_bytes long, oom_killed boolean, query_interface string, "
    "relevance_score double, chunks_returned int, embedding_latency_ms long, hook_event string, hook_scope string, hook_action string, hook_blocked boolean, variables_provided int, template_tokens int, rendered_tokens int"
)
SCORE = "score_id string, trace_id string, span_id string, mcp_id string, agent_id string, name string, source string, data_type string, value double, string_value string, comment string, metadata map<string,string>"
DEFAULTS = {"trace_type": "mcp", "ide": "", "method": "", "status": "success", "source": "api", "data_type": "numeric"}
REQUIRED = {"traces": ("trace_id", "start_time"), "spans": ("span_id", "trace_id", "type", "name", "start_time"), "scores": ("score_id", "name", "value")}
SECRET, FLAGS, TIMES = ("input", "output", "error"), ("tool_schema_valid", "oom_killed", "hook_blocked"), ("start_time", "end_time")


def _items(payloads: DataFrame, kind: str, fields: str) -> DataFrame:
    """payloads(json, project_id, user_id, environment, received): a row for each item of the kind that has all it must have."""
    struct = ", ".join(f"{name}: {type_}" for name, type_ in (f.strip().split(" ", 1) for f in fields.split(", ")))
    parsed = F.from_json("json", f"{kind} array<struct<{struct}>>")[kind]
    items = payloads.select("project_id", "user_id", "environment", "received", F.explode(parsed).alias("item"))

    def column(name: str) -> Column:
        value = F.col(f"item.{name}")
        if name in SECRET:
            value = redact(value)
        elif name in FLAGS:
            value = value.cast("int")
        elif name in TIMES:
            value = normalize_ts(value)
        elif name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[name]))
        elif name == "metadata":
            value = F.coalesce(value, F.create_map().cast("map<string,string>"))
        return value.alias(name)

    has_all = F.lit(True)
    for name in REQUIRED[kind]:
        has_all &= F.col(f"item.{name}").isNotNull()
    return items.filter(has_all).select("project_id", "user_id", "environment", "received", *(column(f.strip().split(" ", 1)[0]) for f in fields.split(", ")))


def batch_traces(payloads: DataFrame) -> DataFrame:
    return _items(payloads, "traces", TRACE).drop("received")


def batch_spans(payloads: DataFrame) -> DataFrame:
    """Spans take the ids of tool and agent from their trace when they are read, so both are null here."""
    none = F.lit(None).cast("string")
    return _items(payloads, "spans", SPAN).drop("received").withColumns({"mcp_id": none, "agent_id": none})


def batch_scores(payloads: DataFrame) -> DataFrame:
    """Scores have the time at which their batch came."""
    return _items(payloads, "scores", SCORE).withColumnRenamed("received", "timestamp").drop("environment")
