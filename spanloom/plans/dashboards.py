"""Dashboard panels, listings and counters over the telemetry views."""

from __future__ import annotations

from spanloom.plans.panel import Panel
from spanloom.sources.views import EVENTS_AS_OF, ORDERS_AS_OF

NOW, EVENTS_NOW = f"timestamp '{ORDERS_AS_OF}'", f"timestamp '{EVENTS_AS_OF}'"


def since(column: str, amount: int, unit: str = "day", now: str = NOW) -> str:
    out = f"{column} >= {now} - interval '{amount}' {unit} and {column} <= {now}"
    if column == "start_time":  # a span starts within hours of its order, whose time is a key of its versions and stands in the file
        out += f" and order_time >= {now} - interval '{amount}' {unit} - interval '1' day and order_time <= {now}"
    return out


def panel_filter(column: str = "start_time", days: int = 2500, projects: tuple[str, ...] = (), environments: tuple[str, ...] = ()) -> str:
    """The predicate that panels share: not deleted, in the time range, in the chosen projects and environments (none: all)."""
    out = f"is_deleted = 0 and {since(column, days)}"
    for name, chosen in (("project_id", projects), ("environment", environments)):
        if chosen:
            out += f" and {name} in ({', '.join(repr(c) for c in chosen)})"
    return out


RANGE, SCORED = panel_filter(), panel_filter("timestamp")
HAS_AGENT = "agent_id is not null and agent_id <> ''"
BUCKET = {"bucket": "date_trunc('month', start_time)"}
SCORE_BUCKET, AUDIT_BUCKET = {"bucket": "date_trunc('month', timestamp)"}, {"bucket": "date_trunc('day', timestamp)"}
N = {"n": "count(*)"}


def total(x: str) -> str:
    return f"coalesce(cast(sum({x}) as bigint), 0)"


def rate(condition: str, digits: int = 4, scale: int = 1) -> str:
    return f"round({scale} * cast(count_if({condition}) as double) / nullif(count(*), 0), {digits})"


def quantile(x: str, p: float) -> str:
    return f"round(percentile_cont({p}) within group (order by {x}), 6)"


def top(source: str, where: str, by: str, aggs: dict[str, str], key: str, limit: int, having: str = "") -> Panel:
    return Panel(source, where, {by: by}, aggs, having=having, order=(f"{key} desc", by), limit=limit)


TOOL = f"{RANGE} and type = 'tool_call'"
SANDBOX = f"{RANGE} and type = 'sandbox_exec'"
SPAN_TOP = {"n": "count(*)", "p95": quantile("latency_ms", 0.95)}
TOKENS = {"tokens_in": total("token_count_input"), "tokens_out": total("token_count_output"), "tokens_all": total("token_count_total")}
LATENCIES = {f"p{int(p * 100)}": quantile("latency_ms", p) for p in (0.5, 0.95, 0.99)}
RECENT_TRACE = {c: c for c in ("trace_id", "project_id", "user_id", "agent_id", "name", "start_time")}

GRAFANA = {
    "gf_agent_traces_ts": Panel("traces", f"{RANGE} and {HAS_AGENT}", BUCKET, N),
    "gf_active_agents": Panel("traces", f"{RANGE} and {HAS_AGENT}", {}, {"agents": "count(distinct agent_id)"}),
    "gf_top_agents_traces": top("traces", f"{RANGE} and {HAS_AGENT}", "agent_id", N, "n", 15),
    "gf_agent_error_rate": top("span_traces", f"{RANGE} and {HAS_AGENT}", "agent_id", {"n": "count(*)", "error_rate": rate("status = 'error'", 2, 100)}, "error_rate", 15, "n >= 5"),
    "gf_agent_latency_ts": Panel("span_traces", f"{RANGE} and {HAS_AGENT}", BUCKET, LATENCIES),
    "gf_agent_latency_top": top("span_traces", f"{RANGE} and {HAS_AGENT}", "agent_id", {"average": "round(avg(latency_ms), 10)", "p95": quantile("latency_ms", 0.95), "most": "max(latency_ms)"}, "p95", 15),
    "gf_agent_recent": Panel("traces", f"{RANGE} and {HAS_AGENT}", columns=RECENT_TRACE, order=("start_time desc", "trace_id"), limit=50),
    "gf_audit_ts": Panel("audit_log", "", AUDIT_BUCKET, N),
    "gf_audit_total": Panel("audit_log", "", {}, N),
    "gf_audit_actors": Panel("audit_log", "", {}, {"actors": "count(distinct actor_id)"}),
    "gf_audit_by_action": top("audit_log", "", "action", N, "n", 100),
    "gf_audit_by_resource": top("audit_log", "", "resource_type", N, "n", 100),
    "gf_audit_by_method": top("audit_log", "http_method <> ''", "http_method", N, "n", 100),
    "gf_audit_top_actors": Panel("audit_log", "", {"actor_email": "actor_email", "actor_role": "actor_role"}, N, order=("n desc", "actor_email", "actor_role"), limit=15),
    "gf_audit_recent": Panel("audit_log", columns={c: c for c in ("event_id", "timestamp", "actor_email", "action", "resource_type", "resource_id")}, order=("timestamp desc", "event_id"), limit=100),
    "gf_cost_total": Panel("spans", f"{RANGE} and cost > 0", {}, {"cost": "round(sum(cost), 10)"}),
    "gf_cost_avg": Panel("spans", f"{RANGE} and cost > 0", {}, {"cost": "round(avg(cost), 10)"}),
    "gf_cost_by_project": top("spans", f"{RANGE} and cost > 0", "project_id", {"total_cost": "round(sum(cost), 10)"}, "total_cost", 15),
    "gf_cost_daily": Panel("spans", f"{RANGE} and cost > 0", {"day": "cast(start_time as date)"}, {"total_cost": "round(sum(cost), 10)"}),
    "gf_cost_breakdown": Panel("spans", f"{RANGE} and cost > 0", {"day": "cast(start_time as date)"}, {"spans": "count(*)", "total_cost": "round(sum(cost), 10)", "avg_cost": "round(avg(cost), 10)", "tokens": total("token_count_total")}),
    "gf_error_rate_ts": Panel("spans", RANGE, BUCKET, {"error_rate": rate("status = 'error'", 2, 100)}),
    "gf_timeout_rate_ts": Panel("spans", RANGE, BUCKET, {"timeout_rate": rate("status = 'timeout'", 2, 100)}),
    "gf_errors_total": Panel("spans", f"{RANGE} and status = 'error'", {}, N),
    "gf_error_rate": Panel("spans", RANGE, {}, {"error_rate": rate("status = 'error'", 2, 100)}),
    "gf_status_breakdown": Panel("spans", RANGE, {"status": "status"}, N),
    "gf_error_by_type": top("spans", RANGE, "type", {"errors": "count_if(status = 'error')"}, "errors", 15, "errors > 0"),
    "gf_errors_recent": Panel("spans", f"{RANGE} and status <> 'success'", columns={c: c for c in ("span_id", "type", "name", "status", "error", "start_time")}, order=("start_time desc", "span_id"), limit=50),
    "gf_cpu_ts": Panel("spans", f"{SANDBOX} and cpu_ms is not null", BUCKET, {"average": "round(avg(cpu_ms), 10)", "p95": quantile("cpu_ms", 0.95)}),
    "gf_memory_ts": Panel("spans", f"{SANDBOX} and memory_mb is not null", BUCKET, {"average": "round(avg(memory_mb), 10)", "p95": quantile("memory_mb", 0.95)}),
    "gf_oom": Panel("spans", SANDBOX, {}, {"n": "count_if(oom_killed = 1)"}),
    "gf_retries": Panel("spans", RANGE, {}, {"n": total("retry_count")}),
    "gf_failed_exits": Panel("spans", SANDBOX, {}, {"n": "count_if(exit_code <> 0)"}),
    "gf_network_ts": Panel("spans", SANDBOX, BUCKET, {"bytes_in": total("network_in_bytes"), "bytes_out": total("network_out_bytes")}),
    "gf_disk_ts": Panel("spans", SANDBOX, BUCKET, {"bytes_read": total("disk_read_bytes"), "bytes_written": total("disk_write_bytes")}),
    "gf_retry_rate_ts": Panel("spans", RANGE, BUCKET, {"retry_rate": rate("retry_count > 0", 2, 100)}),
    "gf_hook_blocked_ts": Panel("spans", f"{RANGE} and type = 'hook'", BUCKET, {"blocked": "count_if(hook_blocked = 1)", "allowed": "count_if(coalesce(hook_blocked, 0) = 0)"}),
    "gf_heavy_spans": Panel("spans", RANGE, columns={c: c for c in ("span_id", "name", "cpu_ms", "memory_mb")}, order=("cpu_ms desc", "span_id"), limit=50),
    "gf_scores_ts": Panel("scores", SCORED, SCORE_BUCKET, N),
    "gf_scores_total": Panel("scores", SCORED, {}, N),
    "gf_score_avg": Panel("scores", SCORED, {}, {"average": "round(avg(value), 3)"}),
    "gf_score_trend": Panel("scores", SCORED, {**SCORE_BUCKET, "name": "name"}, {"average": "round(avg(value), 10)"}),
    "gf_scores_by_source": Panel("scores", SCORED, {"source": "source"}, N),
    "gf_score_dist": top("scores", SCORED, "name", {"n": "count(*)", "average": "round(avg(value), 10)", "least": "min(value)", "most": "max(value)"}, "n", 15),
    "gf_eval_runs": Panel("scores", f"{SCORED} and eval_run_id is not null", {"eval_run_id": "eval_run_id", "eval_template_id": "eval_template_id"}, {"n": "count(*)", "average": "round(avg(value), 10)", "latest": "max(timestamp)"}, order=("latest desc", "eval_run_id", "eval_template_id"), limit=25),
    "gf_scores_recent": Panel("scores", SCORED, columns={c: c for c in ("score_id", "name", "source", "value", "timestamp")}, order=("timestamp desc", "score_id"), limit=50),
    "gf_traces_ts": Panel("traces", RANGE, BUCKET, N),
    "gf_sessions_active": Panel("traces", f"{RANGE} and session_id <> ''", {}, {"sessions": "count(distinct session_id)"}),
    "gf_traces_total": Panel("traces", RANGE, {}, N),
    "gf_trace_types": Panel("traces", RANGE, {"trace_type": "trace_type"}, N),
    "gf_traces_by_ide": top("traces", f"{RANGE} and ide <> ''", "ide", N, "n", 15),
    "gf_traces_recent": Panel("traces", RANGE, columns=RECENT_TRACE, order=("start_time desc", "trace_id"), limit=50),
    "gf_tokens_ts": Panel("spans", RANGE, BUCKET, TOKENS),
    "gf_tokens_in": Panel("spans", RANGE, {}, {"n": total("token_count_input")}),
    "gf_tokens_out": Panel("spans", RANGE, {}, {"n": total("token_count_output")}),
    "gf_tokens_all": Panel("spans", RANGE, {}, {"n": total("token_count_total")}),
    "gf_tokens_by_type": Panel("spans", RANGE, {"type": "type"}, {"n": total("token_count_total")}),
    "gf_token_consumers": Panel("spans", f"{RANGE} and token_count_total > 0", {"name": "name", "type": "type"}, {"n": total("token_count_total"), "calls": "count(*)"}, order=("n desc", "name", "type"), limit=25),
    "gf_tool_calls_ts": Panel("spans", TOOL, BUCKET, N),
    "gf_tool_calls_total": Panel("spans", TOOL, {}, N),
    "gf_tool_latency_avg": Panel("spans", TOOL, {}, {"average": "round(avg(latency_ms), 1)"}),
    "gf_tool_calls_by_name": top("spans", TOOL, "name", N, "n", 15),
    "gf_tool_latency_ts": Panel("spans", TOOL, BUCKET, LATENCIES),
    "gf_tool_latency_top": top("spans", TOOL, "name", {"average": "round(avg(latency_ms), 10)", "p95": quantile("latency_ms", 0.95), "most": "max(latency_ms)"}, "p95", 15),
    "tool_calls_by_mcp": Panel("span_traces", f"{TOOL} and mcp_id <> ''", {"mcp_id": "mcp_id"}, N, order=("n desc", "mcp_id"), limit=15),
    "cost_by_agent": Panel("span_traces", f"{RANGE} and cost > 0 and {HAS_AGENT}", {"agent_id": "agent_id"}, {"total_cost": "round(sum(cost), 10)"}, order=("total_cost desc", "agent_id"), limit=15),
}
for _name, _column, _view in (("project", "project_id", "traces"), ("environment", "environment", "traces"), ("action", "action", "audit_log"), ("resource_type", "resource_type", "audit_log")):
    GRAFANA[f"grafana_variable_{_name}"] = Panel(_view, f"{_column} <> ''", columns={"value": _column}, order=("value",), distinct=True)
GRAFANA["panel_filter"] = Panel("spans", panel_filter(days=1500, projects=("default",), environments=("staging",)), columns={"span_id": "span_id", "start_time": "start_time"})

SPAN_COLUMNS = {c: c for c in ("span_id", "trace_id", "type", "name", "status", "start_time", "latency_ms")}
EVENT_COLUMNS = {c: c for c in ("event_id", "timestamp", "session_id", "user_id", "event_name", "tool_name", "agent_name", "model", "service_name", "terminal", "tool_input", "tool_response")}
FAILURES = "event_name in ('hook_posttoolusefailure', 'hook_stopfailure', 'api_error')"
FAILURE_CLASS = "case when event_name = 'hook_posttoolusefailure' then 'tool_failure' when event_name = 'hook_stopfailure' then 'stop_failure' else 'api_error' end"
AUDIT_COLUMNS = {c: c for c in ("event_id", "timestamp", "actor_id", "action", "resource_type", "resource_id")}


def contains(text: str, *columns: str) -> str:
    """Case-insensitive search for a literal text (no wildcards) in any of the columns."""
    return "(" + " or ".join(f"contains(lower(coalesce({c}, '')), lower('{text}'))" for c in columns) + ")"


READS = {
    "traces_search": Panel("traces", "trace_type = 'agent' and agent_id = 'a3'", columns=RECENT_TRACE, order=("start_time desc", "trace_id"), limit=50, offset=10),
    "trace_by_id": Panel("traces", "trace_id = 't100' and user_id is not null", columns=RECENT_TRACE, limit=1),
    "span_by_id": Panel("spans", "span_id = 's100-1'", columns=SPAN_COLUMNS, order=("start_time desc", "span_id"), limit=1),
    "spans_of_trace": Panel("spans", "trace_id = 't100' and type = 'tool_call' and status = 'success'", columns=SPAN_COLUMNS, order=("start_time", "span_id"), limit=200),
    "shim_spans_in_window": Panel("spans", "user_id = 'u7' and type in ('tool_call', 'retrieval') and start_time between timestamp '1996-01-01 00:00:00' - interval '2' second and timestamp '1999-01-01 00:00:00' + interval '2' second", columns=SPAN_COLUMNS, order=("start_time", "span_id"), limit=500),
    "scores_search": Panel("scores", "source = 'eval' and name = 'helpful'", columns={c: c for c in ("score_id", "trace_id", "name", "value", "timestamp")}, order=("timestamp desc", "score_id"), limit=100),
    "audit_search": Panel("audit_log", f"action = 'click.create' and resource_type = 'agent' and {since('timestamp', 20, 'day', EVENTS_NOW)}", columns=AUDIT_COLUMNS, order=("timestamp desc", "event_id"), limit=50, offset=5),
    "security_events_search": Panel("audit_log", "severity = 'critical'", columns={**AUDIT_COLUMNS, "severity": "severity"}, order=("timestamp desc", "event_id"), limit=1000),
    "export_audit_csv": Panel("audit_log", "actor_role = 'admin'", columns=AUDIT_COLUMNS, order=("timestamp desc", "event_id"), limit=10000),
    "error_events": Panel("otel_logs", FAILURES, columns=EVENT_COLUMNS, order=("timestamp desc", "event_id"), limit=200),
    "error_search": Panel("otel_logs", f"{FAILURES} and {contains('code 2', 'tool_name', 'tool_response', 'agent_name', 'body', 'session_id')}", columns={"event_id": "event_id", "error_type": FAILURE_CLASS, "session_id": "session_id"}),
    "error_type_counts": Panel("otel_logs", FAILURES, {"error_type": FAILURE_CLASS}, N),
    "root_otel_traces": Panel("spans", "parent_span_id is null", columns=SPAN_COLUMNS, order=("start_time desc", "span_id"), limit=100),
    "otel_trace_counts": Panel("spans", "", {}, {"traces": "count(distinct trace_id)", "spans": "count(*)"}),
    "agent_traces": Panel("traces", "agent_id = 'a2' and user_id = 'u30'", columns=RECENT_TRACE, order=("start_time desc", "trace_id"), limit=50),
    "text_search": Panel("agents", contains("100%_", "name", "description"), columns={"agent_id": "agent_id", "name": "name"}),
    "listing_search": Panel("listings", f"status = 'approved' and listing_type = 'skill' and {contains('a', 'name', 'category')}", columns={c: c for c in ("listing_id", "name", "category", "version")}, order=("name", "listing_id"), limit=100),
    "visible_agents": Panel("agents", "visibility = 'public' or creator_email = 'u3@x.org' or team_id in ('g1', 'g2')", columns={"agent_id": "agent_id", "visibility": "visibility"}),
    "recent_event_counts": Panel("otel_logs", since("timestamp", 600, "minute", EVENTS_NOW), {}, N),
    "paged": Panel("agents", columns={"agent_id": "agent_id", "created_at": "created_at"}, order=("created_at desc", "agent_id"), limit=20, offset=20),
    "recently_added": Panel("agents", "status = 'approved'", columns={"agent_id": "agent_id", "created_at": "created_at"}, order=("created_at desc", "agent_id"), limit=6),
    "nulls_last_sort": Panel("spans", columns={"span_id": "span_id", "memory_mb": "memory_mb"}, order=("memory_mb desc", "span_id"), limit=50),
    "trace_sample": Panel("traces", "agent_id = 'a4'", columns=RECENT_TRACE, order=("start_time desc", "trace_id"), limit=20),
    "semver_sort": Panel("listings", columns={"listing_id": "listing_id", "version": "version", "major": "cast(split_part(version, '.', 1) as int)", "minor": "cast(split_part(version, '.', 2) as int)", "patch": "cast(split_part(version, '.', 3) as int)"}, order=("major desc", "minor desc", "patch desc", "listing_id"), limit=50),
    "eval_runs_list": Panel("scores", "eval_run_id is not null", {"eval_run_id": "eval_run_id"}, {"n": "count(*)", "started": "min(timestamp)"}, order=("started desc", "eval_run_id"), limit=20),
    "scorecards_list": Panel("scorecards", "version = 'v1'", columns={c: c for c in ("scorecard_id", "agent_id", "composite", "evaluated_at")}, order=("evaluated_at desc", "scorecard_id"), limit=20, offset=20),
    "versions_list": Panel("listings", "listing_type = 'mcp'", columns={c: c for c in ("listing_id", "version", "created_at")}, order=("created_at desc", "listing_id"), limit=20),
    "my_listings": Panel("listings", "submitted_by = 'u7'", columns={c: c for c in ("listing_id", "listing_type", "status", "created_at")}, order=("created_at desc", "listing_id"), limit=50),
    "recent_sandbox_runs": Panel("spans", "type = 'sandbox_exec'", columns={"span_id": "span_id", "exit_code": "try_cast(m_exit_code as int)", "oom": "m_oom in ('1', 'true')", "start_time": "start_time"}, order=("start_time desc", "span_id"), limit=20),
    "recent_retrievals": Panel("spans", "type = 'retrieval'", columns={"span_id": "span_id", "entities": "try_cast(m_entities as int)", "relevance": "try_cast(m_relevance as double)", "start_time": "start_time"}, order=("start_time desc", "span_id"), limit=20),
    "conversation_search": Panel("turns", contains("the", "text"), {"conv_id": "conv_id"}, {"matching": "count(*)", "first_turn": "min(turn)"}),
    "feedback_list": Panel("feedback", "listing_id = 'a3'", columns={c: c for c in ("feedback_id", "user_id", "rating", "created_at")}, order=("created_at desc", "feedback_id"), limit=100),
}

RATES = {"calls": "count(*)", "errors": "count_if(status = 'error')", "error_rate": rate("status = 'error'"), "average": "round(avg(latency_ms), 1)"}
AGGREGATES = {
    "mcp_metrics_legacy": Panel("span_traces", "type = 'tool_call' and mcp_id <> ''", {"mcp_id": "mcp_id"}, {**RATES, **{f"p{int(p * 100)}": quantile("latency_ms", p) for p in (0.5, 0.9, 0.99)}}),
    "mcp_metrics": Panel("span_traces", "type = 'tool_call' and mcp_id <> ''", {"mcp_id": "mcp_id"}, {**RATES, "timeout_rate": rate("status = 'timeout'"), "p50": quantile("latency_ms", 0.5), "p99": quantile("latency_ms", 0.99), "schema_compliance": "cast(count_if(tool_schema_valid = 1) as double) / nullif(count(tool_schema_valid), 0)"}),
    "overview_window": Panel("spans", RANGE, {}, {"traces": "count(distinct trace_id)", "spans": "count(*)", "tool_calls": "count_if(type = 'tool_call')", "errors": "count_if(status = 'error')"}),
    "token_totals": Panel("spans", RANGE, {}, TOKENS),
    "tokens_over_time": Panel("spans", RANGE, {"day": "cast(start_time as date)"}, {"tokens_in": TOKENS["tokens_in"], "tokens_out": TOKENS["tokens_out"]}),
    "sandbox_summary": Panel("spans", "type = 'sandbox_exec'", {}, {"runs": "count(*)", "oom": "count_if(m_oom in ('1', 'true'))", "timeouts": "count_if(m_timed_out in ('1', 'true'))", "oom_rate": rate("m_oom in ('1', 'true')"), "avg_exit_code": "round(avg(try_cast(m_exit_code as double)), 10)"}),
    "sandbox_cpu_daily": Panel("spans", "type = 'sandbox_exec'", {"day": "cast(start_time as date)"}, {"average": "round(avg(cpu_ms), 1)"}),
    "sandbox_memory_daily": Panel("spans", "type = 'sandbox_exec'", {"day": "cast(start_time as date)"}, {"average": "round(avg(memory_mb), 2)"}),
    "graphrag_summary": Panel("spans", "type = 'retrieval'", {}, {"queries": "count(*)", "entities": "round(avg(try_cast(m_entities as double)), 10)", "relevance": "round(avg(try_cast(m_relevance as double)), 10)"}),
    "relevance_histogram": Panel("spans", "type = 'retrieval' and m_relevance <> ''", {"relevance_bucket": "case when try_cast(m_relevance as double) < 0.2 then '0.0-0.2' when try_cast(m_relevance as double) < 0.4 then '0.2-0.4' when try_cast(m_relevance as double) < 0.6 then '0.4-0.6' when try_cast(m_relevance as double) < 0.8 then '0.6-0.8' else '0.8-1.0' end"}, N),
    "session_summary": Panel("otel_logs", "session_id <> ''", {}, {"sessions": "count(distinct session_id)", "today": f"count(distinct case when timestamp > date_trunc('day', {EVENTS_NOW} - interval '1' day) then session_id end)"}),
    "trace_metrics": Panel("spans", "", {"trace_id": "trace_id"}, {"spans": "count(*)", "errors": "count_if(status = 'error')", "latency": "cast(sum(latency_ms) as bigint)", "tool_calls": "count_if(type = 'tool_call')", "tokens": "cast(nullif(coalesce(sum(token_count_total), 0), 0) as bigint)"}),
    "alert_error_rate": Panel("span_traces", f"{since('start_time', 200)} and {HAS_AGENT}", {"agent_id": "agent_id"}, {"value": rate("status = 'error'", 6)}),
    "alert_latency_p99": Panel("span_traces", f"{since('start_time', 200)} and mcp_id <> ''", {"mcp_id": "mcp_id"}, {"value": quantile("latency_ms", 0.99)}),
    "alert_token_usage": Panel("spans", since("start_time", 200), {}, {"value": total("token_count_total")}),
    "ragas_averages": Panel("scores", "name like 'ragas%'", {"name": "name"}, {"average": "nullif(round(avg(value), 4), 0)", "n": "count(*)"}),
    "ragas_run_averages": Panel("scores", "name like 'ragas%' and eval_run_id is not null", {"eval_run_id": "eval_run_id"}, {"average": "round(avg(case when value > 0 then value end), 10)"}),
    "version_compare": Panel("scorecards", "version in ('v1', 'v2')", {}, {"avg_1": "round(avg(case when version = 'v1' then composite end), 2)", "n_1": "count_if(version = 'v1')", "avg_2": "round(avg(case when version = 'v2' then composite end), 2)", "n_2": "count_if(version = 'v2')"}),
    "session_aggregate": Panel("scorecards", "", {"session_id": "session_id"}, {"average": "round(avg(composite), 10)", "n": "count(*)"}),
    "span_failure_stats": Panel("spans", "", {"trace_id": "trace_id"}, {"errors": "count_if(status = 'error')", "timeouts": "count_if(status = 'timeout')", "latency_coverage": "cast(count(latency_ms) as double) / count(*)"}),
    "event_filter_counts": Panel("otel_logs", "", {"session_id": "session_id"}, {"prompts": "count_if(event_name = 'hook_userpromptsubmit')", "tools": "count_if(event_name in ('hook_pretooluse', 'hook_posttooluse'))", "errors": f"count_if({FAILURES})", "api": "count_if(event_name like 'api%')"}),
    "feedback_summary": Panel("feedback", "", {"listing_id": "listing_id"}, {"average": "coalesce(round(avg(rating), 2), 0)", "n": "count(*)"}),
    "buffer_stats": Panel("audit_log", "", {"state": "case when severity = 'critical' then 'failed' when severity = 'warning' then 'pending' else 'sent' end"}, N),
    "span_filter_options": Panel("otel_logs", "agent_name <> ''", columns={"session_id": "session_id", "agent_name": "agent_name"}, distinct=True),
    "distinct_targets": Panel("spans", "", {"trace_id": "trace_id"}, {"targets": "count(distinct type || '|' || input)"}),
    "download_counts": Panel("downloads", "", {"agent_id": "agent_id"}, N),
}

PANELS = {**GRAFANA, **READS, **AGGREGATES}
