"""Joins, set operations and two-level aggregations as SQL over the views, read alike by Spark and DuckDB.

Catalyst plans them: dimensions are broadcast when they are small enough, facts meet in sort-merge joins on their keys, and every
top-k has a unique tie-break. Functions in `spanloom.operators` hold what needs windows, grouped Python or nested data.
"""

from __future__ import annotations

import re

from spanloom.plans.dashboards import EVENTS_NOW, FAILURES, HAS_AGENT, NOW, since

STATEMENTS = {
    # joins of telemetry with its traces and with registry dimensions
    "tokens_by_agent": f"""
        select t.agent_id, max(coalesce(a.name, t.agent_id)) as name, cast(sum(coalesce(t.token_count_input, 0)) as bigint) as tokens_in,
               cast(sum(coalesce(t.token_count_output, 0)) as bigint) as tokens_out, count(distinct t.trace_id) as traces
        from span_traces t left join agents a on t.agent_id = a.agent_id where {HAS_AGENT.replace('agent_id', 't.agent_id')}
        group by t.agent_id order by tokens_in desc, t.agent_id limit 20""",
    "tokens_by_mcp": """
        select t.mcp_id, max(coalesce(l.name, t.mcp_id)) as name, cast(sum(coalesce(t.token_count_total, 0)) as bigint) as tokens, count(distinct t.trace_id) as traces
        from span_traces t left join listings l on t.mcp_id = l.listing_id where t.mcp_id <> '' group by t.mcp_id order by tokens desc, t.mcp_id limit 20""",
    "ide_usage": """
        select ide, count(distinct trace_id) as traces, round(avg(latency_ms), 8) as average, count_if(status = 'error') as errors, round(cast(count_if(status = 'error') as double) / count(*), 4) as error_rate
        from span_traces where ide <> '' group by ide""",
    "avg_spans_per_agent_trace": f"select round(avg(n), 1) as average from (select trace_id, count(*) as n from span_traces where {HAS_AGENT} group by trace_id) per_trace",
    "tokens_avg_per_trace": "select round(avg(n), 2) as average from (select trace_id, sum(coalesce(token_count_total, 0)) as n from spans group by trace_id) per_trace",
    "unannotated_traces": """
        select t.trace_id, t.name, t.start_time from traces t where not exists (select 1 from scores s where s.source = 'human' and s.trace_id = t.trace_id)
        order by t.start_time desc, t.trace_id limit 50""",
    "latency_heatmap": f"""
        with busy as (select name, count(*) as n from spans where {since('start_time', 400)} group by name order by n desc, name limit 20)
        select s.name, date_trunc('hour', s.start_time) as hour, round(percentile_cont(0.5) within group (order by latency_ms), 6) as p50,
               round(percentile_cont(0.9) within group (order by latency_ms), 6) as p90, round(percentile_cont(0.99) within group (order by latency_ms), 6) as p99
        from spans s where {since('s.start_time', 400)} and s.name in (select name from busy) group by s.name, date_trunc('hour', s.start_time)""",
    "own_sessions_only": "select session_id, count(*) as n from otel_logs e where exists (select 1 from otel_logs o where o.session_id = e.session_id and o.user_id in ('u3', 'u5')) group by session_id",
    "active_sessions": f"""
        select session_id, max(timestamp) as last_seen from otel_logs where session_id <> '' group by session_id
        having max(timestamp) > {EVENTS_NOW} - interval '30' hour and max(struct_key(timestamp, event_id, event_name)) not like '%hook_stop'""",
    "feedback_received": """
        select f.feedback_id, f.listing_id, f.user_id, f.rating, f.created_at from feedback f
        where f.listing_id in (select agent_id from agents where creator_email = 'u3@x.org' union select listing_id from listings where submitted_by = 'u3')
        order by f.created_at desc, f.feedback_id""",
    "component_resolve": """
        select c.agent_id, c.component_id, c.component_type,
               case when c.component_type not in ('mcp', 'skill', 'hook', 'prompt', 'sandbox') then 'unknown type' when l.listing_id is null then 'missing' when l.status <> 'approved' then 'not approved' else 'ok' end as resolution
        from agent_components c left join listings l on c.component_id = l.listing_id and c.component_type = l.listing_type""",
    "components_ready": """
        select a.agent_id, count(l.listing_id) as blocking from agents a left join agent_components c on a.agent_id = c.agent_id
        left join listings l on c.component_id = l.listing_id and l.status <> 'approved' where a.status = 'pending' group by a.agent_id""",
    "skills_bundled_with_mcp": """
        select s.listing_id as skill_id, m.listing_id as mcp_id from listings s join listings m on s.category = m.category and contains(s.name, split_part(m.name, ' ', 1))
        where s.listing_type = 'skill' and s.status = 'pending' and m.listing_type = 'mcp'""",
    "fk_orphans": """
        select entity, count(*) as orphans, min(id) as least, max(id) as most from (
          select 'agent' as entity, d.agent_id as id from (select distinct agent_id from downloads) d left join agents a on d.agent_id = a.agent_id where a.agent_id is null
          union all select 'component', c.component_id from (select distinct component_id from agent_components) c left join listings l on c.component_id = l.listing_id where l.listing_id is null
          union all select 'user', t.user_id from (select distinct user_id from traces) t left join users u on t.user_id = u.user_id where u.user_id is null) o group by entity""",
    "export_monthly_manifest": "select year(start_time) * 100 + month(start_time) as month, count(*) as row_count, min(start_time) as first_time, max(start_time) as last_time from spans group by 1",
    # two-level aggregations and trends
    "trends": """
        select t.bucket, t.traces, coalesce(s.spans, 0) as spans, coalesce(s.errors, 0) as errors
        from (select date_trunc('week', start_time + interval '1' day) - interval '1' day as bucket, count(*) as traces from traces group by 1) t
        left join (select date_trunc('week', start_time + interval '1' day) - interval '1' day as bucket, count(*) as spans, count_if(status = 'error') as errors from spans group by 1) s on t.bucket = s.bucket""",
    "trends_registry": """
        select coalesce(l.day, a.day) as day, coalesce(l.n, 0) as listings, coalesce(a.n, 0) as agents
        from (select cast(created_at as date) as day, count(*) as n from listings group by 1) l
        full outer join (select cast(created_at as date) as day, count(*) as n from agents group by 1) a on l.day = a.day""",
    "overview_counts": f"""
        select (select count(*) from spans where type = 'tool_call' and {since('start_time', 90)}) as tool_calls, (select count(*) from traces where {since('start_time', 90)}) as interactions,
               (select count(*) from listings where status = 'approved' and listing_type = 'mcp') as mcps, (select count(*) from agents where status = 'approved') as agents, (select count(*) from users) as users""",
    "agent_metrics": """
        select t.agent_id, count(*) as interactions, round(cast(count_if(t.trace_type = 'agent') as double) / count(*), 4) as acceptance_rate, round(avg(s.tools), 8) as avg_tools, round(avg(s.latency), 8) as avg_latency, max(coalesce(d.n, 0)) as downloads
        from traces t left join (select trace_id, project_id, count_if(type = 'tool_call') as tools, avg(latency_ms) as latency from spans group by trace_id, project_id) s on t.trace_id = s.trace_id and t.project_id = s.project_id
        left join (select agent_id, count(*) as n from downloads group by agent_id) d on t.agent_id = d.agent_id where t.agent_id <> '' group by t.agent_id""",
    "session_stats": """
        select count(*) as sessions, cast(sum(prompts) as bigint) as prompts, cast(sum(tools) as bigint) as tools, cast(sum(tokens_in) as bigint) as tokens_in
        from (select session_id, count_if(event_name = 'hook_userpromptsubmit') as prompts, greatest(count_if(event_name = 'hook_posttooluse'), count_if(event_name = 'hook_pretooluse')) as tools,
                     sum(case when regexp_like_digits(input_tokens) then cast(input_tokens as bigint) else 0 end) as tokens_in
              from otel_logs where session_id <> '' group by session_id) per_session""",
    "session_list": """
        select session_id, min(timestamp) as first_seen, max(timestamp) as last_seen, count(*) as events, count_if(event_name = 'hook_userpromptsubmit') as prompts,
               greatest(count_if(event_name = 'hook_posttooluse'), count_if(event_name = 'hook_pretooluse')) as tool_calls,
               cast(sum(case when regexp_like_digits(input_tokens) then cast(input_tokens as bigint) else 0 end) as bigint) as tokens_in,
               count(distinct nullif(user_id, '')) as users, min(nullif(terminal, '')) as terminal,
               min(case when service_name in ('claude-code', 'observability-hooks') then 'claude-code' else service_name end) as service
        from otel_logs where session_id <> '' group by session_id having min(service_name) <> '' order by last_seen desc, session_id limit 100""",
    "session_token_stats": """
        select session_id, cast(sum(case when regexp_like_digits(input_tokens) then cast(input_tokens as bigint) else 0 end) as bigint) as tokens_in,
               cast(sum(case when regexp_like_digits(output_tokens) then cast(output_tokens as bigint) else 0 end) as bigint) as tokens_out,
               count_if(event_name = 'api_request') as api_calls, count_if(event_name like 'hook_%') as hook_events, count(distinct nullif(model, '')) as models
        from otel_logs group by session_id""",
    "top_per_group": """
        select session_id, model from (select session_id, model, row_number() over (partition by session_id order by count(*) desc, model) as place from otel_logs where model <> '' group by session_id, model) ranked where place = 1""",
    "session_owner": """
        select o.session_id, coalesce(min(u.name), min(o.user_id), 'unknown') as owner from otel_logs o left join users u on o.user_id = u.user_id group by o.session_id""",
    "dimension_compare": """
        select dimension, coalesce(round(avg(case when version = 'v1' then score end), 8), 0) as avg_1, coalesce(round(avg(case when version = 'v2' then score end), 8), 0) as avg_2
        from (select version, 'goal' as dimension, d_goal as score from scorecards union all select version, 'tool', d_tool from scorecards union all select version, 'fact', d_fact from scorecards) d
        where version in ('v1', 'v2') group by dimension""",
    "gf_cost_cumulative": """
        select bucket, round(sum(cost) over (order by bucket range between unbounded preceding and current row), 6) as running
        from (select date_trunc('month', start_time) as bucket, sum(cost) as cost from spans where cost > 0 group by 1) b""",
    # set operations
    "agent_sessions_fallback": """
        select distinct session_id, latest from (
          select session_id, max(timestamp) as latest from otel_logs where agent_name = 'a1' group by session_id
          union all select session_id, max(timestamp) from otel_logs where tool_input like '%f3%' or agent_name like '%a1%' group by session_id) s order by latest desc, session_id limit 5""",
    "pending_components": """
        select l.listing_id, l.listing_type, l.name, u.name as submitter, l.created_at from listings l left join users u on l.submitted_by = u.user_id where l.status = 'pending'""",
    "review_queue": """
        select kind, id, name, created_at from (select 'agent' as kind, agent_id as id, name, created_at from agents where status = 'pending'
          union all select listing_type, listing_id, name, created_at from listings where status = 'pending') q order by created_at desc, kind, id limit 200""",
    "leaderboard_fill": """
        select agent_id, n from (select agent_id, count(*) as n from downloads group by agent_id
          union all select a.agent_id, 0 from agents a left join downloads d on a.agent_id = d.agent_id where d.agent_id is null and a.status = 'approved') x order by n desc, agent_id limit 50""",
    # registry
    "top_downloads": "select agent_id, count(*) as n from downloads group by agent_id order by n desc, agent_id limit 10",
    "top_agents": """
        select a.agent_id, a.name, d.n as downloads, coalesce(f.rating, 0) as rating from agents a join (select agent_id, count(*) as n from downloads group by agent_id) d on a.agent_id = d.agent_id
        left join (select listing_id, round(avg(rating), 2) as rating from feedback group by listing_id) f on a.agent_id = f.listing_id where a.status = 'approved' order by downloads desc, a.agent_id limit 20""",
    "agent_leaderboard": f"""
        select a.agent_id, a.name, coalesce(d.n, 0) as downloads from agents a left join (select agent_id, count(*) as n from downloads where {since('installed_at', 400)} group by agent_id) d on a.agent_id = d.agent_id
        where a.status = 'approved' order by downloads desc, a.agent_id limit 50""",
    "component_leaderboard": """
        select l.listing_id, l.name, count(*) as agents from agent_components c join listings l on c.component_id = l.listing_id where l.status = 'approved' group by l.listing_id, l.name order by agents desc, l.listing_id limit 50""",
    "creator_leaderboard": """
        select coalesce(nullif(a.creator_email, ''), a.owner, 'unknown') as creator, count(distinct a.agent_id) as items, cast(sum(coalesce(d.n, 0)) as bigint) as downloads
        from agents a left join (select agent_id, count(*) as n from downloads group by agent_id) d on a.agent_id = d.agent_id group by 1""",
    "download_stats": f"""
        select agent_id, count(*) as total, count(distinct user_id) as users, count_if({since('installed_at', 700)}) as recent, count_if(source = 'cli') as from_cli, count_if(source = 'web') as from_web from downloads group by agent_id""",
    "agents_with_ratings": """
        select a.agent_id, a.name, coalesce(f.rating, 0) as rating, coalesce(c.n, 0) as components, t.total from agents a cross join (select count(*) as total from agents) t
        left join (select listing_id, round(avg(rating), 2) as rating from feedback group by listing_id) f on a.agent_id = f.listing_id
        left join (select agent_id, count(*) as n from agent_components group by agent_id) c on a.agent_id = c.agent_id""",
    "newest_pending_per_agent": """
        select submitted_by, listing_id, created_at from (select *, row_number() over (partition by submitted_by order by created_at desc, listing_id) as place from listings where status = 'pending') v where place = 1""",
    "dedup_downloads": """
        select agent_id, downloader, min(download_id) as download_id from (select *, coalesce(user_id, sha_256(ip || ':' || user_agent)) as downloader from downloads) d group by agent_id, downloader""",
    "effective_permission": """
        select agent_id, user_id, case max(level) when 3 then 'owner' when 2 then 'edit' else 'view' end as permission from (
          select a.agent_id, u.user_id, 3 as level from users u join agents a on u.email = a.creator_email
          union all select a.agent_id, u.user_id, 2 from (select *, 'g' || substring(user_id, 2, 1) as team_id from users) u join agents a on u.team_id = a.team_id
          union all select a.agent_id, u.user_id, 1 from (select distinct agent_id, actor_id from (select 'a' || substring(resource_id, 2) as agent_id, actor_id from audit_log where resource_type = 'agent') r) v
            join agents a on a.agent_id = v.agent_id and a.visibility = 'public' join users u on u.user_id = v.actor_id) p
        group by agent_id, user_id""",
    "all_penalties": f"""
        select trace_id, 'error' as event, count(*) as n from spans where status = 'error' group by trace_id
        union all select trace_id, 'timeout', count(*) from spans where status = 'timeout' group by trace_id
        union all select session_id, 'failure', count(*) from otel_logs where {FAILURES} group by session_id""",
    "retention_filter": f"select span_id, start_time from spans where cast(start_time as date) >= cast({NOW} - interval '90' day as date)",
    "evaluate_alerts": f"""
        with values_now as (
          select 'error_rate' as metric, agent_id as target, cast(count_if(status = 'error') as double) / count(*) as value from span_traces where {since('start_time', 200)} and {HAS_AGENT} group by agent_id
          union all select 'latency_p99', mcp_id, percentile_cont(0.99) within group (order by latency_ms) from span_traces where {since('start_time', 200)} and mcp_id <> '' group by mcp_id
          union all select 'token_usage', 'all', cast(sum(token_count_total) as double) from spans where {since('start_time', 200)}),
        rules as (select 1 as rule_id, 'error_rate' as metric, 'a3' as target, 0.2 as threshold, 'above' as condition union all select 2, 'error_rate', 'a4', 0.99, 'above'
          union all select 3, 'latency_p99', 'm5', 100.0, 'above' union all select 4, 'token_usage', 'all', 1.0, 'below' union all select 5, 'token_usage', 'all', 5.0, 'above')
        select r.rule_id, r.metric, r.target, round(v.value, 6) as value, coalesce(case when r.condition = 'above' then v.value > r.threshold else v.value < r.threshold end, false) as fired
        from rules r left join values_now v on r.metric = v.metric and r.target = v.target""",
    "scores_by_trace": "select t.trace_id, count(s.score_id) as n, min(s.score_id) as first_score, round(avg(s.value), 8) as average from traces t left join scores s on t.trace_id = s.trace_id group by t.trace_id",
    "scores_by_span": "select p.span_id, count(s.score_id) as n from spans p left join scores s on p.span_id = s.span_id group by p.span_id",
    "trace_detail": """
        select t.trace_id, t.name, coalesce(p.spans, 0) as spans, coalesce(p.errors, 0) as errors, coalesce(s.n, 0) as scores from traces t
        left join (select trace_id, count(*) as spans, count_if(status = 'error') as errors from spans group by trace_id) p on t.trace_id = p.trace_id
        left join (select trace_id, count(*) as n from scores group by trace_id) s on t.trace_id = s.trace_id""",
    "traces_page": """
        select trace_id, start_time, count(*) over () > 50 as has_more from (select trace_id, start_time from traces where trace_type = 'agent' order by start_time desc, trace_id limit 51) fetched order by start_time desc, trace_id limit 50""",
    "alert_history_list": """
        select h.event_id, h.severity, h.timestamp, t.total from (select event_id, severity, timestamp from audit_log where severity <> 'info' order by timestamp desc, event_id limit 25) h
        cross join (select count(*) as total from audit_log where severity <> 'info') t""",
}

def for_spark(sql: str) -> str:
    sql = re.sub(r"regexp_like_digits\((\w+)\)", r"\1 rlike '^[0-9]+$'", sql)
    sql = re.sub(r"sha_256\((ip \|\| ':' \|\| user_agent)\)", r"sha2(\1, 256)", sql)
    return re.sub(r"struct_key\((\w+), (\w+), (\w+)\)", r"concat(cast(\1 as string), '|', lpad(cast(\2 as string), 12, '0'), '|', \3)", sql)


def for_duckdb(sql: str) -> str:
    sql = re.sub(r"regexp_like_digits\((\w+)\)", r"regexp_full_match(\1, '[0-9]+')", sql)
    sql = re.sub(r"sha_256\((ip \|\| ':' \|\| user_agent)\)", r"sha256(\1)", sql)
    return re.sub(r"struct_key\((\w+), (\w+), (\w+)\)", r"strftime(\1, '%Y-%m-%d %H:%M:%S.%f') || '|' || lpad(cast(\2 as string), 12, '0') || '|' || \3", sql)
