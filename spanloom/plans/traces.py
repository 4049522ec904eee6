"""Window, session, quality and efficiency queries that SQL states: over spans of a trace and events of a session.

Every window is partitioned by trace, session or a finer key, so one sort by that key serves a whole family of columns.
"""

from __future__ import annotations

# ordinal of spans and of tool calls in their trace; success of the same tool later; the span after
_CALLS = """
    numbered as (
      select *, row_number() over (partition by trace_id order by start_time, span_id) as span_index,
             case when type = 'tool_call' then row_number() over (partition by trace_id, case when type = 'tool_call' then 1 else 0 end order by start_time, span_id) end as call_index,
             lead(type) over (partition by trace_id order by start_time, span_id) as next_type,
             lead(span_id) over (partition by trace_id order by start_time, span_id) as next_span
      from spans)"""

_EVENTS = """
    ordered as (
      select *, row_number() over (partition by session_id order by timestamp, event_id) as event_index,
             sum(case when event_name = 'hook_userpromptsubmit' then 1 else 0 end) over (partition by session_id order by timestamp, event_id rows unbounded preceding) as turn_id,
             case when event_name in ('hook_pretooluse', 'hook_posttooluse') then 'tool_use' else event_name end as action
      from otel_logs)"""

_WRITES = """
    acts as (
      select session_id, event_index, timestamp, tool_name, case when tool_name = 'tool_0' then 'write' when tool_name = 'tool_1' then 'bash' when tool_name = 'tool_2' then 'read' when tool_name = 'tool_3' then 'verify' else 'think' end as act,
             tool_input as file, md5(tool_response) as content, case when event_name = 'hook_posttoolusefailure' then 1 else 0 end as failed, (length(tool_input) + length(tool_response)) / cast(4 as double) as cost from ordered)"""

QUERIES = {
    "tool_call_index": f"with {_CALLS} select span_id, span_index, call_index from numbered",
    # the last 50 scorecards of an agent against the 50 before them: mean, its 95 % interval, drift of at least one deviation and five points
    "agent_aggregate": """
        with placed as (select *, row_number() over (partition by agent_id order by evaluated_at desc, scorecard_id) as place from scorecards),
        sums as (
            select agent_id, count_if(place <= 50) as n, avg(case when place <= 50 then composite end) as mean, stddev_pop(case when place <= 50 then composite end) as deviation,
                count_if(place > 50) as n_before, avg(case when place > 50 then composite end) as mean_before, stddev_pop(case when place > 50 then composite end) as deviation_before,
                avg(case when place <= 50 then d_goal end) as goal, avg(case when place <= 50 then d_tool end) as tool, avg(case when place <= 50 then coalesce(d_fact, 0) end) as fact
            from placed where place <= 100 group by agent_id)
        select agent_id, n, round(mean, 6) as average, round(deviation, 6) as deviation,
               round(greatest(mean - 1.96 * deviation / sqrt(cast(n as double)), 0), 6) as ci_low, round(least(mean + 1.96 * deviation / sqrt(cast(n as double)), 100), 6) as ci_high,
               round(goal, 6) as goal, round(tool, 6) as tool, round(fact, 6) as fact,
               case when goal <= tool and goal <= fact then 'goal_completion' when tool <= fact then 'tool_efficiency' else 'factual_grounding' end as weakest, round(mean_before, 6) as before_that,
               coalesce(n >= 10 and n_before >= 10 and abs(mean - mean_before) >= greatest(deviation_before, 1.0) and abs(mean - mean_before) >= 5, false) as drifted
        from sums""",
    "effective_weights": """
        select d.dimension, coalesce(a.weight, g.weight, d.weight) as weight, a.weight is not null or g.weight is not null as is_custom
        from (select 'goal_completion' as dimension, 0.28 as weight union all select 'tool_efficiency', 0.18 union all select 'tool_failures', 0.13 union all select 'factual_grounding', 0.18 union all select 'thought_process', 0.13 union all select 'adversarial_robustness', 0.10) d
        left join (select 'tool_efficiency' as dimension, 0.25 as weight) g on d.dimension = g.dimension left join (select 'goal_completion' as dimension, 0.3 as weight from agents where agent_id = 'a1') a on d.dimension = a.dimension""",
    "heuristic_span_score": "select span_id, round(greatest(least(case when status = 'success' then 0.8 else 0.2 end - case when latency_ms > 5000 then 0.2 else 0.0 end, 1.0), 0.0), 6) as score from spans",
    "eval_templates": "select s.span_id, t.template from spans s join (select 'tool_call' as applies_to, 'tool_quality' as template union all select 'llm', 'answer_quality' union all select 'tool_call', 'latency') t on s.type = t.applies_to",
    # sessions
    "turn_id": f"with {_EVENTS} select event_id, session_id, cast(turn_id as bigint) as turn_id from ordered",
    "session_turns": f"""with {_EVENTS} select session_id, cast(turn_id as bigint) as turn_id, count(*) as events, count_if(action = 'tool_use') as tool_events, count(distinct case when action = 'tool_use' then tool_name end) as tools,
        min(case when event_name = 'hook_userpromptsubmit' then body end) as prompt, bool_or(event_name = 'hook_stop') as stopped from ordered group by session_id, turn_id""",
    "pair_pre_post_fifo": """
        with pre as (select session_id, tool_name, event_id, timestamp, row_number() over (partition by session_id, tool_name order by timestamp, event_id) as nth from otel_logs where event_name = 'hook_pretooluse'),
             post as (select session_id, tool_name, event_id, timestamp, row_number() over (partition by session_id, tool_name order by timestamp, event_id) as nth from otel_logs where event_name = 'hook_posttooluse')
        select pre.event_id as pre_id, post.event_id as post_id from pre left join post on pre.session_id = post.session_id and pre.tool_name = post.tool_name and pre.nth = post.nth""",
    "pair_pre_post_legacy": """
        select coalesce(a.session_id, b.session_id) as session_id, coalesce(a.tool_name, b.tool_name) as tool_name, a.last_pre, b.first_post
        from (select session_id, tool_name, max(event_id) as last_pre from otel_logs where event_name = 'hook_pretooluse' group by session_id, tool_name) a
        full outer join (select session_id, tool_name, min(event_id) as first_post from otel_logs where event_name = 'hook_posttooluse' group by session_id, tool_name) b on a.session_id = b.session_id and a.tool_name = b.tool_name""",
    "pair_pre_post_adjacent": """
        select post_id, pre_id from (
          select event_id as post_id, event_name, lag(event_id) over (partition by session_id order by timestamp, event_id) as pre_id, lag(event_name) over (partition by session_id order by timestamp, event_id) as before_name
          from otel_logs where event_name in ('hook_pretooluse', 'hook_posttooluse')) e where event_name = 'hook_posttooluse' and before_name = 'hook_pretooluse'""",
    "agent_scope_flat": f"""with {_EVENTS}, groups as (select *, sum(case when agent_name <> '' then 1 else 0 end) over (partition by session_id order by event_index rows unbounded preceding) as opened,
          sum(case when event_name = 'hook_stop' then 1 else 0 end) over (partition by session_id order by event_index rows unbounded preceding) - case when event_name = 'hook_stop' then 1 else 0 end as stops from ordered)
        select event_id, max(nullif(agent_name, '')) over (partition by session_id, opened, stops) as scope from groups""",
    "turn_agent_scopes": f"""with {_EVENTS} select session_id, cast(turn_id as bigint) as turn_id, agent_name, min(event_index) as first_index, max(event_index) as last_index, count(*) as events from ordered where agent_name <> '' group by session_id, turn_id, agent_name""",
    "materialize_spans": """
        select event_id, session_id, case event_name when 'hook_posttooluse' then 'tool_call' when 'hook_posttoolusefailure' then 'tool_call' when 'hook_userpromptsubmit' then 'user_prompt' when 'hook_stop' then 'agent_response' else 'other' end as type,
               case when event_name = 'hook_posttoolusefailure' then 'error' else 'success' end as status, substring(tool_response, 1, 2000) as output from otel_logs where event_name <> 'hook_pretooluse'""",
    "materialize_trace": f"""with {_EVENTS} select session_id, max(nullif(model, '')) as model, count(*) as spans, count_if(action = 'tool_use') as tools, max(case when event_name = 'hook_stop' then event_index end) as last_stop from ordered group by session_id""",
    "action_events": f"with {_EVENTS}, {_WRITES} select session_id, event_index, act, file, content, round(cost, 6) as cost from acts",
    "span_tree_roots": "select s.span_id, p.span_id is null as is_root from spans s left join spans p on s.parent_span_id = p.span_id and s.trace_id = p.trace_id",
    # process efficiency
    "write_batches": f"""with {_EVENTS}, {_WRITES} select session_id, batch, count(*) as writes from (select *, sum(case when act = 'bash' then 1 else 0 end) over (partition by session_id order by event_index rows unbounded preceding) as batch from acts) b
        where act = 'write' group by session_id, batch""".replace("select session_id, batch, count", "select session_id, cast(batch as bigint) as batch, count"),
    "unresolved_errors": f"""with {_EVENTS}, {_WRITES} select session_id, event_index from (select *, max(case when act = 'write' then 1 else 0 end) over (partition by session_id order by event_index rows between 1 following and 5 following) as fixed from acts) a where failed = 1 and coalesce(fixed, 0) = 0""",
    "detect_reverts": f"""with {_EVENTS}, {_WRITES} select session_id, file, event_index, previous from (select *, lag(event_index) over (partition by session_id, file, content order by event_index) as previous,
          lag(event_index) over (partition by session_id, file order by event_index) as just_before from acts where act in ('write', 'read')) r where previous is not null and previous < just_before""",
    "conditional_entropy": f"""with {_EVENTS}, {_WRITES}, bigrams as (select session_id, before_act, act, count(*) as n from (select session_id, act, lag(act) over (partition by session_id order by event_index) as before_act from acts) l where before_act is not null group by session_id, before_act, act),
        totals as (select *, sum(n) over (partition by session_id, before_act) as of_before, sum(n) over (partition by session_id) as of_all from bigrams)
        select session_id, round(-sum(cast(n as double) / of_all * ln(cast(n as double) / of_before) / ln(2)), 6) + 0.0 as entropy from totals group by session_id""",
    "marginal_entropy": f"""with {_EVENTS}, {_WRITES}, counts as (select session_id, act, count(*) as n from acts group by session_id, act), totals as (select *, sum(n) over (partition by session_id) as of_all from counts)
        select session_id, round(-sum(cast(n as double) / of_all * ln(cast(n as double) / of_all) / ln(2)), 6) + 0.0 as entropy from totals group by session_id""",
    "target_entropy": f"""with {_EVENTS}, {_WRITES}, counts as (select session_id, act, file, count(*) as n from acts group by session_id, act, file), totals as (select *, sum(n) over (partition by session_id) as of_all from counts)
        select session_id, round(-sum(cast(n as double) / of_all * ln(cast(n as double) / of_all) / ln(2)), 6) + 0.0 as entropy, count(*) as targets from totals group by session_id""",
    "normalized_entropy": f"""with {_EVENTS}, {_WRITES}, counts as (select session_id, act, file, count(*) as n from acts group by session_id, act, file), totals as (select *, sum(n) over (partition by session_id) as of_all from counts)
        select session_id, round(least(-sum(cast(n as double) / of_all * ln(cast(n as double) / of_all) / ln(2)) / (ln(count(*) + 1) / ln(2)), 1), 6) + 0.0 as normalized from totals group by session_id""",
    "file_churn_rate": f"with {_EVENTS}, {_WRITES} select session_id, round(cast(count_if(act = 'write') as double) / nullif(count(distinct case when act = 'write' then file end), 0), 6) as churn, count_if(failed = 1) as build_errors from acts group by session_id",
    "final_session_success": f"with {_EVENTS} select session_id, event_name <> 'hook_posttoolusefailure' as succeeded from (select *, max(event_index) over (partition by session_id) as last_index from ordered) o where event_index = last_index",
    "redundant_reads": f"with {_EVENTS}, {_WRITES} select session_id, event_index from (select *, row_number() over (partition by session_id, file, content order by event_index) as nth from acts where act = 'read') r where nth > 1",
    # ingestion rules that SQL states
    "normalize_service": "select event_id, case when service_name = 'observability-hooks' then 'claude-code' else service_name end as service from otel_logs",
    "ingest_tool_calls": "select span_id as event_id, name as tool_name, status, latency_ms, start_time as timestamp from spans where type = 'tool_call'",
    "ingest_agent_interactions": "select trace_id as event_id, agent_id, trace_type as user_action, start_time as timestamp from traces where agent_id <> ''",
    "ingest_security_events": "select event_id, timestamp, severity, coalesce(actor_email, '') as actor_email, coalesce(http_method, '') as detail from audit_log where severity <> 'info'",
    "registry_event_rows": "select event_id, 'registry' as trace_type, split_part(action, '.', 1) as tag, action, actor_id from audit_log",
    "mirror_shim_spans": "select t.session_id, s.span_id, case when s.status = 'error' then 'ERROR' else 'INFO' end as severity, 'shim: ' || s.type || ' ' || s.name || ' (' || cast(s.latency_ms as string) || 'ms)' as body from spans s join traces t on s.trace_id = t.trace_id where t.session_id <> ''",
    "sideload_shim_spans": """
        select w.session_id, s.span_id from (select session_id, user_id, min(start_time) as first_seen, max(start_time) as last_seen from traces group by session_id, user_id) w
        join spans s on s.user_id = w.user_id and s.start_time between w.first_seen - interval '2' second and w.last_seen + interval '2' second where s.type in ('tool_call', 'retrieval')""",
}

EFFECT = f"""with {_EVENTS}, {_WRITES}, judged as (
      select *, row_number() over (partition by session_id, act, file, content order by event_index) as nth,
             lag(event_index) over (partition by session_id, file, content order by event_index) as same_before, lag(event_index) over (partition by session_id, file order by event_index) as just_before,
             lead(act) over (partition by session_id order by event_index) as next_act, max(event_index) over (partition by session_id) as last_index from acts),
    classed as (select *, case when act = 'read' and nth > 1 then 'redundant_read' when same_before < just_before then 'revert_cycle' when nth > 2 then 'repetition_loop' end as waste from judged)"""

QUERIES |= {
    "first_pass_success": f"{EFFECT} select session_id, round(cast(count_if(act = 'write' and coalesce(waste, '') <> 'revert_cycle') as double) / nullif(count_if(act = 'write'), 0), 6) as share from classed group by session_id",
    "backtrack_depth": f"{EFFECT} select session_id, coalesce(max(case when waste = 'revert_cycle' then event_index - same_before end), 0) as depth from classed group by session_id",
    "build_error_count": f"{EFFECT} select session_id, count_if(act = 'bash' and failed = 1) as errors from classed group by session_id",
    "prev_next_delta": f"{EFFECT} select session_id, event_index, next_act, case when next_act = act then 1 else 0 end as repeats from classed where event_index < last_index",
    "session_events": f"with {_EVENTS} select session_id, event_index, event_id, action, cast(turn_id as bigint) as turn_id, tool_name from ordered where session_id <> ''",
    "agent_in_session": f"""with {_EVENTS}, held as (select *, max(case when event_name = 'api_request' then event_index end) over (partition by session_id order by event_index rows unbounded preceding) as started,
          max(case when event_name = 'hook_stop' then event_index end) over (partition by session_id order by event_index rows between unbounded preceding and 1 preceding) as stopped from ordered)
        select session_id, started, count(*) as events, max(event_index) as last_index from held where started is not null and (stopped is null or stopped < started) group by session_id, started""",
    "spans_to_scores_join": "select s.span_id, t.template, case when s.status = 'success' then 0.8 else 0.2 end as score from spans s join (select 'tool_call' as applies_to, 'tool_quality' as template union all select 'llm', 'answer_quality') t on s.type = t.applies_to",
    "heuristic_interaction_scorecard": "select trace_id, round(0.6 + 0.4 * cast(count_if(status = 'success') as double) / count(*), 6) as outcome, round(greatest(0.0, 1.0 - avg(latency_ms) / 10000), 6) as speed, least(cast(count_if(type = 'tool_call') as bigint), 5) as effort from spans group by trace_id",
    "supported_ides": """select c.agent_id, i.ide from (select agent_id, count_if(component_type in ('hook', 'sandbox')) as special, count_if(component_type = 'skill') as skills from agent_components group by agent_id) c
        join (select 'claude' as ide, 1 as has_special, 1 as has_skills union all select 'cursor', 0, 1 union all select 'kiro', 0, 0) i on (c.special = 0 or i.has_special = 1) and (c.skills = 0 or i.has_skills = 1)""",
    "ingest_audit": "select event_id, timestamp, coalesce(actor_email, '') as actor_email, coalesce(http_method, '') as http_method, action from audit_log",
    "ingest_webhook_deliveries": "select event_id as delivery_id, timestamp, case when severity = 'critical' then 500 else 200 end as status_code, 1 as attempt from audit_log where action like 'error%' or action like 'signup%'",
    "export_registry_jsonl": "select agent_id as id, 'agent' as kind, name from agents union all select listing_id, listing_type, name from listings",
    "buffer_retry": "select case when severity = 'critical' and event_id % 3 = 0 then 'dropped' when severity = 'critical' then 'retried' else 'sent' end as state, count(*) as n from audit_log group by 1",
}
