"""Queries over the acts of agent sessions, and SQL of its own for each: the causal graph, cycles, reverts, waste, dependencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import process, quality
from spanloom.sources.views import Views, checked_by


def acts(v: Views) -> DataFrame:
    """The acts with their files as a list, computed once: most operators read them several times."""
    return v.once("acts", lambda: v.agent_acts.withColumn("files", F.filter(F.array("file1", "file2"), lambda f: f.isNotNull())).drop("file1", "file2"))


def _over(operator: Callable[[DataFrame], DataFrame], *rounded: str) -> Callable[[Views], DataFrame]:
    return lambda v: (out := operator(acts(v))).select(*(F.round(c, 8).alias(c) if c in rounded else c for c in out.columns))


def cycles(v: Views) -> DataFrame:
    rows = acts(v).select("session_id", (F.col("node_id") - 1).alias("at"), process.action_key().alias("key"))  # nodes count from 1
    return process.repetition_cycles(rows)


def metrics(v: Views) -> DataFrame:
    """The profile of each session with the ratios that its rating and labels ask for, computed once."""
    share = lambda c: F.col(c) / F.col("total_events")
    ratios = {"duplicate_ratio": share("duplicate_tool_call_count"), "redundant_read_ratio": share("redundant_reads"), "cycle_ratio": share("repetition_cycles")}
    return v.once("profile", lambda: process.session_profile(acts(v)).withColumns(ratios))


def rates(name: str) -> Callable[[Views], DataFrame]:
    return lambda v: process.efficiency(acts(v)).select("session_id", F.round(name, 8).alias(name))


def verdicts(v: Views) -> DataFrame:
    """What a judge might have said of each session: grades and scores by its number, the ranges of its loops as waste."""
    number = F.substring("session_id", 2, 10).cast("int")
    loops = process.waste_classes(acts(v)).filter("category = 'repetition_loop'").groupBy("session_id").agg(F.collect_list(F.struct(F.col("first_node").alias("first"), F.col("last_node").alias("last"))).alias("ranges"))
    kinds = F.array(*map(F.lit, quality.JUDGE_BOUNDS))
    return metrics(v).join(loops, "session_id", "left").withColumns({
        "complexity": F.get(kinds, number % 3), "grade": F.get(F.array(*map(F.lit, "ABCD")), number % 4), "correctness_score": number % 8 - 1.0, "completeness_score": number % 13 / 2, "minimality_score": F.when(number % 5 > 0, 3.0),
    })


RATES = ("path_efficiency_ratio", "token_waste_rate", "first_pass_success_rate", "write_without_verify_ratio", "file_churn_rate")

QUERIES = {
    "causal_edges": _over(process.causal_edges),
    "critical_path": _over(process.critical_path),
    "changesets": _over(process.changesets),
    "changeset_status": _over(process.changeset_status),
    "repetition_cycles": cycles,
    "act_reverts": _over(process.reverts),
    "effective_events": lambda v: process.judged(acts(v)).filter("effective").select("session_id", "node_id", "action_type"),
    "waste_classes": _over(process.waste_classes),
    "path_efficiency": rates("path_efficiency"),
    "token_waste_rate": rates("token_waste_rate"),
    "dag_nodes": _over(process.dag_nodes),
    "dag_edges": _over(process.dag_edges),
    "dag_stats": _over(process.dag_stats),
    "orphan_dependencies": _over(process.orphan_dependencies),
    "shell_mutation_warnings": _over(process.shell_mutation_warnings),
    "per_trace_metrics": _over(process.per_trace_metrics, *RATES),
    "session_metrics": lambda v: metrics(v).select(*(F.round(c, 8).alias(c) if c in RATES or "ratio" in c else c for c in metrics(v).columns)),
    "efficiency_warnings": lambda v: process.efficiency_warnings(metrics(v)),
    "efficiency_rating": lambda v: quality.efficiency_rating(metrics(v)).select("session_id", F.round("rating", 6).alias("rating"), *(F.round(f"s_{n}", 6).alias(f"s_{n}") for n in quality.EFFICIENCY)),
    "metric_labels": lambda v: quality.metric_labels(metrics(v)),
    "sigmoid_normalize": lambda v: metrics(v).select("session_id", F.round(quality.sigmoid(F.col("path_efficiency_ratio"), 0.5, 6.0), 8).alias("higher"), F.round(quality.sigmoid(F.col("token_waste_rate"), 0.3, 6.0, invert=True), 8).alias("lower")),
    "validate_judge": lambda v: quality.validate_judge(verdicts(v)).select("session_id", "grade", *quality.JUDGE_SCORES, F.array_join("corrections", "; ").alias("corrections")),
}

_EDGES = r"""
    files as (select session_id, node_id, action_type, unnest([file1, file2]) as file from agent_acts),
    touched as (select * from files where file is not null),
    writes as (select session_id, node_id, file from touched where action_type in ('file_write', 'file_delete')),
    writer as (
        select a.session_id, a.node_id, w.file, max(w.node_id) as src
        from agent_acts a join writes w on w.session_id = a.session_id and w.node_id < a.node_id group by all
    ),
    tokens as (select session_id, node_id, unnest(regexp_extract_all(detail, '[\w./\-]{4,}')) as token from agent_acts),
    code as (
        select distinct * from tokens
        where regexp_matches(token, '[/._\-:0-9]') or (regexp_matches(token[2:], '[A-Z]') and regexp_matches(token, '[a-z]'))
    ),
    reasons as (
        select w.session_id, w.src, w.node_id as dst, 1 as rank, 'file' as kind
        from writer w join touched t on t.session_id = w.session_id and t.node_id = w.node_id and t.file = w.file
        union all
        select w.session_id, w.src, w.node_id, 2, 'command'
        from writer w join agent_acts a on a.session_id = w.session_id and a.node_id = w.node_id
        where a.action_type = 'bash' and contains(a.detail, w.file)
        union all
        select c.session_id, b.node_id, c.node_id, 3, 'output'
        from code c join agent_acts b on b.session_id = c.session_id and b.node_id between c.node_id - 20 and c.node_id - 1
        where b.output <> '' and contains(b.output, c.token)
    ),
    every as (
        select session_id, src, dst, rank, kind from reasons
        union all
        select session_id, node_id - 1, node_id, 4, 'order' from agent_acts a
        where node_id > 1 and not exists (select 1 from reasons r where r.session_id = a.session_id and r.dst = a.node_id)
    ),
    edges as (select session_id, src, dst, arg_min(kind, rank) as kind from every group by session_id, src, dst)"""

_REVERTS = """
    places as (
        select session_id, node_id, action_type, result_hash, file, nth,
            row_number() over (partition by session_id, file order by node_id, nth) as place
        from (select session_id, node_id, action_type, result_hash, unnest([file1, file2]) as file, unnest([0, 1]) as nth from agent_acts)
        where file is not null
    ),
    states as (select * from places where action_type <> 'file_read' or place = 1),
    neighbours as (
        select a.session_id, a.file, a.place as low, min(b.place) as high from states a join states b
            on a.session_id = b.session_id and a.file = b.file and a.result_hash = b.result_hash and b.place > a.place
        group by a.session_id, a.file, a.place
    ),
    between_them as (
        select s.session_id, s.node_id, s.file, max(n.high) as high from states s join neighbours n
            on n.session_id = s.session_id and n.file = s.file and s.place > n.low and s.place < n.high
        group by s.session_id, s.node_id, s.file
    ),
    opened as (select session_id, file, min((node_id, nth)) as first from places group by session_id, file),
    reverted as (
        select b.session_id, b.node_id, arg_max(s.node_id, o.first) as reverted_by
        from between_them b join states s on s.session_id = b.session_id and s.file = b.file and s.place = b.high
        join opened o on o.session_id = b.session_id and o.file = b.file group by b.session_id, b.node_id
    )"""

#: Patterns by the definition: where the keys agree with those `length` further on for at least 2 * length places.
_CYCLES = r"""
    keyed as (
        select session_id, node_id - 1 as at_act, action_type || case when action_type like 'file%' then ':' || detail
            when action_type in ('bash', 'mcp_meta') then ':' || regexp_extract(trim(detail), '^\S+', 0) else '' end || '#' || result_hash as act_key
        from agent_acts
    ),
    sessions as (select session_id, list(act_key order by at_act) as keys, count(*) as n from keyed group by session_id),
    lengths as (select session_id, keys, n, unnest(range(2, n // 3 + 1)) as length from sessions),
    pairs as (select session_id, keys, n, length, unnest(range(0, n - length)) as start from lengths),
    agreeing as (
        select session_id, keys, length, start, min(case when keys[start + 1] <> keys[start + length + 1] then start end)
            over (partition by session_id, length order by start rows between current row and unbounded following) as parting, n
        from pairs
    ),
    found as (
        select session_id, length, start, (coalesce(parting, n - length) - start) // length + 1 as times,
            array_to_string(keys[start + 1:start + length], '|') as pattern, array_to_string(keys[start + 1:start + least(length, 3)], '|') as head
        from agreeing where coalesce(parting, n - length) - start >= 2 * length
    ),
    cycles as (
        select session_id, arg_min(start, start) as start, length, arg_min(times, start) as times, arg_min(head, start) as head
        from found group by session_id, length, pattern
    )"""

_JUDGED = f"""{_REVERTS}, {_CYCLES},
    looped as (
        select distinct a.session_id, a.node_id from agent_acts a join cycles c
            on c.session_id = a.session_id and a.node_id - 1 between c.start + c.length and c.start + c.length * c.times - 1
    ),
    marked as (
        select a.*, r.reverted_by, r.node_id is not null or l.node_id is not null or a.action_type = 'mcp_meta' as gone
        from agent_acts a left join reverted r on r.session_id = a.session_id and r.node_id = a.node_id
        left join looped l on l.session_id = a.session_id and l.node_id = a.node_id
    ),
    judged as (
        select m.*, not gone and not (action_type = 'file_read' and exists (
            select 1 from marked b where b.session_id = m.session_id and b.node_id < m.node_id and b.action_type = 'file_read'
                and not b.gone and b.detail = m.detail and b.result_hash = m.result_hash)) as effective
        from marked m
    )"""

#: Sets as what links of a common parent or a near intent lead to, by a recursive walk.
_CHANGESETS = f"""{_EDGES},
    hops as (
        select session_id, dst, src, 1 as far from edges
        union
        select h.session_id, h.dst, e.src, h.far + 1 from hops h join edges e on e.session_id = h.session_id and e.dst = h.src where h.far < 3
    ),
    marks as (
        select w.session_id, w.node_id, h.src, 'parent' as kind from agent_acts w join hops h on h.session_id = w.session_id and h.dst = w.node_id
        where h.far = 1 and w.action_type in ('file_write', 'file_delete')
        union
        select w.session_id, w.node_id, h.src, 'intent' from agent_acts w join hops h on h.session_id = w.session_id and h.dst = w.node_id
        join agent_acts a on a.session_id = h.session_id and a.node_id = h.src
        where a.action_type in ('think', 'search') and w.action_type in ('file_write', 'file_delete')
    ),
    links as (
        select distinct a.session_id, a.node_id, b.node_id as other from marks a join marks b on a.session_id = b.session_id and a.src = b.src and a.kind = b.kind
        union
        select session_id, node_id, node_id from agent_acts where action_type in ('file_write', 'file_delete')
    ),
    reach as (
        select session_id, node_id, other from links
        union
        select r.session_id, r.node_id, l.other from reach r join links l on l.session_id = r.session_id and l.node_id = r.other
    ),
    sets as (select session_id, node_id, min(other) as changeset from reach group by session_id, node_id)"""

#: Of the shell commands and outputs that the view has, those that change files, verify and fail.
_CHANGES, _VERIFY, _ERROR = "(sed -i|install|make|> out)", "(pytest|make)", "FAILED"
_SHARES = """count(*) as total_events, count_if(effective)::bigint as effective_events, count_if(effective) / count(*) as path_efficiency_ratio,
    sum(case when effective then 0 else cost end) / nullif(sum(cost), 0) as token_waste_rate,
    count_if(action_type in ('file_write', 'file_delete') and reverted_by is null) / nullif(count_if(action_type in ('file_write', 'file_delete')), 0) as first_pass_success_rate"""
_PROFILE = f"""{_JUDGED},
    shares as (select session_id, {_SHARES}, count(reverted_by) as backtrack_depth from judged group by session_id),
    errors as (
        select a.session_id, count(*) as build_error_count, count_if(not exists (select 1 from agent_acts b where b.session_id = a.session_id
            and b.node_id between a.node_id + 1 and a.node_id + 5 and b.action_type = 'file_write'))::bigint as unresolved_error_count
        from agent_acts a where a.action_type = 'bash' and contains(a.output, '{_ERROR}') group by a.session_id
    ),
    written as (select session_id, node_id, lead(node_id) over (partition by session_id order by node_id) as next_write from agent_acts where action_type = 'file_write'),
    batches as (
        select w.session_id, w.node_id, bool_or(regexp_matches(a.detail, '{_VERIFY}')) as verified from written w
        left join agent_acts a on a.session_id = w.session_id and a.action_type = 'bash' and a.node_id > w.node_id and a.node_id < coalesce(w.next_write, 1000000)
        group by w.session_id, w.node_id, w.next_write having count(a.node_id) > 0 or w.next_write is null
    ),
    unverified as (select session_id, count_if(not coalesce(verified, false)) / count(*) as write_without_verify_ratio from batches group by session_id),
    contents as (
        select session_id, file, count(distinct result_hash) as n from (select session_id, result_hash, unnest([file1, file2]) as file from agent_acts where action_type = 'file_write')
        where file is not null group by session_id, file
    ),
    churn as (select session_id, count_if(n >= 2) / count(*) as file_churn_rate from contents group by session_id),
    again as (
        select session_id, sum(n - 1)::bigint as redundant_reads from (select session_id, detail, result_hash, count(*) as n from agent_acts where action_type = 'file_read' group by all)
        group by session_id
    ),
    rounds as (select session_id, count(*) as repetition_cycles from cycles group by session_id),
    same as (
        select session_id, sum(n - 1)::bigint as duplicate_tool_call_count from (
            select session_id, action_type, detail, count(*) as n from agent_acts where action_type not in ('think', 'mcp_meta') group by all) group by session_id
    ),
    profile as (
        select s.*, coalesce(duplicate_tool_call_count, 0) as duplicate_tool_call_count, coalesce(repetition_cycles, 0) as repetition_cycles, coalesce(build_error_count, 0) as build_error_count, coalesce(unresolved_error_count, 0) as unresolved_error_count,
            coalesce(write_without_verify_ratio, 0) as write_without_verify_ratio, coalesce(file_churn_rate, 0) as file_churn_rate, coalesce(redundant_reads, 0) as redundant_reads
        from shares s left join rounds r on r.session_id = s.session_id left join errors e on e.session_id = s.session_id left join unverified u on u.session_id = s.session_id
        left join churn c on c.session_id = s.session_id left join same m on m.session_id = s.session_id left join again a on a.session_id = s.session_id
    )"""

_STATUS = "case when reverted_by is not null then 'reverted' when effective then 'effective' else 'waste' end"


def _score(name: str) -> str:
    """A sub-score in SQL: linear to the threshold, logistic beyond it, scaled to meet at 0.95."""
    metric, _, middle, steep, threshold, more = quality.EFFICIENCY[name]
    source = {"duplicate_ratio": "duplicate_tool_call_count / total_events", "cycle_ratio": "repetition_cycles / total_events", "redundant_read_ratio": "redundant_reads / total_events"}.get(metric, metric)
    x, sign = f"({source})", "-" if more else ""
    curve = f"0.95 * (1 + exp({sign}{steep} * ({threshold} - {middle}))) / (1 + exp({sign}{steep} * ({x} - {middle})))"
    if more:
        return f"case when {x} >= 1 then 1 when {x} >= {threshold} then 0.95 + 0.05 * ({x} - {threshold}) / (1 - {threshold}) else {curve} end" if metric not in quality.OPTIONAL else f"case when {x} is null then null when {x} >= 1 then 1 when {x} >= {threshold} then 0.95 + 0.05 * ({x} - {threshold}) / (1 - {threshold}) else {curve} end"
    return f"case when {x} is null then null when {x} <= 0 then 1 when {x} <= {threshold} then 1 - 0.05 * {x} / {threshold} else {curve} end"


_ORPHANS = r"""
    with commands as (
        select session_id, regexp_extract(detail, '(?i)(?:npm\s+install|npm\s+i|yarn\s+add|pip\s+install|pip3\s+install|pipenv\s+install|poetry\s+add|cargo\s+add|go\s+get)\s+(.+)', 1) as rest
        from agent_acts where action_type = 'bash'
    ), words as (select session_id, unnest(regexp_split_to_array(rest, '\s+')) as word from commands where rest <> ''),
    packages as (select distinct session_id, regexp_extract(word, '^[^@=<>~!]*', 0) as package from words where not starts_with(word, '-')),
    texts as (select session_id, unnest([output, detail]) as text from agent_acts where action_type = 'file_write')
    select p.session_id, p.package from packages p
    where p.package <> '' and not exists (select 1 from texts t where t.session_id = p.session_id and contains(t.text, p.package))"""

ORACLES = {
    name: checked_by(text)
    for name, text in {
        "causal_edges": f"with {_EDGES} select session_id, src, dst, kind from edges",
        "dag_edges": f"""with {_EDGES} select e.session_id, e.src, e.dst, e.kind, case when a.trace_id <> b.trace_id then 'cross_trace' else 'causal' end as type
            from edges e join agent_acts a on a.session_id = e.session_id and a.node_id = e.src join agent_acts b on b.session_id = e.session_id and b.node_id = e.dst""",
        "act_reverts": f"with {_REVERTS} select session_id, node_id, reverted_by from reverted",
        "repetition_cycles": f"with {_CYCLES} select session_id, start, length, times, head from cycles",
        "effective_events": f"with {_JUDGED} select session_id, node_id, action_type from judged where effective",
        "path_efficiency": f"with {_JUDGED} select session_id, round(count_if(effective) / count(*), 8) as path_efficiency from judged group by session_id",
        "token_waste_rate": f"""with {_JUDGED} select session_id, round(sum(case when effective then 0 else cost end) / nullif(sum(cost), 0), 8) as token_waste_rate
            from judged group by session_id""",
        "dag_nodes": f"with {_JUDGED} select session_id, node_id, trace_id, action_type, substring(detail, 1, 120) as detail, {_STATUS} as status, reverted_by from judged",
        "dag_stats": f"""with {_JUDGED}, {_EDGES}, per_node as (select session_id, {_STATUS} as status from judged)
            select n.session_id, n.nodes, n.effective, n.reverted, n.waste, e.edges, n.nodes - e.caused as roots
            from (select session_id, count(*) as nodes, count_if(status = 'effective')::bigint as effective, count_if(status = 'reverted')::bigint as reverted,
                         count_if(status = 'waste')::bigint as waste from per_node group by session_id) n
            join (select session_id, count(*) as edges, count(distinct dst) as caused from edges group by session_id) e on e.session_id = n.session_id""",
        "waste_classes": f"""with {_REVERTS}, {_CYCLES},
            windows as (
                select a.session_id, a.node_id, a.node_id + 4 as last_node from agent_acts a
                join agent_acts b on b.session_id = a.session_id and b.node_id between a.node_id and a.node_id + 4
                group by a.session_id, a.node_id
                having count(*) = 5 and count(distinct case when b.action_type = 'file_read' then b.detail end) >= 4
            )
            select session_id, 'revert_cycle' as category, node_id as first_node, node_id as last_node from reverted
            union all
            select session_id, 'redundant_read', node_id, node_id from agent_acts a where action_type = 'file_read' and exists (
                select 1 from agent_acts b where b.session_id = a.session_id and b.node_id < a.node_id and b.action_type = 'file_read'
                    and b.detail = a.detail and b.result_hash = a.result_hash)
            union all
            select session_id, 'context_thrashing', min(node_id), min(last_node) from windows group by session_id
            union all
            select session_id, 'repetition_loop', start + 1, start + length * times from cycles""",
        "changesets": f"with recursive {_CHANGESETS} select session_id, node_id, changeset from sets",
        "changeset_status": f"""with recursive {_CHANGESETS}, {_REVERTS}
            select s.session_id, s.changeset, count(*) as writes, case when count(r.node_id) = count(*) then 'full' when count(r.node_id) > 0 then 'partial' else 'effective' end as status
            from sets s left join reverted r on r.session_id = s.session_id and r.node_id = s.node_id group by s.session_id, s.changeset""",
        "orphan_dependencies": _ORPHANS,
        "shell_mutation_warnings": f"select session_id, node_id, substring(detail, 1, 120) as command from agent_acts where action_type = 'bash' and regexp_matches(detail, '{_CHANGES}')",
        "per_trace_metrics": f"""with {_JUDGED}, shares as (select session_id, trace_id, {_SHARES} from judged group by session_id, trace_id)
            select * replace (round(path_efficiency_ratio, 8) as path_efficiency_ratio, round(token_waste_rate, 8) as token_waste_rate, round(first_pass_success_rate, 8) as first_pass_success_rate) from shares""",
        "session_metrics": f"""with {_PROFILE}, orphans as ({_ORPHANS})
            select p.* replace (round(path_efficiency_ratio, 8) as path_efficiency_ratio, round(token_waste_rate, 8) as token_waste_rate, round(first_pass_success_rate, 8) as first_pass_success_rate,
                round(write_without_verify_ratio, 8) as write_without_verify_ratio, round(file_churn_rate, 8) as file_churn_rate),
                (select count(*) from orphans o where o.session_id = p.session_id) as orphan_dependency_count, round(duplicate_tool_call_count / total_events, 8) as duplicate_ratio,
                round(redundant_reads / total_events, 8) as redundant_read_ratio, round(repetition_cycles / total_events, 8) as cycle_ratio
            from profile p""",
        "efficiency_rating": f"""with {_PROFILE}, scored as (
                select session_id, total_events, {", ".join(f"{_score(n)} as s_{n}" for n in quality.EFFICIENCY)} from profile
            ), rated as (
                select *, least({", ".join(f"s_{n}" for n in quality.EFFICIENCY)}) as worst,
                    exp(({" + ".join(f"coalesce({w} * ln(s_{n}), 0)" for n, (_, w, *_) in quality.EFFICIENCY.items())}) / ({" + ".join(f"case when s_{n} is null then 0 else {w} end" for n, (_, w, *_) in quality.EFFICIENCY.items())})) as mean
                from scored
            )
            select session_id, case when worst <= 0 then 0 else round(mean * case when worst < 0.3 then (worst / 0.3) ** 2 else 1 end, 6) end as rating, {", ".join(f"round(s_{n}, 6) as s_{n}" for n in quality.EFFICIENCY)} from rated""",
        "metric_labels": f"""with {_PROFILE}
            select session_id, 'path_efficiency_ratio' as metric, case when path_efficiency_ratio >= 0.85 then 'Excellent' when path_efficiency_ratio >= 0.7 then 'Good' when path_efficiency_ratio >= 0.5 then 'Fair' else 'Poor' end as label from profile
            union all select session_id, 'token_waste_rate', case when token_waste_rate is null then 'N/A' when token_waste_rate <= 0.1 then 'Excellent' when token_waste_rate <= 0.25 then 'Good' when token_waste_rate <= 0.4 then 'Fair' else 'High' end from profile
            union all select session_id, 'first_pass_success_rate', case when first_pass_success_rate is null then 'N/A' when first_pass_success_rate >= 0.9 then 'Excellent' when first_pass_success_rate >= 0.7 then 'Good' when first_pass_success_rate >= 0.5 then 'Fair' else 'Poor' end from profile
            union all select session_id, 'write_without_verify_ratio', case when write_without_verify_ratio <= 0.2 then 'Excellent' when write_without_verify_ratio <= 0.4 then 'Good' when write_without_verify_ratio <= 0.6 then 'Fair' else 'High' end from profile
            union all select session_id, 'file_churn_rate', case when file_churn_rate <= 0.1 then 'Excellent' when file_churn_rate <= 0.25 then 'Good' when file_churn_rate <= 0.4 then 'Fair' else 'High' end from profile
            union all select session_id, 'repetition_cycles', case when repetition_cycles <= 0 then 'None' when repetition_cycles <= 2 then 'Minor' else 'Significant' end from profile
            union all select session_id, 'duplicate_tool_call_count', case when duplicate_tool_call_count <= 0 then 'None' when duplicate_tool_call_count <= 2 then 'Minor' else 'Significant' end from profile""",
        "sigmoid_normalize": f"""with {_PROFILE} select session_id, round(1 / (1 + exp(-6 * (path_efficiency_ratio - 0.5))), 8) as higher,
            round(coalesce(1 - 1 / (1 + exp(-6 * (token_waste_rate - 0.3))), 0), 8) as lower from profile""",
        "validate_judge": f"""with {_PROFILE}, ranges as (select session_id, start + 1 as first, start + length * times as last from cycles),
            steps as (select session_id, count(distinct step) as covered from (select session_id, unnest(generate_series(first, last)) as step from ranges) group by session_id),
            judged_by as (
                select p.*, coalesce(covered, 0) as covered, cast(substring(p.session_id, 2) as int) as number, [0.5, 0.15, 0.35][cast(substring(p.session_id, 2) as int) % 3 + 1] as floor_of, [0.4, 0.7, 0.5][cast(substring(p.session_id, 2) as int) % 3 + 1] as ceiling_of
                from profile p left join steps s on s.session_id = p.session_id
            ), told as (
                select *, path_efficiency_ratio < floor_of and number % 4 < 2 as lowered, coalesce(token_waste_rate, 0) > ceiling_of and total_events > effective_events and covered < 0.5 * (total_events - effective_events) as uncovered
                from judged_by
            )
            select session_id, case when lowered then 'C' else substring('ABCD', number % 4 + 1, 1) end as grade, least(greatest(number % 8 - 1.0::double, 1), 5) as correctness_score,
                least(greatest((number % 13) / 2::double, 1), 5) as completeness_score, case when number % 5 > 0 then 3.0::double end as minimality_score,
                concat_ws('; ', case when lowered then 'grade ' || substring('ABCD', number % 4 + 1, 1) || ' lowered to C' end, case when uncovered then 'waste is hardly covered' end,
                    case when number % 8 - 1 < 1 or number % 8 - 1 > 5 then 'correctness_score clamped' end, case when (number % 13) / 2 < 1 or (number % 13) / 2 > 5 then 'completeness_score clamped' end) as corrections
            from told""",
        "efficiency_warnings": f"""with {_PROFILE}
            select session_id, 'path_efficiency_ratio' as metric, round(path_efficiency_ratio, 4) as value from profile where path_efficiency_ratio < 0.5
            union all select session_id, 'token_waste_rate', round(token_waste_rate, 4) from profile where token_waste_rate > 0.4
            union all select session_id, 'first_pass_success_rate', round(first_pass_success_rate, 4) from profile where first_pass_success_rate < 0.5
            union all select session_id, 'write_without_verify_ratio', round(write_without_verify_ratio, 4) from profile where write_without_verify_ratio > 0.6
            union all select session_id, 'file_churn_rate', round(file_churn_rate, 4) from profile where file_churn_rate > 0.4
            union all select session_id, 'repetition_cycles', repetition_cycles from profile where repetition_cycles >= 3
            union all select session_id, 'redundant_reads', redundant_reads from profile where redundant_reads >= 3""",
        "critical_path": f"""
            with recursive {_EDGES},
            walk as (
                select session_id, 1::bigint as node_id, map([1::bigint], [latency_ms]) as costs, map([1::bigint], [[1::bigint]]) as paths
                from agent_acts where node_id = 1
                union all
                select w.session_id, a.node_id,
                    map_concat(w.costs, map([a.node_id], [coalesce(w.costs[best.src], 0) + a.latency_ms])),
                    map_concat(w.paths, map([a.node_id], [list_append(coalesce(w.paths[best.src], []), a.node_id)]))
                from walk w join agent_acts a on a.session_id = w.session_id and a.node_id = w.node_id + 1,
                lateral (select list_filter(list(e.src order by w.costs[e.src] desc, e.src), lambda s: w.costs[s] > 0)[1] as src
                         from edges e where e.session_id = w.session_id and e.dst = a.node_id) best
            ),
            ends as (select session_id, arg_max(costs, node_id) as costs, arg_max(paths, node_id) as paths from walk group by session_id),
            best as (select session_id, paths, list_max(map_values(costs)) as length, list_sort(list_filter(map_keys(costs), lambda k: costs[k] = list_max(map_values(costs))))[1] as tail from ends)
            select session_id, length, paths[tail] as path from best""",
    }.items()
}
