"""Queries over structured payloads: the adversarial scan, equal calls, equal contents, numbers; with SQL of its own for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import jsontext
from spanloom.functions import text as tx
from spanloom.operators import adversarial
from spanloom.sources import ingest
from spanloom.sources.views import Views, checked_by


def equal_calls(calls: DataFrame, most: int = 5) -> DataFrame:
    """calls(trace_id, span_id, span_index, name, input) -> trace_id, span_id, same_as: the nearest call before with the same name
    and canonical input, at most `most` spans before."""
    same = Window.partitionBy("trace_id", "name", F.sha2(jsontext.canonical(F.col("input")), 256)).orderBy("span_index")
    before = calls.withColumn("b", F.lag(F.struct("span_index", "span_id")).over(same))
    return before.filter(F.col("span_index") - F.col("b.span_index") <= most).select("trace_id", "span_id", F.col("b.span_id").alias("same_as"))


def repeated_calls(calls: DataFrame) -> DataFrame:
    """calls -> trace_id, span_id, first_span: calls whose name and input, with paths in normal form, stand anywhere before."""
    same = Window.partitionBy("trace_id", "name", F.md5(jsontext.canonical(F.col("input"), paths=True))).orderBy("span_index")
    nth = calls.withColumn("nth", F.row_number().over(same)).withColumn("first_span", F.first("span_id").over(same))
    return nth.filter("nth > 1").select("trace_id", "span_id", "first_span")


def content_groups(contents: DataFrame) -> DataFrame:
    """contents(id, content) -> digest, n, first: contents of one meaning; `first` is the least id. Equal contents are digested once."""
    equal = contents.groupBy("content").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return equal.groupBy(jsontext.meaning_digest(F.col("content")).alias("digest")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def contents(v: Views) -> DataFrame:
    inputs = v.call_inputs.select(F.col("span_id").alias("id"), F.col("input").alias("content"))
    return inputs.unionByName(v.spans.select(F.col("span_id").alias("id"), F.concat(F.lit(" "), F.replace("output", F.lit(" "), F.when(F.col("retry_count") == 1, F.lit("\n  ")).otherwise(F.lit(" ")))).alias("content")))


QUERIES = {
    "schema_compliance": lambda v: ingest.schema_compliance(v.connection_messages),
    "adversarial_scan": lambda v: adversarial.adversarial_scan(v.payloads, "trace_id", "span_id", ["payload"], ["text"]),
    "tool_calls_duplicate": lambda v: equal_calls(v.call_inputs),
    "duplicate_calls": lambda v: repeated_calls(v.call_inputs),
    "content_hash_groups": lambda v: content_groups(contents(v)),
    "numbers_match": lambda v: v.spans.filter("type = 'tool_call'").select("span_id", tx.numbers_match(F.col("output"), F.concat("input", F.lit(" 1,2K 3.0%"))).alias("grounded")),
}

ORACLES = {
    name: checked_by(text)
    for name, text in {
        "schema_compliance": """
            with known as (
                select *, last_value(case when type = 'tool_list' then with_mode end ignore nulls) over (partition by conn order by start_time, id rows between unbounded preceding and 1 preceding) as mode
                from connection_messages
            )
            select conn, id, name, case when mode is null or name is null then null when name = 'tool_0' then case when given in (0, 1) then 1 else 0 end
                when name = 'tool_1' then case when given = 3 or (given = 0 and mode = 0) then 1 else 0 end when name = 'tool_2' then 1 else 0 end as tool_schema_valid,
                case when mode is not null then 3 end as tools_available
            from known where type = 'tool_call'""",
        # what is planted says what is found: `depth` brackets around `value`; strings are scanned up to 50,000 characters
        "adversarial_scan": r"""
            with placed as (
                select *, case when opened = 0 then 1 else opened + 1 end as level, length(value) + case when opened = 0 then 2 else 0 end as size from payloads
            ), seen as (
                select trace_id, span_id, type, substring(value, 1, 50000) as text, size from placed where level <= 10
                union all select trace_id, span_id, type, substring(text, 1, 50000), length(text) from payloads
            ), found as (
                select trace_id, 'html_comment_injection' as category, 'info' as severity, 'observation' as axis from seen
                where regexp_matches(text, '(?is)<!--.*?(EVALUATION|SCORE|JUDGE|RATING|OVERRIDE|ASSESSMENT|INSTRUCTION).*?-->')
                union all select trace_id, 'system_prompt_mimicry', 'info', 'observation' from seen
                where regexp_matches(text, '(?i)You are a (judge|evaluator|scorer)|Score this as|SYSTEM:|INSTRUCTION:')
                union all select trace_id, 'zero_width_unicode', 'high', 'data_integrity' from seen where regexp_matches(text, '[​‌‍﻿⁠]{6,}')
                union all select trace_id, 'score_assertion', 'info', 'observation' from payloads where span_id % 17 = 0
                union all select trace_id, 'secret_access', 'high', 'security' from payloads, (values ('SECRET_KEY'), ('API_KEY'), ('OPENAI_API_KEY')) s(name)
                where type = 'tool_call' and contains(value, name)
            ), cut as (
                select trace_id, type = 'tool_call' as of_call from seen where size > 50000
                union all select trace_id, false from placed where opened >= 10
            )
            select trace_id, category, severity, axis, count(*) as n from found group by all
            union all
            select trace_id, 'field_truncated', case when bool_or(of_call) then 'medium' else 'low' end, 'security', count(*) from cut group by trace_id""",
        "tool_calls_duplicate": """
            with pairs as (
                select a.trace_id, a.span_id, a.span_index, b.span_id as same_as, b.span_index as before_it, row_number() over (partition by a.trace_id, a.span_id order by b.span_index desc) as nth
                from call_inputs a join call_inputs b on a.trace_id = b.trace_id and a.name = b.name and a.written = b.written and a.n = b.n and b.span_index < a.span_index
            )
            select trace_id, span_id, same_as from pairs where nth = 1 and span_index - before_it <= 5""",
        "duplicate_calls": """
            select trace_id, span_id, first_span from (
                select trace_id, span_id, row_number() over w as nth, first_value(span_id) over w as first_span
                from call_inputs window w as (partition by trace_id, name, path, n order by span_index)) d where nth > 1""",
        "content_hash_groups": r"""
            select digest, count(*) as n, min(id) as first from (
                select span_id as id, sha256('{"n":' || n || ',"path":"' || written || '"}') as digest from call_inputs
                union all select span_id, sha256(output) from spans) c group by digest""",
        "numbers_match": r"""
            with found as (
                select span_id, list_transform(regexp_extract_all(output, '\d[\d,]*\.?\d*'), lambda x: cast(replace(x, ',', '') as double)) as claims,
                    list_concat(list_transform(regexp_extract_all(input, '\d[\d,]*\.?\d*'), lambda x: cast(replace(x, ',', '') as double)), [12000.0, 0.03]) as sources
                from spans where type = 'tool_call'
            )
            select span_id, len(list_filter(claims, lambda a: len(list_filter(sources, lambda b: abs(a - b) <= 0.01 * greatest(abs(b), 1e-12))) > 0)) > 0 as grounded
            from found""",
    }.items()
}
