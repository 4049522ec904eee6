"""The scan of structured payloads: attempts on a judge, score keys, secret names, and what the scan had to leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import jsontext

#: The span is the first level and its payload the second (fixed values: levels and characters that are scanned).
MOST_LEVELS, MOST_CHARS = 10, 50_000
# fixed values: patterns of attempts with severity and axis
ATTEMPTS = {
    "html_comment_injection": (r"(?is)<!--.*?(?:EVALUATION|SCORE|JUDGE|RATING|OVERRIDE|ASSESSMENT|INSTRUCTION).*?-->", "info", "observation"),
    "system_prompt_mimicry": (r"(?i)You are a (?:judge|evaluator|scorer)|Score this as|SYSTEM:|INSTRUCTION:", "info", "observation"),
    "zero_width_unicode": ("[​‌‍﻿⁠]{6,}", "high", "data_integrity"),
}
# fixed values: keys that state a score; names of secrets
SCORE_KEYS = ("overall_score", "final_score", "assessment_score", "composite_score", "efficiency_rating")
SECRETS = ("SECRET_KEY", "API_KEY", "OPENAI_API_KEY")


def payload_strings(spans: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """spans(key, columns of JSON text) -> key, column, text, is_key, level: each string of each payload, keys marked.

    The payload is at level 1; what stands in it, one level deeper. A text that is no object or array is one string of level 1. A
    string's level is the running sum of brackets before it, within its payload.
    """
    long = spans.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("payload")) for c in columns))).alias("p")).select(key, "p.*").filter("payload is not null")
    long = long.withColumn("canonical", jsontext.structured(F.col("payload")))
    plain = long.filter("canonical is null").select(key, "column", F.col("payload").alias("text"), F.lit(False).alias("is_key"), F.lit(1).alias("level"))
    found = long.filter("canonical is not null").select(key, "column", F.explode(jsontext.tokens(F.col("canonical"))).alias("t"))
    level = F.sum("t.opened").over(Window.partitionBy(key, "column").orderBy("t.pos").rowsBetween(Window.unboundedPreceding, 0))
    return plain.unionByName(found.select(key, "column", "t.text", "t.is_key", (level + 1).cast("int").alias("level")))


def adversarial_scan(spans: DataFrame, group: str, key: str, payloads: list[str], texts: list[str]) -> DataFrame:
    """spans(group, key, type, payload and text columns) -> group, category, severity, axis, n; `key` tells the spans apart.

    `payloads` hold JSON and are walked, `texts` are one string each. n counts the strings that match a pattern, the top keys
    that state a score, and the secret names in each tool call's first payload. Strings are scanned up to 50,000 characters and
    ten levels; what lies beyond makes a finding field_truncated, medium if a tool call was cut, else low, with n the number of
    cut strings and payloads. Null columns have no strings.
    """
    kind = spans.select(group, key, (F.coalesce("type", F.lit("")) == "tool_call").alias("is_call"), *payloads, *texts)
    plain = kind.select(key, F.explode(F.array(*(F.col(t) for t in texts))).alias("text")).filter("text is not null") if texts else None
    walked = payload_strings(kind, key, payloads)
    strings = walked.filter(~F.col("is_key") & (F.col("level") <= MOST_LEVELS)).select(key, "text")
    strings = strings.unionByName(plain) if texts else strings
    short = F.substring("text", 1, MOST_CHARS)
    hits = strings.select(key, F.explode(F.array(*(F.when(short.rlike(p), F.lit(name)) for name, (p, _, _) in ATTEMPTS.items()), F.when(F.length("text") > MOST_CHARS, F.lit("cut")))).alias("category")).filter("category is not null")
    scores = walked.filter(F.col("is_key") & (F.col("level") == 2) & F.lower("text").isin(*SCORE_KEYS)).select(key, F.lit("score_assertion").alias("category"))
    secret = F.filter(F.array(*map(F.lit, SECRETS)), lambda s: F.contains(F.col(payloads[0]), s))
    secrets = kind.filter("is_call").select(key, F.explode(secret)).select(key, F.lit("secret_access").alias("category"))
    deep = F.filter(F.array(*(jsontext.depth(jsontext.structured(F.col(p))) for p in payloads)), lambda d: d >= MOST_LEVELS)
    deeper = kind.select(key, F.explode(deep)).select(key, F.lit("deep").alias("category"))
    counts = hits.unionByName(scores).unionByName(secrets).unionByName(deeper).groupBy(key, "category").agg(F.count("*").alias("n"))
    told = counts.join(kind.select(group, key, "is_call"), key)
    left_out = F.col("category").isin("cut", "deep")
    found = told.select(group, F.when(left_out, "field_truncated").otherwise(F.col("category")).alias("category"), "n", ((F.col("category") == "cut") & F.col("is_call")).alias("of_call"))
    summed = found.groupBy(group, "category").agg(F.sum("n").alias("n"), F.max("of_call").alias("of_call"))
    tables = {name: (severity, axis) for name, (_, severity, axis) in ATTEMPTS.items()} | {"score_assertion": ("info", "observation"), "secret_access": ("high", "security")}
    at = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for name, v in tables.items() for x in (name, v[i])]), F.col("category"))
    severity = F.coalesce(at(0), F.when(F.col("of_call"), "medium").otherwise("low"))
    return summed.select(group, "category", severity.alias("severity"), F.coalesce(at(1), F.lit("security")).alias("axis"), "n")
