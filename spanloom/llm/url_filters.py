"""URL filters: a Bloom filter cascade gives exact membership of listed keys over the corpus's key universe, without joins.

Keys are label-aligned host suffixes joined to path prefixes, in the shapes (labels, path length) that the rules have. The
universe is the distinct keys of all URLs. Level 1 holds the listed keys; level 2 holds the universe's keys that level 1
wrongly admits; level 3 the listed keys that level 2 wrongly admits, and so on until a level admits nothing wrongly. The
first level that lacks a key decides: an odd level says "not listed", an even one "listed". The false-positive rate of level 1
is |listed| / |universe|, so that every level is as small as the listing, whatever the corpus: what is sent to the tasks grows
with the rules alone. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import checkpointed, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MASK = (1 << 40) - 1

#: The rules of query op3: (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for null and for a URL without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


class Level:
    """One Bloom filter: `bits` positions, `hashes` probes, as 64-bit words."""

    def __init__(self, number: int, bits: int, hashes: int, words: dict[int, int] | None = None):
        self.number, self.bits, self.hashes, self.words = number, bits, hashes, words or {}

    def positions(self, key: Column) -> Column:
        one = F.xxhash64(key, F.lit(self.number)).bitwiseAND(F.lit(_MASK))
        two = F.xxhash64(key, F.lit(-self.number)).bitwiseAND(F.lit(_MASK))
        return F.array(*[F.pmod(one + two * F.lit(i), F.lit(self.bits)) for i in range(self.hashes)])

    def fill(self, keys: DataFrame) -> Level:
        """Only the words of the filter come to the driver: bits / 64 numbers, a size set by the listing."""
        at = keys.select(F.explode(self.positions(F.col("key"))).alias("at")).distinct()
        found = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        self.words = {r["word"]: r["bits"] for r in found.collect()}
        return self

    def admits(self, key: Column) -> Column:
        # one literal, which the optimizer turns into an array once, however long the listing
        words = F.split(F.lit(",".join(str(self.words.get(i, 0)) for i in range(-(-self.bits // 64)))), ",").cast("array<bigint>")
        at = self.positions(key)
        return F.forall(at, lambda p: F.getbit(F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1)


def cascade(universe: DataFrame, listed: DataFrame, n_universe: int) -> list[Level]:
    """Filters that tell every key of `universe` (column key) exactly: listed or not. `listed`: the listed keys."""
    levels: list[Level] = []
    members, others = listed, checkpointed(universe.join(listed, "key", "left_anti"))
    n = listed.count()
    rate = min(0.5, n / max(n_universe, 1))
    while n:
        hashes = max(1, round(-math.log2(rate)))
        level = Level(len(levels) + 1, max(64, math.ceil(n * hashes / math.log(2))), hashes).fill(members)
        levels.append(level)
        members, others = checkpointed(others.filter(level.admits(F.col("key")))), members
        n, rate = members.count(), 0.5
    return levels


def is_listed(levels: Sequence[Level], key: Column) -> Column:
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.admits(key), F.lit(level.number % 2 == 0)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, the longest fitting rule (null if none) and its action as verdict (`allow` if none: not listed).

    A null or unparsable URL has empty host and path and fits no rule. If a rule is listed with both actions, block wins.
    Repeated rows stay; other columns of `pages` are not read. No rules or no rows give no rule or no rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    if not shapes:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keys = [F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m)) for n, m in shapes]
    universe = checkpointed(judged.select(F.explode(F.array_distinct(F.array(*keys))).alias("key")).distinct())
    n_universe = universe.count()
    actions = {}
    for action in ("allow", "block"):
        named = sorted({h + p for a, h, p in rules if a == action})
        listed = spark.createDataFrame([(k,) for k in named], "key string")
        actions[action] = cascade(universe, listed, n_universe)
    fits = [F.when(is_listed(levels, k), F.struct(F.length(k).alias("n"), F.lit(action).alias("action"), k.alias("rule"))) for k in keys for action, levels in actions.items()]
    best = fits[0] if len(fits) == 1 else F.greatest(*fits)
    out = judged.withColumn("best", best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


_RULES_SQL = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
ORACLE = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), rules(action, h, p) AS (VALUES {_RULES_SQL})
SELECT page_id, host, path,
       (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
       coalesce((SELECT max_by(action, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parsed
"""
