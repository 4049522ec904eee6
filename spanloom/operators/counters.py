"""Rates, quantiles and top-k over cumulative counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def increases(samples: DataFrame, series: list[str], at: str = "at", value: str = "value") -> DataFrame:
    """samples with `delta`: the rise since the sample before; a fall means a reset, whose value is the rise."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(at))
    return samples.withColumn("delta", F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def counter_rate(samples: DataFrame, series: list[str], seconds: int, by: list[str] | None = None) -> DataFrame:
    """Rise a second over fixed windows, summed over the series of each group."""
    risen = increases(samples, series).groupBy(*(by or []), F.window("at", f"{seconds} seconds").start.alias("bucket")).agg(F.sum("delta").alias("rise"))
    return risen.withColumn("rate", F.col("rise") / seconds)


def counter_topk(samples: DataFrame, series: list[str], by: str, k: int = 8) -> DataFrame:
    return increases(samples, series).groupBy(by).agg(F.sum("delta").alias("rise")).orderBy(F.desc("rise"), by).limit(k)


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """buckets(by, le, n: cumulative) -> the q-quantile, linear within its bucket; in the open last bucket, its lower bound."""
    own = Window.partitionBy(*by).orderBy("le")
    at = buckets.withColumn("lower", F.coalesce(F.lag("le").over(own), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(own), F.lit(0)))
    at = at.withColumn("rank", F.lit(q) * F.max("n").over(Window.partitionBy(*by))).filter("n >= rank and below < rank")
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * F.try_divide(F.col("rank") - F.col("below"), F.col("n") - F.col("below"))
    return at.select(*by, F.when(F.col("le") == float("inf"), F.col("lower")).otherwise(inside).alias("quantile"))
