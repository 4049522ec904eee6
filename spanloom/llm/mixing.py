"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A mix of T words is cut into N = 2^m slots of B = T / N words. Slot k stands at the van der Corput point of k (its bits
reversed), and the source whose stretch of the cumulative targets holds that point fills the slot. As the N points are exactly
the N grid points, every source gets its share of slots to within one, and so does every long run of slots. Each source's
documents, shuffled by a hash, form a stream that is read at most twice; its r-th slot takes the r-th block of B words of it.
Documents and blocks meet in an equi-join on (source, block).

Running sums are taken in two levels (hash buckets within a source, then documents within a bucket), so no task holds a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import BROADCAST_ROWS, checkpointed, fresh, table

WEIGHTS = (5, 2, 1)
#: Most slots of a schedule, as a power of two; slots per chunk of a two-level rank; hex digits of a source's hash buckets.
SLOT_BITS, CHUNK_BITS, BUCKET_DIGITS = 18, 10, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes(source, size) -> source, idx, source_size, target; one row a source, null last.

    Weights 5, 2, 1 repeat over the sources by code point. The sources share `share` of all sizes by weight; a target stops at
    `most` times its source's size and the excess is shared again by weight. The sources that stop are a prefix by
    size / weight, so running sums over the (few) sources replace the repeated sharing.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("idx") - 1) % len(WEIGHTS))
    everything = Window.partitionBy()
    by_room = Window.orderBy(F.col("cap") / F.col("w"), "idx")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    return (
        totals.withColumn("idx", F.row_number().over(by_name))
        .withColumn("w", weight)
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("full", F.col("left") * F.col("w") >= F.col("cap") * F.col("weights"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.struct(-F.col("cap") / F.col("w"), -F.col("idx"), F.col("left"), F.col("weights")))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level.left") / F.col("level.weights")))
        .select("source", "idx", "source_size", "target")
    )


def schedule(targets: DataFrame, total: float, bits: int) -> DataFrame:
    """slot, idx, rank, start, stop: the source (idx) of every slot and the words [start, stop) of its stream that it takes.

    A source's last slot ends where its target does, so that the words taken are the target, rounded.
    """
    width = total / (1 << bits)
    goal = F.floor(F.col("target") + 0.5)
    first = F.ceil((F.col("upto") - F.col("target")) / width - 0.5)
    last = F.greatest(F.least(F.ceil(F.col("upto") / width - 0.5) - 1, F.lit((1 << bits) - 1)), first)
    points = (
        targets.withColumn("upto", F.sum("target").over(Window.orderBy("idx")))
        .filter("target > 0")
        .select("idx", goal.alias("goal"), (last - first + 1).alias("n"), F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("point"))
        .repartition("idx", "point")
    )
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")
    slots = points.select("idx", "goal", "n", reversed_bits.alias("slot")).withColumn("chunk", F.shiftright("slot", CHUNK_BITS))
    chunks = slots.groupBy("idx", "chunk").count()
    chunks = chunks.select("idx", "chunk", (F.sum("count").over(Window.partitionBy("idx").orderBy("chunk")) - F.col("count")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("slot")) - 1
    # Spark takes the slots, exploded from a row a source, for few, and would send all of them through the driver
    return (
        slots.hint("merge").join(chunks, ["idx", "chunk"])
        .withColumn("rank", rank)
        .select("slot", "idx", "rank", F.least(F.floor(F.col("rank") * width), "goal").alias("start"), F.when(F.col("rank") + 1 == F.col("n"), F.col("goal")).otherwise(F.least(F.floor((F.col("rank") + 1) * width), "goal")).alias("stop"))
    )


def _placed(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's place in its source's shuffled stream: words [at, at + size)."""
    keyed = docs.join(targets, docs["source"].eqNullSafe(targets["source"])).select("doc_id", "size", "idx", "source_size", "target", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = keyed.groupBy("idx", "bucket").agg(F.sum("size").alias("words"))
    buckets = buckets.select("idx", "bucket", (F.sum("words").over(Window.partitionBy("idx").orderBy("bucket")) - F.col("words")).alias("before"))
    within = Window.partitionBy("idx", "bucket").orderBy("key", "doc_id", "size")
    placed = keyed.withColumn("row", F.row_number().over(within)).withColumn("at", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return placed.join(buckets, ["idx", "bucket"]).withColumn("at", F.col("at") + F.col("before")).drop("before", "key")


def mix(docs: DataFrame, share: float = 1.5) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, size, source_size, target, taken, slot, slot_again; a row for each row, repeated ones too.

    slot is the first slot of the schedule that takes words of the document, slot_again the first one of the second reading of
    its source; null if there is none. Null text has size 0 and is never taken; a null source is a source of its own; with no words at all every target is 0.
    No document gives more than twice its words. Ties in the shuffle go by doc_id, then size.
    """
    sized = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = checkpointed(source_targets(sized, share))
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    placed = _placed(sized, targets)
    if total < 1:
        none = F.lit(None).cast("long")
        return placed.select("doc_id", "size", "source_size", F.lit(0.0).alias("target") if not total else "target", F.lit(0).cast("long").alias("taken"), none.alias("slot"), none.alias("slot_again"))
    bits = min(SLOT_BITS, int(math.log2(total)))
    width = total / (1 << bits)
    placed = checkpointed(placed)
    slots = schedule(targets, total, bits)
    goal = F.floor(F.col("target") + 0.5)
    spans = placed.filter("size > 0").select("idx", "bucket", "row", "size", goal.alias("goal"), F.posexplode(F.array(F.col("at"), F.col("at") + F.col("source_size"))).alias("reading", "lo")).filter("lo < goal").withColumn("hi", F.least(F.col("lo") + F.col("size"), "goal"))
    # a block of rank r starts at floor(r * width); one more on either side covers rounding, and words past the last block are its own
    rank = F.sequence(F.greatest(F.floor(F.col("lo") / width) - 1, F.lit(0)), F.floor(F.col("hi") / width) + 1)
    spans = spans.select("idx", "bucket", "row", "reading", "lo", "hi", F.explode(rank).alias("rank"))
    overlap = F.greatest(F.least("hi", "stop") - F.greatest("lo", "start"), F.lit(0))
    of = lambda reading: F.min(F.when((overlap > 0) & (F.col("reading") == reading), F.col("slot")))
    taken = spans.join(slots.hint("merge"), ["idx", "rank"]).groupBy("idx", "bucket", "row").agg(F.sum(overlap).cast("long").alias("taken"), of(0).alias("slot"), of(1).alias("slot_again"))
    return placed.join(taken, ["idx", "bucket", "row"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot", "slot_again")


def mixed_documents(docs: DataFrame, share: float = 1.5) -> DataFrame:
    """The rows of docs that the mix keeps, each once or twice, in the order of the schedule's slots.

    A document counts as often as its words were taken, rounded. Partitions are stretches of slots in order, so of about equal
    words, each sorted by slot. Documents without words can't be taken and stay once, anywhere. doc_id must be unique among the
    documents.
    """
    slots = F.when(F.col("size") == 0, F.array(F.lit(None).cast("long"))).otherwise(F.slice(F.array(F.coalesce("slot", "slot_again"), F.coalesce("slot_again", "slot")), F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int")))
    at = fresh("slot", docs.columns)
    copies = checkpointed(mix(docs, share).select("doc_id", slots.alias(at)).filter(F.size(at) > 0))
    most, rows = copies.agg(F.max(F.array_max(at)), F.count("*")).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    again = docs.join(F.broadcast(copies) if rows <= BROADCAST_ROWS else copies, docs["doc_id"].eqNullSafe(copies["doc_id"])).select(*[docs[c] for c in docs.columns], F.explode(at).alias(at))
    part = F.coalesce(F.floor(F.col(at) * parts / ((most or 0) + 1)), F.pmod(F.xxhash64("doc_id"), F.lit(parts))).cast("int")
    return again.repartitionById(parts, part).sortWithinPartitions(at, "doc_id").drop(at)


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("slot", "slot_again")


#: The blocks of a source tile its stream up to the rounded target, so the words taken are an overlap of intervals.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS idx FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (idx - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM totals
), summed AS (
  SELECT *, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0) AS left_over,
         sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weights, cap / w AS room
  FROM weighed WINDOW b AS (ORDER BY cap / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, left_over * w >= cap * weights AS is_full FROM summed
), first_open AS (
  SELECT left_over AS l, weights AS ws FROM judged WHERE NOT is_full ORDER BY room, idx LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) * (SELECT l FROM first_open) / (SELECT ws FROM first_open) END AS target FROM judged
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS lo
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(least(lo + size, goal) - lo, 0) + greatest(least(lo + source_size + size, goal) - (lo + source_size), 0) AS BIGINT) AS taken
FROM placed
"""
