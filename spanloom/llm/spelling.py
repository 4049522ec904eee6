"""Spelling variants: pivotal grams find all pairs of words one edit apart, frequencies say which one is the form.

Bigrams have one global order, rarest first. A word's prefix is its three rarest bigrams (2 * 1 edit + 1) and every further place of
the last of them. Its two pivots are disjoint bigrams of the prefix, the pair of least total frequency, chosen by dynamic
programming. One edit spares a pivot. Of two words near each other, take the one whose prefix ends first in the order: a pivot of it
that the edit spared is in the other word's prefix. The edit then lies left or right of that bigram, and on the other side the
words agree; so a pivot meets only prefix bigrams that have the same letters, and as many, to their left or to their right (the
position limit, made exact). Those pairs are verified by their edit distance.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import checkpointed, modest_batches, pieces, table

LETTERS = "A-Za-zÀ-ÿ"
#: Occurrences are changed where this divides their hash.
DAMAGE = 199
#: Distinct words that a task counts before it hands them on.
FLUSH = 200_000
_MASK = 2**64 - 1


def _words(least_points: int, damage: int):
    run = re.compile(f"[{LETTERS.replace('A-Z', '')}]{{{max(1, least_points)},}}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in pieces(batches):
            for i, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                own = Counter(run.findall(raw.lower().decode()))  # bytes: only A-Z are lowered
                if damage:
                    start = zlib.crc32(f"{i}:".encode())
                    for word, n in own.items():
                        h = zlib.crc32(word.encode(), start)
                        if not h % damage:
                            h %= len(word)
                            word = word[:h] + word[h + 1 :]
                            if len(word) < least_points:
                                continue
                        total[word] += n
                else:
                    total.update(own)
                if len(total) >= FLUSH:
                    yield flush()
        if total:
            yield flush()

    return work


def vocabulary(docs: DataFrame, least_points: int = 6, least_count: int = 5, damage: int = 0) -> DataFrame:
    """docs(doc_id, text) -> word, n: the maximal runs of LETTERS, A-Z lower-cased, long and frequent enough.

    With `damage`, a run whose CRC-32 under `<doc_id>:<run>` it divides loses the code point at that CRC modulo its length. A null
    text has no words, a null doc_id is written as nothing. Lowers the session's Arrow batches to at most 2,048 rows.
    """
    modest_batches(docs.sparkSession)
    rows = docs.filter("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counts = rows.mapInArrow(_words(least_points, damage), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def pivots(grams: list[tuple[int, int]]) -> list[int]:
    """Positions of the two disjoint bigrams of least total weight among (position, weight), in order of position; ties: leftmost."""
    one: list[tuple[int, int]] = []  # the best single bigram up to each place
    two: tuple[int, int, int] | None = None
    free = 0  # bigrams before this one end before the current one
    for at, weight in grams:
        while grams[free][0] < at - 1:
            free += 1
        if free and (two is None or one[free - 1][0] + weight < two[0]):
            two = one[free - 1][0] + weight, one[free - 1][1], at
        one.append(min(one[-1], (weight, at)) if one else (weight, at))
    return [two[1], two[2]] if two else [one[-1][1]]


def signature(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[int], list[int]]:
    """The last prefix bigram's rank, and keys of pivots and of prefix bigrams: each bigram with all to its left, and to its right."""
    left, right, h = [], [0] * len(word), 0
    for c in word:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & _MASK
        left.append(h)
    h = 1
    for i in range(len(word) - 1, -1, -1):
        h = (h * 0xD1342543DE82EF95 + ord(word[i]) + 1) & _MASK
        right[i] = h
    ranks = [order[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(r for r, _ in ranks)[min(2, len(ranks) - 1)]
    prefix = [i for i, (r, _) in enumerate(ranks) if r <= last]
    keys = lambda places: [k - 2**63 for i in places for k in (left[i + 1], right[i])]
    return last, keys(pivots([(i, ranks[i][1]) for i in prefix])), keys(prefix)


def _signatures(order: Broadcast):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, pivot, prefix = zip(*(signature(w, order.value) for w in batch.column("word").to_pylist())) if batch.num_rows else ((), (), ())
            keys = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(last, pa.int32()), pa.array(pivot, keys), pa.array(prefix, keys)], ["word", "n", "last", "pivots", "prefix"])

    return work


def near_pairs(words: DataFrame) -> DataFrame:
    """words(word, n), distinct -> word, other, n, other_n: both ways, one inserted, deleted or replaced code point apart.

    The order of bigrams is sent to every task: there are at most as many as pairs of letters (8,100 for `vocabulary`). Words of
    less than four code points have no two disjoint bigrams to spare; up to four they meet under what is left without one letter.
    """
    size = lambda c: F.char_length(c)
    beside = (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)
    short = words.filter(size("word") <= 4)
    less = F.transform(F.sequence(F.lit(1), F.greatest(size("word"), F.lit(1))), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.lit(4))))
    meet = short.select("word", "n", F.explode(F.array_distinct(F.array_append(less, F.col("word")))).alias("key"))
    met = meet.join(meet.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "key"), "key").filter(beside).select("word", "n", "other", "other_n")
    words = words.filter(size("word") >= 4)
    bigrams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))))
    frequency = words.select(bigrams.alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()
    order = {g: (rank, n) for rank, (n, g) in enumerate(sorted((r["n"], r["gram"]) for r in frequency))}
    signed = words.mapInArrow(_signatures(words.sparkSession.sparkContext.broadcast(order)), "word string, n long, last int, pivots array<long>, prefix array<long>")
    signed = checkpointed(signed)
    p = signed.select("word", "n", "last", F.explode("pivots").alias("key"))
    q = signed.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("last").alias("other_last"), F.explode("prefix").alias("key"))
    fits: Column = (F.col("last") <= F.col("other_last")) & (F.abs(size("word") - size("other")) <= 1)
    found = p.join(q, (p["key"] == q["key"]) & fits & beside).select("word", "n", "other", "other_n").unionByName(met)
    ways = F.explode(F.array(F.struct("word", "other", "n", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("other_n").alias("n"), F.col("n").alias("other_n"))))
    return found.select(ways.alias("w")).select("w.*").distinct()


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """words(word, n) -> word, form, root, n, n_near, form_n; one row per word.

    A word's form is its most frequent near word (ties: the first in code-point order), if that is at least `ratio` (more than 1)
    times as frequent, else null; its root is where forms lead, or itself. Frequencies grow by the ratio at each step, so the
    number of doublings that reach every root follows from the greatest. No words: no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could lead in a circle")
    words = checkpointed(words.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = words.join(near, "word", "left")
    fine = -F.col("best.less") >= ratio * F.col("n")
    out = checkpointed(near.select("word", F.when(fine, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fine, -F.col("best.less")).alias("form_n")))
    greatest = out.agg(F.max("form_n")).first()[0]
    steps = out.filter("form is not null").select("word", F.col("form").alias("root"))
    if greatest:
        for _ in range(math.ceil(math.log2(math.log(greatest, ratio) + 1)) + 1):
            on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
            steps = checkpointed(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return out.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"), damage=DAMAGE))


#: CRC-32 from its table, which follows from the polynomial 0xEDB88320; bytes come from the hexadecimal digits. DuckDB's levenshtein
#: counts bytes, so the 64 letters À-ÿ become the 64 characters before `a` first.
ORACLE = """
with recursive crc_table as (
    select list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as crc_of
    from (select unnest(range(256))::bigint as b)
), runs as (
    select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
    from documents where text is not null
), counted as (
    select run, hex(encode(concat(doc_id, ':', run))) as digits, count(*) as n
    from runs where length(run) >= 6 group by doc_id, run
), hashed as (
    select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(digits) // 2),
            lambda i: instr('0123456789ABCDEF', digits[2 * i + 1]) * 16 + instr('0123456789ABCDEF', digits[2 * i + 2]) - 17)),
        lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1])), 4294967295) as h
    from counted, crc_table
), results as (
    select case when h % 199 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from hashed
), words as materialized (
    select word, sum(n)::bigint as n, translate(word, array_to_string(list_transform(range(64), lambda i: chr((192 + i)::int)), ''),
        array_to_string(list_transform(range(64), lambda i: chr((33 + i)::int)), '')) as plain
    from results where length(word) >= 6 group by word having sum(n) >= 5
), near as (
    select a.word, a.n, b.word as other, b.n as other_n from words a join words b
        on length(b.word) between length(a.word) - 1 and length(a.word) + 1 and a.word <> b.word
    where levenshtein(a.plain, b.plain) = 1
), best as (
    select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word
), forms as materialized (
    select w.word, case when other_n >= 5 * w.n then other end as form, w.n, coalesce(n_near, 0) as n_near,
        case when other_n >= 5 * w.n then other_n end as form_n
    from words w left join best b on w.word = b.word
), ways as (
    select word, word as root, form as further from forms
    union all
    select w.word, f.word, f.form from ways w join forms f on f.word = w.further
)
select f.word, f.form, w.root, f.n, f.n_near, f.form_n from forms f join ways w on f.word = w.word where w.further is null
"""
