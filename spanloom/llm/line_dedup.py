"""Line dedup: lines by the range of their hashes, first occurrences streamed, a compressed keep bitmap for each document.

1. Each line with a key (white space stripped at both ends, A-Z lower-cased) is a row (128-bit hash, document, position); no text.
2. The rows are range-partitioned and sorted by all four columns, so a line of any frequency spreads over as many partitions as
   its rows fill, and no partition holds a line in pieces but its first and last.
3. A task streams its rows run by run and holds the rows of fewer than `least_docs` documents. Runs that may go on in a neighbour
   are settled by one small aggregation: under `least_docs` documents' rows of each, and one row of each that has enough.
4. What is dropped comes together as one bitmap a document (bit 1: the line stays; lines beyond its end stay), packed and deflated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import checkpointed, modest_batches, only, pieces, table

_LAST = 2**63 - 1
#: Rows of lines that a task hands on at a time.
FLUSH = 1 << 16
ROW = ["one", "two", "id", "at"]
#: What becomes of a streamed row: its run may go on elsewhere; it goes; it goes, and speaks for its run elsewhere.
OPEN, GONE, HEAD = 0, 1, 2


def _lines(least_points: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []
        ids: list[int] = []
        at: list[int] = []

        def flush() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(at, pa.int64())], ROW)
            digests.clear(), ids.clear(), at.clear()
            return out

        for batch in pieces(batches):
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                twin = zlib.crc32(raw) << 31
                for n, line in enumerate(raw.lower().split(b"\n")):  # bytes: only A-Z are lowered, only \x20\x09-\x0D stripped
                    if (key := line.strip()) and (least_points < 2 or len(key.decode()) >= least_points):
                        digests.append(xxhash.xxh3_128_digest(key))
                        ids.append(i)
                        at.append(twin | n)
                        if len(at) == FLUSH:
                            yield flush()
            if at:
                yield flush()

    return work


def _stream(least_docs: int, keep_first: bool):
    """Works on rows sorted by ROW; see OPEN, GONE and HEAD."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)  # the last run's rows, as long as it has too few documents
        enough: tuple[int, int] | None = None  # the last run's key, once it has enough
        begun = False  # a run has ended: the next is whole at its start

        def out(rows: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(4)), pa.array(state)], [*ROW, "state"])

        for batch in batches:
            rows = np.column_stack([np.asarray(batch.column(c)) for c in ROW])
            if enough is not None:
                other = np.flatnonzero((rows[:, 0] != enough[0]) | (rows[:, 1] != enough[1]))
                cut = int(other[0]) if len(other) else len(rows)
                yield out(rows[:cut], np.full(cut, GONE, np.int8))
                rows = rows[cut:]
                if not len(rows):
                    continue
                enough, begun = None, True
            rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
            document = new | np.r_[True, (rows[1:, 2] != rows[:-1, 2]) | (rows[1:, 3] >> 31 != rows[:-1, 3] >> 31)]
            first, run = np.flatnonzero(new), np.cumsum(new) - 1
            fine = np.bincount(run, document) >= least_docs
            edge = np.zeros(len(first), bool)
            edge[0], edge[-1] = not begun, True
            state = np.where(fine[run], GONE, OPEN).astype(np.int8)
            state[first[fine & edge]] = HEAD
            leaves = fine[run] | edge[run]
            if keep_first:
                leaves[first[fine & ~edge]] = False
            begun = begun or len(first) > 1
            if fine[-1]:
                enough, held = (int(rows[-1, 0]), int(rows[-1, 1])), rows[:0]
            else:
                held = rows[first[-1] :]
                leaves[first[-1] :] = False
            yield out(rows[leaves], state[leaves])
        yield out(held, np.full(len(held), OPEN, np.int8))

    return work


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for lines in batch.column("lines").to_pylist():
            keep = np.ones((max(lines) // 8 + 1) * 8, bool)
            keep[lines] = False
            out.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("twin"), pa.array(out, pa.binary())], ["id", "twin", "keep"])


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def keep_bitmaps(docs: DataFrame, least_docs: int = 2, keep_first: bool = True, least_points: int = 1) -> DataFrame:
    """docs(doc_id, text) -> id, twin, keep: a bitmap for each document that loses a line, under its id and its text's CRC.

    Lines with equal keys (stripped, A-Z lower-cased, at least `least_points` code points, never empty) that stand in
    `least_docs` documents or more go in all of them; with keep_first the first one, in order of doc_id and position, stays, and
    least_docs = 1 then means every repeat. A null doc_id comes last (id 2^63 - 1). Rows with the same doc_id and text are one
    document; rows with the same doc_id and other texts, or with none, are several. Columns but doc_id and text are not read.
    Lowers the session's Arrow batches to at most 2,048 rows.
    """
    modest_batches(docs.sparkSession)
    rows = _identified(docs).select("id", "text").mapInArrow(_lines(max(1, least_points)), "one long, two long, id long, at long")
    ordered = rows.repartitionByRange(*ROW).sortWithinPartitions(*ROW)
    found = checkpointed(ordered.mapInArrow(_stream(least_docs, keep_first), "one long, two long, id long, at long, state byte"))
    rest = found.filter(F.col("state") != GONE)
    document = F.struct("id", F.shiftright("at", 31))
    known = rest.groupBy("one", "two").agg(F.min(F.struct("id", "at")).alias("first"), F.countDistinct(document).alias("n"), F.max("state").alias("state"))
    known = known.filter((F.col("n") >= least_docs) | (F.col("state") == HEAD)).select("one", "two", "first")
    settled = rest.join(known, ["one", "two"])
    if keep_first:
        settled = settled.filter(F.struct("id", "at") > F.col("first"))
    gone = found.filter(F.col("state") == GONE).select("id", "at").unionByName(settled.select("id", "at"))
    gone = gone.select("id", F.shiftright("at", 31).alias("twin"), F.col("at").bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("line"))
    return gone.groupBy("id", "twin").agg(F.collect_set("line").alias("lines")).mapInArrow(_bitmaps, "id long, twin long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts, counts, dropped = [], [], []
        for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist()):
            lines = text.split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].astype(bool)
            stay = np.r_[bits, np.ones(len(lines) - len(bits), bool)]
            texts.append("\n".join([line for line, s in zip(lines, stay.tolist()) if s]))
            counts.append(len(lines))
            dropped.append(int(len(lines) - stay.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text (the lines that stay), n_lines (before), n_dropped; a row for each row.

    A null or empty text is one empty line; one whose lines all go is empty. Only texts with a bitmap are shuffled.
    """
    docs, bitmaps = _identified(docs), checkpointed(bitmaps)
    twin = F.crc32(F.col("text").cast("binary")).alias("twin")
    ids = checkpointed(bitmaps.select("id").distinct())
    hit = only(docs, ids, "id").withColumn("twin", twin).join(bitmaps, ["id", "twin"], "left")
    whole = lambda df: df.select("doc_id", "text", (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    changed = hit.filter("keep is not null").select("doc_id", "text", "keep").mapInArrow(_apply, "doc_id long, text string, n_lines long, n_dropped long")
    return changed.unionByName(whole(hit.filter("keep is null"))).unionByName(whole(only(docs, ids, "id", "left_anti")))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = apply_bitmaps(docs, keep_bitmaps(docs, least_docs=10, keep_first=False))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
with lines as (
    select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents
), keyed as (
    select doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key
    from lines
), frequent as (
    select line_key from keyed where line_key <> '' group by line_key having count(distinct doc_id) >= 10
)
select k.doc_id, count(*) as n_lines, count(f.line_key) as n_dropped,
    sha256(coalesce(string_agg(k.line, chr(10) order by k.pos) filter (where f.line_key is null), '')) as kept_sha256
from keyed k left join frequent f on k.line_key = f.line_key
group by k.doc_id
"""
