"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: each step shifts the hash left and adds the byte's gear, so that it depends on the
last 16 bytes alone. A chunk ends where the hash exceeds its `REACH` neighbours before it and none after it is greater, or after
`MOST_BYTES` bytes. Such cuts move with the text when something is inserted before them, so a passage has the same chunks
wherever it stands, except at its edges. Chunks are known by a 128-bit digest; of equal chunks the first by (doc_id, position)
stays. Others go where they stand in an unbroken run of at least `least_bytes` bytes, so short phrases that recur by chance stay.

Digests are counted with a combine step in the tasks. A Bloom filter of fixed size, of the digests that recur, keeps the other
chunks out of the second shuffle; a digest that a large part of the chunks share is split by the skew handling of that join.
Only chunk numbers go back to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bloom_admits, bloom_filter, checkpointed, fresh, lean, mix64, modest_batches, pieces, table, utf8

#: Bytes on either side of a cut that it must outdo (chunks have REACH + 1 bytes at least, and about twice as many on average);
#: bytes of the longest chunk, bytes that a run of repeated chunks must have to go by default; bytes that the gear hash spans.
REACH, MOST_BYTES, LEAST_BYTES, SPAN = 24, 2048, 75, 16
_GEAR = (mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
_LAST = 2**63 - 1


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """hash[i] = sum of gear[data[i - j]] << j for j < SPAN (fewer at the start), by doubling the span."""
    out, span = _GEAR[data], 1
    while span < SPAN:
        longer = out.copy()
        longer[span:] += out[:-span] << np.uint32(span)
        out, span = longer, span * 2
    return out


def _greatest(x: np.ndarray) -> np.ndarray:
    """The maximum of x[i : i + REACH], for each i that has so many."""
    width, span = REACH, 1
    while span * 2 <= width:
        x = np.maximum(x[:-span], x[span:])
        span *= 2
    return np.maximum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def cuts(data: np.ndarray) -> np.ndarray:
    """Bounds of the chunks of a text that isn't empty; none splits a UTF-8 character."""
    hashes = gear_hashes(data)
    room = np.zeros(REACH, hashes.dtype)
    most = _greatest(np.concatenate([room, hashes, room]))
    at = np.flatnonzero((hashes > most[: len(data)]) & (hashes >= most[REACH + 1 : REACH + 1 + len(data)])) + 1
    bounds = np.r_[0, at[at < len(data)], len(data)]
    parts = -(-np.diff(bounds) // MOST_BYTES)  # a stretch without a cut, such as a long run of one byte
    if (parts > 1).any():
        bounds = np.r_[np.repeat(bounds[:-1], parts) + MOST_BYTES * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)), len(data)]
    for _ in range(3):  # on to the next character's first byte
        inside = (data[np.minimum(bounds, len(data) - 1)] & 0xC0 == 0x80) & (bounds < len(data))
        bounds = bounds + inside
    return np.unique(bounds)


def _chunks(text: bytes) -> tuple[list[int], np.ndarray]:
    """Bounds of the chunks of one text, and their digests, two numbers each. A text is cut by itself: what stands before or
    after it in a batch has no say."""
    if not text:
        return [0], np.zeros((0, 2), np.int64)
    bounds = cuts(np.frombuffer(text, np.uint8)).tolist()
    digest = xxhash.xxh3_128_digest
    return bounds, np.frombuffer(b"".join([digest(text[a:b]) for a, b in zip(bounds, bounds[1:])]), np.int64).reshape(-1, 2)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    data, offsets = utf8(batch.column("text"))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _emit(admitted: Broadcast | None = None):
    """Rows (one, two, id, number) of the chunks; those alone that the Bloom filter admits, if there is one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            digests = [_chunks(t)[1] for t in _texts(batch)]
            counts = [len(d) for d in digests]
            every = np.concatenate(digests)
            ids = np.repeat(np.asarray(batch.column("doc_id").fill_null(_LAST)), counts)
            number = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
            one, two = every[:, 0].copy(), every[:, 1].copy()
            if admitted is not None:
                kept = bloom_admits(admitted.value, [one, two])
                one, two, ids, number = one[kept], two[kept], ids[kept], number[kept]
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(ids), pa.array(number)], ["one", "two", "id", "number"])

    return work


def _strip(least_bytes: int, names: list[str], again_name: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            kept, stats = [], []
            for text, again in zip(_texts(batch), batch.column(again_name).to_pylist()):
                gone: list[tuple[int, int]] = []
                if again:
                    bounds, digests = _chunks(text)
                    # a number counts only with its digest: rows with one doc_id may differ in text
                    numbers = sorted({r["number"] for r in again if r["number"] < len(digests) and digests[r["number"], 0] == r["one"]})
                    for n in numbers:
                        if gone and gone[-1][1] == bounds[n]:
                            gone[-1] = (gone[-1][0], bounds[n + 1])
                        else:
                            gone.append((bounds[n], bounds[n + 1]))
                    gone = [(a, b) for a, b in gone if b - a >= least_bytes]
                ends = [0, *(x for run in gone for x in run), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
                kept.append(rest.decode("utf-8"))
                stats.append((len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest()))
            columns = {c: batch.column(c) for c in names} | {
                "text": pa.array(kept, pa.string()),
                **{c: pa.array([s[i] for s in stats], t) for i, (c, t) in enumerate((("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())))},
            }
            yield pa.RecordBatch.from_pydict(columns)

    return work


def dedup_substrings(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) with repeated passages gone from text, and n_bytes, n_removed, n_spans, kept_sha256.

    A row for each row. Null text becomes empty. Of equal chunks the one of the smallest doc_id stays (null counts as the
    greatest), within a document the first; rows that share a doc_id are one document to this rule, so a repeated row is
    treated like its twin. With least_bytes = 0 every repeated chunk goes. Columns named like the new ones are replaced.
    """
    modest_batches(docs.sparkSession)
    spark, own = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
    kind = "one long, two long, id long, number int"
    again = own.mapInArrow(lean(_emit()), kind).groupBy("one", "two").agg(F.count("*").alias("n"), F.min(F.struct("id", "number")).alias("first")).filter("n > 1")
    again = checkpointed(again.select("one", "two", "first"))
    admitted = spark.sparkContext.broadcast(bloom_filter(again, ["one", "two"]))
    gone = own.mapInArrow(lean(_emit(admitted)), kind).join(again, ["one", "two"]).filter(F.struct("id", "number") > F.col("first"))
    key, listed = fresh("id", docs.columns), fresh("again", docs.columns)
    lists = gone.groupBy(F.col("id").alias(key)).agg(F.collect_list(F.struct("number", "one")).alias(listed))
    names = [c for c in docs.columns if c not in ("text", "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    keyed = docs.select(*(F.col(f"`{c}`") for c in names), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias(key))
    joined = keyed.join(lists, key, "left").drop(key)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    return joined.mapInArrow(lean(_strip(least_bytes, names, listed)), schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
