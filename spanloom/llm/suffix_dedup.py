"""Exact removal of repeated byte strings: merged Burrows-Wheeler transforms over the places that can hold a repeat.

A byte goes if a string of LENGTH bytes covers it that also starts earlier. Every such string (a window) is owned by an anchor:
of its k-grams the one with the least hash, the leftmost of equals. Equal windows have equal anchors at equal offsets, so
windows need to be compared only within groups of one anchor hash. Consecutive windows with one anchor form a stretch.

1. Each stretch is a row (anchor, digest of its bytes), 128 bits that its bytes and the anchor's place in them decide. Stretches
   with an earlier twin are repeated as a whole and found by these alone; a Bloom filter of fixed size keeps stretches without
   one out of that join. What is left are the first stretches of anchors that have several different ones, at the edges of repeats.
2. The bytes of those stretches are dealt by anchor, and those that share too little around it with any other drop out. A task takes whole groups in blocks, splits a block into shards, sorts each
   shard's suffixes into a Burrows-Wheeler transform, and merges the transforms without sorting all suffixes again: the
   interleave starts as the shards one after the other, and each refinement step orders it stably by the transforms' next
   symbols, so that after h steps it is right for the first h. Runs of several positions that agree in the symbols taken so far are
   carried along; after LENGTH steps such a run is an interval of equal windows, and all but the first start go.
3. Groups too large for a task give a row for each window instead, counted by digest, exactly as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import _BYTE, _INVERSE, _ODD, PIECE_BYTES, _powers, bloom_admits, bloom_filter, checkpointed, mix64, modest_batches, only, pieces, span_hashes, table, utf8

#: Bytes of a repeated string; of an anchor; bytes that are merged at a time and the shards they form; stretches of one anchor
#: beyond which its windows are counted instead; places of a window around its anchor that are compared as one before the merge.
LENGTH, GRAM, BLOCK_BYTES, SHARDS, MOST_STRETCHES, GRID = 100, 32, 1 << 16, 4, 4096, 4
_LAST = 2**63 - 1


#: Powers that a worker keeps, for pieces of the usual size: 16 MB for each of two bases.
_KEPT: dict[int, np.ndarray] = {}


def _kept_powers(base: int, n: int) -> np.ndarray:
    if n > 2 * PIECE_BYTES:
        return _powers(base, n)
    if base not in _KEPT:
        _KEPT[base] = _powers(base, 2 * PIECE_BYTES)
    return _KEPT[base][:n]


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each stretch: its row, anchor hash, digest, and its place: first start << 16 | windows less one << 8 | anchor's offset."""
    windows = len(data) - LENGTH + 1
    if windows < 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _kept_powers(_ODD, len(data)), out=sums[1:])
        undo = _kept_powers(_INVERSE, len(data) + 1)
        grams = mix64((sums[GRAM:] - sums[:-GRAM]) * undo[: len(data) - GRAM + 1])
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, wide = 1, LENGTH - GRAM + 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    anchor = (np.minimum(least[:windows], least[wide - span : wide - span + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    room = np.repeat(offsets[1:], np.diff(offsets))[:windows] - np.arange(windows)
    starts = np.flatnonzero(room >= LENGTH)
    anchor = anchor[starts]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(anchor)] - 1 if len(anchor) else first
    lo, hi, at = starts[first], starts[last], anchor[first]
    with np.errstate(over="ignore"):
        digest = mix64(((sums[hi + LENGTH] - sums[lo]) * undo[lo]) ^ mix64(((hi - lo) * 256 + (at - lo)).astype(np.uint64)))
    row = np.searchsorted(offsets, lo, side="right") - 1
    return row, grams[at], digest, (lo - offsets[row]) << 16 | (hi - lo) << 8 | (at - lo)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("doc_id").fill_null(_LAST))


def _emit(admitted: Broadcast | None = None):
    """Rows (anchor, digest, id, at): of the stretches that the Bloom filter admits, or without one those of a batch's digest as one row with their count n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, anchor, digest, at = stretches(*utf8(batch.column("text")))
            ids = _ids(batch)[row]
            if admitted is not None:
                kept = bloom_admits(admitted.value, [anchor, digest])
                columns = anchor[kept].view(np.int64), digest[kept].view(np.int64), ids[kept], at[kept]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "digest", "id", "at"])
                continue
            order = np.lexsort((at, ids, anchor, digest))
            anchor, digest, ids, at = anchor[order], digest[order], ids[order], at[order]
            new = np.flatnonzero(np.r_[True, (digest[1:] != digest[:-1]) | (anchor[1:] != anchor[:-1])]) if len(digest) else np.zeros(0, np.int64)
            n = np.diff(np.r_[new, len(digest)])
            anchor, digest, ids, at = anchor[new], digest[new], ids[new], at[new]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.view(np.int64), digest.view(np.int64), ids, at, n)], ["anchor", "digest", "id", "at", "n"])

    return work


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each document."""
    for batch in pieces(batches):
        data, offsets = utf8(batch.column("text"))
        raw, out = data.tobytes(), []
        for i, start, end, wanted in zip(_ids(batch).tolist(), offsets.tolist(), offsets[1:].tolist(), batch.column("wanted").to_pylist()):
            for w in wanted:
                lo, more = w["at"] >> 16, w["at"] >> 8 & 255
                if start + lo + more + LENGTH <= end:
                    out.append((w["anchor"], w["hot"], i, lo, w["at"] & 255, raw[start + lo : start + lo + more + LENGTH]))
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["anchor", "hot", "id", "lo", "offset", "bytes"])


def _transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of the texts, each with an end mark, and their Burrows-Wheeler transform; symbols are bytes + 1, 0 ends."""
    symbols = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)  # 0xFF is in no UTF-8 text
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    span = 1
    while True:
        key = rank * (n + 257)
        key[:-span] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        span *= 2
        if span >= LENGTH or rank[order[-1]] == n - 1:
            return order, symbols[order - 1]


def equal_windows(shards: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the shards' joined texts (each text with an end mark) and their classes: one class has equal LENGTH bytes.

    Positions nearer than LENGTH to their text's end are in classes of their own. What is alone in its run stays alone in all
    further steps, so each step takes only runs of several positions back by a symbol.
    """
    orders, transforms = zip(*(_transform(s) for s in shards))
    starts = np.cumsum([0, *map(len, orders)])
    symbols, places = np.concatenate(transforms), np.concatenate([o + s for o, s in zip(orders, starts)])
    back = np.empty(len(symbols), np.int32)  # where the suffix that starts a symbol earlier stands
    for own, start in zip(transforms, starts):
        back[start + np.argsort(own, kind="stable")] = np.arange(start, start + len(own))
    slot, run = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    for _ in range(LENGTH):
        before = symbols[slot]
        order = np.argsort(before, kind="stable")[len(before) - np.count_nonzero(before) :]  # an end mark equals no other
        before, prior, slot = before[order], run[order], back[slot[order]]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (before[1:] != before[:-1]) | (prior[1:] != prior[:-1])
        several = ~(new[:-1] & new[1:])
        slot, run = slot[several], np.cumsum(new[:-1][several], dtype=np.int32)
        if not len(slot):
            break
    alone = np.ones(len(symbols), bool)
    alone[slot] = False
    last = int(run[-1]) if len(run) else 0
    return np.r_[places[slot], places[alone]], np.r_[run, np.arange(last + 1, last + 1 + np.count_nonzero(alone))]


def _repeats(ids: np.ndarray, los: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, offset) of the windows of the texts that also start earlier, in order of id and position, in another text."""
    cut = -(-len(texts) // SHARDS)
    position, run = equal_windows([texts[i : i + cut] for i in range(0, len(texts), cut)])
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(sizes) - sizes
    text = np.searchsorted(begins, position, side="right") - 1
    offset = position - begins[text]
    fine = offset + LENGTH < sizes[text]
    text, offset, run = text[fine], offset[fine], run[fine]
    order = np.lexsort((los[text] + offset, ids[text], run))
    text, offset, run = text[order], offset[order], run[order]
    start = los[text] + offset
    first = np.searchsorted(run, run)  # a repeated row starts where its twin does, which is no repeat
    again = (ids[text] != ids[text[first]]) | (start != start[first])
    return text[again], offset[again]


def _spans(ids: np.ndarray, los: np.ndarray, text: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive windows as byte spans."""
    order = np.lexsort((offset, text))
    text, offset = text[order], offset[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(text) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(text)] - 1 if len(text) else first
    return pa.RecordBatch.from_arrays([pa.array(ids[text[first]]), pa.array(los[text[first]] + offset[first]), pa.array(los[text[first]] + offset[last] + LENGTH)], ["id", "lo", "hi"])


def _comparable(block: list[tuple]) -> list[tuple]:
    """The stretches that can share a window with another of their anchor, each cut to the windows that can be shared.

    A window has LENGTH - GRAM bytes besides its anchor. Two that are equal, with x of these bytes before the anchor, agree in
    what stands from GRID * (x // GRID) bytes before it up to the end that the next multiple's windows have in common. Most
    anchors that recur by chance fail this.
    """
    sizes = np.array([len(b[4]) for b in block])
    begins = np.cumsum(sizes) - sizes
    at, ends = begins + np.array([b[3] for b in block]), begins + sizes
    anchor = np.array([b[0] for b in block], np.int64).view(np.uint64)
    data = np.frombuffer(b"".join([b[4] for b in block]), np.uint8)
    before = np.arange(0, LENGTH - GRAM + 1, GRID)
    first, last = at[:, None] - before, at[:, None] + GRAM + np.maximum(LENGTH - GRAM - before - GRID + 1, 0)
    text, nth = np.nonzero((first >= begins[:, None]) & (last <= ends[:, None]))
    hashes = span_hashes(data, first[text, nth], last[text, nth]) ^ mix64(anchor[text] + nth.astype(np.uint64))
    _, group, n = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = n[group] > 1
    text, nth = text[shared], nth[shared]
    lo, hi = ends.copy(), begins.copy()
    np.minimum.at(lo, text, at[text] - before[nth] - GRID + 1)
    np.maximum.at(hi, text, at[text] - before[nth] + LENGTH)
    lo, hi = np.maximum(lo, begins) - begins, np.minimum(hi, ends) - begins
    return [(anchor, i, start + a, offset - a, raw[a:b]) for (anchor, i, start, offset, raw), a, b in zip(block, lo.tolist(), hi.tolist()) if b - a >= LENGTH]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Works on stretches sorted by anchor, in blocks of whole groups."""
    rows: list[tuple] = []
    held = 0

    def solve(block: list[tuple]) -> pa.RecordBatch:
        block = _comparable(block)
        ids, los = np.array([b[1] for b in block], np.int64), np.array([b[2] for b in block], np.int64)
        found = _repeats(ids, los, [b[4] for b in block]) if block else (np.zeros(0, np.int64),) * 2
        return _spans(ids, los, *found)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "id", "lo", "offset", "bytes"))):
            if held >= BLOCK_BYTES and row[0] != rows[-1][0]:
                yield solve(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[4])
    if rows:
        yield solve(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the stretches: two digests, id and start."""
    for batch in batches:
        for part in pieces(iter([batch]), "bytes"):
            raw = part.column("bytes").to_pylist()
            sizes = np.array([len(b) for b in raw])
            begins = np.cumsum(sizes) - sizes
            counts = sizes - LENGTH + 1
            text = np.repeat(np.arange(len(raw)), counts)
            offset = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = begins[text] + offset
            data = np.frombuffer(b"".join(raw), np.uint8)
            one, two = span_hashes(data, at, at + LENGTH), span_hashes(data, at + 1, at + LENGTH)
            ids, los = np.asarray(part.column("id")), np.asarray(part.column("lo"))
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array((two ^ data[at]).view(np.int64)), pa.array(ids[text]), pa.array(los[text] + offset)], ["one", "two", "id", "lo"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs(id, doc_id, text) -> id, lo, hi: byte spans that strings cover which also start earlier. Spans may overlap."""
    first = docs.mapInArrow(_emit(), "anchor long, digest long, id long, at long, n long").repartition("anchor").groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("id", "at")).alias("first"))
    first = checkpointed(first.withColumn("kinds", F.count("*").over(Window.partitionBy("anchor"))).filter("n > 1 or kinds > 1"))
    twins = first.filter("n > 1").select("anchor", "digest", "first")
    admitted = docs.sparkSession.sparkContext.broadcast(bloom_filter(twins, ["anchor", "digest"]))
    every = docs.mapInArrow(_emit(admitted), "anchor long, digest long, id long, at long")
    whole = every.join(twins, ["anchor", "digest"]).filter(F.struct("id", "at") > F.col("first"))
    start, more = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255))
    whole = whole.select("id", start.alias("lo"), (start + more + LENGTH).alias("hi"))

    edges = first.filter("kinds > 1").select("first.id", F.struct("anchor", (F.col("kinds") > MOST_STRETCHES).alias("hot"), "first.at").alias("w")).groupBy("id").agg(F.collect_list("w").alias("wanted"))
    edges = checkpointed(edges)
    snippets = only(docs, edges.select("id"), "id").join(edges, "id").mapInArrow(_snippets, "anchor long, hot boolean, id long, lo long, offset int, bytes binary")
    snippets = checkpointed(snippets)
    merged = snippets.filter("not hot").repartition("anchor").sortWithinPartitions("anchor", "id", "lo").mapInArrow(_merge, "id long, lo long, hi long")
    windows = snippets.filter("hot").mapInArrow(_windows, "one long, two long, id long, lo long")
    twice = windows.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(F.struct("id", "lo")).alias("first")).filter("n > 1")
    counted = windows.join(twice, ["one", "two"]).filter(F.struct("id", "lo") > F.col("first")).select("id", "lo", (F.col("lo") + LENGTH).alias("hi"))
    return whole.unionByName(merged).unionByName(counted)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = utf8(batch.column("text"))
        raw, out = data.tobytes(), []
        for start, end, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("spans").to_pylist()):
            gone: list[list[int]] = []
            for lo, hi in sorted((s["lo"], min(s["hi"], end - start)) for s in spans or ()):
                if gone and lo <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], hi)
                elif lo < hi:
                    gone.append([lo, hi])
            ends = [0, *(x for g in gone for x in g), end - start]
            kept = b"".join(raw[start + a : start + b] for a, b in zip(ends[::2], ends[1::2]))
            out.append((end - start, end - start - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256; a row for each row.

    Texts are UTF-8 bytes, null ones empty; matches never cross documents, and count on the input, not on what is left.
    A null doc_id is greater than all others. A repeated row is treated like its twin: rows that share a doc_id, or have none, are
    one document to the order of starts and should have one text. Columns of docs but doc_id and text are not read. Only documents with a repeat are shuffled with their text.
    """
    modest_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("doc_id", F.col("doc_id").cast("long"))
    spans = checkpointed(repeated_spans(docs).groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    ids = spans.select("id")
    touched = only(docs, ids, "id").join(spans, "id").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rest = only(docs, ids, "id", "left_anti")
    zero = F.lit(0).cast("long")
    return touched.unionByName(rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
