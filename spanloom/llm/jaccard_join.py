"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Shingles are put in one global order, rare ones first, by counts over all documents. If two sets of sizes n and m reach the
threshold, then for every k their prefixes of n - ceil(t n) + k and m - ceil(t m) + k shingles share at least k. A document
lengthens its prefix (k up to `MOST_MATCHES`) as far as the estimated cost of its candidates falls by it; a pair needs as many
common prefix shingles as the smaller k of the two, and goes on to verification only then.

* Counts: a sketch of fixed size, filled by every task and summed, gives each shingle a count that is never too low. It only
  orders shingles and chooses k, so its errors cost time, never links.
* Equal sets are one node, whatever the number of copies and with or without a doc_id; a task emits the prefix of a set once.
  Only prefix shingles that different sets share are kept.
* First each set is compared with one hub, in two rounds: of the first sets of its shingles' lists the one that it shares most
  prefix shingles with. This joins most copies, at one candidate for each set and round.
* Then sets of one list whose groups differ are compared in the list's task, long lists in blocks of two buckets, so that no pair
  becomes a row unless sizes, prefix places and an exact bound on the difference (parity bitmaps, wider ones for large sets) let it
  pass. Lists of the same sets, as the shingles of a shared passage have them, are compared once, with their number as weight.
* Candidates are verified in stars: a task holds one set and compares those sent to it, so a set travels once for each candidate.
* A verified member keeps its difference from the hub, which is short. Links within a group are counted from these differences, in
  blocks of two buckets of its sets, which return a number for each set, no pairs.
* Hot shingles are last in the order, so they are rarely in a prefix.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import BROADCAST_ROWS, bloom_admits, bloom_filter, checkpointed, give_back, lean, mix64, modest_batches, only, pieces, shingles, table, utf8, written
from spanloom.llm.components import connected_components

#: Counters of the sketch (as bits) and of one block of it; largest k; cost of verifying a candidate against that of a match.
SKETCH_BITS, BLOCK_BITS, MOST_MATCHES, VERIFY_COST = 22, 12, 4, 4.0
#: 64-bit words of a parity bitmap; members of a star, and sets of a list, that one task takes together, about; pairs that a step
#: of the comparison within a list works on.
BITMAP_WORDS, STAR_SETS, LIST_SETS, STEP_PAIRS = 4, 1024, 2048, 1 << 19
#: Bitmaps of larger sets besides: name, 64-bit words, sets that have it (a bitmap says little of sets with more shingles than bits).
#: Words of such bitmaps that a step of the comparison within a list gathers.
WIDER, STEP_WORDS = (("wide", 32, 384), ("widest", 256, 3072)), 1 << 18
#: Sets, and shingles of their differences, that one bucket of a group holds, about; times that a set goes on to its hub's hub.
BUCKET_SETS, BUCKET_SHINGLES, JUMPS = 2048, 1 << 20, 2
_BITS = [f"bits{i}" for i in range(BITMAP_WORDS)]


class Threshold:
    """Similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least_overlap(self, n: np.ndarray) -> np.ndarray:
        """The least intersection of a set of size n with any set that reaches the threshold."""
        return -(-self.num * n // self.den)


def _sets(batch: pa.RecordBatch, n_words: int, seen: set[int]) -> tuple[np.ndarray, ...]:
    """Of a batch: shingles, their rows, set sizes, row bounds, digests, and which rows hold a set that `seen` lacks (it gets them)."""
    data, offsets = utf8(batch.column("text"))
    value, row = shingles(data, offsets, n_words)
    size = np.bincount(row, minlength=batch.num_rows)
    bounds = np.r_[0, np.cumsum(size)]
    sums = np.zeros(len(value) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix64(value), out=sums[1:])
        digest = mix64((sums[bounds[1:]] - sums[bounds[:-1]]) ^ mix64(size.astype(np.uint64)))
    new = np.zeros(batch.num_rows, bool)
    for i, d in enumerate(digest.tolist()):
        if size[i] and d not in seen:
            seen.add(d)
            new[i] = True
    return value, row, size, bounds, digest.view(np.int64), new


def _bitmaps(value: np.ndarray, row: np.ndarray, rows: int, words: int = BITMAP_WORDS) -> np.ndarray:
    """For each row, the parity of its shingles in each of words * 64 classes."""
    classes = words * 64
    odd = np.bincount(row * classes + (mix64(value) >> np.uint64(32)).astype(np.int64) % classes, minlength=rows * classes) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, classes), axis=1, bitorder="little").view(np.int64)


def _wider(value: np.ndarray, row: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """The bitmaps of WIDER, null for rows with fewer shingles."""
    out = []
    for _, words, least in WIDER:
        has = size > least
        kept = has[row]
        bits = _bitmaps(value[kept], (np.cumsum(has) - 1)[row[kept]], int(has.sum()), words)
        bounds = np.r_[0, np.cumsum(np.where(has, words, 0))].astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(bits.ravel()), mask=pa.array(~has)))
    return out


def _describe(docs: DataFrame, n_words: int) -> DataFrame:
    """A row (block null) for each document with its set's size, digest and bitmap, and from each task the blocks of its sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.int32), set()
        wider = [(name, pa.list_(pa.int64())) for name, *_ in WIDER]
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.int64()), *((b, pa.int64()) for b in _BITS), *wider, ("block", pa.int32()), ("counts", pa.binary())])
        for batch in pieces(batches):
            value, row, size, _, digest, new = _sets(batch, n_words, seen)
            np.add.at(sketch, (value[new[row]] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            bits = _bitmaps(value, row, batch.num_rows)
            none = [pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(digest), *(pa.array(b) for b in bits.T.copy()), *_wider(value, row, size), *none], schema=schema)
        blocks = [(i, zlib.compress(b.tobytes(), 1)) for i, b in enumerate(sketch.reshape(-1, 1 << BLOCK_BITS)) if b.any()]
        if blocks:
            nulls = [pa.nulls(len(blocks), f.type) for f in schema][:-2]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.binary())], schema=schema)

    bits = "".join(f", {b} long" for b in _BITS) + "".join(f", {name} array<long>" for name, *_ in WIDER)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(work), f"doc_id long, n long, digest long{bits}, block int, counts binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the blocks of a partition, one array for each block number."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(zlib.decompress(counts), np.int32)
            sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], ["block", "counts"])


def _sketch(blocks: DataFrame) -> np.ndarray:
    """The counters of all blocks(block, counts), each at most the largest int."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int32)
    for row in blocks.collect():  # SKETCH_BITS sets their size
        counts = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
        np.minimum(counts, 2**31 - 1, out=sketch.reshape(-1, 1 << BLOCK_BITS)[row["block"]], casting="unsafe")
    return sketch


def _prefixes(docs: DataFrame, n_words: int, limit: Threshold, sent: Broadcast, noise: float) -> DataFrame:
    """(token, node, id, meta): the prefix shingles of each set; meta holds the size, the shingle's level and the document's k.

    sent: the sketch; noise: what one of its counters holds on average.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sent.value, set()
        for batch in pieces(batches):
            value, row, size, bounds, digest, new = _sets(batch, n_words, seen)
            value, row = value[keep := new[row]], row[keep]
            if not len(value):
                continue
            size = np.where(new, size, 0)
            bounds = np.r_[0, np.cumsum(size)]
            count = counts[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            order = np.lexsort((count, row))  # stable: of equal counts the smaller hash comes first
            value, count = value[order], count[order]
            base = size - limit.least_overlap(size)
            # the documents a shingle is expected to bring, beyond what a counter holds by chance
            brought = np.r_[0.0, np.cumsum(np.maximum(count - noise - 1, 0))]
            costs = []
            for k in range(1, MOST_MATCHES + 1):
                ends = bounds[:-1] + np.minimum(base + k, size)
                matches = brought[ends] - brought[bounds[:-1]]
                costs.append(np.where(k <= limit.least_overlap(size), base + k + matches + VERIFY_COST * matches / k, np.inf))
            k = np.argmin(costs, axis=0) + 1
            rank = np.arange(len(value)) - bounds[row]
            level = np.maximum(rank + 1 - base[row], 1)
            picked = level <= k[row]
            row, level = row[picked], level[picked]
            meta = (size[row].astype(np.int64) << 8) | (level.astype(np.int64) << 4) | k[row].astype(np.int64)
            ids = np.asarray(batch.column("doc_id").fill_null(2**63 - 1))[row]
            yield pa.RecordBatch.from_arrays([pa.array(value[picked].view(np.int64)), pa.array(digest[row]), pa.array(ids), pa.array(meta)], ["token", "node", "id", "meta"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(work), "token long, node long, id long, meta long")


def _k(meta: str) -> Column:
    return F.col(meta).bitwiseAND(F.lit(15))


def _level(meta: str) -> Column:
    return F.shiftright(meta, 4).bitwiseAND(F.lit(15))


def _shared(prefixes: DataFrame) -> DataFrame:
    """The prefix rows of the shingles that different sets have, with the first set of each such list by doc_id and by digest.

    A Bloom filter of fixed size, of these shingles, keeps most other rows out of the shuffle; the join leaves out the rest.
    """
    lists = prefixes.groupBy("token").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last").select("token")
    lists = checkpointed(lists)
    admitted = prefixes.sparkSession.sparkContext.broadcast(bloom_filter(lists, ["token"]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom_admits(admitted.value, [np.asarray(batch.column("token"))])))

    rows = checkpointed(prefixes.mapInArrow(lean(work), "token long, node long, id long, meta long").join(lists, "token"))
    own = F.struct("node", "meta")
    admitted.destroy()
    hubs = rows.groupBy("token").agg(F.min_by(own, F.struct("id", "node")).alias("hub_0"), F.min(own).alias("hub_1"))
    return rows.drop("id").join(hubs, "token")


def _hub_candidates(shared: DataFrame, hub: str, limit: Threshold) -> DataFrame:
    """(hub, node), one for each set that has any: of the hubs with enough common prefix shingles the one with the most."""
    rows = shared.select("node", "meta", F.col(f"{hub}.node").alias("hub"), F.col(f"{hub}.meta").alias("hub_meta"))
    n, m, k = F.shiftright("meta", 8), F.shiftright("hub_meta", 8), F.least(_k("meta"), _k("hub_meta"))
    fits = (F.col("node") != F.col("hub")) & (F.greatest(n, m) * limit.num <= F.least(n, m) * limit.den) & (F.greatest(_level("meta"), _level("hub_meta")) <= k)
    found = rows.filter(fits).groupBy("node", "hub").agg(F.count("*").alias("matches"), F.min(k).alias("k")).filter("matches >= k")
    return found.groupBy("node").agg(F.max_by("hub", F.struct("matches", "hub")).alias("hub")).select("hub", "node")


def _most_apart(total, limit: Threshold):
    """The greatest symmetric difference of two sets that reach the threshold, of the sum of their sizes."""
    return total + 2 * (-limit.num * total // (limit.num + limit.den))


def _apart(total: Column, limit: Threshold) -> Column:
    return total - 2 * F.ceil(total * limit.num / (limit.num + limit.den) - 1e-9)


def _within(u: np.ndarray, v: np.ndarray, most: np.ndarray, wider: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which pairs (u, v) differ in at most `most` bits of each of the wider bitmaps that both have."""
    good = np.ones(len(u), bool)
    for (place, bits), (_, words, _) in zip(wider, WIDER):
        both = np.flatnonzero(good & (place[u] >= 0) & (place[v] >= 0))
        for at in np.split(both, range(step := STEP_WORDS // words, len(both), step)):
            good[at] = np.bitwise_count(bits[place[u[at]]] ^ bits[place[v[at]]]).sum(axis=1, dtype=np.int64) <= most[at]
    return good


def _list_pairs(limit: Threshold):
    """Rows sorted by block (token, i, j) -> a, b, k, matches: the pairs of a block that can reach the threshold, in steps."""
    order_by = ("token", "i", "j", "bucket", "node", "group", "meta", "weight", *_BITS)

    def pairs(block: np.ndarray, across: np.ndarray, bucket: np.ndarray, node: np.ndarray, group: np.ndarray, meta: np.ndarray, weight: np.ndarray, bits: np.ndarray, wider: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        size, level, k = meta >> 8, meta >> 4 & 15, meta & 15
        order = np.lexsort((node, size, block))
        twin = np.zeros(len(order), bool)
        twin[1:] = (node[order][1:] == node[order][:-1]) & (block[order][1:] == block[order][:-1])
        order = order[~twin]
        block, across, bucket, node, group, size, level, k, weight, bits = (x[order] for x in (block, across, bucket, node, group, size, level, k, weight, bits))
        wider = [(place[order], words) for place, words in wider]
        span = int(size.max(initial=0)) * limit.den // limit.num + 2
        ends = np.searchsorted(block * span + size, block * span + size * limit.den // limit.num, side="right")
        partners = ends - np.arange(len(node)) - 1
        steps = np.cumsum(partners) // STEP_PAIRS
        for at in (rows for rows in np.split(np.arange(len(node)), np.flatnonzero(np.diff(steps)) + 1) if len(rows)):
            n = partners[at]
            u = np.repeat(at, n)
            v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
            least = np.minimum(k[u], k[v])
            good = (group[u] != group[v]) & (np.maximum(level[u], level[v]) <= least) & ~(across[u] & (bucket[u] == bucket[v]))
            u, v, least = u[good], v[good], least[good]
            most = _most_apart(size[u] + size[v], limit)
            good = np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1, dtype=np.int64) <= most
            u, v, least, most = u[good], v[good], least[good], most[good]
            good = _within(u, v, most, wider)
            u, v, least = u[good], v[good], least[good]
            if not len(u):
                continue
            a, b = np.minimum(node[u], node[v]), np.maximum(node[u], node[v])
            order = np.lexsort((b, a))
            a, b, least = a[order], b[order], least[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            matches = np.add.reduceat(weight[u][order], first)
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(least[first]), pa.array(matches)], ["a", "b", "k", "matches"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the last block so far
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in order_by[:3]])
            last = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            start = int(last[-1]) + 1 if len(last) else 0
            same = held and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in order_by[:3])
            if held and (start or not same):
                # what is held ends in this batch or before it
                yield from solved([*held, batch.slice(0, start)])
                held = []
            elif start:
                yield from solved([batch.slice(0, start)])
            held.append(batch.slice(start))
        if held:
            yield from solved(held)

    def solved(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        rows = np.stack([table.column(c).to_numpy().astype(np.int64) for c in order_by])
        wider = []
        for name, words, _ in WIDER:
            column = table.column(name).combine_chunks()
            has = ~np.asarray(column.is_null())
            bits = column.flatten().to_numpy().view(np.uint64)
            wider.append((np.where(has, np.cumsum(has) - 1, -1), bits.reshape(-1, words)))
        block = np.cumsum(np.r_[0, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])
        yield from pairs(block, rows[1] != rows[2], *rows[3:8], rows[8:].T.copy().view(np.uint64), wider)

    return work


def _candidates(shared: DataFrame, known: DataFrame, nodes: DataFrame, limit: Threshold) -> DataFrame:
    """(hub, node): pairs of sets of different known groups with enough common prefix shingles and near enough bitmaps.

    known(node, group): sets already found connected. A shingle all of whose sets are in one group brings no pair. Of the shingles
    with the same rows (count and 64-bit sums of row hashes) the least stands for all.
    """
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = shared.select("token", "node", "meta").join(F.broadcast(known) if few else known, "node", "left").select("token", "node", "meta", F.coalesce("group", "node").alias("group"))
    rows = checkpointed(rows)
    row = F.xxhash64("node", "meta")
    members = [F.sum(row.bitwiseAND(F.lit(2**32 - 1))).alias("low"), F.sum(F.shiftright(row, 32)).alias("high")]
    lists = rows.groupBy("token").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.count("*").alias("sets"), *members).filter("least <> most")
    lists = lists.groupBy("sets", "low", "high").agg(F.min("token").alias("token"), F.count("*").alias("weight"))
    lists = lists.select("token", "weight", F.ceil(F.col("sets") / LIST_SETS).cast("int").alias("buckets"))
    wider = [name for name, *_ in WIDER]
    rows = rows.join(lists, "token").join(nodes.select("node", *_BITS, *wider), "node")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("node"), F.col("buckets").cast("long")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    rows = rows.select("token", F.least("bucket", "x").alias("i"), F.greatest("bucket", "x").alias("j"), "bucket", "node", "group", "meta", "weight", *_BITS, *wider)
    pairs = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(lean(_list_pairs(limit)), "a long, b long, k long, matches long")
    return pairs.groupBy("a", "b").agg(F.sum("matches").alias("matches"), F.min("k").alias("k")).filter("matches >= k").select(F.col("a").alias("hub"), F.col("b").alias("node"))


def _emit_sets(n_words: int):
    """The sets of documents, one row for each place that wants them: (one, two, role, node, shingles)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            value, _, _, bounds, digest, _ = _sets(batch, n_words, set())
            out = []
            for d, start, end, wanted in zip(digest.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), batch.column("wanted").to_pylist()):
                own = value[start:end].tobytes()
                out += [(w["one"], w["two"], w["role"], d, own) for w in wanted if w["node"] == d]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["one", "two", "role", "node", "shingles"])

    return work


def _all_sets(n_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            value, _, _, bounds, digest, _ = _sets(batch, n_words, set())
            yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array([value[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())], ["node", "shingles"])

    return work


def _dealt(docs: DataFrame, wanted: DataFrame, n_words: int) -> DataFrame:
    """The shingles of the wanted(rep, node, one, two, role), dealt by (one, two) and sorted by it and the role.

    rep is a doc_id that has the set, or null. Rows may repeat where a document does.
    """
    kind = "one long, two int, role int, node long, shingles binary"
    own, place = docs.select(F.col("doc_id").cast("long"), "text"), ("one", "two", "role")
    wanted = checkpointed(wanted.select("rep", "node", *place))
    lists = wanted.filter("rep is not null").groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list(F.struct("node", *place)).alias("wanted"))
    rows = only(own, checkpointed(lists), "doc_id", "inner").select("text", "wanted").mapInArrow(lean(_emit_sets(n_words)), kind)
    nameless = wanted.filter("rep is null").drop("rep")
    if not nameless.isEmpty():  # a set without a doc_id is known by its digest alone
        sets = own.filter("doc_id is null").mapInArrow(lean(_all_sets(n_words)), "node long, shingles binary").dropDuplicates(["node"])
        rows = rows.unionByName(sets.join(nameless, "node"))
    return rows.repartition("one", "two").sortWithinPartitions("one", "two", "role")


def _verify_stars(limit: Threshold):
    """Rows sorted by (one, two, role), role 0 being the star's hub -> a (hub), b and their difference for each member that reaches the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, hub, own = None, 0, np.zeros(0, np.uint64)
        for batch in batches:
            one, two, role, node = (np.asarray(batch.column(c)).astype(np.int64) for c in ("one", "two", "role", "node"))
            value = batch.column("shingles").cast(pa.large_binary())
            bounds = np.frombuffer(value.buffers()[1], np.int64)[value.offset : value.offset + len(value) + 1] // 8
            value = np.frombuffer(value.buffers()[2] or b"", np.uint64)
            starts = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (role[1:] != role[:-1])]) if len(one) else []
            links: list[tuple[int, int, np.ndarray]] = []
            for at, end in zip(starts, [*starts[1:], len(one)]):
                if not role[at]:
                    star, hub, own = (one[at], two[at]), int(node[at]), value[bounds[at] : bounds[at + 1]]
                elif star == (one[at], two[at]):
                    sizes = np.diff(bounds[at : end + 1])
                    found = value[bounds[at] : bounds[end]]
                    common = np.add.reduceat((own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found).astype(np.int64), bounds[at:end] - bounds[at])
                    good = np.flatnonzero(limit.den * common >= limit.num * (sizes + len(own) - common)) + at
                    links += [(hub, int(node[i]), np.setxor1d(own, value[bounds[i] : bounds[i + 1]], assume_unique=True).view(np.int64)) for i in good]
            a, b, apart = zip(*links) if links else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(apart, pa.list_(pa.int64()))], ["a", "b", "apart"])

    return work


def _links(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, n_words: int, limit: Threshold) -> DataFrame:
    """(a, b, apart): those of the pairs (hub, node) that reach the threshold, after the bitmaps' bound and in full; apart is their
    symmetric difference."""
    wider = [name for name, *_ in WIDER]
    for s in ("hub", "node"):
        pairs = pairs.join(nodes.select(F.col("node").alias(s), F.struct("n", "rep", *_BITS, *wider).alias(f"of_{s}")), s)
    most = _apart(F.col("of_hub.n") + F.col("of_node.n"), limit)
    near = sum((F.bit_count(F.col(f"of_hub.{b}").bitwiseXOR(F.col(f"of_node.{b}"))) for b in _BITS), F.lit(0)) <= most
    for name in wider:  # null where one of the two has none
        differ = F.zip_with(f"of_hub.{name}", f"of_node.{name}", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        near &= F.coalesce(F.aggregate(differ, F.lit(0), lambda total, x: total + x) <= most, F.lit(True))
    pairs = checkpointed(pairs.filter(near).select("hub", "node", F.col("of_hub.rep").alias("hub_rep"), F.col("of_node.rep").alias("rep")))
    hot = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR_SETS).cast("long").alias("parts")).filter("parts > 1")
    piece = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1).cast("long"))).cast("int")
    pairs = pairs.join(hot, "hub", "left").withColumn("two", piece)
    members = pairs.select("rep", "node", F.col("hub").alias("one"), "two", F.lit(1).alias("role"))
    hubs = pairs.select(F.col("hub_rep").alias("rep"), F.col("hub").alias("node"), F.col("hub").alias("one"), "two", F.lit(0).alias("role")).distinct()
    # a doc_id that repeats with other texts has other digests; equal rows give equal links, made one here
    return checkpointed(_dealt(docs, members.unionByName(hubs), n_words).mapInArrow(lean(_verify_stars(limit)), "a long, b long, apart array<long>").dropDuplicates(["a", "b"]))


def _trees(links: DataFrame) -> DataFrame:
    """node, group, apart: the sets of links(a, b, apart), each b having one a, and their differences from the group's set.

    A set goes with the set that it has been linked to, and that one's, a few times over; the end of the way names the group.
    """
    tree = links.select(F.col("b").alias("node"), F.col("a").alias("group"), "apart")
    both = lambda x, y: F.array_except(F.array_union(x, y), F.array_intersect(x, y))
    for _ in range(JUMPS):
        up = tree.select(F.col("node").alias("group"), F.col("group").alias("next"), F.col("apart").alias("more"))
        moved = both(F.col("apart"), F.col("more"))
        tree = checkpointed(tree.join(up, "group", "left").select("node", F.coalesce("next", "group").alias("group"), F.when(F.col("next").isNull(), F.col("apart")).otherwise(moved).alias("apart")))
    tops = tree.select("group").distinct().join(tree.select(F.col("node").alias("group")), "group", "left_anti")
    return tree.unionByName(tops.select(F.col("group").alias("node"), "group", F.array().cast("array<long>").alias("apart")))


def _block_links(node: np.ndarray, bucket: np.ndarray, size: np.ndarray, apart: list[np.ndarray], across: bool, limit: Threshold) -> dict[int, int]:
    """The number of links of each set with the others, or with those of the other bucket if `across`.

    apart: the differences of the sets from one and the same set; two sets differ by the difference of these.
    """
    order = np.argsort(size, kind="stable")
    node, bucket, size, apart = node[order], bucket[order], size[order], [apart[i] for i in order]
    value = np.concatenate(apart).view(np.uint64)
    far = np.array([len(x) for x in apart], np.int64)
    bounds = np.r_[0, np.cumsum(far)]
    bits = _bitmaps(value, np.repeat(np.arange(len(node)), far), len(node)).view(np.uint64)
    distinct, ids = np.unique(value, return_inverse=True)
    has, links = np.zeros(len(distinct), bool), np.zeros(len(node), np.int64)
    for u, end in enumerate(np.searchsorted(size, size * limit.den // limit.num, side="right").tolist()):
        v = np.arange(u + 1, end)
        if across:
            v = v[bucket[v] != bucket[u]]
        most = _most_apart(size[v] + size[u], limit)
        near = np.bitwise_count(bits[v] ^ bits[u]).sum(axis=1, dtype=np.int64) <= most
        v, most = v[near], most[near]
        if not len(v):
            continue
        has[ids[bounds[u] : bounds[u + 1]]] = True
        starts = np.r_[0, np.cumsum(far[v])]
        hits = np.r_[0, np.cumsum(has[ids[np.repeat(bounds[v] - starts[:-1], far[v]) + np.arange(starts[-1])]])]
        has[ids[bounds[u] : bounds[u + 1]]] = False
        good = v[far[v] + far[u] - 2 * (hits[starts[1:]] - hits[starts[:-1]]) <= most]
        links[good] += 1
        links[u] += len(good)
    return {n: k for n, k in zip(node.tolist(), links.tolist()) if k}


def _count_blocks(limit: Threshold):
    """Rows sorted by block (group, i, j) -> node, n_links: one number for each set of a block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def counted() -> pa.RecordBatch:
            columns = list(zip(*held))
            found = _block_links(*(np.array(c, np.int64) for c in columns[:3]), columns[3], now[1] != now[2], limit) if held else {}
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["node", "n_links"])

        for batch in batches:
            apart = batch.column("apart")
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j", "node", "bucket", "n")))):
                if row[:3] != now:
                    yield counted()
                    now, held = row[:3], []
                held.append((*row[3:], np.asarray(apart[i].values, np.int64).copy()))
        yield counted()

    return work


def _links_within(members: DataFrame, limit: Threshold) -> DataFrame:
    """members(node, n, group, apart) -> node, n_links: each set's links with sets of its own group."""
    weights = members.groupBy("group").agg(F.count("*").alias("sets"), F.sum(F.size("apart")).alias("total")).filter("sets > 1")
    buckets = F.ceil(F.greatest(F.col("sets") / BUCKET_SETS, F.col("total") / BUCKET_SHINGLES)).cast("int")
    rows = members.join(weights.select("group", buckets.alias("buckets")), "group").withColumn("bucket", F.pmod(F.xxhash64("node"), F.col("buckets").cast("long")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    rows = rows.select("group", F.least("bucket", "x").alias("i"), F.greatest("bucket", "x").alias("j"), "bucket", "node", "n", "apart")
    return rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(lean(_count_blocks(limit)), "node long, n_links long")


def jaccard_classes(docs: DataFrame, n_words: int, num: int, den: int, count_links: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id and, if count_links, n_links; a row for each row.

    Documents link when den * |intersection| >= num * |union| of their sets of n_words-word shingles; component_id is the least
    doc_id reachable by links, n_links the number of different sets that the document's own set links with. A document with
    fewer words has its whole sequence as one shingle; one without words or text has none, links with nothing and is its own
    component. Equal sets link, so copies share a component. A null doc_id never counts as least; it has component null where
    no other id is reachable.
    """
    modest_batches(docs.sparkSession)
    limit = Threshold(num, den)
    described = checkpointed(_describe(docs, n_words))
    blocks = described.filter("block is not null").select("block", "counts").repartition("block").mapInArrow(lean(_summed), "block int, counts binary")
    sketch = _sketch(blocks)
    noise = float(sketch.sum(dtype=np.int64)) / len(sketch)
    sent = docs.sparkSession.sparkContext.broadcast(sketch)
    del sketch
    own = described.filter("block is null").drop("block", "counts")
    nodes = checkpointed(own.filter("n > 0").groupBy(F.col("digest").alias("node"), "n").agg(F.min("doc_id").alias("rep"), *[F.first(b).alias(b) for b in (*_BITS, *(name for name, *_ in WIDER))]))

    prefixes = written(_prefixes(docs, n_words, limit, sent, noise))
    sent.destroy()
    give_back()
    shared = checkpointed(_shared(prefixes))
    give_back()
    links = _links(docs, _hub_candidates(shared, "hub_0", limit), nodes, n_words, limit)
    linked = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = links.unionByName(_links(docs, _hub_candidates(shared.join(linked, "node", "left_anti"), "hub_1", limit), nodes, n_words, limit))
    known = checkpointed(_trees(links))
    more = _links(docs, _candidates(shared, known.select("node", "group"), nodes, limit), nodes, n_words, limit)

    named = nodes.select("node", "n", "rep")
    reached = named.join(connected_components(links.unionByName(more).select("a", "b")), "node")
    least = reached.groupBy("component").agg(F.min("rep").alias("least"))
    classes = named.join(reached.join(least, "component").select("node", "n", "least"), ["node", "n"], "left")
    classes = checkpointed(classes.select(F.col("node").alias("digest"), "n", F.coalesce("least", "rep").alias("component")))
    found = own.select("doc_id", "n", "digest").join(classes, ["digest", "n"], "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")]
    if count_links:
        # pairs of one group of `known` are counted in blocks; `more` has the links of all others, once each
        parts = _links_within(named.join(known, "node"), limit)
        for s in "ab":
            parts = parts.unionByName(more.groupBy(F.col(s).alias("node")).agg(F.count("*").alias("n_links")))
        degree = parts.groupBy(F.col("node").alias("digest")).agg(F.sum("n_links").alias("n_links"))
        found = found.join(degree, "digest", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return found.select(*columns)


def without_near_copies(docs: DataFrame, n_words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs but those of which a document with a smaller doc_id is in the same component; doc_id must be unique."""
    classes = jaccard_classes(docs, n_words, num, den, count_links=False)
    copies = checkpointed(classes.filter("component_id < doc_id").select("doc_id"))
    return only(docs, copies, "doc_id", "left_anti").select(*docs.columns)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), 3, 90, 100)
