"""Helpers shared by the corpus operators: tables, checkpoints, Arrow batches and vectorised hashing of text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer single text forms a step of its own.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set on a single machine, as in tests."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")


def fresh(name: str, columns: list[str]) -> str:
    """A column name that isn't taken."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


#: Most rows of a batch between Spark and Python: texts are long, and 10,000 of them take over 100 MB in each of a task's buffers.
BATCH_ROWS = 2048


def modest_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, if they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """DataFrames made in this block drop their shuffle files as soon as their result stands; else these wait for the driver's garbage collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, into the shared folder."""
    _shared_folder(df.sparkSession)
    with passing_shuffles(df.sparkSession):
        return df.select("*").checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with passing_shuffles(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: How to forget what this worker remembers from task to task, by operator.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """This worker holds something for the operator's next tasks; the first task of another operator calls `forget`."""
    _REMEMBERED[operator] = forget


def forget_others(operator: str) -> None:
    for name in [n for n in _REMEMBERED if n != operator]:
        _REMEMBERED.pop(name)()


def give_back() -> None:
    """Freed memory goes back to the system, of which C libraries else keep much."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow without what other operators remember, and giving freed memory back at its end: Spark keeps idle workers."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(operator)
        yield from work(batches)
        give_back()

    return mapped


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, in slices with about `most` bytes of the column, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        part = np.cumsum(sizes) // most
        for at, end in zip(starts := np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), [*starts[1:], batch.num_rows]):
            yield batch.slice(at, end - at)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (multiply and xor-shift rounds), element by element."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], from prefix sums of byte values times powers of an odd number."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers(_ODD, len(data)), out=sums[1:])
        value = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
        return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of the rows, and each word's row; no word spans two rows."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[1:-1][cut]
    last[cut - 1] = inside[1:-1][cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles as 64-bit hashes, with their rows, sorted by row and hash; A-Z lower-cased.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    data = _LOWER[data]
    starts, ends, row = words(data, offsets)
    word = span_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        factor = np.uint64(0xE7037ED1A0B428DB)
        whole = len(word) - n + 1
        value = np.zeros(max(whole, 0), dtype=np.uint64)
        for i in range(n if whole > 0 else 0):
            value = mix64(value * factor + word[i : i + whole] + np.uint64(i + 1))
        rows = row[: len(value)]
        value = value[keep := rows == row[n - 1 :] if len(value) else slice(0)]
        rows = rows[keep]
        counts = np.bincount(row, minlength=len(offsets) - 1)
        ends_at = np.cumsum(counts)
        short = np.flatnonzero((counts > 0) & (counts < n))
        alone = np.zeros(len(short), dtype=np.uint64)
        for i in range(n - 1):
            more = counts[short] > i
            alone[more] = mix64(alone[more] * factor + word[(ends_at - counts)[short[more]] + i] + np.uint64(i + 1))
        value, rows = np.r_[value, mix64(alone + counts[short].astype(np.uint64))], np.r_[rows, short]
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    return value[new], rows[new]


#: Bits of a Bloom filter (as a power of two: 8 MB whatever it holds; beyond some 6 million keys it admits more and more),
#: probes of a key, and bits of one block of it.
BLOOM_BITS, BLOOM_PROBES, BLOOM_BLOCK = 26, 4, 20


def _bloom_places(keys: list[np.ndarray]) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        one = mix64(sum((mix64(k.view(np.uint64) + np.uint64(i)) for i, k in enumerate(keys)), np.uint64(0)))
        two = mix64(one + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return [((one + np.uint64(i) * two) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64) for i in range(BLOOM_PROBES)]


def bloom_filter(keys: DataFrame, columns: list[str]) -> np.ndarray:
    """The bits of the keys (long columns), as bytes. Tasks fill the blocks of their own, one task ORs each block."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
        for batch in batches:
            for at in _bloom_places([np.asarray(batch.column(c)) for c in columns]):
                np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        blocks = [(i, zlib.compress(b.tobytes(), 1)) for i, b in enumerate(bits.reshape(-1, 1 << (BLOOM_BLOCK - 3))) if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.binary())], ["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
                own = np.frombuffer(zlib.decompress(b), np.uint8)
                blocks[i] = blocks[i] | own if i in blocks else own
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([zlib.compress(b.tobytes(), 1) for b in blocks.values()], pa.binary())], ["block", "bits"])

    out = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    filled = keys.select(*columns).mapInArrow(lean(fill), "block int, bits binary").repartition("block").mapInArrow(lean(merge), "block int, bits binary")
    for row in filled.collect():  # BLOOM_BITS sets their size
        out.reshape(-1, 1 << (BLOOM_BLOCK - 3))[row["block"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


def bloom_admits(bits: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(keys[0]), bool)
    for at in _bloom_places(keys):
        out &= bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1
    return out


#: Most rows of ids that are sent to every task (about 16 MB); longer lists are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def only(docs: DataFrame, ids: DataFrame, column: str | list[str], how: str = "left_semi") -> DataFrame:
    """The rows of docs whose `column` is in the (distinct, materialised) ids; "left_anti": isn't. Few ids, counted, are broadcast."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, column, how)
