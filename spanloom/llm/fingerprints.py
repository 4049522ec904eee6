"""Document fingerprints by consistent weighted sampling.

A document is its words with their counts as weights. Each of `SAMPLES` samples draws, from hashes of (sample, word) alone, two
gamma numbers r, c and a uniform b for every word; with t = floor(ln w / r + b), the word whose ln c - r (t - b) - r is least is
the sample, together with t. Two documents take the same sample with probability sum(min) / sum(max) of their weights, the
generalised Jaccard similarity. A sample is kept as 16 bits, and the share of equal samples estimates the similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import _LOWER, mix64, modest_batches, pieces, span_hashes, table, utf8, words

#: Samples of a fingerprint (its standard error is at most 1 / sqrt(4 SAMPLES)); words whose numbers a task remembers; bytes of
#: text in a range of documents, at most, about.
SAMPLES, MEMORY, BUCKET_BYTES = 64, 1 << 16, 64 << 20
_SEEDS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Sampler:
    """Fingerprints of word sets; the numbers of words met before come from a table indexed by the words' hash bits."""

    def __init__(self) -> None:
        self.key = np.zeros(MEMORY, np.uint64)
        self.table = np.zeros((3, MEMORY, SAMPLES), np.float32)

    def _draw(self, word: np.ndarray) -> np.ndarray:
        """r, ln c and b, for each word and sample."""
        with np.errstate(over="ignore"):
            bits = mix64(word[:, None] ^ _SEEDS)
            more = mix64(bits + np.uint64(0x9E3779B97F4A7C15))
        part = lambda x, shift: ((x >> np.uint64(shift) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)
        r = -np.log(part(bits, 0)) - np.log(part(bits, 24))
        c = -np.log(part(more, 0)) - np.log(part(more, 24))
        uniform = ((bits >> np.uint64(48)).astype(np.float32) + ((more >> np.uint64(48)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-16)) * np.float32(2**-16)
        return np.stack([r, np.log(c), np.minimum(uniform, np.float32(1 - 2**-24))])

    def numbers(self, word: np.ndarray) -> np.ndarray:
        slot = (word & np.uint64(MEMORY - 1)).astype(np.int64)
        new = self.key[slot] != word
        out = self.table[:, slot]
        if new.any():
            out[:, new] = drawn = self._draw(word[new])
            self.key[slot[new]] = word[new]
            self.table[:, slot[new]] = drawn
            # of two words of one slot the last one written stays; key and numbers are written alike
        return out

    def fingerprint(self, word: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The SAMPLES 16-bit samples of distinct words with positive weights; empty without words. Ties go to the first word."""
        if not len(word):
            return np.zeros(0, np.uint16)
        best, best_word, best_t = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
        for at in range(0, len(word), 4096):
            r, log_c, b = self.numbers(w := word[at : at + 4096])
            # t is floor(ln w / r + b): zero for the many words that occur once
            t = np.zeros(r.shape, np.float32)
            many = np.flatnonzero(weight[at : at + 4096] > 1)
            t[many] = np.floor(np.log(weight[at : at + 4096][many].astype(np.float32))[:, None] / r[many] + b[many])
            value = log_c - r * (t - b + np.float32(1))
            first = value.argmin(0)
            least = value[first, np.arange(SAMPLES)]
            won = least < best
            best[won], best_word[won], best_t[won] = least[won], w[first][won], t[first, np.arange(SAMPLES)][won].astype(np.int64)
        return (mix64(best_word ^ mix64(best_t.astype(np.uint64))) >> np.uint64(48)).astype(np.uint16)

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        data = _LOWER[data]
        starts, ends, row = words(data, offsets)
        hashes = span_hashes(data, starts, ends)
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        return [self.fingerprint(*np.unique(hashes[a:b], return_counts=True)) for a, b in zip(bounds[:-1], bounds[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated similarity of two fingerprints; those of texts without words are like each other and nothing else."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def _neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, guest: sorted within partitions so that each document's successor in descending doc_id is the row after it.

    Buckets are ranges of doc_id that end at quantiles of it (one for each shuffle partition, more if they would hold more than
    BUCKET_BYTES each; these alone go to the driver), and each is a partition of its own. The rows with the greatest id of each bucket are sent a second time, as guests behind the rows of the bucket
    before it in descending order; those with the greatest id of all go behind the very last row. Equal ids are in order of
    their text, null ids come last.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    quantiles, most = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 20 * buckets), F.max("doc_id")).first()
    cuts = np.array(sorted({c for c in quantiles or [] if c < most}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").fill_null(np.iinfo(np.int64).min))
            bucket = np.searchsorted(cuts, ids).astype(np.int32)
            is_null = np.asarray(batch.column("doc_id").is_null())
            head = np.flatnonzero(is_null if most is None else (np.isin(ids, cuts) | (ids == most)) & ~is_null)
            to = np.where(ids[head] == most, 0, bucket[head] + 1).astype(np.int32) if most is not None else np.zeros(len(head), np.int32)
            for rows, where, guest in ((np.arange(len(ids)), bucket, 0), (head, to, 1)):
                if len(rows):
                    own = batch.take(pa.array(rows)) if guest else batch
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text"), pa.array(where), pa.array(np.full(len(rows), guest, np.int32))], ["doc_id", "text", "bucket", "guest"])

    dealt = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(deal, "doc_id long, text string, bucket int, guest int")
    return dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampler, carry = Sampler(), []
    hexed = lambda f: f.astype(">u2").tobytes().hex()
    for batch in pieces(batches):
        texts = batch.column("text").to_pylist()
        rows = carry + list(zip(batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), texts, sampler.of_texts(texts)))
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[0]]
        carry = rows[-1:]
        edited = [_edited(a[2], b[2]) for a, b in pairs]
        prints = sampler.of_texts(edited)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a[1] for a, _ in pairs], pa.int64()),
                pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([hexed(a[3]) for a, _ in pairs], pa.string()),
                pa.array([hexed(f) for f in prints], pa.string()),
                pa.array([likeness(a[3], f) for (a, _), f in zip(pairs, prints)], pa.float64()),
                pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text's fingerprint as hex; a row for each row. Null text counts as empty: an empty fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in pieces(batches):
            prints = sampler.of_texts(batch.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f.astype(">u2").tobytes().hex() for f in prints], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fingerprint string")


def compare_edits(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> the fingerprints of each text and of its edited text, and how near they are; a row for each row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones (or all) of the next document in
    descending doc_id; the first document follows the last. A single document follows itself. Null text counts as empty. Equal
    doc_ids follow each other in order of text, null ones come last.
    """
    modest_batches(docs.sparkSession)
    return _neighbours(docs).mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))
