"""Language ID by word-first backoff.

A word known from training scores its log frequency in each language. A word that isn't backs off to character n-grams of the
word with its edges marked, from long to short: the longest length with any known n-gram decides. The language with the greatest
sum over all words is predicted. Counts of words and n-grams come from Spark aggregations over the training rows, all of which
go into the model: a table of the (gram, language) pairs that occur, whose size the number of training rows bounds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import lean, modest_batches, pieces, table

#: About so many labelled rows are counted, chosen by a hash of their text; lengths of the character n-grams, in the order they
#: are tried (0 stands for whole words); scores (words x languages) that a task remembers.
TRAINING_ROWS, LENGTHS, MEMORY = 20_000, (4, 3, 2, 1), 1 << 20
LETTERS = r"\p{L}+"


def _words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


_LETTERS = regex.compile(LETTERS)


def _hashes(grams: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each batch: counts are combined before they are shuffled."""
    for batch in pieces(batches):
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.update((lang, w) for w in _words(text))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, rows: int | None = TRAINING_ROWS) -> DataFrame:
    """docs(text, lang) -> lang, length, gram, logp: all grams of about `rows` labelled rows (None: of all); length 0: whole words.

    Rows without text or lang teach nothing. logp is the log of (n + 0.5) / (N + 0.5 V), n being the gram's count, N and V the
    sum and number of the grams of that language and length.
    """
    modest_batches(docs.sparkSession)
    labelled = docs.filter("text is not null and lang is not null").select("lang", "text")
    if rows is not None:
        share = min(1.0, rows / max(labelled.count(), 1))
        labelled = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    words = labelled.mapInArrow(lean(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))

    def grams_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("length"), F.substring(marked, i, n).alias("gram")))

    grams = F.flatten(F.array(*map(grams_of, LENGTHS)))
    pieces_ = words.select("lang", "n", F.explode(grams).alias("g")).select("lang", "g.length", "g.gram", "n").filter("length(gram) = length")
    counts = pieces_.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n")).unionByName(words.select("lang", F.lit(0).alias("length"), F.col("word").alias("gram"), "n"))
    totals = counts.groupBy("lang", "length").agg((F.sum("n") + 0.5 * F.count("*")).alias("total"))  # five rows a language
    return counts.join(F.broadcast(totals), ["lang", "length"]).select("lang", "length", "gram", F.log((F.col("n") + 0.5) / F.col("total")).alias("logp"))


class Model:
    """Log frequencies of grams; of each gram only the languages that have it. Others get the least seen of its length, less one.

    Grams are known by a 64-bit hash, so the model is a few arrays: what a task holds of it is about 16 bytes a gram and language.
    """

    def __init__(self, grams: pa.Table):
        lang = grams.column("lang").combine_chunks().dictionary_encode()
        self.langs = sorted(lang.dictionary.to_pylist())
        at = np.array([self.langs.index(x) for x in lang.dictionary.to_pylist()], np.int32)
        codes = at[np.asarray(lang.indices)] if len(lang) else np.zeros(0, np.int32)
        lengths, logp = np.asarray(grams.column("length")), np.asarray(grams.column("logp"))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]] = {}
        for length in (0, *LENGTHS):
            own = np.flatnonzero(lengths == length)
            if len(own):
                keys, gram = np.unique(_hashes(grams.column("gram").take(pa.array(own)).to_pylist()), return_inverse=True)
                order = np.argsort(gram, kind="stable")
                self.tables[length] = keys, np.r_[0, np.cumsum(np.bincount(gram))], codes[own][order], logp[own][order].astype(np.float32), float(logp[own].min()) - 1.0
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)

    def _found(self, length: int, grams: list[str]) -> np.ndarray:
        """The places of the grams in their table, -1 where it lacks them."""
        if length not in self.tables or not grams:
            return np.full(len(grams), -1)
        keys, hashes = self.tables[length][0], _hashes(grams)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, at, -1)

    def _sums(self, length: int, at: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
        """For each word (a row) the sum over its grams of their scores in each language."""
        _, bounds, langs, logp, least = self.tables[length]
        out = np.repeat(least * np.bincount(word, minlength=words)[:, None], len(self.langs), axis=1)
        n = bounds[at + 1] - bounds[at]
        entry = np.repeat(bounds[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(out, (np.repeat(word, n), langs[entry]), logp[entry] - least)
        return out

    def learn(self, words: list[str]) -> None:
        """Scores words that are new: by themselves or by the longest n-grams that are known; nothing known counts as 0."""
        out = np.zeros((len(words), len(self.langs)))
        at = self._found(0, words)
        known = np.flatnonzero(at >= 0)
        if len(known):
            out[known] = self._sums(0, at[known], np.arange(len(known)), len(known))
        rest = np.flatnonzero(at < 0)
        for n in LENGTHS:
            marked = [f"<{words[i]}>" for i in rest]
            counts = np.array([max(len(m) - n + 1, 0) for m in marked], np.int64)
            at = self._found(n, [m[i : i + n] for m in marked for i in range(len(m) - n + 1)])
            word = np.repeat(np.arange(len(rest)), counts)[at >= 0]
            if len(word):
                hits = np.bincount(word, minlength=len(rest))
                sums, has = self._sums(n, at[at >= 0], word, len(rest)), hits > 0
                out[rest[has]] = sums[has] / hits[has, None]  # the mean, so that a long unseen word counts as one word
                rest = rest[~has]
        self.ids.update(zip(words, range(len(self.ids), len(self.ids) + len(words))))
        self.scores = np.concatenate([self.scores, out.astype(np.float32)])

    def predict(self, words: list[str]) -> tuple[str, float]:
        """The language and the odds, as a probability, that a typical word gives it against the next best one."""
        if not words:
            return "und", 0.0
        mean = self.scores[np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))].mean(axis=0, dtype=np.float64)
        best = int(mean.argmax())  # a tie goes to the first lang by name
        rest = np.delete(mean, best)
        return self.langs[best], float(1.0 / (1.0 + np.exp(max(rest.max() - mean[best], -700.0)))) if len(rest) else 1.0

    def predictions(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [_words(t) if t and self.langs else [] for t in texts]
        if len(self.ids) * len(self.langs) > MEMORY:
            self._forget()
        if new := list(set(chain.from_iterable(split)).difference(self.ids)):
            self.learn(new)
        return [self.predict(words) for words in split]


def identify(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score and the other columns; a row for each row, from the text alone.

    lang_pred is `und` with score 0 where text is null or has no letter, or where nothing was learned. Otherwise the score goes
    from 0.5 (no better than the next language) to 1, whatever the length of the text; with one language it is 1. Columns of
    docs named lang_pred or score are replaced. The model alone goes to the driver and the tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Model(model.select("lang", "length", "gram", "logp").toArrow()))
    rest = [f for f in docs.schema.fields if f.name not in ("doc_id", "lang_pred", "score")]
    names = [f.name for f in rest]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in pieces(batches):
            found = known.predictions(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), *map(batch.column, names)], ["doc_id", "lang_pred", "score", *names])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.select("doc_id", *(F.col(f"`{n}`") for n in names)).mapInArrow(lean(work), schema)


def is_held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~is_held_out("doc_id")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
