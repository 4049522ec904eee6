"""The pipeline against a brute-force one, and its stages on odd tables."""

import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import common
from tests.llm.helpers import DOCS, components, sha
from tests.llm.test_texts import brute_chunks, brute_languages, corpus

pipeline = pytest.importorskip("corpus_pipeline")


def brute_mix(rows, share=1.5):
    """doc_id -> copies, of rows (doc_id, source, text)."""
    size = {i: len((t or "").split()) for i, _, t in rows}
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    room = {s: 2 * sum(size[i] for i, x, _ in rows if x == s) for s in sources}
    weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, {}, share * sum(size.values())
    open_ = list(sources)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit >= room[s]]
        for s in full or open_:
            target[s] = room[s] if full else weight[s] * unit
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    copies = {}
    for s in sources:
        at, goal, words = 0, math.floor(target[s] + 0.5), room[s] // 2
        for i in sorted((i for i, x, _ in rows if x == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            taken = sum(max(min(lo + size[i], goal) - lo, 0) for lo in (at, at + words))
            copies[i] = math.floor(taken / size[i] + 0.5) if size[i] else 1
            at += size[i]
    return copies


def test_run_is_the_brute_force_pipeline(spark, tmp_path):
    draw = random.Random(11)
    other = [(1000 + i, " ".join("".join(draw.choices("uvwxyz", k=draw.randint(1, 6))) for _ in range(draw.randint(5, 60)))) for i in range(20)]
    strange = [(2000, "ßß ß ßßß"), (2001, "ß")]  # nothing in these is known, and they teach nothing
    rows = [(i, t, None if i >= 2000 else "bb" if i >= 1000 else "aa", (f"s{i % 3}", None)[i % 7 == 0], len(t or "")) for i, t in [*(r[:2] for r in corpus()), *other, *strange]]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = pipeline.run(spark, str(tmp_path)).collect()

    told = brute_languages([r[1] for r in rows], [(r[1], r[2]) for r in rows])
    assert all(abs(score - pipeline.LEAST_SCORE) > 1e-4 for _, score in told)  # no close call
    kept = [r for r, (lang, score) in zip(rows, told) if lang != "und" and score >= pipeline.LEAST_SCORE]
    assert len(kept) < sum(1 for r in rows if r[1] and any(map(str.isalpha, r[1])))  # the threshold decides something
    least = components([r[:2] for r in kept], 5, 80, 100)
    kept = [r for r in kept if least[r[0]][1] == r[0]]
    stripped = brute_chunks([r[:2] for r in kept])
    kept = [(i, s, stripped[i]) for i, t, _, s, _ in kept if stripped[i] or not t]
    copies = brute_mix(kept)
    assert Counter(r["decoded_sha256"] for r in found) == Counter(sha(t) for i, _, t in kept for _ in range(copies[i]))
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == sha(",".join(map(str, r["ids"]))) for r in found)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", "en", None, 16), (2, None, None, None, None), (3, "delta", "de", "s", 5)], DOCS).withColumn("score", F.lit(1))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == pipeline.COLUMNS
        assert stage(spark, docs.limit(0), "").count() == 0


def test_tasks_forget_what_other_operators_remember(spark):
    from spanloom.llm import bpe

    texts = spark.createDataFrame([(i, "alpha beta") for i in range(8)], "doc_id long, text string").coalesce(1)

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.load(bpe._located(None)).memory)] * batch.num_rows, pa.int64())], ["n"])

    assert bpe.encode_documents(texts).count() == 8
    words = lambda operator: {r["n"] for r in texts.mapInArrow(common.lean(seen, operator), "n long").collect()}
    assert words("jaccard") == {0}  # a worker may be new to it, but none still has the words


def test_lean_tasks_give_memory_back():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    pins = []

    def work(batches):
        for batch in batches:
            held = [np.ones(60_000, np.uint8) for _ in range(2_000)]
            pins.append(np.ones(60_000, np.uint8))  # on top of the heap, which else shrinks by itself
            del held
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    before = resident()
    assert list(common.lean(work)(iter([batch]))) == [batch]
    assert resident() - before < 60_000_000


def test_checkpoints_leave_no_shuffle_files(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p for p in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in p}
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    dealt = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    kept = [common.checkpointed(dealt), common.written(dealt)]
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before
    assert [k.count() for k in kept] == [7, 7] and dealt.count() == 7
    assert spark.conf.get(key) == "false"  # as it was
