"""The operators on documents against brute force, odd rows included."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from spanloom.llm import bpe, components, fingerprints, jaccard_join, language_id, substring_dedup, suffix_dedup
from tests.llm.helpers import DOCS, components as brute_components, generalised_jaccard, sha, shingle_set, without_repeats


def corpus(seed=1, n=60):
    """Invented texts with copies, near copies, shared passages, null, empty and long ones."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdeéñ", k=draw.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(draw.choices(vocabulary, k=k))
    passage, texts = text(60), [text(draw.randint(0, 120)) for _ in range(n)]
    for i in range(0, n, 5):
        w = texts[i].split(" ")
        w[len(w) // 2 : len(w) // 2 + 1] = ["changed"]
        texts.append(" ".join(w))
    texts += [texts[3], texts[3].upper(), texts[4] + " " + passage, passage + " " + texts[6], text(30) + " " + passage + "\n" + text(9), None, "", " \t\n", "one", "one two", "ONE two", text(5000), "x" * 950, "ab" * 400, "🎉é" * 90]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components(docs, n, num):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs, n, num, 100).collect()}
    assert found == brute_components([r[:2] for r in corpus()], n, num, 100)


def test_jaccard_of_odd_tables(spark, docs):
    assert jaccard_join.jaccard_classes(docs.limit(0), 3, 90, 100).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "z"), (3, "A B C D"), (9, None), (9, None)]
    found = sorted((tuple(r)[:3] for r in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()), key=str)
    assert found == sorted([(5, 2, 3), (5, 2, 3), (None, 2, 3), (None, 1, None), (3, 2, 3), (9, 0, 9), (9, 0, 9)], key=str)


@pytest.mark.parametrize("most", [2048, 4])
def test_jaccard_links_are_all_counted(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "BUCKET_SETS", most)
    draw = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = [r[1] for r in corpus()]
    for _ in range(30):  # a group of near copies, not all of which link
        w = list(base)
        for i in draw.sample(range(60), draw.randint(0, 3)):
            w[i] = f"x{draw.randint(0, 2)}"
        texts.append(" ".join(w))
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    sets = [frozenset(shingle_set(t, 2)) for t in texts]
    for num in (90, 80):
        links = [sum(100 * len(s & t) >= num * len(s | t) for t in set(sets) - {s, frozenset()}) if s else 0 for s in sets]
        assert max(links) > 5
        assert {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_classes(table, 2, num, 100).collect()} == dict(enumerate(links))


def test_jaccard_links_through_sets_without_ids(spark):
    words = [f"w{i}" for i in range(40)]
    left, right = ["x", "y", *words[2:]], [*words[:-2], "u", "v"]  # both like the middle one, not like each other
    rows = [(4, " ".join(left)), (None, " ".join(words)), (None, " ".join(words)), (2, " ".join(right)), (2, "another text under this id"), (7, "another text under this id")]
    found = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90, 100).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(4, 40, 2, 1), (None, 40, 2, 2), (None, 40, 2, 2), (2, 40, 2, 1), (2, 5, 2, 0), (7, 5, 2, 0)], key=str)


def test_jaccard_lists_leave_out_large_sets_that_differ():
    draw, limit, base = np.random.default_rng(5), jaccard_join.Threshold(80, 100), 800
    passage = draw.integers(0, 2**63, 46, np.uint64)
    sets = [np.r_[passage, draw.integers(0, 2**63, base, np.uint64)] for _ in range(40)]
    sets += [np.r_[draw.integers(0, 2**63, 40, np.uint64), sets[3][40:]], draw.integers(0, 2**63, 20, np.uint64)]
    sets += [np.r_[passage, draw.integers(0, 2**63, 4000, np.uint64)] for _ in range(4)]
    value, row, size = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.array([len(x) for x in sets])
    n = len(sets)
    bits = jaccard_join._bitmaps(value, row, n).T.copy()
    columns = {"token": np.repeat([1, 2], n), "i": np.zeros(2 * n, int), "j": np.zeros(2 * n, int), "bucket": np.zeros(2 * n, int), "node": np.tile(np.arange(n), 2), "group": np.tile(np.arange(n), 2)}
    columns |= {"meta": np.tile((size << 8) | (1 << 4) | 1, 2), "weight": np.repeat([3, 1], n)} | {name: np.tile(b, 2) for name, b in zip(jaccard_join._BITS, bits)}
    arrays = {k: pa.array(v) for k, v in columns.items()} | {name: pa.concat_arrays([w, w]) for (name, *_), w in zip(jaccard_join.WIDER, jaccard_join._wider(value, row, size))}
    batch = pa.RecordBatch.from_pydict(arrays)
    for step in (1, 7, n, 2 * n):
        found = [tuple(r.values()) for b in jaccard_join._list_pairs(limit)(iter([batch.slice(at, step) for at in range(0, 2 * n, step)])) for r in b.to_pylist()]
        assert {r[:2] for r in found} == {(3, 40)} and sum(r[3] for r in found) == 4


def test_jaccard_compares_lists_of_the_same_sets_once(spark, monkeypatch):
    kind = "token long, node long, meta long"
    one = (20 << 8) | (1 << 4) | 1
    shared = spark.createDataFrame([(t, n, one) for t in (1, 2, 3) for n in (10, 11, 11, 12)] + [(4, n, one) for n in (10, 10, 11, 12)] + [(5, n, one) for n in (10, 11)], kind)
    nodes = spark.createDataFrame([(n, *[0] * len(jaccard_join._BITS), None, None) for n in (10, 11, 12)], "node long, " + ", ".join(f"{b} long" for b in jaccard_join._BITS) + ", wide array<long>, widest array<long>")
    known = spark.createDataFrame([], "node long, group long")

    def listed(limit):
        def work(batches):
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("weight"), pa.array([0] * n), pa.array([1] * n)], ["a", "b", "k", "matches"])

        return work

    monkeypatch.setattr(jaccard_join, "_list_pairs", listed)
    found = jaccard_join._candidates(shared, known, nodes, jaccard_join.Threshold(80, 100)).collect()
    assert {tuple(r) for r in found} == {(1, 3), (4, 1), (5, 1)}


def test_near_copies_leave_one_of_each_group(docs):
    kept = {r["doc_id"] for r in jaccard_join.without_near_copies(docs).collect()}
    assert kept == {i for i, (_, least) in brute_components([r[:2] for r in corpus()], 5, 80, 100).items() if i == least}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3), (60, 59)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 61)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [4096, 1])
def test_repeats_go_exactly(docs, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_STRETCHES", most)
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert found == without_repeats([r[:2] for r in corpus()])


def test_repeats_of_odd_tables(spark, docs):
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    draw = random.Random(6)
    text = lambda k: "".join(draw.choices("abc é", k=k))
    passage = text(150)
    rows = [(4, text(50) + passage), (None, passage + text(9)), (2, passage), (3, ""), (5, None), (9, text(500))]
    rows += [rows[0], rows[-1]]
    found = suffix_dedup.remove_repeats(spark.createDataFrame([(*r, 1, "clash", 5) for r in rows], "doc_id long, text string, id int, n_spans string, wanted int"))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    data = lambda t: (t or "").encode()
    # a null doc_id comes last; rows of one doc_id are one document, of which equal starts are no repeat of each other
    order = lambda i: 2**63 if i is None else i
    first = {}
    for i, t in rows:
        for p in range(len(data(t)) - 99):
            w = data(t)[p : p + 100]
            first[w] = min(first.get(w, (order(i), p)), (order(i), p))
    wanted = []
    for i, t in rows:
        gone = bytearray(len(data(t)))
        for p in range(len(gone) - 99):
            if first[data(t)[p : p + 100]] < (order(i), p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(data(t), gone) if not g)
        wanted.append((i, len(gone), sum(gone), sum(1 for q, g in enumerate(gone) if g and (q == 0 or not gone[q - 1])), sha(kept)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)


def test_merged_transforms_find_equal_windows():
    draw = random.Random(2)
    base = bytes(draw.choices(b"ab", k=700))
    texts = [base[i : i + draw.randint(100, 300)] for i in range(0, 400, 20)]
    position, run = suffix_dedup.equal_windows([texts[:7], texts[7:9], texts[9:]])
    joined, at = b"\xff".join(texts) + b"\xff", {}
    for p, r in zip(position.tolist(), run.tolist()):
        at.setdefault(r, []).append(joined[p : p + 100])
    whole = [w for p in range(len(joined)) if b"\xff" not in (w := joined[p : p + 100]) and len(w) == 100]
    assert all(len(set(ws)) == 1 for ws in at.values()) and sorted(len(ws) for ws in at.values() if b"\xff" not in ws[0] and len(ws[0]) == 100) == sorted(whole.count(w) for w in set(whole))


def test_stretches_are_cut_to_what_can_be_shared():
    draw = random.Random(8)
    gram, noise = bytes(draw.choices(b"abcdef", k=32)), lambda k: bytes(draw.choices(b"abcdef", k=k))
    left, right = noise(40), noise(34)
    whole = left + gram + right  # 106 bytes: 7 windows in common
    texts = [noise(20) + whole + noise(30), noise(5) + whole + noise(34), noise(68) + gram + right + noise(34)]  # the third shares one side only
    block = [(7, i, 1000, t.index(gram), t) for i, t in enumerate(texts)]
    found = suffix_dedup._comparable(block)
    assert [r[1] for r in found] == [0, 1]
    for _, i, start, offset, raw in found:
        assert whole in raw and len(raw) < len(whole) + 2 * suffix_dedup.GRID
        assert raw == texts[i][start - 1000 : start - 1000 + len(raw)] and raw[offset : offset + 32] == gram


def brute_cuts(data):
    """Chunk bounds byte by byte: the gear hash of the last 16 bytes exceeds those of the 24 before it and none of the 24 after is greater."""
    gear = [int(g) for g in substring_dedup._GEAR]
    h = [sum(gear[data[i - j]] << j for j in range(min(16, i + 1))) % 2**32 for i in range(len(data))]
    ends = [i + 1 for i in range(len(data)) if h[i] > max(h[max(i - 24, 0) : i], default=0) and h[i] >= max(h[i + 1 : i + 25], default=0)]
    bounds, out = sorted({0, len(data), *ends}), []
    for a, b in zip(bounds, bounds[1:]):
        out += range(a, b, 2048)
    out = [next(j for j in range(i, len(data) + 1) if j == len(data) or data[j] & 0xC0 != 0x80) for i in out] + [len(data)]
    return sorted(set(out))


def brute_chunks(rows, least_bytes=75):
    seen, out = {}, {}
    bounds = {i: brute_cuts((t or "").encode()) for i, t in rows}
    for i, t in sorted(rows):
        data = (t or "").encode()
        for a, b in zip(bounds[i], bounds[i][1:]):
            seen.setdefault(data[a:b], (i, a))
    for i, t in rows:
        data, runs = (t or "").encode(), []
        for a, b in zip(bounds[i], bounds[i][1:]):
            if seen[data[a:b]] != (i, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        runs = [r for r in runs if r[1] - r[0] >= least_bytes]
        ends = [0, *(x for r in runs for x in r), len(data)]
        out[i] = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])).decode()
    return out


@pytest.mark.parametrize("text", [" " * 5000, "é" * 3000, "ab" * 400, "x" * 40, "-" * 100_000])
def test_runs_of_one_byte_are_cut_seldom(text):
    bounds = substring_dedup.cuts(np.frombuffer(text.encode(), np.uint8)).tolist()
    assert len(bounds) <= len(text.encode()) / 2048 + 4 and bounds == (brute_cuts(text.encode()) if len(text) < 10_000 else bounds)


def test_every_repeated_chunk_goes_if_asked(spark):
    rows = [(i, t) for i, t, *_ in corpus()][:40] + [(100, "x" * 200 + "y" * 6000)]
    named = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, again int, id int")
    found = substring_dedup.dedup_substrings(named, least_bytes=0)
    assert found.columns[:3] == ["doc_id", "again", "id"]
    assert {r["doc_id"]: r["text"] for r in found.collect()} == brute_chunks(rows, 0)


def test_repeated_chunks_go(docs):
    found = substring_dedup.dedup_substrings(docs)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows, wanted, texts = found.collect(), brute_chunks([r[:2] for r in corpus()]), {r[0]: r[1] or "" for r in corpus()}
    assert {r["doc_id"]: r["text"] for r in rows} == wanted
    assert all(r["kept_sha256"] == sha(r["text"]) and r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["n_removed"] == r["n_bytes"] - len(r["text"].encode()) for r in rows)
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_a_shifted_passage_is_caught():
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 9)))
    passage = " ".join(word() for _ in range(55))
    rows = [(i, " ".join(word() for _ in range(draw.randint(0, 200))) + " " + passage + " " + " ".join(word() for _ in range(40))) for i in range(30)]
    kept = brute_chunks(rows)
    assert kept[0] == rows[0][1] and all(passage not in kept[i] for i in range(1, 30))


def test_languages_are_told_on_held_out_rows(spark):
    draw = random.Random(3)
    letters = {"aa": "abcde", "bb": "efgha", "cc": "xyzé"}
    rows = [(i, " ".join("".join(draw.choices(letters[lang], k=draw.randint(2, 6))) for _ in range(draw.randint(3, 30))), lang) for i in range(300) for lang in [draw.choice(sorted(letters))]]
    rows += [(1000, None, "aa"), (1001, "12 !?", "bb"), (1002, "", None), (None, "xyz", None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    held = language_id.is_held_out("doc_id")
    model = language_id.train(docs.filter(~held))
    found = language_id.identify(docs.select("doc_id", "text"), model).collect()
    lang = {i: x for i, _, x in rows}
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1000, 1001, 1002)) for r in found)
    ids = {r["doc_id"] for r in docs.filter(held).collect()}
    told = [r["lang_pred"] == lang[r["doc_id"]] for r in found if r["doc_id"] in ids and r["doc_id"] < 1000]
    assert sum(told) >= 0.95 * len(told)
    nothing = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs.select("doc_id", "text"), nothing).collect()} == {"und"}


def brute_languages(rows, labelled):
    """Word-first backoff by its definition: (lang, score) of each text."""
    find = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    counts = {}
    for text, lang in labelled:
        for w in find(text) if lang is not None else ():
            marked = f"<{w}>"
            for length, gram in [(0, w)] + [(n, marked[i : i + n]) for n in (4, 3, 2, 1) for i in range(len(marked) - n + 1)]:
                of = counts.setdefault((lang, length), Counter())
                of[gram] += 1
    langs = sorted({k[0] for k in counts})
    logp = {k: {g: math.log((n + 0.5) / (sum(c.values()) + 0.5 * len(c))) for g, n in c.items()} for k, c in counts.items()}
    least = {n: min(v for (_, m), c in logp.items() if m == n for v in c.values()) - 1 for n in {k[1] for k in logp}}

    def word(w):
        marked = f"<{w}>"
        for length, grams in [(0, [w])] + [(n, [marked[i : i + n] for i in range(len(marked) - n + 1)]) for n in (4, 3, 2, 1)]:
            known = [g for g in grams if any(g in logp.get((x, length), ()) for x in langs)]
            if known:
                return [sum(logp.get((x, length), {}).get(g, least[length]) for g in known) / len(known) for x in langs]
        return [0.0] * len(langs)

    out = []
    for text in rows:
        words = find(text)
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        mean = [sum(x) / len(words) for x in zip(*map(word, words))]
        best = max(range(len(langs)), key=lambda i: (mean[i], -i))
        rest = [m for i, m in enumerate(mean) if i != best]
        out.append((langs[best], 1 / (1 + math.exp(max(rest) - mean[best])) if rest else 1.0))
    return out


def test_languages_by_brute_force(spark):
    draw = random.Random(8)
    letters = {"aa": "abcdefé", "bb": "efghab", "cc": "xyzéa"}
    text = lambda lang, n: " ".join("".join(draw.choices(letters[lang], k=draw.randint(1, 7))) for _ in range(n))
    labelled = [(text(lang, draw.randint(0, 40)), lang) for lang in letters for _ in range(25)] + [("ab AB", None), (None, "aa"), ("", "bb")]
    rows = [text(lang, draw.randint(0, 20)) for lang in letters for _ in range(30)] + [None, "", "12 -", "ÉÉ éé", "ß", "ab " * 4000]
    model = language_id.train(spark.createDataFrame(labelled, "text string, lang string"), rows=None)
    docs = spark.createDataFrame([(i, t, 7, "clash") for i, t in enumerate(rows)], "doc_id long, text string, score int, lang_pred string")
    found = language_id.identify(docs, model)
    assert found.columns == ["doc_id", "lang_pred", "score", "text"]
    for r, (lang, score) in zip(found.orderBy("doc_id").collect(), brute_languages(rows, labelled), strict=True):
        assert r["score"] == pytest.approx(score, abs=1e-4) and (r["lang_pred"] == lang or abs(score - 0.5) < 1e-4)


def test_fingerprints_estimate_likeness(docs):
    rows = sorted(((i, t or "") for i, t, *_ in corpus()), reverse=True)
    found = {r["doc_id"]: r for r in fingerprints.compare_edits(docs).collect()}
    assert len(found) == len(rows)
    errors = []
    for k, (i, text) in enumerate(rows):
        following, half, r = rows[(k + 1) % len(rows)][1], len(text) // 2, found[i]
        edited = text[: len(text) - half] + following[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        errors += [r["near_edited"] - generalised_jaccard(text, edited), r["near_next"] - generalised_jaccard(text, following)]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.3
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()}
    assert prints == {i: r["fingerprint"] for i, r in found.items()}
    texts = dict(rows)
    assert all((prints[a] == prints[b]) for a in prints for b in prints if texts[a] == texts[b])


def test_neighbours_of_odd_tables(spark, docs):
    assert fingerprints.compare_edits(docs.limit(0)).count() == 0
    one = fingerprints.compare_edits(docs.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    rows = [(2, "bb"), (2, "aaaa"), (None, "nn"), (7, "cccc"), (7, "cccc")]
    found = fingerprints.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    chain = ["cccc", "cccc", "aaaa", "bb", "nn"]
    wanted = sorted(sha(t[: len(t) - len(t) // 2] + n[: len(t) // 2]) for t, n in zip(chain, chain[1:] + chain[:1]))
    assert sorted(r["edited_sha256"] for r in found) == wanted


ODD = ["", "<|endoftext|>", "a<|endoftext|> b<|endo", "don't  \n\n x 　y 12³½ ٣ 你好 🎉🎉 \x00\x1f​ " + "é" * 300, "a" * 3000 + " " * 777 + "\r\n\t x", "ǅ́ I'LL we'll", "  lead", "trail  "]


def test_bpe_is_the_librarys(spark, docs):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t, *_ in corpus()] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "twin"), (3, "twin")]
    found = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), keep_ids=True).collect()
    wanted = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), ids))
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_bpe_forgets_and_goes_on(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    whole, small = bpe.Bpe(public.path(bpe.VOCABULARY)), bpe.Bpe(public.path(bpe.VOCABULARY))
    texts = [t or "" for _, t, *_ in corpus()] + ODD
    expected = whole.encode(texts)
    monkeypatch.setattr(bpe, "MOST_WORDS", 20)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 50)
    assert [small.encode([t])[0] for t in texts] == expected
    assert [small.decode(x) for x in expected] == texts


def test_bpe_remembers_words_in_little_memory():
    public = pytest.importorskip("public_tokenizers")
    encoder, words = bpe.Bpe(public.path(bpe.VOCABULARY)), [f"x{i * 7919:x}q" for i in range(30_000)]
    encoder.encode(words[:100])
    tracemalloc.start()
    encoder.encode([" ".join(words[100:])])
    held = tracemalloc.get_traced_memory()[0] / len(encoder.memory)
    tracemalloc.stop()
    assert held * bpe.MOST_WORDS < 100_000_000
    before = encoder.memory
    assert encoder.encode(["a<|endoftext|>"])[0][1] == encoder.special["<|endoftext|>"] and encoder.memory is before
