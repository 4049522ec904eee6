"""Conversation repair, line dedup and spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from spanloom.llm import conversations, line_dedup, spelling
from spanloom.llm.conversations import BLANK, CUT, DUPLICATE, FINE, Repair
from tests.llm.helpers import sha

TURNS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\v\f\r"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# conversations


def every_edit(kinds):
    """All audits of at most two insertions before each row, with their costs and roles: (cost, audit)."""
    best = None
    gaps = [[""], ["", "u", "a", "ua", "au"]][1]
    for inserted in itertools.product(gaps, repeat=len(kinds) + 1):
        for edits in itertools.product(("D", "K", "u", "a"), repeat=len(kinds)):
            cost, audit, roles = 0, "", ""
            for extra, edit, (initial, fault) in zip(inserted, edits, kinds):
                cost, audit, roles = cost + 3 * len(extra), audit + "I" * len(extra), roles + extra
                if edit == "D":
                    cost, audit = cost + 4, audit + "D"
                elif fault in (BLANK, DUPLICATE):
                    break
                else:
                    cost += (0 if edit == "K" else 3) + (3 if fault == CUT else 0)
                    audit, roles = audit + ("K" if edit == "K" else "R"), roles + (initial if edit == "K" else edit)
            else:
                cost, audit, roles = cost + 3 * len(inserted[-1]), audit + "I" * len(inserted[-1]), roles + inserted[-1]
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def searched(kinds):
    out = []
    search = Repair(lambda letter, times, role, text: out.append((letter * times, role, text)))
    for initial, fault in kinds:
        search.delete() if fault in (BLANK, DUPLICATE) else search.row({"u": "user", "a": "assistant", "s": "system", "x": "x"}[initial], "t", fault == CUT)
    return search.finish(), "".join(o[0] for o in out)


def test_every_short_conversation_gets_its_cheapest_and_least_edits():
    for n in range(3):
        for kinds in itertools.product(itertools.product("uasx", (FINE, BLANK, CUT)), repeat=n):
            assert searched(kinds) == every_edit(kinds), kinds
    draw = random.Random(3)
    for _ in range(12):
        kinds = [(draw.choice("uasx"), draw.choice((FINE, DUPLICATE, CUT))) for _ in range(3)]
        assert searched(kinds) == every_edit(kinds), kinds


def plain_search(kinds):
    """Whole strings for each state, insertions anywhere."""

    def with_insertions(best):
        best = dict(best)
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                to = {"": "u", "s": "u", "a": "u", "u": "a"}[state]
                best[to] = min(best.get(to, (10**9, "")), (cost + 3, audit + "I"))
        return best

    best = {"": (0, "")}
    for initial, fault in kinds:
        new = {}
        for state, (cost, audit) in with_insertions(best).items():
            ways = [(state, cost + 4, "D")]
            if fault not in (BLANK, DUPLICATE):
                extra = 3 if fault == CUT else 0
                to = "a" if state == "u" else "u"
                ways += [(to, cost + extra + 3 * (initial != to), "K" if initial == to else "R")]
                ways += [("s", cost + extra, "K")] if initial == "s" and state == "" else []
            for to, price, letter in ways:
                new[to] = min(new.get(to, (10**9, "")), (price, audit + letter))
        best = new
    best = with_insertions(best)
    return min(best[s] for s in ("", "a") if s in best)


def test_long_conversations_and_what_stays_open():
    draw = random.Random(4)
    for _ in range(2000):
        kinds = [(draw.choice("uuaasx"), draw.choice((FINE, FINE, FINE, BLANK, CUT))) for _ in range(draw.randrange(14))]
        assert searched(kinds) == plain_search(kinds), kinds
    kinds = [("u", FINE)] * 41  # the first edits follow from the length: nothing is certain before the end
    assert searched(kinds) == plain_search(kinds) and searched(kinds[1:]) == plain_search(kinds[1:])
    search = Repair(lambda *edit: None)
    most = 0
    for i in range(5000):
        search.row(("user", "assistant")[i % 2], "t", False)
        open_nodes, stack = 0, [search.root]
        while stack:
            open_nodes += 1
            stack += stack.pop().below
        most = max(most, open_nodes)
    assert most < 8
    for _ in range(5000):
        search.delete()
    assert len(search.root.below) < 4  # a run of deletions is one node a survivor


def brute_repair(table, damage):
    out = {}
    for conv in {r[0] for r in table}:
        turns = []
        for c, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            how = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            if how == 0:
                continue
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            turns += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.strip(WHITE)
            faults.append(BLANK if not body else DUPLICATE if (role, text) in seen else FINE if body[-1] in ".!?" else CUT)
            seen.add((role, text))
        cost, audit = plain_search([(role[:1], f) for (_, role, _), f in zip(turns, faults)])
        kept, at, led = [], 0, 0
        for letter in audit:
            if letter != "I":
                _, role, text = turns[at]
                at += 1
            if letter == "D":
                continue
            led += not kept and letter == "K" and role[:1] == "s"
            name = role if letter == "K" else ("user", "assistant")[(len(kept) - led) % 2]
            kept.append(f"{name}:{'' if letter == 'I' else text}")
        known = {t[0] for t in turns} - {None}
        initials = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal, cost, audit, sha("\n".join(kept)))
    return out


def conversation_rows(draw):
    table = []
    for conv in (*range(40), None):
        for turn in range(draw.randrange(1, 12)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", None, "", "ux"])
            table.append((conv, draw.choice([turn, turn, turn + 3, None]), role, draw.choice(["Yes.", "No!  ", "half a", "", None, " \t", "Why?\n", "é."])))
    return table


def test_conversations_with_nulls_ties_and_copies(spark):
    table = conversation_rows(random.Random(5)) * 2
    frame = spark.createDataFrame(table, TURNS).selectExpr("*", "1 as there", "role as `_text`", "turn as fault")
    assert {r[0]: r[1:] for r in rows(conversations.repair_conversations(conversations.damaged(frame), there="there"))} == brute_repair(table, True)
    whole = conversations.repair_conversations(spark.createDataFrame(table, TURNS))
    wanted = brute_repair(table, False)
    assert {r[0]: r[1:] for r in rows(whole)} == wanted
    lines = defaultdict(list)
    for conv, turn, edit, role, text in rows(conversations.repaired_turns(spark.createDataFrame(table, TURNS)), "conv_id", "turn"):
        assert turn == len(lines[conv]) and edit in "KRI"
        lines[conv].append(f"{role}:{text}")
    assert {c: sha("\n".join(lines[c])) for c in wanted} == {c: w[-1] for c, w in wanted.items()}
    assert rows(conversations.repair_conversations(spark.createDataFrame([], TURNS))) == []


def test_a_conversation_whose_rows_are_all_dropped_stays(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = conversations.repair_conversations(conversations.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], TURNS)), there="there")
    assert rows(found) == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]


# lines

DOCS = "doc_id long, text string"


def key(line):
    return line.encode().lower().strip()


def brute_lines(table, least):
    docs = defaultdict(set)
    for i, text in table:
        for line in (text or "").split("\n"):
            docs[key(line)].add((i, text) if i is None else i)
    out = []
    for i, text in table:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(docs[key(x)]) < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows(draw, n=120):
    common = ["Share this", "share THIS \t", "\x0bterms of use", "ÀB", "àb", "x"]
    table = [(i, "\n".join(draw.choice([*common, "", " ", f"own {draw.randrange(200)}"]) for _ in range(draw.randrange(9)))) for i in range(n)]
    return [*table, *table[:7], (None, "x\nmine"), (None, "x"), (900, None), (901, ""), (902, "x\r\nx\n\n" * 300), (903, "\n".join(f"line {i}" for i in range(5000)) + "\nx")]


@pytest.mark.parametrize("least", [2, 10, 1000])
def test_frequent_lines_go_everywhere(spark, least):
    table = line_rows(random.Random(least))
    frame = spark.createDataFrame(table, DOCS).repartition(5).selectExpr("*", "text as keep", "doc_id as id", "1 as twin")
    found = line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame, least_docs=least, keep_first=False))
    assert sorted(rows(found), key=repr) == sorted(brute_lines(table, least), key=repr)
    assert rows(line_dedup.apply_bitmaps(*[spark.createDataFrame([], DOCS)] * 1, line_dedup.keep_bitmaps(spark.createDataFrame([], DOCS)))) == []


def test_the_first_of_equal_lines_stays(spark):
    table = [(3, "b\na\nc"), (1, "a\nA \nd"), (2, "c\nb\n\n"), (None, "d\ne")]
    frame = spark.createDataFrame(table, DOCS)
    kept = {r[0]: r[1] for r in rows(line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame, least_docs=1)))}
    assert kept == {1: "a\nd", 2: "c\nb\n\n", 3: "", None: "e"}
    across = {r[0]: r[1] for r in rows(line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame, least_docs=2)))}
    assert across == {1: "a\nd", 2: "c\nb\n\n", 3: "", None: "e"}
    longer = {r[0]: r[1] for r in rows(line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame, least_docs=1, least_points=2)))}
    assert longer == dict(table)


@pytest.mark.parametrize("keep_first", [False, True])
def test_runs_over_partition_ends(spark, keep_first):
    """A line in most documents fills several range partitions and batches; the streams' results don't depend on where they end."""
    table = [(i, f"hot\nhot\nrare {i % 40}\npair {i // 2}") for i in range(300)]
    frame = spark.createDataFrame(table, DOCS)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = {r[0]: r[1] for r in rows(line_dedup.apply_bitmaps(frame, line_dedup.keep_bitmaps(frame, least_docs=7, keep_first=keep_first)))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, text in table:
        first, of_forty = (["hot"] if i == 0 else []), ([f"rare {i}"] if i < 40 else [])
        many = sum(j % 40 == i % 40 for j in range(300)) >= 7
        assert found[i].split("\n") == [*(first if keep_first else []), *(of_forty if keep_first or not many else []), f"pair {i // 2}"]


# spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        out[w] = [form, n, len(near), -near[0][0] if form else None]
    for w, o in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        o.insert(1, root)
    return {w: tuple(o) for w, o in out.items()}


def word_counts(draw):
    counts = {}
    for _ in range(60):
        base = "".join(draw.choice("abéÿ") for _ in range(draw.randrange(5, 12)))
        for _ in range(8):
            word, at = base, draw.randrange(len(base))
            word = draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice("abé") + word[at:], word[:at] + "z" + word[at + 1 :], word])
            base = draw.choice([base, word])
            counts[word] = draw.choice([1, 5, 6, 25, 30, 125, 700])
    return counts | {"a": 5, "b": 40, "ab": 3, "": 7, "é": 1, "abc": 2, "abd": 90, "abcd": 11, "bc": 6, "a" * 300: 9, "a" * 299: 50, "a" * 150 + "b" + "a" * 149: 8, "abab" * 3: 4, "baba" * 3: 4}


def test_all_near_words_and_roots(spark):
    counts = word_counts(random.Random(6))
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").selectExpr("*", "word as form", "1 as key")
    found = {r[0]: r[1:] for r in rows(spelling.variants(frame))}
    wanted = brute_variants(counts)
    assert found == wanted and sum(w[3] for w in wanted.values()) > 200 and any(w[1] not in (v, w[0]) for v, w in wanted.items())
    assert rows(spelling.variants(frame.limit(0))) == [] and rows(spelling.variants(spark.createDataFrame([("single", 3)], "word string, n long"))) == [("single", None, "single", 3, 0, None)]
    with pytest.raises(ValueError):
        spelling.variants(frame, ratio=1)


def test_pivots_are_the_least_disjoint_pair():
    draw = random.Random(7)
    for _ in range(500):
        grams = [(at, draw.randrange(9)) for at in sorted(draw.sample(range(12), draw.randrange(3, 8)))]
        least = min(x[1] + y[1] for x, y in itertools.combinations(grams, 2) if y[0] - x[0] >= 2)
        chosen = spelling.pivots(grams)
        assert len(chosen) == 2 and chosen[1] - chosen[0] >= 2 and sum(dict(grams)[c] for c in chosen) == least


def test_words_of_texts(spark):
    table = [(i, draw) for i, draw in enumerate(["Straßen-Café ÉTÉDUSUD étédusud x_abcdef abcdefg", None, "", "abcdefg ABCDEFG1abcdefg", "naïveté" * 40])] * 3
    table += [(None, "abcdefg"), (199, " ".join(["wörterbuch"] * 4))]
    wanted = Counter()
    for i, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            wanted[run] += 1
    wanted = {w: n for w, n in wanted.items() if len(w) >= 6 and n >= 2}
    frame = spark.createDataFrame(table, DOCS).selectExpr("*", "text as word", "1 as n")
    assert dict(rows(spelling.vocabulary(frame, least_count=2, damage=3))) == wanted
    assert rows(spelling.vocabulary(frame.limit(0))) == []
