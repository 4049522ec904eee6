"""The causal graph, cycles, reverts and waste of sessions, against hand-made sessions and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import process
from spanloom.operators.process import BASH, DELETE, META, READ, SEARCH, THINK, WRITE

SCHEMA = "session_id string, node_id long, trace_id string, action_type string, detail string, files array<string>, output string, result_hash string, cost double, latency_ms double"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def acts(spark, *lines, session="s"):
    """Lines are (type, detail, files, output, hash); cost 1 and latency 10 each."""
    return spark.createDataFrame([(session, i, "t", *line, 1.0, 10.0) for i, line in enumerate(lines, 1)], SCHEMA)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def brute_repetitions(keys, least=2, repeats=3):
    seen, out = set(), []
    for length in range(least, len(keys) // repeats + 1):
        for start in range(len(keys) - length * repeats + 1):
            pattern, times = tuple(keys[start : start + length]), 1
            while tuple(keys[start + length * times : start + length * (times + 1)]) == pattern:
                times += 1
            if times >= repeats and pattern not in seen:
                seen.add(pattern)
                out.append((start, length, times))
    return out


def test_all_repetitions_of_random_sequences():
    draw = random.Random(1)
    for _ in range(600):
        letters = draw.choice([1, 2, 3, 4])
        keys = [draw.randrange(letters) for _ in range(draw.randrange(40))]
        unit = [draw.randrange(letters) for _ in range(draw.randrange(1, 9))]
        at = draw.randrange(len(keys) + 1)
        keys = keys[:at] + unit * draw.randrange(1, 7) + keys[at:] + unit * draw.choice([0, 3])
        assert process.repetitions(np.array(keys, np.int64)) == brute_repetitions(keys)
    assert len(process.repetitions(np.zeros(100_000, np.int64))) == 33_332  # each length is one pattern


def test_cycles_of_sessions(spark, small_batches):
    draw = random.Random(2)
    sessions = {"long": [f"k{i}" for i in range(25)] * 3, "turned": list("ababab") + ["x"] + list("bababa"), "none": list("abc"), None: list("qqqqqq")}
    sessions |= {f"r{i}": [k for _ in range(6) for k in draw.choices("xyz", k=draw.randint(1, 5)) * draw.choice([1, 3])] for i in range(8)}
    table = [(s, i, k) for s, keys in sessions.items() for i, k in enumerate(keys)]
    found = process.repetition_cycles(spark.createDataFrame(draw.sample(table, len(table)), "session_id string, at long, key string"))
    wanted = {(s, *r, "|".join(keys[r[0] : r[0] + min(r[1], 3)])) for s, keys in sessions.items() for r in brute_repetitions(keys)}
    assert set(rows(found)) == wanted and ("long", 0, 25, 3, "k0|k1|k2") in wanted and {("turned", 0, 2, 3, "a|b"), ("turned", 7, 2, 3, "b|a")} < wanted
    empty = spark.createDataFrame([], "session_id string, at long, key string")
    assert rows(process.repetition_cycles(empty)) == []


GRAPH = [
    (THINK, "plan", [], "", "t"),  # 1
    (WRITE, "/a.py", ["/a.py"], "x", "h1"),  # 2: after 1
    (READ, "/b.py", ["/b.py"], "uses utils.load_all", "h1"),  # 3: after 2
    (WRITE, "/c.py", ["/c.py", "/a.py"], "y", "h2"),  # 4: file, from 2
    (BASH, "cat /a.pyc", None, "FAILED at line42", "r"),  # 5: the last writer of /a.py, as a part of a word, is 4
    (SEARCH, "where is utils.load_all", [], None, "s"),  # 6: output of 3
    (SEARCH, "Error line", [], "", "s"),  # 7: plain words: the act before
    (BASH, "sed line42 /c.py", [], "", "r"),  # 8: command from 4, output of 5
    (None, None, None, None, None),  # 9: the act before
]


def test_an_act_has_all_its_causes(spark, small_batches):
    assert rows(process.causal_edges(acts(spark, *GRAPH)), "dst", "src") == [
        ("s", 1, 2, "order"), ("s", 2, 3, "order"), ("s", 2, 4, "file"), ("s", 4, 5, "command"), ("s", 3, 6, "output"), ("s", 6, 7, "order"), ("s", 4, 8, "command"), ("s", 5, 8, "output"), ("s", 8, 9, "order"),
    ]
    far = [(READ, "/b", [], "holds sym_1", "h")] + [(THINK, "x", [], "", "h")] * 20 + [(SEARCH, "sym_1", [], "", "h")]
    assert rows(process.causal_edges(acts(spark, *far)).filter("kind = 'output'")) == []  # twenty-one acts before
    assert rows(process.causal_edges(acts(spark, *far[:1], *far[2:])).filter("kind = 'output'")) == [("s", 1, 21, "output")]


def test_critical_path(spark, small_batches):
    slow = acts(spark, *GRAPH).withColumn("latency_ms", F.when(F.col("node_id") == 3, 100.0).otherwise(F.col("latency_ms")))
    assert rows(process.critical_path(slow)) == [("s", 10.0 + 10 + 100 + 10 + 10, [1, 2, 3, 6, 7])]
    assert rows(process.critical_path(slow.withColumn("latency_ms", F.lit(None).cast("double")))) == [("s", 0.0, [1])]


def brute_changesets(kinds, edges):
    parents = {}
    for src, dst in edges:
        parents.setdefault(dst, set()).add(src)
    marks = {}
    for w in (n for n, k in kinds.items() if k in (WRITE, DELETE)):
        level, own = {w}, {("p", p) for p in parents.get(w, ())}
        for _ in range(3):
            level = {p for n in level for p in parents.get(n, ())}
            own |= {("i", n) for n in level if kinds[n] in (THINK, SEARCH)}
        marks[w] = own
    name = {w: w for w in marks}
    for _ in marks:
        for a in marks:
            for b in marks:
                if marks[a] & marks[b]:
                    name[a] = name[b] = min(name[a], name[b])
    return name


@pytest.mark.parametrize("every", [1, 7, 1000])
def test_changesets_of_random_sessions(spark, small_batches, monkeypatch, every):
    monkeypatch.setattr(process._Changesets, "EVERY", every)
    draw = random.Random(every)
    lines = []
    for _ in range(90):
        kind, f = draw.choice([READ, WRITE, WRITE, DELETE, BASH, THINK, SEARCH]), f"/f{draw.randrange(9)}.py"
        lines.append((kind, f if draw.random() < 0.5 else "words", [f] if kind in (READ, WRITE, DELETE) else [], draw.choice(["", "", f, "sym_" + str(draw.randrange(5))]), "h"))
    table = acts(spark, *lines)
    edges = [(r[1], r[2]) for r in rows(process.causal_edges(table))]
    wanted = brute_changesets({i: line[0] for i, line in enumerate(lines, 1)}, edges)
    machine = process._Changesets()  # in this process, where the patch holds
    feed = [(i, *line[:4]) for i, line in enumerate(lines, 1)]
    assert dict(machine.feed(feed) + machine.end()) == wanted and 1 < len(set(wanted.values())) < len(wanted)
    assert {r[1]: r[2] for r in rows(process.changesets(table))} == wanted


def test_long_sessions_leave_little_behind():
    longest, sets = process._Longest(), process._Changesets()
    for i in range(20_000):
        row = (i, (WRITE, READ, THINK, BASH)[i % 4], f"/f{i % 50}.py", [f"/f{i % 50}.py"] if i % 4 < 2 else [], f"out_{i}")
        longest.feed([(*row, 1.0)])
        sets.feed([row])
    assert len(longest.ways) < 500 and len(sets.intents) < 500 and len(sets.holder) < 2000


def test_reverts_waste_and_efficiency(spark):
    loop = [(SEARCH, "find x", [], "", "s"), (BASH, "make test", [], "", "r")] * 3
    lines = [
        (READ, "/a", ["/a"], "", "h0"),  # 1: the first state of /a
        (WRITE, "/a", ["/a"], "", "h1"),  # 2: reverted by 5
        (WRITE, "/a", ["/a", "/b"], "", "h2"),  # 3: reverted by 5
        (READ, "/a", ["/a"], "", "h2"),  # 4: no state
        (WRITE, "/a", ["/a"], "", "h0"),  # 5
        (READ, "/a", ["/a"], "", "h0"),  # 6: as 1
        (META, "tools/list", [], "", ""),  # 7
        *loop,  # 8 to 13; 10 to 13 repeat 8 and 9
        *((READ, f"/m{i}", [f"/m{i}"], "", "m") for i in range(5)),  # 14 to 18
    ]
    table = acts(spark, *lines)
    assert rows(process.reverts(table), "node_id") == [("s", 2, 5), ("s", 3, 5)]
    assert [r[1] for r in rows(process.judged(table).filter("effective").select("session_id", "node_id"), "node_id")] == [1, 4, 5, 8, 9, 14, 15, 16, 17, 18]
    assert rows(process.waste_classes(table), "category", "first_node") == [
        ("s", "context_thrashing", 13, 17), ("s", "redundant_read", 6, 6), ("s", "repetition_loop", 8, 13), ("s", "revert_cycle", 2, 2), ("s", "revert_cycle", 3, 3),
    ]
    [(_, n, effective, share, waste)] = rows(process.efficiency(table))
    assert (n, effective, share, waste) == (18, 10, 10 / 18, 8 / 18)
    assert rows(process.efficiency(table.withColumn("cost", F.lit(0.0))).select("token_waste_rate")) == [(None,)]
    assert {s: n for s, n in rows(process.dag_nodes(table).groupBy("status").count())} == {"effective": 10, "reverted": 2, "waste": 6}
    assert rows(process.dag_stats(table).drop("edges")) == [("s", 18, 10, 2, 6, 1)]
    assert [r[1:] for r in rows(process.changeset_status(table), "changeset")] == [(2, 1, "full"), (3, 1, "full"), (5, 1, "effective")]


def test_cross_trace_edges(spark):
    table = acts(spark, (THINK, "a", [], "", ""), (THINK, "b", [], "", ""), (THINK, "c", [], "", "")).withColumn("trace_id", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("")), F.col("node_id").cast("int")))
    assert rows(process.dag_edges(table), "dst") == [("s", 1, 2, "order", "cross_trace"), ("s", 2, 3, "order", "causal")]


def test_installed_packages_that_nothing_uses(spark):
    lines = [
        (BASH, "cd x && NPM install left-pad@1.3.0 --save-dev lodash", [], "", ""), (BASH, "pip install 'odd' requests>=2.0 numpy", [], "", ""), (BASH, "ls", [], "", ""),
        (WRITE, "/use_lodash_here.js", [], "import requests", ""), (READ, "/numpy", [], "numpy", ""), (WRITE, None, None, None, None),
    ]
    other = acts(spark, (BASH, "cargo add lodash", [], "", ""), session="t")
    found = process.orphan_dependencies(acts(spark, *lines).unionByName(other))
    assert rows(found, "session_id", "package") == [("s", "'odd'"), ("s", "left-pad"), ("s", "numpy"), ("t", "lodash")]


def test_profile_of_a_session(spark):
    lines = [
        (WRITE, "/a", ["/a"], "", "h1"),  # 1
        (BASH, "pytest -q", [], "FAILED a", "r"),  # 2: verifies 1; no write in the next five acts
        *((THINK, "x", [], "", "t"),) * 5,  # 3 to 7; no cycle, since a pattern has two acts at least: 4 and 5 are one of length 1
        (WRITE, "/a", ["/a"], "", "h2"),  # 8
        (READ, "/a", ["/a"], "", "h2"),  # 9
        (BASH, "ls", [], "KeyError", "r"),  # 10: ends the batch of 8, unverified; resolved by 11
        (WRITE, "/b", ["/b"], "", "h1"),  # 11: the last batch, unverified
        (READ, "/a", ["/a"], "", "h2"),  # 12
        (READ, "/a", ["/a"], "", "h2"),  # 13
        (READ, "/a", ["/a"], "", "h2"),  # 14
        (BASH, "cat x > y", [], None, "r"),  # 15
    ]
    table = acts(spark, *lines).withColumn("trace_id", F.when(F.col("node_id") < 9, "t1").when(F.col("node_id") < 15, "t2"))
    [row] = process.session_profile(table).collect()
    assert (row["total_events"], row["build_error_count"], row["unresolved_error_count"], row["redundant_reads"], row["orphan_dependency_count"]) == (15, 2, 1, 3, 0)
    assert (row["write_without_verify_ratio"], row["file_churn_rate"], row["first_pass_success_rate"], row["backtrack_depth"], row["repetition_cycles"]) == (2 / 3, 0.5, 1.0, 0, 0)
    assert row["duplicate_tool_call_count"] == 1 + 3 and row["effective_events"] == 12 and row["token_waste_rate"] == 3 / 15
    found = process.efficiency_warnings(process.session_profile(table))
    assert rows(found, "metric") == [("s", "file_churn_rate", 0.5), ("s", "redundant_reads", 3.0), ("s", "write_without_verify_ratio", 0.6667)]
    assert [r[:5] for r in rows(process.per_trace_metrics(table), "trace_id")] == [("s", "t1", 8, 8, 1.0), ("s", "t2", 6, 3, 0.5)]
    assert rows(process.shell_mutation_warnings(table)) == [("s", 15, "cat x > y")]
    calm = process.session_profile(acts(spark, (THINK, "x", [], "", "")).withColumn("cost", F.lit(0.0)))
    assert [r for r in calm.collect()[0]][1:] == [1, 1, 1.0, None, None, 0, 0, 0, 0, 0, 0.0, 0.0, 0, 0]
