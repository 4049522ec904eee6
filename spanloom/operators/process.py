"""What a session's acts did: causal graph, changesets, critical path, repetition, reverts, waste and efficiency.

Acts are rows (session_id, node_id, trace_id, action_type, detail, files, output, result_hash, cost, latency_ms), in order of
node_id within a session. Whatever a window can say is a window; what depends on the state of the files so far runs as a machine
over rows sorted by session and node, which holds the last writer of each file and the last twenty acts, not the session.
"""

from __future__ import annotations

import re
from collections import deque

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.sequences import _in_order

READ, WRITE, DELETE, BASH, SEARCH, THINK, META = "file_read", "file_write", "file_delete", "bash", "search", "think", "mcp_meta"
WRITES, INTENTS = (WRITE, DELETE), (THINK, SEARCH)
#: How many acts before it may have put out what an act names; how far up an act's intent may stand (fixed values).
LOOKBACK, HOPS = 20, 3
#: A pattern has so many acts at least and occurs so often in a row (fixed values).
LEAST_CYCLE, LEAST_REPEATS = 2, 3
#: A window of so many acts with so many reads, of as many files (fixed values).
THRASH_WINDOW, THRASH_READS = 5, 4
_TOKEN = re.compile(r"[\w./\-]{4,}")
_CODE = re.compile(r"[/._\-:]|\d")


def _names_code(token: str) -> bool:
    """Whether a token is more than a plain word: a mark, a digit, or capitals after its first letter beside small ones."""
    return bool(_CODE.search(token)) or any(c.isdigit() for c in token) or (any(c.isupper() for c in token[1:]) and any(c.islower() for c in token))


class _Causes:
    """Finds each act's parents; holds the last writer of each file and the last acts with their outputs."""

    COLUMNS = ["node_id", "action_type", "detail", "files", "output"]

    def __init__(self) -> None:
        self.writer: dict[str, int] = {}
        self.lengths: dict[int, int] = {}
        self.recent: deque[tuple[int, str]] = deque(maxlen=LOOKBACK)

    def parents(self, node: int, action: str, detail: str | None, files: list[str] | None, output: str | None) -> dict[int, str]:
        """parent -> why, the first reason that holds: file, command, output, order."""
        found: dict[int, str] = {}
        for f in files or ():
            if f in self.writer:
                found.setdefault(self.writer[f], "file")
        if action == BASH and detail:
            for n in self.lengths:  # any substring that is a written file's name
                for at in range(len(detail) - n + 1):
                    if (writer := self.writer.get(detail[at : at + n])) is not None:
                        found.setdefault(writer, "command")
        tokens = [t for t in dict.fromkeys(_TOKEN.findall(detail)) if _names_code(t)] if detail else []
        if tokens:
            for before, said in self.recent:
                if said and any(t in said for t in tokens):
                    found.setdefault(before, "output")
        if not found and self.recent:
            found[self.recent[-1][0]] = "order"
        if action in WRITES:
            for f in files or ():
                if f not in self.writer:
                    self.lengths[len(f)] = self.lengths.get(len(f), 0) + 1
                self.writer[f] = node
        self.recent.append((node, output or ""))
        return found

    def open(self) -> set[int]:
        """The acts that a later one can still have as a parent."""
        return {*self.writer.values(), *(n for n, _ in self.recent)}


class _Edges(_Causes):
    def feed(self, rows: list[tuple]) -> list[tuple]:
        return [(src, row[0], why) for row in rows for src, why in sorted(self.parents(*row).items())]

    def end(self) -> list[tuple]:
        return []


class _Longest(_Causes):
    """The costliest path; a path is a chain of (node, the chain before it), so what no open act leads to goes by itself."""

    #: After so many acts, the ways to acts that can't be parents any more are dropped.
    EVERY = 256

    def __init__(self) -> None:
        super().__init__()
        self.ways: dict[int, tuple[float, tuple]] = {}
        self.best: tuple[float, tuple] | None = None
        self.since = 0

    def feed(self, rows: list[tuple]) -> list[tuple]:
        for *row, latency in rows:
            most, before = 0.0, None
            for parent in sorted(self.parents(*row)):
                if self.ways[parent][0] > most:
                    most, before = self.ways[parent]
            self.ways[row[0]] = way = (most + (latency or 0.0), (row[0], before))
            if self.best is None or way[0] > self.best[0]:
                self.best = way
            self.since += 1
            if self.since == self.EVERY:
                keep = self.open()
                self.ways, self.since = {n: w for n, w in self.ways.items() if n in keep}, 0
        return []

    def end(self) -> list[tuple]:
        length, at = self.best
        path = []
        while at is not None:
            path.append(at[0])
            at = at[1]
        return [(length, path[::-1])]


class _Changesets(_Causes):
    """Writes with a common parent, or a common intent at most HOPS up, form a set; its number is its first write.

    A set is returned when nothing that a later write can have as parent or intent belongs to it; until then its numbers are held.
    """

    EVERY = 256

    def __init__(self) -> None:
        super().__init__()
        self.intents: dict[int, dict[int, int]] = {}  # act -> intents up to HOPS above it, with their distance
        self.acts: dict[int, bool] = {}  # act -> is an intent
        self.holder: dict[tuple[str, int], int] = {}  # parent or intent -> a write below it
        self.least: dict[int, int] = {}
        self.since = 0

    def _find(self, x: int) -> int:
        while self.least[x] != x:
            self.least[x] = x = self.least[self.least[x]]
        return x

    def feed(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for row in rows:
            node, action = row[:2]
            parents = self.parents(*row)
            above: dict[int, int] = {}
            for p in parents:
                if self.acts[p]:
                    above[p] = 1
                for i, far in self.intents[p].items():
                    if far < HOPS:
                        above[i] = min(far + 1, above.get(i, HOPS))
            self.intents[node], self.acts[node] = above, action in INTENTS
            if action in WRITES:
                self.least[node] = node
                for mark in [*(("parent", p) for p in parents), *(("intent", i) for i in above)]:
                    if mark in self.holder:
                        a, b = self._find(node), self._find(self.holder[mark])
                        self.least[max(a, b)] = min(a, b)
                    else:
                        self.holder[mark] = node
            self.since += 1
            if self.since == self.EVERY:
                out += self._close(self.open())
        return out

    def _close(self, keep: set[int]) -> list[tuple]:
        self.since = 0
        self.intents = {n: a for n, a in self.intents.items() if n in keep}
        self.acts = {n: a for n, a in self.acts.items() if n in keep}
        marks = {("parent", n) for n in keep} | {("intent", i) for a in self.intents.values() for i in a} | {("intent", n) for n, is_intent in self.acts.items() if is_intent}
        self.holder = {m: w for m, w in self.holder.items() if m in marks}
        alive = {self._find(w) for w in self.holder.values()}
        done = [(w, root) for w in sorted(self.least) if (root := self._find(w)) not in alive]
        for w, _ in done:
            del self.least[w]
        return done

    def end(self) -> list[tuple]:
        return self._close(set())


def causal_edges(acts: DataFrame) -> DataFrame:
    """acts -> session_id, src, dst, kind: each act's causes, one row a pair.

    file: the last writer of a file that the act touches; command: the last writer of a file that a shell command names, as any
    part of it; output: one of the twenty acts before it whose output holds a token of its detail that looks like code; order:
    the act before it, if there is no other cause. A pair has the first kind that holds. Null details, files and outputs are
    empty.
    """
    return _in_order(acts, ["session_id"], ["node_id"], _Causes.COLUMNS, _Edges, {"src": pa.int64(), "dst": pa.int64(), "kind": pa.string()})


def critical_path(acts: DataFrame) -> DataFrame:
    """acts -> session_id, length, path: the path through the causal graph with the greatest sum of latencies; ties: the first act."""
    fields = {"length": pa.float64(), "path": pa.list_(pa.int64())}
    return _in_order(acts, ["session_id"], ["node_id"], [*_Causes.COLUMNS, "latency_ms"], _Longest, fields)


def changesets(acts: DataFrame) -> DataFrame:
    """acts -> session_id, node_id, changeset, for each write and delete."""
    return _in_order(acts, ["session_id"], ["node_id"], _Causes.COLUMNS, _Changesets, {"node_id": pa.int64(), "changeset": pa.int64()})


# repetition


class _Prints:
    """Fingerprints of every stretch of a sequence of numbers, two residues modulo the prime 2^31 - 1."""

    PRIME = (1 << 31) - 1

    def __init__(self, keys: np.ndarray):
        self.parts = []
        for base in (1_103_515_245, 69_069 * 31_337):
            up, down = self._powers(base, len(keys) + 1), self._powers(pow(base, -1, self.PRIME), len(keys) + 1)
            sums = np.zeros(len(keys) + 1, np.int64)
            np.cumsum((keys + 1) % self.PRIME * up[:-1] % self.PRIME, out=sums[1:])
            self.parts.append((sums, down))

    def _powers(self, base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.int64)
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * pow(base, done, self.PRIME) % self.PRIME
            done += more
        return out

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        one, two = ((sums[starts + length] - sums[starts]) % self.PRIME * down[starts] % self.PRIME for sums, down in self.parts)
        return one << 31 | two


def repetitions(keys: np.ndarray, least: int = LEAST_CYCLE, repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, times) of every pattern that follows itself `repeats` times or more, where it first does; by length and start.

    A stretch that repeats with period p agrees with itself p further on for (repeats - 1) * p places, so two blocks of p that
    start at multiples of p are equal in it: n / p comparisons find all of one period, n log n those of all. A stretch with a
    shorter period is found once, and its multiples follow from it.
    """
    n = len(keys)
    if n < least * repeats:
        return []
    prints, runs = _Prints(keys), []  # (period, start, end) of stretches by their shortest period
    known: dict[int, tuple[list[int], list[int]]] = {}
    for p in range(1, n // repeats + 1):
        at = np.arange(0, n - 2 * p + 1, p)
        hits = at[prints.of(at, p) == prints.of(at + p, p)]
        for starts, ends in [known[q] for q in known if not p % q] if len(hits) else ():
            i = np.searchsorted(starts, hits, side="right") - 1
            hits = hits[(i < 0) | (hits + 2 * p > np.array(ends)[i])]
        seen = 0
        for i in hits.tolist():
            if i + p < seen or not np.array_equal(keys[i : i + p], keys[i + p : i + 2 * p]):
                continue
            a, b = i, i + 2 * p
            while a and keys[a - 1] == keys[a - 1 + p]:
                a -= 1
            while b < n and keys[b] == keys[b - p]:
                b += 1
            seen = b
            if b - a >= repeats * p:
                runs.append((p, a, b))
                starts, ends = known.setdefault(p, ([], []))
                starts.append(a)
                ends.append(b)
    first: dict[tuple[int, int], tuple[int, int]] = {}
    for p, a, b in runs:
        for length in range(p, (b - a) // repeats + 1, p):
            if length < least:
                continue
            starts = np.arange(a, min(a + p, b - repeats * length + 1))
            for start, mark in zip(starts.tolist(), prints.of(starts, length).tolist()):
                if (length, mark) not in first or start < first[length, mark][0]:
                    first[length, mark] = start, (b - start) // length
    return sorted(((start, length, times) for (length, _), (start, times) in first.items()), key=lambda r: (r[1], r[0]))


class _Repeats:
    """Numbers for the keys of a session, eight bytes an act; the patterns at its end."""

    def __init__(self, least: int, repeats: int):
        self.least, self.repeats, self.number, self.keys = least, repeats, {}, []

    def feed(self, rows: list[tuple]) -> list[tuple]:
        self.keys.append(np.array([self.number.setdefault(k, len(self.number)) for k, in rows], np.int64))
        return []

    def end(self) -> list[tuple]:
        keys, names = np.concatenate(self.keys), list(self.number)
        return [(start, length, times, "|".join(str(names[k]) for k in keys[start : start + min(length, 3)])) for start, length, times in repetitions(keys, self.least, self.repeats)]


def repetition_cycles(events: DataFrame, least: int = LEAST_CYCLE, repeats: int = LEAST_REPEATS) -> DataFrame:
    """events(session_id, at, key) -> session_id, start, length, times, head: patterns of `least` keys or more, `repeats` times in a row.

    Each different pattern of a session once, where it first occurs so often: rotations of a pattern and its multiples are patterns
    of their own. `start` counts from 0, `head` has the first three keys. Patterns of any length, sessions of any number of acts.
    """
    fields = {"start": pa.int64(), "length": pa.int64(), "times": pa.int64(), "head": pa.string()}
    return _in_order(events, ["session_id"], ["at"], ["key"], lambda: _Repeats(least, repeats), fields)


# waste and efficiency


def action_key() -> Column:
    """What an act is for cycles: files by path, commands and protocol calls by their first word, others by type."""
    word = F.regexp_extract(F.trim("detail"), r"^\S+", 0)
    named = F.when(F.col("action_type").isin(READ, WRITE, DELETE), F.coalesce("detail", F.lit(""))).when(F.col("action_type") == BASH, F.coalesce(F.nullif(word, F.lit("")), F.lit("bash"))).when(F.col("action_type") == META, F.coalesce(F.nullif(word, F.lit("")), F.lit("meta")))
    return F.concat("action_type", F.coalesce(F.concat(F.lit(":"), named), F.lit("")), F.lit("#"), F.coalesce("result_hash", F.lit("")))


def reverts(acts: DataFrame) -> DataFrame:
    """acts -> session_id, node_id, reverted_by: acts whose file later has the content again that it had before them.

    A file's states are its writes and deletes, and the read that comes before all of them. Between two neighbouring states of one
    content all states are reverted, by the last such later one; if that holds in several files, the one touched last first counts.
    """
    of_file = Window.partitionBy("session_id", "file")
    touched = acts.filter(F.col("action_type").isin(READ, *WRITES)).select("session_id", "node_id", "action_type", "result_hash", F.posexplode("files").alias("nth", "file"))
    placed = touched.withColumn("place", F.row_number().over(of_file.orderBy("node_id", "nth")))
    opened = F.first(F.struct("node_id", "nth")).over(of_file.orderBy("node_id", "nth"))
    states = placed.withColumn("opened", opened).filter((F.col("action_type") != READ) | (F.col("place") == 1))
    again = F.lead(F.struct("place", "node_id")).over(Window.partitionBy("session_id", "file", "result_hash").orderBy("place"))
    reach = F.max("again").over(of_file.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    found = states.withColumn("again", again).withColumn("reach", reach).filter(F.col("reach.place") > F.col("place"))
    return found.groupBy("session_id", "node_id").agg(F.max_by("reach.node_id", "opened").alias("reverted_by"))


def _numbered(acts: DataFrame) -> DataFrame:
    return acts.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("node_id")) - 1)


def judged(acts: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """acts -> session_id, node_id, seq (from 0), trace_id, action_type, detail, result_hash, cost, reverted_by, in_cycle, effective.

    Not effective are: reverted acts; repetitions of a cycle beyond its first round; protocol calls; reads of what an effective
    read has shown before. Cycles become steps up and down at their ends, and a running sum over the session says what they cover.
    """
    rows = _numbered(acts)
    cycles = repetition_cycles(rows.select("session_id", F.col("seq").alias("at"), action_key().alias("key"))) if cycles is None else cycles
    steps = F.explode(F.array(F.struct((F.col("start") + F.col("length")).alias("seq"), F.lit(1).alias("step")), F.struct((F.col("start") + F.col("length") * F.col("times")).alias("seq"), F.lit(-1).alias("step"))))
    steps = cycles.select("session_id", steps.alias("s")).groupBy("session_id", "s.seq").agg(F.sum("s.step").alias("step"))
    columns = ["session_id", "node_id", "seq", "trace_id", "action_type", "detail", "result_hash", "cost"]
    both = rows.select(*columns, F.lit(0).cast("long").alias("step")).unionByName(steps, allowMissingColumns=True)
    running = F.sum("step").over(Window.partitionBy("session_id").orderBy("seq", F.col("node_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    covered = both.withColumn("in_cycle", running > 0).filter("node_id is not null").drop("step")
    covered = covered.join(reverts(acts), ["session_id", "node_id"], "left")
    out = F.col("reverted_by").isNotNull() | F.col("in_cycle") | (F.col("action_type") == META)
    earlier = Window.partitionBy("session_id", "detail", "result_hash", "action_type", "out").orderBy("seq")
    shown = (F.col("action_type") == READ) & (F.row_number().over(earlier) > 1)
    return covered.withColumn("out", out).withColumn("effective", ~(F.col("out") | shown)).drop("out")


def waste_classes(acts: DataFrame) -> DataFrame:
    """acts -> session_id, category, first_node, last_node: reverted acts, repeated reads, the first thrashing window, loops."""
    rows = _numbered(acts)
    cycles = repetition_cycles(rows.select("session_id", F.col("seq").alias("at"), action_key().alias("key")))
    one = lambda df, category: df.select("session_id", F.lit(category).alias("category"), F.col("node_id").alias("first_node"), F.col("node_id").alias("last_node"))
    again = F.row_number().over(Window.partitionBy("session_id", "detail", "result_hash").orderBy("seq"))
    reads = rows.filter(F.col("action_type") == READ).withColumn("nth", again).filter("nth > 1")
    ahead = Window.partitionBy("session_id").orderBy("seq").rowsBetween(0, THRASH_WINDOW - 1)
    read = F.when(F.col("action_type") == READ, F.coalesce("detail", F.lit("")))
    windows = rows.select("session_id", "seq", "node_id", F.count(read).over(ahead).alias("reads"), F.size(F.collect_set(read).over(ahead)).alias("files"), F.count("*").over(ahead).alias("acts"), F.last("node_id").over(ahead).alias("last_node"))
    dense = windows.filter((F.col("acts") == THRASH_WINDOW) & (F.col("reads") >= THRASH_READS) & (F.col("files") >= THRASH_READS))
    dense = dense.groupBy("session_id").agg(F.min(F.struct("seq", "node_id", "last_node")).alias("w")).select("session_id", F.lit("context_thrashing").alias("category"), F.col("w.node_id").alias("first_node"), "w.last_node")
    ends = cycles.select("session_id", F.col("start").alias("a"), (F.col("start") + F.col("length") * F.col("times") - 1).alias("b"))
    place = rows.select("session_id", "seq", "node_id")
    loops = ends.join(place.withColumnsRenamed({"seq": "a", "node_id": "first_node"}), ["session_id", "a"]).join(place.withColumnsRenamed({"seq": "b", "node_id": "last_node"}), ["session_id", "b"])
    loops = loops.select("session_id", F.lit("repetition_loop").alias("category"), "first_node", "last_node")
    return one(reverts(acts), "revert_cycle").unionByName(one(reads, "redundant_read")).unionByName(dense).unionByName(loops)


def efficiency(acts: DataFrame) -> DataFrame:
    """acts -> session_id, acts, effective, path_efficiency, token_waste_rate (null where nothing costs anything)."""
    lost = F.sum(F.when(~F.col("effective"), F.col("cost")).otherwise(0.0))
    found = judged(acts).groupBy("session_id").agg(F.count("*").alias("acts"), F.count_if("effective").alias("effective"), F.sum("cost").alias("all"), lost.alias("lost"))
    return found.select("session_id", "acts", "effective", (F.col("effective") / F.col("acts")).alias("path_efficiency"), F.when(F.col("all") != 0, F.col("lost") / F.col("all")).alias("token_waste_rate"))


def dag_nodes(acts: DataFrame) -> DataFrame:
    """acts -> session_id, node_id, trace_id, action_type, detail (120 characters), status (reverted, waste, effective), reverted_by."""
    status = F.when(F.col("reverted_by").isNotNull(), "reverted").when(F.col("effective"), "effective").otherwise("waste")
    return judged(acts).select("session_id", "node_id", "trace_id", "action_type", F.substring(F.coalesce("detail", F.lit("")), 1, 120).alias("detail"), status.alias("status"), "reverted_by")


def dag_edges(acts: DataFrame) -> DataFrame:
    """acts -> session_id, src, dst, kind, type: cross_trace where both ends have a trace and not the same one, else causal."""
    trace = acts.select("session_id", "node_id", F.nullif("trace_id", F.lit("")).alias("trace"))
    ends = causal_edges(acts).join(trace.withColumnsRenamed({"node_id": "src", "trace": "a"}), ["session_id", "src"]).join(trace.withColumnsRenamed({"node_id": "dst", "trace": "b"}), ["session_id", "dst"])
    return ends.select("session_id", "src", "dst", "kind", F.when(F.col("a") != F.col("b"), "cross_trace").otherwise("causal").alias("type"))


def dag_stats(acts: DataFrame) -> DataFrame:
    """acts -> session_id, nodes, effective, reverted, waste, edges, roots (acts without a cause)."""
    nodes = dag_nodes(acts).groupBy("session_id").agg(F.count("*").alias("nodes"), *(F.count_if(F.col("status") == s).alias(s) for s in ("effective", "reverted", "waste")))
    edges = causal_edges(acts).groupBy("session_id").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("caused"))
    both = nodes.join(edges, "session_id", "left")
    return both.select("session_id", "nodes", "effective", "reverted", "waste", F.coalesce("edges", F.lit(0)).alias("edges"), (F.col("nodes") - F.coalesce("caused", F.lit(0))).alias("roots"))


def changeset_status(acts: DataFrame) -> DataFrame:
    """acts -> session_id, changeset, writes, status: full (all of its writes are reverted), partial or effective."""
    rows = changesets(acts).join(reverts(acts), ["session_id", "node_id"], "left").groupBy("session_id", "changeset").agg(F.count("*").alias("writes"), F.count("reverted_by").alias("gone"))
    return rows.select("session_id", "changeset", "writes", F.when(F.col("gone") == F.col("writes"), "full").when(F.col("gone") > 0, "partial").otherwise("effective").alias("status"))


# dependencies

#: Commands that install packages (a fixed value).
_INSTALL = r"(?i)(?:npm\s+install|npm\s+i|yarn\s+add|pip\s+install|pip3\s+install|pipenv\s+install|poetry\s+add|cargo\s+add|go\s+get)\s+(.+)"


class _Unused:
    """Packages come first, then texts; an automaton of the packages reads each text once."""

    def __init__(self) -> None:
        self.left: set[str] = set()
        self.automaton: ahocorasick.Automaton | None = None

    def feed(self, rows: list[tuple]) -> list[tuple]:
        for is_text, value in rows:
            if not is_text:
                self.left.add(value)
                continue
            if not self.left:
                continue
            if self.automaton is None or 2 * len(self.left) < len(self.automaton):
                self.automaton = ahocorasick.Automaton()
                for package in self.left:
                    self.automaton.add_word(package, package)
                self.automaton.make_automaton()
            self.left -= {package for _, package in self.automaton.iter(value)}
        return []

    def end(self) -> list[tuple]:
        return [(p,) for p in sorted(self.left)]


def installed_packages(acts: DataFrame) -> DataFrame:
    """acts -> session_id, package: names in install commands, without options and versions."""
    line = F.split(F.regexp_extract("detail", _INSTALL, 1), r"\s+")
    words = acts.filter((F.col("action_type") == BASH) & F.col("detail").rlike(_INSTALL)).select("session_id", F.explode(line).alias("word"))
    return words.filter(~F.col("word").startswith("-")).select("session_id", F.split("word", "[@=<>~!]")[0].alias("package")).filter("package <> ''").distinct()


def orphan_dependencies(acts: DataFrame) -> DataFrame:
    """acts -> session_id, package: installed packages that no written text or written path of the session contains."""
    packages = installed_packages(acts)
    sessions = packages.select("session_id").distinct()
    texts = acts.filter(F.col("action_type") == WRITE).join(sessions, "session_id", "left_semi").select("session_id", F.explode(F.array("output", "detail")).alias("value")).filter("value <> ''")
    rows = packages.select("session_id", F.lit(False).alias("is_text"), F.col("package").alias("value")).unionByName(texts.select("session_id", F.lit(True).alias("is_text"), "value"))
    return _in_order(rows, ["session_id"], ["is_text"], ["is_text", "value"], _Unused, {"package": pa.string()})


# metrics of a session

#: What shows that a shell command failed, that it verifies, that it may change files unseen (fixed values).
_FAILED = (
    "Failed to compile", "SyntaxError", "TypeError", "ReferenceError", "ImportError", "ModuleNotFoundError", "NameError", "AttributeError", "KeyError", "ValueError", "RuntimeError", "Module not found", "Cannot find module",
    "npm ERR!", "ENOENT", "EACCES", "EPERM", "command not found", "No such file or directory", "Permission denied", r"Traceback \(most recent call last\)", "FAILED", "panic:", r"error\[E\d+\]", "BUILD FAILED", r"exit code [1-9]\d*",
    "returned non-zero exit status",
)
_VERIFIES = (
    "pytest", "jest", "mocha", "vitest", r"npm\s+test", r"npm\s+run", r"yarn\s+test", r"cargo\s+test", r"go\s+test", r"make\s+test", r"python\s+-m\s+pytest", r"node\s", r"npx\s", "tsc", "eslint", "flake8", "mypy", r"npm\s+start",
    r"npm\s+run\s+dev", r"npm\s+run\s+build", r"npm\s+create", r"cargo\s+build", r"cargo\s+check", r"go\s+build", r"make\b", r"cmake\b", r"Start-Process\b", r"Invoke-Expression\b", r"& npm\b", r"& node\b", r"python\s", r"python3\s", r"ruby\s",
    r"java\s", r"javac\s", r"gcc\s", r"g\+\+\s",
)
_MUTATES = (
    r"sed\s+-i", r"tee\s", r"echo\s.*>>?", r"cat\s.*>\s", r"mv\s", r"cp\s", r"git\s+checkout", r"git\s+reset", r"git\s+restore", r"chmod\s", r"chown\s", r"rm\s", r"mkdir\s", r"touch\s", r"patch\s", r"curl\s.*-o", r"wget\s",
    r"python[23]?\s+-c\s.*(?:open|write)\s*\(", r"perl\s+-[ip]e?\s", r"awk\s.*>\s", r"ruby\s+-e\s.*(?:File\.|IO\.|open)", r"node\s+-e\s.*(?:fs\.|writeFile)", r"go\s+run\s", r">\s*\S+", r"\|\s*tee\s", r"install\s", r"jq\s.*>\s", r"ffmpeg\s",
    r"sox\s", r"convert\s", r"tar\s.*-[xf]", r"unzip\s", r"gunzip\s", r"go\s+mod\s+tidy", r"cargo\s+build", r"npm\s+install", r"pip\s+install", r"make\b", r"cmake\b", r"ninja\b", r"dd\s",
)
#: Acts after an error in which a write resolves it (a fixed value).
RESOLVED_WITHIN = 5
#: When a session is warned about: metric, whether too low or too high, bound (fixed values).
WARNINGS = (
    ("path_efficiency_ratio", "low", 0.5), ("token_waste_rate", "high", 0.4), ("first_pass_success_rate", "low", 0.5), ("write_without_verify_ratio", "high", 0.6), ("file_churn_rate", "high", 0.4),
    ("repetition_cycles", "least", 3), ("redundant_reads", "least", 3),
)


def _any(patterns: tuple[str, ...], column: str) -> Column:
    return F.coalesce(F.col(column).rlike("|".join(patterns)), F.lit(False))


def shell_mutation_warnings(acts: DataFrame) -> DataFrame:
    """acts -> session_id, node_id, command: shell commands that may change files without a write, cut to 120 characters."""
    return acts.filter((F.col("action_type") == BASH) & _any(_MUTATES, "detail")).select("session_id", "node_id", F.substring("detail", 1, 120).alias("command"))


def _shares(total: Column) -> list[Column]:
    """Aggregates of judged acts: numbers, efficiency, waste and first-pass success (null without cost or writes)."""
    write = F.col("action_type").isin(*WRITES)
    lost = F.sum(F.when(~F.col("effective"), F.col("cost")).otherwise(0.0))
    return [
        total.alias("total_events"), F.count_if("effective").alias("effective_events"), (F.count_if("effective") / total).alias("path_efficiency_ratio"),
        F.when(F.sum("cost") > 0, lost / F.sum("cost")).alias("token_waste_rate"), F.when(F.count_if(write) > 0, F.count_if(write & F.col("reverted_by").isNull()) / F.count_if(write)).alias("first_pass_success_rate"),
    ]


def per_trace_metrics(acts: DataFrame) -> DataFrame:
    """acts -> session_id, trace_id, and the shares of the trace's acts; effects are judged in the whole session. No row without a trace."""
    return judged(acts).filter("trace_id <> ''").groupBy("session_id", "trace_id").agg(*_shares(F.count("*")))


def session_profile(acts: DataFrame) -> DataFrame:
    """acts -> one row a session with its shares, reverted acts, cycles, errors, unverified batches of writes, churn, orphans.

    A batch of writes ends at a shell command; it is verified if a command before the next write builds, tests or runs. Churn is
    the share of written files that were written with two contents or more. Duplicate calls are acts that aren't thoughts or protocol
    calls and have the type and detail of an earlier one.
    """
    rows = _numbered(acts)
    cycles = repetition_cycles(rows.select("session_id", F.col("seq").alias("at"), action_key().alias("key")))
    own = Window.partitionBy("session_id").orderBy("seq")
    error = (F.col("action_type") == BASH) & _any(_FAILED, "output")
    write, bash = F.col("action_type") == WRITE, F.col("action_type") == BASH
    fixed = F.max(write.cast("int")).over(own.rowsBetween(1, RESOLVED_WITHIN))
    marked = rows.select("session_id", "seq", error.alias("error"), F.coalesce(fixed, F.lit(0)).alias("fixed"), F.count_if(write).over(own).alias("after"), bash.alias("bash"), (bash & _any(_VERIFIES, "detail")).alias("verify"))
    errors = marked.groupBy("session_id").agg(F.count_if("error").alias("build_error_count"), F.count_if(F.col("error") & (F.col("fixed") == 0)).alias("unresolved_error_count"))
    stretches = marked.filter("after > 0").groupBy("session_id", "after").agg(F.max("bash").alias("bash"), F.max("verify").alias("verify"))
    ends = F.col("bash") | (F.col("after") == F.max("after").over(Window.partitionBy("session_id")))
    batches = stretches.withColumn("ends", ends).groupBy("session_id").agg((F.count_if(F.col("ends") & ~F.col("verify")) / F.count_if("ends")).alias("write_without_verify_ratio"))
    files = acts.filter(write).select("session_id", F.explode("files").alias("file"), "result_hash").groupBy("session_id", "file").agg(F.countDistinct("result_hash").alias("contents"))
    churn = files.groupBy("session_id").agg((F.count_if(F.col("contents") >= 2) / F.count("*")).alias("file_churn_rate"))
    reads = Window.partitionBy("session_id", "detail", "result_hash").orderBy("seq")
    again = rows.filter(F.col("action_type") == READ).withColumn("nth", F.row_number().over(reads)).groupBy("session_id").agg(F.count_if(F.col("nth") > 1).alias("redundant_reads"))
    shares = judged(acts, cycles).groupBy("session_id").agg(*_shares(F.count("*")), F.count("reverted_by").alias("backtrack_depth"))
    orphans = orphan_dependencies(acts).groupBy("session_id").agg(F.count("*").alias("orphan_dependency_count"))
    calls = acts.filter(~F.col("action_type").isin(THINK, META)).groupBy("session_id", "action_type", "detail").agg(F.count("*").alias("n"))
    same = calls.groupBy("session_id").agg(F.sum(F.col("n") - 1).alias("duplicate_tool_call_count"))
    out = shares
    for more in (same, cycles.groupBy("session_id").agg(F.count("*").alias("repetition_cycles")), errors, batches, churn, again, orphans):
        out = out.join(more, "session_id", "left")
    zero = ["duplicate_tool_call_count", "repetition_cycles", "build_error_count", "unresolved_error_count", "write_without_verify_ratio", "file_churn_rate", "redundant_reads", "orphan_dependency_count"]
    return out.fillna(0, zero)


def efficiency_warnings(profile: DataFrame) -> DataFrame:
    """session_profile -> session_id, metric, value: the metrics beyond their bounds; null ones warn of nothing."""
    beyond = {"low": lambda c, b: c < b, "high": lambda c, b: c > b, "least": lambda c, b: c >= b}
    told = F.array(*(F.when(beyond[how](F.col(name), bound), F.struct(F.lit(name).alias("metric"), F.round(F.col(name).cast("double"), 4).alias("value"))) for name, how, bound in WARNINGS))
    return profile.select("session_id", F.explode(F.array_compact(told)).alias("w")).select("session_id", "w.*")
