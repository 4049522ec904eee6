"""Conversation structure repair: a Viterbi search whose survivors' histories are emitted as soon as they share an ancestor.

The cheapest edits that make a conversation's roles read (s?(ua)+)? come from four states: nothing yet, after system, after user,
after assistant. Each state keeps one survivor, a node of a tree of back-pointers that counts its branches; a node without
branches goes. Once all survivors stand below one node, what lies above it is certain: it is emitted (audit letter, repaired
text into the running digest) and dropped. Ties are decided by the survivors' whole letters from their common root on; as no
survivor's letters begin another's, their order stays as it is whatever follows, and is carried along. A run of deletions that
every survivor must make is one node. A state that another one beats whatever follows dies. What stays open is held: mostly a
few rows, but all rows of a run in one role, since whether it is even or odd decides its first edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import modest_batches, table

#: Costs of a new role, a deletion, an insertion, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAULTS = FINE, BLANK, DUPLICATE, CUT = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}


@dataclass(slots=True, eq=False)
class Node:
    """One edit below its parent: a letter, how often (deletions only), what it leaves in the conversation, and its branches."""

    parent: Node | None
    letter: str
    times: int = 1
    role: str = ""
    text: str | None = None  # None: nothing is left
    below: set[Node] = field(default_factory=set)

    def grow(self, letter: str, role: str = "", text: str | None = None) -> Node:
        node = Node(self, letter, 1, role, text)
        self.below.add(node)
        return node


class Repair:
    """The search over one conversation's rows in order. `emit(letter, times, role, text)` gets each certain edit once, in order."""

    def __init__(self, emit: Callable[[str, int, str, str | None], None]):
        self.emit = emit
        self.root = Node(None, "")
        #: of each state: cost, place in the order of letters, history
        self.survivors: list[tuple[int, int, Node] | None] = [(0, 0, self.root), None, None, None]

    def _drop(self, node: Node) -> None:
        """Removes a node that no survivor and no branch needs, and so on up to the root."""
        while node is not self.root and not node.below and not any(s and s[2] is node for s in self.survivors):
            node.parent.below.discard(node)
            node = node.parent

    def _settle(self) -> None:
        """Emits what all survivors share."""
        while len(self.root.below) == 1 and not any(s and s[2] is self.root for s in self.survivors):
            (node,) = self.root.below
            self.emit(node.letter, node.times, node.role, node.text)
            node.parent = None
            self.root = node

    def _next(self, options: list[list[tuple]]) -> None:
        """options[state]: (cost, order, letters, survivor, edits), edits being (letter, role, text). The first in this order wins."""
        old = [s[2] for s in self.survivors if s]
        chosen = [min(ways, key=lambda w: w[:3]) if ways else None for ways in options]
        if (after := chosen[ASSISTANT]) is not None:  # what can follow START or SYSTEM can follow it, but for a system row that stays
            if chosen[START] is not None and chosen[START][0] > after[0] + DELETE:
                chosen[START] = None
            if chosen[SYSTEM] is not None and chosen[SYSTEM][0] > after[0]:
                chosen[SYSTEM] = None
        order = sorted({w[1:3] for w in chosen if w})
        self.survivors = [None] * 4
        for state, way in enumerate(chosen):
            if way is not None:
                node = way[3]
                for letter, role, text in way[4]:
                    node = node.grow(letter, role, text)
                self.survivors[state] = way[0], order.index(way[1:3]), node
        for node in old:
            self._drop(node)
        self._settle()

    def delete(self) -> None:
        """A row that has to go: the same for every survivor."""
        for state, s in enumerate(self.survivors):
            if s:
                node = s[2]
                if node is not self.root and node.letter == "D" and not node.below:
                    node.times += 1
                else:
                    node = node.grow("D")
                self.survivors[state] = s[0] + DELETE, s[1], node
        self._settle()

    def row(self, role: str, text: str, truncated: bool) -> None:
        """A row that may stay. Insertions come right before a row that stays: before a deletion they are never the least letters."""
        extra = TRUNCATED if truncated else 0
        options: list[list[tuple]] = [[], [], [], []]
        for state, s in enumerate(self.survivors):
            if not s:
                continue
            cost, order, node = s
            options[state].append((cost + DELETE, order, "D", node, [("D", "", None)]))
            if state == START and role[:1] == "s":
                options[SYSTEM].append((cost + extra, order, "K", node, [("K", role, text)]))
            for to in (USER, ASSISTANT):
                kept = role[:1] == ROLE[to][0]
                edit = ("K", role, text) if kept else ("R", ROLE[to], text)
                before = (state == USER) == (to == USER)  # the other role has to come in between
                edits = [("I", ROLE[USER + ASSISTANT - to], ""), edit] if before else [edit]
                price = cost + extra + (0 if kept else REROLE) + (INSERT if before else 0)
                options[to].append((price, order, "".join(e[0] for e in edits), node, edits))
        self._next(options)

    def finish(self) -> int:
        """Emits the rest; the cost of all edits."""
        missing = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
        ends = [(s[0] + INSERT * len(missing[i]), s[1], "I" * len(missing[i]), s[2], [("I", ROLE[r], "") for r in missing[i]]) for i, s in enumerate(self.survivors) if s]
        self._next([ends, [], [], []])
        path, node = [], self.survivors[START][2]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.letter, node.times, node.role, node.text)
        return self.survivors[START][0]


class _Summary:
    """What the rows of one conversation come to."""

    NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def __init__(self) -> None:
        self.turns: list[int] = []  # least, last, distinct
        self.faults = [0] * len(FAULTS)
        self.illegal = 0
        self.before: str | None = None
        self.audit: list[str] = []
        self.digest, self.begun = hashlib.sha256(), False
        self.search = Repair(self._edit)

    def _edit(self, letter: str, times: int, role: str, text: str | None) -> None:
        self.audit.append(letter * times)
        if text is not None:
            self.digest.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
            self.begun = True

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if fault in (BLANK, DUPLICATE):
            self.search.delete()
        else:
            self.search.row(role, text, fault == CUT)

    def values(self) -> tuple:
        cost = self.search.finish()
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit), self.digest.hexdigest()


def _keys_and_rows(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column(key), *(batch.column(c).to_pylist() for c in columns))


def _summaries(schema: pa.DataType, key: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, summary = None, None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * (1 + len(_Summary.NAMES))
            types = [schema, *[pa.int64()] * 6, pa.string(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [key, *_Summary.NAMES])
            done.clear()
            return out

        held = 0
        for group, there, turn, role, text, fault in _keys_and_rows(batches, key, ["_there", "_turn", "_role", "_text", "_fault"]):
            value = (group.as_py(),)
            if value != now:
                if summary:
                    done.append((*now, *summary.values()))
                    held += len(done[-1][7]) + 200
                    if held > 1 << 20:
                        yield flush()
                        held = 0
                now, summary = value, _Summary()
            if there:
                summary.add(turn, role, text, fault)
        if summary:
            done.append((*now, *summary.values()))
        yield flush()

    return work


def _turns(schema: pa.DataType, key: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, search, at = None, None, 0

        def edit(letter: str, times: int, role: str, text: str | None) -> None:
            nonlocal at
            if text is not None:
                out.append((*now, at, letter, role, text))
                at += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            types = [schema, pa.int64(), pa.string(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [key, "turn", "edit", "role", "text"])
            out.clear()
            return batch

        for group, there, role, text, fault in _keys_and_rows(batches, key, ["_there", "_role", "_text", "_fault"]):
            value = (group.as_py(),)
            if value != now:
                if search:
                    search.finish()
                now, search, at = value, Repair(edit), 0
            if there and fault in (BLANK, DUPLICATE):
                search.delete()
            elif there:
                search.row(role, text, fault == CUT)
            if len(out) >= 1024:
                yield flush()
        if search:
            search.finish()
        yield flush()

    return work


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text), damaged by the CRC-32 of `conv_id:turn` modulo 20; nulls are taken as one space.

    0 drops the row, 1 empties the text, 2 removes its [.!?], 3 repeats the row, 4 makes its role user. Dropped rows stay as rows
    with `there` false, so that no conversation is lost.
    """
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", written("role").alias("role"), written("text").alias("text"), (F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") != 0).alias("there"), copies.alias("copy")).drop("copy")


def _in_order(rows: DataFrame, key: str, there: Column) -> DataFrame:
    """Rows with their first fault, in order of conversation, turn (nulls first), role and text. One shuffle, by conversation."""
    modest_batches(rows.sparkSession)
    space = F.lit(" ")
    rows = rows.select(key, F.col("turn").cast("long").alias("_turn"), F.coalesce("role", space).alias("_role"), F.coalesce("text", space).alias("_text"), there.alias("_there"))
    seen = Window.partitionBy(key, "_there", "_role", "_text").orderBy(F.asc_nulls_first("_turn"))
    blank = ~F.col("_text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("_text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(F.row_number().over(seen) > 1, DUPLICATE).when(cut, CUT).otherwise(FINE)
    return rows.repartition(key).withColumn("_fault", fault).sortWithinPartitions(key, F.asc_nulls_first("_turn"), "_role", "_text")


def _type(rows: DataFrame, key: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[key].dataType
    return kind.simpleString(), to_arrow_type(kind)


def repair_conversations(rows: DataFrame, there: str | None = None) -> DataFrame:
    """rows(conv_id, turn, role, text) -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    One row per conv_id, a null one included. Rows count in order of turn (nulls first), then role and text; null roles and texts
    are one space. Each row's first fault counts: blank, duplicate (role and text stand earlier), truncated (no [.!?] at the end).
    `audit` is the cheapest edits' letters (Delete, Insert, Keep, Rerole; ties: least in ASCII) that make the roles read
    (s?(ua)+)?, `repaired_sha256` digests the repaired `role:text` lines. `there` names a boolean column that is false for rows
    that are gone; a conversation without rows has zeros, an empty audit and the digest of nothing. Other columns are not read.

    A conversation's rows pass one task in order, as one digest needs them, sorted by Spark (spilling); the task holds the edits
    that are not certain yet. Lowers the session's Arrow batches to at most 2,048 rows.
    """
    name, kind = _type(rows, "conv_id")
    schema = f"conv_id {name}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _in_order(rows, "conv_id", F.col(there) if there else F.lit(True)).mapInArrow(_summaries(kind, "conv_id"), schema)


def repaired_turns(rows: DataFrame, there: str | None = None) -> DataFrame:
    """The repaired conversations of repair_conversations as rows: conv_id, turn (from 0), edit (K, R or I), role, text."""
    name, kind = _type(rows, "conv_id")
    return _in_order(rows, "conv_id", F.col(there) if there else F.lit(True)).mapInArrow(_turns(kind, "conv_id"), f"conv_id {name}, turn long, edit string, role string, text string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), there="there")


#: The search as a recursive query over whole strings, an insertion wherever one can stand; CRC-32 from its table.
ORACLE = r"""
with recursive crc_table as (
    select list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as crc_of
    from (select unnest(range(256))::bigint as b)
), raw as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        hex(encode(concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')))) as digits
    from conversations
), hashed as (
    select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(digits) // 2),
            lambda i: instr('0123456789ABCDEF', digits[2 * i + 1]) * 16 + instr('0123456789ABCDEF', digits[2 * i + 2]) - 17)),
        lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1])), 4294967295) % 20 as how
    from raw, crc_table
), hurt as (
    select conv_id, turn, case when how = 4 then 'user' else role end as role,
        case how when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when how = 3 then [0, 1] else [0] end) as copy
    from hashed where how <> 0
), numbered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as at_row from hurt
), turns as materialized (
    select conv_id, turn, role, text, at_row, role[1] as i,
        case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1
            when row_number() over (partition by conv_id, role, text order by at_row) > 1 then 2
            when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 3 else 0 end as fault,
        lag(role[1]) over (partition by conv_id order by at_row) as prior
    from numbered
), search as (
    select conv_id, 0::bigint as at_row, {'c': 0, 's': ''} as p0, {'c': 1000000000, 's': ''} as p1,
        {'c': 1000000000, 's': ''} as p2, {'c': 1000000000, 's': ''} as p3
    from (select distinct conv_id from turns)
    union all
    select conv_id, at_row,
        {'c': p0.c + 4, 's': p0.s || 'D'} as p0,
        least({'c': p1.c + 4, 's': p1.s || 'D'}, case when stays and i = 's' then {'c': p0.c + cut, 's': p0.s || 'K'} end) as p1,
        least({'c': u.c + 4, 's': u.s || 'D'},
            case when stays then {'c': p0.c + cut + as_u, 's': p0.s || l_u} end,
            case when stays then {'c': p1.c + cut + as_u, 's': p1.s || l_u} end,
            case when stays then {'c': a.c + cut + as_u, 's': a.s || l_u} end) as p2,
        least({'c': a.c + 4, 's': a.s || 'D'}, case when stays then {'c': u.c + cut + as_a, 's': u.s || l_a} end) as p3
    from (
        select *, least(p3, {'c': u.c + 3, 's': u.s || 'I'}) as a
        from (
            select s.conv_id, t.at_row, t.i, p0, p1, p3, t.fault not in (1, 2) as stays, case when t.fault = 3 then 3 else 0 end as cut,
                case when t.i = 'u' then 0 else 3 end as as_u, case when t.i = 'u' then 'K' else 'R' end as l_u,
                case when t.i = 'a' then 0 else 3 end as as_a, case when t.i = 'a' then 'K' else 'R' end as l_a,
                least(p2, {'c': p0.c + 3, 's': p0.s || 'I'}, {'c': p1.c + 3, 's': p1.s || 'I'}, {'c': p3.c + 3, 's': p3.s || 'I'}) as u
            from search s join turns t on t.conv_id is not distinct from s.conv_id and t.at_row = s.at_row + 1
        )
    )
), ends as (
    select conv_id, unnest(least(p0, p3, {'c': p2.c + 3, 's': p2.s || 'I'}, {'c': p1.c + 6, 's': p1.s || 'II'}))
    from search s
    where at_row = (select max(at_row) from turns t where t.conv_id is not distinct from s.conv_id)
), letters as (
    select conv_id, pos, s[pos] as letter, pos - length(replace(s[1:pos], 'I', '')) as inserted,
        length(replace(s[1:pos], 'D', '')) as kept
    from (select conv_id, s, unnest(range(1, length(s) + 1)) as pos from ends)
), edited as (
    select l.conv_id, l.pos, l.letter, l.kept, t.role, case when l.letter = 'I' then '' else t.text end as text,
        max(case when l.kept = 1 and l.letter = 'K' and t.i = 's' then 1 else 0 end) over (partition by l.conv_id) as led
    from letters l left join turns t
        on t.conv_id is not distinct from l.conv_id and t.at_row = l.pos - l.inserted and l.letter <> 'I'
    where l.letter <> 'D'
), repaired as (
    select conv_id, string_agg(case when letter = 'K' then role when (kept - 1 - led) % 2 = 0 then 'user' else 'assistant' end
        || ':' || text, chr(10) order by pos) as lines
    from edited group by conv_id
), counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate,
        count(*) filter (where fault = 3) as truncated,
        count(*) filter (where prior is not null and prior || i not in ('su', 'ua', 'au')) as illegal
    from turns group by conv_id
)
select c.conv_id, coalesce(n.gaps, 0)::bigint as gaps, coalesce(n.blank, 0)::bigint as blank,
    coalesce(n.duplicate, 0)::bigint as duplicate, coalesce(n.truncated, 0)::bigint as truncated,
    coalesce(n.illegal, 0)::bigint as illegal, coalesce(e.c, 0)::bigint as cost, coalesce(e.s, '') as audit,
    sha256(coalesce(r.lines, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counts n on n.conv_id is not distinct from c.conv_id
left join ends e on e.conv_id is not distinct from c.conv_id
left join repaired r on r.conv_id is not distinct from c.conv_id
"""
