"""Conversation structure repair (operator 11).

A conversation should be an optional system row and then user and assistant in turn. The cheapest edits
that make it so are found by Hirschberg's divide and conquer: the costs from the front and the costs from
the back, one for each of the four states that a conversation can be in, meet in the middle; of the states
that a cheapest repair can cross there, the one whose edits so far are the least is taken, and both halves
are repaired for themselves. No table of all rows and states is kept.

Rows are dealt out in ranges, so that a long conversation is cut into blocks. A block is summed up by what
it costs from each state to each, the same division picks the states at the blocks' borders, and then all
blocks are repaired at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.storage import saved

DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED_COST = 5
#: Rows of a block; one has at most three edits a row and two more.
BLOCK_ROWS = 4096
BLOCK_PLACES = 4 * BLOCK_ROWS

#: What stands last so far: nothing, or a row with the initial s, u or a.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
INITIALS = ("", "s", "u", "a")
#: States in which a role may follow.
MAY_FOLLOW = {SYSTEM: (NOTHING,), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
NEVER = 1 << 60
WHITE = " \t\n\x0b\x0c\r"

#: From each state to each: the least cost, and the rank of the edits among those from the same state.
Table = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]
#: For each state the cost, and the rank of its edits among the four.
Front = tuple[tuple[int, int], ...]


def _edits_of(initial: int, fault: int) -> list[tuple[int, str, int | None]]:
    """(cost, edit, state after; None: as before) of what can be done to a row."""
    found = [(COST[DELETE], DELETE, None)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST * (fault == TRUNCATED)
        if initial:
            found.append((COST[KEEP] + more, KEEP, initial))
        found += [(COST[REROLE] + more, REROLE, to) for to in (USER, ASSISTANT)]
    return found


def _table(edits: list[tuple[int, str, int | None]], end: bool = False) -> tuple[Table, list[list[str]]]:
    """The table of a row that may be edited so, with rows inserted before it; and the edits from each state to
    each. end: nothing is done but to insert, until the conversation may end."""
    best = [[(NEVER, "")] * 4 for _ in STATES]
    for first in STATES:
        state, inserted = first, 0
        while inserted < 3:
            if end and state in (NOTHING, ASSISTANT):
                best[first][NOTHING] = min(best[first][NOTHING], (COST[INSERT] * inserted, INSERT * inserted))
            for cost, edit, to in edits:
                if to is None or state in MAY_FOLLOW[to]:
                    after = state if to is None else to
                    best[first][after] = min(best[first][after], (cost + COST[INSERT] * inserted, INSERT * inserted + edit))
            state, inserted = ASSISTANT if state == USER else USER, inserted + 1
    cost = tuple(tuple(c for c, _ in row) for row in best)
    rank = tuple(tuple(sorted(x for _, x in row).index(text) for _, text in row) for row in best)
    return (cost, rank), [[text for _, text in row] for row in best]


_ROWS = [_table(_edits_of(code // 4, code % 4)) for code in range(16)]
_END, _END_EDITS = _table([], end=True)


def _onward(front: Front, table: Table) -> Front:
    """Costs and ranks after one more row or block. Edits to different states from one state differ, and none
    is the beginning of another; so ranks before and within tell the order of what they make together."""
    cost, rank = table
    best = [min((front[p][0] + cost[p][q], front[p][1], rank[p][q]) for p in STATES) for q in STATES]
    order = sorted(b[1:] for b in best)
    return tuple((min(NEVER, b[0]), order.index(b[1:])) for b in best)


def _back(costs: tuple[int, ...], table: Table) -> tuple[int, ...]:
    """Costs to the end from before a row or block."""
    return tuple(min(NEVER, *(c + costs[q] for q, c in enumerate(row))) for row in table[0])


@lru_cache(1 << 16)
def _row_onward(front: Front, code: int) -> tuple[Front, int]:
    """_onward() for a row, less the least cost; few fronts occur again and again."""
    after = _onward(front, _ROWS[code][0])
    least = min(c for c, _ in after)
    return tuple((c if c == NEVER else c - least, r) for c, r in after), least


@lru_cache(1 << 16)
def _row_back(costs: tuple[int, ...], code: int) -> tuple[int, ...]:
    before = _back(costs, _ROWS[code][0])
    least = min(before)
    return tuple(c if c == NEVER else c - least for c in before)


def _from(state: int) -> Front:
    return tuple((0 if s == state else NEVER, 0) for s in STATES)


def _to(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else NEVER for s in STATES)


class Rows:
    """A run of rows by their codes (4 * initial + fault)."""

    def __init__(self, codes: bytes):
        self.codes = codes

    def __len__(self) -> int:
        return len(self.codes)

    def front(self, a: int, b: int, state: int) -> tuple[Front, int]:
        """Costs and ranks after rows a to b from a state, and what was taken off the costs."""
        front, off = _from(state), 0
        for code in self.codes[a:b]:
            front, least = _row_onward(front, code)
            off += least
        return front, off

    def back(self, a: int, b: int, state: int) -> tuple[int, ...]:
        costs = _to(state)
        for code in reversed(self.codes[a:b]):
            costs = _row_back(costs, code)
        return costs

    def table(self) -> Table:
        fronts = [self.front(0, len(self.codes), s) for s in STATES]
        cost = tuple(tuple(min(NEVER, c + off) for c, _ in front) for front, off in fronts)
        return cost, tuple(tuple(r for _, r in front) for front, _ in fronts)

    def edits(self, first: int, last: int) -> Iterator[tuple[str, int]]:
        """Of each row its edits (those before it inserted first) and the state after, from a state to a state."""
        for code, after in zip(self.codes, crossed(self, first, last)):
            yield _ROWS[code][1][first][after], after
            first = after


class Blocks:
    """A conversation's blocks by their tables, and its end."""

    def __init__(self, tables: Sequence[Table]):
        self.tables = [*tables, _END]

    def __len__(self) -> int:
        return len(self.tables)

    def front(self, a: int, b: int, state: int) -> tuple[Front, int]:
        front = _from(state)
        for table in self.tables[a:b]:
            front = _onward(front, table)
        return front, 0

    def back(self, a: int, b: int, state: int) -> tuple[int, ...]:
        costs = _to(state)
        for table in reversed(self.tables[a:b]):
            costs = _back(costs, table)
        return costs


def crossed(parts: Rows | Blocks, first: int, last: int) -> list[int]:
    """The state after each part of the cheapest way from a state to a state; of several the one with the least edits."""
    after = [last] * len(parts)
    todo = [(0, len(parts), first, last)]
    while todo:
        a, b, p, q = todo.pop()
        if b - a < 2:
            continue
        mid = (a + b) // 2
        front, _ = parts.front(a, mid, p)
        back = parts.back(mid, b, q)
        s = min(STATES, key=lambda s: (front[s][0] + back[s], front[s][1]))
        after[mid - 1] = s
        todo += [(a, mid, p, s), (mid, b, s, q)]
    return after


def plain_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text) with a space for a null role or text."""
    space = F.lit(" ")
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"))


def _coded(rows: DataFrame) -> DataFrame:
    """(seq, conv, turn, role, digest, initial, fault) of numbered rows. Of rows with equal role and text the first counts:
    a minimum by key and a join on rows' numbers, so that no task holds all rows of a hot text."""
    end = F.rtrim("text", F.lit(WHITE))
    initial = F.when(F.length("role") > 0, F.array_position(F.array(*map(F.lit, INITIALS[1:])), F.substring("role", 1, 1))).otherwise(0).cast("int")
    light = rows.select("seq", "conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), initial.alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"))
    # Nulls come first in structs, as they do among turns.
    first = light.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "seq"))["seq"].alias("seq")).select("seq", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(NO_FAULT)
    return light.join(first, "seq", "left").select("seq", "conv", "turn", "role", "digest", "initial", fault.alias("fault"))


def _legal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.isin(before * 4 + after, [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])


def _blocks(coded: DataFrame) -> DataFrame:
    """(conv, block, codes, seqs, inner, head, tail, cost, rank): runs of a conversation's rows in order, none with more
    than BLOCK_ROWS; block numbers grow along a conversation. inner: adjacent rows that may not be so."""
    kind = coded.schema["conv"].dataType.simpleString()
    ordered = coded.repartitionByRange("conv", "turn", "role", "digest", "seq").sortWithinPartitions("conv", "turn", "role", "digest", "seq")
    picked = ordered.select("conv", "seq", (F.col("initial") * 4 + F.col("fault")).cast("tinyint").alias("code"), F.spark_partition_id().alias("part"))

    def made(conv, block: int, codes: np.ndarray, seqs: np.ndarray) -> tuple:
        initials = codes.astype(np.int64) // 4
        table = Rows(codes.tobytes()).table()
        inner = int((~_legal(initials[:-1], initials[1:])).sum())
        return conv, block, codes.tobytes(), seqs, inner, int(initials[0]), int(initials[-1]), sum(table[0], ()), sum(table[1], ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, None  # held: the conversation whose last rows may go on, and its rows
        names = ["conv", "block", "codes", "seqs", "inner", "head", "tail", "cost", "rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, seqs, codes = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint8)
            part = batch.column(3)[0].as_py()
            borders = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
            out = []
            for a, b in zip(borders[:-1], borders[1:]):
                if held and held[0] != conv[a]:
                    out.append(made(held[0], (part << 40) + n * BLOCK_PLACES, *held[1:]))
                    n, held = n + 1, None
                own_codes, own_seqs = codes[a:b], seqs[a:b]
                if held:
                    own_codes, own_seqs = np.concatenate((held[1], own_codes)), np.concatenate((held[2], own_seqs))
                while len(own_codes) > BLOCK_ROWS:
                    out.append(made(conv[a], (part << 40) + n * BLOCK_PLACES, own_codes[:BLOCK_ROWS], own_seqs[:BLOCK_ROWS]))
                    n, own_codes, own_seqs = n + 1, own_codes[BLOCK_ROWS:], own_seqs[BLOCK_ROWS:]
                held = (conv[a], own_codes, own_seqs)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types(batch))], names)
        if held:
            out = [made(held[0], (part << 40) + n * BLOCK_PLACES, *held[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types(batch))], names)

    def types(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.column(0).type, pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    return picked.mapInArrow(run, f"conv {kind}, block long, codes binary, seqs array<long>, inner long, head int, tail int, cost array<long>, rank array<long>")


def _borders(blocks: DataFrame) -> DataFrame:
    """(conv, block, first, last, illegal, cost, ends): the states at blocks' borders, and in the last block of a conversation
    its whole cost. Only summaries travel: one for BLOCK_ROWS rows."""
    kind = blocks.schema["conv"].dataType.simpleString()
    picked = blocks.select("conv", "block", "inner", "head", "tail", "cost", "rank").repartition("conv").sortWithinPartitions("conv", "block")

    def table(cost: list[int], rank: list[int]) -> Table:
        return tuple(tuple(cost[i : i + 4]) for i in range(0, 16, 4)), tuple(tuple(rank[i : i + 4]) for i in range(0, 16, 4))

    def solved(conv, rows: list[tuple]) -> Iterator[tuple]:
        tables = Blocks([table(r[4], r[5]) for r in rows])
        after = crossed(tables, NOTHING, NOTHING)
        state, total = NOTHING, 0
        for i, (block, inner, head, *_) in enumerate(rows):
            total += tables.tables[i][0][state][after[i]]
            ends = i + 1 == len(rows)
            joint = i > 0 and not _legal(np.array([rows[i - 1][3]]), np.array([head]))[0]
            yield conv, block, state, after[i], inner + joint, total + _END[0][after[i]][NOTHING] if ends else 0, ends
            state = after[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "block", "first", "last", "illegal", "cost", "ends"]
        held, rows, kinds = None, [], None
        for batch in batches:
            kinds = [batch.column(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            out = []
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and conv != held:
                    out += solved(held, rows)
                    rows = []
                held = conv
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*solved(held, rows)), kinds)], names)

    return picked.mapInArrow(run, f"conv {kind}, block long, first int, last int, illegal long, cost long, ends boolean")


def _edited(blocks: DataFrame, borders: DataFrame) -> DataFrame:
    """(conv, place, edit, seq, to): the edits of all blocks. seq is null where a row is inserted, to is the new role's state
    where it has one. Places grow along a conversation."""
    kind = blocks.schema["conv"].dataType.simpleString()
    both = blocks.select("block", "conv", "codes", "seqs").join(borders.select("block", "first", "last", "ends"), "block")
    picked = both.select("conv", "block", "codes", "seqs", "first", "last", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                conv, block, codes, seqs, first, last, ends = (c[i].as_py() for c in batch.columns)
                edit, seq, to = [], [], []
                state, own = first, iter(seqs)
                for texts, after in [*Rows(codes).edits(first, last), *([(_END_EDITS[last][NOTHING], NOTHING)] if ends else [])]:
                    for x in texts:
                        if x == INSERT:
                            state = ASSISTANT if state == USER else USER
                        elif x != DELETE:
                            state = after
                        edit.append(x)
                        seq.append(None if x == INSERT else next(own))
                        to.append(state if x in (INSERT, REROLE) else None)
                n = len(edit)
                columns = [pa.array([conv] * n, batch.column(0).type), pa.array(range(block, block + n), pa.int64()), pa.array(edit, pa.string()), pa.array(seq, pa.int64()), pa.array(to, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["conv", "place", "edit", "seq", "to"])

    return picked.mapInArrow(run, f"conv {kind}, place long, edit string, seq long, to int")


def repaired(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The edits (conv, place, edit, role, text) in order of place, and a report of each conversation (conv, gaps,
    blank, duplicate, truncated, illegal, cost).

    What is left without the edits D is the repaired conversation; an inserted row has an empty text, one with edit R
    its new role. Rows go by turn, nulls first, then by role and by the SHA-256 of their text; a null role or text
    is a space, and null conversations are one. A row's first fault counts: blank, duplicate (its role and text were there
    before), truncated (it doesn't end in a full stop, question or exclamation mark). Of several cheapest ways
    to edit the one whose edits are the least in ASCII order is taken. Further columns play no part; an empty
    table gives empty ones. Texts of any length count whole; they are shuffled once, to meet their edits.
    """
    rows = saved(plain_rows(conversations, conv, turn, role, text).withColumn("seq", F.monotonically_increasing_id()))
    coded = saved(_coded(rows))
    blocks = saved(_blocks(coded))
    borders = saved(_borders(blocks))
    edits = saved(_edited(blocks, borders))
    name = F.when(F.col("to") == USER, "user").when(F.col("to") == ASSISTANT, "assistant")
    inserted = edits.where("seq IS NULL").select("conv", "place", "edit", name.alias("role"), F.lit("").alias("text"))
    own = edits.where("seq IS NOT NULL").join(rows.drop("conv"), "seq").select("conv", "place", "edit", name.otherwise(F.col("role")).alias("role"), "text")
    report = coded.groupBy("conv").agg(
        (F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.count_distinct("turn")).alias("gaps"),
        *[F.count_if(F.col("fault") == fault).alias(n) for n, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))],
    )
    found = borders.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    # A union instead of a join, as a conversation's name may be null.
    both = report.unionByName(found, allowMissingColumns=True).groupBy("conv")
    report = both.agg(*[F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
    return inserted.unionByName(own), report


def audits(edits: DataFrame) -> DataFrame:
    """(conv, audit, sha256): a conversation's edits as one string, and the hash of its repaired rows `role:text` with a
    line feed between. A hash can only be made in order, so a task reads a conversation from its sorted rows, one
    batch at a time; it holds no more than the string of edits."""
    kind = edits.schema["conv"].dataType.simpleString()
    rows = edits.select("conv", "place", "edit", F.when(F.col("edit") != DELETE, F.encode(F.concat("role", F.lit(":"), "text"), "UTF-8")).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], kinds), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv", "audit", "sha256"])

        at, audit, digest, lines, kinds = None, [], None, 0, None
        for batch in batches:
            kinds = batch.column(0).type
            for conv, edit, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if digest is None or conv != at:
                    if digest is not None:
                        yield row()
                    at, audit, digest, lines = conv, [], hashlib.sha256(), 0
                audit.append(edit)
                if edit != DELETE:
                    if lines:
                        digest.update(b"\n")
                    digest.update(memoryview(line.as_buffer()))
                    lines += 1
        if digest is not None:
            yield row()

    return rows.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(run, f"conv {kind}, audit string, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults that a checksum of conversation and turn deals out: of 20
    values 0 drops a row, 1 empties its text, 2 takes its end marks, 3 repeats it, 4 makes it a user's."""
    space = F.lit(" ")
    shown = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat(shown[0], F.lit(":"), shown[1]), "UTF-8")) % 20
    text = F.coalesce("text", space)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", space))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def audited(conversations: DataFrame) -> DataFrame:
    """The report, audit and hash of each conversation after damaged() and repaired(). A conversation of which no row
    is left has zeros, no edits and the hash of nothing."""
    edits, report = repaired(damaged(conversations))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    parts = report.unionByName(audits(edits), allowMissingColumns=True)
    parts = parts.unionByName(conversations.select(F.col("conv_id").alias("conv")).distinct(), allowMissingColumns=True)
    found = parts.groupBy(F.col("conv").alias("conv_id")).agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return found


# crc32 byte by byte: the reflected polynomial 0xEDB88320, eight steps a byte.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode({0}))::BIGINT + 1),
  lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::BIGINT)), lambda h, b: """ + "{1}" + "))"
_STEP = "xor({0} // 2, 3988292384 * ({0} % 2))"


def _crc_sql(text: str) -> str:
    """DuckDB SQL of a text's crc32. Each of the eight steps is a list_transform over one value, as SQL has no local names."""
    steps = "[xor(h, b)]"
    for _ in range(8):
        steps = f"list_transform({steps}, lambda x: {_STEP.format('x')})"
    return _CRC.format(text, f"({steps})[1]")


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _way(state: str, cost: str | int, edit: str, when: str = "true") -> str:
    """What a way to a state becomes by an edit; its lines are kept as text, each after a line feed."""
    line = {DELETE: "''", INSERT: "chr(10) || '{}:'", KEEP: "chr(10) || role || ':' || text", REROLE: "chr(10) || '{}:' || text"}[edit[0]].format(edit[1:])
    return f"{{'c': {state}.c + CASE WHEN {when} THEN {cost} ELSE 1000000000 END, 'a': {state}.a || '{edit[0]}', 'l': {state}.l || {line}}}"


_FREE, _MORE = "fault NOT IN ('blank', 'duplicate')", "(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END)"
_NEVER = "{'c': 2000000000::BIGINT, 'a': '', 'l': ''}"


def _inserted(rows: str) -> str:
    """The ways to each state (w0, ws, wu, wa) of rows, with a row inserted where that costs less."""
    return f"SELECT * EXCLUDE (w0, ws, wu, wa, zu, za), w0, ws, zu AS wu, za AS wa FROM (SELECT *, {_least('wu', *[_way(x, 5, 'Iuser') for x in ('w0', 'ws', 'wa')])} AS zu, {_least('wa', _way('wu', 5, 'Iassistant'))} AS za FROM ({rows}))"


OP11_SQL = f"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    ({_crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")}) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
      FROM o WHERE kind <> 0),
n AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, lead(role) OVER w AS next
      FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), unhex(sha256(text)), copy)),
r AS (SELECT *, CASE WHEN rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
             WHEN NOT right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS ini FROM n),
f AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'l': ''}} AS w0, {_NEVER} AS ws, {_NEVER} AS wu, {_NEVER} AS wa FROM r GROUP BY conv_id
 UNION ALL
 SELECT conv_id, i, {_way('w0', 2, 'D')},
   {_least(_way('ws', 2, 'D'), _way('w0', _MORE, 'K', f"ini = 's' AND {_FREE}"))},
   {_least(_way('wu', 2, 'D'), *[_way(x, _MORE, 'K', f"ini = 'u' AND {_FREE}") for x in ('w0', 'ws', 'wa')], *[_way(x, f'(1 + {_MORE})', 'Ruser', _FREE) for x in ('w0', 'ws', 'wa')])},
   {_least(_way('wa', 2, 'D'), _way('wu', _MORE, 'K', f"ini = 'a' AND {_FREE}"), _way('wu', f'(1 + {_MORE})', 'Rassistant', _FREE))}
 FROM ({_inserted(_inserted("SELECT r.conv_id, r.i, w0, ws, wu, wa, role, text, fault, ini FROM f JOIN r ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = f.i + 1"))})),
e AS (SELECT conv_id, {_least('w0', 'wa')} AS best FROM ({_inserted(_inserted("SELECT f.conv_id, w0, ws, wu, wa, '' AS role, '' AS text FROM f WHERE i = (SELECT max(i) FROM r WHERE r.conv_id IS NOT DISTINCT FROM f.conv_id)"))})),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (next IS NOT NULL AND ini || left(next, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.l[2:], '')) AS repaired_sha256
FROM c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
