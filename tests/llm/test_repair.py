"""Conversation repair, held against a plain search over whole edit strings."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (kind != 0) * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(WHITE)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """The least (cost, audit) and the lines, by a table of the best way to each state, with whole strings."""
    follow = {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}
    faults = faults_of(rows)
    best = {"": (0, "", ())}

    def grown(ways):
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    if state in follow[role[0]]:
                        new = (cost + 5, audit + "I", (*lines, f"{role}:"))
                        ways[role[0]] = min(ways.get(role[0], new), new)
        return ways

    for (role, text), fault in zip(rows, faults):
        after = {}

        def to(state, *way):
            after[state] = min(after.get(state, way), way)

        for state, (cost, audit, lines) in grown(dict(best)).items():
            to(state, cost + 2, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if role[:1] in follow and state in follow[role[:1]]:
                to(role[:1], cost + more, audit + "K", (*lines, f"{role}:{text}"))
            for new in ("user", "assistant"):
                if state in follow[new[0]]:
                    to(new[0], cost + 1 + more, audit + "R", (*lines, f"{new}:{text}"))
        best = after
    ended = grown(dict(best))
    return min(ended[s] for s in ("", "a") if s in ended)


def plain_report(originals):
    out = {}
    left = plain_damage(originals)
    for conv in {r[0] for r in originals}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        rows = [r[2:] for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = faults_of(rows)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, lines = plain_repair(rows)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, rows, **more):
    table = spark.createDataFrame(rows, SCHEMA)
    for name, value in more.items():
        table = table.selectExpr("*", f"{value} AS {name}")
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.audited(table).collect()}
    assert found == plain_report(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=14))
def test_the_least_of_the_cheapest_ways(kinds):
    codes = bytes(4 * i + f for i, f in kinds)
    texts = {0: "x.", 1: "", 2: "dup.", 3: "open"}
    # Texts are made distinct, and duplicates are told by a row before all that is charged for apart.
    rows = [(("x", "system", "user", "assistant")[i], f"{n}{texts[f]}" if f != 1 else "") for n, (i, f) in enumerate(kinds)]
    gone = [f in (1, 2) for _, f in kinds]
    rows = [(r, "" if g else t) for (r, t), g in zip(rows, gone)]
    want = plain_repair(rows)
    parts = repair.Rows(codes)
    whole = repair.Blocks([repair.Rows(codes[a : a + 3]).table() for a in range(0, len(codes), 3)])
    after = repair.crossed(whole, 0, 0)
    audit, state = "", 0
    for n, a in enumerate(range(0, len(codes), 3)):
        audit += "".join(text for text, _ in repair.Rows(codes[a : a + 3]).edits(state, after[n]))
        state = after[n]
    audit += repair._END_EDITS[state][0]
    assert audit == want[1]
    assert repair._back(parts.back(0, 0, state), repair._END)[state] >= 0
    alone = repair.crossed(repair.Blocks([parts.table()]), 0, 0)[0]
    assert "".join(t for t, _ in parts.edits(0, alone)) + repair._END_EDITS[alone][0] == want[1]


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["a b.", "c?", "d", " ", "", None, f"t{turn}.", f"u{turn} \n", "é。", "x!\t"])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
    check(spark, rows + [(None, None, None, None), (None, 1, "user", "q?"), (None, 2, "assistant", "a.")], kind="1", copy="2", seq="3", conv="'x'", digest="4")


def test_nothing_left_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "a.")])
    check(spark, [])


def test_long_conversation_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", 7)
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"t{t}.", f"t{t}", ""])) for t in range(300)]
    rows += [(2, None, "user", "again.")] * 50 + [(3, 0, "user", "long " * 100_000 + "."), (3, 1, "assistant", "ok.")]
    check(spark, rows)


def test_edits_hold_the_repaired_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "hello?"), (1, 2, "assistant", "yes."), (1, 3, "user", "and?")]
    edits, report = repair.repaired(spark.createDataFrame(rows, SCHEMA))
    found = [tuple(r) for r in edits.orderBy("place").select("edit", "role", "text").collect()]
    cost, audit, lines = plain_repair([r[2:] for r in rows])
    assert "".join(e for e, _, _ in found) == audit and report.first()["cost"] == cost
    assert [f"{r}:{t}" for e, r, t in found if e != "D"] == list(lines)
