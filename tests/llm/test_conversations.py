"""Repaired conversations against a search over all edits, cheapest and least first."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import conversations
from tidemark.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv_id, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def search(rows, faults):
    """The audit and the repaired rows, by a search over partial repairs in order of cost and audit."""
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, made = heapq.heappop(heap)
        initials = "".join(role[:1] if role else "?" for role, _ in made)
        if at == len(rows) + 1:
            return cost, audit, made
        if (at, initials) in done or not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        done.add((at, initials))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            heapq.heappush(heap, (cost, audit, at + 1, made))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, (*made, (role, ""))))
        if at < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, made))
            if faults[at] not in ("blank", "duplicate"):
                extra = 5 if faults[at] else 0
                heapq.heappush(heap, (cost + extra, audit + "K", at + 1, (*made, rows[at])))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + extra, audit + "R", at + 1, (*made, (role, rows[at][1]))))


def brute(rows):
    ids = sorted({r[0] for r in rows}, key=repr)
    out = []
    hashed = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for conv_id in ids:
        own = [r for r in damage(rows) if r[0] == conv_id]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashed(r[3])))
        seen, faults = set(), []
        for _, _, role, text in own:
            end = text.rstrip(SPACE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [(a[2][:1], b[2][:1]) for a, b in itertools.pairwise(own)]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairs)
        cost, audit, made = search([r[2:] for r in own], faults)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv_id, min(gaps, 2**63 - 1), *counts, illegal, cost, audit, hashed("\n".join(f"{r}:{t}" for r, t in made))))
    return out


def result(df):
    got = conversations.repair_conversations(df).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_given_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert result(df) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_random_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
    monkeypatch.setattr(conversations, "TURNS", 2 * block)
    rng = random.Random(block)
    rows = []
    for conv_id in range(120):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", "Assistant"))
            text = rng.choice(("One.", "Two!", "three", "Four? \n", " ", "", "five \t", "Six."))
            rows.append((conv_id, rng.choice((turn, turn + 2, turn, None)), role, text))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df) == sorted(brute(rows), key=repr)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (7, -(2**63), "user", "x."), (7, 2**63 - 1, "assistant", "y."),
            (8, 5, "user", "same."), (8, 5, "user", "same."), (8, 6, "assistant", "long. " * 100_000), (9, None, "user", "n"), (10, 3, "s", "é.")]
    dropped = [c for c in range(100, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows += [(c, 0, "user", "gone.") for c in dropped]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = result(df)
    assert got == sorted(brute(rows), key=repr)
    empty = hashlib.sha256(b"").hexdigest()
    assert [r for r in got if r[0] in dropped] == [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in dropped]


def test_empty_table_and_clashing_columns(spark):
    assert conversations.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "a.", "x", 1), (1, 1, "assistant", "b.", "y", 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", digest string, stretch int")
    assert result(df) == brute([r[:4] for r in rows])


def test_long_conversation_in_many_blocks(spark):
    rows = [(1, turn, "user" if turn % 2 == 0 else "assistant", f"text {turn % 90}.") for turn in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    (got,) = result(df)
    assert got == brute(rows)[0]


def test_a_rest_is_worked_out_once(monkeypatch):
    made = []
    whole = conversations.node_table
    monkeypatch.setattr(conversations, "node_table", lambda letter, rest: made.append(1) or whole(letter, rest))
    signatures = sorted(("ua", "suaua", "uaua", "xuaua", "uAua", "aua"), key=lambda s: s[::-1])
    solved = dict(conversations.tables(iter(signatures)))
    rests = {s[i:] for s in signatures for i in range(len(s))}
    assert len(made) == len(rests) and solved["uaua"][0][3] == (0, "KKKK")
