from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from kestrelog.llm import common, turns

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def slow_repair(rows):
    """rows (role initial, fault) -> (cost, audit) by Dijkstra over (cost, audit, rows taken, written roles cut to two)."""
    start = (0, "", 0, "", ())
    heap, seen = [start], set()
    while heap:
        cost, audit, i, written, lines = heapq.heappop(heap)
        if (i, written) in seen:
            continue
        seen.add((i, written))
        if i == len(rows) and LEGAL.match(written):
            return cost, audit, lines
        steps = [("I", 3, i, r, (None, r)) for r in "ua"]
        if i < len(rows):
            role, fault = rows[i]
            steps.append(("D", 4, i + 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                steps += [("K", more, i + 1, role, (i, role))] + [("R", 3 + more, i + 1, r, (i, r)) for r in "ua" if r != role]
        for letter, paid, j, role, line in steps:
            now = written + role
            if any(LEGAL.match(now + rest) for rest in ("", "a", "ua")):
                now = now if len(now) < 3 else "ua" + "u" * (now[-1] == "u")  # all that matters later
                heapq.heappush(heap, (cost + paid, audit + letter, j, now, lines + ((line,) if line else ())))


def slow_conversation(conv_id, rows):
    """Rows (turn, role, text) in any order -> the contract's values, row by row."""
    text = lambda x: " " if x is None else str(x)
    after = []
    for turn, role, said in rows:
        role, said = text(role), text(said)
        kind = zlib.crc32(f"{text(conv_id)}:{text(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            said = ""
        if kind == 2:
            said = re.sub("[.!?]", "", said)
        after += [(turn, "user" if kind == 4 else role, said)] * (2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, said in after:
        last = re.findall(r"[^\x20\x09-\x0D]", said)
        faults.append("blank" if not last else "duplicate" if (role, said) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, said))
    times = [t for t, _, _ in after if t is not None]
    gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
    initials = [r[:1] if r[:1] and r[:1] in "sua" else "x" for _, r, _ in after]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = slow_repair(list(zip(initials, faults)))
    names = {"u": "user", "a": "assistant"}
    out = [f"{names[r]}:" if i is None else f"{after[i][1] if r == initials[i] else names[r]}:{after[i][2]}" for i, r in lines]
    return (conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_auction_equals_dijkstra_on_all_short_conversations():
    letters = {"s": turns.SYSTEM, "u": turns.USER, "a": turns.ASSISTANT, "x": turns.OTHER}
    kinds = {"": turns.SOUND, "duplicate": turns.DUPLICATE, "truncated": turns.TRUNCATED, "blank": turns.BLANK}
    rng = random.Random(5)
    cases = [c for n in range(3) for c in itertools.product(itertools.product(letters, kinds), repeat=n)]
    cases += [[(rng.choice("suauax"), rng.choice(["", "", "", *kinds])) for _ in range(rng.randrange(3, 14))] for _ in range(1_500)]
    for case in cases:
        cost, edits = turns.repair([(letters[r], kinds[f]) for r, f in case])
        assert (cost, "".join(e for e, _ in edits)) == slow_repair(list(case))[:2], case


def test_prices_meet_complementary_slackness():
    rng = random.Random(6)
    codes = [(rng.randrange(4), rng.randrange(4)) for _ in range(300)]
    price = turns.auction(codes)
    for node in range(4 * len(codes) + 4):
        assert price[node] == min(cost + price[to] for _, cost, to in turns._arcs(codes, node))


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(7)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u"]
    said = ["Hello there.", "Yes!", "no end", " \t\n", "", None, "é? ", "Really? \n", "a\nb."]
    rows = []
    for conv in [None, *range(220)]:
        for turn in range(rng.randrange(1, 9)):
            at = rng.choice([turn, turn, turn, turn + 3, None, 1])
            rows += [(conv, at, rng.choice(roles), rng.choice(said))] * rng.choice([1, 1, 1, 2, 5])
    rows += [(500, t, ("user", "assistant")[t % 2], f"line {t}." if t % 7 else "line") for t in range(900)]
    rows += [(501, 4, "user", "again.")] * 300
    return rows


def test_query_rows_equal_plain_version(spark, conversations):
    frame = spark.createDataFrame([(*r, "x", 1) for r in conversations], "conv_id long, turn long, role string, text string, place string, copies int")
    got = {tuple(r) for r in turns._repaired(turns.damage(frame.repartition(5))).collect()}
    expected = {slow_conversation(c, [r[1:] for r in conversations if r[0] == c]) for c in {r[0] for r in conversations}}
    assert got == expected


def test_long_conversation_is_cut_and_joined(spark, conversations, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK_BITS", 3)
    mine = [r for r in conversations if r[0] in (500, 501)]
    frame = spark.createDataFrame(mine, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in turns._repaired(turns.damage(frame)).collect()} == {slow_conversation(c, [r[1:] for r in mine if r[0] == c]) for c in (500, 501)}


def test_undamaged_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Why?"), (1, 1, "assistant", "So."), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.audit, r.blank) for r in turns.repaired(frame).collect()}
    assert got == {1: (0, "KK", 0), 2: (4, "D", 1)}
    assert turns.repaired(frame.limit(0)).count() == 0


def test_given_table_equals_plain_version(spark):
    rows = common.table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()
    groups: dict = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(rest)
    assert {tuple(r) for r in turns.op13_conversation_repair(spark, "/root/testdata/sf0.001").collect()} == {slow_conversation(c, g) for c, g in groups.items()}
