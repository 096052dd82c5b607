"""Conversation repair against an enumeration of edits and the registered query against a plain reading of its contract."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import conversations
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
GRAMMAR = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """(cost, audit, lines) by Dijkstra over (rows read, last initial), ordered by cost and then by the audit itself."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, place, state, lines = heapq.heappop(heap)
        if (place, state) in done:
            continue
        done.add((place, state))
        if place == len(rows) and state in ("", "a"):
            return cost, audit, list(lines)
        role_of = {"u": "user", "a": "assistant"}
        for initial, after in GRAMMAR[state].items():
            if initial != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", place, after, (*lines, role_of[initial] + ":")))
        if place < len(rows):
            role, text, fault = rows[place]
            heapq.heappush(heap, (cost + 2, audit + "D", place + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] in GRAMMAR[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", place + 1, GRAMMAR[state][role[:1]], (*lines, f"{role}:{text}")))
                for initial, after in GRAMMAR[state].items():
                    if initial != "s":
                        heapq.heappush(heap, (cost + extra + 1, audit + "R", place + 1, after, (*lines, f"{role_of[initial]}:{text}")))


def expected(table, damage=True):
    """Rows of the contract from (conv_id, turn, role, text)."""
    kept, ids = defaultdict(list), set()
    for conv, turn, role, text in table:
        ids.add(conv)
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            kept[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv in ids:
        rows, seen = [], set()
        for _, _, role, text in sorted(kept[conv]):
            visible = re.findall("[^\x20\x09-\x0d]", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else None if visible[-1] in ".!?" else "truncated"
            seen.add((role, text))
            rows.append((role, text, fault))
        turns = {t for known, t, _, _ in kept[conv] if known}
        cost, audit, lines = cheapest(rows)
        faults = [f for _, _, f in rows]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def collected(frame):
    return {r[0]: tuple(r)[1:9] for r in frame.collect()}


def random_table(rng, count):
    table = []
    for conv in range(count):
        for turn in range(rng.randrange(12)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Fine.", "Yes!", "no end", " \t", "", None, f"Turn {turn}. ", f"cut {turn}"])
            table.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    return table


def test_registered_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(QUERIES["op11_repaired_conversations"](spark, SF)) == expected(table)


@pytest.mark.parametrize("stretch", [512, 3, 1])
def test_any_rows_in_one_piece_or_in_stretches(spark, stretch):
    table = random_table(random.Random(stretch), 60)
    table += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hello."), (1000, 5, None, None), (1001, 0, "user", "Same.")] + [(1001, 1, "assistant", "Again.")] * 5
    frame = spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id long, turn long, role string, text string, kind string, copies int")
    found = collected(conversations.repaired(conversations.damaged(frame), frame, stretch))
    assert found == expected(table)


def test_long_conversation_is_cut(spark):
    rng = random.Random(5)
    table = [(7, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Part {k}.", f"part {k}", "", "Same."])) for k in range(1500)]
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert collected(conversations.repaired(frame, frame)) == expected(table, damage=False)


def test_empty_tables_and_dropped_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repaired(frame, frame).collect() == []
    asked = spark.createDataFrame([(3,), (3,)], "conv_id long")
    assert collected(conversations.repaired(frame, asked)) == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("seed", range(40))
def test_auction_equals_shortest_paths(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["system", "user", "assistant", "x"]), "t", rng.choice([None, None, None, "truncated", "blank"])) for _ in range(rng.randrange(14))]
    levels = [{None: 0, "truncated": 1, "blank": 2}[f] for _, _, f in rows]
    lattice = conversations.Lattice([r[0][:1] for r in rows], levels, (0, None, None, 0))
    cost = lattice.auction(conversations.START)
    assert (cost, lattice.trace(conversations.START)[0]) == cheapest(rows)[:2]
    for node in range(lattice.end):
        assert all(lattice.price[node] <= step[2] + lattice.price[step[1]] for step in lattice.steps(node))
