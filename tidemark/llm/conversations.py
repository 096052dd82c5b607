"""Conversation structure repair: cheapest edits by an auction over prices of a small lattice, read off its tight arcs."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import ordered, running
from tidemark.session import through_table

#: White space of the contract, and the characters that may end a turn.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
_FILLED = re.compile("[^" + BLANKS + "]")
#: States of the repaired role initials `(s?(ua)+)?`: nothing yet, after s, after u, after a. An added or renamed turn has
#: one possible role in each state.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
KEEP, RENAME, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: Faults of a row in the lattice.
SOUND, TRUNCATED, UNUSABLE = 0, 1, 2
#: Turns of one lattice; longer conversations are solved in stretches of as many. Bytes of a conversation repaired in one
#: piece, and of a task's group of conversations.
STRETCH, PIECE_BYTES, GROUP_BYTES, GROUP_TURNS = 512, 8 << 20, 16 << 20, 4096

Step = tuple[str, int, int]


class Lattice:
    """Turns x states: node 4 i + q stands before turn i in state q, and one more node ends the conversation at the price of
    its last state in `exits` (None: no end there)."""

    def __init__(self, initials: Sequence[str], faults: Sequence[int], exits: Sequence[int | None]) -> None:
        self.initials, self.faults, self.exits = initials, faults, exits
        self.size = len(initials)
        self.end = 4 * self.size + 4
        self.known: dict[int, list[Step]] = {}
        # A turn costs its cheapest edit at least, so these prices rise along no arc by more than it costs.
        ahead = min(x for x in exits if x is not None)
        self.price = [0] * (self.end + 1)
        for i in range(self.size, -1, -1):
            if i < self.size:
                ahead += DELETE if faults[i] else KEEP
            self.price[4 * i:4 * i + 4] = [ahead] * 4

    def steps(self, node: int) -> list[Step]:
        """(edit, next node, cost), in the order of the edits' initials."""
        found = self.known.get(node)
        if found is None:
            i, state = divmod(node, 4)
            found = []
            if i < self.size:
                found.append(("D", node + 4, DELETE))
            elif self.exits[state] is not None:
                found.append(("", self.end, self.exits[state]))
            found.append(("I", 4 * i + NEXT[state], INSERT))
            if i < self.size and self.faults[i] != UNUSABLE:
                more = CUT_OFF * self.faults[i]
                kept = AFTER.get((state, self.initials[i]))
                if kept is not None:
                    found.append(("K", 4 * i + 4 + kept, KEEP + more))
                found.append(("R", 4 * i + 4 + NEXT[state], RENAME + more))
            self.known[node] = found
        return found

    def auction(self, start: int) -> int:
        """Cost from `start` to the end: a path grows along its last node's best arc while that node's price is met, else the
        price rises to the best offer and the path loses the node. No price ever exceeds what an arc asks plus its head's."""
        price, end, path = self.price, self.end, [start]
        while path[-1] != end:
            node = path[-1]
            offer, head = min((cost + price[to], to) for _, to, cost in self.steps(node))
            if price[node] < offer:
                price[node] = offer
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        return price[start]

    def _tight(self, node: int) -> Iterator[Step]:
        price = self.price
        return (step for step in self.steps(node) if price[node] == step[2] + price[step[1]])

    def trace(self, start: int) -> tuple[str, int]:
        """(ASCII-least initials of the cheapest edits, last state): after an auction from `start` all cheapest paths are made
        of tight arcs, and the least of them follows the least initial whose arc still leads to the end."""
        leads = [False] * (self.end + 1)
        leads[self.end] = True
        for i in range(self.size, start // 4 - 1, -1):
            tight = {node: list(self._tight(node)) for node in range(4 * i, 4 * i + 4)}
            # Insertions stay at their turn: three rounds follow any chain of them.
            for _ in range(4):
                for node, steps in tight.items():
                    leads[node] = leads[node] or any(leads[to] for _, to, _ in steps)
        letters, node = [], start
        while True:
            letter, to, _ = next(step for step in self._tight(node) if leads[step[1]])
            if to == self.end:
                return "".join(letters), node % 4
            letters.append(letter)
            node = to


def fault_of(text: str, seen: bool) -> str | None:
    """First fault of a turn."""
    if not _FILLED.search(text):
        return "blank"
    if seen:
        return "duplicate"
    return None if text.rstrip(BLANKS)[-1] in ENDS else "truncated"


def repaired_lines(audit: str, state: int, turns: Sequence[tuple[str, str]]) -> list[str]:
    """`role:text` of what the edits leave, from a state on."""
    lines, place = [], 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            lines.append(ROLE_OF[state] + ":")
            continue
        role, text = turns[place]
        place += 1
        if letter == "D":
            continue
        state = AFTER[state, role[:1]] if letter == "K" else NEXT[state]
        lines.append(f"{role if letter == 'K' else ROLE_OF[state]}:{text}")
    return lines


def repair_turns(turns: Sequence[tuple[str, str]]) -> dict[str, object]:
    """Faults, cheapest edits and digest of one conversation, whose (role, text) are in order."""
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    seen: set[tuple[str, str]] = set()
    faults = []
    for turn in turns:
        fault = fault_of(turn[1], turn in seen)
        seen.add(turn)
        if fault:
            counts[fault] += 1
        faults.append(SOUND if fault is None else TRUNCATED if fault == "truncated" else UNUSABLE)
    initials = [role[:1] for role, _ in turns]
    lattice = Lattice(initials, faults, (0, None, None, 0))
    cost = lattice.auction(START)
    audit, _ = lattice.trace(START)
    text = "\n".join(repaired_lines(audit, START, turns))
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return counts | {"illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()}


def crossing_costs(initials: Sequence[str], faults: Sequence[int]) -> list[int | None]:
    """Cost from each first state of a stretch to each last state, row by row; None where no edits lead there."""
    system = any(x == "s" and fault != UNUSABLE for x, fault in zip(initials, faults, strict=True))
    possible = {START: (START, USER, ASSISTANT, *((SYSTEM,) if system else ())), SYSTEM: (SYSTEM, USER, ASSISTANT)}
    costs: list[int | None] = []
    for first in range(4):
        for last in range(4):
            reached = last in possible.get(first, (USER, ASSISTANT))
            costs.append(Lattice(initials, faults, [0 if q == last else None for q in range(4)]).auction(first) if reached else None)
    return costs


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's planted faults, chosen by crc32 of `conv_id:turn` modulo 20; nulls in any column become one space there
    and in role and text."""
    def shown(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.where("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def repaired(turns: DataFrame, conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per distinct conv_id of `conversations`: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are read in order of turn (null first), then role and text, so that equal turns and ties have one order; a row that
    repeats is a turn each time. Null roles and texts count as one space. Null conv_ids are one conversation. An empty text is
    blank; a conversation without turns has zeros, an empty audit and the digest of nothing. Other columns play no part.

    A conversation of up to `stretch` turns is repaired in one piece. Longer ones are cut: each stretch gives its cost from
    every first to every last state, these are summed from the end into the prices at the cuts, auctions inside the stretches
    against those prices give the edits from every first state, and the stretches are chained. A long conversation never
    meets in a task but for one short row per stretch, its audit and its digest, which is fed stretch by stretch."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")}
    rows = turns.select(key, F.col("turn").cast("long").alias("turn"), shown["role"].alias("role"), shown["text"].alias("text"))
    # Equal rows are one row with a number, however many there are.
    rows = through_table(rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")), "turns")
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("turns"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    sizes = sizes.withColumn("long", (F.col("turns") > stretch) | (F.col("bytes") > PIECE_BYTES))
    total = sizes.agg(F.sum("turns"), F.sum("bytes"), F.max("long")).first()
    groups = max(1, math.ceil((total[0] or 0) / GROUP_TURNS), math.ceil((total[1] or 0) / GROUP_BYTES))
    short = rows
    if total[2]:
        long = through_table(sizes.where("long").select("conv"), "long-conversations")
        short = rows.join(long, "conv", "left_anti")

    def repair(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for conv, part in frame.groupby("conv", sort=False):
            # Missing turns come first; ids and turns stay exact integers.
            order = sorted((0, 0, role, text, copies) if turn is None else (1, int(turn), role, text, copies) for turn, role, text, copies in
                           zip(part["turn"], part["role"], part["text"], part["copies"], strict=True))
            known = {turn for has, turn, *_ in order if has}
            result = repair_turns([(role, text) for _, _, role, text, copies in order for _ in range(copies)])
            out.append({"conv": conv, "gaps": max(known) - min(known) + 1 - len(known) if known else 0} | result)
        return pd.DataFrame(out)

    results = "conv string, " + SCHEMA.split(", ", 1)[1]
    group = F.pmod(F.xxhash64("conv"), F.lit(groups)).alias("group")
    # Decimals reach pandas as objects: a null among longs would turn them into floats.
    done = short.select(group, "conv", F.col("turn").cast("decimal(20,0)").alias("turn"), "role", "text", "copies").groupBy("group").applyInPandas(repair, results)
    if total[2]:
        done = done.unionByName(_repaired_long(rows.join(long, "conv", "left_semi"), stretch))
    asked = conversations.select("conv_id", key).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return asked.join(done, "conv", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                                                   F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256"))


def _repaired_long(rows: DataFrame, stretch: int) -> DataFrame:
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy("conv", "role", "text").agg(F.min(when).alias("first"))
    rows = rows.join(firsts, ["conv", "role", "text"]).withColumn("seen", when != F.col("first")).withColumn("known", F.col("turn").isNotNull())
    placed = running(ordered(rows, ["conv"], ["known", "turn", "role", "text"]), {"before": ("sum", "copies")}, exclusive=True).result()
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    last = F.substring(F.expr(r"trim(TRAILING ' \t\n\u000b\f\r' FROM text)"), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("seen") | (F.col("copy") > 0), "duplicate").when(~last.isin(*ENDS), "truncated")
    position = F.coalesce("before", F.lit(0)) + F.col("copy")
    placed = placed.select("conv", "turn", position.alias("position"), F.floor(position / stretch).alias("stretch"), fault.alias("fault"), "role", "text")
    level = F.when(F.col("fault").isNull(), SOUND).when(F.col("fault") == "truncated", TRUNCATED).otherwise(UNUSABLE)
    placed = through_table(placed.select("conv", "turn", "position", "stretch", "fault", level.alias("level"), "role",
                                         F.when(level != UNUSABLE, F.col("text")).alias("text"), F.substring("role", 1, 1).alias("initial")), "long-turns")
    codes = placed.select("conv", "stretch", "position", "initial", "level")
    at = ["conv", "stretch"]

    def sorted_codes(frame: pd.DataFrame) -> tuple[list[str], list[int]]:
        frame = frame.sort_values("position")
        return frame["initial"].to_list(), frame["level"].to_list()

    def cross(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        initials, levels = sorted_codes(frame)
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        costs = [-1 if c is None else c for c in crossing_costs(initials, levels)]
        return pd.DataFrame({"conv": [key[0]], "stretch": [key[1]], "costs": [costs], "illegal": [illegal], "head": [initials[0]], "tail": [initials[-1]]})

    crossed = through_table(codes.groupBy(at).applyInPandas(
        cross, "conv string, stretch long, costs array<long>, illegal long, head string, tail string"), "crossed-stretches")

    def price(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Cost to the end from each state after each stretch."""
        frame = frame.sort_values("stretch", ascending=False)
        ahead: list[int | None] = [0, None, None, 0]
        out = []
        for costs in frame["costs"]:
            out.append([-1 if x is None else x for x in ahead])
            ahead = [min((int(costs[4 * q + x]) + ahead[x] for x in range(4) if ahead[x] is not None and costs[4 * q + x] >= 0), default=None) for q in range(4)]
        seams = sum(a + b not in LEGAL for a, b in zip(frame["tail"].iloc[1:], frame["head"], strict=False))
        return pd.DataFrame({"conv": key[0], "stretch": frame["stretch"], "exits": out, "cost": ahead[START], "illegal": int(frame["illegal"].sum()) + seams})

    priced = through_table(crossed.groupBy("conv").applyInPandas(
        price, "conv string, stretch long, exits array<long>, cost long, illegal long"), "priced-stretches")

    def edit(key: tuple, frame: pd.DataFrame, price: pd.DataFrame) -> pd.DataFrame:
        initials, levels = sorted_codes(frame)
        exits = [None if x < 0 else int(x) for x in price["exits"].iloc[0]]
        out = []
        for first in range(4):
            lattice = Lattice(initials, levels, exits)
            lattice.auction(first)
            out.append((*key, first, *lattice.trace(first)))
        return pd.DataFrame(out, columns=["conv", "stretch", "first", "audit", "last"])

    edited = through_table(codes.groupBy(at).cogroup(priced.groupBy(at)).applyInPandas(
        edit, "conv string, stretch long, first int, audit string, last int"), "edited-stretches")

    def chain(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        last = dict(zip(zip(frame["stretch"], frame["first"], strict=True), frame["last"], strict=True))
        state, out = START, []
        for stretch in sorted(frame["stretch"].unique()):
            out.append((key[0], stretch, state))
            state = last[stretch, state]
        return pd.DataFrame(out, columns=["conv", "stretch", "first"])

    chosen = edited.select("conv", "stretch", "first", "last").groupBy("conv").applyInPandas(chain, "conv string, stretch long, first int")
    chosen = through_table(edited.join(chosen, ["conv", "stretch", "first"]).select("conv", "stretch", "first", "audit"), "chosen-edits")

    def write(key: tuple, frame: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        lines = repaired_lines(edits["audit"].iloc[0], int(edits["first"].iloc[0]), list(zip(frame["role"], frame["text"], strict=True)))
        return pd.DataFrame({"conv": [key[0]], "stretch": [key[1]], "lines": [len(lines)], "piece": ["\n".join(lines)]})

    pieces = placed.select("conv", "stretch", "position", "role", "text").groupBy(at).cogroup(chosen.groupBy(at)).applyInPandas(
        write, "conv string, stretch long, lines long, piece string")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, hashed, begun = None, None, False
        for batch in batches:
            for name, lines, piece in zip(batch["conv"], batch["lines"], batch["piece"], strict=True):
                if name != conv:
                    if hashed:
                        yield pd.DataFrame({"conv": [conv], "repaired_sha256": [hashed.hexdigest()]})
                    conv, hashed, begun = name, hashlib.sha256(), False
                if lines:
                    hashed.update((("\n" if begun else "") + piece).encode("utf-8", "replace"))
                    begun = True
        if hashed:
            yield pd.DataFrame({"conv": [conv], "repaired_sha256": [hashed.hexdigest()]})

    digests = pieces.repartition("conv").sortWithinPartitions("conv", "stretch").mapInPandas(digest, "conv string, repaired_sha256 string")
    audits = chosen.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    faults = placed.groupBy("conv").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    spans = placed.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    return faults.join(spans, "conv", "left").join(priced.where("stretch = 0").select("conv", "cost", "illegal"), "conv").join(audits, "conv").join(
        digests, "conv").select("conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
