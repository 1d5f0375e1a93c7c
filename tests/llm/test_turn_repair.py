"""Dialogue repair against dynamic programming over whole dialogues."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from inkgate.llm import queries, turn_repair as tr

SPACE = " \t\n\x0b\x0c\r"
NEEDS, AFTER, NAMES = "uuau", (2, 2, 3, 2), {"u": "user", "a": "assistant"}


def cheapest(letters):
    """(cost, audit) of a whole dialogue, from its end on."""
    best = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    for t in reversed(letters):
        now = []
        for q in range(4):
            ways = [(3 + best[q][0], "D" + best[q][1])]
            if t != "-":
                extra, (cost, edits) = int(t.isupper()), best[AFTER[q]]
                ways.append((extra + cost, "K" + edits) if t.lower() == NEEDS[q] else (2 + extra + cost, "R" + edits))
                if t.lower() == "s" and q == 0:
                    ways.append((extra + best[1][0], "K" + best[1][1]))
            now.append(min(ways))
        for _ in range(4):
            now = [min(now[q], (2 + now[AFTER[q]][0], "I" + now[AFTER[q]][1])) for q in range(4)]
        best = now
    return best[0]


def judged(rows):
    """rows (turn, role, text) of one dialogue, not null -> the whole result."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, letters, initials, faults = set(), "", "", defaultdict(int)
    for _, role, text in rows:
        initial = role[:1] if role[:1] and role[:1] in "uas" else "x"
        initials += initial
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        faults[fault] += 1
        letters += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        seen.add((role, text))
    cost, audit = cheapest(letters)
    told, left, q = [], iter(rows), 0
    for edit in audit:
        turn, role, text = (None, "", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        role = role if edit == "K" else NAMES[NEEDS[q]]
        q = 1 if q == 0 and role[:1] == "s" else AFTER[q]
        told.append((edit, turn, role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit), told


def digest(told):
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text in told).encode()).hexdigest()


@pytest.mark.parametrize("kinds", ["uaUA-", "uasxUASX-", "us", "-"])
def test_search_finds_the_least_of_the_cheapest_edits(kinds):
    draw = random.Random(kinds)
    for _ in range(400):
        letters = "".join(draw.choice(kinds) for _ in range(draw.randrange(16)))
        cost, audit, end = tr.search(letters, tr.START, tr.CLOSING)
        assert (cost, audit + tr._CLOSING_EDITS[end]) == cheapest(letters)


def test_estimate_is_never_too_high():
    draw = random.Random(5)
    for _ in range(300):
        letters = "".join(draw.choice("uasxUASX-") for _ in range(draw.randrange(1, 10)))
        costs = tr.chunk_costs(letters)
        for q in range(4):
            for r in range(4):
                ends = tuple(0 if x == r else tr.NEVER for x in range(4))
                assert costs[4 * q + r] == tr.NEVER or tr._estimate(letters, ends)(0, q) <= costs[4 * q + r]


def dialogues(draw, sizes):
    rows = []
    for conv, size in sizes:
        for turn in range(size):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = draw.choice([f"Words {turn}.", f"words {turn}", "Again!", "", " \n", f"Ünï {turn}?\n "])
            rows.append((conv, None if draw.random() < 0.02 else turn + draw.randrange(2), role, text))
    return rows


@pytest.mark.parametrize("bits", [6, 2])
def test_repair_matches_brute_force(spark, monkeypatch, bits):
    """Dialogues longer than a chunk, and with small chunks a tree of several levels."""
    monkeypatch.setattr(tr, "CHUNK_BITS", bits)
    big = 2**60
    rows = dialogues(random.Random(bits), [(big + 1, 5), (big + 3, 90), (None, 7), (4, 300), *((i + 10, i) for i in range(1, 12))])
    extra = [(*r, "audit", 1, 2) for r in rows]
    table = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, audit string, place int, state int")
    groups = defaultdict(list)
    for conv, *rest in rows:
        groups[conv].append(tuple(rest))
    found = tr.repair(table.repartition(7))
    want = {conv: judged(held) for conv, held in groups.items()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    got = {r.conv_id: tuple(r[n] for n in names) for r in found.dialogues.collect()}
    assert got == {conv: w for conv, (w, _) in want.items()}
    told = defaultdict(list)
    for r in sorted(tr.repaired_turns(found).collect(), key=lambda r: (r.chunk, r.seq)):
        told[r.conv_id].append((r.edit, r.turn, r.role, r.text))
    assert {conv: [tuple(t) for t in w] for conv, (_, w) in want.items() if w} == dict(told)
    assert {r.conv_id: r.repaired_sha256 for r in tr.fingerprints(found).collect()} == {c: digest(w) for c, (_, w) in want.items()}


def test_odd_turns(spark):
    rows = [
        ("nulls", None, None, None),
        ("nulls", None, "user", "Hi."),
        ("ties", 1, "user", "Same."),
        ("ties", 1, "user", "Same."),
        ("ties", 1, "assistant", "Other."),
        ("long", 0, "user", "x" * 200_000 + "."),
        ("long", 2**62, "assistant", "y"),
    ]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r.conv_id: r for r in tr.repair(table).dialogues.collect()}
    assert (got["nulls"].blank, got["nulls"].gaps, got["nulls"].audit) == (1, 0, "DKI")
    # equal turns by role: the assistant's first
    assert (got["ties"].duplicate, got["ties"].illegal, got["ties"].audit) == (1, 1, "IKKDI")
    assert (got["long"].truncated, got["long"].gaps, got["long"].cost) == (1, 2**62 - 1, 1)
    none = tr.repair(table.limit(0))
    assert none.dialogues.count() == tr.fingerprints(none).count() == tr.repaired_turns(none).count() == 0


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
def test_query_matches_brute_force(spark):
    groups = defaultdict(list)
    for conv, turn, role, text in duckdb.sql(f"SELECT * FROM '{FOLDER}/conversations.parquet'").fetchall():
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = {}
    for conv, rows in groups.items():
        counts, told = judged(rows) if rows else ((0, 0, 0, 0, 0, 0, ""), [])
        want[conv] = (*counts, digest(told))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_turn_repair(spark, FOLDER).collect()}
    assert got == want
