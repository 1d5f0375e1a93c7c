"""Repair of dialogue structure by iterative-deepening A* over edits of turns.

The gate has no dialogues of its own: this operator is general. It takes turns
(``conv_id, turn, role, text``), finds their faults and the cheapest edits that make each dialogue
an optional system turn and alternating user and assistant turns.

Turns are numbered in order and cut into chunks of at most ``CHUNK_TURNS``. A dialogue inside one
chunk is one search. A longer one is searched chunk by chunk: first the cost of every chunk from
each state of the pattern to each other, folded up a tree of chunks; then down the tree what is
left to pay behind each chunk; then each chunk's edits under that price. The edits are those of
one search over the whole dialogue, and no dialogue is gathered in one task for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgate.llm.common import ASCII_SPACE, slices
from inkgate.session import cut

CHUNK_BITS = 6
CHUNK_TURNS = 1 << CHUNK_BITS

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# ---- the search ------------------------------------------------------------------------------
#
# A turn is a letter: u, a, s for its role or x for any other, upper case when its text is
# truncated, - when it must go. States of the pattern (s?(ua)+)?: nothing yet, after the system
# turn, after a user turn, after an assistant turn.

START, SYSTEM, USER, ASSISTANT = range(4)
_NEEDS = "uuau"
_AFTER = (USER, USER, ASSISTANT, USER)
NEVER = 1 << 40
# What the end of a dialogue costs in each state, and the edits for it.
CLOSING = (0, 2 * INSERT, INSERT, 0)
_CLOSING_EDITS = ("", "II", "I", "")


def _estimate(turns: str, ends: tuple[int, ...]) -> Callable[[int, int], int]:
    """(turn, state) -> a cost that no way to the end of ``turns`` undercuts.

    Every turn that must go costs a deletion and every truncated one at least 1. A turn of another
    role costs at least 2, but for one system turn while nothing is kept yet. In a run of k + 1 turns
    of one role each edit mends at most two of the k repetitions.
    """
    n, least = len(turns), min(ends)
    faults, strange, following, repeats, later, system = ([0] * (n + 1) for _ in range(6))
    following[n] = n
    for i in range(n - 1, -1, -1):
        t = turns[i]
        faults[i] = faults[i + 1] + (DELETE if t == "-" else TRUNCATED if t.isupper() else 0)
        strange[i] = strange[i + 1]
        system[i] = system[i + 1] or t.lower() == "s"
        if t == "-":
            following[i] = following[i + 1]
            continue
        following[i] = i
        role, next_turn = t.lower(), following[i + 1]
        if next_turn < n:
            later[i] = later[next_turn]
            if turns[next_turn].lower() in "ua":
                if turns[next_turn].lower() == role:
                    repeats[i] = repeats[next_turn] + 1
                else:
                    later[i] += 2 * ((repeats[next_turn] + 1) // 2)
        if role not in "ua":
            strange[i] += 2

    def cost(i: int, state: int) -> int:
        if i == n:
            return ends[state]
        at = following[i]
        total = faults[i] + strange[i] + least
        if at == n:
            return total
        if state == START and system[i]:
            total -= 2
        role = turns[at].lower()
        if role in "ua":
            return total + later[at] + 2 * ((repeats[at] + (role != _NEEDS[state]) + 1) // 2)
        return total + later[at]

    return cost


def search(turns: str, state: int, ends: tuple[int, ...]) -> tuple[int, str, int]:
    """(cost, edits, state at the end) of the cheapest edits of ``turns``; the ASCII-least of these.

    Depth first in the order D, I, K, R under a bound that grows from the estimate; a state that
    failed keeps the cost it was proven to exceed and is not entered again below that.
    ``ends`` is what comes behind, by state; NEVER where no way may end.
    """
    n = len(turns)
    estimate = _estimate(turns, ends)
    proven: dict[tuple[int, int], int] = {}

    def at_least(i: int, q: int) -> int:
        known = proven.get((i, q))
        if known is None:
            known = proven[i, q] = estimate(i, q)
        return known

    edits: list[str] = []

    def steps(i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        t = turns[i]
        yield "D", DELETE, i + 1, q
        yield "I", INSERT, i, _AFTER[q]
        if t != "-":
            role, extra = t.lower(), TRUNCATED if t.isupper() else 0
            if role == _NEEDS[q]:
                yield "K", KEEP + extra, i + 1, _AFTER[q]
            else:
                if role == "s" and q == START:
                    yield "K", KEEP + extra, i + 1, SYSTEM
                yield "R", REROLE + extra, i + 1, _AFTER[q]

    def go(i: int, q: int, left: int) -> int | None:
        """The state at the end of a way of cost ``left`` at most, whose edits are appended."""
        if i == n:
            return q
        best = NEVER
        for edit, price, j, r in steps(i, q):
            rest = at_least(j, r)
            if price + rest <= left:
                edits.append(edit)
                end = go(j, r, left - price)
                if end is not None:
                    return end
                edits.pop()
                rest = at_least(j, r)
            best = min(best, price + rest)
        proven[i, q] = max(proven[i, q], best)
        return None

    while True:
        bound = at_least(0, state)
        if bound >= NEVER:
            return NEVER, "", state
        end = go(0, state, bound)
        if end is not None:
            return bound, "".join(edits), end


def chunk_costs(turns: str) -> list[int]:
    """The cheapest way through a chunk from each state to each state, row by row."""
    out = []
    for q in range(4):
        for r in range(4):
            possible = r > SYSTEM or (r == START and q == START) or (r == SYSTEM and (q == SYSTEM or (q == START and "s" in turns.lower())))
            ends = tuple(0 if x == r else NEVER for x in range(4))
            out.append(search(turns, q, ends)[0] if possible else NEVER)
    return out


def _through(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


# ---- turns, faults and chunks ----------------------------------------------------------------

_NAMES = {"u": "user", "a": "assistant"}


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("u", "a", "s"), first).otherwise("x")


def numbered(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns in order with ``place``, counted from 0 over all dialogues; written once.

    Ranges of (dialogue, turn, ...) are dealt to tasks, so a long dialogue lies in several.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    # the starts of role and text are enough to deal by; what is still equal goes by its hash
    order = ["conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32), F.xxhash64("role", "text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(dealt.withColumn("at", F.monotonically_increasing_id()), "turns")
    task = F.shiftright("at", 33)
    sizes = sorted(held.groupBy(task.alias("task")).count().collect())  # one row a task
    firsts, total = [], 0
    for row in sizes:
        firsts.append((row["task"], total))
        total += row["count"]
    bases = held.sparkSession.createDataFrame(firsts, "task long, first long")
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        held.join(F.broadcast(bases), task == F.col("task"))
        .withColumn("place", F.col("first") + within)
        .drop("at", "task", "first")
        .withColumn("chunk", F.shiftright("place", CHUNK_BITS))
    )


def _with_faults(rows: DataFrame) -> DataFrame:
    """Narrow rows (conv_id, turn, chunk, place, initial, fault); texts stay behind.

    Only role and text that occur more than once in a dialogue meet the rows again.
    """
    last = F.expr(f"right(rtrim('{ASCII_SPACE}', text), 1)")
    narrow = rows.select(
        "conv_id",
        "turn",
        "chunk",
        "place",
        _initial(F.col("role")).alias("initial"),
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(~last.isin(".", "!", "?"), "truncated").alias("own"),
        F.unhex(F.sha2(F.concat(F.sha2("role", 256), F.lit(":"), "text").cast("binary"), 256)).alias("digest"),
    )
    narrow = cut(narrow, "faults")
    repeated = (
        narrow.groupBy("conv_id", "digest")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("conv_id").alias("of"), F.col("digest").alias("same"), "first")
    )
    met = narrow.join(repeated, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("place") > F.col("first"), "duplicate").otherwise(F.col("own"))
    return met.select("conv_id", "turn", "chunk", "place", "initial", fault.alias("fault"))


def _chunks(faulty: DataFrame) -> DataFrame:
    """(conv_id, chunk, letters, initials): at most CHUNK_TURNS turns to a row."""
    letter = (
        F.when(F.col("fault").isin("blank", "duplicate"), "-")
        .when(F.col("fault") == "truncated", F.upper("initial"))
        .otherwise(F.col("initial"))
    )
    turns = F.array_sort(F.collect_list(F.struct("place", letter.alias("letter"), "initial")))
    found = faulty.groupBy("conv_id", "chunk").agg(turns.alias("t"))
    return found.select(
        "conv_id",
        "chunk",
        F.array_join("t.letter", "").alias("letters"),
        F.array_join("t.initial", "").alias("initials"),
    )


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def _map_chunks(chunks: DataFrame, schema: str, run: Callable[..., list]) -> DataFrame:
    """``run(letters, initials, ...)`` -> the columns of ``schema``, added to the chunks."""
    given = chunks.columns
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields]
    types = [pa.int64() if c.split()[1] == "long" else pa.string() if c.split()[1] == "string" else pa.list_(pa.string() if "string" in c else pa.int64()) for c in schema.split(", ")]
    added = [c.split()[0] for c in schema.split(", ")]
    inputs = [c for c in given if c not in ("conv_id", "chunk", "conv", "node", "top")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list] = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in inputs]
            found = []
            for values in zip(*columns, strict=True):
                key = tuple(tuple(v) if isinstance(v, list) else v for v in values)
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = run(*key)
                found.append(known[key])
            out = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*given, *added])

    return chunks.mapInArrow(each, ", ".join([*kept, schema]))


# ---- dialogues longer than a chunk: a tree of chunks ------------------------------------------


def _grouped(level: DataFrame, schema: str, run: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``run`` on the children of each parent, at most CHUNK_TURNS, in their order."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        return run(rows.sort_values("node"))

    return level.withColumn("parent", F.shiftright("node", CHUNK_BITS)).groupBy("conv", "parent").applyInPandas(each, schema)


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    whole, illegal, last = None, 0, ""
    for costs, first, end, inside in zip(rows["costs"], rows["first"], rows["last"], rows["illegal"], strict=True):
        costs = np.asarray(costs, np.int64).reshape(4, 4)
        whole = costs if whole is None else _through(whole, costs)
        illegal += int(inside) + (_illegal(last + first) if last else 0)
        last = end
    head = rows.iloc[0]
    return pd.DataFrame(
        {"conv": [head["conv"]], "node": [head["parent"]], "costs": [whole.ravel().tolist()], "first": [head["first"]], "last": [last], "illegal": [illegal]}
    )


def _prices(rows: pd.DataFrame) -> pd.DataFrame:
    """What is left to pay behind each child, from what is left behind the parent."""
    behind, out = np.asarray(rows["behind"].iloc[0], np.int64), []
    for costs in reversed(list(rows["costs"])):
        out.append(behind.tolist())
        behind = np.minimum((np.asarray(costs, np.int64).reshape(4, 4) + behind[None, :]).min(axis=1), NEVER)
    return pd.DataFrame({"conv": rows["conv"], "node": rows["node"], "ends": out[::-1]})


def _moves(rows: pd.DataFrame) -> pd.DataFrame:
    to = list(range(4))
    for step in rows["moves"]:
        to = [int(step[q]) for q in to]
    head = rows.iloc[0]
    return pd.DataFrame({"conv": [head["conv"]], "node": [head["parent"]], "moves": [to]})


def _states(rows: pd.DataFrame) -> pd.DataFrame:
    state, out = int(rows["came"].iloc[0]), []
    for step in rows["moves"]:
        out.append(state)
        state = int(step[state])
    return pd.DataFrame({"conv": rows["conv"], "node": rows["node"], "state": out})


def _tree(leaves: DataFrame, height: int, schema: str, fold) -> list[DataFrame]:
    levels = [leaves]
    for _ in range(height):
        levels.append(cut(_grouped(levels[-1], schema, fold), "level"))
    return levels


def _down(levels: list[DataFrame], top: Column, name: str, given: str, schema: str, run) -> DataFrame:
    """From a value at the roots to one for every leaf, level by level."""
    now = levels[-1].select("conv", "node", top.alias(name))
    for level in reversed(levels[:-1]):
        parents = now.select("conv", F.col("node").alias("parent_node"), F.col(name).alias(given))
        children = level.withColumn("parent_node", F.shiftright("node", CHUNK_BITS)).join(parents, ["conv", "parent_node"])
        now = cut(_grouped(children.drop("parent_node"), schema, run), "down")
    return now


def _long_audits(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of dialogues with several: their edits, and (conv, cost, illegal) of the dialogues."""
    costs = _map_chunks(
        long.select("conv", "node", "letters", "initials"),
        "costs array<long>, first string, last string, illegal long",
        lambda letters, initials: [chunk_costs(letters), initials[0], initials[-1], _illegal(initials)],
    )
    leaves = cut(costs.select("conv", "node", "costs", "first", "last", "illegal"), "costs")
    widest = leaves.agg(F.max("node")).first()[0] or 0
    height = -(-widest.bit_length() // CHUNK_BITS)
    levels = _tree(leaves, height, "conv long, node long, costs array<long>, first string, last string, illegal long", _fold)
    roots = levels[-1]
    closing = F.array(*[F.lit(c).cast("long") for c in CLOSING])
    behind = _down(levels, closing, "ends", "behind", "conv long, node long, ends array<long>", _prices)
    total = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.get("costs", q) + F.get(closing, q)))
    dialogues = roots.select("conv", total.alias("cost"), "illegal")

    def ways(letters: str, ends: tuple[int, ...]) -> list:
        found = [search(letters, q, ends) for q in range(4)]
        return [[edits for _, edits, _ in found], [end for _, _, end in found]]

    priced = long.select("conv", "node", "letters").join(behind, ["conv", "node"])
    searched = cut(_map_chunks(priced, "edits array<string>, moves array<long>", ways), "ways")
    levels = _tree(searched.select("conv", "node", "moves"), height, "conv long, node long, moves array<long>", _moves)
    start = F.lit(START).cast("long")
    states = _down(levels, start, "state", "came", "conv long, node long, state long", _states)
    audits = (
        long.select("conv_id", "chunk", "conv", "node", "top")
        .join(searched.select("conv", "node", "edits", "moves"), ["conv", "node"])
        .join(states, ["conv", "node"])
        .withColumn("end", F.get("moves", F.col("state").cast("int")))
        .withColumn("closing", F.when(F.col("node") == F.col("top"), F.get(F.array(*map(F.lit, _CLOSING_EDITS)), F.col("end").cast("int"))).otherwise(""))
        .select("conv_id", "chunk", "state", F.concat(F.get("edits", F.col("state").cast("int")), "closing").alias("audit"))
    )
    return audits, dialogues


# ---- the operator ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Repair:
    """``dialogues``: one row each, see ``repair``; ``audits`` (conv_id, chunk, state, audit): the
    edits of each chunk of turns; ``turns``: the turns in order, with place and chunk."""

    dialogues: DataFrame
    audits: DataFrame
    turns: DataFrame


def repair(
    turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repair:
    """Faults of every dialogue and the cheapest edits that give it its structure.

    A turn's first fault counts: ``blank`` (ASCII white space only), ``duplicate`` (role and text
    came earlier in the dialogue), ``truncated`` (the last character is none of ``. ! ?``). Keeping
    a turn costs 0, giving it the role user or assistant 2, deleting it 3 (required for blank and
    duplicate), inserting an empty turn 2; each truncated turn that stays adds 1. The initials of
    the roles must come to ``(s?(ua)+)?``.

    ``dialogues`` has conv_id, n_turns, gaps (missing turn numbers), blank, duplicate, truncated,
    illegal (neighbours other than su, ua, au), cost, audit (K, R, D, I in order; of several
    cheapest the ASCII-least).

    Turns go by number, null ones first, equal ones by role and text. Null roles and texts are one
    space, a null dialogue is one of its own. Repeated rows are duplicates. No rows in, no rows
    out. Other columns are ignored. An audit is one string, so that of a dialogue is gathered;
    everything else handles chunks.
    """
    rows = numbered(turns, conv_id, turn, role, text)
    faulty = cut(_with_faults(rows), "faulty")
    counts = faulty.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        F.min("place").alias("conv"),
        F.min("chunk").alias("bottom"),
        (F.max("chunk") - F.min("chunk")).alias("top"),
    )
    counts = cut(counts, "dialogues")
    chunks = cut(_chunks(faulty), "chunks")
    known = counts.select(F.col("conv_id").alias("of"), "conv", "bottom", "top")
    placed = chunks.join(known, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("node", F.col("chunk") - F.col("bottom"))

    def whole(letters: str, initials: str) -> list:
        cost, edits, end = search(letters, START, CLOSING)
        return [START, edits + _CLOSING_EDITS[end], cost, _illegal(initials)]

    short = placed.where("top = 0").select("conv_id", "chunk", "conv", "letters", "initials")
    solved = cut(_map_chunks(short, "state long, audit string, cost long, illegal long", whole), "short")
    long = cut(placed.where("top > 0").select("conv_id", "chunk", "conv", "node", "top", "letters", "initials"), "long")
    audits = solved.select("conv_id", "chunk", "state", "audit")
    priced = solved.select("conv", "cost", "illegal", "audit")
    if not long.isEmpty():
        found, dialogues = _long_audits(long)
        found = cut(found, "audits")
        audits = audits.unionByName(found)
        conv = long.select("conv", F.col("conv_id").alias("of")).distinct()
        strings = (
            found.groupBy("conv_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda a: a["audit"]), "").alias("audit"))
            .join(conv, F.col("conv_id").eqNullSafe(F.col("of")))
        )
        priced = priced.unionByName(dialogues.join(strings, "conv").select("conv", "cost", "illegal", "audit"))
    dialogues = counts.join(priced, "conv").select(
        "conv_id", "n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    return Repair(dialogues, audits, rows)


def _side_by_side(found: Repair, *keys: str) -> DataFrame:
    """Every chunk's edits and behind them its turns, by one shuffle and a sort inside tasks."""
    nothing = F.lit(None)
    rows = found.turns.select("conv_id", "chunk", "place", "turn", "role", "text", nothing.cast("string").alias("audit"), nothing.cast("long").alias("state"))
    heads = found.audits.select(
        "conv_id", "chunk", F.lit(-1).cast("long").alias("place"), nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"),
        nothing.cast("string").alias("text"), "audit", "state",
    )
    return rows.unionByName(heads).repartition(*keys).sortWithinPartitions("conv_id", "chunk", "place")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, chunk, edit, turn, role, text) in order, from rows as ``_side_by_side`` sorts them.

    Every chunk begins with a row without an edit.
    """
    audit, at, state = "", 0, START
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "chunk", "turn", "role", "text", "audit", "state")]
        for conv, chunk, turn, role, text, edits, first in zip(*columns, strict=True):
            if edits is not None:
                audit, at, state = edits, 0, first
                yield conv, chunk, None, None, None, None
            else:
                edit, at = audit[at], at + 1
                if edit == "R":
                    role = _NAMES[_NEEDS[state]]
                if edit != "D":
                    state = SYSTEM if state == START and role[:1] == "s" else _AFTER[state]
                yield conv, chunk, edit, turn, role, text
            while at < len(audit) and audit[at] == "I":
                yield conv, chunk, "I", None, _NAMES[_NEEDS[state]], ""
                state, at = _AFTER[state], at + 1


def _with_kind(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    """The Arrow type of the dialogues' ids, and the batches."""
    first = next(batches, None)
    if first is None:
        return None, iter(())
    return first.schema.field("conv_id").type, chain([first], batches)


def repaired_turns(found: Repair) -> DataFrame:
    """The repaired dialogues: conv_id, chunk, seq, edit, turn, role, text, without deleted turns.

    (chunk, seq) is the order of a dialogue's turns; inserted ones have neither number nor text.
    """
    fields = ["conv_id", "chunk", "seq", "edit", "turn", "role", "text"]
    kind = found.turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, batches = _with_kind(batches)
        types = [conv_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def in_turn():
            seq = 0
            for conv, chunk, edit, *rest in _edited(batches):
                seq = 0 if edit is None else seq + 1
                if edit not in (None, "D"):
                    yield conv, chunk, seq, edit, *rest

        for part in slices(in_turn(), lambda r: len(r[-1]) + 200, 1_000_000):
            columns = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=fields)

    schema = f"conv_id {kind}, chunk long, seq long, edit string, turn long, role string, text string"
    return _side_by_side(found, "conv_id", "chunk").mapInArrow(run, schema)


def fingerprints(found: Repair) -> DataFrame:
    """(conv_id, repaired_sha256): of ``role:text`` of the repaired turns, joined by newlines.

    A digest is taken in order, so a dialogue's turns pass one task; they are streamed, and what
    is held is the digest.
    """
    kind = found.turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, batches = _with_kind(batches)

        def digests():
            for conv, turns in groupby(_edited(batches), lambda r: r[0]):
                digest, before = hashlib.sha256(), b""
                for _, _, edit, _, role, text in turns:
                    if edit not in (None, "D"):
                        digest.update(before + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                        before = b"\n"
                yield conv, digest.hexdigest()

        for part in slices(digests(), lambda r: 1, 10_000):
            ids, found = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, conv_type), pa.array(found)], names=["conv_id", "repaired_sha256"])

    return _side_by_side(found, "conv_id").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
