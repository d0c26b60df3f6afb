"""Chat formatting by minimum-cost role repair (operator 6).

A legal conversation is an optional system turn, then user and assistant turns
in alternation, the last an assistant's.  Every input turn becomes a new turn,
under its own or another role, or is merged into the turn before it; empty
turns may be inserted.  Dynamic programming over the automaton whose state is
the last role finds the cheapest repair (``COSTS``), and of equal ones that with
the fewest turns.

Turns are range-partitioned by conversation and order, so a conversation of any
length is spread over partitions.  The step of a turn is a matrix of costs
between states, and steps multiply: each partition gives the product for its
first and last conversation only, the driver chains those (two a partition) and
hands every partition the states in which its conversations begin and end.
Then each partition repairs its turns and renders them.

Every input turn gives one row with a piece of the rendered conversation; the
pieces in order are the whole.

Defined results: turns are in order of turn, role and text, nulls first; a null
text is empty; unknown and null roles cost a relabel; repeated turns are turns;
turns with a null conversation are one conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.base import read, written

#: Costs of another role, of an unknown one, of a merge, and of an inserted empty turn.
COSTS = {"relabel": 3, "unknown": 2, "merge": 1, "insert": 4}
ROLES = ("", "system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: The rendered form of a turn's begin and end.
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
_FAR = (1 << 60, 0)


def _role(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(r) if (r := ALIASES.get(name, name)) in ROLES[1:] else 0


def _inserts(state: int, role: int) -> tuple[int, ...]:
    """The fewest empty turns between a turn of ``state`` and a new one of ``role``."""
    paths = [()]
    while True:
        for path in paths:
            if role in _NEXT[path[-1] if path else state]:
                return path
        paths = [(*path, x) for path in paths for x in _NEXT[path[-1] if path else state] if x != 1]
        if not paths or len(paths[0]) > 3:
            return (0,)  # cannot be reached, as system after a user


def _steps() -> dict[int, list[list[tuple[tuple[int, int], bool, tuple[int, ...]]]]]:
    """By input role, state before and state after: ((cost, new turns), merged, inserted)."""
    table = {}
    for role in range(4):
        rows = []
        for state in range(4):
            row = []
            for to in range(4):
                own = 0 if role == to else COSTS["unknown"] if role == 0 else COSTS["relabel"]
                best = (_FAR, False, ())
                if to:
                    between = _inserts(state, to)
                    if between != (0,):
                        best = ((own + COSTS["insert"] * len(between), 1 + len(between)), False, between)
                    if to == state:
                        best = min(best, ((own + COSTS["merge"], 0), True, ()), key=lambda x: x[0])
                row.append(best)
            rows.append(row)
        table[role] = rows
    return table


STEPS = _steps()
#: By state: cost and turns of what must be inserted to end there.
ENDS = [(0, 0), (2 * COSTS["insert"], 2), (COSTS["insert"], 1), (0, 0)]
_TAILS = [(), (2, 3), (3,), ()]


def _add(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return a[0] + b[0], a[1] + b[1]


def product(roles: list[int]) -> list[list[tuple[int, int]]]:
    """Least (cost, new turns) from each state to each over some turns."""
    now = [[(0, 0) if a == b else _FAR for b in range(4)] for a in range(4)]
    for role in roles:
        step = STEPS[role]
        now = [[min(_add(row[k], step[k][b][0]) for k in range(4)) for b in range(4)] for row in now]
    return now


def path(roles: list[int], begin: int, end: int | None) -> list[int]:
    """States after each turn on the best way from ``begin`` to ``end``, or to the best end of a conversation."""
    costs, back = [(0, 0) if s == begin else _FAR for s in range(4)], []
    for role in roles:
        options = [[_add(costs[k], STEPS[role][k][b][0]) for k in range(4)] for b in range(4)]
        back.append([min(range(4), key=lambda k, o=o: o[k]) for o in options])
        costs = [o[k] for o, k in zip(options, back[-1], strict=True)]
    state = min(range(4), key=lambda s: _add(costs[s], ENDS[s])) if end is None else end
    states = []
    for row in reversed(back):
        states.append(state)
        state = row[state]
    return states[::-1]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[dict]]]:
    """(part, conversation, turns) of sorted rows; a conversation's turns are those of one part."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for (part, conv), turns in groupby(rows, key=lambda r: (r["part"], r["conv_id"])):
        yield part, conv, list(turns)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), *batch.columns], ["part", "place", *batch.schema.names])
        at += n


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The products of each part's first and last conversation."""
    for part, segments in groupby(_conversations(batches), key=lambda x: x[0]):
        first = last = None
        for _, conv, turns in segments:
            last = (conv, product([_role(t["role"]) for t in turns]) if first is None else [_role(t["role"]) for t in turns])
            first = first or last
        edges = [first] if last is first else [first, (last[0], product(last[1]))]
        flat = [[x for row in m for pair in row for x in pair] for _, m in edges]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(edges), pa.int64()), pa.array([c for c, _ in edges], pa.int64()), pa.array(flat, pa.list_(pa.int64()))], ["part", "conv_id", "product"])


def _chained(edges: list[tuple]) -> dict[tuple, tuple[int, int | None, int, bool]]:
    """By (part, conversation): state before, state after (None: it ends there), turns before, and whether it goes on."""
    plan = {}
    for conv, some in groupby(sorted(edges, key=lambda e: (e[1] is not None, e[1] or 0, e[0])), key=lambda e: e[1]):
        parts = [(p, [[(m[8 * a + 2 * b], m[8 * a + 2 * b + 1]) for b in range(4)] for a in range(4)]) for p, _, m in some]
        ahead = [ENDS]
        for _, m in reversed(parts):
            ahead.append([min(_add(m[a][b], ahead[-1][b]) for b in range(4)) for a in range(4)])
        ahead.reverse()
        state, turns = 0, 0
        for k, (part, m) in enumerate(parts):
            to = min(range(4), key=lambda b: _add(m[state][b], ahead[k + 1][b]))
            plan[part, conv] = (state, to, turns, k + 1 < len(parts))
            turns += m[state][to][1]
            state = to
    return plan


_OUT = "conv_id long, turn long, role string, out_turn long, out_role string, action string, inserted int, cost int, piece string"


def repair(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) to a row for each, with its place in the repaired conversation and its piece."""
    spark = turns.sparkSession
    order = ("conv_id", "turn", "role", "text")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = written(ranged.mapInArrow(_numbered, "part long, place long, conv_id long, turn long, role string, text string"))
    parts = stored.repartition("part").sortWithinPartitions("part", "place")
    edges = parts.mapInArrow(_edges, "part long, conv_id long, product array<long>").collect()  # two rows a part at most
    held = spark.sparkContext.broadcast(_chained([tuple(e) for e in edges]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for part, conv, some in _conversations(batches):
            begin, end, number, goes_on = held.value.get((part, conv), (0, None, 0, False))
            state = begin
            for k, (t, to) in enumerate(zip(some, path([_role(t["role"]) for t in some], begin, end), strict=True)):
                role = _role(t["role"])
                (cost, new), merged, between = STEPS[role][state][to]
                number += new
                head = "\n" if merged else (CLOSE if state else "") + "".join(OPEN.format(ROLES[r]) + CLOSE for r in between) + OPEN.format(ROLES[to])
                tail, after = "", ()
                if k + 1 == len(some) and not goes_on:
                    after = _TAILS[to]
                    tail = CLOSE + "".join(OPEN.format(ROLES[r]) + CLOSE for r in after)
                action = ("merge" if merged else "new") + ("" if role == to else "+relabel")
                out.append((conv, t["turn"], t["role"], number, ROLES[to], action, len(between) + len(after), cost + COSTS["insert"] * len(after), head + (t["text"] or "") + tail))
                state = to
            if len(out) >= 2_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return parts.mapInArrow(render, _OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
    names = [c.split()[0] for c in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair(read(spark, sf_dir, "conversations"))
    return out.withColumn("piece_sha256", F.sha2(F.col("piece").cast("binary"), 256)).drop("piece")


QUERIES = {"op6_chat": op6_chat}
ORACLES: dict[str, str] = {}
