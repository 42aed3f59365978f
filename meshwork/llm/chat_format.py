"""Chat formatting with minimum-cost role repair.

The legal turns are an automaton: at first a system or user turn, after system a user turn, after user an assistant turn and after assistant a user turn; a
conversation may end after a user or assistant turn.  A turn may keep its role, be relabelled (cost 2), be merged with the turn before it (cost 1 more than its
label), or have an empty turn inserted before it (cost 3).  Dynamic programming over the automaton's states finds the repair of least cost; ties
go to the state that comes first in (system, user, assistant) and to the move that needs no insertion.

Turns are range-partitioned by (conv_id, turn, role, text), so one conversation may span any number of partitions: a partition first
gives the 4 x 4 matrix of least costs of the conversation it shares with the next ones, the driver chains these matrices (a few numbers for each partition), then
each partition runs the programme from its true entry costs, and the driver chains its backward map, before the turns are rendered.
No conversation is ever gathered as a whole; the rendered text of one is the concatenation of its chunks in order.

Defined cases: a null or unknown role must be relabelled; null text is empty; turns that repeat are turns of their own and are ordered by role and text; a null
conv_id is one conversation, ordered first, and null turns come first; a text of any length is rendered whole, in one chunk; an empty table gives an empty table; other
columns, whatever their names, don't matter.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, INSERT, INF = 1, 2, 3, 10**12
START, NEXT, ACCEPT = 3, {3: (0, 1), 0: (1,), 1: (2,), 2: (1,)}, (1, 2)
SCHEMA = "conv_id long, turn long, position long, role string, new_role string, action string, inserted string, out_turn long, chunk string"


def _moves() -> tuple[np.ndarray, dict]:
    """cost[role, p, t] of going from state p to t by a turn of the role (3: unknown), and the inserted state of the move (None: none)."""
    cost, inserted = np.full((4, 4, 4), INF, np.int64), {}
    for r in range(4):
        for p in range(4):
            for t in range(3):
                label = 0 if r == t else RELABEL
                if t in NEXT[p]:
                    cost[r, p, t] = label
                elif p == t:
                    cost[r, p, t] = label + MERGE
                else:
                    x = next((x for x in NEXT[p] if t in NEXT[x]), None)
                    if x is not None:
                        cost[r, p, t], inserted[p, t] = label + INSERT, x
    return cost, inserted


COST, INSERTED = _moves()


def forward(roles, entry: np.ndarray) -> np.ndarray:
    """costs[i] after i turns, from the entry costs (a vector, or a matrix of one vector for each entry state)."""
    out = [entry]
    for r in roles:
        out.append(np.minimum((out[-1][..., :, None] + COST[r]).min(axis=-2), INF))
    return np.array(out)


def backward(roles, costs: np.ndarray, last: int) -> list[int]:
    """The states before and after each turn of the best path that ends in last."""
    states = [last]
    for i in range(len(roles) - 1, -1, -1):
        states.append(int(np.argmin(costs[i] + COST[roles[i]][:, states[-1]])))
    return states[::-1]


def final_state(costs: np.ndarray) -> int:
    return min(ACCEPT, key=lambda s: (costs[s], s))


def _groups(batches):
    """(conv_id, rows) of each conversation of a sorted partition; the rows as lists of columns."""
    conv, held = None, None
    for batch in batches:
        cols = batch.to_pydict()
        for i in range(batch.num_rows):
            key = cols["conv_id"][i]
            if held is None or key != conv:
                if held is not None:
                    yield conv, held
                conv, held = key, []
            held.append((cols["turn"][i], cols["role"][i], cols["text"][i]))
    if held is not None:
        yield conv, held


def _code(role) -> int:
    return ROLES.index(role) if role in ROLES else 3


def _codes(group) -> list[int]:
    return [_code(role) for _, role, _ in group[1]]


def _made(states: list[int]) -> int:
    """Turns that a path of states makes, inserted ones included."""
    return sum((a != b) + ((a, b) in INSERTED) for a, b in zip(states, states[1:], strict=False))


def _entry(state: int = START) -> np.ndarray:
    return np.where(np.arange(4) == state, 0, INF).astype(np.int64)


def _ends(batches, part_of):
    """A row for the first and the last conversation of each partition: what the driver chains."""
    groups, first, last, n = _groups(batches), None, None, 0
    for conv, rows in groups:
        last, n = (conv, [_code(r) for _, r, _ in rows]), n + 1
        first = first or last
    if first:
        eye = np.where(np.eye(4, dtype=bool), 0, INF).astype(np.int64)
        for which, (conv, roles) in (("first", first), ("last", last)):
            yield pa.record_batch([pa.array([part_of()]), pa.array([which]), pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([len(roles)], pa.int64()), pa.array([forward(roles, eye)[-1].ravel().tolist()])], names=["part", "which", "conv_id", "n", "turns", "matrix"])


class Plan:
    """For each partition, of its first and last conversation: the entry costs, the position before it, and (once known) whether it goes on and its exit state."""

    def __init__(self, ends: list):
        parts = sorted({e.part for e in ends})
        by = {(e.part, e.which): e for e in ends}
        self.entry, self.before, self.goes_on, self.exit, self.parts = {}, {}, {}, {}, parts
        carry, conv, seen, running = None, None, 0, False
        for k, p in enumerate(parts):
            first, last = by[p, "first"], by[p, "last"]
            cont = running and first.conv_id == conv
            self.entry[p], self.before[p] = (carry, seen) if cont else (_entry(), 0)
            following = by[parts[k + 1], "first"].conv_id if k + 1 < len(parts) else object()
            self.goes_on[p] = k + 1 < len(parts) and following == last.conv_id
            start, done = (self.entry[p], self.before[p]) if last.n == 1 else (_entry(), 0)
            carry = np.minimum((start[:, None] + np.array(last.matrix).reshape(4, 4)).min(axis=0), INF)
            conv, seen, running = last.conv_id, done + last.turns, True

    def chain(self, maps: dict[int, list[int]]) -> None:
        """maps[p][s]: the entry state of p's first conversation when it leaves in state s (or, where it ends in p, its only entry state)."""
        nxt = None
        for p in reversed(self.parts):
            self.exit[p] = nxt if self.goes_on[p] else None
            nxt = maps[p][0 if self.exit[p] is None or maps[p][4] != 1 else self.exit[p]]


def repair(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each turn: its place, new role, what was done, the role of an empty turn inserted before it, its place in the repaired conversation and its rendered chunk."""
    spark = turns.sparkSession
    scratch = scratch or Scratch(spark, "chat")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    # one file set for each range: later passes read every range on its own, in order
    dealt.write.mode("overwrite").partitionBy("part").parquet(scratch.path("turns"))
    found = spark.read.schema("conv_id long, turn long, role string, text string, part int").parquet(scratch.path("turns"))
    n = max(1, int(found.agg(F.max("part")).first()[0] or 0) + 1)

    def ranges():
        return found.repartition(n, "part").sortWithinPartitions("part", *order)

    def cut_up(batches):
        for batch in batches:
            col = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(col)) + 1).tolist(), len(col)]
            yield from ((int(col[a]), batch.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)

    def by_part(run):
        def go(batches):
            for part, pieces in itertools.groupby(cut_up(batches), key=lambda x: x[0]):
                yield from run(part, (piece for _, piece in pieces))  # one conversation of the range is held at a time

        return go

    ends = ranges().mapInArrow(by_part(lambda p, held: _ends(held, lambda: p)), "part long, which string, conv_id long, n long, turns long, matrix array<long>")
    plan = Plan(ends.collect())  # two short rows for each partition

    def maps(p, held):
        first, last, n = None, None, 0
        for group in _groups(held):
            last, n = _codes(group), n + 1
            first = first or last
        at_first = first, plan.entry[p]
        at_last = at_first if n == 1 else (last, _entry())
        through = n == 1 and plan.goes_on[p]
        (roles, entry), costs = at_first, forward(*at_first)
        back = [backward(roles, costs, s)[0] for s in (range(4) if through else [final_state(costs[-1])] * 4)]
        costs = forward(*at_last)
        n_made = [_made(backward(at_last[0], costs, s)) for s in range(4)]
        yield pa.record_batch([pa.array([p]), pa.array([n]), pa.array([[*back, int(through)]]), pa.array([n_made])], names=["part", "n", "back", "made"])

    told = {r.part: r for r in ranges().mapInArrow(by_part(maps), "part long, n long, back array<long>, made array<long>").collect()}
    plan.chain({p: list(r.back) for p, r in told.items()})
    base, carry = {}, 0
    for p in plan.parts:
        base[p] = carry if plan.before[p] else 0
        carry = (base[p] if told[p].n == 1 else 0) + told[p].made[plan.exit[p]] if plan.goes_on[p] else 0

    def paths(p, held):
        groups = _groups(held)
        now = next(groups, None)
        at_first = True
        while now:
            conv, rows = now
            now = next(groups, None)
            roles = [_code(r) for _, r, _ in rows]
            entry, before = (plan.entry[p], plan.before[p]) if at_first else (_entry(), 0)
            costs = forward(roles, entry)
            last = plan.exit[p] if now is None and plan.goes_on[p] else final_state(costs[-1])
            yield conv, rows, roles, backward(roles, costs, last), before, now is None and plan.goes_on[p]
            at_first = False

    def render(p, held):
        out, first = [], True
        for conv, rows, roles, states, before, open_ in paths(p, held):
            out_turn = (base[p] if first else 0) - 1
            for i, ((turn, role, text), r) in enumerate(zip(rows, roles, strict=True)):
                a, b = states[i], states[i + 1]
                x = INSERTED.get((a, b))
                out_turn += (a != b) + (x is not None)
                head = "" if a == START else "\n" if a == b else "<|im_end|>\n"
                if x is not None:
                    head += f"<|im_start|>{ROLES[x]}\n<|im_end|>\n"
                if a != b:
                    head += f"<|im_start|>{ROLES[b]}\n"
                tail = "" if i + 1 < len(rows) or open_ else "<|im_end|>\n"
                action = "+".join([*(["relabel"] if r != b else []), *(["merge"] if a == b else [])]) or "keep"
                out.append((conv, turn, before + i, role, ROLES[b], action, None if x is None else ROLES[x], out_turn, head + text + tail))
                if len(out) >= 2048:
                    yield _batch(out)
                    out = []
            first = False
        yield _batch(out)

    return ranges().mapInArrow(by_part(render), SCHEMA)


_NAMES = ["conv_id", "turn", "position", "role", "new_role", "action", "inserted", "out_turn", "chunk"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]


def _batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * len(_NAMES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    return repair(table(spark, sf_dir, "conversations"))
