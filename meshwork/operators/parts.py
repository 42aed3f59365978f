"""Rounds over undirected graphs by parts: ranges of ids, each of them one row with the arcs of its vertices.

Arcs are shuffled and written once, by part.  A round is one shuffle of values: a part sends those of its vertices that have neighbours in other parts, an array to each of these parts, and keeps
its own; so a round moves at most the lesser of the arcs and the vertices times the parts, and where near ids are joined little.  A kernel sees one part: its arcs and the values of all their ends.
"""
from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import cut, kept, placed
from .cells import groups

#: Arcs that a part should hold, about; a vertex's arcs are never divided.
PART_ARCS = 2_000_000

_GRAPH = "part int, begin int, local array<bigint>, offsets array<bigint>, near array<int>, given array<boolean>, targets array<int>, upto array<int>, sent array<int>"


class Part:
    """ids: its vertices; local: they and their neighbours, ascending; own: the slice of local that ids are; near[first[i]:first[i + 1]]: places in local of the neighbours of ids[i];
    given: the arc stands in the edges as it is here, and not the other way round."""

    def __init__(self, row, bounds: np.ndarray):
        self.part, self.local, self.first, self.near, self.given = int(row.part), row.local, row.offsets, row.near, row.given
        self.targets, self.upto, self.sent = row.targets, row.upto, row.sent
        self.own = slice(int(row.begin), int(row.begin) + len(row.offsets) - 1)
        self.ids, self.deg = self.local[self.own], np.diff(self.first)
        self.begins = np.append(0, np.searchsorted(self.local, bounds))

    def tails(self) -> np.ndarray:
        """The place in ids of each arc's own end."""
        return np.repeat(np.arange(len(self.ids)), self.deg)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum over each own vertex's arcs of x, one value an arc; each vertex has an arc."""
        return np.add.reduceat(x, self.first[:-1], dtype=np.float64 if x.dtype.kind == "f" else np.int64)

    def arcs_of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the arcs of some of its vertices, given by place in ids, in turn; where each one's begin among these)."""
        n = self.deg[some]
        begins = np.append(0, np.cumsum(n))
        return np.arange(begins[-1]) + np.repeat(self.first[some] - begins[:-1], n), begins


class Parts:
    """The parts of edges(src, dst)."""

    def __init__(self, edges: DataFrame, part_arcs: int = PART_ARCS):
        self.edges = edges = kept(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
        n = ceil(2 * edges.count() / part_arcs)
        found = [] if n < 2 else edges.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(1000, 10 * n))).first()[0]
        self.bounds = bounds = np.array(sorted(set(found)), np.int64)
        self.n = max(len(bounds) + 1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))

        def deal(batches):
            for pdf in batches:
                s, d = pdf["src"].to_numpy(), pdf["dst"].to_numpy()
                src = np.concatenate([s, d])
                yield pd.DataFrame({"part": np.searchsorted(bounds, src, "right").astype(np.int32), "src": src, "dst": np.concatenate([d, s]), "given": np.arange(len(src)) < len(s)})

        def pack(batches):
            for (part,), (s, d, given) in groups(batches, ["part"], ["src", "dst", "given"]):
                local, place = np.unique(np.concatenate([s, d]), return_inverse=True)
                place = place.astype(np.int64)
                order = np.argsort(place[: len(s)] * len(local) + place[len(s) :], kind="stable")
                tail, near = place[: len(s)][order], place[len(s) :][order]
                at, end = tail[0], tail[-1]  # its vertices are one range of ids
                first = np.searchsorted(tail, np.arange(at, end + 2))
                where = np.searchsorted(bounds, local, "right")[near]
                away = where != part
                pairs = np.unique(where[away] * len(local) + (tail[away] - at))
                targets, upto = np.unique(pairs // len(local), return_index=True)
                yield pd.DataFrame([{
                    "part": part, "begin": at, "local": local, "offsets": first, "near": near.astype(np.int32), "given": given[order],
                    "targets": targets.astype(np.int32), "upto": np.append(upto, len(pairs)).astype(np.int32), "sent": (pairs % len(local)).astype(np.int32),
                }])

        dealt = edges.mapInPandas(deal, "part int, src bigint, dst bigint, given boolean").repartition(self.n, "part").sortWithinPartitions("part")
        self.rows = placed(dealt.mapInPandas(pack, _GRAPH), "part", self.n)

    def _schema(self, shared: dict[str, str], private: dict[str, str]) -> str:
        return "to int, frm int, key bigint, changed bigint, " + ", ".join(f"{c} array<{t}>" for c, t in {**shared, **private}.items())

    def begin(self, kernel, shared: dict[str, str], private: dict[str, str] | None = None, values: DataFrame | None = None, sparse: bool = False) -> DataFrame:
        """A state: kernel(part) gives the own values by name; with values(id, ..., perhaps key) kernel(part, the rows of its ids, place in ids of each) is asked for each key.

        shared: names and types of the values that neighbours see; private: of those that they don't.  sparse: an array of zeros is not sent.
        """
        private, bounds = private or {}, self.bounds
        names = ["to", "frm", "key", "changed", *shared, *private]

        def alone(batches):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    g = Part(row, bounds)
                    yield pd.DataFrame(_sent(g, 0, kernel(g), 0, shared, private, sparse), columns=names)

        if values is None:
            return self.rows.mapInPandas(alone, self._schema(shared, private))
        if "key" not in values.columns:
            values = values.withColumn("key", F.lit(0).cast("long"))

        def deal(batches):
            for pdf in batches:
                yield pdf.assign(part=np.searchsorted(bounds, pdf["id"].to_numpy(), "right").astype(np.int32))

        def run(left, right):
            out = []
            if len(right) and (len(left) or not sparse):
                g = Part(right.iloc[0], bounds)
                for key, rows in left.groupby("key") if len(left) else [(0, left)]:
                    at = np.minimum(np.searchsorted(g.ids, rows["id"].to_numpy()), len(g.ids) - 1)
                    fits = g.ids[at] == rows["id"].to_numpy()
                    out += _sent(g, key, kernel(g, rows[fits], at[fits]), 0, shared, private, sparse)
            return pd.DataFrame(out, columns=names)

        types = ", ".join(f"{c} {t}" for c, t in values.dtypes)
        dealt = values.mapInPandas(deal, f"{types}, part int")
        return dealt.groupBy("part").cogroup(self.rows.groupBy("part")).applyInPandas(run, self._schema(shared, private))

    def step(self, state: DataFrame, kernel, shared: dict[str, str], private: dict[str, str] | None = None, sparse: bool = False, also: dict[str, str] | None = None) -> DataFrame:
        """The state after kernel(part, own, full) of each part and key, which gives (new own values by name, how many changed); full: the shared values of all local ids, own: the own values.

        also: the shared values of the state before, if they were others.
        """
        private, bounds, seen = private or {}, self.bounds, also or shared

        def run(left, right):
            out = []
            if len(left) and len(right):
                g = Part(right.iloc[0], bounds)
                for key, rows in left.groupby("key"):
                    own, changed = kernel(g, *_assembled(g, rows, seen))
                    out += _sent(g, key, own, changed, shared, private, sparse)
            return pd.DataFrame(out, columns=["to", "frm", "key", "changed", *shared, *private])

        return state.groupBy("to").cogroup(self.rows.groupBy("part")).applyInPandas(run, self._schema(shared, private))

    def until_stable(self, state: DataFrame, kernel, shared: dict[str, str], private: dict[str, str] | None = None, most: int = 100_000) -> DataFrame:
        """Steps until no value changes; a kernel may take several steps of its own, so long as its values can only fall or only rise."""
        for _ in range(most):
            state = cut(self.step(state, kernel, shared, private))
            if not state.agg(F.sum("changed")).first()[0]:
                return state
        raise RuntimeError("no fixpoint within the limit of rounds")

    def rounds(self, state: DataFrame, kernel, shared: dict[str, str], most: int, private: dict[str, str] | None = None, every: int = 5) -> DataFrame:
        """So many steps, or fewer if the last of some ``every`` steps changed nothing."""
        for i in range(1, most + 1):
            state = self.step(state, kernel, shared, private)
            if i % every == 0 or i == most:
                state = cut(state)
                if not state.agg(F.sum("changed")).first()[0]:
                    break
        return state

    def out(self, state: DataFrame, kernel, shared: dict[str, str], schema: str) -> DataFrame:
        """The rows that kernel(part, own, full, key) gives as a pandas table for each part and key."""
        bounds = self.bounds

        def run(left, right):
            parts = []
            if len(left) and len(right):
                g = Part(right.iloc[0], bounds)
                parts = [kernel(g, *_assembled(g, rows, shared), key) for key, rows in left.groupby("key")]
            return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

        return state.groupBy("to").cogroup(self.rows.groupBy("part")).applyInPandas(run, schema)

    def vertices(self) -> DataFrame:
        """id, deg."""
        bounds = self.bounds

        def run(batches):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    g = Part(row, bounds)
                    yield pd.DataFrame({"id": g.ids, "deg": g.deg})

        return self.rows.mapInPandas(run, "id bigint, deg bigint")

    def left(self, state: DataFrame, shared: dict[str, str]) -> DataFrame:
        """src, dst of the edges, as they were given, of whose ends ``alive`` is true."""

        def kernel(g, own, full, key):
            stays = g.given & (full["alive"][g.near] > 0) & np.repeat(own["alive"] > 0, g.deg)
            return pd.DataFrame({"src": g.ids[g.tails()[stays]], "dst": g.local[g.near[stays]]})

        return self.out(state, kernel, shared, "src bigint, dst bigint")


def _sent(g: Part, key: int, own: dict, changed: int, shared: dict, private: dict, sparse: bool) -> list[dict]:
    """The rows by which a part keeps its own values and sends the shared ones to the parts that need them."""
    out = [{"to": g.part, "frm": g.part, "key": key, "changed": changed, **{c: own[c] for c in (*shared, *private)}}]
    for t, a, b in zip(g.targets, g.upto, g.upto[1:], strict=False):
        values = {c: own[c][g.sent[a:b]] for c in shared}
        if not sparse or any(v.any() for v in values.values()):
            out.append({"to": int(t), "frm": g.part, "key": key, "changed": 0, **values, **dict.fromkeys(private)})
    return out


def parts_of(edges) -> Parts:
    """edges as parts, unless they are."""
    return edges if isinstance(edges, Parts) else Parts(edges)


def _assembled(g: Part, rows: pd.DataFrame, shared) -> tuple[dict, dict]:
    """(own values, values of all local ids) from the rows that came to a part; what did not come is 0."""
    frm = rows["frm"].to_numpy()
    own = np.flatnonzero(frm == g.part)
    mine = {c: rows[c].iloc[own[0]] for c in rows.columns if c not in ("to", "frm", "key", "changed")} if len(own) else {}
    full = {}
    for c in shared:
        arrays = rows[c].tolist()
        full[c] = np.zeros(len(g.local), arrays[0].dtype)
        for f, x in zip(frm, arrays, strict=True):
            full[c][g.begins[f] : g.begins[f] + len(x)] = x
    return mine, full


_MOVES = {"x": "double"}, {"p": "double", "r": "double"}


def _moved(g: Part, p: np.ndarray, r: np.ndarray, to_receiver: bool) -> dict:
    return {"p": p, "r": r, "x": r if to_receiver else r / g.deg}


def passed_on(parts: Parts, start: DataFrame, rounds: list[int], gain: float, share: float, to_receiver: bool = False, stop: int | None = None, every: int = 5) -> list[DataFrame]:
    """source, id, p, r after each of so many rounds (ascending) from start(source, id, r): in a round p takes gain of r, and each vertex passes share of r on to its neighbours in equal parts
    (to_receiver: each vertex receives share of the mean of its neighbours' r).  Nothing comes to the vertex stop.  Vertices that hold nothing are left out."""
    shared, private = _MOVES

    def first(g, rows, at):
        r = np.bincount(at, rows["r"], len(g.ids))
        return _moved(g, np.zeros(len(g.ids)), r, to_receiver)

    def kernel(g, own, full):
        p, r = (own["p"], own["r"]) if own else (np.zeros(len(g.ids)),) * 2
        fresh = g.sums(full["x"][g.near]) * share
        if to_receiver:
            fresh /= g.deg
        if stop is not None:
            fresh[g.ids == stop] = 0.0
        return _moved(g, p + r * gain, fresh, to_receiver), 0

    def table(g, own, full, key):
        some = np.flatnonzero((own["p"] > 0) | (own["r"] > 0)) if own else np.zeros(0, np.int64)
        return pd.DataFrame({"source": key, "id": g.ids[some], "p": own["p"][some] if own else 0.0, "r": own["r"][some] if own else 0.0})

    values = start.select(F.col("source").cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col("r").cast("double").alias("r"))
    state, out = parts.begin(first, shared, private, values, sparse=True), []
    for i in range(1, rounds[-1] + 1):
        state = parts.step(state, kernel, shared, private, sparse=True)
        if i in rounds[:-1] or i % every == 0:
            state = cut(state)
        if i in rounds:
            out.append(parts.out(state, table, shared, "source bigint, id bigint, p double, r double"))
    return out
