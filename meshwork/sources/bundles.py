"""Data-set bundles: citation pickles, community files, ego circles, node-link JSON, sampled-graph archives and temporal sidecars.

Text formats are read by Spark.  Formats that hold one array or object in one file are read on the driver, which their own size bounds, and become DataFrames.
"""
from __future__ import annotations

import json
import os
import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered
from .tables import symmetric


class _Matrix:
    """What a pickled sparse matrix held, whatever library wrote it."""

    def __setstate__(self, state):
        self.__dict__.update(state if isinstance(state, dict) else state[1])

    def rows(self) -> np.ndarray:
        shape = getattr(self, "_shape", None) or self.shape
        out = np.zeros(shape, np.float64)
        for i in range(shape[0]):
            s = slice(self.indptr[i], self.indptr[i + 1])
            out[i, self.indices[s]] = self.data[s]
        return out


class _Reader(pickle.Unpickler):
    """Reads arrays, lists and sparse matrices; any other class is refused."""

    def find_class(self, module, name):
        if module.startswith("scipy.sparse") and name in ("csr_matrix", "csr_array"):
            return _Matrix
        if (module, name) in {("collections", "defaultdict"), ("builtins", "list"), ("__builtin__", "list"), ("_codecs", "encode")}:
            return super().find_class(module.replace("__builtin__", "builtins"), name)
        if module in ("numpy", "numpy.core.multiarray", "numpy._core.multiarray", "numpy.core.numeric", "numpy._core.numeric") and name in ("ndarray", "dtype", "_reconstruct", "scalar", "_frombuffer"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not read")


def _load(path: str):
    with open(path, "rb") as f:
        return _Reader(f, encoding="latin1").load()


def _dense(x) -> np.ndarray:
    return x.rows() if isinstance(x, _Matrix) else np.asarray(x, float)


class Citation:
    """The files ind.NAME.x, tx, allx, y, ty, ally, graph and test.index of a folder."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.at = spark, lambda part: os.path.join(folder, f"ind.{name}.{part}")

    def test_ids(self) -> list[int]:
        """The ids of the test rows, in the order of tx and ty."""
        with open(self.at("test.index")) as f:
            return [int(line) for line in f if line.strip()]

    def edges(self) -> DataFrame:
        """src < dst of the dictionary of lists, each edge once and without loops."""
        rows = [(int(a), int(b)) for a, found in _load(self.at("graph")).items() for b in found]
        e = self.spark.createDataFrame(rows, "src long, dst long").filter("src <> dst")
        return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    def _stacked(self, first: str, rest: str) -> np.ndarray:
        """The rows of all nodes by id: those of the first part, then the test rows at their ids (ids of the test range without a row are zero)."""
        a, b, ids = _dense(_load(self.at(first))), _dense(_load(self.at(rest))), self.test_ids()
        out = np.zeros((max(len(a), max(ids, default=-1) + 1), a.shape[1]))
        out[: len(a)] = a
        out[ids] = b
        return out

    def features(self) -> DataFrame:
        """id, x."""
        return self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(self._stacked("allx", "tx"))], "id long, x array<double>")

    def labels(self) -> DataFrame:
        """id, label: the place of the greatest value of a one-hot row (the first on ties)."""
        return self.spark.createDataFrame([(i, int(y.argmax())) for i, y in enumerate(self._stacked("ally", "ty"))], "id long, label int")

    def splits(self, valid: int = 500) -> DataFrame:
        """id, split: the rows of y train, the next ones validate, those of test.index test, and the rest have none."""
        n, total = len(_dense(_load(self.at("y")))), len(self._stacked("ally", "ty"))
        test = set(self.test_ids())
        rows = [(i, "train" if i < n else "valid" if i < n + valid and i not in test else "test" if i in test else None) for i in range(total)]
        return self.spark.createDataFrame(rows, "id long, split string")

    def train_edges(self) -> DataFrame:
        """The edges both of whose ends are neither valid nor test rows."""
        out = self.splits().filter("split IN ('valid', 'test')").select("id")
        return self.edges().join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")


def mask(nodes: DataFrame, chosen: DataFrame, name: str = "mask") -> DataFrame:
    """nodes(id) with a boolean: whether chosen(id) has the id."""
    return nodes.join(chosen.select("id").distinct().withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def communities(spark: SparkSession, edges: str, members: str, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(src, dst; community, members of at least so many; old, id): ids are ranks of the sorted node ids; lines with # in front are no edges."""
    pairs = spark.read.text(edges).filter("value <> '' AND NOT startswith(value, '#')").select(F.split("value", r"\s+").alias("p"))
    pairs = pairs.select(F.get("p", F.lit(0)).cast("long").alias("a"), F.get("p", F.lit(1)).cast("long").alias("b"))
    ids = numbered(pairs.select(F.explode(F.array("a", "b")).alias("old")).distinct(), "old", "id")
    src, dst = ids.select(F.col("old").alias("a"), F.col("id").alias("src")), ids.select(F.col("old").alias("b"), F.col("id").alias("dst"))
    lists = spark.read.text(members).filter("trim(value) <> ''").select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("v")).select("line", F.posexplode("v").alias("at", "old"))
    found = lists.withColumn("old", F.col("old").cast("long")).join(ids, "old").groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("members"))
    kept = found.filter(F.size("members") >= least).select(F.col("line").alias("community"), "members")
    return pairs.join(src, "a").join(dst, "b").select("src", "dst"), kept, ids


def ego_network(spark: SparkSession, folder: str, seed: int, least: int = 8) -> dict[str, DataFrame]:
    """nodes (id, old, x), edges (src, dst; the seed is joined to all), circles (members, of at least so many) and seed (id) of SEED.feat, .egofeat, .edges and .circles."""
    def ints(part, name):
        return spark.read.text(os.path.join(folder, f"{seed}.{part}")).filter("trim(value) <> ''").select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("long")).alias(name))

    own = ints("egofeat", "v").limit(1).select(F.lit(seed).cast("long").alias("old"), F.col("v").alias("x"))
    rest = ints("feat", "v").select(F.get("v", F.lit(0)).alias("old"), F.slice("v", 2, F.size("v")).alias("x"))
    nodes = numbered(rest.unionByName(own), "old", "id")
    at = nodes.select("old", "id")
    raw = ints("edges", "v").select(F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b")).unionByName(rest.select(F.lit(seed).cast("long").alias("a"), F.col("old").alias("b")))
    edges = raw.join(at.withColumnsRenamed({"old": "a", "id": "src"}), "a").join(at.withColumnsRenamed({"old": "b", "id": "dst"}), "b").select("src", "dst")
    lines = spark.read.text(os.path.join(folder, f"{seed}.circles")).filter("trim(value) <> ''").select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("v"))
    members = lines.select("line", F.posexplode(F.slice("v", 2, F.size("v"))).alias("k", "old")).withColumn("old", F.col("old").cast("long")).join(at, "old")
    circles = members.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("members")).filter(F.size("members") >= least).select("members")
    return {"nodes": nodes.select("id", "old", "x"), "edges": edges, "circles": circles, "seed": at.filter(F.col("old") == seed).select("id")}


def standardised(features: DataFrame, train: DataFrame) -> DataFrame:
    """features(id, x) less the mean and over the population deviation of each dimension among train(id); a dimension that does not vary is only shifted."""
    each = features.select("id", F.posexplode("x").alias("dim", "v"))
    stats = each.join(train.select("id").distinct(), "id", "left_semi").groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scaled = each.join(F.broadcast(stats), "dim").select("id", "dim", ((F.col("v") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("v"))  # a row for each dimension
    return scaled.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda p: p["v"]).alias("x"))


def _json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _labels(spark, rows: list[tuple]) -> DataFrame:
    """id, label (an array: one-hot over the range of the classes, or as it stands)."""
    several = rows and isinstance(rows[0][1], list)
    low, high = (0, 0) if several or not rows else (min(y for _, y in rows), max(y for _, y in rows))
    return spark.createDataFrame([(i, [float(v) for v in y] if several else [float(k == y) for k in range(low, high + 1)]) for i, y in rows], "id long, label array<double>")


def node_link_bundle(spark: SparkSession, prefix: str, normalise: bool = True) -> dict[str, DataFrame]:
    """edges, train_edges, features, labels, splits of PREFIX-G.json, -id_map.json, -class_map.json and -feats.npy; nodes that the id map lacks are left out."""
    graph, ids, classes = (_json(f"{prefix}-{part}.json") for part in ("G", "id_map", "class_map"))
    names = [n["id"] for n in graph["nodes"]]
    known = {str(k): int(v) for k, v in ids.items()}
    ends = lambda e: (e["source"], e["target"])
    by_place = names and all(isinstance(x, int) and 0 <= x < len(names) for e in graph["links"] for x in ends(e)) and not all(isinstance(n, int) for n in names)
    pairs = [tuple(str(names[x]) if by_place else str(x) for x in ends(e)) for e in graph["links"]]
    edges = spark.createDataFrame([(known[a], known[b]) for a, b in pairs if a in known and b in known], "src long, dst long")
    splits = spark.createDataFrame([(known[str(n["id"])], "valid" if n.get("val") else "test" if n.get("test") else "train") for n in graph["nodes"] if str(n["id"]) in known], "id long, split string")
    features = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.load(f"{prefix}-feats.npy").astype(np.float64))], "id long, x array<double>")
    train = splits.filter("split = 'train'").select("id")
    inner = edges.join(train.withColumnRenamed("id", "src"), "src", "left_semi").join(train.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    return {"edges": edges, "train_edges": inner, "features": standardised(features, train) if normalise else features, "labels": _labels(spark, [(known[str(k)], v) for k, v in classes.items() if str(k) in known]), "splits": splits}


def _archive(spark, path: str) -> DataFrame:
    """src, dst of the stored entries of a compressed sparse row archive."""
    with np.load(path, allow_pickle=False) as z:
        first, to = z["indptr"], z["indices"]
    return spark.createDataFrame(list(zip(np.repeat(np.arange(len(first) - 1), np.diff(first)).tolist(), to.tolist(), strict=True)), "src long, dst long")


def sampled_graph_bundle(spark: SparkSession, folder: str, normalise: bool = True) -> dict[str, DataFrame]:
    """edges, train_edges, features, labels, splits of adj_full.npz, adj_train.npz, feats.npy, class_map.json and role.json."""
    at = lambda name: os.path.join(folder, name)
    edges, inner = _archive(spark, at("adj_full.npz")), _archive(spark, at("adj_train.npz"))
    features = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.load(at("feats.npy")).astype(np.float64))], "id long, x array<double>")
    role = _json(at("role.json"))
    splits = spark.createDataFrame([(int(i), {"tr": "train", "va": "valid", "te": "test"}[k]) for k, found in role.items() for i in found], "id long, split string")
    train = inner.select(F.col("src").alias("id"))
    return {"edges": edges, "train_edges": inner, "features": standardised(features, train) if normalise else features, "labels": _labels(spark, [(int(k), v) for k, v in _json(at("class_map.json")).items()]), "splits": splits}


def temporal_sidecars(spark: SparkSession, path: str, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, t; u, t, ds) of PATH#FIRST#LAST#NODE, #ADJ (a JSON object from time to neighbours in each line) and #DS (from time to activity), lines in the order of the nodes."""
    at = lambda kind: f"{path}#{first}#{last}#{kind}"
    nodes = [int(x) for x in open(at("NODE")) if x.strip()]
    adj = [(u, v, int(t)) for u, line in zip(nodes, open(at("ADJ")), strict=True) for t, found in json.loads(line).items() for v in found]
    ds = [(u, int(t), float(n)) for u, line in zip(nodes, open(at("DS")), strict=True) for t, n in json.loads(line).items()]
    return spark.createDataFrame(adj, "u long, v long, t int"), spark.createDataFrame(ds, "u long, t int, ds double")


def connected_with_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst: both directions of each edge once, and a loop at each of nodes(id): A + I with entries cut at 1."""
    return symmetric(edges.select("src", "dst")).unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()
