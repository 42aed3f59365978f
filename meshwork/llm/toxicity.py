"""Toxicity by a classifier chain of linear models.

Categories are predicted in order (``CHAIN``); each model sees the text's features and the probabilities of the categories before it.  While
training, those probabilities are out-of-fold predictions, so that a later model learns from the errors an earlier one makes on unseen texts.

Features are the presence of words and of word beginnings (2 to 6 characters).  The models are fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, those with the
least hash of doc_id); their features are the ``FEATURES`` per category with the highest signed log-likelihood ratio over that sample, counted on the executors.
The driver holds counts of chosen features and the sample's indices only.  All rows are scored, from their whole texts, without a shuffle.

The labels know quality and toxic only, so the chain has low quality, toxic, and both together; ``toxic`` decides, and the third category has no part in that.

Defined cases: null text is empty; labels that are null leave out a row for that category; labels of a doc_id that repeats count once (the greatest); rows that repeat a
labelled doc_id are all in the sample; a label without a document is left out; of features with equal scores the lesser id is chosen; a text of any length is scored whole; a
probability at the cutoff is toxic; with no usable label every probability is 0 and nothing is toxic; an empty table gives an empty table; other columns, whatever their names, don't matter.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch, slices

TRAIN_ROWS, FEATURES, FOLDS, CUTOFF = 12_000, 200, 5, 0.5
#: Words that a worker's memo holds: with all features, and with the chosen ones only.
MEMO_WORDS, MEMO_CHOSEN = 50_000, 200_000
#: Features that a task counts before it passes on what it has.
COUNTED = 60_000
#: Category: its label as an expression over the columns of labels.
CHAIN = {"low_quality": "1 - quality", "toxic": "toxic", "toxic_low_quality": "toxic * (1 - quality)"}
#: The category whose probability decides.
DECIDES = "toxic"
WORD = re.compile(r"\w+").findall


def features_of(word: str) -> list[int]:
    """The feature ids of a word: itself, and its beginnings of 2 to 6 characters."""
    return [xxhash.xxh32_intdigest("=" + word), *(xxhash.xxh32_intdigest(f"^{word[:k]}") for k in range(2, min(6, len(word)) + 1))]


class Features:
    """The distinct feature ids of texts, through a bounded memo of words; chosen: only these."""

    def __init__(self, chosen: dict[int, int] | None = None):
        self.chosen, self.memo = chosen, {}

    def __call__(self, text: str) -> list[int]:
        words = set(WORD(text.lower()))
        memo, chosen = self.memo, self.chosen
        miss = words.difference(memo)
        if len(memo) + len(miss) > (MEMO_WORDS if chosen is None else MEMO_CHOSEN):
            memo.clear()
            miss = words
        for w in miss:
            ids = features_of(w)
            memo[w] = tuple(chosen[i] for i in ids if i in chosen) if chosen is not None else tuple(ids)
        return list(set().union(*map(memo.__getitem__, words)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Logistic regression by Newton's method; x has its constant as the last column, which is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + shrink * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """The fitted models, in order."""

    def __init__(self, columns: list[np.ndarray], weights: list[np.ndarray | None]):
        self.columns, self.weights = columns, weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category; x: presence of the chosen features."""
        out = np.zeros((len(x), len(self.weights)))
        for k, (cols, w) in enumerate(zip(self.columns, self.weights, strict=True)):
            if w is not None:
                out[:, k] = sigmoid(np.hstack([x[:, cols], out[:, :k], np.ones((len(x), 1))]) @ w)
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, columns: list[np.ndarray]) -> Chain:
    """y: a column for each category, NaN where a label is missing."""
    before, weights = np.zeros((len(x), 0)), []
    for k in range(y.shape[1]):
        known = ~np.isnan(y[:, k])
        z = np.hstack([x[:, columns[k]], before, np.ones((len(x), 1))])
        if known.sum() < 2 * FOLDS or len(np.unique(y[known, k])) < 2:
            weights.append(None)
            before = np.hstack([before, np.zeros((len(x), 1))])
            continue
        target = np.where(known, y[:, k], 0.0)
        own = np.zeros(len(x))
        for f in range(FOLDS):
            out = fold == f
            own[out] = sigmoid(z[out] @ fit_linear(z, target, (known & ~out).astype(float)))
        weights.append(fit_linear(z, target, known.astype(float)))
        before = np.hstack([before, own[:, None]])
    return Chain(columns, weights)


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, fold, text and a label column for each category of the sample; at most ``rows`` label rows, so their side is broadcast."""
    grouped = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic")).filter("doc_id IS NOT NULL")
    grouped = grouped.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    few = grouped.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), *(F.expr(e).alias(c) for c, e in CHAIN.items()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "doc_id")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, scratch: Scratch | None = None) -> tuple[dict[int, int], Chain]:
    names = list(CHAIN)
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    found = scratch.write(sample(docs, labels, rows), "sample")  # read three times

    def count(batches):
        features, seen = Features(), {}
        for batch in batches:
            for part in slices(batch):
                y = [part.column(c).to_pylist() for c in names]
                for i, text in enumerate(part.column("text").to_pylist()):
                    for f in features(text):
                        c = seen.get(f)
                        if c is None:
                            c = seen[f] = [0] * (2 * len(names))
                        for k in range(len(names)):
                            if y[k][i] is not None:
                                c[2 * k + (y[k][i] > 0)] += 1
                if len(seen) > COUNTED:
                    yield told(seen)
                    seen = {}
        yield told(seen)

    def told(seen):
        return pa.record_batch([pa.array(list(seen), pa.int64()), *(pa.array([c[j] for c in seen.values()], pa.int64()) for j in range(2 * len(names)))], names=["feature", *(f"n{j}" for j in range(2 * len(names)))])

    schema = "feature long, " + ", ".join(f"n{j} long" for j in range(2 * len(names)))
    counts = found.mapInArrow(count, schema).groupBy("feature").agg(*(F.sum(f"n{j}").alias(f"n{j}") for j in range(2 * len(names))))
    labelled = found.agg(*(F.sum((F.col(c) == v).cast("long")) for c in names for v in (0, 1))).first()
    if not any(labelled):
        return {}, Chain([np.zeros(0, int)] * len(names), [None] * len(names))
    scored = []
    for k in range(len(names)):
        neg, pos = (max(1, labelled[2 * k + v] or 0) for v in (0, 1))
        rate = F.log((F.col(f"n{2 * k + 1}") + 0.5) / (pos + 1)) - F.log((F.col(f"n{2 * k}") + 0.5) / (neg + 1))
        scored.append((F.col(f"n{2 * k + 1}") * F.greatest(rate, F.lit(0.0))).alias(f"s{k}"))
    enough = scratch.write(counts.filter(" + ".join(f"n{j}" for j in range(2 * len(names))) + f" >= {3 * len(names)}").select("feature", *scored), "scores")
    top = [[r.feature for r in enough.filter(F.col(f"s{k}") > 0).orderBy(F.desc(f"s{k}"), "feature").limit(FEATURES).collect()] for k in range(len(names))]
    chosen = {f: i for i, f in enumerate(dict.fromkeys(f for fs in top for f in fs))}
    columns = [np.array([chosen[f] for f in fs], np.int64) for fs in top]

    def index(batches):
        features = Features(chosen)
        for batch in batches:
            for part in slices(batch):
                at = pa.array([features(t) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))
                yield pa.record_batch([part.column("fold"), *(part.column(c) for c in names), at], names=["fold", *names, "at"])

    # the sample's rows with the indices of their chosen features
    rows_ = found.mapInArrow(index, "fold int, " + ", ".join(f"{c} double" for c in names) + ", at array<long>").toArrow()
    x = np.zeros((rows_.num_rows, len(chosen)), np.float32)
    lists = rows_.column("at").combine_chunks()
    x[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()] = 1
    y = np.stack([rows_.column(c).to_pandas().to_numpy(float) for c in names], axis=1)
    return chosen, fit_chain(x, y, rows_.column("fold").to_numpy(), columns)


def _scorer(chosen: dict[int, int], chain: Chain):
    """Adds a column of probabilities for each category to batches of (row, text); the column row passes as it is."""
    names = list(CHAIN)

    def run(batches):
        features = Features(chosen)
        for batch in batches:
            for part in slices(batch):
                x = np.zeros((part.num_rows, len(chosen)))
                for i, t in enumerate(part.column("text").to_pylist()):
                    x[i, features(t or "")] = 1
                p = chain.predict(x)
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(p[:, k]) for k in range(len(names)))], names=["row", *(f"p_{c}" for c in names)])

    return run


def _scored(docs: DataFrame, rows: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """rows (row, text) with the probabilities instead of the text."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    chosen, chain = train(docs, labels, sample_rows)
    return rows.mapInArrow(_scorer(chosen, chain), StructType([rows.schema["row"], *(StructField(f"p_{c}", DoubleType()) for c in CHAIN)]))


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the probability of each category (p_...) and is_toxic of each row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    out = _scored(docs, slim, labels, rows)
    return out.select(F.col("row").alias("doc_id"), *(F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CHAIN), (F.col(f"p_{DECIDES}") >= cutoff).alias("is_toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs (all columns) whose probability of being toxic is below the cutoff."""
    kept = _scored(docs, docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")), labels, rows)
    return kept.filter(F.col(f"p_{DECIDES}") < cutoff).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .util import table

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
