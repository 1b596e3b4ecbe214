"""Gradient-boosted regression trees for all folds at once: tasks count gradients by bin, Spark adds the counts up."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .quantiles import exact_quantiles


@dataclass(frozen=True)
class BoostingParams:
    """Frozen parameters: the same for every fold and run. Trees grow level by level to ``depth``."""

    trees: int = 500
    depth: int = 5
    learning_rate: float = 0.05
    bins: int = 64
    min_child: int = 20
    reg_lambda: float = 1.0
    feature_fraction: float = 0.8
    bagging_fraction: float = 0.8
    seed: int = 0
    #: Trees after which the rows' predictions are written, so that a pass evaluates at most so many.
    stage: int = 25


@dataclass
class Boosted:
    """Trees of every fold: by (fold, tree, node) the feature to split on and the last bin that goes left, and by (fold,
    tree, leaf) the value. Children of node k are 2k + 1 and 2k + 2. Size: folds x trees x 2^depth, set by parameters."""

    folds: list
    edges: list  # by fold and feature, the upper ends of bins 1, 2, ...
    base: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    done: int = 0
    params: BoostingParams = field(default_factory=BoostingParams)

    def nodes(self, tree: int, fold: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row of bins at that depth of a tree."""
        node, row = np.zeros(len(fold), np.int64), np.arange(len(fold))
        for _ in range(depth):
            node = 2 * node + 1 + (bins[row, self.feature[fold, tree, node]] > self.threshold[fold, tree, node])
        return node

    def add(self, total: np.ndarray, fold: np.ndarray, bins: np.ndarray, first: int, last: int) -> np.ndarray:
        """total with the values of trees first..last-1 added, tree after tree, so that sums come out alike everywhere."""
        d = self.params.depth
        for t in range(first, last):
            total = total + self.value[fold, t, self.nodes(t, fold, bins, d) - (2**d - 1)]
        return total


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A hash of 64-bit numbers, uniform in [0, 1)."""
    z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(float) / 2.0**64


def chosen_features(params: BoostingParams, tree: int, n: int) -> np.ndarray:
    """Features that a tree may split on: the share with the smallest hashes, at least one."""
    k = max(1, round(params.feature_fraction * n))
    return np.sort(np.argsort(_mixed(np.arange(n), params.seed + 7919 * (tree + 1)), kind="stable")[:k])


def in_bag(params: BoostingParams, tree: int, keys: np.ndarray) -> np.ndarray:
    """Rows that a tree learns from."""
    return _mixed(keys, params.seed + 104729 * (tree + 1)) < params.bagging_fraction


def bin_edges(train: DataFrame, features: list[str], bins: int) -> dict:
    """fold -> upper ends of the bins of each feature: exact quantiles of the training rows, without repeats."""
    long = train.select("fold", *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["fold"], features, "feature", "x")
    cuts = exact_quantiles(long, "x", [i / bins for i in range(1, bins)], ["fold", "feature"]).collect()  # folds x features
    out: dict = {}
    for r in cuts:
        out.setdefault(r["fold"], {})[r["feature"]] = sorted(set(r["quantiles"]))
    return out


def _bin(x: Column, edges: list[float]) -> Column:
    """0 for a missing value, else 1 + the number of edges below x, by halving."""

    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo + 1)
        mid = (lo + hi) // 2
        return F.when(x > edges[mid], below(mid + 1, hi)).otherwise(below(lo, mid))

    return F.when(x.isNull() | F.isnan(x), 0).otherwise(below(0, len(edges)))


def binned(rows: DataFrame, features: list[str], edges: dict, extra: list[Column]) -> DataFrame:
    """(extra..., __fold, __bins): rows of known folds with the number of the fold and the bins of the features."""
    parts = None
    for k, fold in enumerate(sorted(edges)):
        cells = F.array(*[_bin(F.col(c).cast("double"), edges[fold].get(c, [])).cast("int") for c in features])
        part = rows.where(F.col("fold") == fold).select(*extra, F.lit(k).alias("__fold"), cells.alias("__bins"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def best_split(grad: np.ndarray, count: np.ndarray, scale: float, params: BoostingParams, allowed: np.ndarray) -> tuple:
    """(feature, bin, gradient left, rows left, gradient, rows) of the best cut of a node; sums are by feature and bin.
    Missing values, bin 0, go left. Without a cut that gains, all rows go left. Ties: the first feature, then the first bin."""
    lam, total, rows = params.reg_lambda, int(grad[allowed[0]].sum()), int(count[allowed[0]].sum())
    left, n = np.cumsum(grad[allowed], 1)[:, :-1], np.cumsum(count[allowed], 1)[:, :-1]
    part = lambda g, c: (g * scale) ** 2 / (c + lam)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = part(left, n) + part(total - left, rows - n) - part(total, rows)
    gain = np.where((n >= params.min_child) & (rows - n >= params.min_child), gain, -np.inf)
    at = int(gain.argmax()) if gain.size else 0
    if not gain.size or not gain.flat[at] > 1e-12:
        return 0, grad.shape[1], total, rows, total, rows
    f, b = divmod(at, gain.shape[1])
    return int(allowed[f]), b, int(left[f, b]), int(n[f, b]), total, rows


def fit_boosting(tagged: DataFrame, features: list[str], y: str, keys: list[str], params: BoostingParams = BoostingParams()) -> Boosted:
    """Boosted trees of every fold of tagged (fold, role, features, y), from the rows whose role is train and y is known.

    Features are cut into bins at exact quantiles of the fold's training rows. For each level of each tree one pass lets
    every task add up gradients by (fold, node, feature, bin) for its rows; Spark sums these tables, and the best cut of a
    node is found from its own table of features x bins, in as many tasks as there are nodes. So tasks hold a table of
    fixed size, folds are fitted together, and no fold is gathered anywhere. Gradients are whole numbers (y in steps of
    2^-24 of its largest size), so sums do not depend on the order of rows: runs repeat to the bit on any cluster.

    ``keys`` name a row for the bagging hash. The model, folds x trees x nodes, is on the driver; rows never are. A lost
    executor costs the passes of its rows, as they read a stored table. Null and NaN features are a bin of their own. Folds
    without training rows have no model; no rows at all raise ValueError.
    """
    train = tagged.where(f"role = 'train' and `{y}` is not null and not isnan(`{y}`)")
    edges = bin_edges(train, features, params.bins)
    about = {r["fold"]: r for r in train.groupBy("fold").agg(F.max(F.abs(y)).alias("top"), F.count("*").alias("n")).collect()}
    if not about:
        raise ValueError("no training rows")
    for fold in about:
        edges.setdefault(fold, {})
    folds = sorted(edges)
    top = max(r["top"] for r in about.values())
    scale = 2.0 ** (np.ceil(np.log2(top)) - 24 if top > 0 else 0)
    sums = {r["fold"]: r["s"] for r in train.groupBy("fold").agg(F.sum(F.rint(F.col(y) / scale).cast("long")).alias("s")).collect()}
    size = (len(folds), params.trees, 2**params.depth)
    base = np.array([np.rint(sums[k] / about[k]["n"]) * scale for k in folds])
    model = Boosted(folds, [[edges[k].get(c, []) for c in features] for k in folds], base, np.zeros(size, int), np.full(size, params.bins + 1), np.zeros(size), 0, params)
    lit = F.element_at(F.create_map(*[F.lit(x) for k, b in zip(folds, base, strict=True) for x in (k, float(b))]), F.col("fold"))
    rows = stored(binned(train, features, edges, [F.col(y).cast("double").alias("__y"), lit.alias("__sum"), F.xxhash64(*keys).alias("__key")]), "boosting-rows")
    spark, width, spread = tagged.sparkSession, params.bins + 1, len(features)

    def histograms(shared, tree: int, depth: int, kept: int):
        def run(batches):
            import pyarrow as pa

            m, first = shared.value, 2**depth - 1
            shape = (len(m.folds), 2**depth, spread, width)
            grad, count = np.zeros(np.prod(shape), np.int64), np.zeros(np.prod(shape), np.int64)
            for batch in batches:
                y_, total, key, fold, bins = (batch.column(i) for i in range(5))
                y_, total, key, fold = (c.to_numpy(zero_copy_only=False) for c in (y_, total, key, fold))
                bins = bins.flatten().to_numpy(zero_copy_only=False).reshape(-1, spread)
                bag = in_bag(params, tree, key) if params.bagging_fraction < 1 else np.ones(len(key), bool)
                y_, total, fold, bins = y_[bag], total[bag], fold[bag].astype(np.int64), bins[bag]
                total = m.add(total, fold, bins, kept, tree)
                g = np.rint((y_ - total) / scale).astype(np.int64)
                node = m.nodes(tree, fold, bins, depth) - first
                at = (((fold * 2**depth + node)[:, None] * spread + np.arange(spread)) * width + bins).ravel()
                np.add.at(grad, at, np.repeat(g, spread))
                count += np.bincount(at, minlength=len(count))
            hit = np.flatnonzero(count)
            cell, b = divmod(hit, width)
            cell, f = divmod(cell, spread)
            fold, node = divmod(cell, 2**depth)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (fold, node, f, b, grad[hit], count[hit])], names=["fold", "node", "f", "b", "g", "n"])

        return run

    def cut(tree: int):
        allowed = chosen_features(params, tree, spread)

        def run(pdf):
            import pandas as pd

            grad, count = np.zeros((spread, width), np.int64), np.zeros((spread, width), np.int64)
            grad[pdf["f"], pdf["b"]], count[pdf["f"], pdf["b"]] = pdf["g"], pdf["n"]
            return pd.DataFrame([(pdf["fold"].iloc[0], pdf["node"].iloc[0], *best_split(grad, count, scale, params, allowed))], columns=["fold", "node", "f", "b", "gl", "nl", "g", "n"])

        return run

    kept = 0
    for tree in range(params.trees):
        if tree - kept >= params.stage:
            rows, kept = stored(_with_sums(rows, model, kept, tree), "boosting-rows"), tree
        for depth in range(params.depth):
            shared = spark.sparkContext.broadcast(model)
            sums = rows.mapInArrow(histograms(shared, tree, depth, kept), "fold long, node long, f long, b long, g long, n long").groupBy("fold", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
            cuts = sums.groupBy("fold", "node").applyInPandas(cut(tree), "fold long, node long, f long, b long, gl long, nl long, g long, n long").collect()  # folds x nodes
            for c in cuts:
                node = 2**depth - 1 + c["node"]
                model.feature[c["fold"], tree, node], model.threshold[c["fold"], tree, node] = c["f"], c["b"]
                if depth == params.depth - 1:
                    for side, g, n in ((0, c["gl"], c["nl"]), (1, c["g"] - c["gl"], c["n"] - c["nl"])):
                        model.value[c["fold"], tree, 2 * c["node"] + side] = params.learning_rate * (g * scale) / (n + params.reg_lambda)
            shared.unpersist()
        model.done = tree + 1
    return model


def _with_sums(rows: DataFrame, model: Boosted, first: int, last: int) -> DataFrame:
    """rows with the values of some more trees added to __sum."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = rows.columns
    at, fold, bins = names.index("__sum"), names.index("__fold"), names.index("__bins")

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            cells = b.column(bins).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            total = m.add(b.column(at).to_numpy(zero_copy_only=False), b.column(fold).to_numpy(zero_copy_only=False).astype(np.int64), cells, first, last)
            yield b.set_column(at, names[at], pa.array(total, pa.float64()))

    return rows.mapInArrow(run, rows.schema)


def score_boosting(rows: DataFrame, model: Boosted, features: list[str]) -> DataFrame:
    """rows (fold, features, ...) with ``score``, each by the trees of its own fold; rows of folds without a model are left
    out. A narrow map; the model is broadcast, its size is set by the parameters."""
    edges = {k: dict(zip(features, e, strict=True)) for k, e in zip(model.folds, model.edges, strict=True)}
    base = F.element_at(F.array(*[F.lit(float(b)) for b in model.base]), F.col("__fold") + 1)
    cells = binned(rows, features, edges, [F.struct(*[F.col(c) for c in rows.columns]).alias("__row")]).withColumn("__sum", base)
    out = _with_sums(cells, model, 0, model.done)
    return out.select(*[F.col(f"__row.{c}").alias(c) for c in rows.columns], F.col("__sum").alias("score"))


def boosted_scores(tagged: DataFrame, features: list[str], y: str, keys: list[str], params: BoostingParams = BoostingParams()) -> DataFrame:
    """The test rows of every fold with the score of the trees fitted on its training rows: out-of-fold scores."""
    return score_boosting(tagged.where("role = 'test'"), fit_boosting(tagged, features, y, keys, params), features)


def frozen(params: BoostingParams) -> dict:
    """Parameters as a record, for a run's manifest."""
    return asdict(params)
