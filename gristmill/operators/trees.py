"""MLlib forests and boosted trees, grown from counts per cell instead of rows.

A tree sees a row only through the bins of its features (at most `maxBins` each). Rows with the same bins
are a cell; one scan counts the cells, and every level of every tree works on these counts. Draws stay draws of
single rows: rows of a cell and class are drawn together from the law of their sum (Poisson for bootstraps,
binomial for subsamples); where the label is a number, each row is drawn by itself, for all trees in one scan.
Splits, stopping, pruning and losses are those of MLlib, and so are the models. Tables with more than
MOST_CELLS cells are left to MLlib, which scans the rows for each level.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import new_path, ship_package
from .quantiles import exact_quantiles

#: Cells (times classes) that a task holds; more are left to MLlib.
MOST_CELLS, MOST_COUNTS, MOST_FEATURES = 8_192, 65_536, 1_000
#: Rows whose draws for all trees a task holds at once; counts of a level that it holds at once.
ROWS_AT_ONCE, COUNTS_AT_ONCE = 1_024, 1 << 21
#: Impurity below this is none.
PURE = 2.0**-52

NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)
_SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])

_MODELS = {
    RandomForestClassifier: (RandomForestClassificationModel, "classification.RandomForestClassificationModel", "classification.DecisionTreeClassificationModel"),
    GBTClassifier: (GBTClassificationModel, "classification.GBTClassificationModel", "regression.DecisionTreeRegressionModel"),
    RandomForestRegressor: (RandomForestRegressionModel, "regression.RandomForestRegressionModel", "regression.DecisionTreeRegressionModel"),
    GBTRegressor: (GBTRegressionModel, "regression.GBTRegressionModel", "regression.DecisionTreeRegressionModel"),
}


@dataclass(frozen=True)
class Cells:
    """Cuts per feature (None: 0 or 1), the bins of each cell, and its rows: per class, or one column where the label is a number."""

    cuts: list[np.ndarray | None]
    bins: np.ndarray
    counts: np.ndarray
    classes: int

    @property
    def width(self) -> np.ndarray:
        return np.array([2 if c is None else len(c) + 1 for c in self.cuts], np.int64)


def find_cells(ready: DataFrame, rows: int, *, classification: bool, max_bins: int = 32) -> Cells | None:
    """Cells of the columns 'features' and 'label'; None if there are too many, or features are codes of more than two categories."""
    found = ready.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    kinds = {a["idx"]: kind for kind, group in found.items() for a in group}
    if not rows or not kinds or len(kinds) > MOST_FEATURES or "nominal" in found:
        return None
    ship_package(ready.sparkSession)
    plain = ready.select(vector_to_array("features").alias("x"), "label")
    numbers = [j for j in range(len(kinds)) if kinds[j] != "binary"]
    cuts = _cuts(plain.select(*[F.col("x")[j].alias(f"x{j}") for j in numbers]), [f"x{j}" for j in numbers], min(max_bins, rows))
    cuts = [cuts[f"x{j}"] if kinds[j] != "binary" else None for j in range(len(kinds))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, float], int] = {}
        for b in batches:
            keys, own, y = _keys(b, cuts, classification)
            pairs, n = np.unique(np.stack([own, y]), axis=1, return_counts=True)
            for i, label, many in zip(pairs[0].astype(int).tolist(), pairs[1].tolist(), n.tolist()):
                at = (keys[i].tobytes(), label)
                seen[at] = seen.get(at, 0) + many
            if len(seen) > MOST_COUNTS:
                break
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in seen], pa.binary()), pa.array([y for _, y in seen], pa.float64()), pa.array(seen.values(), pa.int64())],
            ["cell", "label", "n"],
        )

    counted = plain.mapInArrow(count, "cell binary, label double, n bigint").groupBy("cell", "label").agg(F.sum("n").alias("n"))
    pairs = counted.limit(MOST_COUNTS + 1).collect()
    cells = {c: i for i, c in enumerate(sorted({bytes(r["cell"]) for r in pairs}))}
    classes = 1 + int(max(r["label"] for r in pairs)) if classification else 1
    if len(cells) > MOST_CELLS or len(cells) * classes > MOST_COUNTS or classification and classes < 2:
        return None
    counts = np.zeros((len(cells), classes), np.int64)
    for r in pairs:
        counts[cells[bytes(r["cell"])], int(r["label"])] = r["n"]
    bins = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), len(cuts))
    return Cells(cuts, bins, counts, classes)


def _cuts(numbers: DataFrame, names: list[str], most: int) -> dict[str, np.ndarray]:
    """Cuts between at most so many bins, over all rows: between all values if they are few, else exact quantiles."""
    if not names:
        return {}
    about = numbers.agg(*[F.approx_count_distinct(n).alias(n) for n in names]).first()
    out = {}
    few = [n for n in names if about[n] <= 2 * most]
    for n in few:
        v = np.array([r[0] for r in numbers.select(n).where(f"not isnan({n})").distinct().orderBy(n).collect()])
        if len(v) <= most:
            out[n] = (v[1:] + v[:-1]) / 2
    many = [n for n in names if n not in out]
    probs = [i / most for i in range(1, most)]
    for n, q in (exact_quantiles(numbers, many, probs) if many else {}).items():
        out[n] = np.unique(np.array([x for x in q if x is not None], float))
    return out


def _keys(batch: pa.RecordBatch, cuts, classification: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of each cell of the batch, cell of each row, label or 0)."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
    bins = np.empty(x.shape, np.uint8)
    flags = [j for j, c in enumerate(cuts) if c is None]
    bins[:, flags] = x[:, flags] > 0.5
    for j, c in enumerate(cuts):
        if c is not None:
            bins[:, j] = np.searchsorted(c, x[:, j])
    _, first, own = np.unique(bins.view(np.dtype((np.void, len(cuts)))).ravel(), return_index=True, return_inverse=True)
    y = batch.column("label").to_numpy(zero_copy_only=False) if classification else np.zeros(batch.num_rows)
    return bins[first], own, y


# --- one tree ----------------------------------------------------------------


def grow(cells: Cells, stats: np.ndarray, *, classes: bool, depth: int, features: int, rng) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(nodes in level order, children behind their parents; the prediction for each cell).

    stats are per cell the drawn rows of each class, or (rows, sum, sum of squares) of a number.
    """
    width = cells.width
    start = np.concatenate([[0], np.cumsum(width)[:-1]])
    slots = int(width.sum())
    ends = np.zeros(slots, bool)
    ends[start + width - 1] = True  # behind the last bin nothing is left
    of = np.repeat(np.arange(len(width)), width)
    numbers = [j for j, c in enumerate(cells.cuts) if c is not None]
    place = cells.bins.astype(np.int64) + start

    def weight(s):
        return s.sum(axis=-1) if classes else s[..., 0]

    def impurity(s):
        n = np.maximum(weight(s), 1.0)
        if classes:
            return 1.0 - np.square(s / n[..., None]).sum(axis=-1)
        return (s[..., 2] - np.square(s[..., 1]) / n) / n

    node = np.zeros(len(stats), np.int64)
    nodes = {"stats": [stats.sum(axis=0)], "feature": [-1], "cut": [-1], "gain": [-1.0], "left": [-1], "right": [-1]}
    open_ = [0]
    for _ in range(depth):
        step = max(1, COUNTS_AT_ONCE // (slots * stats.shape[1]))
        split: list[int] = []
        for at in range(0, len(open_), step):
            some = np.array(open_[at : at + step])
            row = np.full(len(nodes["gain"]), -1)
            row[some] = np.arange(len(some))
            held = np.flatnonzero((row[node] >= 0) & (weight(stats) > 0))
            flat = (row[node[held]][:, None] * slots + place[held]).ravel()
            sums = np.stack([
                np.bincount(flat, np.repeat(stats[held, k], len(width)), len(some) * slots) for k in range(stats.shape[1])
            ], axis=-1).reshape(len(some), slots, -1)
            left = sums.copy()  # of flags the rows with 0 are left
            for j in numbers:
                own = slice(start[j], start[j] + width[j])
                left[:, own] = np.cumsum(sums[:, own], axis=1)
            whole = np.stack([nodes["stats"][i] for i in some])
            right = whole[:, None] - left
            n, l, r = weight(whole)[:, None], weight(left), weight(right)
            gain = impurity(whole)[:, None] - l / n * impurity(left) - r / n * impurity(right)
            gain[(l < 1) | (r < 1) | ends[None]] = -np.inf
            if features < len(width):
                drawn = np.zeros((len(some), len(width)), bool)
                chosen = rng.random(drawn.shape).argpartition(features, axis=1)[:, :features]
                np.put_along_axis(drawn, chosen, True, axis=1)
                gain[~drawn[:, of]] = -np.inf
            best = gain.argmax(axis=1)
            for i, b, g in zip(range(len(some)), best.tolist(), gain[np.arange(len(some)), best].tolist()):
                if g <= 0:
                    continue
                mine = int(some[i])
                nodes["feature"][mine], nodes["cut"][mine], nodes["gain"][mine] = int(of[b]), int(b - start[of[b]]), g
                for side, s in (("left", left[i, b]), ("right", right[i, b])):
                    nodes[side][mine] = len(nodes["gain"])
                    for name, value in (("stats", s), ("feature", -1), ("cut", -1), ("gain", -1.0), ("left", -1), ("right", -1)):
                        nodes[name].append(value)
                split.append(mine)
        if not split:
            break
        feature, cut, low, high = (np.array(nodes[k]) for k in ("feature", "cut", "left", "right"))
        moved = np.flatnonzero(low[node] >= 0)
        own = node[moved]
        node[moved] = np.where(cells.bins[moved, feature[own]] <= cut[own], low[own], high[own])
        children = [c for i in split for c in (nodes["left"][i], nodes["right"][i])]
        mixed = impurity(np.stack([nodes["stats"][c] for c in children])) >= PURE
        open_ = [c for c, m in zip(children, mixed) if m]
        if not open_:
            break
    made = {k: np.array(v) for k, v in nodes.items()}
    s = made["stats"]
    made["impurity"], made["rows"] = impurity(s), weight(s)
    made["prediction"] = s.argmax(axis=1).astype(float) if classes else s[:, 1] / np.maximum(s[:, 0], 1.0)
    told = made["prediction"][node]
    return _pruned(made), told


def _pruned(nodes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Two leaves that tell the same are one."""
    left, right, told = nodes["left"].copy(), nodes["right"].copy(), nodes["prediction"]
    gone = np.zeros(len(left), bool)
    for i in range(len(left) - 1, -1, -1):
        a, b = left[i], right[i]
        if a >= 0 and left[a] < 0 and left[b] < 0 and told[a] == told[b]:
            gone[[a, b]] = True
            left[i] = right[i] = -1
    number = np.cumsum(~gone) - 1
    out = {k: v[~gone] for k, v in (nodes | {"left": left, "right": right}).items()}
    leaf = out["left"] < 0
    for side in ("left", "right"):
        out[side] = np.where(leaf, -1, number[out[side]])
    out["gain"], out["feature"] = np.where(leaf, -1.0, out["gain"]), np.where(leaf, -1, out["feature"])
    return out


def _table(tree: int, nodes: dict[str, np.ndarray], cuts) -> pa.RecordBatch:
    """Nodes of a tree as MLlib stores them."""
    splits = []
    for f, c in zip(nodes["feature"].tolist(), nodes["cut"].tolist()):
        if f < 0:
            splits.append((-1, [], -1))
        else:
            splits.append((f, [0.0], 2) if cuts[f] is None else (f, [float(cuts[f][c])], -1))
    n = len(splits)
    split = pa.StructArray.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*splits), _SPLIT)], fields=list(_SPLIT))
    data = {
        "id": pa.array(range(n), pa.int32()), "prediction": pa.array(nodes["prediction"], pa.float64()),
        "impurity": pa.array(nodes["impurity"], pa.float64()), "impurityStats": pa.array(nodes["stats"].tolist(), pa.list_(pa.float64())),
        "rawCount": pa.array(np.rint(nodes["rows"]).astype(np.int64)), "gain": pa.array(nodes["gain"], pa.float64()),
        "leftChild": pa.array(nodes["left"], pa.int32()), "rightChild": pa.array(nodes["right"], pa.int32()), "split": split,
    }
    return pa.RecordBatch.from_arrays([pa.array([tree] * n, pa.int32()), pa.StructArray.from_arrays(data.values(), names=list(data))], ["treeID", "nodeData"])


# --- draws -------------------------------------------------------------------


def _drawn_counts(counts: np.ndarray, rate: float, replace: bool, rng) -> np.ndarray:
    """How many rows of each cell and class a tree gets, each row being drawn by itself."""
    if replace:
        return rng.poisson(counts * rate).astype(float)
    return (counts if rate >= 1 else rng.binomial(counts, rate)).astype(float)


def _drawn_sums(ready: DataFrame, cells: Cells, trees: int, rate: float, replace: bool, seed: int) -> DataFrame:
    """(tree, sums): per tree and task the drawn rows of each cell, their labels' sum and sum of squares."""
    at = ready.sparkSession.sparkContext.broadcast((cells.cuts, {b.tobytes(): i for i, b in enumerate(cells.bins)}))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, number = at.value
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums = np.zeros((len(number), 3, trees))
        for b in batches:
            keys, own, _ = _keys(b, cuts, False)
            cell = np.array([number[k.tobytes()] for k in keys])[own]
            label = b.column("label").to_numpy(zero_copy_only=False)
            for first in range(0, len(cell), ROWS_AT_ONCE):
                order = first + np.argsort(cell[first : first + ROWS_AT_ONCE], kind="stable")
                y, (found, starts) = label[order][:, None], np.unique(cell[order], return_index=True)
                shape = (len(order), trees)
                if replace:
                    w = rng.poisson(rate, shape).astype(float)
                else:
                    w = np.ones(shape) if rate >= 1 else (rng.random(shape, np.float32) < rate).astype(float)
                for k in range(3):
                    sums[found, k] += np.add.reduceat(w, starts, axis=0)
                    w *= y
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(trees), pa.int32()), pa.array([np.ascontiguousarray(sums[:, :, t]).tobytes() for t in range(trees)], pa.binary())],
            ["tree", "sums"],
        )

    return ready.select(vector_to_array("features").alias("x"), "label").mapInArrow(draw, "tree int, sums binary")


def _added(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return sum(np.frombuffer(s.as_buffer(), float) for s in table.column("sums")).reshape(-1, 3)


# --- whole models ------------------------------------------------------------


def _features_per_node(estimator, n: int, trees: int, classification: bool) -> int | None:
    strategy = estimator.getFeatureSubsetStrategy()
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classification else "onethird"
    known = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "onethird": math.ceil(n / 3.0)}
    if strategy in known:
        return known[strategy]
    return math.ceil(float(strategy) * n) if "." in strategy and 0 < float(strategy) <= 1 else None


def fit_trees(estimator, ready: DataFrame, cells: Cells | None):
    """The fitted MLlib model of a forest or of boosting; of any other estimator, or without cells, as MLlib fits it."""
    kind = type(estimator)
    if cells is None or kind not in _MODELS:
        return estimator.fit(ready)
    forest = kind in (RandomForestClassifier, RandomForestRegressor)
    trees = estimator.getNumTrees() if forest else estimator.getMaxIter()
    per_node = _features_per_node(estimator, len(cells.cuts), trees, kind is RandomForestClassifier)
    if per_node is None or kind is GBTClassifier and cells.classes != 2:
        return estimator.fit(ready)
    path = new_path(ready.sparkSession, "trees")
    (_forest if forest else _boosted)(estimator, ready, cells, trees, per_node).write.parquet(f"{path}/data")
    return _stored(estimator, ready.sparkSession, path, trees, cells)


def _forest(estimator, ready: DataFrame, cells: Cells, trees: int, per_node: int) -> DataFrame:
    """Trees are grown side by side, each in one task."""
    spark = ready.sparkSession
    shared = spark.sparkContext.broadcast(cells)
    classes, depth, seed = isinstance(estimator, RandomForestClassifier), estimator.getMaxDepth(), estimator.getSeed()
    rate, replace = estimator.getSubsamplingRate(), estimator.getBootstrap()

    def grown(tree: int, stats: np.ndarray | None) -> pa.RecordBatch:
        rng = np.random.default_rng([seed, tree])
        own = shared.value
        stats = _drawn_counts(own.counts, rate, replace, rng) if stats is None else stats
        nodes, _ = grow(own, stats, classes=classes, depth=depth, features=per_node, rng=rng)
        return _table(tree, nodes, own.cuts)

    if classes:
        many = min(trees, spark.sparkContext.defaultParallelism)
        return spark.range(0, trees, 1, many).mapInArrow(lambda bs: (grown(t, None) for b in bs for t in b.column("id").to_pylist()), NODES)
    drawn = _drawn_sums(ready, cells, trees, rate, replace, seed)
    return drawn.groupBy("tree").applyInArrow(lambda t: pa.Table.from_batches([grown(t.column("tree")[0].as_py(), _added(t))]), NODES)


def _boosted(estimator, ready: DataFrame, cells: Cells, rounds: int, per_node: int) -> DataFrame:
    """Each round's tree fits what the rounds before leave; the driver grows it from the counts of the cells."""
    spark = ready.sparkSession
    depth, seed, rate, learn = estimator.getMaxDepth(), estimator.getSeed(), estimator.getSubsamplingRate(), estimator.getStepSize()
    classes = isinstance(estimator, GBTClassifier)
    sums = {}
    if not classes:
        drawn = _drawn_sums(ready, cells, rounds, rate, False, seed).groupBy("tree").applyInArrow(
            lambda t: pa.table({"tree": t.column("tree")[:1], "sums": [_added(t).tobytes()]}), "tree int, sums binary")
        sums = {r["tree"]: np.frombuffer(bytes(r["sums"])).reshape(-1, 3) for r in drawn.collect()}
    score, tables, sign = np.zeros(len(cells.bins)), [], np.array([-1.0, 1.0])
    for m in range(rounds):
        rng = np.random.default_rng([seed, m])
        if classes:
            n = _drawn_counts(cells.counts, rate, False, rng)
            with np.errstate(over="ignore"):
                left_over = sign if m == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * score[:, None]))
            stats = np.stack([n.sum(axis=1), (n * left_over).sum(axis=1), (n * left_over**2).sum(axis=1)], axis=1)
        else:
            n, y, yy = sums[m].T
            stats = np.stack([n, y, yy] if m == 0 else [n, 2.0 * (y - score * n), 4.0 * (yy - 2.0 * score * y + score**2 * n)], axis=1)
        nodes, told = grow(cells, stats, classes=False, depth=depth, features=per_node, rng=rng)
        score = score + (told if m == 0 else learn * told)
        tables.append(_table(m, nodes, cells.cuts))
    return spark.createDataFrame(pa.Table.from_batches(tables), NODES)


def _stored(estimator, spark, path: str, trees: int, cells: Cells):
    """The model read by MLlib from its nodes and the parameters of the estimator."""
    model, name, tree_name = _MODELS[type(estimator)]
    boosted = not hasattr(estimator, "getNumTrees")

    def told(kind: str, uid: str, **more) -> str:
        given, default = ({p.name: v for p, v in of.items()} for of in (estimator._paramMap, estimator._defaultParamMap))
        if kind == tree_name:  # parameters that a tree has
            own = {"cacheNodeIds", "checkpointInterval", "featuresCol", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB", "minInfoGain",
                   "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed"} | (set() if boosted else {"impurity"})
            given, default = ({k: v for k, v in of.items() if k in own} for of in (given, default))
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid,
                           "paramMap": given, "defaultParamMap": default, **more})

    more = {"numFeatures": len(cells.cuts), "numTrees": trees} | ({"numClasses": cells.classes} if type(estimator) is RandomForestClassifier else {})
    spark.createDataFrame([(told(name, estimator.uid, **more),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    weights = [1.0 if not boosted or t == 0 else estimator.getStepSize() for t in range(trees)]
    rows = [(t, told(tree_name, f"tree_{t}"), w) for t, w in enumerate(weights)]
    spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return model.load(path)


__all__ = ["Cells", "find_cells", "fit_trees", "grow"]
