"""Gradient-boosted trees for many models in one growth.

A frame holds the training rows of all models side by side, with the column model. Each model learns a quantile (the
column q; 0.5 is the absolute loss) or, where q is null, the mean (squared loss). Trees grow best first: of all leaves,
the one whose split gains most is split next, up to a number of leaves. Missing values are a bin of their own, and every
split sends them to the side where they gain more (or, unseen, to the larger side). Categories are split into two sets, by
the order of their mean gradient. After growth, a leaf's value is the quantile (or mean) of what its rows leave over.

Rows are first cut to bins by each model's own quantiles, one byte a feature. Then:

* a model of at most local_rows rows, which are counted first, is one group of an applyInArrow: all its rounds run in one
  task, all models at once in one stage, each lost task on its own repeated;
* a larger one stays dealt out. Tasks route rows through the trees so far and add up their bins; partial sums meet by
  (model, node, feature and bin), the driver picks splits from those sums, whose number does not depend on the rows.
  Leaf quantiles are Spark's mergeable sketches. Every few rounds what trees add up to is stored, which ends the lineage.

Growth goes in waves so that both need few steps: a wave evaluates the children of all splits that would be made if
children had no split of their own, and the order of splits is replayed until it holds nothing unevaluated. The tree is
then the same as if leaves had been split one at a time.

Trees are a table: (model, round, feature, low, high, goes, value, gain), one array entry a node. A frame to forecast
meets them by model; they are broadcast (rounds x leaves numbers a model; the models are cells and origins, not rows).

Edge cases: rows with a null y or model are not learned from. A model without training rows has no tree, and rows to forecast
of such a model are left out. Rows that repeat count each. Values not finite are null. A category that is not among the
most frequent (bins - 2) shares one bin with all such, unseen ones too.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretable.sources.files import stored
from foretable.sources.packing import ship

#: Rounds after which what the trees of large models add up to is stored.
STORED_EVERY = 10
MOST_TASKS = 2_000
TREES = "model string, round int, feature array<int>, low array<int>, high array<int>, goes array<binary>, value array<double>, gain array<double>"


@dataclass(frozen=True)
class Growth:
    """rows, columns: the share of rows and of features that each round draws. least: rows of a leaf at least."""

    rounds: int = 100
    step: float = 0.1
    leaves: int = 31
    least: int = 20
    rows: float = 0.9
    columns: float = 0.9
    bins: int = 64
    seed: int = 0
    local_rows: int = 300_000


@dataclass
class Coding:
    """How values become bins. edges: of each model and number, ascending; a value's bin is how many edges are below it. codes: of
    each category. The last bin of width stands for what is missing."""

    numbers: tuple[str, ...]
    categories: tuple[str, ...]
    edges: dict[str, list[np.ndarray]]
    codes: list[dict[str, int]]
    width: int

    def binned(self, batch: pa.RecordBatch, models: np.ndarray) -> np.ndarray:
        """(rows, features), a byte each, of rows whose models have edges."""
        out = np.full((batch.num_rows, len(self.numbers) + len(self.categories)), self.width - 1, np.uint8)
        values = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in self.numbers]
        for m in np.unique(models):
            at = np.flatnonzero(models == m)
            for i, v in enumerate(values):
                x = v[at]
                there = np.isfinite(x)
                out[at[there], i] = np.searchsorted(self.edges[m][i], x[there])
        for i, c in enumerate(self.categories):
            seen = batch.column(c).dictionary_encode()
            codes = np.array([*(self.codes[i].get(v, self.width - 2) for v in seen.dictionary.to_pylist()), self.width - 1], np.uint8)
            out[:, len(self.numbers) + i] = codes[seen.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)]
        return out


def strings(column: pa.Array) -> np.ndarray:
    """A column of few distinct strings without nulls, as objects."""
    seen = column.dictionary_encode()
    return np.array(seen.dictionary.to_pylist(), object)[seen.indices.to_numpy(zero_copy_only=False)] if len(column) else np.array([], object)


def packed(x: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def unpacked(column: pa.Array | pa.ChunkedArray, features: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * features, column.offset * features).reshape(len(column), features)


@dataclass
class Tree:
    """Node 0 is the root; feature is -1 at a leaf. goes: (nodes, bins), whether a bin's rows go to low."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    goes: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[self.feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = np.where(self.goes[at, x[rows, self.feature[at]]], self.low[at], self.high[at])
        return node

    def row(self, model: str, number: int) -> tuple:
        return model, number, self.feature.tolist(), self.low.tolist(), self.high.tolist(), [g.tobytes() for g in np.packbits(self.goes, axis=1)], self.value.tolist(), self.gain.tolist()

    @staticmethod
    def of(r, width: int) -> Tree:
        goes = np.unpackbits(np.array([list(g) for g in r["goes"]], np.uint8), axis=1)[:, :width].astype(bool)
        return Tree(*(np.array(r[c], np.int64) for c in ("feature", "low", "high")), goes, np.array(r["value"]), np.array(r["gain"]))


def best_splits(g: np.ndarray, n: np.ndarray, categorical: np.ndarray, usable: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and which bins go to low, for each node. g, n: (nodes, features, bins), gradients and rows; nulls in the last bin."""
    all_g, all_n = g[:, 0].sum(axis=1), n[:, 0].sum(axis=1)
    nodes, features, width = g.shape
    order = np.broadcast_to(np.arange(width - 1), (nodes, features, width - 1)).copy()
    mean = np.where(n[:, categorical, :-1] > 0, g[:, categorical, :-1] / np.maximum(n[:, categorical, :-1], 1), np.inf)
    order[:, categorical] = np.argsort(mean, axis=2, kind="stable")
    low_g, low_n = (np.take_along_axis(v[:, :, :-1], order, axis=2).cumsum(axis=2) for v in (g, n))
    low_g, low_n = (np.stack([v, v + w[:, :, -1:]], axis=1) for v, w in ((low_g, g), (low_n, n)))  # nulls to high, nulls to low
    high_g, high_n = all_g[:, None, None, None] - low_g, all_n[:, None, None, None] - low_n
    fine = (low_n >= least) & (high_n >= least) & usable[None, None, :, None]
    gains = np.where(fine, low_g**2 / np.maximum(low_n, 1) + high_g**2 / np.maximum(high_n, 1) - (all_g**2 / np.maximum(all_n, 1))[:, None, None, None], 0.0)
    best = gains.reshape(nodes, -1).argmax(axis=1)
    nulls_low, feature, place = np.unravel_index(best, gains.shape[1:])
    at = np.arange(nodes)
    goes = np.zeros((nodes, width), bool)
    chosen = order[at, feature]
    goes[at[:, None], chosen] = np.arange(width - 1) <= place[:, None]
    larger = low_n[at, nulls_low, feature, place] >= high_n[at, nulls_low, feature, place]
    goes[:, -1] = np.where(n[at, feature, -1] > 0, nulls_low == 1, larger)
    return gains[at, nulls_low, feature, place], feature, goes


class Grower:
    """One tree in the making. Nodes keep the number that they get when their parent's split is first followed."""

    def __init__(self, p: Growth, categorical: np.ndarray, usable: np.ndarray) -> None:
        self.p, self.categorical, self.usable = p, categorical, usable
        self.gain, self.feature, self.goes, self.children = {}, {}, {}, {}
        self.asked, self.split = [0], []

    def learn(self, g: np.ndarray, n: np.ndarray) -> list[int]:
        """Takes the sums of the nodes asked for; gives the nodes that are now followed to new children, which are asked for next."""
        for node, gain, feature, goes in zip(self.asked, *best_splits(g, n, self.categorical, self.usable, self.p.least), strict=True):
            self.gain[node], self.feature[node], self.goes[node] = float(gain), int(feature), goes
        queue, self.split = [(-self.gain[0], 0)], []
        while queue and len(self.split) < self.p.leaves - 1:
            gain, node = heapq.heappop(queue)
            if gain >= -1e-12:
                break
            self.split.append(node)
            for child in self.children.get(node, ()):
                heapq.heappush(queue, (-self.gain[child], child))
        new = [node for node in self.split if node not in self.children]
        for node in new:
            first = 1 + 2 * len(self.children)
            self.children[node] = (first, first + 1)
        self.asked = [c for node in new for c in self.children[node]]
        return new

    def tree(self) -> tuple[Tree, np.ndarray]:
        """The tree, its leaves' values 0; and of every node that was made, the node of the tree that its rows are in."""
        made = 1 + 2 * len(self.children)
        split, number, owner = set(self.split), {}, np.zeros(made, np.int64)
        stack = [(0, None)]
        while stack:
            node, held = stack.pop()
            if held is None:
                number[node] = len(number)
            owner[node] = number[node] if held is None else held
            stack += [(c, None if held is None and node in split else owner[node]) for c in self.children.get(node, ())]
        n, width = len(number), len(self.goes[0])
        t = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, width), bool), np.zeros(n), np.zeros(n))
        for node in split:
            i = number[node]
            t.feature[i], t.goes[i], t.gain[i] = self.feature[node], self.goes[node], self.gain[node]
            t.low[i], t.high[i] = (number[c] for c in self.children[node])
        return t, owner


def drawn(ids: np.ndarray, number: int, p: Growth) -> np.ndarray:
    """Whether a row takes part in a round: a hash of its id and the round."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 + p.seed & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) < p.rows * 2.0**53


def usable(features: int, number: int, p: Growth) -> np.ndarray:
    out = np.zeros(features, bool)
    out[np.random.default_rng([p.seed, number]).permutation(features)[: max(1, int(np.ceil(p.columns * features)))]] = True
    return out


def sums(x: np.ndarray, w: np.ndarray, place: np.ndarray, nodes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, features, bins): of w and of rows, for rows at place (below 0: nowhere)."""
    at = place >= 0
    cells = ((place[at, None] * x.shape[1] + np.arange(x.shape[1])) * width + x[at]).ravel()
    shape, size = (nodes, x.shape[1], width), nodes * x.shape[1] * width
    return np.bincount(cells, np.repeat(w[at], x.shape[1]), size).reshape(shape), np.bincount(cells, minlength=size).reshape(shape)


def weights(y: np.ndarray, f: np.ndarray, q: float | None) -> np.ndarray:
    """What is added up by bin: rows above the forecast (whole numbers, so that sums are exact), or what is left over."""
    return y - f if q is None else (y > f).astype(np.float64)


def gradients(w: np.ndarray, n: np.ndarray, q: float | None) -> np.ndarray:
    return -w if q is None else (1 - q) * n - w


def leaf_values(rest: np.ndarray, leaf: np.ndarray, nodes: int, q: float | None) -> np.ndarray:
    """The mean, or the least value that a share q of the rows does not exceed; 0 for a node without rows."""
    count = np.bincount(leaf, minlength=nodes)
    if q is None:
        return np.bincount(leaf, rest, nodes) / np.maximum(count, 1)
    if nodes == 1 and len(rest):
        at = max(int(np.ceil(np.round(q * len(rest), 9))), 1) - 1
        return np.partition(rest, at)[at : at + 1]
    ordered, starts = rest[np.lexsort((rest, leaf))], np.cumsum(count) - count
    at = starts + np.maximum(np.ceil(np.round(q * count, 9)).astype(np.int64), 1) - 1
    return np.where(count > 0, ordered[np.minimum(at, max(len(rest) - 1, 0))], 0.0)


def boosted(x: np.ndarray, y: np.ndarray, ids: np.ndarray, q: float | None, categorical: np.ndarray, width: int, p: Growth) -> Iterator[Tree]:
    """One model's trees, the first a single leaf; values are shrunk. Each node keeps the places of its rows; of two children only the
    smaller one is counted, the other is what is left of their parent."""
    start = leaf_values(y, np.zeros(len(y), np.int64), 1, q)
    yield Tree(np.array([-1]), np.array([0]), np.array([0]), np.zeros((1, width), bool), start, np.zeros(1))
    f, features = np.full(len(y), start[0]), x.shape[1]
    by_feature, size = np.ascontiguousarray(x.T), x.shape[1] * width
    cells = np.arange(features) * width + x.astype(np.int64)

    def counted(rows: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = cells[rows]
        if q is None:
            s, n = np.bincount(own.ravel(), np.repeat(w[rows], features), size), np.bincount(own.ravel(), minlength=size)
        else:  # w is 0 or 1: both counts at once
            both = np.bincount((own + size * w[rows].astype(np.int64)[:, None]).ravel(), minlength=2 * size)
            s, n = both[size:], both[:size] + both[size:]
        return s.reshape(features, width), n.reshape(features, width)

    for number in range(p.rounds):
        take, w = drawn(ids, number, p), weights(y, f, q)
        grower = Grower(p, categorical, usable(features, number, p))
        rows = {0: (np.flatnonzero(take), np.flatnonzero(~take))}
        held = {0: counted(rows[0][0], w)}
        while grower.asked:
            s, n = (np.stack([held[node][i] for node in grower.asked]) for i in range(2))
            for parent in grower.learn(gradients(s, n, q), n):
                low, high = grower.children[parent]
                column, goes = by_feature[grower.feature[parent]], grower.goes[parent]
                sides = [goes[column[part]] for part in rows[parent]]
                rows[low], rows[high] = (tuple(part[side == way] for part, side in zip(rows[parent], sides, strict=True)) for way in (True, False))
                less, more = sorted((low, high), key=lambda c: len(rows[c][0]))
                held[less] = counted(rows[less][0], w)
                held[more] = tuple(a - b for a, b in zip(held.pop(parent), held[less], strict=True))
        tree, owner = grower.tree()
        rest, leaf_rows = y - f, {}
        for node in range(len(owner)):
            if tree.feature[owner[node]] < 0:
                leaf_rows.setdefault(owner[node], node)  # the first made is the leaf itself, later ones lie below it
        for leaf, node in leaf_rows.items():
            taken, others = rows[node]
            tree.value[leaf] = p.step * leaf_values(rest[taken], np.zeros(len(taken), np.int64), 1, q)[0]
            f[taken] += tree.value[leaf]
            f[others] += tree.value[leaf]
        yield tree


def _tree_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.binary()), *[pa.list_(pa.float64())] * 2]
    names = [c.split()[0] for c in TREES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


@dataclass
class Forest:
    """The trees of all models, and how rows become bins."""

    trees: DataFrame
    coding: Coding

    def predict(self, rows: DataFrame, least: float | None = 0.0) -> DataFrame:
        """rows of models that have trees, with y_hat (not below least)."""
        spark, width = rows.sparkSession, self.coding.width
        ship(spark)
        by_model: dict[str, list[Tree]] = {}
        for r in self.trees.orderBy("model", "round").collect():
            by_model.setdefault(r["model"], []).append(Tree.of(r, width))
        shared = spark.sparkContext.broadcast((by_model, self.coding))
        rows = rows.drop("y_hat")
        schema = rows.select("*", F.lit(0.0).alias("y_hat")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, coding = shared.value
            for batch in batches:
                batch = batch.filter(pa.array([m in forest for m in batch.column("model").to_pylist()], pa.bool_()))
                models = strings(batch.column("model"))
                x, out = coding.binned(batch, models), np.zeros(batch.num_rows)
                for m in np.unique(models):
                    at = np.flatnonzero(models == m)
                    part = x[at]
                    for tree in forest[m]:
                        out[at] += tree.value[tree.leaves(part)]
                out = out if least is None else np.maximum(out, least)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=schema.names)

        return rows.mapInArrow(run, schema)

    def importance(self) -> DataFrame:
        """(feature, share): each feature's share of what all splits gained; 0 for those that were never split on."""
        names = [*self.coding.numbers, *self.coding.categories]
        parts = self.trees.select(F.explode(F.arrays_zip("feature", "gain")).alias("s")).where("s.feature >= 0").groupBy(F.col("s.feature").alias("ix")).agg(F.sum("s.gain").alias("gain"))
        every = self.trees.sparkSession.createDataFrame(list(enumerate(names)), "ix int, feature string").join(parts, "ix", "left")
        total = parts.agg(F.sum("gain").alias("total"))
        return every.crossJoin(F.broadcast(total)).select("feature", F.coalesce(F.try_divide("gain", "total"), F.lit(0.0)).alias("share"))


def coded(train: DataFrame, numbers: tuple[str, ...], categories: tuple[str, ...], bins: int) -> Coding:
    """Quantiles of each model's numbers, and the most frequent values of each category: what reaches the driver grows with models
    and features."""
    codes = []
    for c in categories:
        most = train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(254).collect()
        codes.append({r[c]: i for i, r in enumerate(sorted(most, key=lambda r: r[c]))})
    width = 256 if any(len(x) > bins - 2 for x in codes) else bins
    cuts = F.array(*(F.lit(i / (bins - 1)) for i in range(1, bins - 1)))
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    rows = train.groupBy("model").agg(*(F.percentile_approx(value(c), cuts, 1_000).alias(f"e{i}") for i, c in enumerate(numbers))).collect()
    edges = {r["model"]: [np.unique(np.array(r[f"e{i}"] or [], float)) for i in range(len(numbers))] for r in rows}
    return Coding(tuple(numbers), tuple(categories), edges, codes, width)


def fit(train: DataFrame, numbers: tuple[str, ...], categories: tuple[str, ...] = (), p: Growth = Growth()) -> Forest:
    """train: model, q, y, the numbers and categories. A model that may not use a feature has it null in all its rows."""
    spark = train.sparkSession
    ship(spark)
    train = train.where(F.col("y").isNotNull() & F.col("model").isNotNull()).select("model", F.col("q").cast("double").alias("q"), F.col("y").cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in numbers), *(F.col(c).cast("string").alias(c) for c in categories))
    train = stored(train.withColumn("id", F.xxhash64(*train.columns)), "train")
    coding = coded(train, numbers, categories, p.bins)
    categorical = np.arange(len(numbers) + len(categories)) >= len(numbers)
    shared = spark.sparkContext.broadcast(coding)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.binned(batch, strings(batch.column("model")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("model", "q", "y", "id")), packed(x)], names=["model", "q", "y", "id", "bins"])

    rows = stored(train.mapInArrow(cut, "model string, q double, y double, id long, bins binary"), "binned")
    sizes = {r["model"]: (r["count"], r["q"]) for r in rows.groupBy("model").agg(F.count("*").alias("count"), F.first("q").alias("q")).collect()}
    large = {m: q for m, (n, q) in sizes.items() if n > p.local_rows}

    def local(table: pa.Table) -> pa.Table:
        # rows in the order of their ids, so that sums do not depend on how they were dealt
        table = table.sort_by([("id", "ascending"), ("y", "ascending")])
        x = unpacked(table.column("bins"), len(categorical))
        q, model = table.column("q")[0].as_py(), table.column("model")[0].as_py()
        made = boosted(x, table.column("y").to_numpy(), table.column("id").to_numpy(), q, categorical, shared.value.width, p)
        return pa.Table.from_batches([_tree_batch([t.row(model, i) for i, t in enumerate(made)])])

    # as many partitions as models, so that a task has few of them and a long one does not wait behind others
    trees = rows.where(~F.col("model").isin(list(large))).repartition(max(1, min(len(sizes) - len(large), MOST_TASKS)), "model").groupBy("model").applyInArrow(local, TREES)
    if large:
        made = [t.row(m, i) for m, ts in _dealt_out(rows.where(F.col("model").isin(list(large))), large, categorical, coding.width, p).items() for i, t in enumerate(ts)]
        trees = trees.unionByName(spark.createDataFrame(made, TREES))
    return Forest(stored(trees, "trees"), coding)


def _dealt_out(rows: DataFrame, models: dict[str, float | None], categorical: np.ndarray, width: int, p: Growth) -> dict[str, list[Tree]]:
    """The trees of models whose rows stay dealt out."""
    spark, features = rows.sparkSession, len(categorical)
    qs = sorted({q for q in models.values() if q is not None})
    sketch = F.percentile_approx("v", F.array(*map(F.lit, qs)), 10_000) if qs else F.lit(None)
    values = lambda found, q: found["mean"] if q is None else found["cuts"][qs.index(q)]
    starts = rows.withColumn("v", F.col("y")).groupBy("model").agg(F.avg("v").alias("mean"), sketch.alias("cuts")).collect()
    out = {r["model"]: [Tree(np.array([-1]), np.array([0]), np.array([0]), np.zeros((1, width), bool), np.array([values(r, models[r["model"]])]), np.zeros(1))] for r in starts}
    rows = rows.withColumn("f", F.lit(0.0))
    since = 0  # trees before this one are in f

    def each(of: dict[str, list[Tree]], made: Callable[[pa.RecordBatch, str, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, frame: DataFrame) -> DataFrame:
        """made(rows of one model, model, bins, y, forecast so far) over all rows."""
        shared = spark.sparkContext.broadcast(of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = strings(batch.column("model"))
                for m in np.unique(names):
                    part = batch.filter(pa.array(names == m))
                    x = unpacked(part.column("bins"), features)
                    f = part.column("f").to_numpy().copy()
                    for tree in shared.value[m]:
                        f += tree.value[tree.leaves(x)]
                    yield made(part, m, x, part.column("y").to_numpy(), f)

        return frame.mapInArrow(run, schema)

    for number in range(p.rounds):
        recent = {m: ts[since:] for m, ts in out.items()}
        growers = {m: Grower(p, categorical, usable(features, number, p)) for m in models}
        while asked := {m: g for m, g in growers.items() if g.asked}:
            # trees that lead to the nodes asked for: every split that was ever followed
            paths = {m: (_followed(g, width), np.array(g.asked)) for m, g in asked.items()}

            def counted(part: pa.RecordBatch, m: str, x: np.ndarray, y: np.ndarray, f: np.ndarray, paths: dict = paths, number: int = number) -> pa.RecordBatch:
                way, nodes = paths[m]
                take = drawn(part.column("id").to_numpy(), number, p)
                place = np.full(len(way.feature), -1)
                place[nodes] = np.arange(len(nodes))
                s, n = sums(x[take], weights(y, f, models[m])[take], place[way.leaves(x[take])], len(nodes), width)
                cells = np.flatnonzero(n)
                return pa.RecordBatch.from_arrays([pa.array([m] * len(cells), pa.string()), pa.array(cells), pa.array(s.ravel()[cells]), pa.array(n.ravel()[cells])], names=["model", "cell", "s", "n"])

            found = each(recent, counted, "model string, cell long, s double, n long", rows.where(F.col("model").isin(list(asked)))).groupBy("model", "cell").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
            names = np.array(found.column("model").to_pylist(), object)
            for m, g in asked.items():
                at, shape = np.flatnonzero(names == m), (len(g.asked), features, width)
                s, n = np.zeros(shape), np.zeros(shape, np.int64)
                cells = found.column("cell").to_numpy()[at]
                s.ravel()[cells], n.ravel()[cells] = found.column("s").to_numpy()[at], found.column("n").to_numpy()[at]
                g.learn(gradients(s, n, models[m]), n)
        grown = {m: g.tree()[0] for m, g in growers.items()}

        def left(part: pa.RecordBatch, m: str, x: np.ndarray, y: np.ndarray, f: np.ndarray, grown: dict = grown, number: int = number) -> pa.RecordBatch:
            take = drawn(part.column("id").to_numpy(), number, p)
            return pa.RecordBatch.from_arrays([pa.array([m] * int(take.sum()), pa.string()), pa.array(grown[m].leaves(x[take])), pa.array((y - f)[take])], names=["model", "leaf", "v"])

        for r in each(recent, left, "model string, leaf long, v double", rows).groupBy("model", "leaf").agg(F.avg("v").alias("mean"), sketch.alias("cuts")).collect():
            grown[r["model"]].value[r["leaf"]] = p.step * values(r, models[r["model"]])
        for m, t in grown.items():
            out[m].append(t)
        if number % STORED_EVERY == STORED_EVERY - 1:
            told = lambda part, m, x, y, f: pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "f"), pa.array(f)], names=part.schema.names)
            rows = stored(each({m: ts[since:] for m, ts in out.items()}, told, "model string, q double, y double, id long, bins binary, f double", rows), "boosting")
            since = number + 2
    return out


def _followed(g: Grower, width: int) -> Tree:
    n = 1 + 2 * len(g.children)
    t = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, width), bool), np.zeros(n), np.zeros(n))
    for node, (low, high) in g.children.items():
        t.feature[node], t.goes[node], t.low[node], t.high[node] = g.feature[node], g.goes[node], low, high
    return t
