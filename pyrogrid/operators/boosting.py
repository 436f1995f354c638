"""Gradient-boosted trees for several classes, grown from histograms that Spark adds up.

Each round grows one tree per class on the slopes of the softmax loss, level by level.
A level is one pass over the rows: every task counts the slopes and curvatures of its
rows by (class, node, feature, bin), Spark adds the counts, and the best cut of each
node is chosen from running sums over the bins.  Only one row per node reaches the
driver, so nothing there grows with the data.

Features are cut into at most BINS bins at approximate quantiles.  Rows are stored as
bins, and their scores are renewed every STORE_EVERY rounds, so a pass evaluates few trees.

A tree is an array in heap order: the children of node i are 2 i and 2 i + 1.  Every
node has the value it would have as a leaf, so the steps along a row's path say what
each feature adds to each class's score (``contributions``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyrogrid.session import stored

BINS = 32
STORE_EVERY = 10
# Regularisation of leaf values, and the least curvature a child may have.
LAMBDA, LEAST_CURVATURE = 1.0, 1.0
# Rows that one task learns from; smaller tables are read in fewer tasks.
ROWS_PER_TASK = 50_000
# Gains that differ by less are equal; the first feature and the first cut then win.
GAIN_DIGITS = 9


@dataclass
class Boosted:
    """Classes, features, the cuts of each feature, and trees (rounds, classes, nodes)."""

    classes: list[str]
    features: list[str]
    cuts: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, classes: list[str], features: list[str], cuts: list[np.ndarray], depth: int) -> Boosted:
        shape = (0, len(classes), 2 ** (depth + 1))
        return cls(classes, features, cuts, np.zeros(shape, dtype=np.int16), np.zeros(shape, dtype=np.int16), np.zeros(shape))

    @property
    def rounds(self) -> int:
        return len(self.feature)

    def grown(self, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> Boosted:
        """The model with one more round of trees."""
        more = [np.concatenate([a, b[None]]) for a, b in ((self.feature, feature), (self.cut, cut), (self.value, value))]
        return Boosted(self.classes, self.features, self.cuts, *more)

    def bins_of(self, values: np.ndarray) -> np.ndarray:
        """Bin of each value (rows, features): how many cuts are smaller."""
        return np.column_stack([np.searchsorted(c, values[:, f], side="left") for f, c in enumerate(self.cuts)]).astype(np.uint8)

    def leaves(self, bins: np.ndarray, tree: int, of_class: int) -> np.ndarray:
        """The node that each row ends in."""
        return _leaves(bins, self.feature[tree, of_class], self.cut[tree, of_class])

    def raw(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Sum of the leaf values of the trees from round ``first`` on: (rows, classes)."""
        out = np.zeros((len(bins), len(self.classes)))
        for tree in range(first, self.rounds):
            for k in range(len(self.classes)):
                out[:, k] += self.value[tree, k, self.leaves(bins, tree, k)]
        return out

    def base(self) -> np.ndarray:
        """What each class's score is without any feature: the sum of its roots' values."""
        return self.value[:, :, 1].sum(axis=0)

    def contributions(self, bins: np.ndarray) -> np.ndarray:
        """What each feature adds to each class's score: (rows, classes, features)."""
        out = np.zeros((len(bins), len(self.classes), len(self.features)))
        rows = np.arange(len(bins))
        for tree in range(self.rounds):
            for k in range(len(self.classes)):
                feature, cut, value = self.feature[tree, k], self.cut[tree, k], self.value[tree, k]
                node = np.ones(len(bins), dtype=np.int64)
                moving = feature[node] >= 0
                while moving.any():
                    own, at = rows[moving], node[moving]
                    below = 2 * at + (bins[own, feature[at]] > cut[at])
                    out[own, k, feature[at]] += value[below] - value[at]
                    node[own] = below
                    moving = feature[node] >= 0
        return out

    def nodes(self) -> Iterator[tuple]:
        """(round, class, node, feature or null, cut or null, value) of every node in use."""
        for tree in range(self.rounds):
            for k, name in enumerate(self.classes):
                used = [1]
                while used:
                    node = used.pop()
                    f = int(self.feature[tree, k, node])
                    at = float(self.cuts[f][self.cut[tree, k, node]]) if f >= 0 else None
                    yield tree, name, node, self.features[f] if f >= 0 else None, at, float(self.value[tree, k, node])
                    used += [2 * node, 2 * node + 1] if f >= 0 else []

    def with_scores(self, df: DataFrame, contributions: bool = False) -> DataFrame:
        """``df`` with ``_raw`` and ``_p`` (arrays by class) and, if asked, ``_contributions`` (by class, then feature).

        The trees are broadcast; their size is that of the model.
        """
        shared = df.sparkSession.sparkContext.broadcast(self)

        def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            model = shared.value
            for columns in batches:
                values = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
                bins = model.bins_of(values)
                raw = model.raw(bins)
                out = {"raw": list(raw), "p": list(softmax(raw))}
                if contributions:
                    out["contributions"] = [list(map(list, one)) for one in model.contributions(bins)]
                yield pd.DataFrame(out)

        kind = "raw array<double>, p array<double>" + (", contributions array<array<double>>" if contributions else "")
        found = F.pandas_udf(of, kind)(*[F.col(f"x_{c}") for c in self.features])
        added = df.withColumn("_scored", found)
        names = {"_raw": F.col("_scored.raw"), "_p": F.col("_scored.p")}
        if contributions:
            names["_contributions"] = F.col("_scored.contributions")
        return added.withColumns(names).drop("_scored")

    def with_probabilities(self, df: DataFrame) -> DataFrame:
        return self.with_scores(df).drop("_raw")

    def save(self, spark: SparkSession, root: str) -> None:
        """Write the node table and the cuts as Parquet."""
        kind = "round int, cls string, node int, feature string, cut double, value double"
        spark.createDataFrame(list(self.nodes()), kind).coalesce(1).write.mode("overwrite").parquet(f"{root}/nodes")
        cuts = [(i, f, [float(v) for v in c]) for i, (f, c) in enumerate(zip(self.features, self.cuts, strict=True))]
        spark.createDataFrame(cuts, "i int, feature string, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(f"{root}/cuts")
        shape = [(self.classes, int(np.log2(self.value.shape[2])) - 1, self.rounds)]
        spark.createDataFrame(shape, "classes array<string>, depth int, rounds int").coalesce(1).write.mode("overwrite").parquet(f"{root}/shape")

    @staticmethod
    def load(spark: SparkSession, root: str) -> Boosted:
        shape = spark.read.parquet(f"{root}/shape").first()
        cuts = spark.read.parquet(f"{root}/cuts").orderBy("i").collect()
        features, tables = [r["feature"] for r in cuts], [np.array(r["cuts"]) for r in cuts]
        size = (shape["rounds"], len(shape["classes"]), 2 ** (shape["depth"] + 1))
        feature, cut, value = np.full(size, -1, dtype=np.int16), np.zeros(size, dtype=np.int16), np.zeros(size)
        for r in spark.read.parquet(f"{root}/nodes").toLocalIterator():
            at = (r["round"], shape["classes"].index(r["cls"]), r["node"])
            value[at] = r["value"]
            if r["feature"] is not None:
                feature[at] = features.index(r["feature"])
                cut[at] = np.searchsorted(tables[feature[at]], r["cut"])
        return Boosted(list(shape["classes"]), features, tables, feature, cut, value)


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node = np.ones(len(bins), dtype=np.int64)
    rows = np.arange(len(bins))
    moving = feature[node] >= 0
    while moving.any():
        own, at = rows[moving], node[moving]
        node[own] = 2 * at + (bins[own, feature[at]] > cut[at])
        moving = feature[node] >= 0
    return node


def quantile_cuts(df: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins`` - 1 cuts of each column, where shares of 1 / bins of the rows end; the largest value is no cut."""
    shares = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in columns], *[F.max(c).alias(f"{c}_top") for c in columns]).first()
    return [np.unique([v for v in found[c] or [] if v < found[f"{c}_top"]]) for c in columns]


def slopes(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted softmax loss by each class's score."""
    p = softmax(raw)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1.0
    return g * weight[:, None], np.maximum(2.0 * p * (1.0 - p), 1e-16) * weight[:, None]


def _counted(table: DataFrame, model: Boosted, first: int, feature: np.ndarray, cut: np.ndarray, level: int) -> DataFrame:
    """(cls, node, feature, bin, g, h): sums over the rows of each node of ``level`` of this round's trees."""
    shared = table.sparkSession.sparkContext.broadcast((model, first, feature, cut))
    classes, features, bins = len(model.classes), len(model.features), BINS

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, begin, growing, at = shared.value
        nodes = 2**level
        sums = np.zeros((2, classes * nodes * features * bins))
        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, features)
            y, w = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.float64).reshape(-1, classes) + own.raw(b, begin)
            g, h = slopes(raw, y, w)
            for k in range(classes):
                node = _leaves(b, growing[k], at[k]) - nodes
                here = node >= 0
                cell = ((k * nodes + node[here, None]) * features + np.arange(features)) * bins + b[here]
                for side, d in enumerate((g, h)):
                    sums[side] += np.bincount(cell.ravel(), weights=np.repeat(d[here, k], features), minlength=sums.shape[1])
        cell = np.flatnonzero(sums[1])
        parts = np.unravel_index(cell, (classes, nodes, features, bins))
        columns = [pa.array(p + (nodes if i == 1 else 0), pa.int32()) for i, p in enumerate(parts)] + [pa.array(s[cell], pa.float64()) for s in sums]
        yield pa.record_batch(columns, names=["cls", "node", "feature", "bin", "g", "h"])

    found = table.mapInArrow(of, "cls int, node int, feature int, bin int, g double, h double")
    return found.groupBy("cls", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_cuts(counted: DataFrame) -> DataFrame:
    """(cls, node, feature, bin, gain, left_g, left_h, g, h): the best cut of each node that has one.

    ``bin`` and all below go left.  Of equal gains the first feature and cut win.
    """
    whole = Window.partitionBy("cls", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counted.select(
        "cls", "node", "feature", "bin", F.sum("g").over(upto).alias("left_g"), F.sum("h").over(upto).alias("left_h"),
        F.sum("g").over(whole).alias("g"), F.sum("h").over(whole).alias("h"),
    )

    def part(g, h):
        return g * g / (h + LAMBDA)

    right_g, right_h = F.col("g") - F.col("left_g"), F.col("h") - F.col("left_h")
    gain = F.round(part(F.col("left_g"), F.col("left_h")) + part(right_g, right_h) - part(F.col("g"), F.col("h")), GAIN_DIGITS)
    open_ = sums.withColumn("gain", gain).filter((F.col("left_h") >= LEAST_CURVATURE) & (right_h >= LEAST_CURVATURE) & (F.col("gain") > 0))
    order = F.struct((-F.col("gain")).alias("a"), F.col("feature").alias("b"), F.col("bin").alias("c"))
    best = F.min_by(F.struct("feature", "bin", "gain", "left_g", "left_h", "g", "h"), order).alias("best")
    return open_.groupBy("cls", "node").agg(best).select("cls", "node", "best.*")


def binned(df: DataFrame, features: list[str], cuts: list[np.ndarray], classes: list[str]) -> DataFrame:
    """(bins, y, weight, scores) of rows with ``x_`` columns, cls and weight; scores start at 0."""
    shell = Boosted.empty(classes, features, cuts, 0)
    number = F.create_map(*[F.lit(v) for k, c in enumerate(classes) for v in (c, k)])
    rows = df.select(F.array(*[F.col(f"x_{c}") for c in features]).alias("x"), number[F.col("cls")].alias("y"), F.col("weight").cast("double").alias("weight"))
    zero = np.zeros(len(classes)).tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                found = shell.bins_of(values)
                columns = [pa.array([r.tobytes() for r in found], pa.binary()), batch.column(1), batch.column(2), pa.array([zero] * batch.num_rows, pa.binary())]
                yield pa.record_batch(columns, names=["bins", "y", "weight", "scores"])

    return rows.filter("y is not null").mapInArrow(of, "bins binary, y int, weight double, scores binary")


def _rescored(table: DataFrame, model: Boosted, first: int) -> DataFrame:
    """``table`` with the trees from round ``first`` on added to its scores."""
    shared = table.sparkSession.sparkContext.broadcast((model, first))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, begin = shared.value
        for batch in batches:
            if batch.num_rows:
                b = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1) + own.raw(b, begin)
                yield pa.record_batch([*batch.columns[:3], pa.array([r.tobytes() for r in raw], pa.binary())], names=["bins", "y", "weight", "scores"])

    return table.mapInArrow(of, "bins binary, y int, weight double, scores binary")


def boost(
    df: DataFrame, features: list[str], rounds: int = 300, depth: int = 6, rate: float = 0.05, bins: int = BINS
) -> Boosted:
    """Fit trees to rows with columns ``x_<feature>`` (never null), ``cls`` and ``weight``."""
    df = stored(df.select(*[F.col(f"x_{c}").cast("double").alias(f"x_{c}") for c in features], "cls", "weight"), "rows")
    classes = sorted(r[0] for r in df.select("cls").filter("cls is not null").distinct().collect())
    cuts = quantile_cuts(df, [f"x_{c}" for c in features], min(bins, BINS))
    model = Boosted.empty(classes, features, cuts, depth)
    if not classes:
        return model
    tasks = max(1, -(-df.count() // ROWS_PER_TASK))
    table = binned(df, features, cuts, classes)
    table = stored(table.coalesce(tasks), "bins")
    first = 0
    for number in range(rounds):
        if number - first == STORE_EVERY:
            table, first = stored(_rescored(table, model, first), "bins"), number
        shape = (len(classes), 2 ** (depth + 1))
        feature, cut, value = np.full(shape, -1, dtype=np.int16), np.zeros(shape, dtype=np.int16), np.zeros(shape)
        for level in range(depth):
            found = best_cuts(_counted(table, model, first, feature, cut, level)).collect()
            for r in found:
                k, node = r["cls"], r["node"]
                feature[k, node], cut[k, node] = r["feature"], r["bin"]
                sides = {node: (r["g"], r["h"]), 2 * node: (r["left_g"], r["left_h"]), 2 * node + 1: (r["g"] - r["left_g"], r["h"] - r["left_h"])}
                for n, (g, h) in sides.items():
                    value[k, n] = -rate * g / (h + LAMBDA)
            if not found:
                break
        if (feature[:, 1] < 0).all():
            break
        model = model.grown(feature, cut, value)
    return model
