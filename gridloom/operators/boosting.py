"""Gradient-boosted trees of all walk-forward windows at once, by histograms.

Features are binned once and rows packed into blocks, which are written to the
shared folder: the plans of a fit's jobs start there, and are as short in the last
round as in the first. A level of a round's trees is one job: each block adds up, per window and open node, the gradients and counts of every
feature's bins; the blocks' sums meet by window, and the driver, which holds
trees and sums but no rows, picks the splits. Every window is fitted by the same
jobs; a row counts in all windows that train on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.sinks import fresh_folder

#: Rows of a block; rounds after which the blocks' predictions are brought up to date.
BLOCK_ROWS, FRESH = 65_536, 20
_NONE = -1


@dataclass(frozen=True)
class Boosting:
    """Settings of a fit: rounds, shrinkage, depth, bins a feature, L2 on leaf values, and least rows of a leaf."""

    rounds: int = 200
    rate: float = 0.05
    depth: int = 3
    bins: int = 64
    l2: float = 1.0
    least: int = 20


def leaf_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node each row reaches in ``levels`` steps of a tree in heap order; from a node without a split all go left."""
    node = np.zeros(len(bins), dtype=np.int64)
    rows = np.arange(len(bins))
    for _ in range(levels):
        f = feature[node]
        right = (f != _NONE) & (bins[rows, np.maximum(f, 0)] > cut[node])
        node = 2 * node + 1 + right
    return node


def best_splits(grad: np.ndarray, count: np.ndarray, s: Boosting) -> tuple[np.ndarray, np.ndarray]:
    """(feature, last bin of the left side) per node from its histograms (node, feature, bin); -1 without a gain."""
    left, n = grad.cumsum(axis=2)[:, :, :-1], count.cumsum(axis=2)[:, :, :-1]
    all_, m = grad.sum(axis=2)[:, :, None], count.sum(axis=2)[:, :, None]
    score = lambda g, h: g * g / (h + s.l2)
    gain = score(left, n) + score(all_ - left, m - n) - score(all_, m)
    gain = np.where((n >= s.least) & (m - n >= s.least), np.round(gain, 9), -np.inf).reshape(len(grad), -1)
    at = gain.argmax(axis=1)
    fine = gain[np.arange(len(gain)), at] > 1e-7
    return np.where(fine, at // left.shape[2], _NONE), np.where(fine, at % left.shape[2], 0)


def _bin(panel: DataFrame, xs: list[str], edges: list[list[float]]) -> list:
    """Bin numbers of the features: how many edges lie below the value."""
    below = lambda x: lambda c: c < F.col(x)
    grid = lambda cut: F.array(*map(F.lit, cut)).cast("array<double>")
    return [F.size(F.filter(grid(cut), below(x))).cast("int").alias(f"_b{i}") for i, (x, cut) in enumerate(zip(xs, edges, strict=True))]


_BLOCK = "y binary, step binary, bins binary, pred binary"


def _pack(k: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                bins = np.stack([part.column(2 + i).to_numpy() for i in range(k)], axis=1).astype(np.uint8)
                data = (part.column(0).to_numpy().astype(float), part.column(1).to_numpy().astype(np.int32), bins, np.zeros((part.num_rows, windows)))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in data], names=["y", "step", "bins", "pred"])

    return run


def _unpack(batch: pa.RecordBatch, i: int, k: int, windows: int):
    y, step, bins, pred = (batch.column(j)[i].as_py() for j in range(4))
    y = np.frombuffer(y)
    return y, np.frombuffer(step, np.int32), np.frombuffer(bins, np.uint8).reshape(len(y), k), np.frombuffer(pred).reshape(len(y), windows).copy()


def _add(pred: np.ndarray, step: np.ndarray, bins: np.ndarray, trees: list, first: int, depth: int) -> None:
    """Add the trees to the predictions of the windows that train on a row."""
    for feature, cut, value in trees:
        for w in range(pred.shape[1]):
            rows = step <= w
            pred[rows, w] += value[w][leaf_of(bins[rows], feature[w], cut[w], depth) - first]


def fit(blocks: DataFrame, base: np.ndarray, k: int, s: Boosting) -> list:
    """The trees of all windows: per round (feature, cut, leaf values), each with a row per window. ``blocks`` hold rows, ``base`` the windows' first predictions."""
    windows, inner, leaves = len(base), 2**s.depth - 1, 2**s.depth
    trees: list = []
    fresh: list = []  # trees not yet in the blocks' predictions

    def updated(new: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    _, step, bins, pred = _unpack(batch, i, k, windows)
                    _add(pred, step, bins, new, inner, s.depth)
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(i, 1) for j in range(3)), pa.array([pred.tobytes()], pa.binary())], names=["y", "step", "bins", "pred"])

        return run

    def sums(new: list, feature: np.ndarray, cut: np.ndarray, level: int):
        """Histograms of the nodes of a level: gradients and counts (window, node, feature, bin)."""
        nodes = 2**level

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((windows, 2, nodes, k, s.bins))
            for batch in batches:
                for i in range(batch.num_rows):
                    y, step, bins, pred = _unpack(batch, i, k, windows)
                    _add(pred, step, bins, new, inner, s.depth)
                    for w in range(windows):
                        rows = step <= w
                        own = bins[rows]
                        g = pred[rows, w] + base[w] - y[rows]
                        node = leaf_of(own, feature[w], cut[w], level) - (nodes - 1)
                        for f in range(k):
                            cell = node * s.bins + own[:, f]
                            total[w, 0, :, f] += np.bincount(cell, g, nodes * s.bins).reshape(nodes, s.bins)
                            total[w, 1, :, f] += np.bincount(cell, minlength=nodes * s.bins).reshape(nodes, s.bins)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(windows)), pa.array([t.tobytes() for t in total], pa.binary())], names=["w", "h"])

        def add(table: pa.Table) -> pa.Table:
            h = sum(np.frombuffer(x) for x in table["h"].to_pylist())
            return pa.table({"w": table["w"].slice(0, 1), "h": pa.array([h.tobytes()], pa.binary())})

        rows = now.mapInArrow(run, "w long, h binary").groupBy("w").applyInArrow(add, "w long, h binary").collect()
        out = np.zeros((windows, 2, nodes, k, s.bins))
        for r in rows:
            out[r.w] = np.frombuffer(r.h).reshape(out.shape[1:])
        return out[:, 0], out[:, 1]

    now = blocks
    try:
        for _ in range(s.rounds):
            feature, cut = np.full((windows, inner), _NONE), np.zeros((windows, inner), dtype=np.int64)
            for level in range(s.depth):
                grad, count = sums(fresh, feature, cut, level)
                at = slice(2**level - 1, 2 ** (level + 1) - 1)
                for w in range(windows):
                    feature[w, at], cut[w, at] = best_splits(grad[w], count[w], s)
                if level == s.depth - 1:
                    value = _leaf_values(grad, count, feature, cut, s)
            trees.append((feature, cut, value.reshape(windows, leaves)))
            fresh.append(trees[-1])
            if len(fresh) == FRESH:
                # from the written blocks on, so that no plan holds the plans of earlier rounds
                before, now = now, blocks.mapInArrow(updated(list(trees)), _BLOCK).persist()
                now.count()
                if before is not blocks:
                    before.unpersist()
                fresh.clear()
    finally:
        if now is not blocks:
            now.unpersist()
    return trees


def _leaf_values(grad: np.ndarray, count: np.ndarray, feature: np.ndarray, cut: np.ndarray, s: Boosting) -> np.ndarray:
    """Leaf values from the last level's histograms: its splits say which bins go to which side."""
    windows, nodes = grad.shape[:2]
    out = np.zeros((windows, nodes, 2))
    for w in range(windows):
        for j in range(nodes):
            f, c = feature[w, nodes - 1 + j], cut[w, nodes - 1 + j]
            g, n = grad[w, j, max(f, 0)], count[w, j, max(f, 0)]
            for side, part in enumerate((slice(0, c + 1), slice(c + 1, None)) if f != _NONE else (slice(0, None), slice(0, 0))):
                out[w, j, side] = -s.rate * g[part].sum() / (n[part].sum() + s.l2)
    return out


def walk_forward_boosted(panel: DataFrame, windows: DataFrame, xs: list[str], y: str, settings: Boosting | None = None) -> DataFrame:
    """(window_id, dt, asset, pred): boosted trees fitted on each window's training rows, scored on its test rows.

    ``panel``: pos (0-based bar), dt, asset, features, label; rows without all
    features don't count, those without a label only for the tests. Bins come
    from the first window's training rows, which all windows train on, so none
    sees what comes after. Gradients are of the squared error, from the mean of
    the training labels on. Trees and histograms go through the driver: windows
    x rounds and windows x nodes x features x bins numbers.
    """
    s = settings or Boosting()
    spark = panel.sparkSession
    ends = [(r.window_id, r.train_end, r.test_lo, r.test_hi) for r in windows.select("window_id", "train_end", "test_lo", "test_hi").orderBy("train_end", "window_id").collect()]
    schema = f"window_id int, dt {panel.schema['dt'].dataType.simpleString()}, asset {panel.schema['asset'].dataType.simpleString()}, pred double"
    if not ends:
        return spark.createDataFrame([], schema)
    full = panel.dropna(subset=xs)
    train = full.filter(F.col(y).isNotNull() & (F.col("pos") < ends[-1][1]))
    share = F.lit([k / s.bins for k in range(1, s.bins)])
    found = train.filter(F.col("pos") < ends[0][1]).agg(*(F.percentile_approx(x, share, F.lit(10_000)).alias(x) for x in xs)).first()
    edges = [sorted(set(found[x] or [])) for x in xs]
    step = F.size(F.filter(F.lit([e[1] for e in ends]), lambda e: e <= F.col("pos")))
    rows = train.select(F.col(y).cast("double").alias("y"), step.alias("step"), *_bin(train, xs, edges))
    per = {r.step: r for r in rows.groupBy("step").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()}  # a row per window
    total = np.cumsum([(per[w].s, per[w].n) if w in per else (0.0, 0) for w in range(len(ends))], axis=0)
    base = total[:, 0] / np.maximum(total[:, 1], 1)
    parts = max(1, -(-int(total[-1, 1]) // BLOCK_ROWS))
    folder = fresh_folder(spark, "boosting")
    rows.repartition(parts).mapInArrow(_pack(len(xs), len(ends)), _BLOCK).write.parquet(folder)
    trees = fit(spark.read.schema(_BLOCK).parquet(folder), base, len(xs), s)
    first = 2**s.depth - 1

    @F.pandas_udf("double")
    def score(at: pd.Series, bins: pd.DataFrame) -> pd.Series:
        w, b = at.to_numpy(), bins.to_numpy()
        out = base[w].copy()
        for k in np.unique(w):
            mine = w == k
            for feature, cut, value in trees:
                out[mine] += value[k][leaf_of(b[mine], feature[k], cut[k], s.depth) - first]
        return pd.Series(out)

    tests = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(e[0]).alias("window_id"), F.lit(e[2]).alias("lo"), F.lit(e[3]).alias("hi")) for i, e in enumerate(ends)))
    test = full.withColumn("_w", F.explode(F.filter(tests, lambda t: (t["lo"] <= F.col("pos")) & (F.col("pos") < t["hi"]))))
    test = test.select(F.col("_w.window_id").cast("int").alias("window_id"), "dt", "asset", F.col("_w.at").alias("_at"), F.struct(*_bin(test, xs, edges)).alias("_bins"))
    return test.select("window_id", "dt", "asset", score("_at", "_bins").alias("pred"))
