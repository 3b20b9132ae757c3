"""Isolation forest: trees are grown in groups of Spark, one task a tree, and rows are scored in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _mean_path(n):
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(df: DataFrame, features: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(tree, node, feature, cut, left, right, size): leaves have feature -1.

    Each tree takes about ``sample`` rows by hash, so a tree's group is bounded whatever the table holds; rows with missing features
    aren't learned from.
    """
    clean = df.select("id", *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    total = max(1, clean.count())
    share = min(1.0, sample / total)
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col("tree"), F.col("id")), F.lit(1 << 40)) / float(1 << 40)
    drawn = clean.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(hashed < share)

    def build(g: pd.DataFrame) -> pd.DataFrame:
        tree = int(g["tree"].iloc[0])
        rng = np.random.default_rng(seed * 1_000_003 + tree)
        x = g.sort_values("id")[features].to_numpy()
        depth = int(np.ceil(np.log2(max(2, len(x)))))
        nodes: list[list] = []

        def split(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            nodes.append([tree, me, -1, 0.0, -1, -1, len(rows)])
            lo, hi = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(len(features)),) * 2
            open_ = np.flatnonzero(hi > lo)
            if level < depth and len(rows) > 1 and len(open_):
                f = int(rng.choice(open_))
                cut = float(rng.uniform(lo[f], hi[f]))
                below = x[rows, f] < cut
                nodes[me][2:4] = [f, cut]
                nodes[me][4] = split(rows[below], level + 1)
                nodes[me][5] = split(rows[~below], level + 1)
            return me

        split(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "size"])

    return drawn.groupBy("tree").applyInPandas(build, "tree int, node int, feature int, cut double, left int, right int, size long")


def score(df: DataFrame, features: list[str], forest: DataFrame, sample: int = 256) -> DataFrame:
    """(id, anomaly): 2 to the power of minus the mean depth over the expected one; null where a feature is missing.

    The forest is at most trees * 2 * sample rows, whatever was learned from, and goes to all executors.
    """
    f = forest.orderBy("tree", "node").toPandas()
    trees = [g[["feature", "cut", "left", "right", "size"]].to_numpy() for _, g in f.groupby("tree")]
    sent = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))])
            depth = np.zeros(len(x))
            for t in sent.value:
                at, level, live = np.zeros(len(x), int), np.zeros(len(x)), np.ones(len(x), bool)
                while live.any():
                    k = t[at]
                    inner = live & (k[:, 0] >= 0)
                    below = x[np.arange(len(x)), k[:, 0].astype(int)] < k[:, 1]
                    at = np.where(inner, np.where(below, k[:, 2], k[:, 3]).astype(int), at)
                    level += inner
                    live = inner
                depth += level + _mean_path(t[at, 4])
            size = min(sample, max((t[0, 4] for t in sent.value), default=1))
            out = np.power(2.0, -(depth / max(1, len(sent.value))) / max(float(_mean_path(size)), 1e-9))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(np.isnan(x).any(1), np.nan, out), from_pandas=True)], ["id", "anomaly"])

    return df.select(F.col("id").cast("string").alias("id"), *[F.col(c).cast("double").alias(c) for c in features]).mapInArrow(run, "id string, anomaly double")
