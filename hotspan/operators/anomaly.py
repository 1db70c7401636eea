"""Outlier scores by an isolation forest: trees grown on bounded samples, scored as one pass over all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpoint
from .quantiles import exact

FEATURES = ("max_bright_ti4", "bt_diff_max", "mean_frp", "max_frp", "observation_count", "active_days", "duration_days", "detection_density", "mean_confidence", "frp_mean_to_max_ratio")
TREES, SAMPLE, SEED, SHARE = 100, 256, 42, 0.05
Tree = list[tuple[int, float, int, int, int]]


def scales(df: DataFrame, columns: Sequence[str] = FEATURES) -> dict[str, tuple[float, float]]:
    """(median, interquartile range) of each feature, exactly; an empty range counts as 1, a column without values as (0, 1)."""
    found = exact(df, columns, (0.25, 0.5, 0.75))
    return {c: (mid, (high - low) or 1.0) if mid is not None else (0.0, 1.0) for c, (low, mid, high) in found.items()}


def standardised(df: DataFrame, by: dict[str, tuple[float, float]]) -> DataFrame:
    """`df` with a column `std_<name>` for each feature in `by`: its distance from the median in interquartile ranges; missing values stay so."""
    return df.withColumns({f"std_{c}": (F.col(c).cast("double") - F.lit(m)) / F.lit(r) for c, (m, r) in by.items()})


def scaled(df: DataFrame, by: dict[str, tuple[float, float]]) -> DataFrame:
    """`df` with `x`, its features scaled; missing and infinite values stand at the median."""
    value = lambda c, m, r: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), (F.col(c).cast("double") - m) / r), F.lit(0.0))
    return df.withColumn("x", F.array(*[value(c, m, r) for c, (m, r) in by.items()]))


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> Tree:
    """Nodes (feature, cut, left, right, size); feature -1 marks a leaf."""
    nodes: Tree = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0, len(rows)))
        spread = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if len(rows) > 1 else []
        if depth < limit and len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
            left = x[rows, f] <= cut
            nodes[at] = (f, cut, add(rows[left], depth + 1), add(rows[~left], depth + 1), len(rows))
        return at

    add(np.arange(len(x)), 0)
    return nodes


def expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def forest(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> list[Tree]:
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = max(1, int(np.ceil(np.log2(max(2, size)))))
    return [grow(x[rng.choice(len(x), size, replace=False)], rng, limit) for _ in range(trees)] if len(x) else []


def outlyingness(x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 for outliers, under 0.5 for the rest."""
    total = np.zeros(len(x))
    for t in trees:
        feature, cut, left, right, size = (np.array(c) for c in zip(*t, strict=True))
        at, depth = np.zeros(len(x), int), np.zeros(len(x))
        inner = feature[at] >= 0
        while inner.any():
            go = np.flatnonzero(inner)
            f = feature[at[go]]
            at[go] = np.where(x[go, f] <= cut[at[go]], left[at[go]], right[at[go]])
            depth[go] += 1
            inner = feature[at] >= 0
        total += depth + expected(size[at])
    base = expected(np.array([trees[0][0][4]]))[0] if trees else 1.0
    return 2.0 ** (-total / max(1, len(trees)) / max(base, 1e-9))


@dataclass(frozen=True)
class Model:
    """Scales of the features, the trees, and the outlyingness that is the threshold."""

    by: dict[str, tuple[float, float]]
    trees: list[Tree]
    cut: float


def outlying(df: DataFrame, by: dict[str, tuple[float, float]], trees: list[Tree]) -> DataFrame:
    """`df` with `odd`, its rows' outlyingness."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(outlyingness(np.array(b.tolist(), float).reshape(-1, len(by)), trees))

    return scaled(df, by).withColumn("odd", score("x")).drop("x")


def fitted(df: DataFrame, share: float = SHARE, key: str = "cluster_id", most: int = 20_000) -> Model:
    """A forest of at most `most` rows, the first by hash of the key, whose threshold leaves `share` of all rows above it."""
    by = scales(df)
    rows = scaled(df, by).select(key, "x").orderBy(F.xxhash64(key), key).limit(most).toPandas()  # bounded by `most`
    trees = forest(np.array(rows.x.tolist(), float).reshape(-1, len(FEATURES)))
    cut = exact(outlying(df, by, trees), ["odd"], [1 - share])["odd"][0]
    return Model(by, trees, 0.5 if cut is None else cut)


def scored(df: DataFrame, share: float = SHARE, key: str = "cluster_id", most: int = 20_000) -> DataFrame:
    """`df` judged by the forest that is fitted to it."""
    return judged(df, fitted(df, share, key, most))


def judged(df: DataFrame, model: Model) -> DataFrame:
    """`df` with anomaly_score (higher is odder), anomaly_flag and abnormality_level.

    The score is the distance to the model's threshold. Over it a row is HIGH, less than 0.05 under it ELEVATED.
    """
    found = checkpoint(outlying(df, model.by, model.trees))
    out = found.withColumn("raw", F.col("odd") - F.lit(model.cut)).drop("odd", "anomaly_score", "anomaly_flag", "abnormality_level")
    level = F.when(F.col("raw") > 0, "HIGH").when(F.col("raw") > -0.05, "ELEVATED").otherwise("NORMAL")
    return out.withColumns({"abnormality_level": level, "anomaly_flag": (F.col("raw") > 0).cast("int"), "anomaly_score": F.rint(F.col("raw") * 1e4) / 1e4}).drop("raw")
