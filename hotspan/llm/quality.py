"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A Gaussian kernel over standardised statistics is approximated by cosines of random projections. The normal equations
of ridge regression are sums over documents, so every partition adds up its own and only the sums travel. Scores are
calibrated with isotonic regression on labelled documents that the ridge fit has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit uses at most (the first by hash of the id): the documented bound on training work.
TRAIN_ROWS, TRAIN_TASKS = 40_000, 24
FEATURES, RIDGE, SEED = 384, 3.0, 11
MARKS = re.compile(rb"[^\w\s]", re.ASCII)


def statistics(text: str | None) -> list[float]:
    """Numbers about a whole text; all zero for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    w = raw.split()
    k = max(1, len(w))
    different = set(w)
    pairs = set(zip(w, w[1:], strict=False))
    lines = raw.split(b"\n")
    full = [x for x in lines if x]
    stops = counts[46] + counts[33] + counts[63]
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    plain = counts[44] + counts[46]
    return [
        np.log1p(n), np.log1p(len(w)), n / k, len(different) / k, len(pairs) / k,
        sum(a == b for a, b in zip(w, w[1:], strict=False)) / k,
        (marks - plain) / k, plain / k, counts[124] / k, (counts[35] + counts[36] + counts[37] + counts[38] + counts[42]) / k,
        counts[48:58].sum() / n, counts[65:91].sum() / n, counts[128:].sum() / n, counts[32] / n, stops / k,
        np.log1p(len(full)), n / max(1, len(full)) / 100.0 if n < 100 * max(1, len(full)) * 20 else 20.0, len(set(full)) / max(1, len(full)),
        counts[58] / k, counts[60] / k, counts[123] / k, counts[64] / k, counts[47] / k,
        len(w) / max(1, int(stops)) / 100.0 if len(w) < 2000 * max(1, int(stops)) else 20.0,
    ]


N_STATISTICS = 24


def compressed(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.log1p(np.abs(x) * 10.0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (compressed(x) - self.mean) / self.scale
        cosines = np.sqrt(2.0 / len(self.phases)) * np.cos(np.clip(z, -6, 6) @ self.directions + self.phases)
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit by pooling adjacent violators: (knots, levels) for linear interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, smallest x, largest x
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([b, c, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v = pools.pop()
            u = pools[-1]
            total = u[1] + v[1]
            pools[-1] = [(u[0] * u[1] + v[0] * v[1]) / total, total, u[2], v[3]]
    knots = [k for p in pools for k in ((p[2], p[3]) if p[3] > p[2] else (p[2],))]
    levels = [p[0] for p in pools for _ in range(2 if p[3] > p[2] else 1)]
    return np.array(knots), np.array(levels)


def vectors(docs: DataFrame) -> DataFrame:
    """(`x` array of statistics) beside the columns of `docs`, whose `text` goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([[float(v) for v in statistics(t)] for t in b.column("__text").to_pylist()], pa.list_(pa.float64()))
            keep = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [x], names=[*keep, "__x"])

    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["`__x` array<double>"])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Model from (key, text, label 0/1); rows with a null label are left out.

    Three of four rows, by hash of `key`, enter the normal equations, the fourth calibrates. With no labels, or one
    class only, the model scores every text with the classes' share (0.5 without labels).
    """
    from .common import checkpoint

    rows = labelled.where("label is not null").select("key", "text", F.col("label").cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("key"), "key").limit(TRAIN_ROWS).repartition(TRAIN_TASKS, "key")
    data = checkpoint(vectors(rows).withColumn("calibrates", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(4)) == 0))
    rng = np.random.default_rng(seed)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(N_STATISTICS), np.zeros(N_STATISTICS)
        for b in batches:
            x = compressed(np.array(b.column("__x").to_pylist(), float).reshape(-1, N_STATISTICS))
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()]), pa.array([q.tolist()])], names=["n", "s", "q"])

    parts = data.select("__x").mapInArrow(moments, "n long, s array<double>, q array<double>").collect()  # TRAIN_TASKS rows
    n = sum(p.n for p in parts)
    mean = sum((np.array(p.s) for p in parts), np.zeros(N_STATISTICS)) / max(1, n)
    scale = np.sqrt(np.maximum(sum((np.array(p.q) for p in parts), np.zeros(N_STATISTICS)) / max(1, n) - mean**2, 0))
    # a median distance between standardised points of about sqrt(2 * N) sets the kernel's width
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.standard_normal((N_STATISTICS, features)) / np.sqrt(N_STATISTICS), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for b in batches:
            z = model.features(np.array(b.column("__x").to_pylist(), float).reshape(-1, N_STATISTICS))
            left += z.T @ z
            right += z.T @ np.array(b.column("y"))
        yield pa.RecordBatch.from_arrays([pa.array(range(features + 1), pa.int32()), pa.array(np.column_stack([left, right]).tolist())], names=["i", "row"])

    sums = data.where("not calibrates").select("__x", "y").mapInArrow(equations, "i int, row array<double>")
    total = np.zeros((features + 1, features + 2))
    for r in sums.groupBy("i").agg(F.array(*[F.sum(F.element_at("row", j + 1)) for j in range(features + 2)]).alias("row")).collect() if n else []:
        total[r.i] = r.row
    penalty = np.diag([ridge] * features + [1e-6])
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    def outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = model.raw(np.array(b.column("__x").to_pylist(), float).reshape(-1, N_STATISTICS))
            yield pa.RecordBatch.from_arrays([pa.array(raw), b.column("y")], names=["raw", "y"])

    held = data.where("calibrates").select("__x", "y").mapInArrow(outcome, "raw double, y double").toPandas()  # under TRAIN_ROWS pairs
    if len(held):
        model.knots, model.levels = isotonic(held.raw.to_numpy(), held.y.to_numpy(), np.ones(len(held)))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """`docs` without `text` and with score and predicted (1 if score >= threshold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.array([statistics(t) for t in b.column("__text").to_pylist()], float).reshape(-1, N_STATISTICS))
            keep = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    kept = [c for c in docs.columns if c.lower() not in ("text", "score", "predicted")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["score double", "predicted int"])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(key, text, label) of the labelled documents that are not held out, one row per id.

    A repeated id in `labels` counts once, with its largest label; a repeated document counts once, with its first text
    in value order. Null ids have no label.
    """
    from .common import held_out

    one = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(label).alias("label"))
    one = one.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    return docs.select("doc_id", "text").join(one, "doc_id").groupBy(F.col("doc_id").alias("key")).agg(F.min("text").alias("text"), F.max("label").alias("label"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document doc_id, held_out, score, predicted, learnt from labels.quality of documents that are not held out.

    Null and empty texts have statistics of zero and are scored like any other; repeated rows give repeated rows.
    """
    from .common import held_out

    model = fit(training_rows(docs, labels, "quality"))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model, threshold).select("doc_id", "held_out", "score", "predicted")
