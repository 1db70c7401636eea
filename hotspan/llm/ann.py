"""Approximate nearest neighbours: inverted lists scanned with an adaptive number of dimensions.

Vectors are scaled to length one and rotated by one random orthogonal matrix, so that every prefix of their dimensions
is a random projection. Within a probed list the squared distance grows over column blocks; after each block a
hypothesis test abandons the candidates whose whole distance would hardly come under the query's current k-th best.

How many lists a query probes is measured on the sample the lists are fit on: the fewest that hold the share TARGET of
its rows' true neighbours. Clustered vectors need few; vectors without clusters need most lists, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Rows that the lists are fit on; rows of a list, and queries of a list, that one task holds.
SAMPLE, BLOCK_ROWS, BLOCK_QUERIES = 20_000, 8_192, 8_192
#: Lists there are at least, and sample rows a list; rows of the sample that measure the probes; their recall; pairs
#: of query and candidate whose distances are held at once.
LISTS, PER_LIST, MEASURED, TARGET, PAIRS = 64, 40, 400, 0.97, 1 << 20
PLACED = "id long, v array<double>, r array<float>, cell int"


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(unit: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means over the sample."""
    rng = np.random.default_rng(seed)
    c = unit[rng.choice(len(unit), lists, replace=False)]
    for _ in range(rounds):
        near = (unit @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    return np.array(column.to_pylist() if isinstance(column, pa.Array) else list(column), dtype=np.float64).reshape(-1, dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two at their largest component: no square over- or underflows, and no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def probes_for(unit: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET) -> int:
    """The fewest lists, taken by the nearness of their centres, that hold the share `target` of k nearest in the sample."""
    some = unit[:MEASURED]
    near = some @ unit.T
    near[np.arange(len(some)), np.arange(len(some))] = -np.inf
    k = min(k, len(unit) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(some @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(place, (unit @ centres.T).argmax(1)[best], axis=1)
    return int(np.quantile(ranks, target, method="higher")) + 1


def adaptive_scan(q: np.ndarray, x: np.ndarray, k: int, columns: int = 16, doubt: float = 2.1) -> list[np.ndarray]:
    """For each query the positions in x that may be among its k nearest.

    The first candidates are measured whole and set the threshold. The partial squared distance over d of D rotated
    dimensions, times D/d, estimates the whole one; a candidate is abandoned once that exceeds the threshold by the
    factor (1 + doubt/sqrt(d))**2, the test's critical value. The first columns are taken for all pairs at once, the
    others only for the pairs still alive.
    """
    dim, found = x.shape[1], []

    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)

    step = max(1, PAIRS // len(x))
    for at in range(0, len(q), step):
        some, first = q[at : at + step], x[: 64 * k]
        kth = min(k, len(first)) - 1
        best = np.partition(between(some, first), kth, axis=1)[:, kth]
        i = j = part = None
        for low in range(0, dim, columns):
            end = min(low + columns, dim)
            limit = best + 1e-6 if end == dim else best * end / dim * (1 + doubt / np.sqrt(end)) ** 2 + 1e-6
            if part is None:
                all_pairs = between(some[:, :end], x[:, :end])
                i, j = np.nonzero(all_pairs <= limit[:, None])
                part = all_pairs[i, j]
                continue
            block = x[j, low:end] - some[i, low:end]
            part = part + np.einsum("ij,ij->i", block, block)
            keep = part <= limit[i]
            i, j, part = i[keep], j[keep], part[keep]
        found += np.split(j, np.searchsorted(i, np.arange(1, len(some))))
    return found


def search(vectors: DataFrame, every: int = 50, k: int = 5, lists: int | None = None, probes: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by cosine for each row whose id is divisible by `every`.

    Rows whose id or vector is null or empty, whose vector is zero, holds null or non-finite components or has not the
    commonest dimension take no part. Candidates are all rows but those with the query's own id; a repeated id counts
    once, with its first vector in value order. Ties go to the smaller id, so that of ids with one and the same vector
    only the k + 1 smallest can ever be found; the others are queries, but not held as candidates. A query whose nearest
    `probes` lists hold too few rows probes more until they hold 4k, so it gets k results wherever there are k
    candidates. Lists are fit on at most SAMPLE rows chosen by hash; every row is indexed. There are `lists` lists: by
    default a quarter of the square root of the rows, LISTS at least and one for PER_LIST rows of the sample at most.
    `probes` of them are searched, by default as many as probes_for() measures. Large lists are dealt out in blocks by a
    second hash.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    v = v.where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    made = "query_id long, rank int, vec_id long, score double"
    dim = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dim:
        return spark.createDataFrame([], made)
    dim, rows = dim[0]
    v = stored(v.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")))
    sample = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()  # bounded by SAMPLE
    unit = scaled(matrix(sample.v, dim))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turn = rotation(dim)
    lists = max(1, min(lists or max(LISTS, math.isqrt(rows) // 4), len(unit) // PER_LIST))
    unit = unit @ turn
    centres = centroids(unit, lists)
    probes = probes or probes_for(unit, centres, k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = scaled(matrix(b.column("v"), dim))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            turned = x @ turn
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(list(turned.astype(np.float32))), pa.array((turned @ centres.T).argmax(1).astype(np.int32))], names=["id", "v", "r", "cell"])

    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    copies = v.withColumn("nth", first).where(F.col("nth") <= k + 1).select("v", "id")
    held = stored(copies.mapInArrow(place, PLACED))
    sizes = np.zeros(lists, dtype=np.int64)
    for cell, n in held.groupBy("cell").count().collect():  # one row for each list
        sizes[cell] = n
    blocks = np.maximum(1, -(-sizes // BLOCK_ROWS))
    queries = v.where(F.pmod("id", F.lit(every)) == 0).mapInArrow(place, PLACED)
    query_blocks = max(1, -(-int(rows) // every * probes // lists // BLOCK_QUERIES))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(-(matrix(b.column("r"), dim) @ centres.T), axis=1, kind="stable")
            enough = np.cumsum(sizes[order], axis=1) >= 4 * k
            need = np.where(enough.any(1), enough.argmax(1) + 1, lists)
            at, cell, block = [], [], []
            for i, n in enumerate(np.maximum(need, min(probes, lists))):
                for c in order[i, :n]:
                    at += [i] * blocks[c]
                    cell += [c] * blocks[c]
                    block += range(blocks[c])
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(n).take(at) for n in ("id", "v", "r")] + [pa.array(cell, pa.int32()), pa.array(block, pa.int32())], names=["id", "v", "r", "cell", "block"])

    probing = queries.mapInArrow(probe, "id long, v array<double>, r array<float>, cell int, block int").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
    split = F.element_at(F.array(*[F.lit(int(n)) for n in blocks]), F.col("cell") + 1)
    held = held.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), split).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, x = np.array(right.column("id")), scaled(matrix(right.column("v").combine_chunks(), dim))
            norms = np.linalg.norm(x, axis=1)
            qid, q = np.array(left.column("id")), scaled(matrix(left.column("v").combine_chunks(), dim))
            alive = adaptive_scan(matrix(left.column("r").combine_chunks(), dim), matrix(right.column("r").combine_chunks(), dim), k + 1)
            for i, some in enumerate(alive):
                some = some[ids[some] != qid[i]]
                score = (x[some] @ q[i]) / (norms[some] * np.linalg.norm(q[i]))
                for j in np.lexsort((ids[some], -score))[:k]:
                    out.append((qid[i], ids[some[j]], score[j]))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    keys = ["cell", "block", "part"]
    found = probing.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
