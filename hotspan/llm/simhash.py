"""Near-duplicate documents by SimHash fingerprints, found with multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components

SEED, BITS = 42, 64


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of the word shingles of a text, A-Z lower-cased; zero if there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):  # bounds the unpacked bits of a very long text
        set_bits += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """`docs` without its texts and with a column `__fp` (long), every whole text being read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t, width) for t in b.column("__text").to_pylist()]
            keep = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(np.array(got, np.uint64).view(np.int64))], names=[*keep, "__fp"])

    kept = [c for c in docs.columns if c != text]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["`__fp` long"])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def near(found: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct fingerprints in column `fp` that differ in at most `distance` bits.

    By the pigeonhole principle two such fingerprints differ in at most distance // segments bits of some segment. One
    side looks up every value in that small Hamming ball around its segments in the table of the other's exact
    segments; the whole distance is verified inside the join.
    """
    radius, size = distance // segments, BITS // segments
    bounds = [(i * size, BITS if i == segments - 1 else (i + 1) * size) for i in range(segments)]

    def key(i: int) -> Column:
        lo, hi = bounds[i]
        part = F.shiftrightunsigned("fp", lo)
        return part if hi == BITS else part.bitwiseAND(F.lit((1 << (hi - lo)) - 1))

    def ball(i: int) -> Column:
        lo, hi = bounds[i]
        masks, edge = {0}, {0}
        for _ in range(radius):
            edge = {m ^ (1 << b) for m in edge for b in range(hi - lo)}
            masks |= edge
        signed = sorted(m - (1 << 64) if m >= 1 << 63 else m for m in masks)
        return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: key(i).bitwiseXOR(m))

    each = range(segments)
    table = found.select(F.col("fp").alias("b"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), key(i).alias("k")) for i in each])).alias("s")).select("b", "s.i", "s.k")
    probes = None
    for i in each:
        rows = found.select(F.col("fp").alias("a"), F.lit(i).alias("i"), F.explode(ball(i)).alias("k"))
        probes = rows if probes is None else probes.union(rows)
    close = F.expr(f"a < b and bit_count(a ^ b) <= {distance}")
    on = (F.col("p.i") == F.col("t.i")) & (F.col("p.k") == F.col("t.k")) & close
    return probes.alias("p").join(table.alias("t"), on).select("a", "b")


def groups(docs: DataFrame, width: int, distance: int) -> DataFrame:
    """`docs` (doc_id, text and others) without its texts, with `__fp` and the component_id of its group, see below."""
    found = checkpoint(fingerprints(docs, width))
    classes = checkpoint(found.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("least")))
    linked = components(near(classes.select("fp"), distance))
    of = classes.join(linked, classes.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(least, "component").select("fp", "component", "component_id")
    return found.join(named, found["__fp"] == named.fp).drop("fp")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most `distance` bits are linked; component_id is the smallest id that
    links reach, itself included. Copies are one class, so only different fingerprints are compared. Null, empty and
    blank texts have fingerprint zero and are linked like any other. Null ids are kept and never the smallest (a
    component of null ids only has a null component_id); repeated rows give repeated rows; no rows give none.
    """
    made = groups(docs.select(F.col(doc_id).alias("doc_id"), F.col("text")), width, distance)
    return made.select("doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """The rows of `docs` that stay when of each group of near duplicates the one with the smallest id stays.

    Null ids stay only where a group has no other; of rows with the same id the first stays. `docs` must be a stored
    table, as its rows are numbered when they are read.
    """
    numbered = docs.withColumn("__rid", F.monotonically_increasing_id())
    made = groups(numbered.select("doc_id", "__rid", "text"), width, distance)
    first = made.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__rid")).alias("first"))
    return numbered.join(first.select(F.col("first.__rid").alias("__rid")), "__rid", "left_semi").drop("__rid")
