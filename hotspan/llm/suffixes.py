"""Removal of long repeated byte strings by a distributed, common-prefix-aware merge sort of sparse suffixes.

Every `length`-byte window holds an anchor: of its GRAM-byte strings the one with the least hash. Equal windows have
their anchor at the same offset, so windows need only be compared around anchors whose gram recurs. The suffixes that
begin at such anchors are sorted as in a suffix array: tasks sort runs, exchange them front-coded (only what differs
from the suffix before), and merge them with loser trees that keep for every suffix how much it shares with the last
one put out and never compare that part again. The common prefixes that the merge yields, and those of the bytes left
of the anchors, tell exactly which windows occur elsewhere.

Suffixes whose whole neighbourhood (all windows of the anchor) is the same are one variant and sorted once; copies,
however many, cost a count. An anchor with very many different neighbourhoods is not sorted in one task: stretches of
its windows are compared by digests, which spread. A stretch whose bytes are the same elsewhere recurs as a whole; one
whose windows have no common bytes elsewhere holds no window that recurs; any other is cut into FOUR, down to windows.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, stored

LENGTH, GRAM = 400, 128
#: Variants merged by one task; variants of one gram up to which they are merged; sorted run; bytes of text hashed at once.
PER_TASK, HOT, RUN_ROWS, CHUNK = 20_000, 3_000, 40_000, 1 << 19
#: Parts into which a stretch of windows is cut; neighbourhoods of hot grams in one batch.
FOUR, HOT_ROWS = 4, 2_000
M1, M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers of the rolling hashes


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            more, one = max(n, 2 * len(self.up)) - 1, np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(more, self.base)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(more, self.inverse)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


class Rolling:
    """Hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray, powers: Powers):
        up, self.down = powers.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def anchors(data: bytes, length: int, gram: int, first: Powers, second: Powers) -> tuple[np.ndarray, ...]:
    """Of every anchor: gram hash, neighbourhood hash, first and last window start, anchor position."""
    out: list[tuple[np.ndarray, ...]] = []
    width = length - gram + 1
    for base in range(0, max(0, len(data) - length + 1), CHUNK):
        part = np.frombuffer(data, np.uint8)[base : base + CHUNK + length - 1]
        n = len(part) - length + 1  # window starts in this chunk
        one = Rolling(part, first)
        grams = one.at(np.arange(len(part) - gram + 1), np.arange(gram, len(part) + 1))
        # sliding minimum of (hash, position) by block-wise prefix and suffix minima
        key = (grams & ~np.uint64(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        blocks = -(-len(key) // width)
        padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        square = padded.reshape(blocks, width)
        prefix = np.minimum.accumulate(square, axis=1).ravel()
        suffix = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n]) & np.uint64(0xFFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(begin[1:], n) - 1
        anchor = at[begin]
        whole = Rolling(part, second).at(begin, last + length)
        out.append((grams[anchor], whole, begin + base, last + base, anchor + base))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def common(x: bytes, y: bytes, start: int) -> int:
    """Length of the common prefix of x and y, known to be at least `start`."""
    lo, hi = start, min(len(x), len(y))
    if x[lo:hi] == y[lo:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def front_code(rows: list[tuple[bytes, bytes, int]]) -> bytes:
    """(key, left context, variant) in order of key, each key as what it shares with the one before and the rest."""
    out, before = [], b""
    for key, left, variant in rows:
        n = common(before, key, 0)
        out += [struct.pack("<HHHQ", n, len(key) - n, len(left), variant), key[n:], left]
        before = key
    return b"".join(out)


def decode(block: bytes) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(length shared with the key before, key, left context, variant)."""
    at, key = 0, b""
    while at < len(block):
        n, rest, left, variant = struct.unpack_from("<HHHQ", block, at)
        at += 14
        key = key[:n] + block[at : at + rest]
        at += rest
        yield n, key, block[at : at + left], variant
        at += left


def merge(runs: list[Iterator[tuple[int, bytes, bytes, int]]]) -> Iterator[tuple[int, bytes, bytes, int]]:
    """Loser tree over sorted runs: the same rows, with the length each key shares with the one put out before it.

    `shared[i]` is what run i's head shares with the last key put out. Of two heads the one that shares more is the
    smaller; only if they share the same length are bytes compared, from that length on.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows what it shares with the winner."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        n = common(x, y, shared[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    losers, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    champion = winners[1] if size > 1 else 0
    while heads[champion] is not None:
        _, key, left, variant = heads[champion]
        yield shared[champion], key, left, variant
        heads[champion] = next(runs[champion], None) if champion < len(runs) else None
        shared[champion] = heads[champion][0] if heads[champion] else 0
        node = (champion + size) // 2
        while node:
            champion, losers[node] = play(champion, losers[node])
            node //= 2


def repeated(members: list[tuple[int, bytes, bytes, int]], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(variant, ranges of offsets whose windows another member has too) for the members of one gram, in merge order.

    A window at offset o before the anchor takes o bytes on the left and length - o from the anchor on. Two members
    share it if they share so many on both sides. The keys carry 8 bytes more than the suffixes.
    """
    n = len(members)
    right = [m[0] - 8 for m in members]
    lefts = [m[2][::-1] for m in members]
    low = [length - (len(m[1]) - 8) for m in members]  # the offset of an anchor's last window
    flags: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n <= 24:
        for i in range(n):
            r = 1 << 30
            for j in range(i + 1, n):
                r = min(r, right[j])
                if r < GRAM:
                    break
                a, z = length - r, common(lefts[i], lefts[j], 0)
                if max(a, low[i], low[j]) <= z:
                    flags[i].append((max(a, low[i]), z))
                    flags[j].append((max(a, low[j]), z))
    else:
        r = np.array(right)
        order = sorted(range(n), key=lefts.__getitem__)
        near = np.array([0] + [common(lefts[a], lefts[b], 0) for a, b in zip(order, order[1:], strict=False)])
        lo, hi = np.array(low), np.array([len(x) for x in lefts])
        order = np.array(order)
        group = np.empty(n, np.int64)
        for o in range(int(lo.min()), int(hi.max()) + 1):
            group[order] = np.cumsum(near < o)
            mine = np.flatnonzero((lo <= o) & (o <= hi))
            _, back, count = np.unique(np.cumsum(r < length - o)[mine] * (n + 1) + group[mine], return_inverse=True, return_counts=True)
            for i in mine[count[back] > 1].tolist():
                if flags[i] and flags[i][-1][1] == o - 1:
                    flags[i][-1] = (flags[i][-1][0], o)
                else:
                    flags[i].append((o, o))
    for m, f in zip(members, flags, strict=True):
        if f:
            yield m[3], f


def bytes_at(o_low: Column, o_high: Column, length: int) -> Column:
    """Digest of a neighbourhood's bytes from `o_high` before its anchor to `length` - `o_low` after it."""
    return F.sha2(F.substring("block", F.col("high") - o_high + 1, o_high + F.lit(length) - o_low), 256)


def shared(nodes: DataFrame, key: str, name: str) -> DataFrame:
    """`nodes` with the column `name`: the least variant of those that have the same stretch and digest `key`, if there are several."""
    on = ["low", "until", key] if key == "whole" else ["part", key]
    several = nodes.groupBy(*on).agg(F.min("variant").alias("one"), F.max("variant").alias("other")).where("one <> other")
    return nodes.join(several.select(*on, F.col("one").alias(name)).hint("merge"), on, "left")


def hot_windows(found: DataFrame, length: int) -> DataFrame:
    """(variant, low, high): ranges of offsets whose windows another variant has too, for (variant, block, high).

    `block` has all windows of an anchor, the first one at the offset `high`. A stretch is `part`, the offsets from
    `part` * width on, of which the variant has those from `low` to `until`. Two variants share all of these windows if
    they share the bytes that these cover, and none of the part's if they differ in the bytes that all of them hold.
    """
    last, width, out = length - GRAM, 1, []
    while width * FOUR <= last + 1:
        width *= FOUR
    first = F.col("high") - (F.length("block") - length)
    nodes = found.select("variant", "block", "high", F.explode(F.sequence(F.floor(first / width), F.floor(F.col("high") / width))).alias("part"))
    while True:
        start, end = F.col("part") * width, F.least(F.col("part") * width + (width - 1), F.lit(last))
        cut = nodes.withColumn("low", F.greatest(start, first)).withColumn("until", F.least(end, F.col("high")))
        cut = checkpoint(cut.withColumn("whole", bytes_at(F.col("low"), F.col("until"), length)).withColumn("every", bytes_at(end, start, length)))
        judged = checkpoint(shared(shared(cut, "whole", "again"), "every", "maybe"))
        out.append(judged.where("again is not null").select("variant", F.col("low").cast("int").alias("low"), F.col("until").cast("int").alias("high")))
        if width == 1:
            return reduce(DataFrame.union, out)
        width //= FOUR
        left = judged.where("(again is null or again = variant) and maybe is not null")  # one of equal stretches goes on, for the others' sake
        nodes = left.select("variant", "block", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("until") / width))).alias("part"))


def deflated(docs: DataFrame) -> DataFrame:
    """`docs` with the bytes of `data` deflated, as which they are shuffled: that takes two thirds of what blocks of LZ4 take."""

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pa.array([zlib.compress(d, 1) for d in b.column(n).to_pylist()], pa.binary()) if n == "data" else b.column(n) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays(made, names=b.schema.names)

    return docs.mapInArrow(deflate, docs.schema)


def recurring(each: DataFrame) -> DataFrame:
    """The anchors `each` whose gram recurs; `alike` if all its neighbourhoods are one, so that nothing needs sorting.

    The grams are stored before they are joined: both sides of the join are then plain shuffles, of which Spark deals
    out the share of a gram that very many anchors have; it cannot where a side is aggregated in the joining task.
    """
    grams = each.groupBy("h").agg(F.count("*").alias("n"), F.min("t").alias("one"), F.max("t").alias("other")).where("n > 1")
    return each.join(stored(grams.select("h", (F.col("one") == F.col("other")).alias("alike"))).hint("merge"), "h")


def find_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, p, q): of the rows `rid`, `data` (bytes) of `docs`, the window starts from p to q that occur elsewhere too."""
    gram = GRAM
    if length <= gram:
        raise ValueError(f"length must be over {gram}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Powers(M1), Powers(M2)
        for b in batches:
            got = [anchors(d or b"", length, gram, first, second) for d in b.column("data").to_pylist()]
            arrays = [b.column("rid")]
            for i, kind in enumerate((np.int64, np.int64, np.int32, np.int32, np.int32)):
                flat = np.concatenate([g[i].view(np.int64) if i < 2 else g[i].astype(kind) for g in got]) if got else np.zeros(0, kind)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(g[0]) for g in got)]), pa.int32()), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(arrays, names=["rid", "h", "t", "p", "q", "a"])

    found = stored(docs.mapInArrow(scan, "rid long, h array<long>, t array<long>, p array<int>, q array<int>, a array<int>").where("size(h) > 0"))
    each = found.select("rid", F.explode(F.arrays_zip("h", "t", "p", "q", "a")).alias("x")).select("rid", "x.*")
    again = stored(recurring(each))
    whole = again.where("alike").select("rid", "p", "q")
    mixed_up = again.where("not alike")
    variants = mixed_up.groupBy("h", "t").agg(F.count("*").alias("n"), F.min(F.struct("rid", "p", "q", "a")).alias("at"))
    variants = stored(variants.withColumn("variant", F.monotonically_increasing_id()))
    many = variants.groupBy("h").count().where(F.col("count") > HOT).select("h", F.lit(True).alias("hot"))
    sizes = variants.count()
    tasks = max(1, -(-sizes // PER_TASK))
    wanted = variants.join(many, "h", "left").groupBy(F.col("at.rid").alias("rid")).agg(F.collect_list(F.struct("h", "variant", F.coalesce("hot", F.lit(False)).alias("hot"), "at.p", "at.q", "at.a")).alias("wanted"))
    texts = deflated(docs).join(wanted, "rid").select("data", "wanted")

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted, front-coded runs cut by the task that merges them; of hot grams the neighbourhoods, with the anchor's place."""
        rows: list[tuple[bytes, bytes, int]] = []
        apart: list[tuple[bytes, int, int]] = []

        def whole() -> pa.RecordBatch:
            block, variant, o = zip(*apart, strict=True)
            return pa.RecordBatch.from_arrays([pa.nulls(len(apart), pa.int32()), pa.array(block, pa.binary()), pa.array(variant, pa.int64()), pa.array(o, pa.int32())], names=["task", "block", "variant", "o"])

        def flush() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[0])
            owner = [int.from_bytes(r[0][:8], "big") * tasks >> 64 for r in rows]
            cuts = [(t, bisect_left(owner, t), bisect_left(owner, t + 1)) for t in sorted(set(owner))]
            blocks = [front_code(rows[a:b]) for _, a, b in cuts]
            return pa.RecordBatch.from_arrays([pa.array([t for t, *_ in cuts], pa.int32()), pa.array(blocks, pa.binary())] + [pa.nulls(len(cuts), pa.int64())] + [pa.nulls(len(cuts), pa.int32())], names=["task", "block", "variant", "o"])

        for b in batches:
            for data, some in zip(b.column("data").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                data = zlib.decompress(data)
                for w in some:
                    p, q, a = w["p"], w["q"], w["a"]
                    if w["hot"]:
                        apart.append((data[p : q + length], w["variant"], a - p))
                        if len(apart) >= HOT_ROWS:
                            yield whole()
                            apart.clear()
                    else:
                        # an anchor's hash is the least of many: an odd factor spreads it, so that tasks get equal shares
                        rows.append(((w["h"] * M1 & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big") + data[a : q + length], data[p:a], w["variant"]))
                        if len(rows) >= RUN_ROWS:
                            yield flush()
                            rows.clear()
        if rows:
            yield flush()
        if apart:
            yield whole()

    runs = stored(texts.mapInArrow(sort_runs, "task int, block binary, variant long, o int"))

    def merge_runs(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []

        def close(members: list) -> None:
            for variant, ranges in repeated(members, length) if len(members) > 1 else ():
                out.extend((variant, a, z) for a, z in ranges)

        members: list[tuple[int, bytes, bytes, int]] = []
        for row in merge([decode(b) for b in table.column("block").to_pylist()]):
            if row[0] < 8 + gram and members:
                close(members)
                members = []
            members.append(row)
        close(members)
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["variant", "low", "high"])

    sorted_out = runs.where("task is not null").groupBy("task").applyInArrow(merge_runs, "variant long, low int, high int")
    hot = runs.where("task is null").select("variant", "block", F.col("o").alias("high"))
    every = sorted_out if hot.isEmpty() else sorted_out.union(hot_windows(hot, length))
    ranges = every.groupBy("variant").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    verdict = variants.join(ranges, "variant", "left").where("n > 1 or ranges is not null").select("h", "t", F.col("n").alias("copies"), "ranges")
    judged = mixed_up.join(verdict, ["h", "t"])
    full = judged.where("copies > 1").select("rid", "p", "q")
    part = judged.where("copies = 1").select("rid", "a", F.explode("ranges").alias("r")).select("rid", (F.col("a") - F.col("r.high")).alias("p"), (F.col("a") - F.col("r.low")).alias("q"))
    return whole.union(full).union(part)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans and the bytes `kept`.

    Texts count as UTF-8 bytes, null as empty. Every byte goes that a `length`-byte string covers which starts anywhere
    else too, in the same or another row, as the input stands; so of copies none stays. Rows are numbered as they are
    read, so `docs` must be a stored table; repeated rows are copies of each other; no rows give none.
    """
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    starts = find_repeats(numbered.select("rid", "data"), length).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("p", "q"))).alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[list] = [[], [], [], []]
            for data, some in zip(b.column("data").to_pylist(), b.column("starts").to_pylist(), strict=True):
                data = zlib.decompress(data)
                kept, at, gone, spans = [], 0, 0, 0
                for s in some or ():
                    end = s["q"] + length
                    if s["p"] > at or not spans:  # touching stretches are one
                        kept.append(data[at : s["p"]])
                        spans += 1
                        at = s["p"]
                    gone += max(0, end - at)
                    at = max(at, end)
                kept.append(data[at:])
                for c, v in zip(made, (len(data), gone, spans, b"".join(kept)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, pa.int64()) for c in made[:3]] + [pa.array(made[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return deflated(numbered).join(starts, "rid", "left").select("doc_id", "data", "starts").mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
