"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

A sequence's fate depends only on the lengths put in it, and there are at most `capacity` different lengths. So the
plan is made from the histogram of lengths (a table of at most `capacity` rows, the only thing the driver sees), with
equal open bins kept as one count, and every piece then finds its bin from its rank among the pieces of its length.
The plan is that of best-fit decreasing over all pieces at once, however many partitions hold them.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END_ID, CAPACITY = 2, 1024
#: How the byte-level tokenizer cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts as `tokenizers` gives them from the same file, as little-endian unsigned 32-bit bytes.

    The file's vocabulary is handed to tiktoken, which finds the same ids several times faster on these texts. With
    `added` the file's added tokens have their own ids where they stand in a text, as `tokenizers` has it by default;
    without, they are text like any other (its `encode_special_tokens`). A text that the fast way cannot take, such as
    one with a very long run of blanks, goes through `tokenizers` itself.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in model["added_tokens"]):
            raise ValueError("added tokens that take in or depend on their surroundings are not supported")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special if added else {})
        self.allowed, self.path, self.added, self.slow = "all" if added else set(), path, added, None

    def __call__(self, text: str) -> bytes:
        try:
            return self.coder.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
                self.slow.encode_special_tokens = not self.added
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Tightest:
    """Segment tree over remaining capacities 0..n: finds the smallest one that is at least `need` and has open bins."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [False] * (2 * self.size)

    def put(self, room: int, on: bool) -> None:
        at = room + self.size
        self.open[at] = on
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def find(self, need: int) -> int | None:
        at = need + self.size
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: rows (length, first rank, count, first sequence, offset).

    Bins opened alike and filled alike stay a run of sequence numbers with one remaining capacity; `room` lists such
    runs by what is left in them. Placing a batch of equal lengths splits a run at most once.
    """
    tree, room, rows, next_sequence = Tightest(capacity), {}, [], 0
    for length in sorted((n for n in lengths if n > 0), reverse=True):
        rank, left = 0, lengths[length]
        while left:
            free = tree.find(length)
            if free is None:
                each = capacity // length
                bins = -(-left // each)
                full, over = divmod(left, each)
                for i in range(each):
                    n = full + (i < over)
                    if n:
                        rows.append((length, rank, n, next_sequence, i * length))
                        rank += n
                if full and (rest := capacity - each * length):
                    room.setdefault(rest, []).append((next_sequence, full))
                    tree.put(rest, True)
                if over and (rest := capacity - over * length):
                    room.setdefault(rest, []).append((next_sequence + full, 1))
                    tree.put(rest, True)
                next_sequence += bins
                left = 0
                continue
            start, n = room[free].pop()
            take = min(n, left)
            rows.append((length, rank, take, start, capacity - free))
            if take < n:
                room[free].append((start + take, n - take))
            if not room[free]:
                tree.put(free, False)
            if free > length:
                room.setdefault(free - length, []).append((start, take))
                tree.put(free - length, True)
            rank, left = rank + take, left - take
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, write: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of `docs` is a document, repeated ids included; a null text is an empty one and makes one piece of the
    end id alone. Documents of more than `capacity` ids are cut into pieces of `capacity`, the first being the shorter
    one. `write` stores the pieces before they are ranked (a checkpoint by default), so that texts are encoded once.
    """
    from .common import checkpoint

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(tokenizer, added=True), end_id.to_bytes(4, "little")
        seen = [0] * (capacity + 1)
        for batch in batches:
            ids = batch.column("doc_id")
            columns: list[list] = [[] for _ in range(6)]
            for i, text in enumerate(batch.column("text").to_pylist()):
                coded = encode(text or "") + end
                n = len(coded) // 4
                cut = n % capacity or capacity
                for piece, at in enumerate([0, *range(cut, n, capacity)]):
                    part = coded[4 * at : 4 * (at + capacity if at else cut)]
                    length = len(part) // 4
                    for c, v in zip(columns, (i, piece, at, length, zlib.crc32(part), seen[length]), strict=True):
                        c.append(v)
                    seen[length] += 1
            arrays = [ids.take(pa.array(columns[0], pa.int32())), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "local"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, local long")
    made = (write or checkpoint)(made.withColumn("task", F.spark_partition_id()))
    per_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    totals = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    rows = plan({r.length: r.n for r in totals}, capacity)
    before = per_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    table: dict[int, np.ndarray] = {n: np.array([r[1:] for r in rows if r[0] == n], np.int64) for n in {r[0] for r in rows}}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.array(b.column("length")), np.array(b.column("rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine, t = length == n, table[int(n)]
                at = np.searchsorted(t[:, 0], rank[mine], "right") - 1
                sequence[mine] = t[at, 2] + rank[mine] - t[at, 0]
                offset[mine] = t[at, 3]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    ranked = made.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
