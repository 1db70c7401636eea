"""Periodic runs of words within texts: a harmonic grid of positions, extended by common extensions from suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that divide words; `bytes.split()` divides at just these.
SPACES = "[\\x20\\x09-\\x0D]+"
LEAST, TIMES = 6, 4
RUNS = "array<struct<start: long, length: long, period: long>>"
#: Words of several texts whose suffixes are sorted together; a longer text is taken alone, whole.
TOGETHER = 1 << 19
#: Places of the grid that are extended at a time; bounds what is held besides the text.
PLACES = 1 << 20


def suffix_ranks(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of `w` and the rank of each suffix, by doubling; only suffixes that are not yet told apart are sorted again."""
    n = len(w)
    order = np.argsort(w, kind="stable")
    head = np.r_[True, w[order][1:] != w[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    width = 1
    while not head.all():
        tied = np.flatnonzero(~(head & np.r_[head[1:], True]))
        at = order[tied]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)], -1)
        by = np.lexsort((after, rank[at]))
        order[tied], group, after = at[by], rank[at[by]], after[by]
        head[tied] = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        rank[order[tied]] = np.maximum.accumulate(np.where(head, np.arange(n), 0))[tied]
        width *= 2
    return order, rank


def common_with_next(w: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each suffix in order, how many words it shares with the next one (the last: none).

    Along the text the shared length falls by one word at most, so that each word is compared a bounded number of times.
    """
    n = len(w)
    words, places, ranks, out = w.tolist(), order.tolist(), rank.tolist(), [0] * n
    h = 0
    for i in range(n):
        r = ranks[i]
        if r + 1 == n:
            h = 0
            continue
        j = places[r + 1]
        while i + h < n and j + h < n and words[i + h] == words[j + h]:
            h += 1
        out[r] = h
        h = max(h - 1, 0)
    return np.array(out, np.int64)


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi] for each pair lo < hi; one level of the table of powers of two is held at a time."""
    out = np.empty(len(lo), np.int64)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    table, size = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[lo[mine]], table[hi[mine] - size])
        table, size = np.minimum(table[:-size], table[size:]), size * 2
    return out


class Extensions:
    """Common extensions of the suffixes of `w`: its suffix array, and the words that neighbours in it share."""

    def __init__(self, w: np.ndarray):
        order, self.rank = suffix_ranks(w)
        self.shared = common_with_next(w, order, self.rank)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many words the suffixes at `left` and at `right` (different places) have in common."""
        a, b = self.rank[left], self.rank[right]
        return least_between(self.shared, np.minimum(a, b), np.maximum(a, b))


def grid(w: np.ndarray, ends: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods p of the grid i = jp whose next two places hold the same words, i + 3p in the same text.

    A run of four periods covers four places of its period's grid at least, so that none is missed. Where the words
    differ, the common extension is known to be none and is not asked for. Periods rise; some PLACES come at a time.
    `ends` has the end of each word's text.
    """
    at, periods, held = [], [], 0
    for p in range(1, longest // TIMES + 1):
        own = w[::p]
        same = own[1:] == own[:-1]
        i = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p if len(same) > 2 else np.zeros(0, np.int64)
        i = i[i + 3 * p < ends[i]]
        if len(i):
            at.append(i)
            periods.append(np.full(len(i), p))
            held += len(i)
        if held > PLACES:
            yield np.concatenate(at), np.concatenate(periods)
            at, periods, held = [], [], 0
    if at:
        yield np.concatenate(at), np.concatenate(periods)


def runs_of(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), in order, of the runs of texts of so many words laid one after the other; no word is in two texts."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    n, found, forward, backward = len(w), np.zeros((0, 3), np.int64), None, None
    for i, period in grid(w, ends, int(sizes.max(initial=0))):
        if forward is None or backward is None:
            forward, backward = Extensions(w), Extensions(w[::-1])
        after, before, inner = forward.of(i, i + period), np.zeros(len(i), np.int64), np.flatnonzero(i > 0)
        # In reverse, the words before a place are those after its mirror image.
        before[inner] = backward.of(n - i[inner], n - i[inner] - period[inner])
        start, end = i - before, i + period + after
        long = end - start >= np.maximum(LEAST, TIMES * period)
        found = np.concatenate([found, np.c_[start, end - start, period][long]])
        # A stretch with several periods is a run of the smallest, which comes first: the others are its multiples.
        found = found[np.unique(found[:, 0] * (n + 1) + found[:, 1], return_index=True)[1]]
    return found


def worth(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the texts have any place of the grid: the others have no run."""
    ends = np.cumsum(sizes)
    out = np.zeros(len(sizes), bool)
    for i, _ in grid(w, np.repeat(ends, sizes), int(sizes.max(initial=0))):
        out[np.searchsorted(ends, i, side="right")] = True
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run contains after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words).decode("utf-8", "surrogatepass")
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(edge[:-1]) == 0
    return b" ".join([words[k] for k in np.flatnonzero(stay).tolist()]).decode("utf-8", "surrogatepass")


def several(texts: list[str | None]) -> list[tuple[np.ndarray, str]]:
    """Runs and collapsed text of each text; sorted together up to TOGETHER words."""
    out: list[tuple[np.ndarray, str]] = []
    held: list[list[bytes]] = []

    def close() -> None:
        flat: list[int] = []
        for words in held:
            ids: dict[bytes, int] = {}
            base = len(flat)
            flat += [base + ids.setdefault(x, len(ids)) for x in words]
        w = np.array(flat, np.int64)
        sizes = np.array([len(words) for words in held], np.int64)
        # Only texts that have a place of the grid are sorted.
        told = worth(w, sizes)
        runs = runs_of(w[np.repeat(told, sizes)], sizes[told])
        starts = np.cumsum(sizes[told]) - sizes[told]
        cuts = iter(np.split(runs, np.searchsorted(runs[:, 0], starts[1:]))) if told.any() else iter(())
        lows = iter(starts.tolist())
        for words, some in zip(held, told.tolist(), strict=True):
            mine = next(cuts) - np.array([next(lows), 0, 0]) if some else np.zeros((0, 3), np.int64)
            out.append((mine, collapsed(words, mine)))
        held.clear()

    room = 0
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").split()
        if held and room + len(words) > TOGETHER:
            close()
            room = 0
        held.append(words)
        room += len(words)
    if held:
        close()
    return out


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `text` replaced by `runs` (array of start, length, period in words, by start and period) and `collapsed`.

    Words are stretches without ASCII white space. A run is a stretch whose smallest period is `period`, as long as
    max(6, 4 * period) at least, that no neighbouring word carries on. `collapsed` has the words outside the runs and
    each run's first period. Null, empty and blank texts have no run and an empty `collapsed`; repeated rows are told
    each; no rows give none; columns called `runs` or `collapsed` are replaced.

    A text is told whole within one task, which holds some numbers per word of it; texts need no shuffle.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = several(b.column("__text").to_pylist())
            keep = [n for n in b.schema.names if n != "__text"]
            flat = np.concatenate([r for r, _ in made]) if made else np.zeros((0, 3), np.int64)
            cuts = np.cumsum([0] + [len(r) for r, _ in made]).astype(np.int32)
            one = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(cuts), one)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [runs, pa.array([c for _, c in made], pa.string())], names=[*keep, "runs", "collapsed"])

    kept = [c for c in docs.columns if c != text and c.lower() not in ("runs", "collapsed")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"runs {RUNS}, collapsed string"])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(tell, schema)


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text of `docs`, a tenth of them changed to repeat a stretch of words to their end, as the query's contract says (a null id: unchanged)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    found = F.filter(F.split(F.col("text"), SPACES), lambda x: x != "")

    def periodic(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = whole(1) + F.floor((n - a) / (g % 8 + 3)).cast("long")
        tail = F.transform(F.sequence(whole(0), n - a - 1), lambda i: F.get(words, (a + i % p).cast("int")))
        return F.when(n == 0, "").otherwise(F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " "))

    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), F.element_at(F.transform(F.array(found), periodic), 1)).otherwise(F.col("text")).alias("text"))


def whole(n: int) -> Column:
    return F.lit(n).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, its longest run (start, length, period, exponent_milli; nulls without one) and two digests."""
    made = find_runs(repeating(docs))
    # The longest run, of several the first, of these the one with the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    told = made.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "").alias("list"), "collapsed")
    return told.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"), F.sha2("list", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
