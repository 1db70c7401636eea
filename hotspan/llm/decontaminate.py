"""Benchmark decontamination with a positional inverted index that is distributed by documents.

The index is a table of segments. A segment holds the postings (word positions) of some thousand whole documents, so
lists of different words can be intersected where they lie. Test phrases are looked up from their rarest words: the
shortest list gives the places where a phrase could start, each further list, shifted by its word's offset, thins them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

WINDOW, SEGMENT_WORDS = 10, 1_000_000
#: Words of test items that are looked up at once; more items are taken in several blocks.
BLOCK_WORDS = 400_000
#: Up to so many different test words the index leaves other words out; beyond, it holds all.
VOCABULARY = 2_000_000
#: Fixed: the bytes that words consist of, A-Z lower-cased; any other byte ends a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEGMENT = "doc_ids array<{}>, n_words array<long>, terms array<string>, counts array<int>, postings binary"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None) -> DataFrame:
    """Segments of the positional index over all whole texts; words outside `vocabulary`, if given, are only counted.

    Positions run through a segment with one place left free between documents, so that no phrase crosses them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = None if vocabulary is None else {w: i for i, w in enumerate(sorted(vocabulary))}
        ids: dict[bytes, int] = fixed or {}
        doc_ids, lengths, parts, total = [], [], [], 0

        def segment() -> pa.RecordBatch:
            names = list(ids)
            code = np.concatenate([np.append(p, -1) for p in parts])
            order = np.argsort(code, kind="stable")
            code = code[order]
            order = order[np.searchsorted(code, 0) :].astype("<u4")
            counts = np.bincount(code[code >= 0], minlength=len(names)).astype(np.int32)
            used = np.flatnonzero(counts)
            terms = pa.array([names[i].decode("utf-8", "replace") for i in used], pa.string())
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            arrays = [one(pa.array(doc_ids, kind)), one(pa.array(lengths, pa.int64())), one(terms), one(pa.array(counts[used])), pa.array([order.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_ids", "n_words", "terms", "counts", "postings"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words(text)
                if fixed is None:
                    for x in w:
                        ids.setdefault(x, len(ids))
                parts.append(np.fromiter(map(ids.get, w, repeat(-1)), np.int32, len(w)))
                doc_ids.append(doc)
                lengths.append(len(w))
                total += len(w) + 1
                if total >= SEGMENT_WORDS:
                    yield segment()
                    doc_ids, lengths, parts, total = [], [], [], 0
                    ids = fixed or {}
        if doc_ids:
            yield segment()

    made = SEGMENT.format(docs.schema["doc_id"].dataType.simpleString())
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, made)


def term_counts(index: DataFrame) -> DataFrame:
    """How often each indexed word occurs in all documents."""
    return index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))


class Segment:
    """One segment's lists: `keys` are word number times 2**32 plus position, sorted."""

    def __init__(self, row: dict):
        self.doc_ids, self.lengths = row["doc_ids"], np.array(row["n_words"], np.int64)
        self.at = {t: i for i, t in enumerate(row["terms"])}
        counts = np.array(row["counts"], np.int64)
        self.ends = np.cumsum(counts)
        self.positions = np.frombuffer(row["postings"], "<u4").astype(np.int64)
        self.keys = np.repeat(np.arange(len(counts), dtype=np.int64) << 32, counts) + self.positions
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term - 1] if term else 0 : self.ends[term]]

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        wanted = (terms << 32) + positions
        at = np.searchsorted(self.keys, wanted)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)

    def doc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def phrases(self, windows: list[tuple[str, ...]], rare: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(window number, position) of every occurrence of every window."""
        which, start = [], []
        known = [i for i, w in enumerate(windows) if all(t in self.at for t in w)]
        longest = max((len(windows[i]) for i in known), default=0)
        term = np.full((len(windows), longest), -1, np.int64)
        offset = np.zeros((len(windows), longest), np.int64)
        for i in known:
            w = windows[i]
            for j, o in enumerate(sorted(range(len(w)), key=lambda o: (rare.get(w[o], 0), o))):
                term[i, j], offset[i, j] = self.at[w[o]], o
            p = self.list_of(term[i, 0]) - offset[i, 0]
            which.append(np.full(len(p), i, np.int64))
            start.append(p)
        if not known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which, start = np.concatenate(which), np.concatenate(start)
        for j in range(1, longest):
            t = term[which, j]
            keep = (t < 0) | ((start >= 0) & self.has(np.maximum(t, 0), start + offset[which, j]))
            which, start = which[keep], start[keep]
        return which, start


def item_windows(text: str | None, width: int = WINDOW) -> list[tuple[str, ...]]:
    w = [x.decode("utf-8", "replace") for x in words(text)]
    return [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def blocks(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """(item id, text) in lists of about BLOCK_WORDS words; a null id is called 'null'."""
    some, n = [], 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("string").alias("t"))
    for r in rows.where("t is not null").toLocalIterator():
        some.append((r.i, r.t))
        n += len(r.t) // 5
        if n >= BLOCK_WORDS:
            yield some
            some, n = [], 0
    if some:
        yield some


def index_for(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The stored index over `docs` with the words of `items`, or with all words where those are too many."""
    folded = F.regexp_replace(F.col("text").cast("string"), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " ")
    lower = F.translate(folded, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.explode(F.split(lower, " ")).alias("w")).where("w <> ''").distinct().limit(VOCABULARY + 1).collect()
    return checkpoint(build_index(docs, None if len(terms) > VOCABULARY else {r.w.encode() for r in terms}))


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `width` consecutive words of an item, or all of an item with fewer. Words of a document inside any
    occurrence of a window are hit. Null texts have no words; items without words have no windows; repeated item ids
    count once, repeated documents each; no items leave every document clean; no documents give no rows.
    """
    index = index_for(docs, items)
    rare = {}
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for block in blocks(items):
        owners: dict[tuple[str, ...], set[str]] = {}
        for item, text in block:
            for w in item_windows(text, width):
                owners.setdefault(w, set()).add(item)
        need = {t for w in owners for t in w}
        rare = {r.term: r.n for r in term_counts(index).where(F.col("term").isin(list(need)) if len(need) < 1000 else F.lit(True)).toLocalIterator() if r.term in need}
        part = matches(index, list(owners), [sorted(x) for x in owners.values()], rare, kind)
        found = part if found is None else found.union(part)
    if found is None:
        found = matches(index, [], [], {}, kind)
    per_doc = found.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return per_doc.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of `docs` in which no window of any item occurs; `docs` must be a stored table, as its rows are numbered."""
    numbered = docs.withColumn("__rid", F.monotonically_increasing_id())
    hit = contamination(numbered.select(F.col("__rid").alias("doc_id"), "text"), items, width).where("contaminated")
    return numbered.join(hit.select(F.col("doc_id").alias("__rid")), "__rid", "left_anti").drop("__rid")


def matches(index: DataFrame, windows: list[tuple[str, ...]], owners: list[list[str]], rare: dict[str, int], kind: str) -> DataFrame:
    """Per document of the index: (segment, place) that name it, doc_id, n_words, the word numbers hit, the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                which, start = s.phrases(windows, rare)
                length = np.array([len(windows[i]) for i in which], np.int64)
                size = int((s.lengths + 1).sum())
                edge = np.zeros(size + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                hit = np.flatnonzero(np.cumsum(edge)[:size] > 0)
                at = s.doc(hit)
                cut = np.searchsorted(at, np.arange(len(s.lengths) + 1))
                items: dict[int, set[str]] = {}
                for i, d in set(zip(which.tolist(), s.doc(start).tolist(), strict=True)):
                    items.setdefault(d, set()).update(owners[i])
                n = len(s.lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(s.doc_ids, batch.schema.field("doc_ids").type.value_type), pa.array(s.lengths),
                        pa.array([(hit[cut[i] : cut[i + 1]] - s.starts[i]).tolist() for i in range(n)], pa.list_(pa.int64())), pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string())),
                    ],
                    names=["segment", "place", "doc_id", "n_words", "hits", "items"],
                )

    return index.withColumn("segment", F.monotonically_increasing_id()).mapInArrow(run, f"segment long, place int, doc_id {kind}, n_words long, hits array<long>, items array<string>")


def proximity_matches(docs: DataFrame, items: DataFrame, within: int = 20, least: int = 2) -> DataFrame:
    """(doc_id, item_id, start): places where all different words of an item of at least `least` occur, in any order, within that many words.

    `start` is the first word of the earliest such stretch around each occurrence of the item's rarest word. Made for
    short items; every item's lists are scanned from its rarest word.
    """
    index = index_for(docs, items)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for block in blocks(items):
        wanted = [(i, sorted({t.decode("utf-8", "replace") for t in words(text)})) for i, text in block]
        wanted = [(i, w) for i, w in wanted if len(w) >= least]

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = set()
                for row in batch.to_pylist():
                    s = Segment(row)
                    for item, terms in wanted:
                        if not all(t in s.at for t in terms):
                            continue
                        lists = sorted((s.list_of(s.at[t]) for t in terms), key=len)
                        starts = np.unique((lists[0][:, None] - np.arange(within)).ravel())
                        for x in lists:
                            after = np.append(x, 1 << 60)[np.searchsorted(x, starts)]
                            starts = starts[after < starts + within]
                        first = np.minimum.reduce([x[np.searchsorted(x, starts)] for x in lists]) if len(starts) else starts
                        last = np.maximum.reduce([x[np.searchsorted(x, starts)] for x in lists]) if len(starts) else starts
                        for a, z in zip(first.tolist(), last.tolist(), strict=True):
                            d = bisect.bisect_right(s.starts, a) - 1
                            if z < s.starts[d] + s.lengths[d]:
                                out.add((s.doc_ids[d], item, int(a - s.starts[d])))
                columns = list(zip(*sorted(out, key=repr), strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("doc_ids").type.value_type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["doc_id", "item_id", "start"])

        part = index.mapInArrow(run, f"doc_id {kind}, item_id string, start long")
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id string, start long")


def oracle(width: int = WINDOW) -> str:
    """contamination() over `documents` and `benchmark` in DuckDB SQL."""
    split = lambda t: f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split("text")} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, {split("text")} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), {width}) AS n, unnest(list_transform(range(1, greatest(len(w) - {width} + 1, 1) + 1), lambda s: array_to_string(w[s : s + {width - 1}], ' '))) AS gram FROM i WHERE len(w) > 0),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d),
m AS (SELECT p.r, p.s, g.n, g.item_id FROM p JOIN (SELECT DISTINCT n AS size FROM g) z ON p.s + z.size - 1 <= len(p.w) JOIN g ON g.n = z.size AND g.gram = array_to_string(p.w[p.s : p.s + z.size - 1], ' ')),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM m) GROUP BY r),
x AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM m GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(x.n_items, 0)::BIGINT AS n_items, sha256(coalesce(x.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN x ON x.r = d.r"""
