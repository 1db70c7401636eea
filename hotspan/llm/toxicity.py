"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nystroem landmarks.

Words are compared by the subsequences of letters that they share, gaps costing a factor per letter spanned, so that an
insult with letters put in between is still near the plain one. The kernel against a few landmark strings, whitened by
the landmarks' own kernel matrix, gives each word a short vector, and a linear machine over these vectors is trained on
the labelled texts as bags of words: of every toxic text the most suspicious word counts, of a clean one every word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, held_out

#: The documented bounds of training: labelled texts (the first by hash of the id), candidate strings, landmarks, clean words.
TRAIN_ROWS, CANDIDATES, LANDMARKS, CLEAN_WORDS = 16_000, 600, 64, 3_000
ORDER, DECAY, LONGEST = 3, 0.55, 24
#: Fixed: digits and signs that stand for letters, bytes that are dropped, A-Z lower-cased.
STAND_FOR = {ord("0"): "o", ord("1"): "i", ord("3"): "e", ord("4"): "a", ord("5"): "s", ord("7"): "t", ord("@"): "a", ord("$"): "s"}
FOLD = bytes(ord(STAND_FOR[c]) if c in STAND_FOR else c + 32 if 65 <= c <= 90 else 32 if c <= 32 else c for c in range(256))
DROP = bytes(c for c in range(33, 128) if c not in STAND_FOR and not 65 <= c <= 90 and not 97 <= c <= 122)
SPACED = re.compile(rb"(?:(?<= )|(?<=^))(?:[a-z\x80-\xff] ){3,}[a-z\x80-\xff](?= |$)")


def words(text: str | None) -> list[bytes]:
    """Words of a whole text: signs inside a word are dropped, runs of four or more single letters joined to one."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(FOLD, DROP)
    out = raw.split()
    return out + [m.replace(b" ", b"") for m in SPACED.findall(raw)]


def letters(strings: Iterable[bytes], longest: int = LONGEST) -> np.ndarray:
    """Rows of letter numbers, 0 beyond a string's end."""
    out = np.zeros((len(strings), longest), np.uint8)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s[:longest], np.uint8)
    return out


def subsequences(x: np.ndarray, y: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted count of common subsequences of `order` letters of rows of x and rows of y (or its only row).

    Rows are 0 beyond a string's end. Gaps in either string cost a factor `decay` a letter.
    """
    n, m = x.shape[1], y.shape[1]
    ends = ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] > 0)).astype(np.float32) * decay**2  # matches of one letter at (i, j)
    same = ends.copy()
    for _ in range(order - 1):
        # the mass of shorter matches that end before (i, j), decayed by the distance
        before = np.zeros_like(ends)
        run = np.zeros((len(ends), m), np.float32)
        for i in range(1, n):
            run = run * decay + ends[:, i - 1]
            across = np.zeros(len(ends), np.float32)
            for j in range(1, m):
                across = across * decay + run[:, j - 1]
                before[:, i, j] = across
        ends = same * before
    return ends.sum((1, 2))


def kernel(some: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalised subsequence kernel of strings with landmarks: 1 for equal ones."""
    x = letters(some)
    width = max((len(w) for w in some), default=1)
    x = np.ascontiguousarray(x[:, :width])
    own = np.maximum(subsequences(x, x), 1e-9)
    columns = []
    for v in landmarks:
        y = letters([v])[:, : len(v)]
        columns.append(subsequences(x, y) / np.sqrt(own * subsequences(y, y)[0]))
    return np.column_stack(columns)


@dataclass
class Model:
    landmarks: list[bytes]
    whiten: np.ndarray | None = None
    weights: np.ndarray | None = None
    floor: float = -3.0
    slope: float = 4.0
    offset: float = 0.0

    def vectors(self, some: list[bytes]) -> np.ndarray:
        """Nystroem vectors, and a constant."""
        parts = [kernel(some[i : i + 4096], self.landmarks) @ self.whiten for i in range(0, len(some), 4096)]
        return np.hstack([np.vstack(parts), np.ones((len(some), 1))])

    def passages(self, found: list[bytes]) -> dict[int, set[bytes]]:
        """By number of a word: the parts of it in which some landmark's letters follow each other with small gaps."""
        out: dict[int, set[bytes]] = {}
        if not found or not self.landmarks:
            return out
        size = np.array([len(w) for w in found])
        flat = np.frombuffer(b"".join(found), np.uint8)
        has = np.bitwise_or.reduceat(np.uint64(1) << (flat & 63).astype(np.uint64), np.cumsum(size) - size)
        for v in self.landmarks:
            mask = np.bitwise_or.reduce(np.uint64(1) << (np.frombuffer(v, np.uint8) & 63).astype(np.uint64))
            pattern = gapped(v)
            for i in np.flatnonzero((np.bitwise_count(mask & ~has) <= (len(v) >= 6)) & (size >= ORDER)).tolist():
                if v in found[i]:
                    out.setdefault(i, set()).add(v)
                elif m := pattern.search(found[i]):
                    out.setdefault(i, set()).add(m[0][:LONGEST])
        return out

    def margins(self, found: list[bytes]) -> np.ndarray:
        """Decision value of each word, that of its worst passage; `floor` for words without one."""
        out = np.full(len(found), self.floor)
        near = self.passages(found)
        different = list(set().union(*near.values()))
        if different:
            value = dict(zip(different, np.maximum(self.vectors(different) @ self.weights, self.floor + 0.5).tolist(), strict=True))
            for i, some in near.items():
                out[i] = max(value[x] for x in some)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def gapped(v: bytes) -> re.Pattern[bytes]:
    """The letters of a landmark in order with gaps of up to two; of six letters or more one inner one may be left out."""
    ways = [v] + [v[:i] + v[i + 1 :] for i in range(1, len(v) - 1) if len(v) >= 6]
    return re.compile(b"|".join(b".{0,2}?".join(re.escape(w[i : i + 1]) for i in range(len(w))) for w in ways), re.DOTALL)


def machine(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 400, penalty: float = 2e-3) -> np.ndarray:
    """Linear machine with the squared hinge loss, classes weighted alike, by Newton-like steps on the active rows."""
    beta = np.zeros(x.shape[1])
    c = w * np.where(y > 0, 0.5 / max(1e-9, w[y > 0].sum()), 0.5 / max(1e-9, w[y < 0].sum()))
    for _ in range(rounds):
        active = y * (x @ beta) < 1
        a = x[active]
        new = np.linalg.solve(a.T @ (a * c[active, None]) + penalty * np.eye(x.shape[1]) * 0.1, a.T @ (c[active] * y[active]))
        if np.allclose(new, beta, atol=1e-7):
            break
        beta = beta + 0.5 * (new - beta)
    return beta


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, text, y): labelled documents that are not held out; a repeated id counts once, with its largest label."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    one = one.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    return docs.select("doc_id", "text").where("text is not null").join(one, "doc_id").groupBy(F.col("doc_id").alias("key")).agg(F.min("text").alias("text"), F.max("y").alias("y"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many toxic and clean texts a word of 3 to LONGEST bytes occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                w = [x for x in set(words(t)) if 3 <= len(x) <= LONGEST]
                at += [i] * len(w)
                out += w
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column("y").take(pa.array(at, pa.int32()))], names=["word", "y"])

    one = rows.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "word binary, y int")
    return one.groupBy("word").agg(F.sum("y").cast("long").alias("toxic"), F.sum(1 - F.col("y")).cast("long").alias("clean"))


def fit(rows: DataFrame) -> Model:
    rows = checkpoint(rows)
    counts = checkpoint(word_counts(rows))
    share = rows.agg(F.avg("y")).first()[0] or 0.0
    # strings of 4 to 8 bytes inside words, by how many toxic and clean texts hold the words they stand in
    pieces = F.flatten(F.transform(F.sequence(F.lit(4), F.lit(8)), lambda n: F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, n))).otherwise(F.array().cast("array<binary>"))))
    grams = counts.where("toxic > 0").select("word", "toxic", "clean", F.explode(F.array_distinct(pieces)).alias("gram")).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("words"))
    grams = grams.where("toxic >= 3")
    # a gram in toxic texts' words only may still be common in words that only clean texts have
    lost = counts.where("toxic = 0").select("clean", F.explode(F.array_distinct(pieces)).alias("gram")).groupBy("gram").agg(F.sum("clean").alias("more"))
    rate = F.lit(max(share, 1e-6))
    joined = grams.join(lost, "gram", "left").withColumn("clean", F.col("clean") + F.coalesce("more", F.lit(0)))
    total = F.col("toxic") + F.col("clean")
    signal = (F.col("toxic") - total * rate) / F.sqrt(total * rate * (1 - rate) + 1)
    best = joined.withColumn("z", signal).where((F.col("z") > 4) & (F.col("toxic") > 2 * F.col("clean"))).orderBy(F.desc("z"), F.desc(F.length("gram")), "gram").limit(CANDIDATES).collect()
    rare = counts.where("toxic > 0 and clean = 0").orderBy(F.desc("toxic"), F.xxhash64("word"), "word").limit(4 * CLEAN_WORDS).collect()
    landmarks = covering({bytes(r.gram): r.clean for r in best}, {bytes(r.word): r.toxic for r in rare})
    if not landmarks:
        return Model([], offset=float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))) + 12.0)
    among = kernel(landmarks, landmarks)
    value, vector = np.linalg.eigh((among + among.T) / 2 + 1e-3 * np.eye(len(landmarks)))
    model = Model(landmarks, vector / np.sqrt(np.maximum(value, 1e-3)))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.passages([bytes(w) for w in b.column("word").to_pylist()])
            rows = [(i, x) for i, some in found.items() for x in some]
            at = pa.array([i for i, _ in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in rows], pa.binary()), b.column("toxic").take(at), b.column("clean").take(at)], names=["passage", "toxic", "clean"])

    # passages of all training words that are near a landmark, with the texts they stand in: what is to be told apart
    near = counts.select("word", "toxic", "clean").mapInArrow(passages, "passage binary, toxic long, clean long").groupBy("passage").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    told = near.orderBy(F.desc(F.col("toxic") + F.col("clean")), "passage").limit(2 * CLEAN_WORDS).collect()
    bad = {bytes(r.passage): float(r.toxic) - float(r.clean) * share / max(1e-9, 1 - share) for r in told}
    good = {bytes(r.passage): float(r.clean) for r in told}
    # a letter put into an insult, as it may be written
    spread = {v[:i] + b"x" + v[i:] for v in landmarks for i in range(1, len(v))} - set(bad)
    taught = [(k, 1.0, w) for k, w in bad.items() if w > 0] + [(k, -1.0, w) for k, w in good.items() if w > 0] + [(k, 1.0, 1.0) for k in spread]
    w = np.sqrt(np.array([r[2] for r in taught]))
    model.weights = machine(model.vectors([r[0] for r in taught]), np.array([r[1] for r in taught]), w)
    # the margin of a text is that of its worst word: fit a sigmoid to the training texts' margins
    held = margins(rows.select("y", "text"), model).groupBy("y", F.round("margin", 3).alias("m")).count().collect()
    m, t, n = (np.array([r[i] for r in held], float) for i in (1, 0, 2))
    model.slope, model.offset = sigmoid(m, t, n)
    return model


def covering(grams: dict[bytes, int], toxic: dict[bytes, int]) -> list[bytes]:
    """Landmarks: of the candidate strings (with their clean texts), again and again the one that stands in most toxic
    texts' words not yet covered, clean texts counting against it threefold."""
    inside = {g: [w for w in toxic if g in w] for g in grams}
    chosen: list[bytes] = []
    while inside and len(chosen) < LANDMARKS:
        gain = {g: sum(toxic[w] for w in ws) - 3 * grams[g] for g, ws in inside.items()}
        best = max(gain, key=lambda g: (gain[g], len(g), g))
        if gain[best] < 3:
            break
        chosen.append(best)
        done = set(inside.pop(best))
        inside = {g: rest for g, ws in inside.items() if (rest := [w for w in ws if w not in done])}
    return chosen


def sigmoid(m: np.ndarray, t: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Logistic regression of labels on one margin, slightly regularised, by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([(n * (p - t) * m).sum() + 0.01 * a, (n * (p - t)).sum()])
        s = n * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * m * m).sum() + 0.01, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - size * step[0], b - size * step[1]
    return float(max(a, 0.1)), float(b)


def margins(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without `text` and with `margin`, that of the worst word of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            texts = b.column("__text").to_pylist()
            for lo in range(0, len(texts), 512):
                bags = [set(words(t)) for t in texts[lo : lo + 512]]
                different = list(set().union(*bags))
                value = model.margins(different)
                hot = {different[i]: value[i] for i in np.flatnonzero(value > model.floor).tolist()}
                out += [max((hot[w] for w in bag & hot.keys()), default=model.floor) for bag in bags]
            keep = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(out, pa.float64())], names=[*keep, "margin"])

    kept = [c for c in docs.columns if c.lower() not in ("text", "margin")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["margin double"])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document doc_id, held_out, score, predicted, learnt from labels.toxic of documents that are not held out.

    Null and empty texts have no words and get the lowest margin. Without labels, or without any string that marks
    toxic texts, all texts get the share of toxic labels as score. Repeated rows are scored each; no rows give none.
    """
    model = fit(training_rows(docs, labels))
    scored = margins(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("margin") * model.slope + model.offset))))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
