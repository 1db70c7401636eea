"""Language identification in two steps: the family, then one-versus-one linear SVMs between its languages.

Texts become hashed counts of character 1- to 3-grams, weighted down by a square root and scaled to length one. Linear
support vector machines, fit by Pegasos-style averaged subgradient steps, first separate the families, each against the
rest; within the chosen family every pair of languages has its own machine and the language with most wins is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Documents per language that the fit uses at most: the documented bound. They are the first by hash of the id in each
#: of so many shards of a language, so that no window holds a whole language.
TRAIN_PER_LANGUAGE, SHARDS, BUCKETS, EPOCHS = 832, 64, 4096, 12
#: Fixed: families of languages by code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
}


def has_letter(text: str) -> bool:
    """Whether any character is a letter of Unicode; numbers such as one half or a superscript two are none."""
    return any(map(str.isalpha, text))


def family_of(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language in codes), language)


def profile(text: str) -> np.ndarray:
    """Hashed 1- to 3-gram counts of a whole lower-cased text."""
    b = np.frombuffer(b" " + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" ", np.uint8)
    total = np.zeros(BUCKETS)
    for at in range(0, len(b), 1 << 20):  # windows overlap by two bytes, so every n-gram counts once
        c = b[at : at + (1 << 20) + 2].astype(np.uint32)
        if len(c) < 3:
            break
        two = c[:-2] * np.uint32(257) + c[1:-1]
        three = two * np.uint32(65599) + c[2:] * np.uint32(2654435)
        total += np.bincount(three % np.uint32(2999) + np.uint32(1024), minlength=BUCKETS)
        total += np.bincount(two * np.uint32(2654435) % np.uint32(768) + np.uint32(256), minlength=BUCKETS)
        total += np.bincount(c[:-2], minlength=BUCKETS)
    root = np.sqrt(total)
    return root / max(1e-12, float(np.linalg.norm(root)))


def machine(x: np.ndarray, y: np.ndarray, seed: int, penalty: float = 1e-4, epochs: int = EPOCHS) -> np.ndarray:
    """Averaged Pegasos for the hinge loss with labels +-1, classes weighted alike; the last weight is the bias."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1))])
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    weight = np.where(y > 0, len(y) / (2.0 * max(1, (y > 0).sum())), len(y) / (2.0 * max(1, (y < 0).sum())))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 16):
            some = order[at : at + 16]
            t += 1
            step = 1.0 / (penalty * (t + 1.0 / penalty / 8.0))
            wrong = y[some] * (x[some] @ w) < 1
            w = (1 - step * penalty) * w + step / len(some) * ((weight[some] * y[some] * wrong) @ x[some])
            if epoch >= epochs // 2:
                mean += w
    return mean / max(1, np.linalg.norm(mean)) * max(1e-9, np.linalg.norm(w))


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); score is the product of both steps' sigmoid margins, between 0 and 1."""
        if not text or not has_letter(text) or not self.families:
            return "und", 0.0
        x = np.append(profile(text), 1.0)
        sure = 1.0
        family = self.families[0]
        if len(self.families) > 1:
            margin = self.family_weights @ x
            order = np.argsort(-margin, kind="stable")
            family = self.families[order[0]]
            sure = 1 / (1 + np.exp(-2 * np.clip(margin[order[0]] - margin[order[1]], -30, 30)))
        names, wins, margins = self.members[family], np.zeros(len(self.members[family])), np.zeros(len(self.members[family]))
        for a, b, w in self.pairs[family]:
            m = float(w @ x)
            wins[a if m >= 0 else b] += 1
            margins[a] += m
            margins[b] -= m
        best = max(range(len(names)), key=lambda i: (wins[i], margins[i], -i))
        if len(names) > 1:
            sure *= 1 / (1 + np.exp(-2 * np.clip(margins[best] / (len(names) - 1), -30, 30)))
        return names[best], float(np.clip(sure, 0.0, 1.0))


def fit(labelled: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Model from (key, text, lang). Null languages, and texts that are null or have no letter, are left out; a key counts once."""
    from pyspark.sql.window import Window

    from .common import checkpoint

    ids = labelled.where("lang is not null and text is not null").groupBy("key").agg(F.min("lang").alias("lang")).withColumn("shard", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(SHARDS)))
    order = Window.partitionBy("lang", "shard").orderBy(F.xxhash64("key", F.lit(9)), "key")
    chosen = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= -(-per_language // SHARDS)).select("key", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, t) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) if t and has_letter(t)]
            x = [profile(t).astype(np.float32).tobytes() for _, t in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(x, pa.binary())], names=["lang", "x"])

    one = labelled.select("key", "lang", "text").join(chosen, ["key", "lang"]).groupBy("key", "lang").agg(F.min("text").alias("text"))
    rows = checkpoint(one.select("lang", "text").mapInArrow(run, "lang string, x binary")).orderBy("lang", "x").collect()
    model = Model()
    if not rows:
        return model
    langs = np.array([r.lang for r in rows])
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], dtype=np.float64)
    for lang in sorted(set(langs.tolist())):
        model.members.setdefault(family_of(lang), []).append(lang)
    model.families = sorted(model.members)
    of = np.array([family_of(v) for v in langs.tolist()])
    if len(model.families) > 1:
        model.family_weights = np.array([machine(x, np.where(of == f, 1.0, -1.0), i) for i, f in enumerate(model.families)])
    for f, names in model.members.items():
        model.pairs[f] = []
        for a, b in combinations(range(len(names)), 2):
            mine = (langs == names[a]) | (langs == names[b])
            model.pairs[f].append((a, b, machine(x[mine], np.where(langs[mine] == names[a], 1.0, -1.0), 100 + 10 * a + b)))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without `text` and with lang_pred and score; every whole text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t) for t in b.column("__text").to_pylist()]
            keep = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    kept = [c for c in docs.columns if c.lower() not in ("text", "lang_pred", "score")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["lang_pred string, score double"])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def classify(docs: DataFrame) -> DataFrame:
    """Per document doc_id, held_out, lang_pred, score, learnt from text and lang of documents that are not held out.

    A null text, or one without a letter (marks and numbers of any script are none), is `und` with score 0, as is everything where nothing could be learnt.
    Repeated rows are predicted each; no rows give none.
    """
    model = fit(docs.where(~held_out()).select(F.col("doc_id").alias("key"), "text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
