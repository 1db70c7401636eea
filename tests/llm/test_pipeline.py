"""The corpus pipeline against plain Python, stage by stage, and its stages on awkward tables."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline as pipeline
import numpy as np
import xxhash
from test_operators import TOKENIZER, plain_lines, plain_words, roots
from tokenizers import Tokenizer

from hotspan.llm import decontaminate, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b for a in ("river", "stone", "tree", "cloud", "house", "field", "road", "glass", "wind", "bread") for b in ("", "s", "ed", "ing", "let", "ful", "ward", "like", "ish", "er")]


def tables(spark, folder, docs, labels, items):
    """The input tables of a run, each with a column more than it needs."""
    rows = [(d, t, "en", "web", len(t or ""), "more") for d, t in docs]
    spark.createDataFrame(rows, DOCS + ", component_id string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(docs):
    """The documents with the smallest id of each group of near duplicates."""
    ids = sorted(docs)
    fp = {d: fingerprint(docs[d]) for d in ids}
    group = roots(ids, [(a, b) for a, b in combinations(ids, 2) if (fp[a] ^ fp[b]).bit_count() <= 3])
    return {d: docs[d] for d in ids if group[d] == d}


def plain_clean(docs, items):
    windows = {tuple(x.encode() for x in g) for _, t in items for g in decontaminate.item_windows(t)}
    holds = lambda w: any(tuple(w[p : p + n]) in windows for n in {len(g) for g in windows} for p in range(len(w) - n + 1))
    return {d: t for d, t in docs.items() if not holds(plain_words(t))}


def plain_pieces(docs):
    encode, out = Tokenizer.from_file(TOKENIZER), Counter()
    for d, t in docs.items():
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % 1024 or 1024
        for piece, at in enumerate([0, *range(cut, len(ids), 1024)]):
            part = ids[at : cut if at == 0 else at + 1024]
            out[(d, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    return out


def test_every_stage_matches_plain_python(spark, tmp_path, monkeypatch):
    rnd = random.Random(31)
    line = lambda: [rnd.choice(VOCABULARY) for _ in range(12)]
    shared = [line() for _ in range(12)]

    def text(of=2):
        lines = [line() for _ in range(rnd.randrange(2, 8))]
        for x in rnd.sample(shared, rnd.randrange(of + 1)):
            x = list(x)
            if rnd.random() < 0.6:
                x[rnd.randrange(12)] = rnd.choice(VOCABULARY)
            lines.insert(rnd.randrange(len(lines) + 1), x)
        return "\n".join(" ".join(x).capitalize() + "." for x in lines)

    items = [(1, " ".join(line() + line())), (2, "two words"), (3, None), (4, "")]
    docs = {i: text(0 if 20 <= i < 28 else 2) for i in range(90)}
    docs |= {100 + i: docs[i] for i in range(8)}  # exact copies: their lines go, what is left is one group of empty texts
    docs |= {110 + i: docs[20 + i].replace("\n", " ") for i in range(8)}  # copies that only the document stage can see
    docs |= {120: docs[1] + "\nAnd " + items[0][1].upper() + " too.", 121: text() + " has two words in it.", 122: text() * 30}
    bad = {200 + i: "buy | now " * rnd.randrange(5, 30) + str(i) for i in range(40)}
    labels = [(d, 1, 0) for d in docs] + [(d, 0, 0) for d in bad]
    every = {**docs, **bad, 300: None, 301: ""}
    folder = tables(spark, tmp_path, list(every.items()), labels, items)

    seen = []
    noted = lambda f: lambda s, d, sf: seen.append({r.doc_id: r.text for r in d.collect()}) or f(s, d, sf)
    monkeypatch.setattr(pipeline, "STAGES", [(name, noted(f)) for name, f in pipeline.STAGES])
    got = pipeline.run(spark, folder).collect()

    source = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = quality.fit(quality.training_rows(source, spark.read.parquet(f"{folder}/labels.parquet"), "quality"))
    score = dict(zip(every, model.score(np.array([quality.statistics(t) for t in every.values()])), strict=True))
    assert seen[0] == every and seen[1] == {d: t for d, t in every.items() if score[d] >= pipeline.REJECT_UNDER}
    assert set(docs) <= set(seen[1]) and not set(bad) & set(seen[1])
    lines, links = plain_lines(seen[1])
    assert links > 5 and seen[2] == lines and seen[2] != seen[1]
    assert seen[3] == plain_groups(seen[2]) and not {110, 111} & set(seen[3]) and set(range(20, 90)) <= set(seen[3])
    assert seen[4] == plain_clean(seen[3], items) and not {120, 121} & set(seen[4]) and len(seen[3]) - len(seen[4]) == 2
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces(seen[4])
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, n in sorted(content):
            assert offset == at
            at += n
        assert at <= 1024


def test_stages_take_awkward_rows(spark, tmp_path, stored):
    """Nulls in all columns, repeated rows, empty texts, a clashing column: each stage keeps the columns of documents."""
    good = "The river ran over stones and trees.\nAnother line of words that is like no other."
    rows = [(1, good, "en", "a", 5, "x"), (1, good, "en", "a", 5, "x"), (None, None, None, None, None, None), (None, good, None, None, None, None), (2, "", "en", None, 0, ""), (3, "word " * 30000, None, "b", None, None)]
    folder = tables(spark, tmp_path / "sf", [(r[0], r[1]) for r in rows], [(1, 1, 0), (None, 0, None)], [(None, None), (5, None), (6, "")])
    docs = stored(rows, DOCS + ", __rid string")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == list(pipeline.COLUMNS), name
        kept[name] = made.collect()
    assert len(kept["line dedup"]) == 6 and sum(r.text == good for r in kept["line dedup"]) == 1
    assert sorted((r.doc_id or 0) for r in kept["simhash near-dedup"]) == [1, 2, 3]  # of null and empty texts the one with an id
    assert len(kept["benchmark decontamination"]) == 6
    assert sum(r.start == 0 for r in pipeline.packing_stage(spark, docs, folder).collect()) == 6


def test_run_of_no_documents(spark, tmp_path):
    assert pipeline.run(spark, tables(spark, tmp_path, [], [], [])).collect() == []
