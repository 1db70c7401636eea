"""URL filter: rules by host and path, then a weighted vocabulary matched with an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (term, weight): "strict" rejects alone; several different "soft" ones are needed.
VOCABULARY = (
    ("casino", "strict"), ("porn", "strict"), ("xxx", "strict"), ("adult-x", "strict"), ("cheap-pills", "strict"), ("free-bets", "strict"), ("spam", "strict"),
    ("free", "soft"), ("bets", "soft"), ("cheap", "soft"), ("pills", "soft"), ("win", "soft"), ("bonus", "soft"), ("adult", "soft"),
    ("loans", "soft"), ("farm", "soft"), ("ads", "soft"), ("track", "soft"), ("click", "soft"),
)
#: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")


def automaton(vocabulary: Sequence[tuple[str, str]]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for term, weight in vocabulary:
        auto.add_word(term, (term, weight))
    auto.make_automaton()
    return auto


def hits(auto: ahocorasick.Automaton, url: str) -> tuple[int, int]:
    """How many different strict and soft terms stand in a lower-cased url, no ASCII letter or digit on either side."""
    word = lambda c: c.isascii() and c.isalnum()
    found = set()
    for end, (term, weight) in auto.iter(url) if len(auto) else ():
        at = end - len(term) + 1
        if (at == 0 or not word(url[at - 1])) and (end + 1 == len(url) or not word(url[end + 1])):
            found.add((weight, term))
    strict = sum(w == "strict" for w, _ in found)
    return strict, len(found) - strict


def parts(url: str | None) -> tuple[str, str]:
    """Host after the first :// (lower case) and path; both empty without one."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for c in "?#":
        rest = rest.partition(c)[0]
    host, slash, path = rest.partition("/")
    return lower_ascii(host), slash + path


def filter_urls(pages: DataFrame, url: str = "url", vocabulary: Sequence = VOCABULARY, rules: Sequence = RULES, soft_needed: int = 2) -> DataFrame:
    """`pages` with host, path, rule, strict_hits, soft_hits and verdict instead of any columns so called.

    The longest rule whose host is the url's or a parent domain of it, and whose path starts the url's, decides; else
    one strict term or `soft_needed` different soft ones block. A null, empty or scheme-less url has an empty host and
    path, so no rule fits it; the vocabulary still applies to its text, and a null one is allowed. Rows are judged one
    by one: repeated rows are repeated in the result, an empty table gives an empty one.
    """
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for u in batch.column("__url").to_pylist():
                host, path = parts(u)
                strict, soft = hits(auto, lower_ascii(u or ""))
                fit = next((r for r in by_length if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), None)
                verdict = fit[0] if fit else "block" if strict or soft >= soft_needed else "allow"
                out.append((host, path, fit and fit[1] + fit[2], strict, soft, verdict))
            columns = list(zip(*out, strict=True)) or [()] * 6
            keep = [n for n in batch.schema.names if n != "__url"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(c, t) for c, (_, t) in zip(columns, MADE, strict=True)], names=keep + [n for n, _ in MADE])

    kept = [c for c in pages.columns if c.lower() not in {n for n, _ in MADE}]
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept] + ["host string, path string, rule string, strict_hits int, soft_hits int, verdict string"])
    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(url).cast("string").alias("__url")).mapInArrow(judge, schema)


MADE = (("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("strict_hits", pa.int32()), ("soft_hits", pa.int32()), ("verdict", pa.string()))


def oracle(pages: str = "pages", vocabulary: Sequence = VOCABULARY, rules: Sequence = RULES, soft_needed: int = 2) -> str:
    """The same verdicts in DuckDB SQL."""
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    count = lambda kind: " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t, w in vocabulary if w == kind) or "0"
    fits = lambda r: f"((host = '{r[1]}' OR host LIKE '%.{r[1]}') AND starts_with(path, '{r[2]}'))"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[1]}{r[2]}'" for r in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in ordered) + f" WHEN strict_hits >= 1 OR soft_hits >= {soft_needed} THEN 'block' ELSE 'allow' END"
    return f"""
WITH u AS (SELECT page_id, {lower("coalesce(url, '')")} AS low,
  CASE WHEN contains(url, '://') THEN split_part(split_part(substr(url, strpos(url, '://') + 3), '?', 1), '#', 1) ELSE '' END AS rest FROM {pages}),
p AS (SELECT page_id, low, {lower("split_part(rest, '/', 1)")} AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM u),
h AS (SELECT *, {count("strict")} AS strict_hits, {count("soft")} AS soft_hits FROM p)
SELECT page_id, host, path, {rule} AS rule, strict_hits::INT AS strict_hits, soft_hits::INT AS soft_hits, {verdict} AS verdict FROM h"""
