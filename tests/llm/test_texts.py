"""Conversation repair, periodic runs and main texts of pages against plain Python on small, awkward tables."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from hotspan.llm import conversations, html, periodic

TURNS = "conv_id long, turn long, role string, text string, cost string"


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# --- conversations -----------------------------------------------------------------------------------------------------


def least_audit(rows):
    """Every sequence of edits of (first, truncated, stays) rows up to two insertions a place: the least cost, then audit."""
    best = None
    for edits in product("KRD", repeat=len(rows)):
        spent = 0
        for e, (first, cut, stays) in zip(edits, rows, strict=True):
            spent += {"K": 0, "R": 2, "D": 3}[e] + (cut if e != "D" else 0)
            if e != "D" and not stays or e == "K" and first not in "sua":
                break
        else:
            for inserted in product(range(3), repeat=len(rows) + 1):
                if best is not None and spent + 2 * sum(inserted) > best[0]:
                    continue
                audit, out = "I" * inserted[0], ["?"] * inserted[0]
                for e, (first, _, _), k in zip(edits, rows, inserted[1:], strict=True):
                    audit += e + "I" * k
                    out += ([first] if e == "K" else ["?"] if e == "R" else []) + ["?"] * k
                body = out[1:] if out and out[0] == "s" else out
                if len(body) % 2 or (out and not body) or any(x not in ("?", "ua"[i % 2]) for i, x in enumerate(body)):
                    continue
                found = (spent + 2 * sum(inserted), audit)
                best = found if best is None else min(best, found)
    return best


def test_fold_finds_the_cheapest_edits(spark):
    rnd = random.Random(4)
    cases = []
    for k in range(60):
        roles = [rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]) for _ in range(rnd.randrange(5))]
        cases += [(k, i, r, rnd.choice(["Yes.", "No!", "cut", "", "  ", f"Number {i}.", "Yes."]), None) for i, r in enumerate(roles)]
    got = {r.conv_id: r for r in conversations.repair(spark.createDataFrame(cases, TURNS)).collect()}
    for k in {c[0] for c in cases}:
        seen, rows = set(), []
        for _, _, role, text, _ in (c for c in cases if c[0] == k):
            blank, again = not text.strip(), (role, text) in seen
            seen.add((role, text))
            rows.append((role[:1] or "-", int(not blank and not again and text.strip()[-1] not in ".!?"), not blank and not again))
        assert (got[k].cost, got[k].audit) == least_audit(rows), rows
        turns = iter([c for c in cases if c[0] == k])
        lines, place, system = [], 0, 0
        for e in got[k].audit:
            turn = next(turns) if e != "I" else None
            if e == "D":
                continue
            if e == "K" and turn[2][0] == "s":
                lines.append((turn[2], turn[3]))
                system = 1
                continue
            lines.append((turn[2] if e == "K" else ("user", "assistant")[place % 2], turn[3] if turn else ""))
            place += 1
        assert [tuple(x) for x in got[k].repaired] == lines
        assert [r[:1] for r, _ in lines][system:] == ["u", "a"] * (place // 2)


def harmed(rows):
    out = []
    for conv, turn, role, text, _ in rows:
        sp = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def test_query_of_conversations_and_its_sql(spark, stored):
    import duckdb

    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["system", "user", "assistant", None]), rnd.choice(["Hi there.", "what", None, "", " \t\n", "Ok!\x0b", "Ω?", "No. " * 3]), "x") for c in range(80) for t in rnd.sample([None, 0, 1, 2, 3, 7, 9], rnd.randrange(1, 6))]
    rows += [(None, 1, "user", "Null id.", "x"), (None, None, None, None, None)] + rows[:10] + [(500, t, "user", "Long. " * 3000, "x") for t in range(3)]
    rows += [(c, 0, "user", "Lonely.", "x") for c in range(1000, 1060)]
    made = conversations.digests(stored(rows, TURNS))
    got = sorted(map(tuple, made.collect()), key=repr)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar, cost varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?, ?)", rows)
    want = con.sql(conversations.oracle())
    assert list(made.columns) == want.columns
    assert got == sorted(want.fetchall(), key=repr)
    left = {r[0] for r in harmed(rows)}
    lost = {r[0] for r in rows} - left
    assert lost, "no conversation without rows in this test"
    assert all(r[1:] == (0, 0, 0, 0, 0, 0, "", sha("")) for r in got if r[0] in lost)
    by = {r[0]: r for r in got}
    for conv in left:
        turns = [t for c, t, _, _ in harmed(rows) if c == conv and t is not None]
        assert by[conv][1] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)


def test_conversations_of_no_rows_and_of_extreme_numbers(spark):
    assert conversations.digests(spark.createDataFrame([], TURNS)).collect() == []
    far = [(1, -(2**63), "user", "Hi.", None), (1, 2**63 - 1, "assistant", "Yes.", None)]
    (r,) = conversations.repair(spark.createDataFrame(far, TURNS)).collect()
    assert (r.gaps, r.cost, r.audit) == (None, 0, "KK")


def test_a_long_conversation_is_repaired_whole(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.", None) for i in range(1500) if i != 700]
    (r,) = conversations.repair(spark.createDataFrame(rows, TURNS)).collect()
    assert (r.gaps, r.illegal, r.cost) == (1, 1, 2)
    assert len(r.repaired) == 1500 and r.repaired[700] == ("user", "")


def test_a_conversation_takes_one_shuffle(spark, stored):
    plan = conversations.digests(stored([(1, 1, "user", "Hi.", "x")], TURNS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Python" not in plan and "Arrow" not in plan


# --- periodic runs -----------------------------------------------------------------------------------------------------


def runs_by_definition(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and not any(all(words[k] == words[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_texts(rnd, n):
    out = []
    for _ in range(n):
        words = [f"w{rnd.randrange(rnd.choice([1, 2, 3, 30]))}" for _ in range(rnd.randrange(60))]
        part = words[: rnd.randrange(1, 9)]
        out.append(" ".join(words[: rnd.randrange(len(words) + 1)] + part * rnd.randrange(1, 9) + part[:1] + words[rnd.randrange(len(words) + 1) :]))
    return out


@pytest.mark.parametrize("together", [1, 64, 1 << 19])
def test_runs_match_their_definition(together, monkeypatch):
    monkeypatch.setattr(periodic, "TOGETHER", together)
    monkeypatch.setattr(periodic, "PLACES", together // 8)
    texts = some_texts(random.Random(6), 150)
    for t, (runs, left) in zip(texts, periodic.several(texts), strict=True):
        want = runs_by_definition(t.split())
        assert [tuple(r) for r in runs.tolist()] == want
        gone = {k for s, size, q in want for k in range(s + q, s + size)}
        assert left == " ".join(w for k, w in enumerate(t.split()) if k not in gone)


def digest(doc_id, text):
    words = [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").split()]
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(words)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_of_runs_by_brute_force(spark, stored):
    rnd = random.Random(7)
    rows = [(i, t, "x") for i, t in enumerate(some_texts(rnd, 200))]
    rows += [(900, None, None), (901, "", None), (902, " \t\n\x0b\f\r ", None), (None, "a a a a a a b", None), (903, "a a a\x1ca " * 40, None), rows[3], rows[3], (904, "aé ☃ " * 4000, None), (905, "one", None)]
    rows += [(i, None if i % 2 else " ", None) for i in range(5000, 5040)]
    docs = stored(rows, "doc_id long, text string, runs string")
    made = periodic.digests(docs)
    assert made.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted((digest(i, t) for i, t, _ in rows), key=repr)
    assert periodic.digests(docs.limit(0)).collect() == []
    assert periodic.find_runs(docs).columns == ["doc_id", "runs", "collapsed"]


# --- main text ---------------------------------------------------------------------------------------------------------

PROSE = "The river ran over the stones, past the mill, and down to the sea."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>Title</h1><p>{PROSE}</p><p>Short.</p></article><footer>&copy; us</footer>", f"Title\n{PROSE}\nShort."),
        (f"<header><h1>Site</h1></header><div id='content'><h2>Title</h2><p>{PROSE}<p>{PROSE} Again.</div><div class='sidebar'><p>{PROSE} Not this.</p></div>", f"Title\n{PROSE}\n{PROSE} Again."),
        (f"<main><p>{PROSE}</p></main><section id='comments'><article class='comment'><p>{PROSE * 4}</p></article></section>", PROSE),
        (f"<div class='cookie-notice'>{PROSE * 3}</div><article><p>{PROSE}</p><aside>{PROSE}</aside><form><p>Your name</p></form></article>", PROSE),
        (f"<article><p><b>{PROSE}<br><p>a &lt; b &amp;amp c &eacute;</p><!-- <p>no</p> --></article>", f"{PROSE}\na < b &amp c é"),
        (f"<article><p>  two \n\t words&nbsp;here </p><pre>x\n  y</pre><table><tr><td>1<td>2<tr><td>3</table>{PROSE}</article>", f"two words here\nx y\n1 2\n3\n{PROSE}"),
        (f"<div class='wrap'><section><p>{PROSE * 5}</p></section><section><p>{PROSE}</p></section></div><div class='ad'>{PROSE * 9}</div>", f"{PROSE * 5}\n{PROSE}"),
        (f"<form id='page'><div><article><p>{PROSE}</p></article><input value='x'><label>Name</label></div></form>", PROSE),
        (f"<article><p>{PROSE}</p><ul><li><a href='/1'>One more</a><li><a href='/2'>Two more</a><li><a href='/3'>Three more</a></ul><ul><li>kept</ul></article>", f"{PROSE}\nkept"),
        (f"<div hidden><p>{PROSE}</p></div><p style='display: none'>{PROSE}</p><div class='content with-sidebar'><p>{PROSE} Here.</p></div>", f"{PROSE} Here."),
    ],
)
def test_main_text(body, want):
    assert html.main_text(page(body)) == want


def test_pages_as_a_table(spark, stored):
    rows = [(1, "u", page(f"<article><p>{PROSE} 😀</p></article>"), "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "no tags &amp; none", "x"), (5, "u", "<p>cut <b", "x"), (6, "u", "<nav>only</nav>", "x"), (None, "u", page("<p>null id</p>"), "x")]
    rows += [rows[0], (7, "u", page(f"<article>{'<p>' + PROSE + '</p>'}{'<p>again and again</p>' * 5000}</article>"), "x"), (8, "u", "<div>" * 5000 + "deep", "x"), (9, "u", "<a href='" * 3000, "x")]
    pages = stored(rows, "page_id long, url string, html string, n_chars string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert html.extract(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert html.extract(pages).count() == len(rows)
    want = {1: f"{PROSE} 😀", 2: "", 3: "", 4: "no tags & none", 5: "cut", 6: "", None: "null id", 7: "\n".join([PROSE] + ["again and again"] * 5000), 8: "deep", 9: ""}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract(pages.limit(0)).collect() == []


def test_wrong_pages_take_time_in_proportion(spark):
    for wrong in ("<b>" * 30000 + "</i>" * 30000, "<!--" * 30000, "<a x=\"" * 30000, "</script" * 30000, "<ul><li>x" * 20000, "<p>" * 30000):
        html.main_text(wrong)


def test_anchors_without_a_target_are_no_links():
    menu = "<div><ul><li><a href='/1'>Home page of all</a><li><a href='/2'>News of the day</a><li><a href='/3'>Other things</a></ul></div>"
    told = [f"Paragraph {i} tells a long story, with rivers, hills, and many trees, as it goes on." for i in range(4)]
    marked = "".join(f"<p><a name=s{i} data-href='x'>{t}</a></p>" for i, t in enumerate(told))
    assert html.main_text(page(f"{menu}<div>{marked}</div>")) == "\n".join(told)
    assert html.main_text(page(f"<div>{menu}<p>{told[0]}</p><p>{told[1]}</p></div>")) == "\n".join(told[:2])


LONG = " ".join([PROSE] * 6)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<ul><li>one<li>two</ul><p>three</p>", "one\ntwo\nthree"),
        (f"<div><div><div><p>{LONG}</p></div></div></div><div><div><div>Few words.</div></div></div>", f"{LONG}\nFew words."),
        (f"<article><p>{PROSE}</p></article><blockquote>{PROSE}</blockquote><div>{LONG}</div><div>Site name</div>", f"{PROSE}\n{PROSE}\n{LONG}"),
        (f"<article><h2 id='social-impact'>Social impact</h2><p>Let <math><mi>x</mi></math> be.</p></article>", "Social impact\nLet x be."),
        (f"<div class='container right-sidebar'><h1>Title</h1><p>{PROSE}</p></div>", f"Title\n{PROSE}"),
        (f"<article><p>{PROSE}</p><table>{'<tr><td><a href=/1>Smith</a><td>4' * 3}</table></article>", "\n".join([PROSE] + ["Smith 4"] * 3)),
        (f"<nav>menu{'<b>' * 600}</nav><article><p>{PROSE}</p></article>", PROSE),
        (f"<main><p>{PROSE}</p></main><section id=comments><h1>Replies</h1><article><p>{LONG}</p></article></section><div class=ad><p>{LONG}</p></div>", PROSE),
    ],
)
def test_nothing_else_is_dropped(body, want):
    assert html.main_text(page(body)) == want


def test_points_are_given():
    root = html.tree(page(f"<div><p>{LONG}</p></div><div><p>{PROSE}</p></div>"))
    elements = html.pruned(root)
    html.score(elements)
    assert [round(e.points) for e in elements if e.name == "div"] == [16, 4]
    assert html.main_text(page(f"<article><p>{PROSE}</p></article><div>{LONG}</div><div>{PROSE}</div>")) == f"{PROSE}\n{LONG}"
