"""Cheapest repair of conversations whose turns are blank, repeated, cut short or out of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that a blank text holds at most.
SPACES = " \t\n\x0b\f\r"
ENDS = (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Cost of what is not allowed: more than any conversation's repair.
NEVER = 1 << 40
ROLES = {"u": "user", "a": "assistant"}


def whole(n: int) -> Column:
    return F.lit(n).cast("long")


def faults(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) with `seen` (how often role and text have come) and `fault`, its first one or null."""
    said = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    rows = turns.withColumn("seen", F.row_number().over(said)).withColumn("last", last)
    fault = F.when(F.col("last") == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.col("last").isin(*ENDS), "truncated")
    return rows.withColumn("fault", fault).drop("last")


def cheapest(turns: Column) -> Column:
    """The least (cost, audit) that turns an array of (turn, role, text, seen, fault) into `(s?(ua)+)?`.

    aggregate() carries four such structs, one per end of what has been written: nothing, system, user, assistant. Of
    two audits of one cost that have used the same turns and end alike, none begins with the other (more insertions
    cost more), so that the smaller one stays smaller whatever follows.
    """

    def state(cost: Column, audit: Column) -> Column:
        return F.struct(cost.alias("cost"), audit.alias("audit"))

    def then(s: Column, cost: Column, letter: Column) -> Column:
        return state(s["cost"] + cost, F.concat(s["audit"], letter))

    def inserted(s: Column) -> Column:
        return then(s, whole(INSERT), F.lit("I"))

    def with_insertions(o: Column, s: Column, u: Column, a: Column) -> Column:
        u = F.least(u, inserted(o), inserted(s), inserted(a))
        return F.struct(o.alias("o"), s.alias("s"), u.alias("u"), F.least(a, inserted(u)).alias("a"))

    def step(acc: Column, mark: Column) -> Column:
        o, s, u, a = (acc[k] for k in "osua")
        base = F.when(mark["stays"], mark["cut"]).otherwise(whole(NEVER))

        def spoken(by: str) -> tuple[Column, Column]:
            own = mark["first"] == by
            return base + F.when(own, whole(KEEP)).otherwise(whole(REROLE)), F.when(own, "K").otherwise("R")

        gone = lambda x: then(x, whole(DELETE), F.lit("D"))
        system = base + F.when(mark["first"] == "s", whole(KEEP)).otherwise(whole(NEVER))
        by_user, by_assistant = spoken("u"), spoken("a")
        return with_insertions(
            gone(o), F.least(gone(s), then(o, system, F.lit("K"))), F.least(gone(u), *[then(x, *by_user) for x in (o, s, a)]), F.least(gone(a), then(u, *by_assistant))
        )

    fault = lambda t: F.coalesce(t["fault"], F.lit(""))
    marks = F.transform(turns, lambda t: F.struct(F.left(t["role"], F.lit(1)).alias("first"), (fault(t) == "truncated").cast("long").alias("cut"), (~fault(t).isin("blank", "duplicate")).alias("stays")))
    none, never = state(whole(0), F.lit("")), state(whole(NEVER), F.lit(""))
    start = F.struct(none.alias("o"), never.alias("s"), inserted(none).alias("u"), inserted(inserted(none)).alias("a"))
    return F.aggregate(marks, start, step, lambda acc: F.least(acc["o"], acc["a"]))


def mended(turns: Column, audit: Column) -> Column:
    """The (role, text) turns that the edits of `audit` leave of an array of turns; roles follow from their places."""

    def without(letter: str, upto: Column) -> Column:
        return F.length(F.translate(F.substring(audit, F.lit(1), upto), letter, ""))

    first = F.element_at(turns, F.least(F.length(F.regexp_extract(audit, "^D*", 0)) + 1, F.size(turns)))["role"]
    system = (audit.rlike("^D*K") & F.startswith(first, F.lit("s"))).cast("int")

    def line(i: Column) -> Column:
        letter, turn = F.substring(audit, i, F.lit(1)), F.get(turns, without("I", i) - 1)
        place = without("D", i) - system
        role = F.when(place % 2 == 1, ROLES["u"]).otherwise(ROLES["a"])
        return F.when(letter != "D", F.struct(F.when(letter == "K", turn["role"]).otherwise(role).alias("role"), F.when(letter == "I", "").otherwise(turn["text"]).alias("text")))

    lines = F.transform(F.sequence(F.lit(1), F.greatest(F.length(audit), F.lit(1))), line)
    return F.filter(lines, lambda x: x.isNotNull())


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Per conv_id of `turns` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    Turns are taken by number, null numbers first; those of one number by role and text. A null role or text counts as
    one space, so a null text is blank and a null role fits nowhere. `repaired` is an array of (role, text) structs of
    the cheapest edits, of which `audit` has the initials (Keep, Rerole, Delete, Insert; of several the least). Where
    `present` is false, a row only names its conversation: one without other rows has zeros, an empty audit and an
    empty array. A null conv_id is a conversation like others; repeated rows are duplicates; no rows give none; gaps
    too large for a long are null; other columns are not looked at.

    One shuffle by conversation serves the window and the fold. A conversation is one row, as its repaired text is;
    its audits are copied at each turn, so its time grows with the square of its turns (not of its text).
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], (F.lit(True) if present is None else present).alias("present"))
    told = faults(rows.repartition("conv_id"))
    here = F.col("present")
    number = F.when(here, F.col("turn"))
    collected = told.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(here, F.struct("turn", "role", "text", "seen", "fault")))).alias("turns"),
        *[F.count_if(here & (F.col("fault") == f)).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.max(number).alias("most"), F.min(number).alias("least"),
    )
    some = F.col("turns")
    distinct = F.size(F.array_distinct(F.filter(F.transform(some, lambda t: t["turn"]), lambda n: n.isNotNull()))).cast("long")
    gaps = F.when(F.col("most").isNull(), whole(0)).otherwise(F.try_add(F.try_subtract("most", "least"), whole(1) - distinct))
    first = F.transform(some, lambda t: F.left(t["role"], F.lit(1)))
    less = F.greatest(F.size(some) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(first, F.lit(1), less), F.slice(first, F.lit(2), less), lambda x, y: F.concat(x, y))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    best = collected.select("conv_id", "turns", gaps.alias("gaps"), "blank", "duplicate", "truncated", illegal.alias("illegal"), cheapest(some).alias("best"))
    empty = F.expr("cast(array() as array<struct<role string, text string>>)")
    fixed = F.when(F.col("best.audit") == "", empty).otherwise(mended(some, F.col("best.audit")))
    return best.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", fixed.alias("repaired"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of `conversations` with `present`, changed by crc32 of `conv_id:turn` modulo 20 as the query's contract says; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(kind == 0, F.array(F.lit(False))).when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.explode(copies).alias("present"))


def digests(conversations: DataFrame) -> DataFrame:
    """`repair` of the damaged conversations, with the digest of the repaired text in its place."""
    made = repair(damaged(conversations), F.col("present"))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return made.select(*[c for c in made.columns if c != "repaired"], F.sha2(lines, 256).alias("repaired_sha256"))


def oracle() -> str:
    """The same in DuckDB SQL: CRC-32 bit by bit, the edits by a recursive query that carries the repaired lines."""
    # One round of a byte's CRC: the byte is mixed in, then eight bits are shifted out (-1).
    bits = "list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])"
    crc = f"xor(list_reduce([4294967295::BIGINT] || flatten({bits}), lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295)"
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    put = lambda s, cost, letter, line: f"{{'c': {s}.c + {cost}, 'a': {s}.a || {letter}, 'r': list_concat({s}.r, {line})}}"
    gone = lambda s: put(s, "3", "'D'", "[]::VARCHAR[]")
    added = lambda s, role: put(s, "2", "'I'", f"['{role}:']")
    never = f"CASE WHEN stays THEN cut ELSE {NEVER} END"
    said = lambda s, role: put(s, f"{never} + CASE WHEN first = '{role[0]}' THEN 0 ELSE 2 END", f"CASE WHEN first = '{role[0]}' THEN 'K' ELSE 'R' END", f"[CASE WHEN first = '{role[0]}' THEN role ELSE '{role}' END || ':' || text]")
    system = put("o", f"{never} + CASE WHEN first = 's' THEN 0 ELSE {NEVER} END", "'K'", "[role || ':' || text]")
    none = "{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}"
    return f"""WITH RECURSIVE hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS k FROM conversations),
        harm AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM hit, (SELECT unnest([1, 2]) AS copy) WHERE k <> 0 AND (copy = 1 OR k = 3)),
        counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen, right(rtrim(text, {spaces}), 1) AS last FROM harm),
        told AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS first FROM counted),
        numbered AS (SELECT *, row_number() OVER w AS i, lag(first) OVER w AS earlier, (fault = 'truncated')::BIGINT AS cut, fault NOT IN ('blank', 'duplicate') AS stays
            FROM told WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
        fold AS (SELECT conv_id, 0::BIGINT AS i, {none} AS o, {{'c': {NEVER}::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS s, {{'c': 2::BIGINT, 'a': 'I', 'r': ['user:']}} AS u, {{'c': 4::BIGINT, 'a': 'II', 'r': ['user:', 'assistant:']}} AS a
                FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL SELECT conv_id, i, o, s, u, least(a, {added('u', 'assistant')}) AS a FROM (
                SELECT conv_id, i, o, s, a, least(u, {added('o', 'user')}, {added('s', 'user')}, {added('a', 'user')}) AS u FROM (
                    SELECT f.conv_id, n.i, {gone('o')} AS o, least({gone('s')}, {system}) AS s, least({gone('u')}, {said('o', 'user')}, {said('s', 'user')}, {said('a', 'user')}) AS u, least({gone('a')}, {said('u', 'assistant')}) AS a
                    FROM fold f JOIN numbered n ON n.conv_id IS NOT DISTINCT FROM f.conv_id AND n.i = f.i + 1))),
        ended AS (SELECT conv_id, least(o, a) AS best FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank')::BIGINT AS blank, count_if(fault = 'duplicate')::BIGINT AS duplicate,
            count_if(fault = 'truncated')::BIGINT AS truncated, count_if(i > 1 AND earlier || first NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM numbered GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
            best.c AS cost, best.a AS audit, sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
        FROM ended e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id"""
