"""Repair of the structure of conversations: the cheapest edits that leave an optional system turn, then user and assistant by turns.

A fault is the first of these that holds for a turn: ``blank`` (nothing but white space), ``duplicate`` (role and text were
there before) or ``truncated`` (the last character that is no white space is none of ``.!?``). Edits are Keep, Rerole (to user
or assistant), Delete and Insert (an empty user or assistant turn); blank and duplicate turns must be deleted, truncated ones
cost more if they stay. Of the cheapest edits those are taken whose initials, in order, come first in ASCII.

The fold is Spark SQL's own ``aggregate`` over sorted structs of turns. It carries four pairs of (cost, audit), one for each
state that repaired turns can be in: nothing yet, a system turn, a user turn, an assistant turn; each step is a ``least`` of
the pairs that lead to a state. Two audits of one cost and state are never the beginning of one another, as more of the
inserted turns would cost more; so the least of each state is all that a later turn needs to know.

A long conversation is no single fold. Its turns fall into ranges of ``SPAN`` turn numbers, these into chunks of as many rows;
flags come from windows over ranges, each chunk is folded from each of the four states, and a second fold over the chunks of a
conversation picks the states between them. When a text of a conversation was said first is an aggregate that is summed up
in the map tasks and joined, so that a text that is said often is no group in one task. The repaired conversation is one
value, as its hash is; that is the bound on a conversation: what a cell of Spark holds (2 GB).

Defined cases: a null role or text is one space; null turns come first; a null id is a conversation; turns of one number come by
role, then text; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of a range, a power of two as bits, and rows of a chunk.
SPAN_BITS = 8
SPAN = 1 << SPAN_BITS
#: States: nothing yet, system, user, assistant.
STATES = "esua"
DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5
#: More than any edits cost.
NEVER = 1 << 50
_WHITE = "\t\n\x0b\x0c\r "


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a fault in about a quarter of the turns, told by a checksum of id and turn: dropped,
    emptied, without ends of sentences, said twice, or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("_k"))
    k = F.col("_k")
    return turns.filter(k != 0).select(
        "conv_id",
        "turn",
        F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _pair(cost: Column | int, audit: Column | str) -> Column:
    return F.struct((cost if isinstance(cost, Column) else F.lit(cost)).cast("bigint").alias("cost"), (audit if isinstance(audit, Column) else F.lit(audit)).alias("audit"))


def _vector(**states: Column) -> Column:
    """The pairs of all states, in their order; those not given can't be."""
    return F.array(*(states.get(s, _pair(NEVER, "")) for s in STATES))


def _more(pair: Column, cost: Column | int, initial: Column | str) -> Column:
    return _pair(pair["cost"] + cost, F.concat(pair["audit"], initial if isinstance(initial, Column) else F.lit(initial)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _inserted(e: Column, s: Column, u: Column, a: Column) -> Column:
    """The pairs once turns may be inserted: one leads to a user or an assistant turn, a second one from a user to an assistant."""
    user = F.least(u, *(_more(x, INSERT, "I") for x in (e, s, a)))
    return _let(user, lambda user: _vector(e=e, s=s, u=user, a=F.least(a, _more(user, INSERT, "I"))))


def _step(v: Column, row: Column) -> Column:
    pair = dict(zip(STATES, (v[i] for i in range(4))))
    gone = {x: _more(pair[x], DELETE, "D") for x in STATES}
    to = lambda role, before: _more(pair[before], row[f"{role}_cost"], row[f"{role}_edit"])
    return _inserted(
        gone["e"],
        F.least(gone["s"], _more(pair["e"], row["s_cost"], "K")),
        F.least(gone["u"], *(to("u", x) for x in "esa")),
        F.least(gone["a"], to("a", "u")),
    )


def _flagged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with range, place in it, fault, and how each stands to the one before."""
    said = F.sha2(F.concat("role", F.lit("\0"), "text"), 256)
    keyed = turns.withColumn("said", said)
    firsts = keyed.groupBy(F.col("conv_id").alias("of"), F.col("said").alias("what")).agg(F.min(F.struct("turn")).alias("first"))
    known = keyed.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("what"))).select("conv_id", "turn", "role", "text", "first", F.shiftright("turn", SPAN_BITS).alias("range"))
    inside = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before, own = F.lag(F.struct("turn", "role", "text")).over(inside), F.struct("turn", "role", "text")
    initial = F.left("role", F.lit(1))
    end = F.rtrim("text", F.lit(_WHITE))
    marked = known.withColumns({"at": F.row_number().over(inside) - 1, "before": before, "end": end, "initial": initial})
    old = ~F.col("turn").eqNullSafe(F.col("first.turn")) | F.col("before").eqNullSafe(own)
    fault = F.when(F.col("end") == "", "blank").when(old, "duplicate").when(~F.right("end", F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none")
    met = F.concat(F.left("before.role", F.lit(1)), "initial")
    return marked.select(
        "conv_id",
        "range",
        F.shiftright("at", SPAN_BITS).alias("chunk"),
        "at",
        "turn",
        "role",
        "text",
        "initial",
        fault.alias("fault"),
        (F.col("before").isNotNull() & ~met.isin("su", "ua", "au")).alias("odd"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before.turn"))).alias("new"),
    )


def _folded(flagged: DataFrame) -> DataFrame:
    """A row per chunk: its rows in order, counts, and the pairs of all states ``after`` it, by the state before it."""
    stays = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(NEVER)).when(F.col("fault") == "truncated", F.lit(CUT)).otherwise(F.lit(0)).cast("bigint")
    costs = [F.when(F.col("initial") == "s", stays).otherwise(F.lit(NEVER)).alias("s_cost")]
    for x in "ua":
        own = F.col("initial") == x
        costs += [(stays + F.when(own, 0).otherwise(REROLE)).alias(f"{x}_cost"), F.when(own, "K").otherwise("R").alias(f"{x}_edit")]
    chunks = flagged.groupBy("conv_id", "range", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("at", *costs, "role", "text"))).alias("rows"),
        *(F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")),
        F.count_if("odd").alias("odd"),
        F.count_if("new").alias("turns"),
        F.min("turn").alias("least"),
        F.max("turn").alias("most"),
        F.min_by("initial", "at").alias("opens"),
        F.max_by("initial", "at").alias("closes"),
    )
    begins = F.array(*(_vector(**{x: _pair(0, "")}) for x in STATES))
    return chunks.withColumn("after", F.transform(begins, lambda begin: F.aggregate("rows", begin, _step)))


def _between(v: Column, chunk: Column) -> Column:
    """Pairs after a chunk, each with the numbers of the states at which chunks begin."""

    def through(s: Column, e: Column) -> Column:
        a, b = v[s], chunk["after"][s][e]
        return F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"), F.concat(a["path"], s.cast("string")).alias("path"))

    numbers = F.array(*map(F.lit, range(4)))
    return F.transform(numbers, lambda e: F.array_min(F.transform(numbers, lambda s: through(s, e))))


def _rendered(chunk: Column, start: Column, audit: Column) -> Column:
    """The turns that a chunk's audit leaves, from a state on."""
    begin = F.struct(F.lit(0).alias("i"), F.substring(F.lit(STATES), start + 1, F.lit(1)).alias("last"), F.array().cast("array<struct<role:string,text:string>>").alias("out"))

    def put(state: Column, c: Column) -> Column:
        row = F.get(chunk["rows"], state["i"])
        role = F.when(c == "K", row["role"]).when(state["last"] == "u", "assistant").otherwise("user")
        made = F.struct(role.alias("role"), F.when(c == "I", "").otherwise(row["text"]).alias("text"))
        gone = c == "D"
        return F.struct(
            (state["i"] + F.when(c == "I", 0).otherwise(1)).alias("i"),
            F.when(gone, state["last"]).otherwise(F.left(role, F.lit(1))).alias("last"),
            F.when(gone, state["out"]).otherwise(F.concat(state["out"], F.array(made))).alias("out"),
        )

    return F.aggregate(F.when(audit == "", F.array().cast("array<string>")).otherwise(F.split(audit, "")), begin, put, lambda state: state["out"])


def repair(conversations: DataFrame) -> DataFrame:
    """A row per conversation of (conv_id, turn, role, text): conv_id, gaps (turn numbers that are missing), blank, duplicate and
    truncated (turns by first fault), illegal (neighbours that may not follow each other), cost and audit of the cheapest edits,
    and ``repaired``, the turns that they leave."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    turns = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), space("role"), space("text"))
    chunks = _folded(_flagged(turns))
    parts = ("range", "chunk", "opens", "closes", "rows", "after")
    whole = chunks.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(*parts))).alias("chunks"),
        *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "odd", "turns")),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )
    first = lambda cost, audit: F.struct(F.lit(cost).cast("bigint").alias("cost"), F.lit(audit).alias("audit"), F.lit("").alias("path"))
    begin = F.array(first(0, ""), first(NEVER, ""), first(INSERT, "I"), first(2 * INSERT, "II"))
    found = F.aggregate("chunks", begin, _between)
    end = lambda i: F.struct(F.col("_all")[i]["cost"].alias("cost"), F.col("_all")[i]["audit"].alias("audit"), F.concat(F.col("_all")[i]["path"], F.lit(str(i))).alias("path"))
    # Pairs of neighbours in different ranges; those inside a range are counted there.
    c = F.col("chunks")
    across = F.filter(F.sequence(F.lit(1), F.size(c)), lambda i: (i > 1) & (F.get(c, i - 1)["chunk"] == 0) & ~F.concat(F.get(c, i - 2)["closes"], F.get(c, i - 1)["opens"]).isin("su", "ua", "au"))
    state = lambda i: F.substring("_best.path", i + 1, F.lit(1)).cast("int")
    turn = lambda role: F.struct(F.lit(role).alias("role"), F.lit("").alias("text"))
    before = F.slice(F.array(turn("user"), turn("assistant")), F.lit(1), F.greatest(state(F.lit(0)) - 1, F.lit(0)))
    after = F.flatten(F.transform(c, lambda chunk, i: _rendered(chunk, state(i), chunk["after"][state(i)][state(i + 1)]["audit"])))
    return (
        whole.withColumn("_all", found)
        .withColumn("_best", F.least(end(0), end(3)))
        .select(
            "conv_id",
            F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("bigint").alias("gaps"),
            "blank",
            "duplicate",
            "truncated",
            (F.col("odd") + F.size(across)).cast("bigint").alias("illegal"),
            F.col("_best.cost").alias("cost"),
            F.col("_best.audit").alias("audit"),
            F.concat(before, after).alias("repaired"),
        )
    )


def report(conversations: DataFrame) -> DataFrame:
    """Each conversation's damaged turns, repaired: the figures of ``repair``, and a hash of the repaired turns in place of them.
    A conversation that loses all turns has zeros, an empty audit and the hash of an empty text."""
    fixed = repair(damage(conversations))
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    joined = ids.join(fixed, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    counts = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(lines, F.lit("")), 256).alias("repaired_sha256"))


_CRC = """xor(4294967295, list_reduce(flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
        lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END, CAST(4294967295 AS BIGINT)))"""


def _sql() -> str:
    """The same by a recursive query, a turn of each conversation at a time, with the repaired text beside each pair."""

    def more(before: str, cost: str, initial: str, line: str | None) -> str:
        text = f"{before}.t" if line is None else f"{before}.t || CASE WHEN {before}.t = '' THEN '' ELSE chr(10) END || {line}"
        return f"{{'c': {before}.c + {cost}, 'a': {before}.a || {initial}, 't': {text}}}"

    def to(role: str, letter: str, before: str) -> str:
        own = f"initial = '{letter}'"
        return more(before, f"stays + CASE WHEN {own} THEN 0 ELSE 1 END", f"CASE WHEN {own} THEN 'K' ELSE 'R' END", f"(CASE WHEN {own} THEN role ELSE '{role}' END || ':' || text)")

    gone = {x: more(f"p.{x}", "2", "'D'", None) for x in STATES}
    never = 10**9
    empty, none = "{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}", f"{{'c': CAST({never} AS BIGINT), 'a': '', 't': ''}}"
    inserted = lambda x, role: more(x, "5", "'I'", f"'{role}:'")
    return rf"""
WITH RECURSIVE c AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS k FROM conversations
), d AS (
    SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(0, CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE k <> 0
), o AS (
    SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, role, text, substr(role, 1, 1) AS initial,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d
), f AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
        lag(initial) OVER (PARTITION BY g ORDER BY i) AS last FROM o
), r AS (
    SELECT *, CASE fault WHEN 'blank' THEN {never} WHEN 'duplicate' THEN {never} WHEN 'truncated' THEN 5 ELSE 0 END AS stays FROM f
), dp AS (
    SELECT g, CAST(0 AS BIGINT) AS i, {empty} AS e, {none} AS s, {{'c': CAST(5 AS BIGINT), 'a': 'I', 't': 'user:'}} AS u,
        {{'c': CAST(10 AS BIGINT), 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS a FROM (SELECT DISTINCT g FROM r)
    UNION ALL
    SELECT g, i, e, s, u, list_min([a, {inserted('u', 'assistant')}]) AS a FROM (
        SELECT g, i, e, s, list_min([u, {inserted('e', 'user')}, {inserted('s', 'user')}, {inserted('a', 'user')}]) AS u, a FROM (
            SELECT r.g, r.i, {gone['e']} AS e,
                list_min([{gone['s']}, {more('p.e', f"CASE WHEN initial = 's' THEN stays ELSE {never} END", "'K'", "(role || ':' || text)")}]) AS s,
                list_min([{gone['u']}, {to('user', 'u', 'p.e')}, {to('user', 'u', 'p.s')}, {to('user', 'u', 'p.a')}]) AS u,
                list_min([{gone['a']}, {to('assistant', 'a', 'p.u')}]) AS a
            FROM dp p JOIN r ON r.g = p.g AND r.i = p.i + 1
        )
    )
), best AS (
    SELECT g, list_min([e, a]) AS b FROM dp QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1
), totals AS (
    SELECT g, any_value(conv_id) AS conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (last IS NOT NULL AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM r GROUP BY g
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN (totals JOIN best USING (g)) ON ids.conv_id IS NOT DISTINCT FROM totals.conv_id
"""


SQL = _sql()
