"""Chat formatting by quotation linking: quotes are parsed, hashed, joined to what they quote, and taken out.

A line's quote level is the number of ">" that it begins with. Runs of lines of one level are passages; level 0 is the
message's own text, less attribution lines ("On ... wrote:") right before a quote. Passages, their paragraphs and lines are
normalised (A-Z lower-cased, white space as one space) and hashed, and so are the own text, paragraphs and lines of messages.
A quote is linked to the latest earlier message of its conversation that has the same unit. The parent of a message is the
one that its longest linked unit of level 1 comes from, else the message before it; so parents precede their replies, and
the order of turns is a reply order, in which ``position`` numbers each conversation.

"The latest before" is found without pairs: units as written and as quoted meet by (conversation, hash, range of turns),
a window finds the latest inside the range, and a second one over the few ranges carries what came before. A conversation
or line that holds a third of all rows is as many groups as it has ranges of turns. Everything is DataFrame functions.

Defined cases: a null text is empty; a null role is kept; rows with a null conversation or turn have no parent and no
position; rows with one conversation and turn are siblings, ordered by role and text; an empty table gives no rows; other
columns are ignored; whole messages are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns in a range.
RANGE = 256
_QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Between paragraphs.
_BLANK = r"\n[ \t]*\n"
_SPACE = r"[ \t\n\r\x0B\f]+"


def normal(column: Column) -> Column:
    """A-Z lower-cased, each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(column, _UPPER, _UPPER.lower()), _SPACE, " "))


def _stripped(column: Column) -> Column:
    return F.regexp_replace(column, r"^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$", "")


def parsed(column: Column) -> Column:
    """array<struct<level, body>> of a text's lines."""

    def line(x: Column) -> Column:
        level = F.length(F.translate(F.regexp_extract(x, _QUOTE, 1), " \t", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(x, _QUOTE, "")).otherwise(x).alias("body"))

    return F.transform(F.split(F.translate(F.coalesce(column, F.lit("")), "\x01\x02\r", ""), "\n"), line)


def own_text(lines: Column) -> Column:
    """The lines of level 0 less attributions, without white space at the ends."""

    def own(x: Column, i: Column) -> Column:
        follows = F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))
        return (x["level"] == 0) & ~(follows & x["body"].rlike(r"(?i)^on .*wrote:[ \t]*$"))

    return _stripped(F.array_join(F.transform(F.filter(lines, own), lambda x: x["body"]), "\n"))


def passages(lines: Column) -> Column:
    """array<struct<level, text>> of the runs of lines of one level above 0."""

    def piece(x: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(lines, i - 1)["level"] == x["level"])
        return F.concat(F.when(same, F.lit("\n")).otherwise(F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"))), x["body"])

    runs = F.slice(F.split(F.array_join(F.transform(lines, piece), ""), "\x01"), 2, 1_000_000_000)
    each = F.transform(runs, lambda r: F.struct(F.substring_index(r, "\x02", 1).cast("int").alias("level"), F.substring_index(r, "\x02", -1).alias("text")))
    return F.filter(each, lambda p: p["level"] > 0)


def _units(*texts: Column) -> Column:
    """Distinct normalised texts that are not empty."""
    return F.array_distinct(F.filter(F.transform(F.concat(*texts), normal), lambda u: u != ""))


def _latest_before(written: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` rows (keys, turn, ...) and ``found``: the largest earlier turn of ``written`` (keys, turn) of the same keys."""
    extra = [c for c in asked.columns if c not in (*keys, "turn")]
    payload = F.struct(*extra) if extra else F.struct(F.lit(0).alias("_none"))
    kind = dict(asked.select(payload.alias("p")).dtypes)["p"]
    seen = written.select(*keys, "turn").distinct().select(*keys, "turn", F.lit(None).cast(kind).alias("p"), F.lit(False).alias("asks"))
    events = seen.unionByName(asked.select(*keys, "turn", payload.alias("p"), F.lit(True).alias("asks"))).withColumn("part", F.floor(F.col("turn") / RANGE))
    inside = Window.partitionBy(*keys, "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max(F.when(~F.col("asks"), F.col("turn"))).over(inside)).filter("asks")
    parts = events.groupBy(*keys, "part").agg(F.max(F.when(~F.col("asks"), F.col("turn"))).alias("last"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("carried", F.max("last").over(before)).select(*(F.col(k).alias(f"_{k}") for k in (*keys, "part")), "carried")
    joined = near.join(carried, [F.col(k) == F.col(f"_{k}") for k in (*keys, "part")], "left")
    return joined.select(*keys, "turn", *(F.col(f"p.{c}").alias(c) for c in extra), F.coalesce("near", "carried").alias("found"))


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per message: conv_id, turn, role, content, parent_turn, quoted, n_quotes, n_linked, position.

    ``quoted`` says that the parent was found by a quote; n_quotes counts passages, n_linked those with an original.
    """
    base = messages.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("mid", F.xxhash64("role", "text"))
    whole = base.filter("conv_id is not null and turn is not null")
    lines = whole.withColumn("lines", parsed(F.col("text")))

    # Units as they were written, and as they are quoted.
    content = lines.withColumn("content", own_text(F.col("lines")))
    paragraphs = F.split("content", _BLANK)
    asking = lines.filter(F.col("text").rlike(r"(?:^|\n)[ \t]*>")).select("conv_id", "turn", "mid", F.posexplode(passages(F.col("lines"))).alias("passage", "p"))
    quoted = asking.select("conv_id", "turn", "mid", "passage", F.col("p.level").alias("level"), F.explode(_units(F.array("p.text"), F.split("p.text", _BLANK), F.split("p.text", "\n"))).alias("unit"))
    asked = quoted.select("conv_id", F.xxhash64("unit").alias("h"), "turn", "mid", "passage", "level", F.length("unit").alias("size"))
    written = content.select("conv_id", "turn", F.explode(_units(F.array("content"), paragraphs, F.split("content", "\n"))).alias("unit")).select("conv_id", F.xxhash64("unit").alias("h"), "turn")
    wanted = asked.select("conv_id", "h").distinct()
    found = _latest_before(written.join(wanted, ["conv_id", "h"], "left_semi"), asked, ["conv_id", "h"])
    per_passage = found.groupBy("conv_id", "turn", "mid", "passage").agg(
        F.max(F.when((F.col("level") == 1) & F.col("found").isNotNull(), F.struct("size", "found"))).alias("best"), F.max(F.col("found").isNotNull()).alias("hit")
    )
    parents = per_passage.groupBy("conv_id", "turn", "mid").agg(F.max("best")["found"].alias("origin"), F.count_if("hit").alias("n_linked"))
    counted = asking.select("conv_id", "turn", "mid", "passage").distinct().groupBy("conv_id", "turn", "mid").agg(F.count("*").alias("n_quotes"))

    # The message before, and the place in the conversation.
    turns = whole.select("conv_id", "turn").distinct()
    previous = _latest_before(turns, turns, ["conv_id"]).withColumnRenamed("found", "previous")
    part = F.floor(F.col("turn") / RANGE)
    counts = whole.groupBy("conv_id", part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    placed = content.withColumn("part", part).withColumn("_n", F.row_number().over(inside)).join(bases, ["conv_id", "part"])

    made = placed.join(previous, ["conv_id", "turn"]).join(parents, ["conv_id", "turn", "mid"], "left").join(counted, ["conv_id", "turn", "mid"], "left")
    none = F.lit(0).cast("bigint")
    out = made.select(
        "conv_id",
        "turn",
        "role",
        "content",
        F.coalesce("origin", "previous").alias("parent_turn"),
        F.col("origin").isNotNull().alias("quoted"),
        F.coalesce("n_quotes", none).alias("n_quotes"),
        F.coalesce("n_linked", none).alias("n_linked"),
        (F.col("base") + F.col("_n") - 1).cast("bigint").alias("position"),
    )
    loose = base.filter("conv_id is null or turn is null").withColumn("lines", parsed(F.col("text")))
    rest = loose.select(
        "conv_id", "turn", "role", own_text(F.col("lines")).alias("content"), F.lit(None).cast("bigint").alias("parent_turn"), F.lit(False).alias("quoted"),
        F.size(passages(F.col("lines"))).cast("bigint").alias("n_quotes"), none.alias("n_linked"), F.lit(None).cast("bigint").alias("position"),
    )
    return out.unionByName(rest)


def formatted(linked: DataFrame, template: str = "<|{role}|>\n{content}\n") -> DataFrame:
    """``linked`` and ``chat``: each message in a chat template; ordered by (conv_id, position) they are conversations."""
    head, rest = template.split("{role}")
    middle, tail = rest.split("{content}")
    return linked.withColumn("chat", F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(middle), F.col("content"), F.lit(tail)))


#: The same for DuckDB, by plain joins of normalised units.
SQL = r"""
WITH
base AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text,
        row_number() OVER () AS m
    FROM conversations
), lines AS (
    SELECT m, conv_id, turn, i, regexp_extract(l, '^[ \t]*((?:>[ \t]?)+)', 1) AS prefix, l
    FROM (SELECT *, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS l, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS i FROM base)
), leveled AS (
    SELECT m, conv_id, turn, i, len(regexp_replace(prefix, '[ \t]', '', 'g')) AS level,
        CASE WHEN prefix <> '' THEN regexp_replace(l, '^[ \t]*((?:>[ \t]?)+)', '') ELSE l END AS body
    FROM lines
), marked AS (
    SELECT *, lead(level) OVER w AS following, CASE WHEN level = lag(level) OVER w THEN 0 ELSE 1 END AS begins
    FROM leveled WINDOW w AS (PARTITION BY m ORDER BY i)
), runs AS (
    SELECT *, sum(begins) OVER (PARTITION BY m ORDER BY i) AS run FROM marked
), contents AS (
    SELECT b.m, regexp_replace(coalesce(o.own, ''), '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g') AS content
    FROM base b LEFT JOIN (
        SELECT m, string_agg(body, chr(10) ORDER BY i) AS own FROM runs
        WHERE level = 0 AND NOT (coalesce(following, 0) > 0 AND regexp_matches(body, '^(?i:on .*wrote:)[ \t]*$')) GROUP BY m
    ) o USING (m)
), written AS (
    SELECT DISTINCT conv_id, turn, trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\x0B\f]+', ' ', 'g')) AS unit
    FROM (SELECT b.conv_id, b.turn, unnest(list_concat([content], regexp_split_to_array(content, '\n[ \t]*\n'), string_split(content, chr(10)))) AS u
        FROM base b JOIN contents USING (m))
), passages AS (
    SELECT m, conv_id, turn, run, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS p FROM runs WHERE level > 0 GROUP BY m, conv_id, turn, run
), asked AS (
    SELECT DISTINCT m, conv_id, turn, run, level, trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\x0B\f]+', ' ', 'g')) AS unit
    FROM (SELECT *, unnest(list_concat(list_concat([p], string_split(p, chr(10))), regexp_split_to_array(p, '\n[ \t]*\n'))) AS u FROM passages)
), found AS (
    SELECT a.m, a.run, a.level, len(a.unit) AS size, max(w.turn) AS origin
    FROM asked a JOIN written w ON w.conv_id = a.conv_id AND w.unit = a.unit AND w.turn < a.turn WHERE a.unit <> '' GROUP BY ALL
), parents AS (
    SELECT m, max({'size': size, 'origin': origin}) FILTER (level = 1) AS best, count(DISTINCT run) AS n_linked FROM found GROUP BY m
), counted AS (
    SELECT m, count(*) AS n_quotes FROM passages GROUP BY m
)
SELECT b.conv_id, b.turn, b.role, c.content,
    CASE WHEN b.conv_id IS NOT NULL AND b.turn IS NOT NULL THEN coalesce(p.best.origin, max(b.turn) OVER (PARTITION BY b.conv_id ORDER BY b.turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS parent_turn,
    p.best IS NOT NULL AS quoted, coalesce(q.n_quotes, 0) AS n_quotes, coalesce(p.n_linked, 0) AS n_linked,
    CASE WHEN b.conv_id IS NOT NULL AND b.turn IS NOT NULL
        THEN row_number() OVER (PARTITION BY b.conv_id ORDER BY b.turn NULLS LAST, b.role NULLS FIRST, b.text) - 1 END AS position
FROM base b JOIN contents c USING (m) LEFT JOIN parents p USING (m) LEFT JOIN counted q USING (m)
"""
