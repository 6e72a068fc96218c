import duckdb

from millrace.llm import chat
from tests.llm.data import clashing, frame

KIND = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "user", "Hello there.\nHow are you?\n\nSecond paragraph\nof two lines"),
    (1, 1, "bot", "On Monday X wrote:\n> Hello there.\n> How are you?\n\nFine."),
    (1, 2, "user", ">> hello  THERE.\n>> how are you?\n> Fine.\nGood!"),
    (1, 3, "bot", "> second paragraph\n> of two lines\nyes"),
    (1, 4, "user", "> nothing of the kind\nwhat"),
    (1, 4, "user", "> Good!\ntwin"),
    (2, 0, "user", None),
    (2, 1, None, "> > deep\n>x"),
    (None, 1, "user", "> a\nb"),
    (2, None, "user", "c"),
    (3, 5, "a", " > x\n\n\n  own \n"),
    (3, 700, "b", "> own\nreply"),
    (3, 1000, "c", "> reply\n> own\n> reply\nlate"),
    (3, 1000, "c", "> reply\n> own\n> reply\nlate"),
    (4, 1, "a", ""),
]


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = con.sql(chat.SQL)
    return found.columns, sorted(map(repr, found.fetchall()))


def test_links_contents_and_order(spark):
    out = chat.link(clashing(frame(spark, ROWS, KIND)))
    rows = {(r.conv_id, r.turn, r.content): r for r in out.collect()}
    assert rows[1, 1, "Fine."].parent_turn == 0 and rows[1, 1, "Fine."].quoted
    assert (rows[1, 2, "Good!"].parent_turn, rows[1, 2, "Good!"].n_quotes, rows[1, 2, "Good!"].n_linked) == (1, 2, 2)
    assert rows[1, 3, "yes"].parent_turn == 0 and rows[1, 4, "what"].parent_turn == 3 and not rows[1, 4, "what"].quoted and rows[1, 4, "twin"].parent_turn == 2
    assert rows[3, 1000, "late"].parent_turn == 700 and rows[3, 700, "reply"].parent_turn == 5
    assert rows[None, 1, "b"].position is None and rows[2, None, "c"].parent_turn is None
    assert sorted(r.position for r in rows.values() if r.conv_id == 1) == list(range(6))


def test_equals_sql(spark):
    out = chat.link(frame(spark, ROWS, KIND))
    columns, wanted = by_sql(ROWS)
    assert out.columns == columns and sorted(repr(tuple(r)) for r in out.collect()) == wanted


def test_a_long_conversation_with_one_common_line_equals_sql(spark):
    rows = [(9, i * 3, "u", ("> thanks\nthanks" if i % 2 else "thanks") + ("" if i % 7 else f"\n\nnote {i}\n> note {i - 7}")) for i in range(400)]
    assert sorted(repr(tuple(r)) for r in chat.link(frame(spark, rows, KIND)).collect()) == by_sql(rows)[1]


def test_nothing_and_format(spark):
    assert chat.link(frame(spark, [], KIND)).count() == 0
    row = chat.formatted(chat.link(frame(spark, ROWS[:1], KIND))).first()
    assert row.chat.startswith("<|user|>\nHello there.")


def test_a_quote_of_wrapped_paragraphs_is_linked(spark):
    text = "one paragraph\n\nthe second one is long enough to wrap\n\nand a third one, too"
    rows = [(1, 0, "a", text), (1, 1, "b", "other"), (1, 2, "c", "> the second one is long\n> enough to wrap\n>\n> and a\n> third one, too\nyes")]
    out = chat.link(frame(spark, rows, KIND))
    assert {r.turn: r.parent_turn for r in out.collect()} == {0: None, 1: 0, 2: 0}
    assert sorted(repr(tuple(r)) for r in out.collect()) == by_sql(rows)[1]


def test_very_long_messages_and_repeated_rows_equal_sql(spark):
    long = "\n".join(f"line {i} of a long message" for i in range(5_000))
    rows = [(1, 0, "a", long), (1, 0, "a", long), (1, 1, "b", "> line 4999 of a long message\nyes"), (1, 2, "c", "\n".join(f"> {x}" for x in long.split("\n")) + "\nno")]
    assert sorted(repr(tuple(r)) for r in chat.link(frame(spark, rows, KIND)).collect()) == by_sql(rows)[1]
