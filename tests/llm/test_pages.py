"""Main text of pages of several makes, of broken ones, and of those of the tables, whose articles a plain expression finds."""

import html
import os
import random
import re
import time

import pytest

from millrace.llm.pages import extract, main_text

DATA = "/root/testdata/sf0.001"
P1 = "The council said on Tuesday that it had agreed to the plan for the new bridge, which is to be built over the river by the end of the year, and that the work would start as soon as the money was there."
P2 = "It is not the first time that the town has tried to do this; in the past the cost was more than it could bear, and the people who live on the other side of the river were against it, as they had been for many years."
P3 = "Short but true."
DE = "Der Rat hat am Dienstag gesagt, dass er dem Plan für die neue Brücke zustimmt, die bis zum Ende des Jahres über den Fluss gebaut werden soll, und dass die Arbeit beginnt, wenn das Geld da ist, das es noch nicht gibt."


def page(body, head="<title>The title</title><style>p{}</style><script>if (a<b) document.write('<p>no</p>')</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/news'>News of the day</a></li><li><a href='/about'>About us and the rest</a></li></ul>"
TEXT = f"{P1}\n{P2}"


@pytest.mark.parametrize(
    "body, wanted",
    [
        (f"<nav>{MENU}</nav><article><h1>Bridge</h1><p>{P1}</p><p>{P2}</p></article><footer>&copy; 2020 Them</footer>", f"Bridge\n{TEXT}"),
        # No marks at all: the rules of blocks alone.
        (f"<div>{MENU}</div><h1>Bridge</h1><p>{P1}<p>{P2}<p>{P3}<p>{P1}<div>Home | Contact</div><div>&copy; 2020 Them and all of the others</div>", f"Bridge\n{TEXT}\n{P3}\n{P1}"),
        (f"<div id='header'><h2>The Daily</h2></div><div class='content'><h1>Brücke</h1><p>{DE}</p></div><div class='sidebar'><p>{P1}</p></div>", f"Brücke\n{DE}"),
        (f"<div class='cookie-banner'><p>{P2}</p></div><main><h1>Bridge</h1><p>{P1}</p></main><aside><p>{P2}</p></aside>", f"Bridge\n{P1}"),
        (f"<article><header><h1>Bridge</h1></header><p>{P1}</p><form><p>{P2}</p><input><button>Send</button></form><footer><p>{P2}</p></footer></article>", f"Bridge\n{P1}"),
        # Reader comments, by name and by heading.
        (f"<article><p>{P1}</p></article><section id='comments'><article class='comment'><p>{P2}</p></article></section>", P1),
        (f"<article><h1>Bridge</h1><p>{P1}</p><section><h2>3 Comments</h2><div><p>{P2}</p></div></section><p>{P3}</p></article>", f"Bridge\n{P1}\n{P3}"),
        (f"<h1>Bridge</h1><p>{P1}</p><h3>Leave a comment</h3><p>{P2}</p>", f"Bridge\n{P1}"),
        # Adverts and things that are not shown inside of an article.
        (f"<article><p>{P1}</p><div class='ad-slot'>Buy it now, the best there is.</div><p hidden>{P2}</p><p style='display: none'>{P2}</p><p>{P3}</p></article>", f"{P1}\n{P3}"),
        (f"<article><p>{P1}</p><ul class='x'><li><a href='a'>Share it</a></li><li><a href='b'>Tell them</a></li></ul><p>See <a href='c'>the report</a>.</p></article>", f"{P1}\nSee the report."),
        # A name that would leave nothing is wrong.
        (f"<div class='menu-open widget'><p>{P1}</p></div>", P1),
        # White space, references, line breaks, what is inside of lines.
        ("<article><p>a &amp;amp; b&nbsp;&#233;\n\t c<br>d<b>e</b>f <script>x</script>g<!-- <p> --></p><p> </p><pre>h\n  i</pre></article>", "a &amp; b é c def g\nh i"),
        (f"<article><p><b>{P1}<br><p>{P2}</article>", TEXT),
        (f"<article><table><tr><td>{P1}<td>{P3}</table><dl><dt>One<dd>Two</dl></article>", f"{P1}\n{P3}\nOne\nTwo"),
        # A language without known words.
        ("<div>Zzz</div><p>" + "Кот сидел на окне и смотрел на улицу. " * 8 + "</p>", ("Кот сидел на окне и смотрел на улицу. " * 8).strip()),
        ("", ""),
        (MENU, ""),
    ],
)
def test_pages_of_several_makes(body, wanted):
    got = main_text(page(body))
    assert got.removeprefix("Zzz\n") == wanted


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<!-- <p>no") == main_text("<p") == ""
    assert main_text("Just a text") == "Just a text"
    assert main_text("a < b & c > d") == "a < b & c > d"
    assert main_text("<p>x</p><script>never ends <p>y") == "x"
    assert main_text(f"<article><p title='a > b'>{P1}</p></article>") == P1
    assert main_text(f"</p></div><article></b><p>{P1}</i></article></article>") == P1


@pytest.mark.parametrize("piece", ["<", '<a "', "<a href='", "<div>x", "<!--", "<script>", "<p>x", "<b><p>", "&amp", "</", "<h2>x</b>"])
def test_hostile_pages_take_linear_time(piece):
    began = time.perf_counter()
    main_text(piece * 50_000)
    assert time.perf_counter() - began < 20


def test_a_row_per_page(spark):
    rows = [(1, "u", page(f"<p>{P1}</p>"), 1), (1, None, page(f"<p>{P2}</p>"), 2), (None, "v", None, 3), (2, "w", "", 4), (3, "x", "<p>" + "the word of " * 500_000, 5), (3, "x", "<p>é&#128512;", 6), (3, "x", "<p>é&#128512;", 6)]
    out = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in out) == sorted((str(i), str(u), main_text(h), len(main_text(h))) for i, u, h, _ in rows)
    assert sum(r.text == "é😀" and r.n_chars == 2 for r in out) == 2
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_words_survive_in_order(spark):
    """Articles built from random words come back whole, between all that isn't one."""
    rng = random.Random(3)
    for _ in range(40):
        parts = [" ".join(rng.choice(["the", "of", "and", "was", "zorb", "flim", "é", "x&y", "<z>"]) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 12))]
        body = "".join(f"<p>{html.escape(p)}" + rng.choice(["</p>", ""]) for p in parts)
        assert main_text(page(f"<nav>{MENU}</nav><div class=ad>{P1}</div><article>{body}</article><footer>{P2}</footer>")) == "\n".join(parts)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pages_of_the_tables(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", r.html, re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article))
        assert main_text(r.html) == "\n".join(p for p in parts if p)
