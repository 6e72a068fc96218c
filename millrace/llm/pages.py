"""Main text of web pages, by block rules in two passes.

A page is read once into blocks: the text between the begins and ends of block elements, without markup, comments, scripts and
styles. Of each block the number of words, the share of words that are stop words, the share of characters inside links,
and the elements around it are known.

Blocks in elements that are no part of an article by their own name, role, class or id (menus, headers and footers of the page,
side bars, notices, adverts, forms, reader comments, what isn't shown) go in any case. If a page marks its article (``article``
or ``main``), blocks outside of it go as well, and those inside are doubtful at worst, unless they are made of links.

First pass, without context: a block of links, or one with a sign of copyright, is ``bad``; one under ``SHORT`` characters is
``short``; among longer ones many stop words make it ``good`` (``near`` where it is not long, or has fewer), few make it
``bad``. Where no block of a page has enough stop words, so that its language is none of those known, longer blocks are good
by length and links alone. Second pass: each ``near`` block between bad ones, and each ``short`` one, takes the label of the
nearest decided block on either side; a heading that of the next one; if both sides are as near and differ, or one has none, it
is kept inside of a marked article (outside, one side is enough). If nothing is decided, everything that isn't bad is kept.

Defined cases: a null or empty page, or one without an article, has an empty text; character references are decoded once, white
space inside a block becomes one space, blocks come in page order; broken markup is read as far as it goes (a tag, comment or
script that never ends takes the rest); rows are independent, so that repeated rows and clashing ids have their own texts; other
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._work import bounded_batches, task

#: Characters below which a block is short, and from which stop words alone make it good.
SHORT, LONG = 70, 200
#: Shares of stop words from which a block is near good and good, and the share of linked characters from which it is bad.
SOME_STOPS, MANY_STOPS, LINKED = 0.15, 0.25, 0.33
#: Elements inside one another, at most; what is deeper counts as the text of these, as in browsers.
DEPTH = 512

#: The most frequent function words of some languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be been but by can could for from had has have he her his how i if in into is it its more my no
    not of on or our she so than that the their them there these they this to was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in ist
    ja mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et être il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour que
    qui sa se ses si son sur un une vous y
    al como con de del desde donde el ella en entre era es esta este está fue ha hay la las le lo los más me mi muy no o para pero por porque
    que se ser si sin sobre su sus también te un una y ya
    che con da dei del della di e gli il in la le nel non per si sono un una
    de do da em um uma não os as com por mais dos das
    de het een van en in is dat op te zijn met voor niet aan er om ook
    """.split()
)

_BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4
    h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is not markup, and not shown.
_RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
_OUT = frozenset("aside audio button canvas datalist dialog footer form head map menu nav object search select svg video".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of class names and ids of what is no article.
_CUES = frozenset(
    """ad adbox ads adsense advert advertisement advertising advertorial adverts alert banner breadcrumb breadcrumbs byline-ads captcha comment commentary
    commentlist comments consent cookie cookies copyright dialog disclaimer discussion disqus footer gdpr globalnav login masthead menu menus modal nav
    navbar navi navigation newsletter notice notices outbrain overlay pager pagination paywall popup privacy promo promoted promotion recommended
    register related replies reply respond responses rss search share sharebar sharing sidebar signin signup skip social sponsor sponsored
    subscribe subscription taboola teaser teasers toast toolbar topbar trending widget widgets""".split()
)
#: Whole names of headers of pages; an article has headers of its own.
_HEADERS = frozenset("header page-header site-header global-header top-header main-header page-head site-head".split())
_NOT_CUES = frozenset("has is no not with without".split())
_REMARKS = frozenset("comment comments discussion disqus replies reply respond responses".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Headings of what comes after an article.
_SECTIONS = re.compile(
    r"\W*(\d+\W+)?(reader |user )?(comments?|leave a (comment|reply)|discussion|responses|related( (articles|posts|stories|links))?|you (may|might) also like|share this|"
    r"kommentare?|leserkommentare|commentaires?|comentarios?|ähnliche artikel|articles liés|artículos relacionados)(\W+\d+)?\W*",
    re.IGNORECASE,
)
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|\bcopyright\b|all rights reserved", re.IGNORECASE)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+")


class _Reader:
    """Tags and texts of a page, in one pass: what never ends is looked for once."""

    def __init__(self, page: str):
        self.page, self.never = page, set()

    def _find(self, what: str, at: int) -> int:
        if what in self.never:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.never.add(what)
        return found

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """(kind, name, value): text with its value; begin with its attributes as they stand; end."""
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            lt = self._find("<", at)
            if lt < 0:
                yield "text", "", page[at:]
                return
            if lt > at:
                yield "text", "", page[at:lt]
            if page.startswith("<!--", lt):
                if page.startswith((">", "->"), lt + 4):
                    at = page.find(">", lt) + 1
                    continue
                end = self._find("-->", lt + 4)
                at = size if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), lt):
                end = self._find(">", lt)
                at = size if end < 0 else end + 1
                continue
            closing = page.startswith("/", lt + 1)
            name = _NAME.match(page, lt + 1 + closing)
            if not name:
                if closing and lt + 2 < size:
                    end = self._find(">", lt)
                    at = size if end < 0 else end + 1
                else:
                    yield "text", "", "<"
                    at = lt + 1
                continue
            end = self._tag_end(name.end())
            if end < 0:
                return
            tag = name.group().lower()
            at = end + 1
            if closing:
                yield "end", tag, ""
                continue
            yield "begin", tag, page[name.end() : end]
            if tag in _RAW:
                at = self._raw_end(tag, at)
            elif tag == "plaintext":
                yield "text", "", page[at:]
                return

    def _tag_end(self, at: int) -> int:
        """Where a tag's ``>`` is; one inside a quoted value is none."""
        page, first = self.page, self._find(">", at)
        if first < 0:
            return -1
        mark = at
        while True:
            eq = page.find("=", mark, first)
            if eq < 0:
                return first
            value = eq + 1
            while value < len(page) and page[value].isspace():
                value += 1
            quote = page[value : value + 1]
            if quote not in ("'", '"') or value > first:
                mark = eq + 1
                continue
            close = self._find(quote, value + 1)
            if close < 0:
                return first
            mark = close + 1
            if close > first:
                first = self._find(">", mark)
                if first < 0:
                    return -1

    def _raw_end(self, tag: str, at: int) -> int:
        if tag in self.never:
            return len(self.page)
        found = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(self.page, at)
        if not found:
            self.never.add(tag)
            return len(self.page)
        return found.start()


def _cue(names: str, cues: frozenset) -> bool:
    """Whether a class list or id names what is no article."""
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and parts[0] not in _NOT_CUES and (any(p in cues for p in parts) or (cues is _CUES and "-".join(parts) in _HEADERS)):
            return True
    return False


def _is_out(tag: str, attributes: str, marked: bool, named: bool) -> bool:
    """Whether an element is no part of an article; ``marked``: it is inside one; ``named``: classes and ids count."""
    if tag in _OUT or (tag == "header" and not marked):
        return True
    if not attributes or attributes.isspace():
        return False
    values = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.IGNORECASE):
        return True
    if tag in ("html", "body") or not named:
        return False
    if values.get("role", "").lower() in _ROLES:
        return True
    cues = _REMARKS if tag in ("article", "main") else _CUES
    return _cue(values.get("class", ""), cues) or _cue(values.get("id", ""), cues)


@dataclass
class Block:
    text: str
    linked: int = 0
    links: int = 0
    after: bool = False
    marked: bool = False
    heading: bool = False
    listed: bool = False
    words: int = field(default=0)
    stops: int = field(default=0)

    def __post_init__(self):
        found = _WORD.findall(self.text.lower())
        self.words, self.stops = len(found), sum(map(STOP_WORDS.__contains__, found))


def blocks(page: str, named: bool = True) -> list[Block]:
    """The blocks of a page that have text, in order, but for those in elements that are no part of an article."""
    found: list[Block] = []
    # Open elements: (tag, they are out, they are marked, level of the heading that they are in); how many of each tag are open.
    open_: list[tuple[str, bool, bool, int]] = []
    at: dict[str, int] = {}
    pieces: list[str] = []
    linked = links = 0
    # Depth and level of a heading after which there is no more article.
    after: tuple[int, int] | None = None

    def flush() -> None:
        nonlocal linked, links, after
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            _, _, marked, level = open_[-1] if open_ else ("", False, False, 0)
            if level and after and level <= after[1]:
                after = None
            if level and not after and len(text) < SHORT and _SECTIONS.fullmatch(text) and (level > 1 or any(b.heading for b in found)):
                after = (next(i for i, x in enumerate(open_) if x[0] in _HEADINGS), level)
            found.append(Block(text, linked, links, after is not None, marked, level > 0, bool(at.get("li"))))
        pieces.clear()
        linked = links = 0

    def close(depth: int) -> None:
        nonlocal after
        for tag, *_ in open_[depth:]:
            at[tag] -= 1
        del open_[depth:]
        if after and depth < after[0]:
            after = None

    for kind, tag, value in _Reader(page).tokens():
        out, marked, level = open_[-1][1:] if open_ else (False, False, 0)
        if kind == "text":
            if not out:
                pieces.append(value)
                if at.get("a"):
                    linked += len(value) - value.count(" ")
            continue
        if tag in _BLOCKS:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if kind == "begin":
            if tag in _VOID or tag in _RAW:
                continue
            links += tag == "a" and not out
            if tag in _BLOCKS and open_ and open_[-1][0] in ("p", "dt", "dd", "li", "option") and (open_[-1][0] in ("p", tag) or {open_[-1][0], tag} == {"dt", "dd"}):
                close(len(open_) - 1)
            elif tag in _BLOCKS and at.get("p"):
                # What an open paragraph holds that isn't a block ends with it.
                depth = len(open_) - 1
                while depth >= 0 and open_[depth][0] not in _BLOCKS:
                    depth -= 1
                if depth >= 0 and open_[depth][0] == "p":
                    close(depth)
            out, marked, level = open_[-1][1:] if open_ else (False, False, 0)
            if len(open_) < DEPTH and (tag in _BLOCKS or not value.rstrip().endswith("/")):
                own = out or _is_out(tag, value, marked, named)
                open_.append((tag, own, (marked or tag in ("article", "main")) and not own, int(tag[1]) if tag in _HEADINGS else level))
                at[tag] = at.get(tag, 0) + 1
        elif at.get(tag):
            depth = len(open_) - 1
            while open_[depth][0] != tag:
                depth -= 1
            # The end of something inside a line closes no block.
            if tag in _BLOCKS or not any(x[0] in _BLOCKS for x in open_[depth + 1 :]):
                close(depth)
    flush()
    return found


def _links(block: Block) -> float:
    return block.linked / max(1, len(block.text) - block.text.count(" "))


def _first_pass(block: Block, stops: bool, marked: bool) -> str:
    if _links(block) > LINKED:
        # A heading, or a line of an article, may be one link.
        return "short" if marked and block.words and (block.heading or block.links == 1 and not block.listed) else "bad"
    if not marked and len(block.text) < LONG and _RIGHTS.search(block.text):
        return "bad"
    if len(block.text) < SHORT:
        return "bad" if block.linked and not marked else "short"
    share = block.stops / max(1, block.words) if stops else 1.0
    if share >= MANY_STOPS:
        return "good" if len(block.text) > LONG or marked else "near"
    if share >= SOME_STOPS:
        return "near"
    return "short" if marked else "bad"


def _second_pass(page: list[Block], labels: list[str], marked: bool) -> list[bool]:
    """Whether each block is kept."""
    size = len(page)
    before, after = [-1] * size, [-1] * size
    last = -1
    for i in range(size):
        before[i] = last
        if labels[i] in ("good", "bad"):
            last = i
    last = -1
    for i in reversed(range(size)):
        after[i] = last
        if labels[i] in ("good", "bad"):
            last = i
    kept = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            kept.append(label == "good")
            continue
        a, b = before[i], after[i]
        if label == "near" and (a < 0 or b < 0 or "good" in (labels[a], labels[b])):
            kept.append(True)
        elif a < 0 and b < 0:
            kept.append(True)
        elif page[i].heading and b >= 0:
            kept.append(labels[b] == "good")
        elif a < 0 or b < 0:
            kept.append(marked or labels[max(a, b)] == "good")
        elif labels[a] == labels[b]:
            kept.append(labels[a] == "good")
        elif i - a != b - i:
            kept.append(labels[a if i - a < b - i else b] == "good")
        else:
            kept.append(marked)
    return kept


def main_text(page: str | None) -> str:
    """The main text of a page."""
    page = page or ""
    # A name that says that all of a page is no article is wrong.
    inside = blocks(page) or blocks(page, named=False)
    inside = [b for b in inside if not b.after]
    marked = any(b.marked for b in inside)
    if marked:
        inside = [b for b in inside if b.marked]
    stops = any(len(b.text) >= SHORT and b.stops >= SOME_STOPS * b.words and b.stops for b in inside)
    labels = [_first_pass(b, stops, marked) for b in inside]
    return "\n".join(b.text for b, kept in zip(inside, _second_pass(inside, labels, marked)) if kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, url, the main text, and n_chars, its characters."""
    bounded_batches(pages.sparkSession)
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(value.as_py()) for value in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    kinds = {n: t.simpleString() for n, t in ((f.name, f.dataType) for f in slim.schema)}
    out = slim.mapInArrow(task("pages", run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
