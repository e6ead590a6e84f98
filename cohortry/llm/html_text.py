"""Main text of web pages by consensus of a host's pages.

First pass: each page is read, once, and what was read is kept; its containers are scored by the text of the blocks in them, less that of links, with a decay on the way up
and a bonus for elements that say they hold the content. From the best container the page climbs to the widest one around it, below
the body, in which what was added has more text than links; the page votes for the generalised path (tags and classes, digits as #)
of that. Votes are counted per host and path by an aggregation, and each host's path with the most votes wins.
Second pass: each page's text is taken from all containers with a score on the host's winning path, in page order, or from those on
the page's own path where the winning one is missing or holds under a third of the own best container's score. Text without any
heading (h1 to h3) gets the page's h1 as its headline, if there is just one and it isn't in what is dropped.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments never count nor come out; a `header`
inside an article is part of it. Tags, roles and hidden elements tell them for certain. Classes and ids only hint: a name counts by its
last or first word, but for states (`no-sidebar`, `has-nav`, `menu-open`), and an element told by its name alone stays if it has more text than
all the page has outside of such elements and holds an article, main part or h1, or if it has twenty times that text (comments,
adverts and lists of other articles don't). So does a form, unless it holds a control for every hundred characters. A section of an article
that only its id tells stays if it has a heading and more text than links. If nothing of a page stays, names tell nothing on it: a
page that has any text outside of menus, scripts and the like never comes out empty. Character references are decoded, white space inside a block becomes
one space, blocks are joined by one space; nothing else is changed, dropped or capped. Broken markup (unclosed, misnested, cut
off) is read as far as it goes. A page is read in time and memory in proportion to its length, however deep or broken it is.

The host is the url's, in lower case; pages without one share the host "". Null html is an empty page with an empty text. Repeated
rows and null ids are pages like others; ties of votes go to the path with more text, then to the lesser digest; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import html as entities
import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, meet, saved

#: Hosts' paths may be broadcast up to this size; beyond, pages meet them in so many parts for each host.
BROADCAST_BYTES, HOST_PARTS = 16 << 20, 32
#: Pages that are handed on at once.
PAGES_AT_ONCE = 256
DECAY = 0.9
SHARE_OF_OWN = 1 / 3

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label nobr ruby rb rt rp math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics annotation".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = frozenset("ul ol dl table div article section main body td th form nav aside".split())
CLOSABLE = frozenset(("p", *(t for tags in CLOSED_BY.values() for t in tags)))

DROP_TAGS = frozenset("head script style noscript template nav aside footer button select option textarea iframe object embed svg canvas audio video map menu dialog input datalist title".split())
CONTROLS = frozenset("input select textarea button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters that a form has to have for each of its controls to be text; times the text outside that an element without article has to have.
CHARS_A_CONTROL, TIMES_OUTSIDE = 100, 20
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar tablist form".split())
#: Words of names of what is no main text: those that count alone or at a name's end, those that count at its start whatever follows,
#: and those of elements that stay dropped whatever they hold.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs"
    " sidebar aside rail widget widgets footer foot comment comments commentlist disqus respond replies reply notice notices cookie cookies consent gdpr banner popup modal overlay alert"
    " newsletter subscribe signup login share sharing social related recommended recommendations trending popular pagination pager masthead topbar toolbar search skip".split()
)
FIRST_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer comment comments commentlist disqus"
    " cookie cookies consent gdpr popup modal newsletter share sharing pagination pager masthead topbar toolbar".split()
)
#: Of those, the words that inside of an article may start names of its own parts.
OUTER_WORDS = frozenset("menu sidebar widget footer toolbar topbar masthead popup modal".split())
FIRM_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promos promotion comment comments commentlist disqus respond replies reply"
    " cookie cookies consent gdpr newsletter related recommended recommendations trending popular".split()
)
#: Words that only say which piece of the element it is, and words of names that state something of an element around it.
PIECES = frozenset("area bar block body box button buttons col column container content group head header heading icon icons inner item items left line link links list listing main message outer panel posts right row section slot stories text title unit wrap wrapper articles".split())
STATES_FIRST = frozenset("no not non has have with without hide is".split())
STATES_LAST = frozenset("none off on disabled enabled open opened closed collapsed expanded hidden visible active inactive".split())
KEEP_WORDS = frozenset("article content post entry story main body text".split())
CONTENT_WORDS = frozenset("article content post entry story main maincontent articlebody".split())

MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+)>")
TAG_START = re.compile(r"</?[a-zA-Z]")
#: A tag whose quotes don't match.
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")
LOOSE = re.compile(r"</?[a-zA-Z][^<>]*>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
NAME = re.compile(r"[a-z]+|[0-9]+")
DIGITS = re.compile(r"[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


SURE, FIRM, HINT = 3, 2, 1


def _named(name: str, in_content: bool) -> int:
    """What a class or id says of its element: FIRM or HINT for no main text, else 0."""
    words = NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    if not words or words[0] in STATES_FIRST or words[-1] in STATES_LAST:
        return 0
    whole = len(words)
    while len(words) > 1 and (words[-1] in PIECES or words[-1].isdigit()):
        words.pop()
    hits = [w for w in (words[-1], words[0]) if w in DROP_WORDS]
    if hits and (words[-1] in DROP_WORDS or (words[0] in FIRST_WORDS and not (in_content and words[0] in OUTER_WORDS))):
        return FIRM if any(w in FIRM_WORDS for w in hits) else HINT
    if "header" in name.lower() and not in_content and not set(words) & KEEP_WORDS and (words[-1] == "header" or whole > len(words)):
        return HINT
    return 0


def _drops(tag: str, attributes: dict[str, str], in_content: bool) -> int:
    """SURE, FIRM or HINT if an element is no main text, else 0."""
    if tag in DROP_TAGS or (tag == "header" and not in_content):
        return SURE
    if tag == "form":
        return max(HINT, _drops("div", attributes, in_content))
    if not attributes:
        return 0
    if attributes.get("role", "").lower() in DROP_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", "").lower()):
        return SURE
    if tag in ("body", "html", "article", "main"):
        return 0
    return max((_named(name, in_content) for c in ("class", "id") for name in attributes.get(c, "").split()), default=0)


def _holds_article(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element says that main text is in it, rather than a comment or teaser."""
    if tag in ("article", "main"):
        return not any(_named(name, False) for c in ("class", "id") for name in attributes.get(c, "").split())
    return tag == "h1" or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody"


def _bonus(tag: str, attributes: dict[str, str]) -> float:
    if tag == "body":
        return 0.6
    if tag == "article" or attributes.get("itemprop", "").lower() == "articlebody":
        return 1.6
    if tag == "main" or attributes.get("role", "").lower() in ("main", "article"):
        return 1.5
    words = {w for c in (attributes.get("class", ""), attributes.get("id", "")) for w in NAME.findall(c.lower())}
    return 1.25 if words & CONTENT_WORDS else 1.0


def _marks(html: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, match) of each tag, and of comments and declarations without a match."""
    at, strict = 0, True
    while (at := html.find("<", at)) >= 0:
        m = MARK.match(html, at)
        if m:
            yield at, m.end(), None
            at = m.end()
            continue
        m = TAG.match(html, at) if strict else None
        if not m and TAG_START.match(html, at):
            # its quotes run to the page's end; from here on, quotes don't hold marks
            strict = False
            m = LOOSE_TAG.match(html, at)
        if not m:
            at += 1
            continue
        at = (yield at, m.end(), m) or m.end()


class Stack:
    """The open elements, with where those are that others close, so that nothing is searched for."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int, bool]] = []  # (tag, container, whether its text is surely dropped)
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []

    def push(self, tag: str, node: int, dropped: bool) -> None:
        self.places[tag].append(len(self.items))
        if tag in SCOPE:
            self.scopes.append(len(self.items))
        self.items.append((tag, node, dropped))

    def cut(self, size: int) -> None:
        while len(self.items) > size:
            tag = self.items.pop()[0]
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def open(self, *tags: str) -> bool:
        return any(self.places[t] for t in tags)

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places[tag] else -1

    def close(self, tags: tuple[str, ...]) -> None:
        """Closes the last open one of tags in the innermost scope, and those of them right around it."""
        at, scope = max(map(self.last, tags)), self.scopes[-1] if self.scopes else -1
        if at < 0 or at < scope:
            return
        while at and self.items[at - 1][0] in tags:
            at -= 1
        self.cut(at)

    @property
    def top(self) -> tuple[int, bool]:
        return self.items[-1][1:] if self.items else (0, False)


class Page:
    """The elements of a page that may hold text, and its text in order."""

    def __init__(self, html: str) -> None:
        # of each container: a digest of its path, the one around it, its bonus, its text less that of links, whether it is the
        # page itself, html or body, what its name hints, and whether it says it holds main text
        self.paths, self.parents, self.bonus, self.own = [b""], [-1], [0.6], [0.0]
        self.outer, self.hints, self.article = [True], [0], [False]
        # how many controls and headings are right in it, whether it is a form, and a section of an article that its id alone tells
        self.controls, self.headed, self.form, self.section = [0], [0], [False], [False]
        self.heads: list[tuple[int, str]] = []  # (container, tag) of headings
        self.parts: list[tuple[int, str]] = []  # (container, text or a block's end)
        self._read(html)
        self.off = self._off()
        for i, off in enumerate(self.off):
            if off:
                self.own[i] = 0.0

    KEPT = ("paths", "parents", "bonus", "own", "outer", "heads", "parts", "off")

    def packed(self) -> bytes:
        """What extraction needs of a page."""
        return zlib.compress(pickle.dumps([getattr(self, k) for k in self.KEPT], 5), 1)

    @classmethod
    def unpacked(cls, made: bytes) -> Page:
        page = cls.__new__(cls)
        for k, v in zip(cls.KEPT, pickle.loads(zlib.decompress(made)), strict=True):
            setattr(page, k, v)
        return page

    def _read(self, html: str) -> None:
        stack, at = Stack(), 0
        marks = _marks(html)
        found = next(marks, None)
        while found:
            start, end, m = found
            if start > at:
                self._text(html[at:start], stack)
            at, jump = end, None
            if m:
                jump = self._tag(m, stack, html)
                at = jump or end
            found = next(marks, None) if jump is None else self._sent(marks, jump)
        if at < len(html):
            # a tag that is cut off at the end is no text
            self._text(re.sub(r"<[a-zA-Z/!?][^<]*\Z", "", html[at:]), stack)

    @staticmethod
    def _sent(marks: Iterator, at: int):
        try:
            return marks.send(at)
        except StopIteration:
            return None

    def _tag(self, m: re.Match, stack: Stack, html: str) -> int | None:
        """Where to read on, if not after the tag."""
        tag = m[2].lower()
        if m[1]:
            if stack.open(tag):
                self._break(tag, stack)
                stack.cut(stack.last(tag))
            else:
                self._break(tag, stack)
            return None
        if tag in CLOSES_P:
            stack.close(("p",))
        if tag in CLOSED_BY:
            stack.close(CLOSED_BY[tag])
        self._break(tag, stack)
        if tag in CONTROLS and not (tag == "input" and "hidden" in m[3].lower()):
            self.controls[stack.top[0]] += 1
        if tag in HEADINGS:
            self.headed[stack.top[0]] += 1
        if tag in VOID:
            return None
        raw = m[3]
        attributes = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t\r") else {}
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(html, m.end())
            over = html.find(">", close.start()) if close else -1
            return over + 1 if over >= 0 else len(html)
        parent, dropped = stack.top
        inside = stack.open("article", "main")
        hint = _drops(tag, attributes, inside)
        dropped = dropped or hint == SURE
        node = parent
        if not dropped and (hint or (tag not in INLINE and tag not in ("p", "br") and not raw.endswith("/"))):
            node = len(self.paths)
            name = ".".join([tag, *sorted(DIGITS.sub("#", c) for c in attributes.get("class", "").split())])
            self.paths.append(hashlib.blake2b(self.paths[parent] + name.encode("utf-8", "surrogatepass"), digest_size=12).digest())
            self.parents.append(parent)
            self.outer.append(tag in ("html", "body"))
            self.hints.append(hint)
            self.article.append(_holds_article(tag, attributes))
            self.controls.append(0)
            self.headed.append(int(tag in HEADINGS))
            self.form.append(tag == "form")
            self.section.append(tag == "section" and inside and hint == HINT and not any(_named(x, True) for x in attributes.get("class", "").split()))
            self.bonus.append(_bonus(tag, attributes))
            self.own.append(0.0)
            if tag in ("h1", "h2", "h3"):
                self.heads.append((node, tag))
        stack.push(tag, node, dropped)
        return None

    def _break(self, tag: str, stack: Stack) -> None:
        node, dropped = stack.top
        if tag not in INLINE and not dropped:
            self.parts.append((node, "\n"))

    def _text(self, text: str, stack: Stack) -> None:
        node, dropped = stack.top
        if dropped:
            return
        if "<" in text:
            text = LOOSE.sub("\n", text)
        text = entities.unescape(text) if "&" in text else text
        self.parts.append((node, text))
        size = len(text.strip())
        self.own[node] += -size if stack.open("a") else size

    def _off(self) -> list[bool]:
        """Which containers are no main text by their names, or by those around them."""
        n = len(self.paths)
        firm, told = [h == FIRM for h in self.hints], [h > 0 for h in self.hints]
        for i in range(1, n):
            firm[i] = firm[i] or firm[self.parents[i]]
            told[i] = told[i] or told[self.parents[i]]
        if not any(told):
            return told
        outside = sum(x for x, t in zip(self.own, told, strict=True) if not t)
        inside = [0.0 if f else x for x, f in zip(self.own, firm, strict=True)]
        holds = [a and not f for a, f in zip(self.article, firm, strict=True)]
        controls, headed = list(self.controls), list(self.headed)
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            inside[up] += inside[i]
            holds[up] = holds[up] or holds[i]
            controls[up] += controls[i]
            headed[up] += headed[i]
        off = [False] * n
        for i in range(1, n):
            text = inside[i] > 0 and not firm[i] and not (self.form[i] and inside[i] < CHARS_A_CONTROL * controls[i])
            stays = text and (inside[i] > outside and (holds[i] or inside[i] >= TIMES_OUTSIDE * outside) or self.section[i] and headed[i])
            off[i] = off[self.parents[i]] or (self.hints[i] > 0 and not stays)
        if any(x > 0 for x in self.own) and not any(x > 0 and not o for x, o in zip(self.own, off, strict=True)):
            for no in (firm, [False] * n):  # names tell nothing here: first but for the firm ones
                if any(x > 0 and not f for x, f in zip(self.own, no, strict=True)):
                    return no
        return off

    def scores(self) -> list[float]:
        held = list(self.own)
        for i in range(len(held) - 1, 0, -1):
            held[self.parents[i]] += DECAY * max(0.0, held[i])
        return [x * b for x, b in zip(held, self.bonus, strict=True)]

    def best(self, scores: list[float] | None = None) -> tuple[int, float]:
        scores = scores or self.scores()
        i = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return i, scores[i]

    def widest(self, node: int) -> int:
        """The widest container around node, below the body, that adds more text than links at each step that adds some."""
        whole = list(self.own)  # text less links, all of it
        for i in range(len(whole) - 1, 0, -1):
            whole[self.parents[i]] += whole[i]
        if self.outer[node]:
            return node
        out, at = node, self.parents[node]
        while at >= 0 and not self.outer[at]:
            more = whole[at] - whole[out]
            if more < 0:
                break
            # a wrapper that adds nothing says nothing
            if more > 0:
                out = at
            at = self.parents[at]
        return out

    def on(self, path: bytes | None) -> list[int]:
        """The containers to read: those on the path, or on the page's own path."""
        scores = self.scores()
        own, most = self.best(scores)
        there = [i for i, p in enumerate(self.paths) if p == path] if path is not None else []
        there = [i for i in there if scores[i] > 0] or there
        if there and sum(scores[i] for i in there) >= SHARE_OF_OWN * most:
            return there
        own = self.widest(own)
        return [i for i, p in enumerate(self.paths) if i == own or (p == self.paths[own] and scores[i] > 0)]

    def text(self, nodes: list[int]) -> str:
        inside = [False] * len(self.paths)
        for node in nodes:
            inside[node] = True
        for i in range(nodes[0] + 1, len(self.paths)):
            inside[i] = inside[i] or inside[self.parents[i]]
        heads = [(i, tag) for i, tag in self.heads if not self.off[i]]
        if not any(inside[i] for i, _ in heads):
            # a text without headings has the page's only h1 as its headline
            first = [i for i, tag in heads if tag == "h1"]
            if len(first) == 1:
                inside[first[0]] = True
        return " ".join("".join(t for i, t in self.parts if inside[i] and not self.off[i]).split())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as read, with their votes; what is read is kept, so that each page is read once."""
    for batch in batches:
        for at in range(0, len(batch), PAGES_AT_ONCE):
            some = batch.slice(at, PAGES_AT_ONCE)
            paths, scores, kept = [], [], []
            for x in some.column("html"):
                page = Page(x.as_py() or "")
                i, score = page.best()
                paths.append(page.paths[page.widest(i)] if score > 0 else None)
                scores.append(round(score))
                kept.append(page.packed())
            made = [pa.array(paths, pa.binary()), pa.array(scores, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), some.column("host"), *made], ["page_id", "url", "host", "vote", "score", "page"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for x, path in zip(batch.column("page"), batch.column("path").to_pylist(), strict=True):
            page = Page.unpacked(x.as_py())
            texts.append(page.text(page.on(path)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, vote (a path's digest, null without text), score, page (as read) of each page."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    return named.select("page_id", "url", "host", "html").mapInArrow(_read, "page_id long, url string, host string, vote binary, score long, page binary")


def host_paths(read: DataFrame) -> DataFrame:
    """host, path (its digest): of each host the path with the most votes (then the most text, then the least)."""
    votes = read.select("host", F.col("vote").alias("path"), "score").where("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.col("score"), "path")).alias("path"))


def main_text(pages: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page; most: bytes of hosts' paths to broadcast."""
    read = saved(read_pages(pages), "pages-read")
    paths = cut(host_paths(read))
    rows = meet(read.drop("vote", "score"), paths, "host", F.xxhash64("page_id", "url"), BROADCAST_BYTES if most is None else most, HOST_PARTS)
    return rows.select("page_id", "url", "page", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
