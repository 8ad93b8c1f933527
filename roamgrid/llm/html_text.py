"""Main text of web pages by consensus of each host's pages.

1. Every page is parsed and its containers are scored by the running text in them; the page names
   the innermost container that holds all of it, as a path of tags with their classes in which
   numbers are generalised.  It also names, by hash, its blocks that stand in no article or main.
2. Spark counts these votes for each host; a host's winning paths are those that enough of its pages
   name, and its recurring blocks those that stand at one path on most of its different pages.
3. Every page is extracted again.  Recurring blocks go where they frame the article.  A page whose path other pages of its host
   name too is extracted from its own container.  One that stands alone takes the first winning path
   that holds nearly all of its text, or the path that most pages of its host name if that holds
   enough: what only this page has outside counts as beside the article.  Else, and if its host is
   unknown, it keeps its own container.

A class or id is weak evidence: it tells only if all its words are ones of MARKS or say nothing, never
of a heading, and never of what wraps the article.

Reading a page takes time in proportion to its length, whatever is in it: nothing is searched twice.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamgrid.plans.storage import written

# Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noscript template xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul br".split()
)
CONTAINERS = set("article body center div html main section table tbody td tr form fieldset".split())
ASIDE = set("nav footer aside button select option menu dialog svg canvas object audio video map".split())
FORMS = {"form", "fieldset"}
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup caption figcaption".split())
ARTICLES = {"article", "main"}
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Words in a class or id that mark what isn't the article.
MARKS = set(
    "nav navbar navigation menu menus sidebar sidebars footer foot header masthead topbar ad ads adv advert adverts advertisement "
    "advertisements advertising adsense promo promos promotion sponsor sponsored sponsors banner banners cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register share sharing social "
    "comment comments commentlist respond replies reply disqus discussion related recommended recommendations breadcrumb breadcrumbs crumbs "
    "pagination pager paging widget widgets toolbar search form hidden copyright legal disclaimer paywall tagcloud skip".split()
)
#: Words that say nothing beside one of MARKS, as in ``site-footer`` or ``share-buttons``.
QUALIFIERS = set(
    "site page main top bottom left right upper lower side box boxes bar bars list lists area areas block blocks wrap wrapper container "
    "section inner outer link links button buttons icon icons item items post posts article articles content global primary secondary "
    "group panel row col column js id the my wp more tag tags print text".split()
)
# The last words of names of readers' comments.
COMMENTS = {"comment", "comments"}
#: What an opened element closes when it stands directly inside it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
#: End tags of these don't reach out of what is in SCOPES.
INSIDE = {"p", "li", "dt", "dd"}
SCOPES = set("ul ol dl table td th div article section main aside body".split())

#: Share of a page's running text from which a marked element or a form wraps the article.
WRAPS, FORM_WRAPS = 0.5, 0.8
#: Links, and share of a list's letters in them, from which a list outside of articles is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.9
#: Share of a host's pages that must name a path for it to win, so a host has at most ten; and to be
#: named by several, beside two pages at least, so it has at most a thousand of these.
WINS, SEVERAL = 0.1, 0.001
#: Share of the page's running text that a winning path's containers must hold to be used, and what
#: that of the path which most pages of the host name must hold; both for pages that stand alone.
NEARLY, ENOUGH = 0.95, 0.25
#: Different pages of a host, and share of its pages, from which a block outside of articles recurs.
RECURS_ON, RECURS = 5, 0.5
#: Hosts' paths and blocks up to this number are broadcast, more are joined by a shuffle.
BROADCAST_PATHS = 200_000

_begin = re.compile(r"<(?=[a-zA-Z!?/])")
_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)(\s*+>)?")
_attribute = re.compile(r"[\s/]*+(=?+[^\s/>=]*+)\s*+(=\s*+)?+")
_bare = re.compile(r"[^\s>]*+")
_words = re.compile(r"[a-z]+")
_camel = re.compile(r"([a-z])([A-Z])")
_number = re.compile(r"\d+")
_long_reference = re.compile(r"&#[0-9]{8,};?")
_blank = re.compile(r"\s")
_ROOT = 0


def unescaped(text: str) -> str:
    """Character references decoded; a number of too many digits for Python's int() is no character."""
    if "&#" in text:
        text = _long_reference.sub(lambda m: f"&#{int(d) if len(d := m[0][2:].rstrip(';').lstrip('0')) < 9 and d else 0x110000};", text)
    return html.unescape(text)


def tag_end(source: str, at: int, last: dict[str, int], attributes: list) -> int:
    """Where the tag ends whose attributes begin at ``at``; -1 if the page ends in it.

    Appends (name, value) of each attribute.  ``last``: place of the page's last quote of each kind;
    a value whose quote isn't closed ends with the tag.
    """
    end = len(source)
    while at < end:
        m = _attribute.match(source, at)
        at, value = m.end(), ""
        if m[2]:
            quote = source[at : at + 1]
            if quote in last and at < last[quote]:
                close = source.index(quote, at + 1)
                value, at = source[at + 1 : close], close + 1
            elif quote in last:
                at = source.find(">", at)
                if at < 0:
                    return -1
            else:
                v = _bare.match(source, at)
                value, at = v[0], v.end()
        if m[1]:
            attributes.append((m[1].lower(), value))
        if source[at : at + 1] == ">":
            return at + 1
    return -1


def marks(value: str) -> bool:
    """Whether a class or id tells of what isn't the article: all words of one of its names do, or say nothing,
    or it ends in comments, whosever they are."""
    for name in value.split():
        words = _words.findall(_camel.sub(r"\1 \2", name).lower())
        if not MARKS.isdisjoint(words) and all(w in MARKS or w in QUALIFIERS for w in words) or words and words[-1] in COMMENTS:
            return True
    return False


class Page:
    """A parsed page: elements and text blocks in page order.

    An element is (parent, tag, key, path, aside, marked, within); ``path`` is a hash of the keys from
    the root, ``within`` whether it stands in an article or main.  A block is [element, raw text
    pieces, link letters].  What is marked only by a class, an id or as a form counts as aside unless
    it wraps the article.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.key, self.path_id = [-1], ["#root"], [""], [_ROOT]
        self.aside, self.marked, self.within = [False], [False], [False]
        self.blocks: list[list] = []
        self._stack = [0]
        self._heights: dict[str, list[int]] = {}  # of the open elements of each tag
        self._scopes, self._open_blocks = [0], [0]
        self._parse(source)

    def _parse(self, source: str):
        stack, at, links = self._stack, 0, 0
        block = None
        end = len(source)
        last = {q: source.rfind(q) for q in "\"'"}
        while at < end:
            m = _begin.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                text = source[at:stop]
                if block is None:
                    if not text.isspace():
                        block = [stack[-1], [text], len(text) if links else 0]
                        self.blocks.append(block)
                else:
                    block[1].append(text)
                    if links:
                        block[2] += len(text)
            if m is None:
                break
            m = _tag.match(source, stop)
            if m is None:  # a comment, a declaration or an odd end tag
                comment = source.startswith("<!--", stop)
                at = source.find("-->" if comment else ">", stop + 2)
                if at < 0:
                    break
                at += 3 if comment else 1
                continue
            name, attributes = m[2].lower(), []
            at = m.end() if m[3] else tag_end(source, m.end(), last, attributes)
            if at < 0:
                break  # the page ends inside a tag
            if name in BLOCK:
                block = None
            if m[1]:
                if name == "a":
                    links = 0
                self._close(name)
            elif name == "a":
                links = 1
            elif name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = source.find(">", close.end()) + 1 if close else 0
                if not at:
                    break
            elif name not in VOID and (name in BLOCK or name in ASIDE):
                links = 0
                self._open(name, attributes)

    def _open(self, name, attributes):
        stack, heights = self._stack, self._heights
        if name in BLOCK and self.tag[stack[-1]] == "p":
            self._pop(len(stack) - 1)  # a block ends an open paragraph
        ends = CLOSES.get(name)
        while ends and self.tag[stack[-1]] in ends:
            self._pop(len(stack) - 1)
        parent = stack[-1]
        key, aside, marked = name, name in ASIDE, name in FORMS
        if name == "header":
            aside = not (heights.get("article") or heights.get("main"))
        if attributes:
            named, away, word = self._read(attributes)
            key += named
            if name not in ("html", "body", "article", "main"):
                aside, marked = aside or away, marked or word and name not in HEADINGS
        self.parent.append(parent)
        self.tag.append(name)
        self.key.append(key)
        above = self.path_id[parent]
        self.path_id.append(above if name in ("html", "body") else xxhash.xxh64_intdigest(key, above))
        self.aside.append(aside)
        self.marked.append(marked)
        self.within.append(self.within[parent] or name in ARTICLES)
        heights.setdefault(name, []).append(len(stack))
        if name in SCOPES:
            self._scopes.append(len(stack))
        if name in BLOCK:
            self._open_blocks.append(len(stack))
        stack.append(len(self.tag) - 1)

    @staticmethod
    def _read(attributes):
        """Generalised classes, and whether role or style, or a name of MARKS, tell what isn't the article."""
        named, away, word = "", False, False
        for what, value in attributes:
            if what == "role":
                away |= value.lower() in ROLES
            elif what == "hidden":
                away |= not value or value.lower() == "hidden"
            elif what == "style":
                away |= "display:none" in _blank.sub("", value).lower()
            elif what in ("class", "id"):
                if what == "class" and value:
                    named = "." + ".".join(sorted({_number.sub("#", c).replace(">", "_") for c in value.lower().split()}))
                word |= marks(value)
        return named, away, word

    def _close(self, name):
        heights = self._heights.get(name)
        if not heights:
            return
        limit = self._scopes[-1] if name in INSIDE else self._open_blocks[-1] if name not in BLOCK else 0
        if heights[-1] > limit:
            self._pop(heights[-1])

    def _pop(self, height):
        """Closes the open elements from a height of the stack on."""
        stack = self._stack
        while len(stack) > height:
            name = self.tag[stack.pop()]
            self._heights[name].pop()
            if name in SCOPES:
                self._scopes.pop()
            if name in BLOCK:
                self._open_blocks.pop()

    def finish(self):
        """Menus made of links become asides; letters of running text are summed up the elements."""
        n = len(self.tag)
        letters, linked, many = [0] * n, [0] * n, [0] * n
        for at, pieces, link in self.blocks:
            letters[at] += sum(map(len, pieces))
            linked[at] += link
            many[at] += link > 0
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            letters[p] += letters[i]
            linked[p] += linked[i]
            many[p] += many[i]
        for i in range(1, n):
            menu = self.tag[i] in ("ul", "ol", "dl") and not self.within[i] and many[i] >= MENU_LINKS and linked[i] >= MENU_SHARE * letters[i]
            self.aside[i] = self.aside[i] or self.aside[self.parent[i]] or menu
        running = self._running(self.aside)
        wraps = self._wraps(running)
        aside = list(self.aside)
        for i in range(1, n):
            aside[i] = aside[i] or aside[self.parent[i]] or self.marked[i] and not wraps[i]
        self.score = self._running(aside)
        if self.score[0]:
            self.aside = aside
        else:  # without marks rather than empty
            self.score = running
        return self

    def _running(self, aside) -> list[float]:
        """Letters of running text in and below each element."""
        score = [0.0] * len(self.tag)
        for at, pieces, link in self.blocks:
            if not aside[at]:
                score[at] += max(0, sum(map(len, pieces)) - link)
        for i in range(len(self.tag) - 1, 0, -1):
            score[self.parent[i]] += score[i]
        return score

    def _wraps(self, running) -> list[bool]:
        """Elements that hold main, the longest article, or most of the page's running text."""
        n = len(self.tag)
        wraps = [running[i] > (FORM_WRAPS if self.tag[i] in FORMS else WRAPS) * running[0] for i in range(n)]
        articles = [i for i in range(n) if self.tag[i] == "article" and running[i]]
        holds = [i for i in range(n) if self.tag[i] == "main" and running[i]] + ([max(articles, key=lambda i: running[i])] if articles else [])
        above = set()
        for i in holds:
            while i > 0 and (i := self.parent[i]) not in above:
                above.add(i)
                wraps[i] = True
        return wraps

    def container(self) -> int:
        """The innermost container that holds all running text."""
        best = {}
        for i in range(1, len(self.tag)):
            p = self.parent[i]
            if self.tag[i] in CONTAINERS and self.score[i] > self.score[best.get(p, 0)] * (p in best):
                best[p] = i
        at = 0
        while at in best and self.score[best[at]] == self.score[0]:
            at = best[at]
        return at

    def path(self, i: int) -> str:
        keys = []
        while i > 0:
            if self.tag[i] not in ("html", "body"):
                keys.append(self.key[i])
            i = self.parent[i]
        return ">".join(reversed(keys))

    def shown(self):
        """(element, text, hash) of the blocks that aren't aside; the hash is of text and path, 0 in articles."""
        for at, pieces, _ in self.blocks:
            if not self.aside[at]:
                text = " ".join(unescaped("".join(pieces)).split())
                if text:
                    yield at, text, 0 if self.within[at] else xxhash.xxh64_intdigest(text, self.path_id[at]) or 1

    def _on(self, paths: set[int]) -> dict[int, list[int]]:
        """Containers on each of these paths that stand in no other one on it."""
        found = {p: [] for p in paths}
        if not paths:
            return found
        inside: dict[int, set[int]] = {p: set() for p in paths}
        for i, p in enumerate(self.path_id):
            for q in paths:
                if i and self.parent[i] in inside[q]:
                    inside[q].add(i)
                elif p == q and (i == 0 or self.tag[i] in CONTAINERS):
                    inside[q].add(i)
                    found[q].append(i)
        return found

    def text(self, paths: list[str] | None = None, named: list[str] | None = None, outvotes: bool = False, recurring: list[int] | None = None) -> str:
        """Text of the page's own container, or of those on one of the host's winning ``paths``.

        ``named``: the paths that several pages of the host name; ``outvotes``: whether most of its
        pages name the first of ``paths``; ``recurring``: hashes of the host's recurring blocks, as
        signed 64-bit numbers, which go where they frame the article (``_without_frame``).
        """
        own = self.container()
        chosen = {own}
        ids = {path: path_id(path) for path in paths or ()}
        if paths and self.path_id[own] not in set(map(path_id, named or ())):
            on = self._on(set(ids.values()))
            held = [sum(self.score[i] for i in on[ids[path]]) for path in paths]
            enough = [k for k, x in enumerate(held) if x and x >= NEARLY * self.score[0]]
            if not enough and outvotes and held[0] and held[0] >= ENOUGH * self.score[0]:
                enough = [0]
            if enough:
                chosen = set(on[ids[paths[enough[0]]]])
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = i in chosen or i > 0 and inside[self.parent[i]]
        return "\n".join(self._without_frame([line for line in self.shown() if inside[line[0]]], {h % 2**64 for h in recurring or ()}))

    def _without_frame(self, lines: list[tuple[int, str, int]], recurring: set[int]) -> list[str]:
        """The lines without the recurring ones that frame the others: before the first or behind the last of
        these, and in a container that itself holds no other running line.  What recurs inside an article
        stays, as do all lines where nothing but such is left."""
        own = [k for k, (_, _, h) in enumerate(lines) if h not in recurring]
        if not own:
            return [text for _, text, _ in lines]
        homes = {self._home(lines[k][0]) for k in own if self.tag[lines[k][0]] not in HEADINGS}
        return [text for k, (at, text, h) in enumerate(lines) if h not in recurring or own[0] < k < own[-1] or self._home(at) in homes]

    def _home(self, i: int) -> int:
        """The container that an element stands in."""
        while i > 0 and self.tag[i] not in CONTAINERS:
            i = self.parent[i]
        return i


def path_id(path: str) -> int:
    """The hash of a path as Page holds it."""
    found = _ROOT
    for key in path.split(">") if path else ():
        found = xxhash.xxh64_intdigest(key, found)
    return found


def parse(source: str | None) -> Page:
    return Page(source or "").finish()


def host_of(url):
    """Host of a URL in lower case without user, port and leading ``www.``; null without one."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """For each page with a host and running text one row of ``host``, ``path`` and ``score``, and one
    of ``host``, ``block`` and ``page``, a hash of its text, for each different block outside of articles."""

    def run(batches):
        for b in batches:
            rows = []
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = parse(source)
                at = page.container()
                if page.score[at]:
                    rows.append((host, page.path(at), page.score[at], None, None))
                    shown = list(page.shown())
                    whole = xxhash.xxh64_intdigest("\n".join(text for _, text, _ in shown)) - 2**63
                    rows += [(host, None, None, h - 2**64 if h >= 2**63 else h, whole) for h in {h for _, _, h in shown if h}]
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "path", "score", "block", "page"])

    named = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("host IS NOT NULL")
    return named.mapInArrow(run, "host string, path string, score double, block long, page long")


def consensus(voted: DataFrame) -> DataFrame:
    """``host``, its winning ``paths``, most votes first, then most text, then alphabetically, the
    paths ``named`` by several pages, whether most pages name the first path (``outvotes``), and the
    hashes of its ``recurring`` blocks."""
    # one pass: a row for each path, and one for each block of so many different pages
    counted = voted.groupBy("host", "path", "block").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.count_distinct("page").alias("pages"))
    counted = written(counted.where(F.col("path").isNotNull() | (F.col("pages") >= RECURS_ON)), "votes")
    totals = counted.where("path IS NOT NULL").groupBy("host").agg(F.sum("n").alias("all"))
    is_path = F.col("path").isNotNull()
    wins = F.when(is_path & (F.col("n") >= WINS * F.col("all")), F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path"))
    several = F.when(is_path & (F.col("n") > 1) & (F.col("n") >= SEVERAL * F.col("all")), F.col("path"))
    recurs = F.when(~is_path & (F.col("n") >= RECURS * F.col("all")), F.col("block"))
    found = counted.join(totals, "host").groupBy("host").agg(
        F.sort_array(F.collect_list(wins))["path"].alias("paths"),
        F.collect_list(several).alias("named"),
        F.coalesce(F.max(is_path & (F.col("n") * 2 > F.col("all"))), F.lit(False)).alias("outvotes"),
        F.collect_list(recurs).alias("recurring"),
    )
    return found.where((F.size("paths") > 0) | (F.size("named") > 0) | (F.size("recurring") > 0))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for each row of ``pages``.

    The whole html is read; a null one is empty and gives an empty text.  A null or hostless url
    leaves the page to its own container.  Repeated rows stay repeated and vote each; other columns
    are left out; an empty table gives an empty table.
    """
    agreed = written(consensus(votes(pages)), "host_consensus")
    few = (agreed.agg(F.sum(F.size("paths") + F.size("named") + F.size("recurring"))).head()[0] or 0) <= BROADCAST_PATHS

    def run(batches):
        for b in batches:
            texts = [parse(source).text(*host) for source, *host in zip(*(b.column(i).to_pylist() for i in range(2, 7)))]
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).join(F.broadcast(agreed) if few else agreed, "host", "left")
    return rows.select("page_id", "url", "html", "paths", "named", "outvotes", "recurring").mapInArrow(run, "page_id long, url string, text string, n_chars long")
