"""Main text of web pages by site template removal.

Pass 1 parses every page, hashes each element subtree (tag, class, id, text)
and counts, per host, the distinct pages that hold it: pages whose text is the
same once what says to be boilerplate is gone are copies and count as one.  A
subtree on at least ``MIN_PAGES`` distinct pages of its host belongs to the
site's template, however many pages the host has.

Pass 2 parses again, deletes template subtrees and elements that say what they
are (nav, footer, aside, form, script ..., or such a class, id or role), and
joins the text of the blocks that remain.  Where the page marks its article
(every outermost ``main``, else every outermost ``article`` where they are more
than headings or teasers), only that is taken, and nothing within it is deleted
as a template: shared articles are articles.  The one exception is a container
(div, section) of nothing but links, which goes if it is on ``MIN_PAGES`` pages,
copies or not.  On a page that marks no article, a subtree that holds most
(``MOST``) of the text stays too.

A name tells what its element is as a whole or by its last part (``ad-box``,
``site-footer``), not as any word in it.  Names do not count for html and body,
for ``main`` and what is around it, nor, where every ``article`` would be lost,
for one, or what is around one, that holds most of the page's text.

Text: character references decoded in each text node by itself, white space inside a block is one space,
blocks are trimmed and joined in page order by one space.

Defined cases: null html is an empty page and gives empty text; unclosed and
stray tags are tolerated, in time linear in the page; a quote or tag that is open
to the end of the page ends at the next bracket; null or odd urls share the empty host; repeated rows
count as copies and are extracted alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import checkpoint, hash128

#: Template hashes (16 bytes each) up to which the whole table is sent to every task; beyond, each page is joined to its own.
BROADCAST_HASHES = 500_000
MIN_PAGES = 3
#: Share of a page's text above which a subtree is taken for the page's own text.
MOST = 0.75
#: Share of the text that nothing says to be boilerplate below which a marked article is taken for a heading or teaser.
LEAST = 0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label ruby rb rt rp img".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
DROP_TAGS = frozenset("head script style noscript template nav footer aside form button select option textarea iframe svg canvas object embed dialog menu title xmp noembed noframes audio video map".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
DROP_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adslot adunit adsense adbanner sponsor sponsored promo promotion banner sidebar rail nav navbar navigation menu
    breadcrumb breadcrumbs footer sidenav subnav cookie cookies cookiebar cookiebanner consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription
    signup login social share sharing related recommended recommendations comment comments reply replies disqus discussion respond widget toolbar
    pagination pager copyright disclaimer legal search masthead topbar skip hidden""".split()
)
#: First parts of names that speak of something else: a wrapper that has a sidebar is none.
STATES = frozenset("has have with no not without".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul dd dt".split()
)
#: An opening tag ends an open element of the first set, unless one of the second set is nearer.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Tags that an opening tag may end, and the tags beyond which it does not look, by the opening tag; "p" stands for all of CLOSES_P.
_RULES = {"p": (frozenset(["p"]), frozenset(["button", "table", "td", "div", "section", "article"])), **ENDS}
_RULES_OF: dict[str, list[str]] = {}
for _rule, (_these, _unless) in _RULES.items():
    for _tag in _these | _unless:
        _RULES_OF.setdefault(_tag, []).append(_rule)

#: A whole tag: a quote counts only after an equals sign.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
#: What stands for a tag where no whole one is left: up to the next bracket.
_BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>?")
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?")
_KEPT_ATTRIBUTES = frozenset("class id role hidden style aria-hidden".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|$)", re.I) for tag in RAW}
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")


class Tree:
    """Elements in page order; kids are texts (decoded, each by itself) and element numbers, parents come before their kids.

    One pass forward: every character is looked at a bounded number of times,
    whatever is unclosed or stray.
    """

    def __init__(self, html: str) -> None:
        self.tags, self.attrs, self.parent, self.kids = ["#root"], [{}], [-1], [[]]
        self._stack = stack = [0]
        self._marks: dict[str, list[int]] = {rule: [] for rule in _RULES}  # by rule: places in the stack of the tags it looks for
        self._open: Counter[str] = Counter()  # open elements by tag
        self._lines: list[Counter[str]] = [Counter()]  # open inline elements by tag, within each open block
        tags, kids = self.tags, self.kids
        at, end, pattern = 0, len(html), _TAG
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                lt = end
            if lt > at:
                kids[stack[-1]].append(unescape(html[at:lt]))
            if lt == end:
                break
            after = html[lt + 1 : lt + 2]
            if after in "!?" and after:
                at = self._skip(html, lt)
                continue
            m = pattern.match(html, lt)
            if not m and pattern is _TAG and _BROKEN_TAG.match(html, lt):
                pattern = _BROKEN_TAG  # a quote or tag that is open to the end of the page: no later one is whole past it
                m = pattern.match(html, lt)
            if not m:  # no markup at all
                kids[stack[-1]].append("<")
                at = lt + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            if tag in CLOSES_P:
                self._end("p")
            if tag in ENDS:
                self._end(tag)
            node = len(tags)
            tags.append(tag)
            self.attrs.append(self._attributes(m[3]) if m[3] else {})
            self.parent.append(stack[-1])
            kids.append([])
            kids[stack[-1]].append(node)
            if tag in RAW:
                close = _RAW_ENDS[tag].search(html, at)
                kids[node].append(html[at : close.start()] if close else html[at:])
                at = close.end() if close else end
            elif tag not in VOID and not m[3].endswith("/"):
                self._push(node, tag)
        del self._stack, self._marks, self._open, self._lines

    @staticmethod
    def _skip(html: str, lt: int) -> int:
        """The end of a comment, declaration or instruction; one that is not closed goes to the end of the page."""
        if html.startswith("<!--", lt):
            if html.startswith(("<!-->", "<!--->"), lt):
                return html.index(">", lt) + 1
            close = html.find("-->", lt + 4)
            return close + 3 if close >= 0 else len(html)
        close = html.find(">", lt)
        return close + 1 if close >= 0 else len(html)

    @staticmethod
    def _attributes(text: str) -> dict[str, str]:
        out: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(text):
            name = m[1].lower()
            if name in _KEPT_ATTRIBUTES and name not in out:
                out[name] = m[2] or m[3] or m[4] or ""
        return out

    def _push(self, node: int, tag: str) -> None:
        for rule in _RULES_OF.get(tag, ()):
            self._marks[rule].append(len(self._stack))
        self._stack.append(node)
        self._open[tag] += 1
        if tag in INLINE:
            self._lines[-1][tag] += 1
        else:
            self._lines.append(Counter())

    def _cut(self, depth: int) -> None:
        """Close what is open from this place of the stack on."""
        for node in reversed(self._stack[depth:]):
            tag = self.tags[node]
            self._open[tag] -= 1
            if tag in INLINE:
                self._lines[-1][tag] -= 1
            else:
                self._lines.pop()
            for rule in _RULES_OF.get(tag, ()):
                self._marks[rule].pop()
        del self._stack[depth:]

    def _end(self, rule: str) -> None:
        marks = self._marks[rule]
        if marks and self.tags[self._stack[marks[-1]]] in _RULES[rule][0]:
            self._cut(marks[-1])

    def _close(self, tag: str) -> None:
        # an inline end tag does not close blocks
        if not (self._lines[-1][tag] if tag in INLINE else self._open[tag]):
            return
        depth = len(self._stack) - 1
        while self.tags[self._stack[depth]] != tag:
            depth -= 1
        self._cut(depth)

    def hashes(self) -> list[bytes]:
        """Hash of each subtree, kids first."""
        out: list[bytes] = [b""] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            a = self.attrs[i]
            h = xxhash.xxh3_128(f"{self.tags[i]}|{a.get('class', '')}|{a.get('id', '')}".encode("utf-8", "replace"))
            for k in self.kids[i]:
                h.update(out[k] if isinstance(k, int) else " ".join(k.split()).encode("utf-8", "replace"))
            out[i] = h.digest()
        return out

    def says_boilerplate(self, i: int) -> bool:
        tag, a = self.tags[i], self.attrs[i]
        if tag in DROP_TAGS:
            return True
        if not a:
            return False
        if self.hidden(i) or a.get("role", "").lower() in DROP_ROLES:
            return True
        return i not in self.spared and any(map(_names_boilerplate, f"{a.get('class', '')} {a.get('id', '')}".split()))

    @cached_property
    def weights(self) -> list[int]:
        """Characters of text in each subtree that no tag says to be boilerplate."""
        out = [0] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            if self.tags[i] not in DROP_TAGS:
                out[i] = sum(out[k] if isinstance(k, int) else len("".join(k.split())) for k in self.kids[i])
        return out

    def holds_most(self, i: int) -> bool:
        return self.weights[i] > MOST * self.weights[0]

    @cached_property
    def spared(self) -> set[int]:
        """Elements whose names do not count."""
        self.spared = out = {i for i, tag in enumerate(self.tags) if tag in ("html", "body")}
        for i, tag in enumerate(self.tags):
            if tag == "main" or self.attrs[i].get("role", "").lower() == "main":
                while i > 0 and i not in out:
                    out.add(i)
                    i = self.parent[i]
        if "article" in self.tags and not self.roots():
            for i, tag in enumerate(self.tags):
                while tag == "article" and i > 0 and i not in out:
                    if self.holds_most(i):
                        out.add(i)
                    i = self.parent[i]
        return out

    def hidden(self, i: int) -> bool:
        a = self.attrs[i]
        return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(a.get("style", "")))

    def roots(self) -> list[int]:
        """The elements that hold the article: the outermost mains, else the outermost articles; none if the page marks none, or articles that hold only a little of its text."""
        inside = [False] * len(self.tags)  # within an element that says it is boilerplate
        mains, articles = [], []
        held, held_main = [False] * len(self.tags), [False] * len(self.tags)  # within one found already
        plain = [0] * len(self.tags)
        for i in range(1, len(self.tags)):
            p, tag = self.parent[i], self.tags[i]
            main = tag == "main" or self.attrs[i].get("role", "").lower() == "main"
            inside[i] = inside[p] or (self.hidden(i) if main else self.says_boilerplate(i))
            held[i], held_main[i] = held[p], held_main[p]
            if not inside[i]:
                plain[i] = sum(len("".join(k.split())) for k in self.kids[i] if isinstance(k, str))
                if main and not held_main[i]:
                    mains.append(i)
                    held_main[i] = True
                elif tag == "article" and not held[i]:
                    articles.append(i)
                    held[i] = True
        if not mains and sum(n for n, own in zip(plain, held) if own) < LEAST * sum(plain):
            return []
        return mains or articles

    def text(self, templates: frozenset[bytes] | set[bytes]) -> str:
        hashes = self.hashes() if templates else []
        roots = self.roots()
        above = set()
        for r in roots:
            p = r
            while p > 0:
                above.add(p)
                p = self.parent[p]
        pieces: list[str] = []
        blocks: list[str] = []

        def flush() -> None:
            words = "".join(pieces).split()
            if words:
                blocks.append(" ".join(words))
            pieces.clear()

        # of a main that holds articles only those are the article
        articles = {i for i, tag in enumerate(self.tags) if tag == "article"} if templates else set()
        around = set()
        for i in articles:
            while i > 0 and i not in around:
                around.add(i)
                i = self.parent[i]

        for root in roots or [0]:
            flush()
            work: list = [(root, bool(roots), root not in around or root in articles)]
            while work:
                item = work.pop()
                if item is None:
                    flush()
                    continue
                if isinstance(item, str):
                    pieces.append(item)
                    continue
                i, within, own = item
                own = own or i in articles
                tag = self.tags[i]
                if tag == "br":
                    pieces.append(" ")
                    continue
                if i not in above and i:
                    if self.says_boilerplate(i) or (tag == "header" and not within):
                        if tag not in INLINE:
                            flush()
                        continue
                    if templates and hashes[i] in templates and tag not in ("html", "body") and not self._stays(i, within, own, i in around):
                        flush()
                        continue
                block = tag not in INLINE
                if block:
                    flush()
                    work.append(None)
                work.extend((k, within, within and own) if isinstance(k, int) else k for k in reversed(self.kids[i]))
            flush()
        return " ".join(blocks)

    def _stays(self, i: int, within: bool, own: bool, around: bool) -> bool:
        """Whether a recurring subtree is text of the page all the same."""
        if not within:
            return self.holds_most(i)
        return around or (own and not self.only_links(i)) or self.tags[i] in PROSE or self.tags[i] in INLINE

    @cached_property
    def _plain(self) -> list[tuple[bool, bool]]:
        """Of each subtree: whether it has text outside links, and whether it has links."""
        out = [(False, False)] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            kids = [out[k] if isinstance(k, int) else (bool(k.strip()), False) for k in self.kids[i]]
            out[i] = (False, True) if self.tags[i] == "a" else (any(k[0] for k in kids), any(k[1] for k in kids))
        return out

    def only_links(self, i: int) -> bool:
        """A container all of whose text is in links."""
        return self.tags[i] in ("div", "section") and self._plain[i] == (False, True)

    def countable(self) -> dict[bytes, bool]:
        """Hashes of the block subtrees that hold anything, and whether it is only links."""
        hashes = self.hashes()
        return {
            hashes[i]: self.only_links(i)
            for i in range(1, len(self.tags))
            if self.tags[i] not in INLINE and self.tags[i] not in VOID and self.tags[i] not in RAW and self.kids[i]
        }


def _names_boilerplate(name: str) -> bool:
    parts = _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
    return bool(parts) and parts[0] not in STATES and (parts[-1] in DROP_NAMES or "".join(parts) in DROP_NAMES)


def extract(html: str | None, templates: set[bytes] | frozenset[bytes] = frozenset()) -> str:
    return Tree(html or "").text(templates)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, found, links, same = [], [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
            tree = Tree(html.as_py() or "")
            mine = tree.countable()
            hosts += [host] * len(mine)
            found += mine
            links += mine.values()
            same += [xxhash.xxh3_64_intdigest(tree.text(frozenset()).encode("utf-8", "replace")) - (1 << 63)] * len(mine)
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(found, pa.binary()), pa.array(links, pa.bool_()), pa.array(same, pa.int64())], ["host", "subtree", "links", "same"])


def templates(pages: DataFrame) -> DataFrame:
    """host, subtree for every template subtree."""
    hosted = pages.select(host_of(F.col("url")).alias("host"), "html")
    distinct = hosted.mapInArrow(_subtrees, "host string, subtree binary, links boolean, same long").groupBy("host", "subtree", "links", "same").agg(F.count(F.lit(1)).alias("n"))
    counted = distinct.groupBy("host", "subtree", "links").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n"))
    return counted.where((F.col("contexts") >= MIN_PAGES) | (F.col("links") & (F.col("n") >= MIN_PAGES))).select("host", "subtree")


SCHEMA = "page_id long, url string, text string, n_chars long"


def _extracted(batch: pa.RecordBatch, lists: Iterator[frozenset[bytes]]) -> pa.RecordBatch:
    out = [extract(html.as_py(), listed) for html, listed in zip(batch.column("html"), lists)]
    return pa.record_batch(
        [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"]
    )


def _extract_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _extracted(batch, (frozenset(listed.as_py() or ()) for listed in batch.column("templates")))


def _page_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, found = [], []
        for i, html in enumerate(batch.column("html")):
            mine = Tree(html.as_py() or "").countable()
            at += [i] * len(mine)
            found += mine
        rows = batch.select(["k1", "k2", "host"]).take(pa.array(at, pa.int64()))
        yield pa.record_batch([*rows.columns, pa.array(found, pa.binary())], ["k1", "k2", "host", "subtree"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """The columns of the query: page_id, url, text, n_chars for every page."""
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    listed = checkpoint(templates(pages))
    if listed.count() <= BROADCAST_HASHES:
        by_host: dict[str, list[bytes]] = {}
        for host, subtree in listed.collect():
            by_host.setdefault(host, []).append(bytes(subtree))
        shared = pages.sparkSession.sparkContext.broadcast({host: b"".join(sorted(subtrees)) for host, subtrees in by_host.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, frozenset[bytes]] = {}

            def of(host: str) -> frozenset[bytes]:
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    packed = shared.value.get(host, b"")
                    known[host] = frozenset(packed[i : i + 16] for i in range(0, len(packed), 16))
                return known[host]

            for batch in batches:
                yield _extracted(batch, map(of, batch.column("host").to_pylist()))

        return hosted.mapInArrow(run, SCHEMA)
    # beyond the checked size each page gets the templates it holds, so no row grows with its host; equal pages share a key
    keyed = hosted.withColumns(dict(zip(("k1", "k2"), hash128(F.col("host"), F.col("html")))))
    on_page = keyed.select("k1", "k2", "host", "html").mapInArrow(_page_subtrees, "k1 long, k2 long, host string, subtree binary")
    mine = on_page.join(listed, ["host", "subtree"]).groupBy("k1", "k2").agg(F.collect_set("subtree").alias("templates"))
    return keyed.join(mine, ["k1", "k2"], "left").mapInArrow(_extract_joined, SCHEMA)
