"""Main text of web pages: each host's template is deduced from equivalence classes of tokens, and its main slot read.

Tokens are a page's containers (elements that hold blocks), told apart by their place, and on pages that mark no article
also its texts, told apart by container. Tokens that occur in the same pages equally often have one occurrence vector
and form a class; classes that many pages have and whose tokens lie within tokens of classes as frequent nest into the
template. What lies between the template's texts is what differs from page to page: where most of it is, is the slot of
the article. Where texts do not differ, what the template's containers hold on the mean of the host's pages tells the
slot from menus, adverts and notices. Markup that says what it is (nav, footer, article) is believed; names in class, id
and role only decide about small parts beside or within the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, cut
from quire.llm.url_model import host_of

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that hold blocks; others (paragraphs, headings, cells) count as what lies within.
CONTAINERS = set("html body div section article main header footer nav aside ul ol dl table blockquote figure form fieldset details center".split())
#: Cells of tables that lay out a page, as those outside of articles may, hold blocks as well.
CELLS = {"td", "th"}
#: Elements whose text is never part of the article, and such that are not unless within the article.
DROPPED = set("head title script style noscript template iframe object svg canvas nav footer aside form button select option textarea input dialog menu".split())
DROPPED_OUTSIDE = {"header"}
#: Words of class, id and role that tell of adverts, menus and the like, and words before them that say otherwise.
ROLES = set("ad ads advert adverts advertisement adverts sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended comment comments reply replies discussion disqus footer masthead contentinfo complementary login search toolbar widget form banner topbar alert".split())
DENIED = set("no not non has have with without is hide hidden show".split())
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}

#: A class belongs to a host's template if it occurs in this share of its pages.
MIN_SHARE = 0.5
#: A container with this share of its own in its text is not a mere frame of what it holds.
OWN_SHARE = 0.2
#: Of parts side by side those with this share of the largest one's text are parts of the article.
PART_SHARE = 0.3
#: A part named like an advert is dropped if it has less than this share of the article; one of links has this share in
#: links.
NAMED_SHARE, LINK_SHARE = 0.5, 0.8
#: Texts are taken for the template's if the host has so many different pages that mark no article; and a page is read
#: by what differs if that is at least this share of what is read without.
LEAST_PAGES, OWN_TEXT = 3, 0.15
#: Templates measured to be at most so many bytes are broadcast; beyond that a host's pages go to so many tasks.
MOST_BROADCAST, SALTS = 8 << 20, 64


def token(*parts: str) -> int:
    h = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Node:
    """A container of a page. chars and links: of its own blocks, those in links and others."""

    token: int
    parent: int
    tag: str = ""
    told: bool = False
    article: bool = False
    prose: float = 0.0
    links: float = 0.0
    text: int = 0
    inside: list[int] = field(default_factory=list)


@dataclass
class Open:
    tag: str
    node: int
    dropped: bool
    article: bool
    link: bool


def names_of(marks: str) -> bool:
    """Whether class, id and role tell of a part that is not the article."""
    for name in marks.split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if any(w in ROLES and not (i and words[i - 1] in DENIED) for i, w in enumerate(words)):
            return True
    return False


TAG_NAME = re.compile(r"[A-Za-z][^\t\n\r\f />]*+")
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"?)|'([^']*+)('?)|([^\s>]*+)))?+")
BETWEEN = re.compile(r"[\s/]*+")
END_OF_COMMENT = re.compile(r"--!?>")
#: Elements whose content is text up to their own end tag.
RAW = {t: re.compile(rf"</{t}(?=[\t\n\r\f />])", re.I) for t in "script style iframe textarea title xmp noembed noframes".split()}
ZEROS, TOO_LARGE = re.compile(r"(&#[xX]?)0++(?=[0-9A-Fa-f])"), re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9A-Fa-f]{7,}+);?")


def decoded(text: str) -> str:
    """text with its character references resolved, numbers of any length among them."""
    if "&" not in text:
        return text
    return unescape(TOO_LARGE.sub("\ufffd", ZEROS.sub(r"\1", text)) if "&#" in text else text)


def markup(html: str) -> Iterator[tuple[str, str, list[tuple[str, str | None]], bool]]:
    """(kind, name or text, attributes, closed at once) of what a page consists of: kinds are start, end and text.

    Each character is looked at a bounded number of times, whatever the page. A tag or comment that nothing ends reaches
    to the end of the page, as in browsers; a < that opens nothing is text.
    """
    at, n = 0, len(html)
    while at < n:
        open_ = html.find("<", at)
        if open_ < 0:
            open_ = n
        if open_ > at:
            yield "text", decoded(html[at:open_]), [], False
        at = open_
        if at >= n:
            return
        following = html[at + 1 : at + 2]
        if following in ("!", "?") or (following == "/" and not TAG_NAME.match(html, at + 2)):
            if html.startswith("<!--", at):
                short = html.startswith((">", "->"), at + 4)  # an empty comment
                found = None if short else END_OF_COMMENT.search(html, at + 4)
                at = html.index(">", at) + 1 if short else found.end() if found else n
            else:
                at = html.find(">", at) + 1 or n
        elif following == "/":
            name = TAG_NAME.match(html, at + 2)
            yield "end", name.group().lower(), [], False
            at = html.find(">", name.end()) + 1 or n
        elif name := TAG_NAME.match(html, at + 1):
            tag, attrs, at = name.group().lower(), [], BETWEEN.match(html, name.end()).end()
            while at < n and html[at] != ">":
                a = ATTRIBUTE.match(html, at)
                value = next((v for v in (a[2], a[4], a[6]) if v is not None), None)
                attrs.append((a[1].lower(), None if value is None else decoded(value)))
                at = n if a[3] == "" or a[5] == "" else BETWEEN.match(html, a.end()).end()
            if at >= n:
                return
            at += 1
            yield "start", tag, attrs, html[at - 2] == "/"
            if tag in RAW and html[at - 2] != "/":
                end = RAW[tag].search(html, at)
                yield "text", html[at : end.start() if end else n], [], False
                at = end.start() if end else n
        else:
            yield "text", "<", [], False
            at += 1


class Outline:
    """A page's containers as a tree, and its blocks of text in order as (text, container)."""

    def __init__(self) -> None:
        self.nodes = [Node(token(""), -1)]
        self.stack = [Open("", 0, False, False, False)]
        self.open: dict[str, list[int]] = {}  # where in the stack each tag is open
        self.blocks: list[tuple[str, int]] = []
        self.seen: dict[tuple[int, str], int] = {}
        self.held: list[str] = []
        self.link_chars = 0

    @classmethod
    def of(cls, html: str | None) -> Outline:
        page = cls()
        for kind, what, attrs, closed in markup(html or ""):
            if kind == "text":
                page.add_text(what)
            elif kind == "end":
                page.close(what)
            else:
                page.start(what, attrs)
                if closed:
                    page.close(what)
        page.flush()
        return page

    def flush(self) -> None:
        if text := " ".join("".join(self.held).split()):
            node = self.nodes[self.stack[-1].node]
            self.blocks.append((text, self.stack[-1].node))
            node.links += min(self.link_chars, len(text))
            node.prose += max(len(text) - self.link_chars, 0)
            node.text = token(str(node.text), text)
        self.held, self.link_chars = [], 0

    def marked(self) -> bool:
        return any(n.article for n in self.nodes)

    def text_tokens(self) -> list[int]:
        """Of each block a token: its text and the container that it lies in."""
        return [token(str(self.nodes[i].token), "text", text) for text, i in self.blocks]

    def push(self, entry: Open) -> None:
        self.open.setdefault(entry.tag, []).append(len(self.stack))
        self.stack.append(entry)

    def pop_to(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """Closes the last open one of tags with all that it holds, unless one of stop was opened since."""
        last = lambda names: max((self.open[t][-1] for t in names if self.open.get(t)), default=0)
        at = last(tags)
        if at > last(stop):
            for entry in self.stack[at:]:
                self.open[entry.tag].pop()
            del self.stack[at:]

    def start(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
            self.pop_to(("p",), ("table", "td", "th", "button", "object"))
        if tag in CLOSES:
            names, stop = CLOSES[tag]
            self.pop_to(tuple(names.split()), tuple(stop))
        if tag == "br":
            self.held.append("\n")
        if tag in VOID:
            return
        up = self.stack[-1]
        has = {k: v or "" for k, v in attrs}
        marks = " ".join(has.get(k, "") for k in ("class", "id", "role"))
        told = tag not in INLINE and bool(marks.strip()) and names_of(marks)
        own = tag in ("article", "main") or has.get("role") == "main"
        article = up.article or own
        dropped = up.dropped or tag in DROPPED or "hidden" in has or (not article and tag in DROPPED_OUTSIDE)
        at = up.node
        if not dropped and (tag in CONTAINERS or told or (tag in CELLS and not up.article)):
            kind = tag + "." + re.sub(r"[0-9]+", "#", marks)
            n = self.seen[at, kind] = self.seen.get((at, kind), 0) + 1
            self.nodes[at].inside.append(len(self.nodes))
            self.nodes.append(Node(token(str(self.nodes[at].token), kind, str(n)), at, tag, told, own))
            at = len(self.nodes) - 1
        self.push(Open(tag, at, dropped, article, up.link or tag == "a"))

    def close(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self.pop_to((tag,), ("td", "th", "table") if tag in INLINE or tag == "p" else ())

    def add_text(self, data: str) -> None:
        top = self.stack[-1]
        if not top.dropped:
            self.held.append(data)
            self.link_chars += len(data) * top.link


@dataclass
class Seen:
    """What is summed up of one token of one host."""

    pages: int = 0
    vector: list[int] = field(default_factory=lambda: [0, 0])
    prose: int = 0
    links: int = 0
    least: int = 1 << 62
    most: int = -(1 << 62)


LONGS = ("token", "parent", "page", "pages", "vector_a", "vector_b", "prose", "links", "least", "most")
#: In the place of a token, the page itself.
WHOLE = 0


def occurrence_vectors(pages: DataFrame, flush_at: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(containers, texts), each with one row per token of a host: token, parent, pages, vector; and of containers prose,
    links, least and most.

    vector is a signature of the vector of counts over the host's pages: two sums of 31-bit hashes of page and count, so
    repeated rows add up and a host of any number of pages is summed up with map-side combine. Tasks sum up before they
    emit. least and most are of the hash of the token's own text: equal if it is the same in all pages. Texts are those
    of pages that mark no article; pages of one content count once there, and token WHOLE counts them.
    """

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[tuple, Seen] = {}

        def flush() -> Iterator[tuple]:
            for (host, t, parent, page), s in held.items():
                yield host, t, parent, page, s.pages, *s.vector, s.prose, s.links, s.least, s.most
            held.clear()

        for host, page_id, html in it:
            page = Outline.of(html)
            mark = token(str(page_id), "1") & ((1 << 62) - 1)  # the place tells containers apart: each occurs once
            for n in page.nodes:
                s = held.setdefault((host, n.token, page.nodes[n.parent].token if n.parent >= 0 else 0, None), Seen())
                s.pages += 1
                s.vector[0] += mark >> 31
                s.vector[1] += mark & ((1 << 31) - 1)
                s.prose, s.links = s.prose + int(n.prose), s.links + int(n.links)
                s.least, s.most = min(s.least, n.text >> 2), max(s.most, n.text >> 2)
            if not page.marked():
                texts = page.text_tokens()
                content = token(*map(str, texts))
                for t in {WHOLE, *texts}:
                    held.setdefault((host, t, None, content), Seen()).pages = 1
            if len(held) >= flush_at:
                yield from flush()
        yield from flush()

    arrow = pa.schema([("host", pa.string()), *((c, pa.int64()) for c in LONGS)])
    parts = cut(arrow_map(pages, rows, f"host string, {', '.join(f'{c} long' for c in LONGS)}", arrow, chunk=64))
    sums = [F.sum(c).alias(c) for c in ("pages", "vector_a", "vector_b", "prose", "links")]
    containers = parts.where("page is null").groupBy("host", "token", "parent").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"))
    each = parts.where("page is not null").select("host", "token", "page").distinct()
    marks = [F.sum(F.shiftright("page", n).bitwiseAND((1 << 31) - 1)).alias(v) for v, n in (("vector_a", 0), ("vector_b", 32))]
    return containers, each.groupBy("host", "token").agg(F.count("*").alias("pages"), *marks)


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, texts): the containers of each host's template, as structs of token, prose and links on the mean of
    the pages that have it, and fixed: its own text is the same in all pages of the host, of which there are two or
    more; and the template's texts, or null.

    Tokens of a host with one occurrence vector are an equivalence class. A class is valid if MIN_SHARE of the host's
    pages have it and its tokens nest: each one's parent is a token that as many pages have. The class of the page
    itself, which all pages have, is the template's root; the others lie in it or in one another.
    """
    tokens, texts = map(cut, occurrence_vectors(pages))
    hosts = tokens.where("parent = 0").groupBy("host").agg(F.sum("pages").alias("n_pages"))
    # A host may hold a third of all tokens, so they meet their host's figures in SALTS places.
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = tokens.withColumn("salt", F.pmod("token", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"]).drop("salt")
    often = cut(dealt.where(F.col("pages") >= MIN_SHARE * F.col("n_pages")))  # fewer for each host than two pages have
    parents = often.select("host", F.col("token").alias("parent"), F.col("pages").alias("parent_pages"))
    nests = (F.col("parent") == 0) | F.coalesce(F.col("parent_pages") >= F.col("pages"), F.lit(False))
    mean = lambda c: (F.col(c) / F.col("pages")).alias(c)
    fixed = ((F.col("least") == F.col("most")) & (F.col("pages") == F.col("n_pages")) & (F.col("n_pages") > 1)).alias("fixed")
    member = F.struct("token", mean("prose"), mean("links"), fixed)
    classes = often.join(parents, ["host", "parent"], "left").groupBy("host", "vector_a", "vector_b", "pages").agg(F.bool_and(nests).alias("valid"), F.collect_list(member).alias("members"))
    containers = classes.where("valid").groupBy("host").agg(F.flatten(F.collect_list("members")).alias("tokens"))
    # Texts lie in containers that at least as many pages have. A class has fewer members than two pages have texts.
    whole = texts.where(F.col("token") == WHOLE).where(F.col("pages") >= LEAST_PAGES).select("host", F.col("pages").alias("n_pages"))
    often = texts.where(F.col("token") != WHOLE).where("pages > 1").join(whole, "host").where(F.col("pages") >= MIN_SHARE * F.col("n_pages"))
    same = often.groupBy("host", "vector_a", "vector_b", "pages").agg(F.collect_list("token").alias("members"))
    return containers.join(same.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("texts")), "host", "left")


def slots(page: Outline, template: dict[int, tuple[float, float, bool]] | None = None, texts: set[int] | frozenset[int] = frozenset()) -> str:
    """The text of the article: the blocks of the page's main slots, in order; of a page that marks no article those
    that are not texts of the template, if what is left is not too little to be read by."""
    whole = main_slots(page, template or {}, None)
    if not texts or page.marked():
        return whole
    differs = [t not in texts for t in page.text_tokens()]
    own = main_slots(page, template or {}, differs)
    return own if len(own) >= OWN_TEXT * len(whole) else whole


def main_slots(page: Outline, template: dict[int, tuple[float, float, bool]], differs: list[bool] | None) -> str:
    """The blocks of the main slots, in order; with `differs`, which tells for each block whether it is the page's own,
    only such count.

    From the page downwards a container that mostly frames others is left for those of them that hold most text; one
    with much text of its own, with some and parts that all belong to the article, or marked as one, is the slot. A container of the template counts as its host's
    mean, another as it is. Within the slot parts go that are named like adverts and small, that (unless the slot is
    marked as an article) hold links only, or that repeat one text in all pages of a host whose articles differ.
    """
    nodes = page.nodes
    prose, links, marked = [0.0] * len(nodes), [0.0] * len(nodes), [False] * len(nodes)
    if differs is None:
        own = [template.get(n.token, (n.prose, n.links, False)) for n in nodes]
    else:
        own = [(0.0, 0.0, False)] * len(nodes)
        for (text, i), is_own in zip(page.blocks, differs):
            share = nodes[i].links / max(nodes[i].links + nodes[i].prose, 1) if is_own else 0.0
            own[i] = own[i][0] + is_own * len(text) * (1 - share), own[i][1] + is_own * len(text) * share, False
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        prose[i] += own[i][0]
        links[i] += own[i][1]
        marked[i] |= nodes[i].article
        if nodes[i].parent >= 0 and not (nodes[i].told and not marked[i]):
            up = nodes[i].parent
            prose[up], links[up], marked[up] = prose[up] + prose[i], links[up] + links[i], marked[up] or marked[i]
    mostly_links = lambda i: links[i] >= LINK_SHARE * (links[i] + prose[i]) and links[i] > 0
    main: set[int] = set()
    todo = [0]
    while todo:
        i = todo.pop()
        n = nodes[i]
        held = [k for k in n.inside if marked[k] or not (nodes[k].told or mostly_links(k))]
        believed = n.article and (n.tag == "article" or not any(marked[k] for k in n.inside))  # a main may frame articles
        if believed or not held or (own[i][0] >= OWN_SHARE * prose[i] and not any(marked[k] for k in held)):
            main.add(i)
            continue
        most = max(prose[k] for k in held)
        least = PART_SHARE * max((prose[k] for k in held if marked[k]), default=most)
        parts = [k for k in held if marked[k] or prose[k] >= least]
        if own[i][0] and not any(marked[k] for k in held) and all(k in parts or not prose[k] for k in held):
            main.add(i)  # all that it holds is of the article, and so is what it says itself, a heading mostly
        else:
            todo += parts
    slot = [-1] * len(nodes)  # the main slot that a container lies in, or -1
    for i, n in enumerate(nodes):
        up = n.parent
        if i in main:
            slot[i] = i
        elif up >= 0 and slot[up] >= 0:
            top = slot[up]
            named = n.told and not marked[i] and prose[i] < NAMED_SHARE * prose[top]
            menu = not nodes[top].article and mostly_links(i)
            repeated = own[i][2] and not own[top][2] and not n.inside and prose[i] < NAMED_SHARE * prose[top]
            slot[i] = -1 if named or menu or repeated else top
    return "\n".join(text for k, (text, i) in enumerate(page.blocks) if slot[i] >= 0 and (differs is None or differs[k]))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null html is an empty page; text is empty where a page has none. Pages of one host share its template; a null url
    has the empty host. The template of a host of one page is that page: nothing is told apart by the number of pages.
    Repeated rows are extracted alike; an empty table gives no rows. Other columns are not read.
    """
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host_of(F.col(url)).alias("host"))
    templates = cut(deduce_templates(p.select("host", "page_id", "html")))

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        known: dict[str, tuple[dict, set]] = {}
        for i, u, h, host, tokens, texts in it:
            if len(known) > 1000:
                known.clear()
            if host not in known:
                known[host] = {t["token"]: (t["prose"], t["links"], t["fixed"]) for t in tokens or ()}, set(texts or ())
            text = slots(Outline.of(h), *known[host])
            yield i, u, text, len(text)

    size = templates.agg(F.coalesce(F.sum(F.length("host") * 4 + 64 + 40 * F.size("tokens") + 8 * F.coalesce(F.size("texts"), F.lit(0))), F.lit(0)).alias("bytes")).first().bytes
    if size <= MOST_BROADCAST:
        joined = p.join(F.broadcast(templates), "host", "left")
    else:  # the pages of a host of any size are dealt to SALTS tasks
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "host", "tokens", "texts")
    return arrow_map(joined, rows, "page_id long, url string, text string, n_chars long", pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]), chunk=64)
