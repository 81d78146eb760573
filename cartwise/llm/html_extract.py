"""Main text of web pages by wrapper induction.

Pages of one host are dealt into blocks of about ``BLOCK`` pages.  In a block
the DOM trees are aligned with a reference page's by simple tree matching
(largest order-preserving match of the children of matched nodes).  A node
that has the same text on nearly all pages it aligns on is template; slots
that vary are content.  What a page's own mark-up calls navigation, notice,
advert, form or comment is not content, however it varies; an article or
main element, where a page has one, bounds the content.  But a class, an id or
a form says so only beside the content: one that holds it is released, and an
article that holds less of what varies than the rest of main or body doesn't
bound it.

A host with very many pages has very many blocks, so no task sees more than a
block's pages; the block comes from a hash of the page id.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from .common import arrow_bound, ship_package, written

BLOCK = 32
VOTERS = 4              # pages of different content that a template node needs
CONSTANT = 0.9          # share of those on which it has one text
COPY = 0.5              # pages that share more of what varies are copies, not voters
SAME = 0.1              # pages that vary in no more of their text are copies too
DEPTH = 200             # deeper elements hang on their ancestor of this depth
LITTLE = 0.1            # share of a page's varying text that is too little to be its content
BOUND = 0.5             # share of it that an article has to hold to bound the content
CELLS = 250_000         # of one child-list comparison; longer lists match in a band

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset(
    "aside button canvas dialog footer form head iframe input menu nav noscript object option "
    "script select style svg template textarea".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar "
                  "navigation search".split())
NAMES = frozenset(
    "ad adbox ads adslot adunit advert adverts advertisement advertising alert announcement "
    "banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination paywall popup promo promotion related replies reply responses share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
# inside an article these hold its own title
TITLES = frozenset({"header", "masthead"})
# an opening tag of the key closes an open element of the value
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"},
         "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_NAME = re.compile(r"[a-z]+")


class Node:
    """An element (tag, kids) or a text (tag '#text', text)."""

    __slots__ = ("tag", "text", "kids", "parent", "never", "named", "shape", "size")

    def __init__(self, tag: str, parent: "Node | None", text: str = ""):
        self.tag, self.parent, self.text = tag, parent, text
        self.kids: list[Node] = []
        self.never = False      # excluded
        self.named = False      # by a name or as a form only
        self.shape = self.size = 0


def _excluded(tag: str, attrs: list, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is excluded, and whether by a name or as a form only."""
    named = tag == "form"
    if not named and (tag in NEVER or (tag == "header" and not in_article)):
        return True, False
    for k, v in attrs:
        if k == "hidden" or (k == "aria-hidden" and v == "true"):
            return True, False
        if v and (k == "class" or k == "id"):
            found = NAMES.intersection(_NAME.findall(v.lower()))
            named = named or bool(found and not (in_article and found <= TITLES))
        elif v and k == "role" and v.lower() in ROLES:
            return True, False
        elif v and k == "style" and "display:none" in v.replace(" ", "").lower():
            return True, False
    return named, named


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", None)
        self.open = [self.root]

    def _close(self, tags, stops) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self._close(CLOSES[tag], STOPS[tag])
        if tag in BLOCKS:
            self._close({"p"}, BLOCKS - {"p"})
        parent = self.open[-1]
        node = Node(tag, parent)
        if attrs or tag in NEVER or tag == "header":
            node.never, node.named = _excluded(tag, attrs,
                                               any(n.tag == "article" for n in self.open))
        parent.kids.append(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        parent = self.open[-1]
        if parent.kids and parent.kids[-1].tag == "#text":
            parent.kids[-1].text += data
        else:
            parent.kids.append(Node("#text", parent, data))

    def unknown_decl(self, data):
        pass

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:      # an unknown declaration is a comment up to '>'
            return self.parse_bogus_comment(i)


def parse(html: str | None) -> Node:
    """The page's tree; mark-up that isn't closed ends where HTML lets it."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(reversed(n.kids))
    return out


def measure(nodes: list[Node], shapes: dict) -> None:
    """Number equal structures equally, and count their nodes."""
    for n in reversed(nodes):
        key = (n.tag, *[k.shape for k in n.kids])
        n.shape = shapes.setdefault(key, len(shapes) + 1)
        n.size = 1 + sum(k.size for k in n.kids)


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching of two measured trees: the matched pairs."""
    weights: dict[tuple[int, int], int] = {}

    def weight(x: Node, y: Node) -> int:
        if x.tag != y.tag:
            return 0
        if x.shape == y.shape:
            return x.size
        key = (x.shape, y.shape)
        if key not in weights:
            weights[key] = 1 + sum(weight(*p) for p in pairs(x.kids, y.kids))
        return weights[key]

    def pairs(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        if [x.shape for x in xs] == [y.shape for y in ys]:
            return list(zip(xs, ys))
        if not xs or not ys:
            return []
        n, m, half = len(xs), len(ys), len(ys)
        head: list[tuple[Node, Node]] = []
        tail: list[tuple[Node, Node]] = []
        if n * m > CELLS:
            # equal structures at the ends are in a largest match; of what is
            # left the table has a band along the diagonal
            k = next((k for k, (x, y) in enumerate(zip(xs, ys)) if x.shape != y.shape), min(n, m))
            head, xs, ys = list(zip(xs[:k], ys[:k])), xs[k:], ys[k:]
            k = next((k for k, (x, y) in enumerate(zip(xs[::-1], ys[::-1]))
                      if x.shape != y.shape), min(len(xs), len(ys)))
            n, m = len(xs) - k, len(ys) - k
            tail, xs, ys = list(zip(xs[n:], ys[m:])), xs[:n], ys[:m]
            half = m if n * m <= CELLS else max(4, 2 * CELLS // n)
        lo = [max(0, i * m // max(1, n) - half) for i in range(n + 1)]
        hi = [min(m, (i + 1) * m // max(1, n) + half) for i in range(n + 1)]
        best = [[0] * (hi[0] + 1)]
        gain = []
        for i, x in enumerate(xs, 1):
            up, first, last = best[-1], lo[i - 1], hi[i - 1]
            row, g, most = [], [], 0
            for j in range(lo[i], hi[i] + 1):
                # right of its band a row is as at the band's end
                w = weight(x, ys[j - 1]) if j > first else 0
                most = max(up[min(j, last) - first], most,
                           up[min(j - 1, last) - first] + w if w else 0)
                g.append(w)
                row.append(most)
            best.append(row)
            gain.append(g)
        out, i, j = [], n, m
        while i and j and j >= lo[i]:
            here, w = best[i][j - lo[i]], gain[i - 1][j - lo[i]]
            first, last = lo[i - 1], hi[i - 1]
            if w and here == best[i - 1][min(j - 1, last) - first] + w:
                out.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, min(j - 1, last)
            elif here == best[i - 1][min(j, last) - first]:
                i, j = i - 1, min(j, last)
            else:
                j -= 1
        return head + out[::-1] + tail

    out, todo = [], [(a, b)] if a.tag == b.tag else []
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        todo.extend(pairs(x.kids, y.kids))
    return out


def _varying(nodes: list[Node], template: set[int], named: bool) -> dict[int, int]:
    """For each element the characters below it that vary and aren't excluded;
    with ``named`` those that only a name or a form excludes count too."""
    out: dict[int, int] = {}
    for n in reversed(nodes):
        if n.never and not (named and n.named):
            out[id(n)] = 0
        elif n.tag == "#text":
            out[id(n)] = 0 if id(n) in template else sum(map(len, n.text.split()))
        else:
            out[id(n)] = sum(out[id(k)] for k in n.kids)
    return out


def _outermost(nodes: list[Node], wanted) -> list[Node]:
    """The outermost elements that ``wanted`` accepts and nothing excludes."""
    found, skip = [], set()
    for n in nodes:
        if n.parent is not None and id(n.parent) in skip:
            skip.add(id(n))
        elif wanted(n):
            found.append(n)
            skip.add(id(n))
        elif n.never:
            skip.add(id(n))
    return found


def release(nodes: list[Node], template: set[int]) -> None:
    """Undo exclusions by name or as a form, the outermost first, of what holds
    the content: the only article or main, or those with most of the page's
    varying text, where none is left; and where little of that text is left,
    any article or main, or most of the text.  (That a comment section is longer
    than its article doesn't release it.)"""
    if not any(n.named and n.never for n in nodes):
        return
    whole = _varying(nodes, template, True)
    total = whole[id(nodes[0])]
    bounds: dict[int, int] = {}                 # articles and mains with text, outermost
    for n in reversed(nodes):
        if n.tag in ("article", "main") and whole[id(n)]:
            bounds[id(n)] = 1
        else:
            bounds[id(n)] = sum(bounds[id(k)] for k in n.kids) if whole[id(n)] else 0
    while total:
        left = _varying(nodes, template, False)
        little = left[id(nodes[0])] < LITTLE * total
        none = not any(n.tag in ("article", "main") and left[id(n)] and not n.never
                       for n in _outermost(nodes, lambda n: n.tag in ("article", "main")))
        out = []
        for n in _outermost(nodes, lambda n: n.never and n.named):
            held, most = bounds[id(n)], 2 * whole[id(n)] > total
            if (none and (held == 1 or held and most)) or (little and (held or most)):
                out.append(n)
        if not out:
            return
        for n in out:
            n.never = False


def scope(nodes: list[Node], template: set[int] = frozenset()) -> list[Node]:
    """The elements that bound the content: outermost articles, else main
    elements, else the body, else the whole page.  Articles or a main element
    that hold less than ``BOUND`` of the varying text of the next don't."""
    size = _varying(nodes, template, False)
    held = lambda found: sum(size[id(n)] for n in found)
    best: list[Node] = []
    for tag in ("article", "main", "body", "#root"):
        found = _outermost(nodes, lambda n: n.tag == tag and not n.never)  # noqa: B023
        if found and (not best or held(best) < BOUND * held(found)):
            best = found
    return best or nodes[:1]


def content_text(roots: list[Node], template: set[int]) -> str:
    """Blocks in page order, without excluded and template nodes."""
    blocks: list[str] = []
    parts: list[str] = []

    def flush():
        if parts:
            t = " ".join("".join(parts).split())
            if t:
                blocks.append(t)
            parts.clear()

    todo: list = list(reversed(roots))
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif n.never or id(n) in template:
            continue
        elif n.tag == "#text":
            parts.append(n.text)
        elif n.tag == "br":
            parts.append(" ")
        elif n.tag in BLOCKS:
            flush()
            todo.append(None)
            todo.extend(reversed(n.kids))
        else:
            todo.extend(reversed(n.kids))
    flush()
    return " ".join(blocks)


def _shown(nodes: list[Node]) -> list[int]:
    """Ids of the texts that nothing but a name or a form excludes."""
    out, skip = [], set()
    for n in nodes:
        if (n.never and not n.named) or (n.parent is not None and id(n.parent) in skip):
            skip.add(id(n))
        elif n.tag == "#text":
            out.append(id(n))
    return out


def induce(trees: list[list[Node]]) -> list[set[int]]:
    """For each tree (its nodes, parents first): the ids of its template texts."""
    none: list[set[int]] = [set() for _ in trees]
    if len(trees) < VOTERS:
        return none
    shapes: dict = {}
    for t in trees:
        measure(t, shapes)
    ref = sorted(range(len(trees)), key=lambda k: len(trees[k]))[len(trees) // 2]
    aligned: list[dict[int, Node]] = []         # reference text node -> this page's
    for t in trees:
        aligned.append({id(y): x for x, y in match(t[0], trees[ref][0]) if x.tag == "#text"})
    clean = lambda n: " ".join(n.text.split())
    mine = {id(n): clean(n) for n in trees[ref] if n.tag == "#text"}
    # pages of one content have one vote
    distinct = list({tuple(clean(n) for n in trees[k] if n.tag == "#text"): k
                     for k in [*range(len(trees)), ref]}.values())
    alike = [{y for y, x in a.items() if clean(x) == mine[y]} for a in aligned]
    # copies are told by what varies: not by scripts and the like, nor by texts
    # that nearly all pages share, unless next to nothing else is there
    shown = _shown(trees[ref])
    varied = [y for y in shown
              if sum(y in alike[k] for k in distinct) < CONSTANT * len(distinct)]
    chars = lambda ys: sum(len(mine[y]) for y in ys)
    if chars(varied) <= SAME * chars(shown):
        varied = shown
    most = COPY * chars(varied)
    voters = [k for k in distinct
              if k == ref or chars(y for y in varied if y in alike[k]) <= most]
    if len(voters) < VOTERS:
        return none
    constant: dict[int, str] = {}
    for y in mine:
        texts: dict[str, int] = {}
        for k in voters:
            x = aligned[k].get(y)
            if x is not None:
                c = clean(x)
                texts[c] = texts.get(c, 0) + 1
        if texts:
            t, n = max(texts.items(), key=lambda e: (e[1], e[0]))
            if t and n >= VOTERS and n >= CONSTANT * len(voters):
                constant[y] = t
    return [{id(x) for y, x in a.items() if constant.get(y) == clean(x)} for a in aligned]


def extract_block(pages: list[str | None]) -> list[str]:
    """Texts of the pages of one block."""
    trees = [_walk(parse(h)) for h in pages]
    out = []
    for t, skip in zip(trees, induce(trees)):
        release(t, skip)
        out.append(content_text(scope(t, skip), skip))
    return out


def host_of(url_col: str) -> Column:
    host = F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)
    return F.coalesce(host, F.lit(""))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    A null or empty html has an empty text; a null or odd url is of the host
    ''.  Repeated rows are pages of one content and have one vote.  Other
    columns are not read.  The html is shuffled once, by (host, block).
    """
    spark = df.sparkSession
    ship_package(spark)
    arrow_bound(spark)
    pages = df.select(df[id_col].alias("page_id"), df[url_col].alias("url"),
                      df[html_col].alias("html"), host_of(url_col).alias("host"))
    # only hosts of several blocks; a written table, so the planner knows its size
    large = written(spark, pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
                    .filter(F.col("n") > BLOCK)
                    .select("host", F.ceil(F.col("n") / BLOCK).alias("blocks")), "hosts")
    dealt = (pages.join(large, "host", "left")
             .withColumn("block", F.pmod(F.xxhash64("page_id", "url"),
                                         F.coalesce("blocks", F.lit(1))))
             .select("page_id", "url", "html", "host", "block"))
    schema = T.StructType([dealt.schema["page_id"], dealt.schema["url"],
                           T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def extract(table):
        import pyarrow as pa

        texts = extract_block(table.column("html").to_pylist())
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"),
                         "text": pa.array(texts, pa.string()),
                         "n_chars": pa.array(np.array([len(t) for t in texts], np.int64))})

    return dealt.groupBy("host", "block").applyInArrow(extract, schema)
