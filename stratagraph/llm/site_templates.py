"""HTML extraction by site template removal.

Every element's subtree is hashed (tag, class words and text, from the leaves
up) and counted per host in Spark, over pages of distinct content.  A subtree
that recurs across many of its host's pages is the site's template and is
deleted, as are elements whose kind or class words say what they are (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, comments).

Where a page declares articles, its text is theirs.  Inside of them subtrees are
counted over a host's distinct (longest) articles, so a repeated one counts once, and
only boxes are deleted: containers with a class or id, and blocks at least half
of whose text is links.  Other prose that many articles share is a passage and
stays, and so does an article that would be left without text.

A host's template is bounded: a page's elements that recur on a fifth of the
host's pages are, over all pages, at most five times the elements of a page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm import words
from stratagraph.llm.common import small_side, written

#: Pages of distinct content on which a subtree must recur: this many, and this part of the host's.
LEAST_PAGES, SHARE = 3, 0.2

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag closes an open element of these kinds, up to the nearest border.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BORDER = frozenset("table ul ol dl select article section main div body html button".split())
#: Inline elements that an unclosed <p> takes with it.
P_ENDS = BLOCK - {"html", "body", "option", "legend", "summary", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "li", "dt", "dd"} | {"p"}

#: Elements that never hold main text.
CLUTTER = frozenset("head title nav header footer aside menu form button select input script style template noscript iframe object svg canvas dialog search textarea label fieldset noembed noframes".split())
#: Class and id words that name clutter; `-` and `_` part words.
CLUTTER_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
CLUTTER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN = ("article", "main")
#: Containers that a class or id makes a box inside an article.
BOX = frozenset("address center details dialog div dl figure hgroup ol section table ul".split())

#: Elements that a class or id may name clutter: containers, not the text blocks inside of them.
NAMED = frozenset("address article aside center div dl figure li ol section span table tbody td tr ul".split())
#: Open elements at most, about as browsers have it: deeper ones part blocks, but hold nothing.
DEPTH = 512

_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_REST = re.compile(r"((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORDS = re.compile(r"[A-Za-z]+")


_NO_TEXT = frozenset(("head", "script", "style", "template", "noscript"))


class Node:
    __slots__ = ("tag", "attributes", "kids", "known")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.kids, self.known = tag, attributes, [], None

    def values(self) -> dict[str, str]:
        """Attributes by lower-cased name; of one that repeats the first counts."""
        out: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.attributes):
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        return out

    def clutter(self) -> bool:
        """Whether the element's kind or attributes name it clutter."""
        if self.known is None:
            self.known = self.tag in CLUTTER or bool(self.attributes.strip(" /")) and self.tag not in ("html", "body", *MAIN) and self.named()
        return self.known

    def named(self) -> bool:
        """Whether attributes name the element clutter: it is hidden, has such a role, or is a container with
        a class or id at least half of whose words do (user-comments, but not comment-on-economy)."""
        own = self.values()
        if "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or own.get("role", "").strip().lower() in CLUTTER_ROLES:
            return True
        if self.tag in NAMED:
            for name in (own.get("class", "") + " " + own.get("id", "")).split():
                parts = [w.lower() for w in _PART.findall(name)]
                if parts and 2 * sum(w in CLUTTER_WORDS for w in parts) >= len(parts):
                    return True
        return False


def parse(source: str) -> Node:
    """A tree of any text, in time that grows with its length: unclosed, stray and crossed tags are mended
    as browsers do, roughly.  A `<` that opens nothing is text, so is a tag that isn't ended."""
    root = Node("#root")
    stack, opened = [root], Counter()
    at = position = 0
    cdata = True  # whether one may still be ended

    def text(piece: str) -> None:
        if piece:
            stack[-1].kids.append(html.unescape(piece) if "&" in piece else piece)

    def cut(n: int) -> None:
        opened.subtract(x.tag for x in stack[n:])
        del stack[n:]

    while (here := source.find("<", position)) >= 0:
        m, end = None, -1
        if source.startswith("<!--", here):
            end = source.find("-->", here + 4)
            end = len(source) if end < 0 else end + 3
        elif cdata and source.startswith("<![CDATA[", here) and (end := source.find("]]>", here)) >= 0:
            text(source[at:here])
            stack[-1].kids.append(source[here + 9 : end])
            at = position = end + 3
            continue
        elif source.startswith(("<!", "<?"), here):
            cdata = cdata and not source.startswith("<![CDATA[", here)
            end = source.find(">", here) + 1
        elif m := _OPEN.match(source, here):
            rest = _REST.match(source, m.end())
            end = rest.end() if rest else source.find(">", m.end()) + 1
        else:
            position = here + 1
            continue
        if end <= 0:  # no tag is ended from here on
            break
        text(source[at:here])
        at = position = end
        if not m:
            continue
        tag, attributes = m[2].lower(), rest[1] if rest else source[m.end() : end - 1]
        if m[1]:
            if opened[tag] > 0:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag == tag:
                        cut(n)
                        break
                    if stack[n].tag in BORDER and tag not in BORDER:
                        break
            elif tag in BLOCK and len(stack) > DEPTH:
                stack[-1].kids.append(Node(tag))
            continue
        if tag in P_ENDS and opened["p"] > 0:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == "p":
                    cut(n)
                    break
                if stack[n].tag in BLOCK:
                    break
        closes = CLOSES.get(tag, ())
        if closes:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag in closes:
                    cut(n)
                    break
                if stack[n].tag in BORDER:
                    break
        node = Node(tag, attributes)
        stack[-1].kids.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            inner, at = source[at : stop.start() if stop else len(source)], stop.end() if stop else len(source)
            node.kids.append(html.unescape(inner) if tag in ("title", "textarea") else inner)
            position = at
        elif tag not in VOID and not attributes.rstrip().endswith("/") and len(stack) <= DEPTH:
            stack.append(node)
            opened[tag] += 1
    text(source[at:])
    return root


def main_nodes(root: Node) -> list[Node]:
    """The declared articles with text, outside of clutter, in order: the one with most text, and others that
    no class word names clutter (comments and related texts are articles, too)."""
    found: list[tuple[int, Node]] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.clutter():
            continue
        if node.tag in MAIN or "role" in node.attributes.lower() and node.values().get("role", "").strip().lower() == "main":
            if node.tag != "article":
                inner = _articles(node)
                if inner:
                    todo += reversed(inner)
                    continue
            if n := _length(node):
                found.append((n, node))
            continue
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    best = max((n for n, _ in found), default=0)
    first = next((node for n, node in found if n == best), None)
    return [node for _, node in found if node is first or not (node.attributes and node.named())]


def _articles(node: Node) -> list[Node]:
    """The outermost articles inside a node, outside of clutter, in order."""
    out, todo = [], [k for k in reversed(node.kids) if isinstance(k, Node)]
    while todo:
        x = todo.pop()
        if x.clutter():
            continue
        if x.tag == "article":
            out.append(x)
        else:
            todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return out


def _descendants(node: Node) -> Iterator[Node]:
    todo = [k for k in node.kids if isinstance(k, Node)]
    while todo:
        x = todo.pop()
        yield x
        todo += [k for k in x.kids if isinstance(k, Node)]


def _length(node: Node) -> int:
    return sum(len(k) if isinstance(k, str) else 0 for x in (node, *_descendants(node)) for k in x.kids)


def subtree_hashes(root: Node, keep: list[Node]) -> dict[int, int]:
    """id(node) -> hash of each element that has text, outside of `keep`."""
    kept = {id(k) for k in keep}
    out: dict[int, int] = {}
    order: list[Node] = []
    todo = [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if isinstance(k, Node) and id(k) not in kept and k.tag not in _NO_TEXT]
    full: dict[int, tuple[int, bool]] = {}
    for x in reversed(order):
        h, some = xxhash.xxh64(f"{x.tag}|{' '.join(sorted(_WORDS.findall(x.attributes))) if x.attributes else ''}"), False
        for k in x.kids:
            if isinstance(k, str):
                t = " ".join(k.split())
                some |= bool(t)
                h.update(t)
            elif id(k) in full:
                h.update(full[id(k)][0].to_bytes(8, "little"))
                some |= full[id(k)][1]
        full[id(x)] = (h.intdigest(), some)
        if some and x.tag not in ("#root", "html", "body"):
            out[id(x)] = full[id(x)][0] - (1 << 63)
    return out


def box_hashes(article: Node) -> tuple[int, dict[int, int]]:
    """Hash of an article, and id(node) -> hash of each box with text inside of it."""
    hashes = subtree_hashes(article, [])
    order, todo = [], [(article, False)]
    while todo:
        x, linked = todo.pop()
        order.append((x, linked))
        todo += [(k, linked or x.tag == "a") for k in x.kids if isinstance(k, Node) and k.tag not in _NO_TEXT]
    lengths: dict[int, tuple[int, int]] = {}
    boxes = {}
    for x, linked in reversed(order):
        own = sum(len("".join(k.split())) for k in x.kids if isinstance(k, str))
        inner = [lengths[id(k)] for k in x.kids if isinstance(k, Node) and id(k) in lengths]
        n = own + sum(i[0] for i in inner)
        links = n if linked or x.tag == "a" else sum(i[1] for i in inner)
        lengths[id(x)] = n, links
        named = x.tag in BOX and bool(x.attributes.strip(" /")) and not x.values().keys().isdisjoint(("class", "id"))
        if x is not article and x.tag != "article" and id(x) in hashes and (named or x.tag in BLOCK and 2 * links >= n):
            boxes[id(x)] = hashes[id(x)]
    return hashes.get(id(article), 0), boxes


def _lines(tops: list[Node], drop: set[int]) -> str:
    blocks: list[list[str]] = [[]]
    todo: list = tops[::-1]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif id(x) not in drop and not x.clutter():
            if x.tag == "br":
                blocks[-1].append(" ")
            inner = x.kids[::-1]
            if x.tag in BLOCK:
                blocks.append([])
                todo.append(None)
            todo += inner
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(source: str, template: frozenset[int] | set[int] = frozenset(), boxes: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text: one line a block, white space inside a block as one space.  `boxes` is
    the template inside of declared articles, `template` that of pages without any."""
    root = parse(source)
    tops = main_nodes(root)
    drop = {k for k, h in subtree_hashes(root, tops).items() if h in template} if template else set()
    if not tops:
        return _lines([root], drop)
    texts = []
    for top in tops:
        inside = {k for k, h in box_hashes(top)[1].items() if h in boxes} if boxes else set()
        # one inside of a template is the template's, unless that leaves the page without text
        texts.append(_lines([top], inside) or _lines([top], set()))
    outside = {id(x) for k in _of(root, drop) for x in (k, *_descendants(k))}
    kept = [t for top, t in zip(tops, texts) if id(top) not in outside]
    return "\n".join(t for t in (kept or texts) if t)


def _of(root: Node, ids: set[int]) -> list[Node]:
    return [x for x in _descendants(root) if id(x) in ids] if ids else []


def page_hashes(source: str) -> tuple[int, list[int], int | None, list[int]]:
    """Hash of the whole page, distinct hashes of its subtrees outside the declared articles, hash of
    its longest article (None without any) and distinct hashes of the boxes of all of them."""
    root = parse(source)
    tops = main_nodes(root)
    articles = [(_length(top), *box_hashes(top)) for top in tops]
    longest = max(articles, key=lambda a: a[0])[1] if articles else None
    boxes = sorted({h for _, _, own in articles for h in own.values()})
    return xxhash.xxh64_intdigest(source) - (1 << 63), sorted(set(subtree_hashes(root, tops).values())), longest, boxes


def host(url) -> object:
    """Lower-cased host of a URL column; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def host_templates(pages: DataFrame, *, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """_host, _template, _boxes: the subtrees that recur on `least` pages and a `share` of a host's pages of
    distinct content, and the boxes that recur so on its pages of distinct articles.  Pages without a host have no
    template.  Counts are combined before each shuffle, so a host with a third of all pages meets no
    single task; its row is bounded."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, s in zip(words.column(b, "_host"), words.column(b, "html")):
                page, outside, article, boxes = page_hashes(s.as_py() or "")
                rows.append((h.as_py(), False, page, outside))
                if article is not None:
                    rows.append((h.as_py(), True, article, boxes))
            hs, inside, units, subs = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.string()), pa.array(inside, pa.bool_()), pa.array(units, pa.int64()), pa.array(subs, pa.list_(pa.int64()))], ["_host", "_inside", "_unit", "_hashes"])

    hashed = pages.select(host(F.col("url")).alias("_host"), F.col("html")).where("_host is not null").mapInArrow(take, "_host string, _inside boolean, _unit long, _hashes array<long>")
    distinct = written(hashed.dropDuplicates(["_host", "_inside", "_unit", "_hashes"]), "subtrees")
    n_units = distinct.groupBy("_host", "_inside").agg(F.count_distinct("_unit").alias("_units"))
    counts = distinct.select("_host", "_inside", "_unit", F.explode("_hashes").alias("_hash")).groupBy("_host", "_inside", "_hash").agg(F.count_distinct("_unit").alias("_n"))
    often = counts.where(F.col("_n") >= least).join(n_units, ["_host", "_inside"]).where(F.col("_n") >= share * F.col("_units"))
    of = lambda inside: F.sort_array(F.collect_set(F.when(F.col("_inside") == inside, F.col("_hash"))))
    return often.groupBy("_host").agg(of(False).alias("_template"), of(True).alias("_boxes"))


def extract(pages: DataFrame, *, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page, or one that is all clutter, gives an empty text.  A
    null or malformed url has no host: no template is removed there.  Repeated
    rows stay and count once among a host's pages.  Further columns are left out.
    """
    templates = written(host_templates(pages, least=least, share=share), "templates")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, frozenset[int]] = {}

        def known(hashes) -> frozenset[int]:
            own = tuple(hashes.as_py() or ())
            if own not in kept:
                if len(kept) > 1000:
                    kept.clear()
                kept[own] = frozenset(own)
            return kept[own]

        for b in batches:
            texts = []
            for source, template, boxes in zip(words.column(b, "html"), words.column(b, "_template"), words.column(b, "_boxes")):
                texts.append(main_text(source.as_py() or "", known(template), known(boxes)))
            yield pa.RecordBatch.from_arrays([words.column(b, "page_id"), words.column(b, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html"), host(F.col("url")).alias("_host"))
    joined = rows.join(small_side(templates), "_host", "left").select("page_id", "url", "html", "_template", "_boxes")
    return joined.mapInArrow(take, "page_id long, url string, text string, n_chars long")
