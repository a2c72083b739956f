"""Main text of web pages through wrappers inferred per host.

A wrapper is a union-free regular expression over the tokens of a host's pages, kept as a tree: each
element lists, in order, the elements, texts and groups below it, each of them plain, optional,
repeated or both; a text is a constant or a slot.  It starts as one page and is aligned with one page
after the other.  Where token streams differ in a text, the text becomes a slot.  Where they differ in
an element, the mismatch is a square (the items just matched come again: they become a repeated item
or group) or else an optional: the shorter way to where both streams agree again is skipped.  Wrappers
are merged within each input partition first, then across partitions, so a host with any number of
pages costs one wrapper per partition.  Nothing depends on how many pages a host has, but that one
page alone shows no differences.
"""

from __future__ import annotations

import functools
import html as _html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tidy

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "object", "canvas"}
#: Elements that never hold main text.
OUTSIDE = RAW | {"head", "header", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "input", "option"}
#: Names in class, id or role of what surrounds an article: alone, or as the last word of a name ("site-header").
BESIDE = set(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer comments commentlist respond replies cookie cookies consent notice notices notification alert popup modal overlay newsletter "
    "subscribe signup login search share sharing social related recommend recommended recommendations widget toolbar pagination pager copyright disclaimer "
    "complementary contentinfo skip hidden".split()
) | {"more-links", "sr-only"}
#: Of these, names that also count as the first word ("ad-slot", "comment-list").
LEADING = set("ad ads advert adsense sponsor promo sidebar menu nav navbar breadcrumb masthead footer comment comments cookie newsletter subscribe share social related pagination".split())


def is_beside(names: str) -> bool:
    """Whether one of the names says that an element stands beside the text."""
    for name in names.split():
        words = re.split(r"[-_]+", name)
        if name in BESIDE or words[-1] in BESIDE or words[0] in LEADING and len(words) > 1:
            return True
    return False


CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: One attribute after the other, so that names are never found within values or longer names.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "sig", "beside", "children")

    def __init__(self, tag: str, sig: str, beside: bool):
        self.tag, self.sig, self.beside, self.children = tag, sig, beside, []


def _element(tag: str, attributes: str) -> Node:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    names = found.get("class", "").split()
    words = " ".join([*names, found.get("id", ""), found.get("role", "")])
    unseen = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    main = tag in ("article", "main", "body", "html") or found.get("role") in ("main", "article")
    sig = tag + "".join("." + re.sub(r"\d+", "#", n) for n in names[:1]) + ("@main" if found.get("role") in ("main", "article") else "")
    return Node(tag, sig, tag in OUTSIDE or unseen or (not main and is_beside(words)))


def parse(html: str) -> Node:
    """The page as a tree of elements; texts are strings with their references decoded.

    Open paragraphs and list items end where HTML says so; stray ends are ignored.
    """
    root = Node("#page", "#page", False)
    stack, at, end = [root], 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        if m[0] == "<" and html[at + 1 : at + 2].strip("/").isalpha():  # a quote without its end, or no end at all
            m = _LOOSE.match(html, at)
            if m is None:
                break
        at = m.end()
        if m[2] is None:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].children.append(_html.unescape(m[0]))
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE or tag == "p" and stack[i].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in CLOSES_SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or (tag in ("dt", "dd") and stack[i].tag in ("dt", "dd")):
                    del stack[i:]
                    break
                if stack[i].tag in CLOSES_SAME[tag] or stack[i].tag == "table":
                    break
        node = _element(tag, m[3])
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        stack.append(node)
    return root


OPTIONAL, REPEATED, ASIDE = 1, 2, 4
#: A group of items that comes again has at most so many items; longer ones stay written out.
PERIOD = 6


class Item:
    """An element, a text ("#") or a group ("(a b)") of a wrapper.

    own: a text's constants in order (one for each time it is repeated), None for a slot.
    parts: what it is still to be merged from, of the left and of the right side of an alignment.
    """

    __slots__ = ("sig", "flags", "pages", "letters", "own", "kids", "parts")

    def __init__(self, sig: str, flags: int = 0, letters: int = 0, own: tuple | None = None, kids: list | None = None, parts: tuple | None = None, pages: int = 1):
        self.sig, self.flags, self.pages, self.letters, self.own, self.kids, self.parts = sig, flags, pages, letters, own, kids if kids is not None else [], parts


def sides(item: Item) -> tuple[list[Item], list[Item]]:
    return item.parts if item.parts is not None else ([item], [])


def again(a: Item, b: Item) -> Item:
    """a and b in one place of the same side: a repeated item."""
    (l1, r1), (l2, r2) = sides(a), sides(b)
    return Item(a.sig, a.flags | b.flags | REPEATED, kids=[], parts=(l1 + l2, r1 + r2))


def fold(items: list[Item]) -> list[Item]:
    """Squares: what comes twice in a row, one item or a group of up to PERIOD, becomes repeated."""
    out: list[Item] = []
    for item in items:
        out.append(item)
        k = 1
        while k <= PERIOD and k < len(out):
            last = out[-k:]
            if k == 1 and out[-2].sig == item.sig and item.sig[0] != "(":
                out[-2:] = [again(out[-2], out[-1])]
                break
            if k > 1:
                name = f"({' '.join(x.sig for x in last)})"
                if out[-k - 1].sig == name:
                    group = out[-k - 1]
                    out[-k - 1 :] = [again(group, Item(name, kids=last, pages=max(x.pages for x in last)))]
                    break
                before = out[-2 * k : -k]
                if len(before) == k and all(x.sig == y.sig for x, y in zip(before, last, strict=True)) and len({x.sig for x in last}) > 1:
                    one, two = (Item(name, kids=x, pages=max(i.pages for i in x)) for x in (before, last))
                    out[-2 * k :] = [again(one, two)]
                    break
            k += 1
    return out


def align(left: list[Item], right: list[Item], same: bool) -> list[Item]:
    """One list of items that covers both, in order.

    same: both come from one side (elements that are repeated), so nothing is counted twice.
    """
    where: tuple[dict, dict] = {}, {}
    for found, items in zip(where, (left, right), strict=True):
        for at, item in enumerate(items):
            found.setdefault(item.sig, []).append(at)

    def ahead(found: dict, sig: str, at: int) -> int | None:
        places = found.get(sig, ())
        k = bisect_left(places, at)
        return places[k] if k < len(places) else None

    def alone(item: Item, side: int, flags: int) -> Item:
        own = sides(item)[0]
        return Item(item.sig, item.flags | flags, parts=(own, []) if side == 0 or same else ([], own))

    out: list[Item] = []
    i = j = 0
    while i < len(left) and j < len(right):
        a, b = left[i], right[j]
        if a.sig == b.sig:
            one, two = sides(a)[0], sides(b)[0]
            out.append(Item(a.sig, a.flags | b.flags, parts=(one + two, []) if same else (one, two)))
            i, j = i + 1, j + 1
        elif out and out[-1].sig == b.sig:
            out[-1], j = again(out[-1], alone(b, 1, 0)), j + 1
        elif out and out[-1].sig == a.sig:
            out[-1], i = again(out[-1], alone(a, 0, 0)), i + 1
        else:
            k, m = ahead(where[0], b.sig, i), ahead(where[1], a.sig, j)
            if k is not None and (m is None or k - i <= m - j):
                out += [alone(x, 0, OPTIONAL) for x in left[i:k]]
                i = k
            elif m is not None:
                out += [alone(x, 1, OPTIONAL) for x in right[j:m]]
                j = m
            else:
                out += [alone(a, 0, OPTIONAL), alone(b, 1, OPTIONAL)]
                i, j = i + 1, j + 1
    out += [alone(x, 0, OPTIONAL) for x in left[i:]] + [alone(x, 1, OPTIONAL) for x in right[j:]]
    return fold(out)


def resolve(root: Item) -> Item:
    """Merges what is pending in a tree, from the top down and without recursion."""
    todo = [root]
    while todo:
        item = todo.pop()
        if item.parts is not None:
            found, item.parts = [side for side in item.parts if side], None
            every = [x for side in found for x in side]
            for x in every:
                item.flags |= x.flags
            item.pages, item.letters = sum(max(x.pages for x in side) for side in found), sum(x.letters for x in every)
            if item.sig == "#":
                owns = [None if any(x.own is None for x in side) else tuple(c for x in side for c in x.own) for side in found]
                item.own = owns[0] if all(o == owns[0] for o in owns) else None
            lists = []
            for side in found:
                kids = side[0].kids
                for x in side[1:]:
                    kids = align(kids, x.kids, True)
                lists.append(kids)
            item.kids = lists[0] if len(lists) == 1 else align(*lists, False)
        todo += item.kids
    return root


def merge(a: Item, b: Item) -> Item:
    """The wrapper of the pages of two wrappers."""
    return resolve(Item(a.sig, a.flags | b.flags, parts=([a], [b])))


def skeleton(page: Node) -> Item:
    """A page's wrapper: inline elements melt into text, squares fold into repeats."""
    root = Item(page.sig, ASIDE * page.beside)
    todo, order = [(page, root)], []
    while todo:
        node, item = todo.pop()
        order.append(item)
        text: list[str] = []

        def end_text(item: Item = item, text: list[str] = text) -> None:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                item.kids.append(Item("#", letters=len(words), own=(crc32(words.encode("utf-8", "replace")),)))

        inner = [iter(node.children)]
        while inner:
            child = next(inner[-1], None)
            if child is None:
                inner.pop()
            elif isinstance(child, str):
                text.append(child)
            elif child.tag in INLINE and not child.beside:
                text.append(" " if child.tag in ("br", "img") else "")
                inner.append(iter(child.children))
            else:
                end_text()
                if child.tag not in RAW and child.tag != "head":
                    below = Item(child.sig, ASIDE * child.beside)
                    item.kids.append(below)
                    todo.append((child, below))
        end_text()
    for item in reversed(order):  # from the leaves up
        item.letters = sum(x.letters for x in item.kids)
        item.kids = fold(item.kids)
        for x in item.kids:
            if x.parts is not None:
                resolve(x)
    return root


def written(wrapper: Item) -> str:
    """A wrapper as JSON: its items from the top down, each with its number of children."""
    rows, todo = [], [wrapper]
    while todo:
        x = todo.pop()
        rows.append([x.sig, x.flags, x.pages, x.letters, x.own, len(x.kids)])
        todo += reversed(x.kids)
    return json.dumps(rows, separators=(",", ":"))


def unwritten(text: str) -> Item:
    rows = json.loads(text)
    top = Item("#page")
    open_: list[tuple[Item, int]] = [(top, 1)]
    for sig, flags, pages, letters, own, kids in rows:
        while len(open_[-1][0].kids) == open_[-1][1]:
            open_.pop()
        item = Item(sig, flags, letters, tuple(own) if own is not None else None, pages=pages)
        open_[-1][0].kids.append(item)
        open_.append((item, kids))
    return top.kids[0]


def elements(item: Item) -> list[Item]:
    """The children of an element, those in groups among them."""
    out, todo = [], list(reversed(item.kids))
    while todo:
        x = todo.pop()
        if x.sig[0] == "(":
            todo += reversed(x.kids)
        else:
            out.append(x)
    return out


def main_path(wrapper: Item) -> list[str]:
    """Signatures from the page down to the element that holds the main text.

    An article or main element wins; else the way goes down while one child that isn't beside
    the text holds most of the letters in slots.  Where nothing differs between pages, all letters
    count.
    """
    order, todo, above = [], [wrapper], {id(wrapper): None}
    while todo:
        node = todo.pop()
        order.append(node)
        if not node.flags & ASIDE:
            below = elements(node)
            above.update((id(x), node) for x in below)
            todo += reversed(below)

    def path_of(node: Item) -> list[str]:
        out = []
        while node is not wrapper:
            out.append(node.sig)
            node = above[id(node)]
        return out[::-1]

    named = [(x, path_of(x)) for x in order if x is not wrapper and _holds_main(x.sig)]
    slots, every = {}, {}
    for node in reversed(order):
        if node.sig == "#":
            slots[id(node)], every[id(node)] = node.letters * (node.own is None), node.letters
        else:
            below = [] if node.flags & ASIDE else elements(node)
            slots[id(node)], every[id(node)] = sum(slots[id(x)] for x in below), sum(every[id(x)] for x in below)
    for letters in (slots, every):
        best: tuple[int, list] = (0, [])
        for node, path in named:
            found = letters[id(node)]
            # an article inside a main element is the closer fit
            if found > best[0] or (found and 2 * found >= best[0] and path[: len(best[1])] == best[1]):
                best = (found, path)
        if best[0]:
            return best[1]
    letters = slots if slots[id(wrapper)] else every
    path, node = [], wrapper
    while True:
        inner = [x for x in elements(node) if x.sig != "#" and not x.flags & ASIDE]
        top = max(inner, key=lambda x: letters[id(x)], default=None)
        if top is None or letters[id(top)] * 10 < letters[id(node)] * 8 or all(x.sig == "#" for x in elements(top)):
            return path
        path.append(top.sig)
        node = top


def _holds_main(sig: str) -> bool:
    return re.split(r"[.@]", sig)[0] in ("article", "main") or sig.endswith("@main")


#: Elements that are blocks of text of their own rather than boxes around blocks.
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "li", "dt", "dd", "td", "th", "caption", "address"}


def template_texts(wrapper: Item) -> set:
    """(hash of the path, text) of the boxes beside the slots that every page has, with the same words in each.

    Headings, paragraphs and other blocks of text stay, and so does all that an article holds.
    """
    out: set = set()
    order, todo = [], [(wrapper, 0)]
    while todo:
        node, path = todo.pop()
        order.append((node, path))
        if not _holds_main(node.sig):
            todo += [(x, hash((path, x.sig))) for x in elements(node) if x.sig != "#"]
    slot = {}
    for node, _ in reversed(order):
        slot[id(node)] = any(x.own is None if x.sig == "#" else slot.get(id(x), True) for x in elements(node))
    if not slot[id(wrapper)]:
        return out
    boxes = [(node, path) for node, path in order if node is not wrapper and not slot[id(node)] and not node.flags & OPTIONAL and node.pages > 1 and node.sig.split(".")[0] not in TEXT_BLOCKS]
    while boxes:
        node, path = boxes.pop()
        for x in elements(node):
            if x.sig == "#":
                out |= {(path, c) for c in x.own}
            else:
                boxes.append((x, hash((path, x.sig))))
    return out


class Extractor:
    """Applies one wrapper to pages."""

    def __init__(self, wrapper: Item):
        self.path = main_path(wrapper)
        self.constants = set() if any(map(_holds_main, self.path)) else template_texts(wrapper)
        self.top = functools.reduce(lambda path, sig: hash((path, sig)), self.path, 0)

    def roots(self, page: Node) -> list[Node]:
        found = [page]
        for sig in self.path:
            found = [c for n in found for c in _inside(n) if c.sig == sig]
        return found

    def text(self, page: Node) -> str:
        roots = self.roots(page)
        if not roots:  # a page that the wrapper doesn't fit goes by itself
            own = Extractor(skeleton(page))
            return own.text(page) if own.roots(page) else ""
        blocks: list[str] = []
        for root in roots:
            self._blocks(root, blocks)
        return "\n".join(blocks)

    def _blocks(self, root: Node, out: list[str]) -> None:
        text: list[str] = []

        def end_text(here: int) -> None:
            words = " ".join("".join(text).split())
            text.clear()
            if words and (not self.constants or (here, crc32(words.encode("utf-8", "replace"))) not in self.constants):
                out.append(words)

        # one explicit stack: pages may be nested deeper than Python recurses
        todo: list = [(root, self.top, False)]
        while todo:
            item = todo.pop()
            if isinstance(item[0], str):
                text.append(item[0])
                continue
            node, here, ended = item
            if ended:
                end_text(here)
                continue
            for child in reversed(node.children):
                if isinstance(child, str):
                    todo.append((child,))
                elif child.beside:
                    continue
                elif child.tag in INLINE:
                    todo.append((" ",) if child.tag in ("br", "img") else (child, here, False))
                elif child.tag not in VOID:
                    below = hash((here, child.sig))
                    todo += [(child, below, True), (child, below, False), (Node("", "", False), here, True)]
        end_text(self.top)


def _inside(node: Node) -> list[Node]:
    out, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, Node):
            if child.tag in INLINE:
                todo += reversed(child.children)
            else:
                out.append(child)
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON), one row per host of the pages with html."""
    schema = "host string, part long, wrapper string"

    @tidy
    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        known: dict[str, Item] = {}
        for batch in batches:
            for url, html in zip(batch["url"], batch["html"], strict=True):
                if html:
                    own, host = skeleton(parse(html)), host_of(url)
                    known[host] = merge(known[host], own) if host in known else own
        part = TaskContext.get().partitionId()
        if known:
            yield pd.DataFrame({"host": list(known), "part": [part] * len(known), "wrapper": [written(w) for w in known.values()]})

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "part": [rows["part"].iloc[0] // 32], "wrapper": [written(functools.reduce(merge, map(unwritten, rows["wrapper"])))]})

    source = pages.select("url", "html")
    parts, out = source.rdd.getNumPartitions(), source.mapInPandas(start, schema)
    while True:  # 32 wrappers of a host at a time, so that no task gathers more
        parts = -(-parts // 32)
        out = out.groupBy("host", F.floor(F.col("part") / 32).alias("_p")).applyInPandas(join, schema)
        if parts <= 1:
            return out.select("host", "wrapper")


#: Wrappers of at most so many bytes in all are broadcast; more are joined through a shuffle.
BROADCAST_BYTES = 32 << 20
SALTS = 32


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, by its host's wrapper.

    A null or empty html gives an empty text, and so does a page without an article.  Pages
    without a host share the wrapper of the empty host; repeated rows are extracted each; other
    columns are ignored.
    """
    wrappers = cut(infer_wrappers(pages))
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0]
    source = pages.select("page_id", "url", "html").withColumn("_host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    if size <= BROADCAST_BYTES:
        joined = source.join(F.broadcast(wrappers.withColumnRenamed("host", "_host")), "_host", "left")
    else:
        salted = wrappers.withColumnRenamed("host", "_host").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = source.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left")

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Extractor] = {}
        for batch in batches:
            texts = []
            for host, html, wrapper in zip(batch["_host"], batch["html"], batch["wrapper"], strict=True):
                if not html:
                    texts.append("")
                    continue
                page = parse(html)
                if wrapper is None:
                    wrapper = written(skeleton(page))
                if wrapper not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[wrapper] = Extractor(unwritten(wrapper))
                texts.append(known[wrapper].text(page))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.select("page_id", "url", "html", "_host", "wrapper").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
