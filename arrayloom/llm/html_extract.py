"""Main text of web pages with wrappers inferred as union-free regular expressions.

A page is a stream of tags (name and class words) and texts. Pages of one host come from a few templates, so their streams are
aligned one after another into a wrapper, a union-free regular expression over tags with

* text slots: each keeps the fingerprints of what all its pages show there (a mismatch removes them), how many pages
  have it and how much text they put there,
* optional nodes, which some of the streams lack, and
* repeated groups, where a run of nodes follows itself.

Streams are kept as trees of properly nested tags, and aligned level by level. When an element ends, runs of its children
that follow themselves, of any width, are folded into repeated groups: their instances are aligned with each other.
Two levels are aligned by a longest common subsequence of their tags; matched nodes are joined (a group with an instance of its
body, too), the others become optional, and what then follows itself is folded again.

A host's pages with an article, with a main element only and with neither are templates of their own, with a wrapper each.
Aligning is done in three levels: within an input partition, by (host, salt), by host. Each passes on one wrapper for each
host and template, so a host with a third of all pages is never gathered: its pages are met where they lie.

The wrapper decides what is content, slot by slot:

* The region. Where the wrapper has an article (else: a main element), it is the region. In other wrappers it is found by the
  slots: from the root it goes down to the child that holds at least `SHARE` of the text that varies from page to page and isn't
  linked, as long as that child is a container that stands once in the page; a single first-level heading beside it belongs to it.
* Template texts, which at least `PAGES` different pages have at one place, and all pages that have the place: a block of
  nothing but these is no content, whatever its tags and classes. Repeated groups of links are menus where the region was
  found by its slots.
* Boilerplate elements (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) by the tags and
  class words below. Adverts and readers' comments vary from page to page just as articles do, so alignment alone can't
  tell them.

Each page is then read along its template's slots. Templates with fewer than `PAGES` pages that differ have no template
texts, since nothing tells them from content there; a page of nothing but template texts keeps them.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
by a line feed in page order; nothing else is dropped or cut.

Defined cases: null and empty html give an empty text; unclosed and stray tags are tolerated as browsers do; a null or
odd url makes its own host (empty); pages without markup are one block of text; rows that repeat a page_id are
pages each; copies of a page are no evidence of a template; pages may be nested or long at will; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frame, read_table

SALTS = 32
PAGES = 3  #: pages that differ and show a text at one place, for it to be the template's
SHARE = 0.8  #: of a level's varying text that a child must hold to be the region

# Element and class names of the HTML standard and common usage.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var"}
NOISE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "input", "head", "fieldset", *RAW}
NOISE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "rail", "widget", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "form",
    "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "replies", "pagination", "pager", "skip", "toolbar",
}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td", "font", "span"}
MAIN_TAGS = ("article", "main")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


# ---------------------------------------------------------------- tokens
def tokens(html: str):
    """('<', name, class words), ('>', name, ()) and ('#', text, ()) in page order; raw elements hold no text."""
    at, n, search = 0, len(html), _TOKEN.search
    while at < n:
        m = search(html, at)
        if m is None:
            break
        if m.start() > at:
            yield "#", html[at : m.start()], ()
        at = m.end()
        end, name, rest = m.groups()
        if not name:
            continue
        name = name.lower()
        if end:
            yield ">", name, ()
            continue
        words = tuple(sorted({w for g in _CLASS.findall(rest) for w in re.split(r"[\s_-]+", "".join(g).lower()) if w})) if "=" in rest else ()
        yield "<", name, words
        if name in RAW and not rest.rstrip().endswith("/"):
            stop = _ENDS[name].search(html, at)
            at = stop.end() if stop else n
            yield ">", name, ()
    if at < n:
        yield "#", html[at:], ()


def closes(name: str, open_: list[tuple[str, tuple]]) -> int:
    """How many open elements a start tag ends implicitly: an open paragraph (and what is inside it), an item by an item."""
    if name in BLOCKS:
        for i in range(len(open_) - 1, -1, -1):
            other = open_[i][0]
            if other == "p" or (other == name and name in ("li", "tr", "td", "th", "dd", "dt", "option")):
                return len(open_) - i
            if other not in INLINE:
                break
    return 0


def events(html: str):
    """('<' or '>', element) and ('#', text) with the elements properly nested; an element is (name, class words)."""
    open_: list[tuple[str, tuple]] = []
    held: dict[str, int] = {}  # open elements by name
    for kind, name, words in tokens(html):
        if kind == "#":
            yield "#", name
        elif kind == "<":
            for _ in range(closes(name, open_)):
                x = open_.pop()
                held[x[0]] -= 1
                yield ">", x
            x = (name, words)
            yield "<", x
            if name in VOID:
                yield ">", x
            else:
                open_.append(x)
                held[name] = held.get(name, 0) + 1
        elif held.get(name):
            while True:
                x = open_.pop()
                held[x[0]] -= 1
                yield ">", x
                if x[0] == name:
                    break
    while open_:
        yield ">", open_.pop()


# ---------------------------------------------------------------- wrappers
class Text:
    """A text slot: pages that have it, fingerprints of the texts that all of them show there, characters, optional or not."""

    __slots__ = ("pages", "same", "chars", "opt")
    head = "#"

    def __init__(self, pages: int, same: frozenset, chars: int, opt: bool = False):
        self.pages, self.same, self.chars, self.opt = pages, same, chars, opt


class Element:
    __slots__ = ("head", "kids", "opt")

    def __init__(self, head: tuple[str, tuple], kids: list, opt: bool = False):
        self.head, self.kids, self.opt = head, kids, opt


class Group:
    """A run of nodes that is repeated."""

    __slots__ = ("head", "kids", "opt")

    def __init__(self, kids: list, opt: bool = False):
        self.head, self.kids, self.opt = kids[0].head, kids, opt


#: What joining does with the texts of two slots: those of one page are all shown, those of different pages must agree; after an
#: alignment both may be mixed, and then neither adds evidence.
SAME_PAGE, APART, MIXED = "same page", "apart", "mixed"


def fingerprint(text: str) -> int:
    """A hash of the text, with its length (up to a million) in the lowest 20 bits."""
    text = " ".join(text.split())
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") << 20 | min(len(text), 0xFFFFF)


def join(a, b, mode: str):
    """One node for two with the same head."""
    opt = a.opt or b.opt
    if a.head == "#" and type(a) is type(b) is Text:
        same = a.same | b.same if mode == SAME_PAGE else a.same & b.same
        return Text(a.pages + b.pages if mode == APART else max(a.pages, b.pages), same, a.chars + b.chars, opt)
    if type(a) is type(b) is Element:
        return Element(a.head, align(a.kids, b.kids, mode), opt)
    return Group(align(a.kids if type(a) is Group else [a], b.kids if type(b) is Group else [b], mode), opt)


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places. Rows of the table are the bits of one number each."""
    bits: dict = {}
    for j, y in enumerate(b):
        bits[y] = bits.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        rows.append(v)
        u = v & bits.get(x, 0)
        v = (v + u | v - u) & full
    rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def align(a: list, b: list, mode: str) -> list:
    """One level for both: matched nodes joined, the others optional, folded again."""
    a, b = lift(a, b), lift(b, a)
    x, y = [n.head for n in a], [n.head for n in b]
    if x == y:
        return [join(m, n, mode) for m, n in zip(a, b)]
    out, i, j = [], 0, 0
    head = 0
    while head < len(x) and head < len(y) and x[head] == y[head]:
        head += 1
    pairs = [(k, k) for k in range(head)] + [(p + head, q + head) for p, q in matches(x[head:], y[head:])]
    for p, q in [*pairs, (len(a), len(b))]:
        for n in (*a[i:p], *b[j:q]):
            n.opt = True
            out.append(n)
        if p < len(a):
            out.append(join(a[p], b[q], mode))
        i, j = p + 1, q + 1
    return fold(out, MIXED)


def lift(nodes: list, other: list) -> list:
    """Runs that are the body of a wider repeated group of the other level count as that group."""
    for g in other:
        if type(g) is Group and len(g.kids) > 1:
            body, out, i = [n.head for n in g.kids], [], 0
            while i < len(nodes):
                run = nodes[i : i + len(body)]
                if type(nodes[i]) is not Group and [n.head for n in run] == body:
                    out.append(Group(run))
                    i += len(body)
                else:
                    out.append(nodes[i])
                    i += 1
            nodes = out
    return nodes


def fold(nodes: list, mode: str) -> list:
    """Runs of nodes that follow themselves, shortest first, become repeated groups until nothing changes."""
    width = 1
    while 2 * width <= len(nodes):
        starts = _repeats([n.head for n in nodes], width)
        if not starts:
            width += 1
            continue
        out, i = [], 0
        for s in starts:
            if s < i or width == 1 and type(nodes[s]) is type(nodes[s + 1]) is Text:
                continue
            out += nodes[i:s]
            body, heads, i = nodes[s : s + width], [n.head for n in nodes[s : s + width]], s + width
            opt = all(n.opt for n in body)
            while i + width <= len(nodes) and [n.head for n in nodes[i : i + width]] == heads:
                opt = opt and all(n.opt for n in nodes[i : i + width])
                flat = [k for n in body for k in n.kids] if width == 1 and type(body[0]) is Group else body
                more = [k for n in nodes[i : i + width] for k in n.kids] if width == 1 and type(nodes[i]) is Group else nodes[i : i + width]
                body = align(flat, more, mode)
                i += width
            out.append(Group(body, opt))
        if not i:
            width += 1
            continue
        nodes, width = out + nodes[i:], 1
    return nodes


def _repeats(heads: list, width: int) -> list[int]:
    """Where a run of that width is followed by itself."""
    if len(heads) < 64:
        return [s for s in range(len(heads) - 2 * width + 1) if heads[s] == heads[s + width] and heads[s : s + width] == heads[s + width : s + 2 * width] and (width > 1 or heads[s] != "#")]
    names: dict = {}
    ids = np.array([names.setdefault(h, len(names)) for h in heads])
    equal = ids[:-width] == ids[width:]
    if np.count_nonzero(equal) < width:
        return []
    runs = np.concatenate(([0], np.cumsum(equal)))
    found = np.flatnonzero(runs[width:] - runs[:-width] == width).tolist()
    return found if width > 1 else [s for s in found if heads[s] != "#"]


def page_tree(html: str) -> list:
    """A page's own wrapper."""
    level: list = []
    above: list[list] = []
    for kind, x in events(html):
        if kind == "#":
            if x.strip():
                mark = fingerprint(x)
                text = Text(1, frozenset((mark,)), mark & 0xFFFFF)
                if level and type(level[-1]) is Text:
                    level[-1] = join(level[-1], text, SAME_PAGE)
                else:
                    level.append(text)
        elif kind == "<":
            above.append(level)
            level = []
        else:
            kids, level = fold(level, SAME_PAGE), above.pop()
            level.append(Element(x, kids))
    return fold(level, SAME_PAGE)


def dump(nodes: list) -> str:
    """Flat, so that nesting has no bound."""
    out: list = []
    todo = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            out.append(0)
        elif type(x) is Text:
            out.append(["#", int(x.opt), x.pages, x.chars, *sorted(x.same)])
        else:
            out.append(["+", int(x.opt)] if type(x) is Group else ["<", int(x.opt), x.head[0], *x.head[1]])
            todo.append(None)
            todo.extend(reversed(x.kids))
    return json.dumps(out, separators=(",", ":"))


def load(wrapper: str) -> list:
    level: list = []
    above: list = []
    for x in json.loads(wrapper):
        if x == 0:
            kids, (level, start) = level, above.pop()
            level.append(Group(kids, bool(start[1])) if start[0] == "+" else Element((start[2], tuple(start[3:])), kids, bool(start[1])))
        elif x[0] == "#":
            level.append(Text(x[2], frozenset(x[4:]), x[3], bool(x[1])))
        else:
            above.append((level, x))
            level = []
    return level


def merged(wrappers) -> list:
    """One wrapper for several."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # nesting of a page is the depth of an alignment
    out = None
    for w in wrappers:
        out = w if out is None else align(out, w, APART)
    return out or []


# ---------------------------------------------------------------- content
def noise(element: tuple[str, tuple]) -> bool:
    name, words = element
    return name in NOISE_TAGS or any(w in NOISE_WORDS for w in words) and name not in ("article", "body", "html", "main")


class Slot:
    """A path of a wrapper: what its texts are, and the paths under it."""

    __slots__ = ("head", "kids", "inside", "clean", "fixed", "mass", "once", "linked")

    def __init__(self, head=None):
        self.head, self.kids, self.inside, self.clean, self.fixed, self.mass, self.once, self.linked = head, {}, False, True, set(), 0, True, 0


def slots(wrapper: list) -> list[Slot]:
    """The wrapper's paths from the root on, parents first; mass: varying text that isn't linked, of the whole subtree."""
    root = Slot()
    order, todo = [root], [(root, wrapper, False, False)]
    up: dict[int, Slot] = {}
    own: dict[int, list[int]] = {id(root): [0, 0]}
    while todo:
        slot, nodes, many, link = todo.pop()
        for n in nodes:
            if type(n) is Text:
                fixed = n.same if n.pages >= PAGES else ()
                slot.fixed.update(fixed)
                own[id(slot)][link] += max(0, n.chars - n.pages * sum(f & 0xFFFFF for f in fixed))
            elif type(n) is Group:
                todo.append((slot, n.kids, True, link))
            else:
                kid = slot.kids.get(n.head)
                if kid is None:
                    kid = slot.kids[n.head] = Slot(n.head)
                    order.append(kid)
                    up[id(kid)], own[id(kid)] = slot, [0, 0]
                else:
                    kid.once = False
                kid.once = kid.once and not many
                todo.append((kid, n.kids, False, link or n.head[0] == "a"))
    for s in order:
        s.mass, s.linked = own[id(s)]
    for s in reversed(order[1:]):
        if not noise(s.head):
            up[id(s)].mass += s.mass
        up[id(s)].linked += s.linked
    return order


def decide(wrapper: list) -> list[Slot]:
    """The slots with `inside` set for those whose texts are content."""
    order = slots(wrapper)
    root = order[0]
    tag = next((t for t in MAIN_TAGS if any(t == s.head[0] for s in clean(root))), "")
    region = root
    while not tag:
        next_ = [k for k in region.kids.values() if k.once and k.head[0] in CONTAINERS and not noise(k.head) and k.mass >= SHARE * region.mass > 0]
        if not next_:
            break
        region = next_[0]
    todo = [(root, region is root and not tag)]
    while todo:
        s, inside = todo.pop()
        s.inside = inside
        for k in s.kids.values():
            menu = not tag and not k.once and k.linked > 0 and k.mass == 0 and k.head[0] != "a"
            title = not tag and k.once and k.head[0] == "h1" and k.mass > 0 and s.clean
            k.clean = s.clean and not noise(k.head)
            todo.append((k, (inside or k is region or title or k.head[0] == tag) and not noise(k.head) and not menu))
    return order


def clean(root: Slot):
    """The paths without boilerplate elements."""
    todo = [root]
    while todo:
        for k in todo.pop().kids.values():
            if not noise(k.head):
                yield k
                todo.append(k)


def dump_slots(wrapper: list) -> str:
    """What reading needs: for each path its parent's number, head, whether its texts are content, and its template texts."""
    order = decide(wrapper)
    number = {id(s): i for i, s in enumerate(order)}
    up = {id(k): number[id(s)] for s in order for k in s.kids.values()}
    has_main = any(s.head and s.head[0] in MAIN_TAGS and s.inside for s in order)
    rows = [[up.get(id(s), -1), list(s.head[1]) if s.head else [], s.head[0] if s.head else "", int(s.inside), sorted(s.fixed) if s.inside else []] for s in order]
    return json.dumps([has_main, rows], separators=(",", ":"))


def load_slots(model: str) -> tuple[bool, Slot]:
    has_main, rows = json.loads(model)
    order: list[Slot] = []
    for up, words, name, inside, fixed in rows:
        s = Slot((name, tuple(words)))
        s.inside, s.fixed = bool(inside), set(fixed)
        order.append(s)
        if up >= 0:
            order[up].kids[s.head] = s
    return has_main, order[0]


def main_text(html: str, root: Slot | None, fixed: bool = True) -> str:
    """The blocks of text in content slots; without a wrapper, all outside boilerplate. Blocks of nothing but template texts are left out (fixed)."""
    blocks, now = [], []
    inside = root is None or root.inside
    slot, above = root, []
    seen = varies = False
    for kind, x in events(html):
        if kind == "#":
            if inside:
                now.append(entities.unescape(x))
                if not varies and x.strip():
                    seen = True
                    varies = not fixed or slot is None or not slot.fixed or fingerprint(x) not in slot.fixed
            continue
        if x[0] in BLOCKS or x[0] not in INLINE and noise(x):
            if seen and varies and (text := _SPACE.sub(" ", "".join(now)).strip()):
                blocks.append(text)
            now.clear()
            seen = varies = False
        elif x[0] == "br" and kind == "<":
            now.append(" ")
        if kind == "<":
            above.append((slot, inside))
            slot = slot.kids.get(x) if slot is not None else None
            inside = slot.inside if slot is not None else inside and not noise(x)
        else:
            slot, inside = above.pop()
    if seen and varies and (text := _SPACE.sub(" ", "".join(now)).strip()):
        blocks.append(text)
    return "\n".join(blocks)


def match_page(html: str | None, templates: list[tuple[bool, Slot]]) -> str:
    """By the first template whose slots hold text on the page; its template texts stay only if there is nothing else."""
    if not html:
        return ""
    for _, root in templates:
        found = main_text(html, root) or main_text(html, root, fixed=False)
        if found:
            return found
    return main_text(html, None)


# ---------------------------------------------------------------- distribution
def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_STARTS = [(t, re.compile(rf"<{t}\b", re.I)) for t in MAIN_TAGS]


def template_of(html: str) -> str:
    return next((t for t, start in _STARTS if start.search(html)), "")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, template, wrapper (JSON): one expression for each host and template, from all of its pages."""
    schema = "host string, template string, wrapper string"

    def local(batches):
        import pandas as pd

        held: dict[tuple[str, str], list] = {}
        seen: set[int] = set()
        for pdf in batches:
            for host, page in zip(pdf["host"], pdf["html"]):
                key = hash((host, page))
                if not page or key in seen:
                    continue
                seen.add(key)
                group, own = (host, template_of(page)), page_tree(page)
                held[group] = merged([held[group], own]) if group in held else own
        if held:
            yield pd.DataFrame({"host": [h for h, _ in held], "template": [t for _, t in held], "wrapper": [dump(w) for w in held.values()]})

    def merge(pdf):
        import pandas as pd

        out = merged(map(load, sorted(set(pdf["wrapper"]))))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "template": [pdf["template"].iloc[0]], "wrapper": [dump(out)]})

    parts = pages.select("host", "html").mapInPandas(local, schema)
    parts = parts.distinct().withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    parts = parts.groupBy("host", "template", "salt").applyInPandas(lambda pdf: merge(pdf), schema)
    return parts.distinct().groupBy("host", "template").applyInPandas(lambda pdf: merge(pdf), schema)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))

    def judge(batches):
        for pdf in batches:
            yield frame({"host": pdf["host"].to_numpy(), "template": pdf["template"].to_numpy(), "model": [dump_slots(load(w)) for w in pdf["wrapper"]]})

    wrappers = scratch.table(infer_wrappers(rows), "wrappers")
    models = wrappers.mapInPandas(judge, "host string, template string, model string")
    models = scratch.table(models.groupBy("host").agg(F.collect_list(F.struct("template", "model")).alias("models")).select("host", F.transform(F.array_sort("models"), lambda m: m["model"]).alias("models")), "models")

    def run(batches):
        known: dict[tuple, list] = {}
        for pdf in batches:
            text = []
            for page, m in zip(pdf["html"], pdf["models"]):
                m = () if m is None else tuple(m)
                if m not in known:
                    if len(known) >= 1024:
                        known.clear()
                    known[m] = sorted(map(load_slots, m), key=lambda x: not x[0])  # articles and main elements first
                text.append(match_page(page, known[m]))
            yield frame({"page_id": pdf["page_id"].to_numpy(), "url": pdf["url"].to_numpy(), "text": text, "n_chars": [len(t) for t in text]})

    return rows.join(models, "host", "left").select("page_id", "url", "html", "models").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
