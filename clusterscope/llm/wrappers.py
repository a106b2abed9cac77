"""Main-text extraction by union-free regular expressions inferred per host.

All pages of every host are read as token streams and aligned: parts of a host's pages one after the
other, then the parts' patterns, until a host has one.  What they share stays literal; texts that differ become slots; elements
that only some pages have become optional groups; runs of equal element
sequences become repeated groups.  The result, the host's wrapper, is a regular
expression without unions.  It tells which texts are the template's own (literal on
all pages that have it) and where the variable text is: the article elements if they hold most of the
slots' text, else the smallest element that holds all slots.  The token stream of every page of the host is then
matched against the expression, and the texts that its slots and groups take there are the page's text,
with the words of an article that don't vary.  Where an element's content doesn't match, that element alone is
read by its path and the literal texts.  Elements that are menus, headers, footers, sidebars, notices, adverts,
forms or comments by their tag, role, class or id are left out; names don't count around the content, and within an
article only whole classes and roles do.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterscope.session import cut, discard, ship_package

SAMPLE_PAGES = 64            # pages of a host, or patterns of its parts, that a group aligns
SURE_PAGES = 4               # different pages that must agree on a literal text
ARTICLE_SHARE = 0.5          # of the slots' text, from which article elements are the content
ROW_BITS = 1 << 26           # of an alignment table's rows and of key masks that are held at once; further rows are worked out again

# Element names of HTML, and words in class, id and role that mark what is not the article.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "select", "option", "canvas", "math", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "ruby", "rb", "rt", "rp", "nobr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer",
            "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_SELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
NOT_TEXT = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "input"}
OUTSIDE_ONLY = {"header"}    # an article's own header belongs to it
ARTICLE = {"article", "main"}
SIDE_WORDS = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu",
              "breadcrumb", "breadcrumbs", "sidebar", "footer", "cookie", "cookies", "consent", "notice", "notices", "popup", "modal", "newsletter",
              "subscribe", "subscription", "signup", "share", "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "reply",
              "replies", "respond", "disqus", "login", "search", "toolbar", "pagination", "pager", "contentinfo", "complementary", "alert", "header"}

_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[!?/][^>]*+(?:>|\Z))", re.S)
_MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I | re.S)
_NUMBER = re.compile(r"\d{3,}")
_WHITE = re.compile(r"\s+")


def _signature(tag: str, attributes: str) -> str:
    """Tag and the words of its class, id (with #) and role, with long numbers as 0, as they name a page and
    not a kind of element; ``!hidden`` if it isn't shown."""
    if not attributes or attributes.isspace():
        return tag
    words: list[str] = []
    for name, *values in _MARK.findall(attributes):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            words.append("!hidden")
        elif name in ("class", "role"):
            words += value.lower().split()
        elif name == "id":
            words += ["#" + w for w in value.lower().split()]
    return ".".join([tag, *(_NUMBER.sub("0", w) for w in words)])


def events(page: str) -> Iterator[tuple[str, str]]:
    """The page's token stream: ("open" | "close", signature), ("text", decoded), with the
    end tags that HTML lets authors leave out put in; raw elements and comments are left out."""
    stack: list[tuple[str, str]] = []
    at, end = 0, len(page)

    def shut(upto: int) -> Iterator[tuple[str, str]]:
        while len(stack) > upto:
            yield "close", stack.pop()[1]

    def innermost(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str] = frozenset()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in stop:
                break
        return -1

    while at < end:
        m = _next_tag(page, at)
        if m is None:
            yield "text", entities.unescape(page[at:])
            break
        if m.start() > at:
            yield "text", entities.unescape(page[at:m.start()])
        at = m.end()
        slash, tag, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            i = innermost({tag})
            if i >= 0:
                yield from shut(i)
            elif tag == "p":
                yield "open", "p"
                yield "close", "p"
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in CLOSES_P and (i := innermost({"p"}, {"button", "table"})) >= 0:
            yield from shut(i)
        if tag in CLOSES_SELF and (i := innermost({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}, CLOSES_SELF[tag])) >= 0:
            yield from shut(i)
        signature = _signature(tag, attributes)
        yield "open", signature
        if tag in VOID:
            yield "close", signature
        else:
            stack.append((tag, signature))
    yield from shut(0)


def _next_tag(page: str, at: int):
    while True:
        at = page.find("<", at)
        if at < 0:
            return None
        if m := _TAG.match(page, at):
            return m
        at += 1


def _tag(signature: str) -> str:
    return signature.split(".", 1)[0]


def _unseen(signature: str, inside: bool) -> bool:
    """Whether an element is no text by its tag or as it is hidden; ``inside``: it is within an article element."""
    tag, *words = signature.split(".")
    return tag in NOT_TEXT or tag in OUTSIDE_ONLY and not inside or "!hidden" in words


def _aside(signature: str, inside: bool) -> bool:
    """Whether an element is none of the article's text, by its names too."""
    if _unseen(signature, inside):
        return True
    tag, *words = signature.split(".")
    if tag in ARTICLE or tag in ("html", "body"):
        return False
    if inside:
        return tag != "header" and any(w in SIDE_WORDS and w != "header" for w in words)
    return bool({p for w in words for p in re.split(r"[-_]+", w.removeprefix("#"))} & SIDE_WORDS)


def _shared(paths: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The longest path that all of these begin with."""
    low, high = min(paths, default=()), max(paths, default=())
    return low[:next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))]


def kind_of(path: tuple[str, ...], around: tuple[str, ...] = ()) -> int:
    """2: in an article element, 0: elsewhere, -1: not text.  The names of the elements of ``around`` don't count."""
    inside, still = False, True
    for i, s in enumerate(path):
        still = still and i < len(around) and s == around[i]
        if _unseen(s, inside) if still else _aside(s, inside):
            return -1
        inside = inside or _tag(s) in ARTICLE
    return 2 if inside else 0


def _around(sizes: dict[tuple[str, ...], int]) -> tuple[str, ...]:
    """The elements around the content of a page or host whose texts have these paths and lengths: those around
    all articles (around the first if that leaves none), else those around all texts, or around most
    of them and not named in full as something else."""
    articles, plain = [], {}
    for path, size in sizes.items():
        inside = False
        for i, s in enumerate(path):
            if _unseen(s, inside):
                break
            if _tag(s) in ARTICLE:
                articles.append(path[:i + 1])
                break
        else:
            plain[path] = size
    if articles:
        articles = list(dict.fromkeys(articles))
        shared = _shared(articles)
        return shared if any(kind_of(p, shared) == 2 for p in articles) else articles[0]
    around, total = (), sum(plain.values())
    while True:
        inner: dict[str, int] = {}
        for path, size in plain.items():
            s = path[len(around)] if len(path) > len(around) else ""
            if path[:len(around)] == around:
                inner[s] = inner.get(s, 0) + size
        s = max(inner, key=inner.get, default="")
        named = {w.removeprefix("#") for w in s.split(".")[1:]} & SIDE_WORDS
        if not s or inner[s] < total and (named or 2 * inner[s] <= total):
            return around
        around += (s,)


def pieces(page: str) -> Iterator[tuple[str, str]]:
    """The token stream with the texts between block elements in one piece each."""
    parts: list[str] = []
    articles = 0

    def end():
        text = _WHITE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            yield "text", text
    for kind, what in events(page):
        if kind == "text":
            parts.append(what)
            continue
        tag = _tag(what)
        if tag in INLINE and ("." not in what or not _aside(what, articles > 0)):
            continue
        if tag == "br" or tag == "wbr":
            if kind == "open" and tag == "br":
                parts.append(" ") if parts else None
            continue
        yield from end()
        articles += (tag in ARTICLE) * (1 if kind == "open" else -1)
        yield kind, what
    yield from end()


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path of block elements, text) of all blocks, in page order."""
    path: list[str] = []
    for kind, what in pieces(page):
        if kind == "text":
            yield tuple(path), what
        elif kind == "open":
            path.append(what)
        elif path:
            path.pop()


# --- wrapper inference ---------------------------------------------------------------

@dataclass
class Text:
    value: str | None            # None: a slot
    pages: int = 1               # different pages that agreed on the value
    optional: bool = False

    @property
    def key(self):
        return "#"


@dataclass
class Group:
    """One or more neighbouring elements (signature, content)."""
    items: list[tuple[str, list]] = field(default_factory=list)
    repeated: bool = False
    optional: bool = False

    @property
    def key(self):
        return tuple(s for s, _ in self.items)


def read(page: str) -> list:
    """A page as a pattern that matches only itself."""
    root: list = []
    open_: list[list] = [root]
    for kind, what in pieces(page):
        if kind == "text":
            if open_[-1] and isinstance(open_[-1][-1], Text):
                open_[-1][-1].value += " " + what
            else:
                open_[-1].append(Text(what))
        elif _tag(what) in VOID:
            continue
        elif kind == "open":
            inner: list = []
            open_[-1].append(Group([(what, inner)]))
            open_.append(inner)
        elif len(open_) > 1:
            open_.pop()
    return fold(root)


def fold(items: list) -> list:
    """Merge neighbouring repetitions of up to three elements into repeated groups."""
    items = [Group([(s, fold(c)) for s, c in x.items], x.repeated, x.optional) if isinstance(x, Group) else x for x in items]
    for period in (1, 2, 3):
        out: list = []
        i = 0
        while i < len(items):
            run = items[i:i + period]
            keys = [x.key for x in run]
            n = 1
            while len(run) == period and all(isinstance(x, Group) and not (x.repeated and period > 1) for x in run) and \
                    [x.key for x in items[i + n * period:i + (n + 1) * period]] == keys:
                n += 1
            if n == 1 or period > 1 and len(set(keys)) == 1:
                out.append(items[i])
                i += 1
                continue
            parts = [y for x in run for y in x.items]
            for k in range(1, n):
                again = [y for x in items[i + k * period:i + (k + 1) * period] for y in x.items]
                parts = [(s, align(a, b, False)) for (s, a), (_, b) in zip(parts, again)]
            out.append(Group(parts, True))
            i += n * period
        items = out
    return items


def align(a: list, b: list, new_page: bool = True) -> list:
    """The pattern of both sequences; ``new_page``: b is a further page, not a repetition within one."""
    a, b = _gathered(a, b), _gathered(b, a)
    pairs = _common(a, b)
    out: list = []
    i = j = 0
    for x, y in [*pairs, (len(a), len(b))]:
        for rest in (a[i:x], b[j:y]):
            for p in rest:
                p.optional = True
                out.append(p)
        if x < len(a):
            p, q = a[x], b[y]
            if isinstance(p, Text):
                same = p.value is not None and p.value == q.value
                out.append(Text(p.value if same else None, p.pages + (q.pages if new_page and same else 0), p.optional or q.optional))
            else:
                out.append(Group([(s, align(c, d, new_page)) for (s, c), (_, d) in zip(p.items, q.items)], p.repeated or q.repeated, p.optional or q.optional))
        i, j = x + 1, y + 1
    return out


def _gathered(items: list, other: list) -> list:
    """``items`` with single elements put together where they are one turn of a group of ``other``."""
    keys = {p.key for p in other if isinstance(p, Group) and len(p.items) > 1} - {p.key for p in items}
    for key in sorted(keys, key=len, reverse=True):
        out: list = []
        i = 0
        while i < len(items):
            run = items[i:i + len(key)]
            if all(isinstance(p, Group) and not p.optional and not p.repeated for p in run) and tuple(k for p in run for k in p.key) == key:
                out.append(Group([x for p in run for x in p.items]))
                i += len(run)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence by key."""
    ka, kb = [x.key for x in a], [x.key for x in b]
    start = 0
    while start < min(len(ka), len(kb)) and ka[start] == kb[start]:
        start += 1
    tail = 0
    while tail < min(len(ka), len(kb)) - start and ka[-1 - tail] == kb[-1 - tail]:
        tail += 1
    head = [(i, i) for i in range(start)]
    foot = [(len(ka) - t, len(kb) - t) for t in range(tail, 0, -1)]
    middle = _longest(ka[start:len(ka) - tail], kb[start:len(kb) - tail])
    return head + [(start + i, start + j) for i, j in middle] + foot


def _bits(places: list[int], n: int) -> int:
    held = bytearray((n >> 3) + 1)
    for i in places:
        held[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(held, "little")


def _masks(keys: list) -> Callable[..., int]:
    """Key -> its places as the bits of a number."""
    places: dict = {}
    for i, key in enumerate(keys):
        places.setdefault(key, []).append(i)
    known: dict = {}

    def mask(key) -> int:
        if key not in places:
            return 0
        if key not in known:
            if len(known) * len(keys) > ROW_BITS:
                known.clear()
            known[key] = _bits(places[key], len(keys))
        return known[key]
    return mask


def _rows(m: int, n: int, row: Callable, first: int) -> tuple[int, Iterator]:
    """What the last of ``m`` rows of ``n`` bits leaves, and the rows, the last one first; ``row(i, before)`` is what is wanted of
    row i and what it leaves to the next one.  Rows are held in blocks, each worked out again from what was kept
    before it, so a wide table needs twice the time and not its whole size."""
    step = max(math.isqrt(m) + 1, ROW_BITS // (n + 1))
    starts, kept, rows = range(0, m, step), [], []

    def block(start: int, before) -> tuple[list, int]:
        out = []
        for i in range(start, min(start + step, m)):
            wanted, before = row(i, before)
            out.append(wanted)
        return out, before
    for start in starts:
        kept.append(first)
        rows, first = block(start, first)

    def backward() -> Iterator:
        for start in reversed(starts):
            before = kept.pop()
            yield from reversed(rows if start == starts[-1] else block(start, before)[0])
    return first, backward()


def _longest(a: list, b: list) -> list[tuple[int, int]]:
    """The places of a longest common subsequence; of several, that which leaves elements of ``a`` out first."""
    m, n = len(a), len(b)
    if not m or not n:
        return []
    mask, full = _masks(b[::-1]), (1 << n) - 1

    def row(i: int, before: int) -> tuple[tuple[int, int], int]:
        # of the last i + 1 elements of a: the bits are 0 where one more of the last elements of b makes it longer
        met = before & mask(a[m - 1 - i])
        now = (before + met | before - met) & full
        return (now, before), now
    last, rows = _rows(m, n, row, full)
    out: list[tuple[int, int]] = []
    j, length = 0, n - last.bit_count()
    for i, (now, fewer) in enumerate(rows):
        bits = now.to_bytes((n >> 3) + 1, "little")
        while j < n:
            if a[i] == b[j]:
                out.append((i, j))
                j, length = j + 1, length - 1
                break
            at = n - j - 1
            if not bits[at >> 3] >> (at & 7) & 1 or n - j - (fewer & (1 << n - j) - 1).bit_count() == length:
                break
            j += 1
    return out


def expression(pattern: list) -> str:
    """The wrapper in the notation of regular expressions: ``#`` is a slot."""
    out = []
    for p in pattern:
        if isinstance(p, Text):
            body = "#" if p.value is None else re.escape(p.value)
        else:
            body = "".join(f"<{s}>{expression(c)}</{_tag(s)}>" for s, c in p.items)
        if isinstance(p, Group) and (p.repeated or p.optional) or p.optional:
            body = f"({body}){'+' if isinstance(p, Group) and p.repeated else ''}{'?' if p.optional else ''}"
        out.append(body)
    return "".join(out)


def merged(patterns: list[list]) -> list:
    """The pattern of the pages of all these patterns."""
    pattern = patterns[0]
    for other in patterns[1:]:
        pattern = align(pattern, other)
    return pattern


def literals_of(pattern: list) -> list[list]:
    """[path, text] of the sure literal texts outside articles."""
    literals: list[list] = []

    def visit(items: list, path: tuple[str, ...]):
        for p in items:
            if isinstance(p, Group):
                for s, c in p.items:
                    visit(c, (*path, s))
            elif sure(p):
                literals.append([list(path), p.value])
    visit(pattern, ())
    return [x for x in literals if not any(_tag(s) in ARTICLE for s in x[0])]


def content_of(took: dict[str, dict[tuple[str, ...], int]]) -> tuple[list[str], bool]:
    """The path of a host's content and whether that is the article elements, from the lengths of the texts
    by how they match the pattern and by path: what varies on the pages is content."""
    varied = took.get("slot") or took.get("fixed") or {}
    around = _around(varied)
    kinds = {path: kind_of(path, around) for path in varied}
    slots = [path for path, kind in kinds.items() if kind >= 0]
    article = sum(varied[p] for p in slots if kinds[p] == 2) >= ARTICLE_SHARE * sum(varied[p] for p in slots)
    region = _shared(slots)
    # a repeated leaf such as a paragraph is no region: the element around it is
    while region and _tag(region[-1]) in ("p", "li", "td", "pre", "blockquote"):
        region = region[:-1]
    return list(region), article


def infer(pages: list[str]) -> dict:
    """A host's wrapper: its expression (also as lists), the path of its content, whether that is
    the article elements, and its literal texts outside articles."""
    pages = list(dict.fromkeys(pages))
    if not pages:
        return {"expression": "", "pattern": None, "region": [], "article": True, "literals": []}
    pattern = merged([read(page) for page in pages])
    lists = packed(pattern)
    took: dict[str, dict[tuple[str, ...], int]] = {}
    for page in pages:
        for path, text, how in matched(lists, page):
            sizes = took.setdefault(how, {})
            sizes[path] = sizes.get(path, 0) + len(text)
    region, article = content_of(took)
    return {"expression": expression(pattern), "pattern": lists, "region": region, "article": article, "literals": literals_of(pattern)}


def sure(p: Text) -> bool:
    """Whether enough different pages agree on a text for it to be the template's."""
    return p.value is not None and p.pages >= SURE_PAGES and not p.optional


def stored(pattern: list) -> list:
    """The whole pattern as lists, for ``restored``."""
    return [[p.value, p.pages, p.optional] if isinstance(p, Text) else [[[s, stored(c)] for s, c in p.items], p.repeated, p.optional, None] for p in pattern]


def restored(lists: list) -> list:
    return [Text(*x) if len(x) == 3 else Group([(s, restored(c)) for s, c in x[0]], x[1], x[2]) for x in lists]


# --- matching ------------------------------------------------------------------------

def packed(pattern: list) -> list:
    """The pattern as lists: ["#", sure literal or null, optional, whether it varied] and
    ["<>", [[signature, content], ...], repeated, optional]."""
    return [["#", p.value if sure(p) else None, p.optional, p.value is None] if isinstance(p, Text) else
            ["<>", [[s, packed(c)] for s, c in p.items], p.repeated, p.optional] for p in pattern]


def _tree(page: str) -> list:
    """The page's nodes: ("#", texts) and (signature, nodes)."""
    root: list = []
    open_ = [root]
    for kind, what in pieces(page):
        if kind == "text":
            if open_[-1] and open_[-1][-1][0] == "#":
                open_[-1][-1][1].append(what)
            else:
                open_[-1].append(("#", [what]))
        elif _tag(what) in VOID:
            continue
        elif kind == "open":
            inner: list = []
            open_[-1].append((what, inner))
            open_.append(inner)
        elif len(open_) > 1:
            open_.pop()
    return root


def _how(p: list) -> str:
    return "literal" if p[1] is not None else "slot" if p[3] else "fixed"


def _fit(pattern: list, nodes: list) -> list | None:
    """For every node what it matches, "literal", "slot" (that varied) or "fixed" of a text or the content of an element;
    None if the sequence doesn't match.  Only the nodes' own texts and signatures are looked at."""
    m, n = len(pattern), len(nodes)
    if m == n == 1 and pattern[0][0] == nodes[0][0] == "#":
        return [_how(pattern[0])] if pattern[0][1] in (None, " ".join(nodes[0][1])) else None
    keys = _masks([x[0] for x in nodes])
    texts = _masks([" ".join(x[1]) if x[0] == "#" else None for x in nodes])

    def turn(p) -> int:
        """The places at which a text or a turn of a group stands."""
        if p[0] == "#":
            return keys("#") if p[1] is None else texts(p[1])
        here = -1
        for k, item in enumerate(p[1]):
            here &= keys(item[0]) >> k
        return here

    def row(i: int, after: int) -> tuple[int, int]:
        # bits: pattern[m - i:] matches the nodes from there; wanted: so with p taken at least once
        p = pattern[m - 1 - i]
        size, here = (1, turn(p)) if p[0] == "#" else (len(p[1]), turn(p))
        taken = after >> size & here
        if p[0] != "#" and p[2]:
            while here and size <= n:
                taken |= taken >> size & here
                here &= here >> size
                size *= 2
        return taken, taken | after if p[2 if p[0] == "#" else 3] else taken
    whole, rows = _rows(m, n, row, 1 << n)
    if not whole & 1:
        return None
    out: list = []
    i = 0
    for p, taken in zip(pattern, rows):
        bits = taken.to_bytes((n >> 3) + 1, "little")
        while bits[i >> 3] >> (i & 7) & 1:
            if p[0] == "#":
                out.append(_how(p))
                i += 1
                break
            out += [content for _, content in p[1]]
            i += len(p[1])
            if not p[2]:
                break
    return out


def matched(pattern: list | None, page: str) -> Iterator[tuple[tuple[str, ...], str, str]]:
    """(path, text, how) of all blocks: "slot", "fixed", "literal", or "none" in an element whose content doesn't match."""
    work: list = [((), pattern, _tree(page), 0, None)]
    while work:
        path, wanted, nodes, i, fit = work.pop()
        if i == 0:
            fit = _fit(wanted, nodes) if wanted is not None else None
        while i < len(nodes):
            key, inner = nodes[i]
            i += 1
            if key != "#":
                work.append((path, wanted, nodes, i, fit))
                work.append(((*path, key), None if fit is None else fit[i - 1], inner, 0, None))
                break
            how = "none" if fit is None else fit[i - 1]
            for text in inner:
                yield path, text, how


class Wrapper:
    def __init__(self, packed: str | None):
        held = json.loads(packed) if packed else {"pattern": None, "region": [], "article": True, "literals": []}
        self.pattern = held["pattern"]
        self.article = held["article"]
        self.region = tuple(held["region"])
        self.literals = {(tuple(p), t) for p, t in held["literals"]}
        self.known: dict[tuple, int] = {}

    def _kind(self, path: tuple[str, ...], around: tuple[str, ...]) -> int:
        kind = self.known.get((path, around))
        if kind is None:
            if len(self.known) > 100_000:
                self.known.clear()
            kind = self.known[path, around] = max(kind_of(path, around), kind_of(path, self.region))
        return kind

    def text(self, page: str) -> str:
        return self.kept(list(matched(self.pattern, page)))

    def kept(self, found: list[tuple[tuple[str, ...], str, str]]) -> str:
        """The main text of a page whose blocks ``found`` holds, as ``matched`` gives them."""
        sizes: dict[tuple[str, ...], int] = {}
        for path, text, _ in found:
            sizes[path] = sizes.get(path, 0) + len(text)
        around = _around(sizes)
        kept: dict[int, list[str]] = {0: [], 1: [], 2: []}
        for path, text, how in found:
            kind = self._kind(path, around)
            # An article's words that don't vary are its own; a literal elsewhere is the template's.
            if kind < 0 or kind == 0 and (how == "literal" or how == "none" and (path, text) in self.literals):
                continue
            kept[0].append(text)
            if self.region and path[:len(self.region)] == self.region:
                kept[1].append(text)
            if kind == 2:
                kept[2].append(text)
        return "\n\n".join(self.article and kept[2] or kept[1] or kept[0])


# --- Spark -----------------------------------------------------------------------------

def _hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
                        host.alias("host"), F.xxhash64("html").alias("draw"))


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows without those whose html the task has met on their host."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        if len(seen) > SEEN:
            seen.clear()
        new = []
        for i, page in enumerate(zip(batch.column("host").to_pylist(), batch.column("draw").to_pylist())):
            if page not in seen:
                seen.add(page)
                new.append(i)
        yield batch if len(new) == len(batch) else batch.take(pa.array(new, pa.int64()))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pattern of each run of rows of one host and part: pages, of which equal ones follow each other, or patterns of some."""
    key, pattern, last = None, None, None

    def closed():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([json.dumps(stored(pattern))], pa.string())],
                                          names=["host", "part", "pattern"])
    for batch in batches:
        pages = "html" in batch.schema.names
        names = ("host", "part", "draw" if pages else "old")
        for host, part, order, item in zip(*(batch.column(c).to_pylist() for c in names), batch.column("html" if pages else "pattern")):
            if (host, part, order) == last:
                continue
            last = host, part, order
            new = read(item.as_py()) if pages else restored(json.loads(item.as_py()))
            if (host, part) != key:
                if key is not None:
                    yield closed()
                key, pattern = (host, part), new
            else:
                pattern = align(pattern, new)
    if key is not None:
        yield closed()


SEEN = 1 << 18               # pages that a task remembers
PATTERN_SCHEMA = "host string, part long, pattern string"


def _in_parts(rows: DataFrame, held: DataFrame, order: str, at_once: int) -> DataFrame:
    """Rows with the part of their host that they are dealt to by ``order``, parts of about ``at_once`` rows;
    ``held(host, n)``: rows of each host."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / at_once)).cast("long")
    return rows.join(held, "host").withColumn("part", F.pmod(order, parts))


def host_patterns(pages: DataFrame, at_once: int = SAMPLE_PAGES) -> DataFrame:
    """(host, pattern as JSON) of all pages of every host: parts of a host's pages are aligned first, then the
    parts' patterns, ``at_once`` of them at a time until a host has one.  Pages of equal html are one."""
    ship_package(pages.sparkSession)
    rows = _hosts(pages).where(F.col("html").isNotNull()).select("host", "draw", "html")
    held = cut(rows.select("host", "draw").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    placed = _in_parts(rows, held, "draw", at_once).select("host", "part", "draw", "html")
    placed = placed.mapInArrow(_first_seen, "host string, part long, draw long, html string")
    patterns = cut(placed.repartition("host", "part").sortWithinPartitions("host", "part", "draw").mapInArrow(_aligned, PATTERN_SCHEMA))
    while True:
        held = cut(patterns.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
        if held.where("n > 1").isEmpty():
            return patterns.select("host", "pattern")
        # parts of a host are numbered from 0: neighbours meet
        groups = _in_parts(patterns.withColumnRenamed("part", "old"), held, "old", at_once)
        groups = groups.select("host", "part", "old", "pattern").repartition("host", "part").sortWithinPartitions("host", "part", "old")
        last, patterns = patterns, cut(groups.mapInArrow(_aligned, PATTERN_SCHEMA))
        discard(last)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page's blocks: texts, and by number their paths (elements joined by newlines), and how they match.  A page without
    html has none."""
    patterns: dict[str | None, list | None] = {}
    for batch in batches:
        for first in range(0, len(batch), PAGES_OUT):
            some = batch.slice(first, PAGES_OUT)
            out: list[dict] = []
            for page, pattern in zip(some.column("html"), some.column("pattern")):
                pattern = pattern.as_py()
                if pattern not in patterns:
                    if len(patterns) > 1000:
                        patterns.clear()
                    patterns[pattern] = packed(restored(json.loads(pattern))) if pattern is not None else None
                paths: dict[tuple[str, ...], int] = {}
                row: dict = {"text": [], "path": [], "how": []}
                sizes: dict[tuple[str, int], int] = {}
                for path, text, how in matched(patterns[pattern], page.as_py() or ""):
                    at = paths.setdefault(path, len(paths))
                    row["text"].append(text)
                    row["path"].append(at)
                    row["how"].append(HOWS.index(how))
                    sizes[how, at] = sizes.get((how, at), 0) + len(text)
                out.append({**row, "paths": ["\n".join(p) for p in paths], "sizes": [{"how": h, "at": at, "size": n} for (h, at), n in sizes.items()]})
            found = pa.RecordBatch.from_pylist(out, schema=BLOCKS)
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("page_id", "url", "host", "draw")), *found.columns],
                                             names=["page_id", "url", "host", "draw", *BLOCKS.names])


HOWS = ("slot", "fixed", "literal", "none")
PAGES_OUT = 256              # pages whose blocks leave a task at once
BLOCKS = pa.schema([("text", pa.list_(pa.string())), ("path", pa.list_(pa.int32())), ("how", pa.list_(pa.int32())), ("paths", pa.list_(pa.string())),
                    ("sizes", pa.list_(pa.struct([("how", pa.string()), ("at", pa.int32()), ("size", pa.int64())])))])
BLOCK_SCHEMA = ("page_id long, url string, host string, draw long, text array<string>, path array<int>, how array<int>, paths array<string>, "
                "sizes array<struct<how: string, at: int, size: bigint>>")


def _wrapped(rows: pd.DataFrame) -> pd.DataFrame:
    """A host's wrapper without its pattern, which the blocks have met: of rows (how, path, size) and one with the pattern."""
    took: dict[str, dict[tuple[str, ...], int]] = {}
    for how, path, size in zip(rows["how"], rows["path"], rows["size"]):
        took.setdefault(how, {})[tuple(path.split("\n")) if path else ()] = int(size)
    region, article = content_of(took)
    held = {"pattern": None, "region": region, "article": article, "literals": literals_of(restored(json.loads(rows["pattern"].iloc[0])))}
    return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [json.dumps(held)]})


def host_wrappers(patterns: DataFrame, blocks: DataFrame) -> DataFrame:
    """(host, wrapper as JSON): the content of every host by the match of all its pages, those of equal html being one."""
    pages = blocks.groupBy("host", "draw").agg(F.first(F.struct("paths", "sizes")).alias("p"))
    sizes = pages.select("host", "p.paths", F.explode("p.sizes").alias("s")).select(
        "host", "s.how", F.element_at("paths", F.col("s.at") + 1).alias("path"), "s.size")
    sizes = sizes.groupBy("host", "how", "path").agg(F.sum("size").alias("size"))
    none = patterns.select("host", F.lit("none").alias("how"), F.lit("").alias("path"), F.lit(0).cast("long").alias("size"), "pattern")
    rows = sizes.where("how in ('slot', 'fixed')").join(patterns, "host").unionByName(none)
    return rows.groupBy("host").applyInPandas(_wrapped, "host string, wrapper string")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers: dict[str | None, Wrapper] = {}
    for batch in batches:
        texts = []
        for i, wrapper in enumerate(batch.column("wrapper").to_pylist()):
            if wrapper not in wrappers:
                if len(wrappers) > 1000:
                    wrappers.clear()
                wrappers[wrapper] = Wrapper(wrapper)
            paths = [tuple(p.split("\n")) if p else () for p in batch.column("paths")[i].as_py()]
            parts = (batch.column(c)[i].as_py() for c in ("path", "text", "how"))
            texts.append(wrappers[wrapper].kept([(paths[at], text, HOWS[how]) for at, text, how in zip(*parts)]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, at_once: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url and main text of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Blocks are joined by an empty line.  A null html gives an empty text; pages without a host
    (null or relative url) share one wrapper; repeated rows are extracted each.  Wrappers come from all pages; ``at_once``
    only says how many a group aligns.
    """
    patterns = host_patterns(pages, at_once)
    met = _hosts(pages).join(patterns, "host", "left").select("page_id", "url", "host", "draw", "html", "pattern")
    blocks = cut(met.mapInArrow(_matched, BLOCK_SCHEMA))
    wrappers = cut(host_wrappers(patterns, blocks.where(F.size("sizes") > 0)))
    return blocks.join(wrappers, "host", "left").select("page_id", "url", "paths", "path", "text", "how", "wrapper").mapInArrow(
        _extracted, "page_id long, url string, text string")
