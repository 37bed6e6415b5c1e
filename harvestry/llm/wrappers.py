"""Main text of pages by union-free wrapper inference.

A page becomes a stream of block-level tags (class, id and role in their names, implied ends made explicit) and text
slots; inline markup belongs to the slot around it, but for hidden elements and inline adverts, whose text goes. Adjacent
equal groups of any length fold into repeated groups, so a list is one ``( li # /li )+``. The distinct folded streams of
a host, the most frequent first, are aligned one after another with the host's expression: what matches stays, what only
one side has becomes optional, a group that stands once on one side and repeats on the other becomes repeated. No
alternatives are ever made (union-free). A host of many structures is done in parts of PART, whose expressions are
aligned in their turn. A text slot's symbol holds its ancestors, so every slot of the finished wrapper stands in one
place. Each page's stream is matched against its host's wrapper, which gives every text of the page its slot, and the
slot is kept or dropped for the whole host:

* Kept is what stands inside the content element (``article``, else ``main``, else one named like content, else the
  body; the first of them that a page has), and in nothing that is a menu, header, footer, form, hidden or named like a
  sidebar, notice, advert or reader comments. A class or id is such a name as a whole only: all its parts are words for
  boilerplate or for places ("share-box" is one, "share-price" and "side-effects" aren't).
* An element with such a name is no boilerplate if it encloses the content: if it holds half or more of the
  text on the host's pages that have it (menus, headers and the like aside). Inside the content such names don't count on
  headings, paragraphs, sections and headers.
* Inside the content a slot that holds the same text on all pages that have it is template text and dropped. That takes
  PAGES pages of different content; copies and near copies of a page count once. Headings stay, unless all around them
  in their element goes. No page becomes empty by this.

Only distinct folded streams are gathered, a count each, pre-aggregated before they are shuffled: a host with a third
of all pages costs as many rows as it has page structures. Wrappers are sent to all executors if they are small
(checked), else dealt to the pages by host, in SALTS parts a host. Null and empty pages give the empty text; urls that
can't be parsed share one wrapper; repeated rows each keep a row; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import functools
import html as html_entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, map_arrow

SMALL = 4 << 20  # bytes of wrappers that are sent to every executor
SALTS = 16
PAGES = 5  # pages of different content that must hold a text before it counts as the host's template
PART = 64  # structures of a host that one task aligns
CELLS = 1 << 28  # bits of an alignment that are held at once; longer streams are halved
RULES = ("article", "main", "name", "body")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav aside button select option datalist input dialog menu object audio video canvas".split()) | RAW
#: A new one of these ends an open one (and what is open inside) up to the tags that bound it.
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tr td th", "tfoot": "tbody tr td th"}
BOUND = frozenset("table ul ol dl div section article main body html aside nav form".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
#: Words that name boilerplate, and words that say where or what kind an element is: a name of both only is boilerplate's.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsors sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "subscription signup sidebar side aside menu menus submenu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead comment comments commentlist disqus reply replies respond responses "
    "discussion share sharing social related recommended recommendations widget widgets toolbar login skip hidden".split()
)
PLACES = frozenset(
    "article entry law info site page main global top bottom left right primary secondary area bar box block buttons button links link list items item wrap wrapper container panel section inner outer thread form text content body row col column "
    "column posts post articles more to up sign in follow us icons icon policy message center centre unit slot holder group title head".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
INLINE_ADS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion".split())
CONTENT = re.compile(r"(?:^|[-_\s])(?:article|content|main|post|entry|story|text|body)(?:$|[-_\s])", re.I)
#: What these are named says nothing about them inside the content: names there are slugs of what they hold.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 hgroup p section header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())

#: A tag's attributes by the tokenizer's states: an unquoted value ends at white space or >, whatever quotes it holds.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[\s/]++|[^\s/>][^\s/>=]*+(?>\s*+=\s*+(?>"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+)*+)(?:>|\Z)"""
    r"""|(?P<text>[^<]+|<)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?>\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^\s>"'][^\s>]*+))?+)?+""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _parts(token: str) -> list[str]:
    """The lower-case words of a class or id: cut at anything but letters, and before a capital in camel case."""
    return [x.lower() for x in _PART.findall(token)]


@functools.lru_cache(maxsize=65536)
def boilerplate(names: str) -> bool:
    """Whether one of some class names or ids is as a whole a name for boilerplate."""
    found = [_parts(t) for t in names.split()]
    return any(any(x in BOILERPLATE for x in t) and all(x in BOILERPLATE or x in PLACES for x in t) for t in found)


def _commentary(names: str) -> bool:
    return any((t := _parts(x)) and t[0] in COMMENT_WORDS and all(y in BOILERPLATE or y in PLACES for y in t) for x in names.split())


@functools.lru_cache(maxsize=4096)
def _symbol(name: str, rest: str) -> tuple[str, str]:
    """A tag's symbol for the expression, and its mark: ! if it is dropped with all it holds, ? if its name says so."""
    plain = "!" if name in DROPPED else "?" if name == "form" else ""
    if not rest.strip(" /\t\r\n\f"):
        return name, plain
    found: dict[str, str] = {}
    for k, *values in _ATTRIBUTE.findall(rest):
        found.setdefault(k.lower(), html_entities.unescape("".join(values)))
    role = found.get("role", "").strip().lower()
    drop = name in DROPPED or "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or role in ROLES
    drop = drop or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I) is not None
    named = " ".join(found.get(k, "") for k in ("class", "id"))
    if name in INLINE:
        return name, "!" if drop or any(t.lower() in INLINE_ADS for t in named.split()) else ""
    classes = " ".join(sorted(found.get("class", "").split()))
    symbol = name + (f".{classes}" if classes else "") + (f"#{re.sub(r'\d+', '0', found['id'])}" if found.get("id") else "") + (f"@{role}" if role else "")
    if not drop and name not in ("body", "html", "article", "main") and boilerplate(named):
        plain = "?"
    return symbol, "!" if drop else plain


def stream(html: str) -> Iterator[tuple[str, str, str]]:
    """(symbol or text, kind, mark): kinds are < (a block opens), > (it closes), # (text), b (inline, or a line break).

    A dropped inline element takes the text up to its end, or to the end of the block that it stands in.
    """
    open_tags: list[tuple[str, str]] = []
    unseen: list = []  # of a dropped inline element: its name, the blocks open around it, how many of its name are open

    def close(upto: int) -> Iterator[tuple[str, str, str]]:
        while len(open_tags) > upto:
            _, symbol = open_tags.pop()
            if unseen and len(open_tags) < unseen[1]:
                unseen.clear()
            yield symbol, ">", ""

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        if m["text"] is not None or m["cdata"] is not None:
            if not unseen:
                yield m["text"] or m["cdata"], "#", ""
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in INLINE:
                if unseen and unseen[0] == name:
                    unseen[2] -= 1
                    if not unseen[2]:
                        unseen.clear()
                yield name, "b", ""
                continue
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == name:
                    yield from close(k)
                    break
                if open_tags[k][0] in ("td", "th", "table") and name not in BOUND and name not in ("tr", "tbody", "thead", "tfoot"):
                    break
            else:
                if name == "p":
                    yield "p", "<", ""
                    yield "p", ">", ""
            continue
        rest = m["rest"]
        symbol, mark = _symbol(name, rest)
        if name in RAW and not rest.rstrip().endswith("/"):
            after = re.compile(rf"</{re.escape(name)}\s*(?:>|/|\Z)", re.I).search(html, at)
            at = html.find(">", after.start()) + 1 or end if after else end
            yield symbol, "b" if name in ("svg", "math") else "<", "!"
            if name not in ("svg", "math"):
                yield symbol, ">", ""
            continue
        if name in INLINE or (name in VOID and name != "hr"):
            if unseen and unseen[0] == name:
                unseen[2] += 1
            elif mark == "!" and not unseen and name not in VOID:
                unseen[:] = [name, len(open_tags), 1]
            yield name, "b", ""
            continue
        if name in ENDS_P:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == "p":
                    yield from close(k)
                    break
                if open_tags[k][0] in BOUND or open_tags[k][0] in ("td", "th", "li"):
                    break
        if name in ENDS:
            ends = ENDS[name].split()
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] in ends:
                    yield from close(k)
                elif open_tags[k][0] in BOUND:
                    break
        yield symbol, "<", mark
        if name in VOID or rest.rstrip().endswith("/") and name not in ("p", "div", "article", "section"):
            yield symbol, ">", ""
        else:
            open_tags.append((name, symbol))
    yield from close(0)


def blocks(html: str) -> tuple[list[str], list[str]]:
    """The page's symbols and its texts (one for each slot among the symbols).

    A slot's symbol is # and the symbols above it. An element's symbol has its mark in front; text without any character
    but white space is no slot.
    """
    symbols, texts, path, held = [], [], [], []

    def text() -> None:
        if held:
            value = " ".join(html_entities.unescape("".join(held)).split())
            held.clear()
            if value:
                symbols.append("#" + "\x1f".join(path))
                texts.append(value)

    for value, kind, mark in stream(html):
        if kind == "#":
            held.append(value)
        elif kind == "b":
            if value in ("br", "img"):
                held.append(" ")
        elif kind == "<":
            text()
            path.append(mark + value)
            symbols.append(f"<{path[-1]}")
        else:
            text()
            if path:
                symbols.append(f">{path.pop()}")
    text()
    return symbols, texts


# An expression is a tuple of nodes; a node is a symbol, or (body, optional, repeated) with a body of nodes.


def fold(nodes: tuple) -> tuple:
    """Adjacent equal runs become one repeated group, shortest bodies first, until none is left."""
    nodes = list(nodes)
    changed = True
    while changed:
        changed, size, numbers = False, 1, _numbered(nodes)
        while size <= len(nodes) // 2:
            if _repeats(numbers, size):
                nodes, some = _folded(nodes, size)
                if some:
                    changed, numbers = True, _numbered(nodes)
            size += 1
    return tuple(nodes)


def _numbered(nodes: list) -> np.ndarray:
    known: dict = {}
    return np.array([known.setdefault(n, len(known)) for n in nodes], np.int64)


def _repeats(numbers: np.ndarray, size: int) -> bool:
    """Whether a run of this many nodes stands next to an equal one, or next to the group that it made."""
    same = numbers[size:] == numbers[:-size]
    if np.count_nonzero(same) < size:
        return False
    ends = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
    return bool(np.diff(ends).max() > size)


def _folded(nodes: list, size: int) -> tuple[list, bool]:
    """One pass for bodies of one size."""
    out, k, changed = [], 0, False
    while k < len(nodes):
        body = nodes[k : k + size]
        n = 1
        while len(body) == size and nodes[k + n * size : k + (n + 1) * size] == body and _balanced(body):
            n += 1
        if n > 1:
            out.append(_group(tuple(body), False, True))
            k += n * size
            changed = True
        elif size == 1 or not _same_as_last(out, body):
            out.append(nodes[k])
            k += 1
        else:
            k += size
            changed = True
    return out, changed


def _balanced(body: list) -> bool:
    depth = 0
    for x in body:
        if isinstance(x, str) and x[0] in "<>":
            depth += 1 if x[0] == "<" else -1
            if depth < 0:
                return False
    return depth == 0


def _same_as_last(out: list, body: list) -> bool:
    """Whether the run just repeats the group before it once more."""
    return bool(out) and isinstance(out[-1], tuple) and out[-1][2] and list(out[-1][0]) == body


def _group(body: tuple, optional: bool, repeated: bool):
    if len(body) == 1 and isinstance(body[0], tuple):
        return (body[0][0], body[0][1] or optional, body[0][2] or repeated)
    return (body, optional, repeated)


def _core(node) -> tuple:
    return node[0] if isinstance(node, tuple) else (node,)


def _wrap_like(nodes: tuple, other: tuple) -> tuple:
    """Runs of nodes that are the body of a group on the other side become that group, standing once."""
    bodies = sorted({n[0] for n in other if isinstance(n, tuple) and len(n[0]) > 1}, key=lambda b: (-len(b), repr(b)))
    for body in bodies:
        out, k = [], 0
        while k < len(nodes):
            if nodes[k : k + len(body)] == body:
                out.append((body, False, False))
                k += len(body)
            else:
                out.append(nodes[k])
                k += 1
        nodes = tuple(out)
    return nodes


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """For each further member of x, a bit a member of y: 0 where it makes the longest common subsequence longer."""
    full = (1 << len(y)) - 1
    places: dict[int, int] = {}
    for k, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << k
    row = full
    for v in x:
        hit = row & places.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of x and each beginning of y."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def common(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence; both are halved where the rows would take more than CELLS bits."""
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return common(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in common(x[half:], y[cut:])]
    rows = [*_rows(x[::-1], y[::-1])][::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i] >> (len(y) - 1 - j) & 1:
            j += 1
        else:
            i += 1
    return out


def align(a: tuple, b: tuple) -> tuple:
    """The union-free expression that covers both."""
    if a == b:
        return a
    a, b = _wrap_like(a, b), _wrap_like(b, a)
    ca, cb = [_core(x) for x in a], [_core(x) for x in b]
    head = 0
    while head < min(len(ca), len(cb)) and ca[head] == cb[head]:
        head += 1
    tail = 0
    while tail < min(len(ca), len(cb)) - head and ca[len(ca) - 1 - tail] == cb[len(cb) - 1 - tail]:
        tail += 1
    numbers: dict = {}
    x, y = ([numbers.setdefault(v, len(numbers)) for v in c[head : len(c) - tail]] for c in (ca, cb))
    out = [_both(p, q) for p, q in zip(a[:head], b[:head], strict=True)]
    i, j = head, head
    for p, q in [(head + p, head + q) for p, q in common(x, y)] + [(len(a) - tail, len(b) - tail)]:
        out += _optional(a[i:p]) + _optional(b[j:q])  # apart: a group of both sides' nodes would cover neither
        if p < len(a) - tail:
            out.append(_both(a[p], b[q]))
        i, j = p + 1, q + 1
    out += [_both(p, q) for p, q in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)] if tail else []
    return tuple(out)


def _both(p, q):
    if isinstance(p, str) and isinstance(q, str):
        return p
    flags = [(n[1], n[2]) if isinstance(n, tuple) else (False, False) for n in (p, q)]
    return (_core(p), flags[0][0] or flags[1][0], flags[0][1] or flags[1][1])


def _optional(nodes: list) -> list:
    """Nodes that only one side has: each balanced run is one optional group."""
    out: list = []
    run: list = []
    for n in nodes:
        run.append(n)
        if _balanced(run):
            out.append(_group(tuple(run), True, False) if not (len(run) == 1 and isinstance(run[0], str)) else ((run[0],), True, False))
            run = []
    return out + [n if isinstance(n, tuple) and n[1] else (_core(n), True, isinstance(n, tuple) and n[2]) for n in run]


def infer(streams: list[tuple[tuple, int]]) -> tuple:
    """The wrapper of a host's folded streams and their numbers of pages."""
    ordered = [s for s, _ in sorted(streams, key=lambda x: (-x[1], len(x[0]), repr(x[0])))]
    wrapper = ordered[0]
    for s in ordered[1:]:
        wrapper = align(wrapper, s)
    return wrapper


def _symbols(nodes: tuple) -> Iterator[str]:
    for n in nodes:
        if isinstance(n, tuple):
            yield from _symbols(n[0])
        else:
            yield n


def _name(symbol: str) -> str:
    return re.split(r"[.#@]", symbol.lstrip("<>!?"), maxsplit=1)[0]


def _names(symbol: str) -> str:
    """The classes, id and role of an element, as words apart."""
    return re.sub(r"[.#@]", " ", symbol.partition(_name(symbol))[2])


def _inside(path: tuple[str, ...], rule: str) -> int:
    """Depth of the content element on a path, -1 if there is none, -2 if the whole body is content."""
    if rule == "body":
        return -2
    for k, s in enumerate(path):
        name = _name(s)
        if rule == "article" and name == "article" or rule == "main" and (name == "main" or s.endswith("@main")):
            return k
        if rule == "name" and s[0] not in "!?" and name in ("div", "section", "td") and CONTENT.search(re.sub(r"[.#@]", " ", s.partition(name)[2])):
            return k
    return -1


def _harmless(symbol: str) -> bool:
    """Whether a named element's name says nothing about it inside the content."""
    name = _name(symbol)
    if name in TEXTUAL:
        return not (name == "section" and _commentary(_names(symbol)))
    return name != "form" and not boilerplate(" ".join(t for t in _names(symbol).split() if not {"header", "masthead"} & set(_parts(t))))


def keeps(path: tuple[str, ...], rule: str, enclosing: frozenset | None) -> bool:
    """Whether a slot below these elements is content; enclosing: the named elements that enclose content (None: all)."""
    depth = _inside(path, rule)
    if depth == -1:
        return False
    for k, s in enumerate(path):
        if s[0] == "!":
            return False
        name = _name(s)
        if name == "footer" or name == "header" and (depth < 0 or k < depth):
            return False
        if s[0] == "?":
            around = enclosing is None or path[: k + 1] in enclosing
            if not (around if k <= depth else _harmless(s) or depth < 0 and around):
                return False
        if name == "article" and k > depth >= 0 and rule == "article" and boilerplate(_names(s)):
            return False
    return True


def _named(path: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The named elements above a slot that might enclose the content."""
    return [path[: k + 1] for k, s in enumerate(path) if s[0] == "?" and not _commentary(_names(s))]


class Automaton:
    """Matches streams with an expression. Sets of states are made as they come up, and kept."""

    def __init__(self, wrapper: tuple):
        self.symbols: list[str | None] = [None]  # of each state; None where nothing is read. State 0 is the end
        self.next: list[list[int]] = [[]]
        start = self._add(None, [self._build(wrapper, 0)])
        self.start, self.sets = (start,), {}

    def _add(self, symbol: str | None, targets: list[int]) -> int:
        self.symbols.append(symbol)
        self.next.append(targets)
        return len(self.symbols) - 1

    def _build(self, nodes: tuple, after: int) -> int:
        for n in reversed(nodes):
            if not isinstance(n, tuple):
                after = self._add(n, [after])
            elif n[2]:
                loop = self._add(None, [])
                inner = self._build(n[0], loop)
                self.next[loop] += [inner, after]
                after = loop if n[1] else inner
            else:
                inner = self._build(n[0], after)
                after = self._add(None, [inner, after]) if n[1] else inner
        return after

    def _onward(self, states: tuple[int, ...]) -> tuple[dict, int | None]:
        """By symbol, the states reached and from which they are; and from which the end is."""
        if states not in self.sets:
            seen, by_symbol, end = set(), {}, None
            for state in states:
                todo = self.next[state][::-1]
                while todo:
                    k = todo.pop()
                    if k in seen:
                        continue
                    seen.add(k)
                    if k == 0:
                        end = state
                    elif self.symbols[k] is None:
                        todo += self.next[k][::-1]
                    else:
                        by_symbol.setdefault(self.symbols[k], {})[k] = state
            self.sets[states] = {x: (tuple(v), v) for x, v in by_symbol.items()}, end
        return self.sets[states]

    def match(self, stream: list[str]) -> list[int] | None:
        """The state that reads each symbol, None if the expression doesn't cover the stream."""
        if len(self.sets) > 20_000:
            self.sets.clear()
        states, back = self.start, []
        for x in stream:
            found = self._onward(states)[0].get(x)
            if found is None:
                return None
            states = found[0]
            back.append(found[1])
        at = self._onward(states)[1]
        if at is None:
            return None
        out = []
        for origin in reversed(back):
            out.append(at)
            at = origin[at]
        return out[::-1]


class Reader:
    """A host's wrapper, and what is kept of its slots (facts: rows of _facts; none at first)."""

    def __init__(self, wrapper: str, facts: list[dict] | None = None):
        self.automaton = Automaton(_unpack(wrapper))
        self.paths = {k: tuple(x[1:].split("\x1f")) if len(x) > 1 else () for k, x in enumerate(self.automaton.symbols) if x and x[0] == "#"}
        facts = facts or []
        self.enclosing = frozenset(tuple(f["element"].split("\x1f")) for f in facts if f["slot"] < 0 and 2 * f["own"] >= f["total"])
        self.wide = {k: [keeps(p, r, None) for r in RULES] for k, p in self.paths.items()}
        self.strict = {k: [keeps(p, r, self.enclosing) for r in RULES] for k, p in self.paths.items()}
        self.named = {k: _named(p) for k, p in self.paths.items()}
        self.template = self._template({f["slot"]: f for f in facts if f["slot"] >= 0})

    def _template(self, facts: dict[int, dict]) -> set[int]:
        """The slots that hold one text on all of enough different pages."""
        same = {k for k, f in facts.items() if f["low"] == f["high"] and max((f[c] & (1 << 64) - 1).bit_count() for c in ("x", "y")) >= max(PAGES, min(f["n"] // 2, 24))}
        around: dict[tuple, list] = {}
        heading = {k for k, p in self.paths.items() if any(_name(s) in HEADINGS for s in p)}
        for k in facts:
            inner = max(_inside(self.paths[k], r) for r in RULES[:3])
            for end in range(inner + 2, len(self.paths[k])):
                around.setdefault(self.paths[k][:end], []).append(k)
        gone = {p for p, slots in around.items() if all(k in same for k in slots) and any(k not in heading for k in slots)}
        return {k for k in same if k not in heading or any(self.paths[k][:end] in gone for end in range(1, len(self.paths[k])))}

    def place(self, html: str) -> tuple[list[int], list[str]]:
        """The slots of a page, and its texts."""
        symbols, texts = blocks(html)
        states = self.automaton.match(symbols)
        if states is None:
            raise ValueError("a page isn't covered by its host's wrapper")
        return [s for s, x in zip(states, symbols, strict=True) if x[0] == "#"], texts

    def content(self, slots: list[int]) -> list[int]:
        """The places of a page's content, before anything is known of its named elements."""
        for r in range(len(RULES)):
            if found := [k for k, s in enumerate(slots) if self.wide[s][r]]:
                return found
        return []

    def read(self, html: str) -> str:
        """A page's main text."""
        slots, texts = self.place(html)
        for keep, rules in ((self.strict, range(len(RULES))), (self.wide, range(2))):
            for r in rules:
                if found := [k for k, s in enumerate(slots) if keep[s][r]]:
                    varying = [k for k in found if slots[k] not in self.template]
                    return "\n\n".join(texts[k] for k in varying or found)
        return ""


def host(url: str = "url") -> Column:
    """The lower-cased host of a url column, '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _pack(nodes: tuple) -> str:
    """An expression as JSON: the distinct symbols, and the nodes with numbers for them."""
    numbers: dict[str, int] = {}

    def plain(n):
        return [[plain(x) for x in n[0]], n[1], n[2]] if isinstance(n, tuple) else numbers.setdefault(n, len(numbers))

    body = [plain(n) for n in nodes]
    return json.dumps([list(numbers), body])


def _unpack(packed: str) -> tuple:
    symbols, body = json.loads(packed)

    def node(n):
        return (tuple(node(x) for x in n[0]), n[1], n[2]) if isinstance(n, list) else symbols[n]

    return tuple(node(n) for n in body)


def _streams(pages: DataFrame) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found: Counter = Counter()
            folded: dict[tuple, str] = {}
            for h, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                if page:
                    own = tuple(blocks(page)[0])
                    if own not in folded:
                        folded[own] = _pack(fold(own))
                    found[h, folded[own]] += 1
            if not found:
                return None
            keys = list(found)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["host", "stream", "n"])

        return work

    return map_arrow(pages, make, "host string, stream string, n bigint", "html").groupBy("host", "stream").agg(F.sum("n").alias("n"))


def wrappers(pages: DataFrame, work: Workspace) -> DataFrame:
    """host and wrapper (packed). pages: host, html.

    A task aligns PART expressions of a host at most; what a round makes of them are the next round's expressions, each
    with the pages of all that went into it.
    """

    def aligned(key, rows):
        import pandas as pd

        found = infer([(_unpack(s), int(n)) for s, n in zip(rows["stream"], rows["n"], strict=True)])
        return pd.DataFrame({"host": [key[0]], "stream": [_pack(found)], "n": [int(rows["n"].sum())]})

    level = work.write(_streams(pages), "streams")
    while True:
        numbers = level.groupBy("host").agg(F.count("*").alias("held"))
        if (numbers.agg(F.max("held")).first()[0] or 0) <= 1:
            return level.select("host", F.col("stream").alias("wrapper"))
        parts = F.ceil(F.col("held") / PART).cast("bigint")
        dealt = level.join(numbers, "host").withColumn("part", F.pmod(F.xxhash64("stream"), parts))
        following = work.write(dealt.groupBy("host", "part").applyInPandas(aligned, "host string, stream string, n bigint"), "level")
        work.drop(level)
        level = following


def _with_readers(pages: DataFrame, known: DataFrame, handle, schema: str) -> DataFrame:
    """handle(batch, readers by host) over all pages. known: host, wrapper, facts (JSON, may be null)."""
    size = known.agg(F.sum(F.length("host") + F.length("wrapper") + F.coalesce(F.length("facts"), F.lit(0)))).first()[0] or 0

    def reader(wrapper: str, facts: str | None) -> Reader:
        return Reader(wrapper, json.loads(facts) if facts else None)

    if size <= SMALL:
        sent = {r.host: (r.wrapper, r.facts) for r in known.collect()}

        def make():
            readers: dict[str, Reader] = {}

            def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                for h in set(batch["host"].to_pylist()) - readers.keys():
                    if h in sent:
                        readers[h] = reader(*sent[h])
                return handle(batch, readers)

            work.caches = (readers,)
            return work

        return map_arrow(pages, make, schema, "html")
    names = pages.columns
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    rows = pages.withColumn("salt", salt).withColumn("wrapper", F.lit(None).cast("string")).withColumn("facts", F.lit(None).cast("string"))
    first = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    both = rows.unionByName(first, allowMissingColumns=True).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("wrapper").isNull())

    def make_dealt():
        readers: dict[str, Reader] = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            heads = batch["wrapper"].is_valid().to_pylist()
            out, start = [], 0
            for k in [k for k, x in enumerate(heads) if x] + [len(heads)]:
                if k > start and (got := handle(batch.slice(start, k - start).select(names), readers)) is not None:
                    out.append(got)
                if k < len(heads):
                    readers.clear()
                    readers[batch["host"][k].as_py()] = reader(batch["wrapper"][k].as_py(), batch["facts"][k].as_py())
                start = k + 1
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

        work.caches = (readers,)
        return work

    return map_arrow(both, make_dealt, schema, "html")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


FACTS = "host string, slot int, element string, n bigint, low bigint, high bigint, x bigint, y bigint, own bigint, total bigint"


def _facts(pages: DataFrame, known: DataFrame) -> DataFrame:
    """host and facts (JSON): of each content slot the pages, its least and largest hashed text and bitmaps of the
    pages' contents; of each named element around content (slot -1) the text in it and in the pages that have it."""

    def handle(batch: pa.RecordBatch, readers: dict[str, Reader]) -> pa.RecordBatch | None:
        found: dict[tuple, list[int]] = {}
        for h, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
            if not page:
                continue
            slots, texts = readers[h].place(page)
            content = readers[h].content(slots)
            hashes = [zlib.crc32(texts[k].encode("utf-8", "surrogatepass")) for k in content]
            x, y = (1 << (min((v * m & 0xFFFFFFFF for v in hashes), default=0) * 0x9E3779B1 >> 20 & 63) for m in (0x85EBCA6B, 0xC2B2AE35))
            for k, v in zip(content, hashes, strict=True):
                f = found.setdefault((h, slots[k], ""), [0, v, v, 0, 0, 0, 0])
                f[:5] = f[0] + 1, min(f[1], v), max(f[2], v), f[3] | x, f[4] | y
            shown = [k for k, s in enumerate(slots) if readers[h].wide[s][-1]]
            total = sum(len(texts[k]) for k in shown)
            inside: Counter = Counter()
            for k in shown:
                for element in readers[h].named[slots[k]]:
                    inside[element] += len(texts[k])
            for element, own in inside.items():
                f = found.setdefault((h, -1, "\x1f".join(element)), [0, 0, 0, 0, 0, 0, 0])
                f[0], f[5], f[6] = f[0] + 1, f[5] + own, f[6] + total
        if not found:
            return None
        columns = [*zip(*found, strict=True), *zip(*([*f[:3], _signed(f[3]), _signed(f[4]), *f[5:]] for f in found.values()), strict=True)]
        kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "slot", "element", "n", "low", "high", "x", "y", "own", "total"])

    rows = _with_readers(pages, known, handle, FACTS).groupBy("host", "slot", "element")
    rows = rows.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("x").alias("x"), F.bit_or("y").alias("y"), F.sum("own").alias("own"), F.sum("total").alias("total"))
    return rows.groupBy("host").agg(F.to_json(F.collect_list(F.struct("slot", "element", "n", "low", "high", "x", "y", "own", "total"))).alias("facts"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    work = Workspace(pages.sparkSession, "wrappers")
    rows = pages.selectExpr("cast(page_id as bigint) page_id", "url", "cast(html as string) html").withColumn("host", host())
    known = wrappers(rows.select("host", "html"), work)
    facts = _facts(rows, known.withColumn("facts", F.lit(None).cast("string")))
    known = work.write(known.join(facts, "host", "left"), "facts")

    def handle(batch: pa.RecordBatch, readers: dict[str, Reader]) -> pa.RecordBatch:
        texts = [readers[h].read(page) if page else "" for h, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return _with_readers(rows, known, handle, "page_id bigint, url string, text string, n_chars bigint")
