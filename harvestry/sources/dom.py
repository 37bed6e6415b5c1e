"""A small document tree over the standard library's HTML tokenizer, and the selectors that read it.

Implied ends of p, li, dt, dd, options and table parts are made; void and raw-text elements are known; what is open at
the end closes there. Formatting elements aren't reconstructed, so counts of b-like tags in broken pages may differ
from a browser's. A ``<template shadowrootmode="open">`` is the shadow root of its parent: light-tree matches come
first, shadow content is searched only without any, and ``a >>> b`` goes through it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template".split())
BLOCKY = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
SPACE = re.compile(r"[\s﻿]+")
URL_ATTRIBUTES = frozenset("href src data-src data-href action poster".split())


class Node:
    """An element: its children are nodes and strings."""

    __slots__ = ("tag", "attrs", "parent", "children", "place", "shadow", "top")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.top: Node = parent.top if parent is not None else self
        self.children: list[Node | str] = []
        self.place = 0  # among the document's elements, in order
        self.shadow: Node | None = None

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        todo = self.children[::-1]
        while todo:
            n = todo.pop()
            if n.__class__ is not str:
                yield n
                todo += n.children[::-1]

    def _strings(self) -> Iterator[str]:
        for c in self.shadow.children if self.shadow else self.children:
            if isinstance(c, str):
                yield c
            elif c.tag == "slot" and self.shadow:
                yield from (s for x in self.children for s in ([x] if isinstance(x, str) else x._strings()))
            elif c.tag not in UNREAD:
                yield from c._strings()

    @property
    def text(self) -> str:
        """Text content without scripts and styles, white space made single."""
        return SPACE.sub(" ", "".join(self._strings())).strip()

    @property
    def inner_html(self) -> str:
        return "".join(c if isinstance(c, str) else c.outer_html for c in self.children)

    @property
    def outer_html(self) -> str:
        head = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        return f"<{self.tag}{head}>" + ("" if self.tag in VOID else f"{self.inner_html}</{self.tag}>")


class Document(Node):
    """The root of a parsed page, which isn't changed after the parse: it knows which elements have a tag, an id, a class
    or an attribute, so that a selector looks at these alone."""

    __slots__ = ("shadowed", "_known")

    def __init__(self):
        super().__init__("#document", {}, None)
        self.shadowed, self._known = False, None

    def having(self, key: str | None) -> list[Node]:
        """The elements of a key (see _compound) in document order; all of them without one."""
        if self._known is None:
            known: dict[str | None, list[Node]] = {None: list(self.walk())}
            for n in known[None]:
                known.setdefault(n.tag, []).append(n)
                for a, v in n.attrs.items():
                    known.setdefault(f"[{a}", []).append(n)
                    for name in dict.fromkeys(v.split()) if a == "class" else ():
                        known.setdefault(f".{name}", []).append(n)
                    if a == "id":
                        known.setdefault(f"#{v}", []).append(n)
            self._known = known
        return self._known.get(key, [])

    def release(self) -> None:
        """Takes the tree apart, as its circles would stay in memory until a collection."""
        todo: list[Node] = [self]
        while todo:
            n = todo.pop()
            todo += n.elements
            if n.shadow is not None:
                todo.append(n.shadow)
            n.children, n.parent, n.shadow, n.top = [], None, None, None
        self._known = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Document()
        self.at, self.count = self.root, 0

    def _close(self, tags: set[str], bound: set[str]) -> None:
        n = self.at
        while n.parent is not None and n.tag not in bound:
            if n.tag in tags:
                self.at = n.parent
                return self._close(tags, bound)
            n = n.parent
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKY:
            self._close({"p"}, {"td", "th", "button", "#document"} | {"div", "section", "article", "li", "body"} if self.at.tag != "p" else {"#document"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in ("html", "body") and any(n.tag == tag for n in self.root.walk()):
            return
        self.count += 1
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        node = Node(tag, found, self.at)
        node.place = self.count
        if tag == "template" and found.get("shadowrootmode") == "open" and self.at.shadow is None:
            self.at.shadow, self.root.shadowed = node, True
        else:
            self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            if n.tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html", "div"):
                return
            n = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Document:
    """The document node of a page; null gives an empty document."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


# ---- selectors -------------------------------------------------------------------------------------------------

_NAME = r"-?[A-Za-z_¡-￿][\w¡-￿-]*"
_SIMPLE = re.compile(
    rf"""(?P<star>\*)|(?P<tag>{_NAME})|\#(?P<id>[\w¡-￿-]+)|\.(?P<cls>{_NAME})
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+))\s*(?P<case>[iI])?)?\s*\]
    |:(?P<pseudo>[a-z-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?""",
    re.X,
)


class BadSelector(ValueError):
    """A selector that isn't understood; such a selector matches nothing."""


def _nth(text: str):
    text = {"odd": "2n+1", "even": "2n"}.get(text.strip(), text.replace(" ", ""))
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if not m:
        raise BadSelector(text)
    if m[3]:
        return lambda k: k == int(m[3])
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    return lambda k: (k - b) % a == 0 and (k - b) // a >= 0 if a else k == b


def _pseudo(name: str, arg: str | None):
    same = lambda n: [e for e in n.parent.elements if e.tag == n.tag] if n.parent else [n]
    among = lambda n: n.parent.elements if n.parent else [n]
    if name == "not":
        inner = compile_selector(arg or "")
        return lambda n, scope: not any(m(n, scope) for m, _ in inner)
    if name in ("is", "where", "matches"):
        inner = compile_selector(arg or "")
        return lambda n, scope: any(m(n, scope) for m, _ in inner)
    if name == "has":
        return lambda n, scope: bool(_light(arg or "", n))
    simple = {
        "first-child": lambda n, _: among(n)[0] is n, "last-child": lambda n, _: among(n)[-1] is n, "only-child": lambda n, _: len(among(n)) == 1,
        "first-of-type": lambda n, _: same(n)[0] is n, "last-of-type": lambda n, _: same(n)[-1] is n, "only-of-type": lambda n, _: len(same(n)) == 1,
        "empty": lambda n, _: not any(isinstance(c, Node) or c for c in n.children), "root": lambda n, _: n.tag == "html", "scope": lambda n, scope: n is scope,
        "checked": lambda n, _: "checked" in n.attrs or "selected" in n.attrs, "disabled": lambda n, _: "disabled" in n.attrs,
    }
    if name in simple and arg is None:
        return simple[name]
    if name in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type") and arg is not None:
        fits, group, back = _nth(arg), same if name.endswith("type") else among, "last" in name
        return lambda n, _: fits((lambda g: len(g) - g.index(n) if back else g.index(n) + 1)(group(n)))
    raise BadSelector(f":{name}")


def _attribute(name: str, op: str | None, value: str, fold: bool):
    low = (lambda s: s.lower()) if fold else (lambda s: s)
    value = low(value)
    test = {
        None: lambda v: True, "=": lambda v: v == value, "~=": lambda v: bool(value) and value in v.split(), "^=": lambda v: bool(value) and v.startswith(value),
        "$=": lambda v: bool(value) and v.endswith(value), "*=": lambda v: bool(value) and value in v, "|=": lambda v: v == value or v.startswith(f"{value}-"),
    }[op]
    return lambda n, _: name in n.attrs and test(low(n.attrs[name]))


def _compound(text: str, at: int):
    """A test of an element, where the text goes on, and the key of all elements that can pass: #id, .class, [attribute
    or a tag; None for any."""
    tests, keys, begin = [], {}, at
    while at < len(text) and (m := _SIMPLE.match(text, at)):
        if m["tag"] or m["star"]:
            if at != begin:
                break
            if m["tag"]:
                tests.append(lambda n, _, t=m["tag"].lower(): n.tag == t)
                keys["tag"] = m["tag"].lower()
        elif m["id"]:
            tests.append(lambda n, _, i=m["id"]: n.attrs.get("id") == i)
            keys["id"] = f"#{m['id']}"
        elif m["cls"]:
            tests.append(lambda n, _, c=m["cls"]: c in n.classes)
            keys["cls"] = f".{m['cls']}"
        elif m["attr"]:
            tests.append(_attribute(m["attr"].lower(), m["op"], next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), ""), bool(m["case"])))
            keys["attr"] = f"[{m['attr'].lower()}"
        else:
            tests.append(_pseudo(m["pseudo"], m["arg"]))
        at = m.end()
    if at == begin:
        raise BadSelector(text)
    return (lambda n, scope: n.tag != "#document" and all(t(n, scope) for t in tests)), at, next((keys[k] for k in ("id", "cls", "attr", "tag") if k in keys), None)


def _before(n: Node) -> list[Node]:
    among = n.parent.elements if n.parent else []
    return among[: among.index(n)] if n in among else []


def _complex(text: str):
    text, at = text.strip(), 0
    steps = []
    relative = re.match(r"[>+~]", text)
    combinator, key = "", None
    if relative:  # "> a" is relative to the scope
        steps.append(("", lambda n, scope: n is scope))
        combinator, at = text[0], len(re.match(r"[>+~]\s*", text)[0])
    while at < len(text):
        test, at, key = _compound(text, at)
        steps.append((combinator, test))
        gap = re.match(r"\s*([>+~]?)\s*", text[at:])
        if at + gap.end() < len(text) or gap[1]:
            if not gap[0] or at + gap.end() >= len(text):
                raise BadSelector(text)
            combinator = gap[1] or " "
        at += gap.end()
    if not steps:
        raise BadSelector(text)

    def matches(n: Node, scope: Node, k: int = len(steps) - 1) -> bool:
        how, test = steps[k]
        if not test(n, scope):
            return False
        if k == 0:
            return True
        if how == ">":
            return n.parent is not None and matches(n.parent, scope, k - 1)
        if how == "+":
            return bool(b := _before(n)) and matches(b[-1], scope, k - 1)
        if how == "~":
            return any(matches(b, scope, k - 1) for b in _before(n))
        up = n.parent
        while up is not None:
            if matches(up, scope, k - 1):
                return True
            up = up.parent
        return False

    return matches, key


def _split(text: str, mark: str) -> list[str]:
    """Parts at a mark outside brackets and quotes."""
    out, depth, quote_mark, begin = [], 0, "", 0
    k = 0
    while k < len(text):
        c = text[k]
        if quote_mark:
            quote_mark = "" if c == quote_mark else quote_mark
        elif c in "\"'":
            quote_mark = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif not depth and text.startswith(mark, k):
            out.append(text[begin:k])
            begin = k + len(mark)
            k = begin - 1
        k += 1
    return [*out, text[begin:]]


@functools.lru_cache(maxsize=2048)
def compile_selector(text: str) -> tuple:
    """Matchers of a selector list, each with the key of what it can match."""
    return tuple(_complex(part) for part in _split(text, ","))


def _light(selector: str, scope: Node) -> list[Node]:
    try:
        matchers = compile_selector(selector)
    except BadSelector:
        return []
    if not isinstance(scope, Document):
        return [n for n in scope.walk() if any(m(n, scope) for m, _ in matchers)]
    found = [[n for n in scope.having(key) if m(n, scope)] for m, key in matchers]
    filled = [x for x in found if x]
    return filled[0] if len(filled) == 1 else sorted({id(n): n for x in filled for n in x}.values(), key=lambda n: n.place)


def _shadows(scope: Node) -> Iterator[Node]:
    for n in (scope, *scope.walk()):
        if n.shadow is not None:
            yield n.shadow
            yield from _shadows(n.shadow)


def query(selector: str, scope: Node) -> list[Node]:
    """All matches below a scope in document order; open shadow roots only where the light tree has none."""
    if ">>>" in selector:
        scopes = [scope]
        for part in _split(selector, ">>>"):
            scopes = list(dict.fromkeys(n for s in scopes for n in (query(part.strip(), s) or [x for r in _shadows(s) for x in _light(part.strip(), r)])))
        return scopes
    found = _light(selector, scope)
    if found or not getattr(scope.top, "shadowed", True):
        return found
    return [n for root in _shadows(scope) for n in _light(selector, root)]


def resolve(selector: str | None, scope: Node) -> list[Node]:
    """A field's elements: ``:scope`` is the scope itself, a leading ``+`` (``++``) looks in the next (second next)
    sibling element."""
    if not selector or selector == ":scope":
        return [scope] if scope.tag != "#document" else scope.elements[:1]
    m = re.match(r"(\++)\s*(.*)$", selector, re.S)
    if m and scope.tag != "#document":
        among = scope.parent.elements
        k = among.index(scope) + len(m[1])
        if k >= len(among):
            return []
        scope, selector = among[k], m[2]
        if not selector:
            return [scope]
    return query(selector, scope)


@functools.lru_cache(maxsize=8192)
def absolute(url: str, base: str) -> str:
    """A link resolved against a base, its path and query percent-encoded; what can't be resolved stays as it is."""
    try:
        joined = urlsplit(urljoin(base, SPACE.sub("", url) if "\n" in url or "\t" in url else url.strip()))
        if not joined.scheme or (joined.scheme in ("http", "https") and not joined.hostname):
            return url
        if joined.scheme not in ("http", "https", "ftp", "ws", "wss"):
            return urlunsplit(joined)
        host = joined.hostname if joined.hostname.isascii() else joined.hostname.encode("idna").decode()
        port = f":{joined.port}" if joined.port and joined.port != {"http": 80, "https": 443}.get(joined.scheme) else ""
        user = joined.netloc.rpartition("@")[0]
        netloc = (f"{user}@" if user else "") + (f"[{host}]" if ":" in host else host) + port
        return urlunsplit((joined.scheme, netloc, quote(joined.path or "/", safe="/%:@!$&'()*+,;=~-._|[]^"), quote(joined.query, safe="/%:@!$&()*+,;=~-._?[]{}|^`\\"), quote(joined.fragment, safe="/%:@!$&'()*+,;=~-._?#[]{}|^\\")))
    except (ValueError, UnicodeError):
        return url


def read(node: Node, attr: str | None, base: str, resolve_urls: bool | str | None = None) -> str | None:
    """An element's text, inner HTML or attribute; link attributes are made absolute unless told not to."""
    if not attr or attr == "text":
        value = node.text
    elif attr == "html":
        value = node.inner_html
    else:
        value = node.attrs.get(attr.lower())
    if value is None:
        return None
    if resolve_urls or (attr in URL_ATTRIBUTES and resolve_urls is not False):
        return absolute(value, resolve_urls if isinstance(resolve_urls, str) else base)
    return value
