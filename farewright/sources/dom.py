"""The parts of an HTML page that are asked for, each handed on when it closes: no tree of the page is held."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Characters of a page that are parsed at a time.
CHUNK = 1 << 16
#: What reads alike under any rules of parsing: texts, end tags, tags with quoted attributes, scripts and styles without
#: a further "</" or "<!", comments without dashes. Elements whose text is not markup are none of the plain tags.
_RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext|svg|math"
_ATTRS = r"""(?:[ \t\n]+[a-zA-Z][a-zA-Z0-9_-]*(?:="[^"<>\x00\r]*"|='[^'<>\x00\r]*')?)*"""
_PLAIN = re.compile(
    rf"([^<\x00\r]+)|</([a-zA-Z][a-zA-Z0-9]*)>|(<(?!(?:{_RAW})\b)[a-zA-Z][a-zA-Z0-9]*{_ATTRS}[ \t\n]*/?>)"
    rf"|(<(script|style){_ATTRS}>)((?:[^<\x00\r]|<(?![/!]))*)</\5>|<!--[^<>\x00\r-]*-->", re.IGNORECASE | re.ASCII)
_TAG = re.compile(r"<([a-zA-Z0-9]+)")
_ATTR = re.compile(r"""[ \t\n]+([a-zA-Z0-9_-]+)(?:="([^"]*)"|='([^']*)')?""")
#: References that are read alike in texts and in attributes, the last one last.
_KNOWN = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_REFS = [ref for ref, _ in _KNOWN]


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)

    @property
    def text(self) -> str:
        if len(self.parts) == 1 and type(self.parts[0]) is str:
            return self.parts[0]
        return "".join([p for p in self._inside() if type(p) is str])

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def _inside(self) -> list:
        """All nodes and strings below, in the page's order; pages may nest as deep as they are long."""
        out, left = [], self.parts[::-1]
        while left:
            p = left.pop()
            out.append(p)
            if type(p) is Node and p.parts:
                left += p.parts[::-1]
        return out

    def walk(self) -> list[Node]:
        return [p for p in self._inside() if type(p) is Node]

    def is_a(self, tag: str | None = None, cls: str | None = None, **attrs: str) -> bool:
        if tag is not None and tag != self.tag or cls is not None and cls not in self.classes:
            return False
        return not attrs or all(self.attrs.get(k.replace("_", "-")) == v for k, v in attrs.items())

    def all(self, tag: str | None = None, cls: str | None = None, **attrs: str) -> list[Node]:
        return [n for n in self.walk() if n.is_a(tag, cls, **attrs)]

    def first(self, *args, **kw) -> Node | None:
        return next((n for n in self.walk() if n.is_a(*args, **kw)), None)


class _Cutter(HTMLParser):
    """Keeps the open elements, and what is inside of the outermost wanted one."""

    def __init__(self, wanted: Callable[[Node], bool]) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted, self.count = wanted, {}
        self.open: list[Node] = []
        self.inside: int | None = None
        self.found: list[Node] = []
        self.ready: list[Node] = []

    def _add(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        if self.inside is not None:
            self.open[-1].parts.append(node)
        if self.wanted(node):
            self.found.append(node)
            if self.inside is None:
                self.inside = len(self.open)
        return node

    def _release(self) -> None:
        if self.inside is not None and len(self.open) <= self.inside:
            self.ready += self.found
            self.found, self.inside = [], None

    def begin(self, tag: str, attrs: dict[str, str], whole: bool = False) -> None:
        node = self._add(tag, attrs)
        if whole or tag in VOID:
            self._release()
        else:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_starttag(self, tag, attrs):
        self.begin(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.begin(tag, {k: v or "" for k, v in attrs}, True)

    def handle_endtag(self, tag):
        closed = "" if self.count.get(tag) else tag
        while closed != tag:
            closed = self.open.pop().tag
            self.count[closed] -= 1
        self._release()

    def handle_data(self, data):
        if self.inside is not None:
            self.open[-1].parts.append(data)


class _OneTag(HTMLParser):
    """The name and attributes of a start tag."""

    def handle_starttag(self, tag, attrs):
        self.got = tag, attrs


def _known(text: str) -> str:
    """The known references read, others left."""
    for ref, char in _KNOWN:
        if ref in text:
            text = text.replace(ref, char)
    return text


def _read(text: str) -> str:
    """References of a text; the common ones without a call for each."""
    return _known(text) if text.count("&") == sum(map(text.count, _REFS)) else unescape(text)


@lru_cache(1 << 12)
def _plain_tag(text: str) -> tuple[str, dict[str, str], bool]:
    """Name, attributes (shared, not to be changed) and whether the tag closes itself."""
    name = _TAG.match(text)
    attrs = {k.lower(): a or b for k, a, b in _ATTR.findall(text, name.end())}
    if "&" in text:
        read = {k: _read(v) for k, v in attrs.items()}
        # Other references than the known ones differ in attributes, unless they are none in texts either.
        if any(read[k] != _known(v) for k, v in attrs.items()):
            one = _OneTag()
            one.feed(text)
            read = {k: v or "" for k, v in one.got[1]}
        attrs = read
    return name[1].lower(), attrs, text.endswith("/>")


def _read_plain(cut: _Cutter, html: str) -> Iterator[int]:
    """Gives a cutter what is plain, several times as fast as its own reading, up to the first thing that is not.
    Yields the place that is reached, whenever elements are ready and at the end."""
    at = 0
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            break
        kind, at = m.lastindex, m.end()
        if kind == 1:
            if cut.inside is not None:
                text = m[1]
                cut.handle_data(_read(text) if "&" in text else text)
        elif kind == 2:
            cut.handle_endtag(m[2].lower())
        elif kind == 3:
            cut.begin(*_plain_tag(m[3]))
        elif kind is not None:
            tag, attrs, _ = _plain_tag(m[4])
            cut.begin(tag, attrs)
            if m[6]:
                cut.handle_data(m[6])
            cut.handle_endtag(tag)
        if cut.ready:
            yield at
    yield at


def parts(html: str, wanted: Callable[[Node], bool]) -> Iterator[Node]:
    """The wanted elements of a page, in its order. Those inside another wanted one follow it, when the
    outermost closes; what is still open at the end closes there."""
    cut, at = _Cutter(wanted), 0
    for at in _read_plain(cut, html):  # noqa: B007
        yield from cut.ready
        cut.ready.clear()
    for start in range(at, len(html), CHUNK):
        cut.feed(html[start : start + CHUNK])
        yield from cut.ready
        cut.ready.clear()
    cut.close()
    yield from cut.ready
    yield from cut.found


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()
