"""Leaf blocks of an HTML page: the text between two block-level tags, with its ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Elements that stand in a line of text; all other elements end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements without content.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video select datalist head title".split())
#: Elements that may stand in a head; any other one ends it.
HEAD_PARTS = frozenset("html head title base link meta style script noscript template".split())
#: Content that is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that a new one of the same group closes.
SIBLINGS = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option", "p": "p"}
#: Elements that hold the parts of a page.
HOLDERS = frozenset("article main section aside nav header footer form div td body".split())
LISTS = frozenset("ul ol dl table tbody thead tfoot select".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value only behind an equals sign
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"?|'[^']*'?|[^\s>]+)")
_PARTS = re.compile(r"[A-Za-z]+?(?=[A-Z]|[^A-Za-z]|$)")
_SPACES = re.compile(r"\s+")


@dataclass
class _Open:
    """An open element. What it shares with its parent is the parent's own, so depth costs nothing."""

    tag: str
    parent: "_Open | None"
    tags: frozenset[str]
    names: frozenset[str]
    near: tuple[str, ...]
    holder: str | None
    hides: bool

    @classmethod
    def under(cls, parent: "_Open | None", tag: str, names: list[str], hides: bool) -> "_Open":
        tags, known, near, holder = (parent.tags, parent.names, parent.near, parent.holder) if parent else (frozenset(), frozenset(), (), None)
        return cls(
            tag, parent, tags if tag in tags else tags | {tag}, known if known.issuperset(names) else known.union(names),
            tuple(names) if names else near, tag if tag in HOLDERS else holder, hides,
        )


@dataclass
class Block:
    """Text of a block and the element it stands in, the innermost of its ancestors."""

    text: str
    inside: _Open | None = None
    linked: int = 0
    links: int = 0
    fields: int = 0

    @property
    def tag(self) -> str | None:
        return self.inside.tag if self.inside else None

    @property
    def tags(self) -> frozenset[str]:
        return self.inside.tags if self.inside else frozenset()

    @property
    def names(self) -> frozenset[str]:
        return self.inside.names if self.inside else frozenset()

    @property
    def near(self) -> tuple[str, ...]:
        return self.inside.near if self.inside else ()

    @property
    def holder(self) -> str | None:
        """The innermost ancestor that says what part of a page this is."""
        return self.inside.holder if self.inside else None

    @property
    def path(self) -> list[str]:
        """Tags of all ancestors, the outermost first."""
        out, at = [], self.inside
        while at:
            out.append(at.tag)
            at = at.parent
        return out[::-1]


def leaf_blocks(page: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """Blocks with text, in page order; white space inside a block is one space.

    Broken markup is read as browsers do as far as text goes: unclosed elements end with
    their parent, stray end tags are ignored, an unclosed comment or script hides the rest. Text
    and elements that may not stand in a head end it. Block elements with the attribute hidden are
    not text. ``known``: the names worth keeping; all are kept without it, and then memory grows
    with the square of the depth where every level has a name of its own.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[_Open] = []
    pieces: list[str] = []
    hidden = 0
    opened: Counter[str] = Counter()
    state = {"links": 0, "linked": 0, "fields": 0, "in_link": 0}

    def close(depth: int) -> None:
        nonlocal hidden
        for o in stack[depth:]:
            hidden -= o.hides
            opened[o.tag] -= 1
        del stack[depth:]

    def flush() -> None:
        if pieces:
            text = _SPACES.sub(" ", "".join(pieces)).strip()
            if text:
                linked = min(state["linked"], len(text))
                out.append(Block(text, stack[-1] if stack else None, linked, state["links"], state["fields"]))
            pieces.clear()
        state.update(links=0, linked=0, fields=0)

    def end_head() -> None:
        if stack and stack[-1].tag == "head":
            close(len(stack) - 1)

    def add(raw: str) -> None:
        if hidden and raw.strip():
            end_head()
        if raw and not hidden:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if state["in_link"]:
                state["linked"] += len(text.strip())

    at, size = 0, len(page)
    find = _TOKEN.search
    while at < size:
        found = find(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(1):
            if tag == "a":
                state["in_link"] = 0
            if tag in INLINE:
                continue
            if tag == "br":
                add(" ")
                continue
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None) if opened[tag] else None
            if depth is None:
                flush()
                continue
            flush()
            close(depth)
            continue
        if tag not in HEAD_PARTS:
            end_head()
        if tag in INLINE:
            if tag == "a" and "href" in found.group(3):
                state["links"] += 1
                state["in_link"] = 1
            continue
        if tag in ("br", "img", "wbr"):
            add(" " if tag == "br" else "")
            continue
        if tag in ("input", "button", "textarea", "select", "option"):
            state["fields"] += 1
        flush()
        state["in_link"] = 0
        if tag in EMPTY:
            continue
        if tag == "body" and opened["head"]:
            close(next(k for k, o in enumerate(stack) if o.tag == "head"))
        group = SIBLINGS.get(tag)
        for k in range(len(stack) - 1, -1, -1):
            if group and SIBLINGS.get(stack[k].tag) == group:
                close(k)
                break
            if stack[k].tag == "p" and tag not in SIBLINGS:
                close(k)
                break
            if stack[k].tag in LISTS or stack[k].tag not in SIBLINGS:
                break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            if tag == "textarea":
                state["fields"] += 1
            at = end.end() if end else size
            continue
        if found.group(3).rstrip().endswith("/") and tag in ("path", "use", "circle", "rect", "line", "g"):
            continue
        names = [p.lower() for v in _NAMED.findall(found.group(3)) for p in _PARTS.findall(v)] if "=" in found.group(3) else []
        if known is not None:
            names = [n for n in names if n in known]
        hides = tag in HIDDEN or ("hidden" in found.group(3).lower() and "hidden" in _VALUE.sub(" ", found.group(3)).lower().split())
        stack.append(_Open.under(stack[-1] if stack else None, tag, names, hides))
        opened[tag] += 1
        hidden += hides
    flush()
    return out
