"""Leaf blocks of an HTML page: text runs between block-level tags, with their tag path."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_UNQUOTED = re.compile(r"[^>\"']*")
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

#: Fixed values of HTML: elements whose content is no text, inline elements, elements without content.
HIDDEN = frozenset("script style noscript template title svg math iframe object canvas audio video".split())
#: Hidden elements that run to the end of the page if nothing ends them; the others then hide nothing.
RAW = frozenset("script style title iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav noframes ol optgroup option"
    " p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
#: Block-level elements that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


#: Innermost elements of a block's path that are kept.
DEEPEST = 64


@dataclass(slots=True)
class Token:
    """A tag (tag is set), a comment or declaration, or a CDATA section (text is set)."""

    start: int
    end: int
    closing: bool = False
    tag: str = ""
    attributes: str = ""
    text: str | None = None


class Scanner:
    """Finds the tokens of a page in one forward pass.

    What can't end is looked for once: behind the last `>` there is no tag, behind the last quote of
    a kind none is closed, and places from which a quoted reading is known to fail aren't read again.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.failing: set[int] = set()

    def _tag_end(self, at: int) -> int:
        """Place of the `>` that ends a tag whose attributes start here; quoted ones don't count, unless a quote stays open."""
        page, first, met = self.page, at, []
        while at not in self.failing:
            at = _UNQUOTED.match(page, at).end()
            if at >= len(page):
                break
            if page[at] == ">":
                return at
            close = page.find(page[at], at + 1) if self.quotes[page[at]] > at else -1
            if close < 0:
                break
            at = close + 1
            met.append(at)
        self.failing.update(met)
        return page.find(">", first)

    def next(self, at: int) -> Token | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
                mark, end = (4, "-->") if page[at + 2] == "-" else (9, "]]>")
                close = page.find(end, at + mark)
                stop = len(page) if close < 0 else close + 3
                return Token(at, stop, text=page[at + 9 : len(page) if close < 0 else close] if mark == 9 else None)
            if page[at + 1 : at + 2] in ("!", "?"):
                close = page.find(">", at)
                return Token(at, len(page) if close < 0 else close + 1)
            if at > self.last:
                return None if page.find("<!", at) < 0 and page.find("<?", at) < 0 else self._declaration(at + 1)
            name = _NAME.match(page, at)
            if name:
                close = self._tag_end(name.end())
                return Token(at, close + 1, bool(name[1]), name[2].lower(), page[name.end() : close])
            at += 1
        return None

    def _declaration(self, at: int) -> Token | None:
        """Behind the last `>` only comments and declarations are tokens."""
        found = [i for i in (self.page.find("<!", at), self.page.find("<?", at)) if i >= 0]
        return self.next(min(found)) if found else None

    def raw_end(self, tag: str, at: int) -> int:
        """Where the end tag of a raw element ends, or -1."""
        end = _RAW_END[tag].search(self.page, at, self.last + 1)
        return end.end() if end else -1


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def _labels(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    words = [tag]
    if attributes and "=" in attributes:
        for m in _MARK.finditer(attributes):
            words += ["." + w for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())]
    return tuple(words)


def _ends(scanner: Scanner, at: int) -> dict[int, int]:
    """Where the hidden elements from `at` on end, by the end of their start tag; only those with a matching end tag."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    unended: set[str] = set()
    while t := scanner.next(at):
        at, tag = t.end, t.tag
        if tag not in HIDDEN:
            continue
        if t.closing:
            if opened.get(tag):
                found[opened[tag].pop()] = at
        elif not t.attributes.endswith("/"):
            opened.setdefault(tag, []).append(at)
            #: A title inside svg is no raw text.
            if tag in RAW and tag != "title" and tag not in unended:
                end = scanner.raw_end(tag, at)
                at = end if end >= 0 else at
                if end < 0:
                    unended.add(tag)
    return found


def blocks(page: str) -> list[Block]:
    """All non-empty blocks in page order.

    An element that HTML doesn't know is inline. Both tags of head are optional and it holds nothing visible but its hidden elements: text or
    any other element ends it. So it hides nothing itself.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link = 0, False
    ends: dict[int, int] | None = None
    scanner = Scanner(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, tuple(w for _, words in stack[-DEEPEST:] for w in words), min(linked, len(text))))
            parts.clear()
        linked = 0

    at = 0
    while at < len(page):
        t = scanner.next(at)
        text = page[at : t.start] if t else page[at:]
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not t:
            break
        at, tag = t.end, t.tag
        if not tag:
            if t.text is not None:
                parts.append(html.escape(t.text))
            continue
        if tag == "head":
            flush()
            continue
        if tag in HIDDEN:
            if not t.closing and not t.attributes.endswith("/"):
                if tag in RAW:
                    end = scanner.raw_end(tag, at)
                    at = end if end >= 0 else len(page)
                else:
                    ends = _ends(scanner, t.start) if ends is None else ends
                    at = ends.get(at, at)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE or tag not in BLOCK and tag not in VOID:
            if tag == "a":
                in_link = not t.closing
            continue
        flush()
        in_link = False
        if tag in VOID:
            continue
        if t.closing:
            #: What is taken off the stack was put there once, so looking for the tag costs no more than that.
            while held[tag]:
                top = stack.pop()[0]
                held[top] -= 1
                if top == tag:
                    break
            continue
        shut = _CLOSES.get(tag, frozenset(["p"]) if tag in _ENDS_P else frozenset())
        while stack and stack[-1][0] in shut:
            held[stack.pop()[0]] -= 1
        stack.append((tag, _labels(tag, t.attributes)))
        held[tag] += 1
    flush()
    return out
