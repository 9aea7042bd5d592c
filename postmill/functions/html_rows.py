"""Per-page helper of the details job: what needs the nesting of a page.

A page becomes a flat outline in document order. Every entry knows its parent and where its
content ends, so text, siblings and children are slices of one list.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from postmill.functions import fixed_values as fv

# Elements without content, and elements whose text is not page text.
VOID = set(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
NO_TEXT = {"script", "style", "template", "rt", "rp"}

_MARKUP = re.compile(
    r"<!--.*?-->|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>",
    re.S,
)
_RAW_TEXT_END = {t: re.compile(f"</{t}", re.I) for t in ("script", "style")}
_CLASS = re.compile(r"""(?is)(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Outline:
    """Parallel lists over entries; a text entry has no tag, entry 0 is the page itself."""

    def __init__(self, page: str):
        self.tag: list[str | None] = [""]
        self.content = [""]  # text of a text entry, attributes of an element
        self.parent = [-1]
        self.end = [0]
        self._open = [0]
        self._open_tags: Counter[str] = Counter()
        self._read(page)
        while self._open:
            self.end[self._open.pop()] = len(self.tag)

    def _add(self, tag: str | None, content: str) -> int:
        self.tag.append(tag)
        self.content.append(content)
        self.parent.append(self._open[-1])
        self.end.append(len(self.tag))
        return len(self.tag) - 1

    def _read(self, page: str) -> None:
        at = 0
        while at < len(page):
            markup = _MARKUP.search(page, at)
            upto = markup.start() if markup else len(page)
            if upto > at:
                text = page[at:upto]
                self._add(None, html.unescape(text) if "&" in text else text)
            if not markup:
                return
            at = markup.end()
            if markup["tag"]:
                tag = markup["tag"].lower()
                if markup["end"]:
                    self._close(tag)
                else:
                    self._start(tag, markup["rest"])
                    if tag in _RAW_TEXT_END and self._open_tags[tag]:
                        stop = _RAW_TEXT_END[tag].search(page, at)
                        upto = stop.start() if stop else len(page)
                        if upto > at:
                            self._add(None, page[at:upto])
                        at = upto

    def _start(self, tag: str, rest: str) -> None:
        entry = self._add(tag, rest)
        if tag not in VOID and not rest.endswith("/"):
            self._open.append(entry)
            self._open_tags[tag] += 1

    def _close(self, tag: str) -> None:
        """Close up to the element; an end tag without a start is ignored."""
        closed = not self._open_tags[tag]
        while not closed:
            entry = self._open.pop()
            self.end[entry] = len(self.tag)
            self._open_tags[self.tag[entry]] -= 1
            closed = self.tag[entry] == tag

    # -- queries -------------------------------------------------------------

    def all(self, tag: str, inside: int = 0):
        return (i for i in range(inside + 1, self.end[inside]) if self.tag[i] == tag)

    def _elements(self, at: int, last: int):
        while at < last:
            if self.tag[at] is not None:
                yield at
            at = self.end[at]

    def next_siblings(self, at: int):
        return self._elements(self.end[at], self.end[self.parent[at]])

    def children(self, at: int):
        return self._elements(at + 1, self.end[at])

    def pieces(self, at: int = 0):
        """Text pieces; hidden text counts only when asked for its own element."""
        own = self.tag[at]
        for i in range(at, self.end[at]):
            if self.tag[i] is None:
                holder = self.tag[self.parent[i]]
                if holder not in NO_TEXT or holder == own:
                    yield self.content[i]

    def text(self, at: int = 0, sep: str = "") -> str:
        return sep.join(p for p in (x.strip() for x in self.pieces(at)) if p)

    def css(self, at: int) -> str:
        found = _CLASS.search(self.content[at])
        return html.unescape(found[1] or found[2] or found[3] or "") if found else ""


def _heading(page: Outline, word: str):
    return next((i for i in page.all("h3") if page.text(i) == word), None)


def _after_heading(page: Outline, word: str, tag: str, css_class: str | None, sep: str):
    """Text of the first later sibling that fits, else of the next sibling element."""
    at = _heading(page, word)
    if at is None:
        return None
    later = list(page.next_siblings(at))
    fitting = (
        i for i in later
        if page.tag[i] == tag and (css_class is None or css_class in page.css(i).split())
    )
    found = next(fitting, later[0] if later else None)
    return None if found is None else page.text(found, sep)


def _sidebar(page: Outline):
    at = _heading(page, fv.SIDEBAR_HEADING)
    rows = []
    if at is not None:
        for div in page.all("div", inside=page.parent[at]):
            if all(w in page.css(div) for w in fv.SIDEBAR_ROW_CLASSES):
                cells = list(page.children(div))[:2]
                if len(cells) == 2:
                    rows.append({"label": page.text(cells[0]), "value": page.text(cells[1])})
    return rows


def _is_number(text: str) -> bool:
    body = text[:-1] if text[-1:] in ("K", "k", "M", "m") else text
    return bool(body) and all(c.isdigit() or c in ",." for c in body)


def _box_numbers(page: Outline):
    """First number-like paragraph of each number box, in page order."""
    numbers = []
    for div in page.all("div"):
        if all(w in page.css(div) for w in fv.NUMBER_BOX_CLASSES):
            texts = (page.text(p) for p in page.all("p", inside=div))
            hit = next((t for t in texts if _is_number(t)), None)
            if hit is not None:
                numbers.append(hit)
    return numbers


def section_row(body: str) -> dict:
    """Raw fields of a server-rendered page; the rest is done by column expressions."""
    page = Outline(body)
    return {
        "description": _after_heading(page, fv.DESCRIPTION_HEADING, "div", fv.SECTION_CLASS, "\n"),
        "requirements": _after_heading(page, fv.REQUIREMENTS_HEADING, "div", fv.SECTION_CLASS, "\n"),
        "category": _after_heading(page, fv.CATEGORY_HEADING, "span", None, ""),
        "sidebar": _sidebar(page),
        "numbers": _box_numbers(page),
        "nodes": [p for p in page.pieces() if p],
    }


def loose_row(body: str) -> dict:
    """Title and sections by headings that merely contain the word; missing sections are empty."""
    page = Outline(body)

    def section(word):
        for h in page.all("h2"):
            first = next((page.content[i] for i in range(h + 1, page.end[h])
                          if page.tag[i] is None and page.parent[i] == h), "")
            if word in first:
                after = next(page.next_siblings(h), None)
                if after is not None:
                    return page.text(after, "\n")
        return ""

    h1 = next(page.all("h1"), None)
    return {
        "title": fv.UNKNOWN if h1 is None else page.text(h1),
        "description": section(fv.DESCRIPTION_HEADING),
        "requirements": section(fv.REQUIREMENTS_HEADING),
    }
