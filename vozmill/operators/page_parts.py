"""Reading one HTML page inside a task: the small Python helper of the page jobs."""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin

from vozmill import lexicon as lx
from vozmill.operators import json_parts

_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
    "track", "wbr",
}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre",
    "section", "table", "ul",
}
_BLOCKS = ("article", "li", "section", "div")
_HIDDEN = {"script", "style", "template"}
# Tags without attributes; those behind which the parser reads raw text are left to it.
_PLAIN_START = re.compile("<([a-zA-Z][a-zA-Z0-9]*)>")
_PLAIN_END = re.compile("</([a-zA-Z][a-zA-Z0-9]*)>")
_RAW_TEXT = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}


class _Element:
    __slots__ = ("tag", "start", "end")

    def __init__(self, tag: str, start: int):
        self.tag, self.start, self.end = tag, start, None


class PageParts(HTMLParser):
    """Collects anchors, headings, marked blocks and scripts of one page.

    Visible text is a list of pieces; an element is a range of that list, so
    the text of any element is available once the page has been read.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.raw: list[str] = []
        self.anchors: list[tuple[str, _Element, _Element | None]] = []
        self.headings: list[_Element] = []
        self.marked: list[tuple[int, _Element]] = []
        self.og_title = ""
        self.scripts: list[tuple[str, str, str]] = []
        self._open: list[_Element] = []
        self._anchor: _Element | None = None
        # Places in the stack of open elements, per tag: no step looks through the stack.
        self._at: dict[str, list[int]] = defaultdict(list)
        self._buffer: list[str] = []
        self._script: tuple[str, str] | None = None
        self.feed(html or "")
        self.close()
        self._flush()
        for element in self._open:
            self._end(element)

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns of the source are not asked for, so they are not counted."""
        return j

    # -- text -----------------------------------------------------------------
    def _flush(self) -> None:
        if not self._buffer:
            return
        text = "".join(self._buffer)
        self._buffer = []
        if self._script is not None:
            self.scripts.append((*self._script, text.strip()))
        if self._innermost(_HIDDEN) >= 0:
            return
        self.raw.append(text)
        # Python splits at the blank characters that the Catalyst expressions know.
        flat = " ".join(text.split())
        if flat:
            self.pieces.append(flat)

    def text_of(self, element: _Element) -> str:
        return " ".join(self.pieces[element.start:element.end])

    def handle_data(self, data: str) -> None:
        self._buffer.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    # -- elements ---------------------------------------------------------------
    def parse_starttag(self, i: int) -> int:
        plain = _PLAIN_START.match(self.rawdata, i)
        tag = plain[1].lower() if plain else None
        if tag is None or tag in _RAW_TEXT:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, [])
        return plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag: str, attrs) -> None:
        self._flush()
        if tag in _CLOSES_P:
            self._close("p", until=_BLOCKS)
        elif tag == "li":
            self._close("li", until=("ul", "ol"))
        found = {k: v or "" for k, v in reversed(attrs)}
        if tag == "meta":
            if found.get("property") == "og:title" and not self.og_title:
                self.og_title = found.get("content", "")
        element = _Element(tag, len(self.pieces))
        if tag in _VOID:
            element.end = element.start
        else:
            self._at[tag].append(len(self._open))
            self._open.append(element)
        self._mark(tag, found, element)

    def _mark(self, tag: str, found: dict, element: _Element) -> None:
        if tag == "a":
            # Anchors do not nest: one that was never closed ends where the next begins.
            if self._anchor is not None:
                self._end(self._anchor)
            self._anchor = element
        if tag == "a" and found.get("href", "").strip():
            depth = self._innermost(_BLOCKS)
            block = self._open[depth] if depth >= 0 else None
            self.anchors.append((found["href"].strip(), element, block))
        elif tag == "h1":
            self.headings.append(element)
        elif tag == "script":
            self._script = (found.get("id", ""), found.get("type", ""))
        if not found:
            return
        name = lx.COMPLAINT_BLOCK_NAME
        matches = (
            found.get("id") == name,
            found.get("data-testid") == name,
            name in found.get("id", ""),
            tag == "div" and name in found.get("class", ""),
            tag == "p" and name in found.get("class", ""),
        )
        self.marked.extend((rank, element) for rank, hit in enumerate(matches) if hit)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if tag == "script":
            self._script = None
        self._close(tag)

    def _innermost(self, tags) -> int:
        """Place of the innermost open element with one of the tags, -1 without any."""
        deepest = -1
        for tag in tags:
            places = self._at.get(tag)
            if places and places[-1] > deepest:
                deepest = places[-1]
        return deepest

    def _close(self, tag: str, until=()) -> None:
        """Close the innermost open ``tag`` and all in it, unless ``until`` lies deeper."""
        depth = self._innermost((tag,))
        if depth >= 0 and depth > self._innermost(until):
            for element in self._open[depth:]:
                self._end(element)
                self._at[element.tag].pop()
            del self._open[depth:]

    def _end(self, element: _Element) -> None:
        if element.end is None:
            element.end = len(self.pieces)

    # -- results ------------------------------------------------------------------
    def heading(self) -> str:
        return self.text_of(self.headings[0]) if self.headings else ""

    def embedded_json(self) -> str:
        named = [s for s in self.scripts if s[0] == lx.EMBEDDED_JSON_ID]
        typed = [s for s in named if s[1] == "application/json"]
        return (typed or named or [("", "", "")])[0][2]

    def ld_json(self) -> list[str]:
        return [text for _, kind, text in self.scripts if kind == "application/ld+json" and text]

    def json_strings(self) -> list[tuple[int, str]]:
        """All strings of the embedded JSON with the hints in their keys."""
        return json_parts.strings(self.embedded_json())

    def linked_texts(self) -> list[tuple[str, str]]:
        """Text fields of the linked data with the type of their object."""
        return json_parts.linked_texts(self.ld_json())

    def links(self, base_url: str) -> dict:
        """Anchors, and the text pieces once: the block around an anchor is a range of them."""
        out = []
        for pos, (href, element, block) in enumerate(self.anchors):
            title = self.text_of(element)
            try:
                url = urljoin(base_url, href)
            except ValueError:
                continue
            out.append(
                {
                    "pos": pos,
                    "url": url,
                    "title": title,
                    "start": block.start if block is not None else None,
                    "stop": block.end if block is not None else None,
                }
            )
        return {"anchors": out, "pieces": self.pieces}

    def blocks(self) -> list[dict]:
        """The marked blocks as ranges of the pieces with their text's length, by selector rank, then position.

        Nested blocks share their pieces, so their texts are joined only where one is needed.
        """
        ends = [0]
        for piece in self.pieces:
            ends.append(ends[-1] + len(piece) + 1)
        ordered = sorted(self.marked, key=lambda m: m[0])
        return [
            {"rank": rank, "start": e.start, "stop": e.end, "n_chars": max(0, ends[e.end] - ends[e.start] - 1)}
            for rank, e in ordered
        ]
