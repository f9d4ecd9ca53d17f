"""Markdown of pages whose structure regular expressions cannot follow.

Nested and numbered lists, tables and preformatted text need to know which elements are open,
so the tags of a page are walked with a stack. ``convert`` sends only such pages here; any
other keeps to the column functions of ``functions.html``.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

_DROPPED = {"script", "style", "head"}
_HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
_BLOCKS = {"p", "div", "article", "section", "nav", "footer", "header", "main", "aside", "figure", "blockquote", "form"}
_LISTS = {"ul", "ol"}
_MARKS = {"b": "**", "strong": "**", "code": "`"}
_VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
# What a start tag ends that was left open: up to the nearest of the second set.
_ENDS = {
    "li": ({"li"}, _LISTS),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{tag: ({"p"}, {"li", "td", "th", "div", "article", "section", "body"}) for tag in (_BLOCKS | _LISTS | set(_HEADINGS) | {"table", "pre"})},
}


class _Element:
    def __init__(self, tag: str, href: str | None = None):
        self.tag, self.href = tag, href
        self.parts: list[str] = []  # text of links, cells and preformatted blocks
        self.items = 0  # of a list
        self.rows: list[list[str]] = []  # of a table


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Element("")]

    # -------------------------------------------------------------- text

    def _within(self, *tags: str) -> _Element | None:
        return next((e for e in reversed(self.open) if e.tag in tags), None)

    def _put(self, text: str) -> None:
        """To the nearest element that collects its text, or to the page."""
        holder = next((e for e in reversed(self.open) if e.tag in ("a", "td", "th", "pre")), self.open[0])
        holder.parts.append(text)

    def _line(self) -> None:
        if self._within("td", "th", "a"):
            self._put(" ")
        elif not self._within("pre"):
            self._put("\n")

    def handle_data(self, data: str) -> None:
        if self._within(*_DROPPED):
            return
        if self._within("pre"):
            self._put(data)
            return
        if self.open[-1].tag in ("table", "tr", "tbody", "thead", *_LISTS) and not data.strip():
            return
        self._put(re.sub(r"[ \t\r\n ]+", " ", data))

    # -------------------------------------------------------------- tags

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._within(*_DROPPED):
            return
        ended, until = _ENDS.get(tag, (set(), set()))
        while (at := next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag in ended | until), 0)) and self.open[at].tag in ended:
            self._close(at)
        if tag == "br":
            self._line()
        if tag in _VOID:
            return
        element = _Element(tag, dict(attrs).get("href"))
        if tag in _HEADINGS or tag in _BLOCKS or tag in ("table", "pre"):
            self._line()
        if tag in _HEADINGS:
            self._put(_HEADINGS[tag])
        elif tag == "li":
            depth = sum(e.tag in _LISTS for e in self.open)
            owner = self._within(*_LISTS)
            marker = "- "
            if owner is not None:
                owner.items += 1
                marker = f"{owner.items}. " if owner.tag == "ol" else marker
            self._line()
            self._put("\u0002" * max(0, depth - 1) + marker)
        elif tag in _MARKS and not self._within("pre"):
            self._put(_MARKS[tag])
        elif tag == "tr" and (table := self._within("table")):
            table.rows.append([])
        self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        # A stray end tag ends nothing, nor does one reach out of its cell or item.
        if at and not any(e.tag in ("td", "th", "table") for e in self.open[at + 1 :] if tag not in ("td", "th", "tr", "table")):
            self._close(at)

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            element = self.open.pop()
            tag, text = element.tag, "".join(element.parts)
            if tag == "a":
                self._put(f"[{text.strip()}]({element.href})" if element.href is not None else text)
            elif tag in ("td", "th"):
                cell = re.sub(r"\s+", " ", text.replace("\u0002", "")).strip().replace("|", "\\|")
                if (table := self._within("table")) is None:
                    self._put(cell)
                else:
                    if not table.rows:
                        table.rows.append([])
                    table.rows[-1].append(cell)
            elif tag == "pre":
                self._put("\n\u0003" + text.strip("\n") + "\u0003\n")
            elif tag == "table":
                self._put(_table([r for r in element.rows if r]))
                self._line()
            elif tag in _MARKS and not self._within("pre"):
                self._put(_MARKS[tag])
            elif tag in _HEADINGS or tag in _BLOCKS or tag in _LISTS:
                self._line()


def _table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join(["", lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def to_markdown(html: str) -> str:
    """Headings, paragraphs, links, bold and code, lists of any depth with their numbers, tables
    with the first row as head, preformatted text as it is; unclosed elements end where their
    parent does."""
    writer = _Writer()
    writer.feed(html)
    writer.close()
    writer._close(1)
    out = []
    for i, part in enumerate("".join(writer.open[0].parts).split("\u0003")):
        if i % 2:
            out.append(f"```\n{part}\n```")
        else:
            part = re.sub(r" *\n *", "\n", re.sub(r" +", " ", part))
            out.append(re.sub(r"\n{3,}", "\n\n", part).replace("\u0002", "  "))
    return "".join(out).strip()
