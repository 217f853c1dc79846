"""One pass over one HTML page: metadata, link targets and text blocks.

Pure Python because nesting cannot be followed with column expressions.  It only
reads the page: what to keep, and how to write it, is decided by Spark afterwards.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape
from urllib.parse import urljoin

# Attribute values may contain '>', so quoted values are taken whole.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""")
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![A-Za-z]))[^>]*>?", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_ATTR_ENTITY = re.compile(r"&(?:#\d+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z]\w*;|[A-Za-z]\w*(?![\w=;]))")
_TRIM = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B),
                          0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))

_MARKUP_STARTS = set("!?/abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_OUTSIDE = {"noscript", "template", "nav", "header", "footer", "aside", "form"}
_MAIN = {"article", "main"}
_HEAD = {"html", "head", "title", "meta", "link", "base", "style", "script", "noscript", "template"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
          "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre",
          "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_KINDS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "blockquote", "td"}
_LISTS = {"ul", "ol", "menu"}
# Inline elements and the bits that stand for them in the style of a run.
STRONG, EMPHASIS, DELETED, CODE, LITERAL = 1, 2, 4, 8, 16
_STYLES = {"b": STRONG, "strong": STRONG, "i": EMPHASIS, "em": EMPHASIS, "del": DELETED,
           "s": DELETED, "strike": DELETED, "code": CODE}
# An element that starts closes these still open ones, up to the given boundary.
_CLOSES = {"li": ({"li"}, _LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
           "tr": ({"tr"}, {"table"})}


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(text):
        value = double or single or bare
        if "&" in value:
            value = _ATTR_ENTITY.sub(lambda m: unescape(m[0]), value)
        found.setdefault(name.lower(), value)
    return found


#: What a block is made of, in this order: kind, whether in the main element, list or table it belongs to,
#: words, linked words, runs (text, style, link target, table cell), list depth, number of a list item that
#: starts here (0: bullet, n + 1: number n), depth of quotes, language of code, whether a table head.


class PageReader:
    """Collects what one page says; ``read`` returns the fields of ``parse.PARSED_FIELDS``."""

    def __init__(self, url: str, want_blocks: bool = True):
        self.url, self.want_blocks = url, want_blocks
        self.has_refresh = False
        self.meta: dict[str, str] = {}
        self.h1_text = self.title_tag = None
        self.hrefs: list[str] = []
        self.blocks: list[tuple] = []
        self.body_text: list[str] = []
        self.in_body = False
        self.open: list[str] = []  # open block elements
        self.places: dict[str, list[int]] = defaultdict(list)  # where each of them is in it
        self.outside_counts: Counter[str] = Counter()
        self.lists: list[list] = []  # open lists: [next number or None]
        self.outside: list[str] = []  # open elements whose text is not content
        self.kinds: list[str] = []  # those of them that name the kind of a block
        self.main_depth = self.pre_depth = self.quotes = self.group = self.groups = 0
        self.heading: list[str] | None = None  # text of the first h1 while it is open
        self.cell: int | None = None  # of the open table row: cells so far
        self.row: list[tuple] = []  # runs of the open table row
        self.row_words = self.row_links = 0
        self.header_pending = self.item_pending = False
        self.language = ""
        self._reset()

    def _reset(self) -> None:
        self.runs: list[list] = []  # of the open block: texts, style, link target
        self.marks: list[tuple[str, str]] = []  # open inline elements: tag, link target
        self.mark_counts: Counter[str] = Counter()
        self.plain: list[str] = []
        self.linked: list[str] = []

    # -- text ---------------------------------------------------------------
    def text(self, raw: str) -> None:
        if not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        if not self.in_body:
            if not text.strip(_TRIM):
                return
            self.in_body = True
        self.body_text.append(text)
        if self.heading is not None:
            self.heading.append(text)
        if self.outside or not self.want_blocks:
            return
        self.plain.append(text)
        if self.mark_counts["a"]:
            self.linked.append(text)
        self._run(text)

    def _run(self, text: str, extra: int = 0) -> None:
        """Add text to the open block, in the style of the open inline elements."""
        style, target = extra, ""
        for tag, bit in _STYLES.items():
            if self.mark_counts[tag]:
                style |= bit
        if self.mark_counts["a"]:
            target = self.target
        if self.runs and self.runs[-1][1:] == [style, target]:
            self.runs[-1][0].append(text)
        else:
            self.runs.append([[text], style, target])

    def _open_mark(self, tag: str, target: str = "") -> None:
        self.marks.append((tag, target))
        self.mark_counts[tag] += 1
        if tag == "a":
            self.target = target

    def _close_mark(self) -> None:
        self.mark_counts[self.marks.pop()[0]] -= 1

    def _innermost(self, names: set[str]) -> int:
        """Where the innermost open element with one of these names is, or -1."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    # -- blocks -------------------------------------------------------------
    def flush(self) -> None:
        """End the open block; one without text is none."""
        if "".join(self.plain).strip(_TRIM):
            words, links = len("".join(self.plain).split()), len(" ".join(self.linked).split())
            cell = self.cell or 0
            runs = [("".join(texts), style, target, cell) for texts, style, target in self.runs]
            if self.cell is not None:
                self.row += runs
                self.cell += 1
                self.row_words += words
                self.row_links += links
            else:
                self._emit(runs, words, links)
        self._reset()

    def _block(self, tag: str, runs: list[tuple], words: int = 0, links: int = 0, number=None,
               header: bool = False, nested: bool = True) -> None:
        depth, quotes = (len(self.lists), self.quotes) if nested else (0, 0)
        language = self.language if tag == "pre" else ""
        self.blocks.append((tag, self.main_depth > 0, self.group, words, links, runs, depth, number,
                            quotes, language, header))

    def _emit(self, runs: list[tuple], words: int, links: int) -> None:
        number = None
        if self.lists and self.item_pending:
            number = self.lists[-1][0] or 0
            if self.lists[-1][0] is not None:
                number += 1  # so that a list may begin with 0
                self.lists[-1][0] += 1
            self.item_pending = False
        self._block(self.kinds[-1] if self.kinds else "div", runs, words, links, number)

    def _end_row(self) -> None:
        if self.cell:
            self._block("td", self.row, self.row_words, self.row_links,
                        header=self.header_pending, nested=False)
            self.header_pending = False
        self.cell, self.row, self.row_words, self.row_links = None, [], 0, 0

    # -- tags ---------------------------------------------------------------
    def _pop_block(self, name: str) -> None:
        """Close the innermost open ``name`` and everything inside it."""
        while self.open:
            top = self.open.pop()
            self.places[top].pop()
            if top in _KINDS:
                self.kinds.pop()
            if top == "pre":
                self.pre_depth -= 1
            elif top == "blockquote":
                self.quotes -= 1
            elif top in _MAIN:
                self.main_depth -= 1
            elif top in _LISTS and self.lists:
                self.lists.pop()
                self.group = self.group if self.lists else 0
            elif top == "tr":
                self._end_row()
            elif top == "table":
                self._end_row()
                self.group = 0
            if top == name:
                return

    def start(self, tag: str, attrs: str) -> None:
        if not self.in_body and tag not in _HEAD:
            self.in_body = True
        if tag == "meta":
            self._meta(_attributes(attrs))
        elif tag == "a":
            link = _attributes(attrs).get("href", "")
            if link:
                self.hrefs.append(link)
            if self.want_blocks:
                self._link(link)
        elif tag == "h1" and self.h1_text is None and self.heading is None:
            self.heading = []
        if tag in _OUTSIDE:
            if tag in _BLOCK:
                self.flush()
            self.outside.append(tag)
            self.outside_counts[tag] += 1
        if self.outside or not self.want_blocks:
            return
        if tag in _BLOCK:
            self._start_block(tag, attrs)
        elif tag in _STYLES:
            if tag == "code" and self.pre_depth and not self.language:
                named = re.search(r"language-([\w+#.-]+)", _attributes(attrs).get("class", ""))
                self.language = named[1] if named else ""
            self._open_mark(tag)
        elif tag == "br":
            self._run("\n" if self.pre_depth else "\0")
            self.plain.append(" ")
        elif tag == "input":
            box = _attributes(attrs)
            if box.get("type", "").lower() == "checkbox" and self.places["li"]:
                self._run("[x] " if "checked" in box else "[ ] ", LITERAL)

    def _start_block(self, tag: str, attrs: str) -> None:
        self.flush()
        if self.open and self.open[-1] == "p":
            self._pop_block("p")
        if tag in _CLOSES:
            names, boundary = _CLOSES[tag]
            at = self._innermost(names)
            if at > self._innermost(boundary):
                self._pop_block(self.open[at])
        if tag == "hr":
            group, self.group = self.group, 0
            self._block("hr", [], nested=False)
            self.group = group
            return
        self.places[tag].append(len(self.open))
        self.open.append(tag)
        if tag in _KINDS:
            self.kinds.append(tag)
        if tag in _MAIN:
            self.main_depth += 1
        elif tag == "blockquote":
            self.quotes += 1
        elif tag in _LISTS:
            number = None
            if tag == "ol":
                start = _attributes(attrs).get("start", "")
                number = int(start) if start.isdecimal() and len(start) < 10 else 1
            self.lists.append([number])
            if len(self.lists) == 1:
                self.groups += 1
                self.group = self.groups
        elif tag == "li":
            self.item_pending = True
        elif tag == "pre":
            self.language = ""
            self.pre_depth += 1
        elif tag == "table":
            self.groups += 1
            self.group, self.header_pending = self.groups, True
        elif tag == "tr":
            self.cell = 0

    def end(self, tag: str) -> None:
        if tag == "h1" and self.heading is not None:
            self.h1_text, self.heading = "".join(self.heading), None
        if self.outside_counts[tag]:
            while True:
                top = self.outside.pop()
                self.outside_counts[top] -= 1
                if top == tag:
                    break
        elif self.outside or not self.want_blocks:
            return
        elif tag in _BLOCK:
            self.flush()
            if self.places[tag]:
                self._pop_block(tag)
        elif self.mark_counts[tag]:
            while self.marks[-1][0] != tag:
                self._close_mark()
            self._close_mark()

    def _link(self, link: str) -> None:
        if self.outside:
            return
        try:
            target = urljoin(self.url, link.strip(_TRIM)) if link else ""
        except ValueError:
            target = link
        if target[:11].lower() == "javascript:":
            target = ""
        if self.mark_counts["a"]:
            self.end("a")
        self._open_mark("a", target)

    def _meta(self, attrs: dict[str, str]) -> None:
        if attrs.get("http-equiv", "").lower() == "refresh":
            self.has_refresh = True
        for key in (attrs.get("property"), attrs.get("name")):
            if key in ("og:title", "og:description", "description"):
                slot = key if key != "description" or attrs.get("name") == key else None
                if slot and (slot == "description" or attrs.get("property") == slot):
                    self.meta.setdefault(slot, attrs.get("content", ""))

    # -- page ---------------------------------------------------------------
    def read(self, html: str) -> dict:
        if "\r" in html:
            html = html.replace("\r\n", "\n").replace("\r", "\n")
        html = html.replace("\0", "\ufffd")
        at = lt = 0
        while (lt := html.find("<", lt)) >= 0:
            match = _TAG.match(html, lt)
            if match is None and html[lt + 1 : lt + 2] not in _MARKUP_STARTS:
                lt += 1  # a bare '<' is text
                continue
            if lt > at:
                self.text(html[at:lt])
            if match is None:
                markup = _MARKUP.match(html, lt)
                at = lt = markup.end() if markup else len(html)  # else it ends inside a tag
                continue
            slash, tag, attrs = match.groups()
            tag = tag.lower()
            at = lt = match.end()
            if slash:
                self.end(tag)
                continue
            self.start(tag, attrs)
            if tag in _RAW:
                at = lt = self._raw(tag, html, at)
        self.text(html[at:])
        if self.heading is not None:
            self.h1_text = "".join(self.heading)
        if self.want_blocks:
            self.flush()
            self._end_row()
        return {
            "has_refresh": self.has_refresh,
            "og_title": self.meta.get("og:title"),
            "h1_text": self.h1_text,
            "title_tag": self.title_tag,
            "meta_desc": self.meta.get("description"),
            "og_desc": self.meta.get("og:description"),
            "body_chars": len("".join(self.body_text).strip(_TRIM)),
            "hrefs": self.hrefs,
            "blocks": self.blocks,
        }

    def _raw(self, tag: str, html: str, at: int) -> int:
        """Take the text of an element that holds no markup; return where it ends."""
        close = _RAW_END[tag].search(html, at)
        stop = close.start() if close else len(html)
        body = html[at:stop]
        if tag == "title":
            if self.title_tag is None:
                self.title_tag = unescape(body)
        elif self.in_body:
            self.body_text.append(unescape(body) if tag == "textarea" else body)
        if not close:
            return len(html)
        gt = html.find(">", stop)
        return len(html) if gt < 0 else gt + 1
