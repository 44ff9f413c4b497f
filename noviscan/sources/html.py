"""Readable text of one HTML page, by a stack of open tags.

Text goes to a list of pieces as it comes; structure is put there as one-character marks. An element that is
never article text remembers how long the list was when it opened and cuts the list back at its own end
tag, so whatever is nested in it goes with it, and an element that is never closed takes nothing away.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

# Page parts that are never article text, class names of notices, tags without content.
NOISE = ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "template", "svg", "iframe")
NOTICES = frozenset(("ad", "ads", "advert", "banner", "cookie", "sidebar"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div section table tr ul ol blockquote h1 h2 h3 h4 h5 h6".split())
REGIONS = ("article", "main", "body")

#: Tags whose end is left out in practice, and the start tags that end them.
ENDED_BY = {
    "p": BLOCKS | {"article", "main", "aside", "nav", "header", "footer", "form", "hr", "pre", "dl"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"},
}

# Marks are noncharacters, which no page may contain.
INLINE, BREAK, BLOCK, ITEM = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
HEADINGS = ("\ufdd4", "\ufdd5", "\ufdd6")
TEXT_OF = {INLINE: "", BREAK: "\n", BLOCK: "\n\n", ITEM: "\n- ", HEADINGS[0]: "\n\n# ", HEADINGS[1]: "\n\n## ", HEADINGS[2]: "\n\n### ", "\xa0": " "}
BARE = re.compile(r"&(?!#?\w+;)")
MARKS = re.compile("[\ufdd0-\ufdd6\xa0]")
OWN_MARKS = re.compile("[\ufdd0-\ufdd6]")


def start_mark(tag: str) -> str:
    if tag in ("h1", "h2"):
        return HEADINGS[int(tag[1]) - 1]
    if tag in ("h3", "h4", "h5", "h6"):
        return HEADINGS[2]
    return ITEM if tag == "li" else BREAK if tag == "br" else BLOCK if tag in BLOCKS else INLINE


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.stack: list[tuple[str, int | None]] = []  # open tags; where their text starts if it has to go
        self.open: Counter = Counter()
        self.starts: dict[str, list[int]] = {r: [] for r in REGIONS}
        self.ends: dict[str, list[int]] = {r: [] for r in REGIONS}
        self.title: list[str] | None = None
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        while self.stack and tag in ENDED_BY.get(self.stack[-1][0], ()):
            self._close()
        if tag == "title" and self.title is None and not self.open["svg"]:
            self.title, self.in_title = [], True
        dropped = tag in NOISE or not NOTICES.isdisjoint((dict(attrs).get("class") or "").lower().split())
        if tag not in VOID:
            self.stack.append((tag, len(self.pieces) if dropped else None))
            self.open[tag] += 1
        if tag in self.starts:
            self.starts[tag].append(len(self.pieces) + 1)
        self.pieces.append(start_mark(tag))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.ends:
            self.ends[tag].append(len(self.pieces))
        if tag not in VOID and self.open[tag]:
            while self.stack[-1][0] != tag:  # left open inside: keeps its text
                self.open[self.stack.pop()[0]] -= 1
            if self._close():
                return
        self.pieces.append(BLOCK if tag in BLOCKS else INLINE)

    def _close(self) -> bool:
        """Close the innermost tag; true if it was a part that is no article text, which leaves a blank."""
        tag, start = self.stack.pop()
        self.open[tag] -= 1
        if start is not None:
            del self.pieces[start:]
            self.pieces.append(" ")
            for places in (*self.starts.values(), *self.ends.values()):
                while places and places[-1] > start:
                    places.pop()
        return start is not None

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not (self.stack and self.stack[-1][0] in ("script", "style")):
            self.pieces.append(OWN_MARKS.sub("", data))

    def handle_comment(self, data):
        self.pieces.append(" ")

    def parse_marked_section(self, i, report=1):
        """Sections such as ``<![if !IE]>`` are skipped up to their ``>``."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1


def readable(html: str | None) -> tuple[str, str]:
    """(title, text): the article, else main, else body, else all, with headings, list items and paragraphs as lines.

    From the first start to the last end of the first region that has text; empty for null or empty pages.
    A character reference ends in a semicolon; without one it is text, as it stands.
    """
    page = _Page()
    page.feed(BARE.sub("&amp;", html or ""))
    page.close()
    spans = [(s[0], e[-1]) for s, e in ((page.starts[r], page.ends[r]) for r in REGIONS) if s and e and s[0] < e[-1]]
    text = ""
    for start, end in [*spans, (0, len(page.pieces))]:
        text = _lines("".join(page.pieces[start:end]))
        if text:
            break
    title = re.sub(r"\s+", " ", "".join(page.title or [])).strip()
    return title, text


def _lines(marked: str) -> str:
    text = re.sub(r"[ \t\n\v\f\r]+", " ", marked)
    text = MARKS.sub(lambda m: TEXT_OF[m[0]], text)
    text = re.sub(r" *\n *", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()
