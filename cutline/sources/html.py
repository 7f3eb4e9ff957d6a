"""A small reader that turns one HTML page into flat lists; used inside ``mapInPandas`` only.

It keeps a stack of open elements and closes an element when its end tag
comes, as lenient browsers do. Text of scripts, styles and comments is no text.

Text, cells and rows are each kept once per page; an element only knows where
its share begins and ends, so that reading takes linear time however many
elements stay open.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
LINK_PARENTS = ("li", "tr", "div", "p")
HEADINGS = ("div", "h1", "h2", "h3", "h4", "p")


class _Element:
    """An element and the span of the page's lists that lies within it."""

    __slots__ = ("tag", "attrs", "number", "div", "before", "_page", "_from", "_to")

    def __init__(self, tag, attrs, page):
        self.tag, self.attrs, self.number, self._page = tag, dict(attrs), page.count, page
        self.div, self.before = page.nearest("div"), None
        self._from, self._to = page.sizes(), None

    def close(self):
        self._to = self._page.sizes()

    def _within(self, kind):
        return self._page.lists[kind][self._from[kind] : self._to[kind] if self._to else None]

    @property
    def text(self) -> str:
        return "".join(self._within(0))

    @property
    def stripped(self) -> str:
        return "".join(p.strip() for p in self._within(0))

    @property
    def cells(self) -> list[_Element]:
        return self._within(1)

    @property
    def rows(self) -> list[_Element]:
        return self._within(2)

    def divs(self):
        """The blocks around this element, innermost first."""
        block = self.div
        while block is not None:
            yield block
            block = block.div


class PageReader(HTMLParser):
    """After ``read``: links, tables and second-level headings of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.count = [], 0
        self.links, self.tables, self.headings = [], [], []
        self.lists = ([], [], [])  # pieces of text, cells, rows
        self._by_tag, self._before = {}, None

    def read(self, html: str) -> PageReader:
        self.feed(html)
        self.close()
        return self

    def sizes(self):
        return tuple(map(len, self.lists))

    def nearest(self, *tags):
        held = [self._by_tag[t][-1] for t in tags if self._by_tag.get(t)]
        return max(held, key=lambda e: e.number, default=None)

    def handle_starttag(self, tag, attrs):
        self.count += 1
        element = _Element(tag, attrs, self)
        if tag == "a" and element.attrs.get("href") is not None:
            self.links.append((element, self.nearest(*LINK_PARENTS)))
        elif tag == "table":
            element.before = self._before
            self.tables.append(element)
        elif tag == "tr":
            self.lists[2].append(element)
        elif tag in ("td", "th"):
            self.lists[1].append(element)
        elif tag == "h2":
            self.headings.append(element)
        if tag in HEADINGS:
            self._before = element
        if tag in VOID:
            element.close()
        else:
            self.open.append(element)
            self._by_tag.setdefault(tag, []).append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self._by_tag.get(tag):
            return
        closed = None
        while closed is None or closed.tag != tag:
            closed = self.open.pop()
            self._by_tag[closed.tag].pop()
            closed.close()

    def handle_data(self, data):
        if not (self.open and self.open[-1].tag in SILENT):
            self.lists[0].append(data)
