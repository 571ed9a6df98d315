"""Raw pages to documents."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

#: Elements whose whole content is left out.
SKIPPED = ("script", "style", "nav", "footer", "header", "aside")


#: Elements of HTML that have no content and no end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


class _Body(HTMLParser):
    """The first title of a page, and all text outside the skipped elements, titles included.

    Open elements are a stack. An end tag closes the last open element of its name and with it all that was opened since; one without such an element is ignored. What is left open ends with the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.open, self.titles = "", [], [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in VOID:
            self.open.append(tag)
            self.titles += tag == "title"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """An element that ends where it starts holds nothing."""

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.titles == 1 and "title" in self.open:
            self.title += data
        if not any(tag in SKIPPED for tag in self.open):
            self.parts.append(data)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text) of pages(page_id, url, html): white space collapsed, boilerplate elements dropped, null html empty."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            rows = []
            for url, html in zip(pdf["url"], pdf["html"], strict=True):
                body = _Body()
                body.feed(html or "")
                body.close()
                rows.append((" ".join(body.title.split()) or url, " ".join(" ".join(body.parts).split())))
            yield pdf[["page_id", "url"]].assign(title=[r[0] for r in rows], text=[r[1] for r in rows])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, text string")
