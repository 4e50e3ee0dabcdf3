"""Visible text of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

#: Elements whose text is not part of a page.
HIDDEN = ("script", "style", "noscript")


class _Text(HTMLParser):
    """Text nodes of a page, without those of hidden elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.parts: list[str] = []
        self.hidden = 0

    def _end_node(self) -> None:
        if text := "".join(self.parts).strip():
            self.found.append(text)
        self.parts = []

    def handle_starttag(self, tag: str, attrs) -> None:
        self._end_node()
        self.hidden += tag in HIDDEN

    def handle_endtag(self, tag: str) -> None:
        self._end_node()
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self._end_node()

    def handle_comment(self, data: str) -> None:
        self._end_node()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(page: str | None) -> str:
    """Visible text nodes of a page, stripped, a line each."""
    if not page:
        return ""
    parser = _Text()
    parser.feed(page)
    parser.close()
    parser._end_node()
    return "\n".join(parser.found)
