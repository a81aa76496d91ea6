"""Text of HTML pages, as an Arrow pandas UDF over the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style"}


class _Reader(HTMLParser):
    """Joins the texts of sibling nodes by a single space; scripts, styles and comments have none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str], int]] = [("", [], 0)]

    def _add(self, text: str) -> None:
        name, parts, n = self.open[-1]
        if text and n and parts:
            parts.append(" ")
        if text:
            parts.append(text)
        self.open[-1] = (name, parts, n + 1)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _VOID:
            self._add("")
        else:
            self.open.append((tag, [], 0))

    def handle_startendtag(self, tag, attrs) -> None:
        self._add("")

    def handle_endtag(self, tag) -> None:
        if any(name == tag for name, _, _ in self.open[1:]):
            while self._close() != tag:
                pass

    def handle_data(self, data) -> None:
        if self.open[-1][0] not in _HIDDEN:
            self._add(data)

    def _close(self) -> str:
        name, parts, _ = self.open.pop()
        self._add("".join(parts))
        return name

    def text(self) -> str:
        self.close()
        while len(self.open) > 1:
            self._close()
        return "".join(self.open[0][1])


def text_of(html: str | None) -> str | None:
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    return reader.text()


@F.pandas_udf(StringType())
def _strip(pages: pd.Series) -> pd.Series:
    return pages.map(text_of)


def strip(html: Column) -> Column:
    return _strip(html)


def strip_response(content: Column) -> Column:
    """Text of a page that may begin with the header of an HTTP response, which ends at a blank line."""
    body = F.when(content.startswith("HTTP"), F.when(content.rlike(r"(?s)\r?\n\r?\n"), F.regexp_replace(content, r"(?s)^.*?\r?\n\r?\n", "")).otherwise(F.lit(""))).otherwise(content)
    return _strip(body)
