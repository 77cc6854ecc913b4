"""Visible text and links of landed pages."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shipping import ship

# Elements whose content no reader sees.
UNSEEN = frozenset("script style noscript svg head template".split())

# An ampersand that begins no closed number, with the closed name behind it, if there is one.
_AMPERSAND = re.compile(r"&(?!#(?:[0-9]+|[xX][0-9a-fA-F]+);)([A-Za-z][A-Za-z0-9]*;)?")


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.text, self.links = 0, [], []

    def part(self, tag):
        """Tags part words, unless what they enclose is not seen at all; comments and a stray < do not."""
        if tag not in UNSEEN and not self.depth:
            self.text.append(" ")

    def handle_starttag(self, tag, attrs):
        self.part(tag)
        self.depth += tag in UNSEEN
        self.links += [v for k, v in attrs if tag == "a" and k == "href" and v]

    def handle_startendtag(self, tag, attrs):
        self.part(tag)

    def handle_endtag(self, tag):
        self.part(tag)
        self.depth -= tag in UNSEEN and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.text.append(data)


def read(html: str | None, bare: bool = True) -> tuple[str, list[str]]:
    """(text, links); white space becomes one blank. Broken pages give what was read of them.

    Character references that lack their semicolon, as where a page was cut, are read as browsers read them; with bare=False they stay as they stand.
    """
    html = html or ""
    if not bare:
        html = _AMPERSAND.sub(lambda m: m[0] if m[1] in html5 else f"&amp;{m[1] or ''}", html)
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except (AssertionError, ValueError):
        pass
    return " ".join("".join(reader.text).split()), reader.links


def visible(pages: DataFrame, column: str, bare: bool = True) -> DataFrame:
    """pages with text and links in place of the column, read as read() does."""
    ship(pages.sparkSession)

    @F.pandas_udf("text string, links array<string>")
    def parse(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(x, bare) for x in html], columns=["text", "links"])

    keep = [c for c in pages.columns if c not in (column, "text", "links")]
    return pages.select(*keep, parse(column).alias("__read")).select(*keep, "__read.text", "__read.links")
