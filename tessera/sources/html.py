"""Listings and links out of saved HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class _Rows(HTMLParser):
    """Table rows in order: ('header', text) for rows of the header class, ('link', href) for the first link of a row's first cell."""

    def __init__(self, header: str, ending: str):
        super().__init__()
        self.header, self.ending, self.rows = header, ending, []
        self._in_header, self._cell, self._text, self._found = False, 0, "", None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "tr":
            self._in_header = self.header in (attrs.get("class") or "").split()
            self._cell, self._text, self._found = 0, "", None
        elif tag in ("td", "th"):
            self._cell += 1
        elif tag == "a" and self._cell == 1 and self._found is None and (attrs.get("href") or "").endswith(self.ending):
            self._found = attrs["href"]

    def handle_data(self, data):
        if self._in_header:
            self._text += data

    def handle_endtag(self, tag):
        if tag == "tr":
            if self._in_header:
                self.rows.append(("header", " ".join(self._text.split())))
            elif self._found is not None:
                self.rows.append(("link", self._found))
            self._in_header = False


def listing(pages: DataFrame, key: str, html: str, base: str, header: str = "gameheader", ending: str = ".mid") -> DataFrame:
    """(key, pos, header, url): files of a listing, each under the last header row above it (null before the first)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, text, root in zip(batch.id, batch.html, batch.base, strict=True):
                parser = _Rows(header, ending)
                parser.feed(text or "")
                out += [(id_, i, value if kind == "header" else None, urljoin(root or "", value) if kind == "link" else None) for i, (kind, value) in enumerate(parser.rows)]
            yield pd.DataFrame(out, columns=["id", "pos", "header", "url"])

    id_type = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("id"), F.col(html).alias("html"), F.col(base).alias("base")).mapInPandas(parse, f"id {id_type}, pos int, header string, url string")
    carried = F.last("header", ignorenulls=True).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("header", carried).where("url IS NOT NULL").withColumnRenamed("id", key)


def all_matches(pages: DataFrame, key: str, html: Column, pattern: str) -> DataFrame:
    """(key, pos, value): the first group of every match."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("pos", "value"))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
