"""Scraping of HTML by a small set of CSS selectors: tag, #id, .class, [attr], [attr=value], descendants."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

SIMPLE = re.compile(r"([\w-]+|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def parsed(selector: str) -> list[list[tuple]]:
    return [[m.groups() for m in SIMPLE.finditer(part)] for part in selector.split()]


def fits(tests: list[tuple], tag: str, attrs: dict) -> bool:
    classes = (attrs.get("class") or "").split()
    for t, i, c, a, v in tests:
        if t and t not in ("*", tag) or i and attrs.get("id") != i or c and c not in classes or a and (a not in attrs or v is not None and attrs[a] != v):
            return False
    return True


class Finder(HTMLParser):
    def __init__(self, path: list[list[tuple]]):
        super().__init__(convert_charrefs=True)
        self.path, self.open, self.found = path, [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        hit = None
        if fits(self.path[-1], tag, attrs):
            k = len(self.path) - 2
            for t, a, _ in reversed(self.open):
                if k >= 0 and fits(self.path[k], t, a):
                    k -= 1
            if k < 0:
                hit = {"attrs": attrs, "text": []}
                self.found.append(hit)
        if tag not in VOID:
            self.open.append((tag, attrs, hit))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for _, _, hit in self.open:
            if hit is not None:
                hit["text"].append(data)


def scrape(selector: str, attribute: str | None = None, pattern: str | None = None, group: int = 0):
    """A function of an HTML column: the first hit's text, or attribute, or the pattern's group in it; null without."""
    path, regex = parsed(selector), re.compile(pattern) if pattern else None

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        finder = Finder(path)
        finder.feed(text)
        for hit in finder.found:
            value = hit["attrs"].get(attribute) if attribute else " ".join("".join(hit["text"]).split())
            if value is not None and regex:
                m = regex.search(value)
                value = m.group(group) if m else None
            if value is not None:
                return value
        return None

    @F.pandas_udf("string")
    def udf(html: pd.Series) -> pd.Series:
        return html.map(one)

    return udf
