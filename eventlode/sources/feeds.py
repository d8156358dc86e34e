"""Sitemaps, hydration state in scripts, cards in markup, distances."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructType


def sitemap(df: DataFrame, xml: str, prefixes: list[str]) -> DataFrame:
    """url, section, kept: all links of sitemaps, kept where their path starts with an allowed prefix."""
    urls = df.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1)).alias("url")).distinct()
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    kept = F.lit(False)
    for p in prefixes:
        kept = kept | path.startswith(p)
    return urls.select("url", F.nullif(F.split_part(path, F.lit("/"), F.lit(2)), F.lit("")).alias("section"), kept.alias("kept"))


def kilometres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def near(df: DataFrame, lat: str, lon: str, at: tuple[float, float], km: float = 50.0) -> DataFrame:
    """Rows within the radius; a box on latitude goes to the scan first."""
    box = F.col(lat).between(at[0] - km / 110.0, at[0] + km / 110.0)
    return df.filter(box & (kilometres(F.col(lat), F.col(lon), F.lit(at[0]), F.lit(at[1])) <= km))


def balanced(text: str, start: int) -> str | None:
    """The bracketed value that opens at `start`, strings and escapes minded."""
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
        i += 1
    return None


def state_after(mark: str):
    """A function of pages: the JSON value that follows the mark in a script, null if there is none."""

    @pandas_udf(StringType())
    def found(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            value = None
            at = page.find(mark) if page else -1
            if at >= 0:
                opens = [i for i in (page.find("[", at + len(mark)), page.find("{", at + len(mark))) if i >= 0]
                value = balanced(page, min(opens)) if opens else None
                try:
                    json.loads(value or "")
                except ValueError:
                    value = None
            out.append(value)
        return pd.Series(out, dtype="object")

    return found


class _Cards(HTMLParser):
    """Texts of the elements whose class holds one of the names."""

    def __init__(self, names: list[str], most: int):
        super().__init__()
        self.names, self.most, self.depth, self.cards = names, most, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "input", "meta", "link"):
            return
        if self.depth:
            self.depth += 1
        elif len(self.cards) < self.most and any(n in (dict(attrs).get("class") or "").lower() for n in self.names):
            self.depth = 1
            self.cards.append([])

    def handle_endtag(self, tag):
        if self.depth and tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and data.strip():
            self.cards[-1].append(data.strip())


def cards(names: list[str], most: int = 60):
    """A function of pages: title and text of each event card, at most `most` a page (a page lists no more)."""

    @pandas_udf(ArrayType(StructType().add("title", "string").add("text", "string")))
    def found(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            p = _Cards(names, most)
            p.feed(page or "")
            out.append([(c[0], " ".join(c)) for c in p.cards if c])
        return pd.Series(out, dtype="object")

    return found
