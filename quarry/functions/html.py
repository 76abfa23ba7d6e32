"""HTML to title, text, anchors and links.

The pattern forms run in the JVM and have SQL counterparts; ``parse_html`` is
the robust form on the standard library's parser, one Arrow batch at a time.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _normal, normalize_space
from .urls import CRAWLABLE_TYPES, is_crawlable, is_web_url, resolve

# Attributes that hold links, and schemes that are none.
LINK_ATTRIBUTES = ("href", "src", "action", "data-url", "data-href", "data-src", "data-original", "data-link", "data-path")
NO_LINK = ("javascript:", "mailto:", "tel:", "data:", "#")


def page_title(html: Column) -> Column:
    return normalize_space(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b[^>]*>.*?</(?:script|style|noscript)>|<!--.*?-->", " ")
    return normalize_space(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))


def anchor_texts(html: Column) -> Column:
    inner = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    return F.filter(F.transform(inner, lambda a: normalize_space(F.regexp_replace(a, r"(?s)<[^>]*>", " "))), lambda a: a != "")


def anchor_links(html: Column, base: Column) -> Column:
    """Resolved targets of a-tags, in order, distinct."""
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return _crawlable(raw, base)


def all_links(html: Column, base: Column) -> Column:
    """Link attributes and data attributes, absolute urls and root paths anywhere in the source, in that order."""
    source = F.coalesce(html, F.lit(""))
    named = F.regexp_extract_all(source, F.lit(r"(?is)\s(?:href|src|action|data-[a-z0-9-]+)\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    absolute = F.transform(F.regexp_extract_all(source, F.lit(r"(?i)https?://[^\s\"'<>\\)]+"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;]+$", ""))
    rooted = F.transform(F.regexp_extract_all(source, F.lit(r"(?<![A-Za-z0-9_<:/])/(?:[A-Za-z0-9._~!$&'()*+,;=:@%-][A-Za-z0-9._~!$&'()*+,;=:@%/-]*)(?:\?[A-Za-z0-9._~!$&'()*+,;=:@%/?-]*)?"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;]+$", ""))
    rooted = F.filter(rooted, lambda u: ~u.rlike("^/(?:_next/static|static)/"))
    return _crawlable(F.concat(named, absolute, rooted), base)


def _crawlable(raw: Column, base: Column) -> Column:
    fit = F.filter(raw, lambda u: (F.trim(u) != "") & ~F.lower(F.trim(u)).rlike("^(?:javascript:|mailto:|tel:|data:|#)"))
    return F.array_distinct(F.filter(F.transform(fit, lambda u: resolve(base, u)), lambda u: is_web_url(u) & is_crawlable(u)))


def asset_links(html: Column, base: Column, extensions: tuple[str, ...] = ("js",)) -> Column:
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)\s(?:src|href)\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda u: resolve(base, u)), lambda u: is_web_url(u) & F.lower(u).rlike(rf"^[^?#]*\.(?:{'|'.join(extensions)})(?:[?#]|$)")))


class _Page(HTMLParser):
    HIDDEN, VOID = {"script", "style", "noscript"}, {"br", "img", "input", "meta", "link", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.anchors, self.links, self.hidden, self.in_title, self.open_anchor = [], [], [], [], 0, False, None

    def handle_starttag(self, tag, attrs):
        for k, v in attrs:
            if v and (k in LINK_ATTRIBUTES or k.startswith("data-")):
                self.links.append(v)
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a":
            self.handle_endtag("a")
            self.open_anchor = []

    def handle_startendtag(self, tag, attrs):
        hidden = self.hidden
        self.handle_starttag(tag, attrs)
        self.hidden = hidden

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(self.hidden - 1, 0)
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.open_anchor is not None:
            self.anchors.append(" ".join(self.open_anchor))
            self.open_anchor = None

    def handle_data(self, data):
        if self.hidden:
            return
        self.text.append(data)
        if self.in_title:
            self.title.append(data)
        if self.open_anchor is not None:
            self.open_anchor.append(data)


def _web(base: str, link: str) -> str:
    if link.strip().lower().startswith(NO_LINK):
        return ""
    try:
        whole = urldefrag(urljoin(base, link.strip()))[0]
        parts = urlparse(whole)
    except ValueError:
        return ""
    name = parts.path.lower().rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1] if "." in name else ""
    return whole if parts.scheme in ("http", "https") and parts.netloc and suffix in CRAWLABLE_TYPES else ""


_STRINGS = T.ArrayType(T.StringType())


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("anchors", _STRINGS), T.StructField("links", _STRINGS)]))
def parse_html(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    out = []
    for body, at in zip(html, base, strict=True):
        page = _Page()
        page.feed(body or "")
        page.close()
        page.handle_endtag("a")
        links = [_web(at or "", x) for x in page.links]
        out.append((_normal(" ".join(page.title)), _normal(" ".join(page.text)), [a for a in map(_normal, page.anchors) if a], list(dict.fromkeys(x for x in links if x))))
    return pd.DataFrame(out, columns=["title", "text", "anchors", "links"])
