"""Crawled pages (S4): text of HTML by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named character references that are resolved.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column) -> Column:
    """The visible text: scripts, styles, comments and the head go, block ends become line ends, tags
    spaces, and white space is collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head|nav)\b.*?</\1\s*>|<!--.*?-->", " ")
    lines = F.regexp_replace(bare, r"(?i)</(p|div|h[1-6]|li|tr|article|section)\s*>|<br\s*/?>", "\n")
    text = F.regexp_replace(lines, r"<[^>]*>", " ")
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title and text of a table of crawled pages."""
    return pages.select("page_id", "url", html_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("text"))
