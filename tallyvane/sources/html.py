"""Web pages as digital pages: title, heading and paragraphs by regular expressions over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What isn't content, with what is inside it.
DROPPED = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<!--.*?-->"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def plain(html):
    """Text of a piece of HTML: no tags, entities resolved, single spaces."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def ingest(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, title, heading, paragraphs and text (paragraphs by line feeds) of every page."""
    body = F.regexp_replace(pages[html], DROPPED, "")
    found = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), plain), lambda p: p != "")
    return pages.select(
        key,
        plain(F.regexp_extract(pages[html], r"(?is)<title\b[^>]*>(.*?)</title>", 1)).alias("title"),
        plain(F.regexp_extract(body, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)).alias("heading"),
        found.alias("paragraphs"),
        F.array_join(found, "\n").alias("text"),
    )
