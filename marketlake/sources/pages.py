"""Articles and links out of HTML pages (columns url, html)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import blank_to_null, clean_text, parse_flexible_utc


#: What the body is made of, and where it is looked for first.
_TEXT = frozenset({"p", "h2", "h3", "blockquote"})
_CLASSES = frozenset({"article-content", "article-body"})
#: Fixed values of HTML: elements without an end, and those that end an open paragraph when they begin.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())


class _Body(HTMLParser):
    """The text right within paragraphs, headings and quotes; of each article container, and of the whole page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        #: for each open container, how deep it is and the texts found in it
        self.containers: list[tuple[int, list[str]]] = []
        self.found: list[list[str]] = []
        self.all: list[str] = []
        self.goes_on = False

    def _close(self, depth: int) -> None:
        del self.open[depth:]
        while self.containers and self.containers[-1][0] >= depth:
            self.containers.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.goes_on = False
        if tag in _BLOCK and "p" in self.open:
            self._close(len(self.open) - 1 - self.open[::-1].index("p"))
        if tag in _VOID:
            return
        if tag == "article" or tag == "div" and _CLASSES & set((dict(attrs).get("class") or "").split()):
            self.found.append([])
            self.containers.append((len(self.open), self.found[-1]))
        self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.goes_on = False
        if tag in self.open:
            self._close(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_comment(self, data: str) -> None:
        self.goes_on = False

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] in _TEXT:
            for texts in (self.all, *(x for _, x in self.containers)):
                if self.goes_on:
                    texts[-1] += data
                else:
                    texts.append(data)
            self.goes_on = True


def body_text(html: str | None) -> str:
    """The texts right within paragraphs, headings and quotes, trimmed, joined by line breaks.

    Those of the article containers, container by container, so what stands in two
    comes twice; of the whole page where no container has any.
    """
    parser = _Body()
    parser.feed(html or "")
    parser.close()
    texts = [x for found in parser.found for x in found] or parser.all
    return "\n".join(t for t in (x.strip() for x in texts) if t)


def _body_pages(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["content"] = [body_text(h) for h in pdf.pop("html")]
        yield pdf


def _tag(name: str) -> Column:
    return blank_to_null(clean_text(F.regexp_replace(F.regexp_extract("html", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)<[^>]+>", " ")))


def _meta(*names: str) -> Column:
    tries = []
    for n in names:
        tries += [F.regexp_extract("html", rf"(?is)<meta\b[^>]*(?:name|property)=[\"']{n}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1), F.regexp_extract("html", rf"(?is)<meta\b[^>]*content=[\"']([^\"']*)[\"'][^>]*(?:name|property)=[\"']{n}[\"']", 1)]
    return F.coalesce(*(blank_to_null(t) for t in tries))


def extract_news_page(pages: DataFrame) -> DataFrame:
    """page_id, url, title, author, published, updated, content of every page.

    Dates: the byline's text, then meta and time tags, then /YYYY/MM/DD/ in the
    URL.  Expressions find all but the content, which needs an HTML parser.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.withColumn("html", html)
    byline = F.regexp_extract("html", r"(?is)(?:published|posted|updated)(?: on)?:?\s*([A-Z][a-z]{2,8} \d{1,2}, \d{4})", 1)
    time_tag = F.regexp_extract("html", r"(?is)<time\b[^>]*datetime=[\"']([^\"']*)[\"']", 1)
    in_url = F.regexp_replace(F.regexp_extract("url", r"/(\d{4}/\d{2}/\d{2})/", 1), "/", "-")
    dates = {"d0": F.regexp_replace(byline, r"^([A-Z][a-z]{2})[a-z]* ", "$1 "), "d1": _meta("article:published_time", "date"), "d2": time_tag, "d3": in_url, "d4": _meta("article:modified_time")}
    found = rows.select("page_id", "url", "html", F.coalesce(_tag("h1"), _tag("title"), _meta("og:title")).alias("title"), _meta("author", "article:author").alias("author"), *(c.alias(n) for n, c in dates.items()))
    read = found.mapInPandas(_body_pages, "page_id long, url string, title string, author string, d0 string, d1 string, d2 string, d3 string, d4 string, content string")
    published = F.coalesce(*(parse_flexible_utc(c) for c in ("d0", "d1", "d2", "d3")))
    return read.select("page_id", "url", "title", "author", published.alias("published"), parse_flexible_utc("d4").alias("updated"), "content")


def extract_article_links(pages: DataFrame, domains: Iterable[str] | None = None, sections: Iterable[str] | None = None, most: int | None = None) -> DataFrame:
    """url and distinct absolute link of every href: in the domains and sections, outside /tag/."""
    rows = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*?href=[\"']([^\"'#]+)"), 1)).alias("href"))
    root = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    scheme = F.substring_index("url", ":", 1)
    link = F.when(F.col("href").rlike("(?i)^https?://"), F.col("href")).when(F.col("href").startswith("//"), F.concat(scheme, F.lit(":"), F.col("href"))).when(F.col("href").startswith("/"), F.concat(root, F.col("href")))
    out = rows.select("url", F.trim(link).alias("link")).where(F.col("link").isNotNull() & ~F.col("link").contains("/tag/"))
    if domains is not None:
        host = F.regexp_extract("link", r"^https?://([^/?#:]+)", 1)
        keep = F.lit(False)
        for d in domains:
            keep = keep | (host == d) | host.endswith("." + d)
        out = out.where(keep)
    if sections is not None:
        out = out.where(F.regexp_extract("link", r"^https?://[^/]+/([^/?#]+)", 1).isin(*sections))
    out = out.distinct()
    if most is None:
        return out
    from pyspark.sql import Window

    return out.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy("link"))).where(F.col("_r") <= most).drop("_r")
