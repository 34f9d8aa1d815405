"""HTML: text, titles, main content and publication dates, by patterns in the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every named entity of HTML 4 and apos, from the standard library's table; a space that doesn't break is a space here.
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
AMPERSANDS = ["&amp;", "&#38;", "&#x26;", "&#X26;"]
#: Names of meta elements that hold a publication date, the first found wins.
DATE_NAMES = ["pubdate", "publish-date", "publication_date", "date", "Date", "DC.date.issued"]
LEAST_CHARS = 200


def unescape(c: Column) -> Column:
    """Named and numeric entities as the characters they stand for, ampersands last so that nothing is unescaped twice. What is no entity stays."""
    named = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])

    def meaning(e: Column) -> Column:
        body = F.substring(e, F.lit(2), F.length(e) - 2)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)).when(body.startswith("#"), F.substring(body, F.lit(2), F.length(body))).cast("long")
        real = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF) & (number != 160)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(real, number)), 8, "0")), "UTF-32")
        return F.when(number == 160, F.lit(" ")).when(number.isNotNull(), F.coalesce(char, e)).otherwise(F.coalesce(F.try_element_at(named, body), e))

    found = F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)"), 1)), F.array(*[F.lit(x) for x in AMPERSANDS]))
    plain = F.aggregate(found, c, lambda text, e: F.replace(text, e, meaning(e)))
    for x in AMPERSANDS:
        plain = F.replace(plain, F.lit(x), F.lit("&"))
    return F.when(c.contains("&"), plain).otherwise(c)


def to_text(html: Column) -> Column:
    """Text without comments, scripts, styles and tags, white space as single spaces."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, r"<[^>]*>", " ")), r"\s+", " "))


def title(html: Column) -> Column:
    return F.nullif(to_text(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def main_text(html: Column, least: int = LEAST_CHARS) -> Column:
    """The text of <article>, or else of the page without navigation and the like; null unless one has more than ``least`` characters."""
    article = to_text(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<article[^>]*>(.*?)</article>", 1))
    rest = to_text(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<head[^>]*>.*?</head>|<nav[^>]*>.*?</nav>|<header[^>]*>.*?</header>|<footer[^>]*>.*?</footer>|<aside[^>]*>.*?</aside>", " "))
    return F.when(F.length(article) > least, article).when(F.length(rest) > least, rest)


#: Elements whose text isn't an article's, and the blocks that hold an article's text.
BOILERPLATE = ["head", "nav", "header", "footer", "aside", "form", "table", "figure"]
BLOCKS = r"(?:p|h[1-6]|li|blockquote|pre)"


def article_text(html: Column, least: int = LEAST_CHARS) -> Column:
    """(text, method): the blocks of text outside boilerplate that aren't mostly links, in order ("blocks"); if these have no more than ``least`` characters all text of the page ("page"); null if that has no more either.

    A block counts as links if more than half of its characters stand in <a>.
    """
    h = F.coalesce(html, F.lit(""))
    plain = F.regexp_replace(h, "(?is)" + "|".join(rf"<{e}\b[^>]*>.*?</{e}>" for e in BOILERPLATE), " ")
    blocks = F.regexp_extract_all(plain, F.lit(rf"(?is)<{BLOCKS}\b[^>]*>(.*?)</{BLOCKS}>"), 1)
    linked = lambda b: F.length(to_text(F.array_join(F.regexp_extract_all(b, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), 1), " ")))
    told = F.filter(F.transform(blocks, lambda b: F.struct(to_text(b).alias("text"), linked(b).alias("linked"))), lambda x: (F.length(x["text"]) > 0) & (x["linked"] * 2 <= F.length(x["text"])))
    inside, page = F.array_join(F.transform(told, lambda x: x["text"]), " "), to_text(h)
    return F.when(F.length(inside) > least, F.struct(inside.alias("text"), F.lit("blocks").alias("method"))).when(F.length(page) > least, F.struct(page.alias("text"), F.lit("page").alias("method")))


def _attribute(html: Column, element: str, attribute: str, value: str, wanted: str) -> Column:
    """The attribute ``wanted`` of the first element with attribute="value", in either order."""
    pick = lambda p: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit(""))
    q = r"""["']"""
    v = value.replace(".", r"\.")
    return F.coalesce(pick(rf"<{element}[^>]*\b{attribute}={q}{v}{q}[^>]*\b{wanted}={q}([^\"'>]*){q}"), pick(rf"<{element}[^>]*\b{wanted}={q}([^\"'>]*){q}[^>]*\b{attribute}={q}{v}{q}"))


def published(html: Column) -> Column:
    """(raw, source) of the publication date: linked data first, then article:published_time, meta names, <time datetime>, the text of <time>; nulls if there is none."""
    h = F.coalesce(html, F.lit(""))
    linked = F.regexp_extract(h, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    steps = [
        (F.coalesce(*[F.nullif(F.regexp_extract(linked, rf'"{k}"\s*:\s*\[?\s*"([^"]*)"', 1), F.lit("")) for k in ("datePublished", "dateCreated")]), "jsonld:datePublished/dateCreated"),
        (_attribute(h, "meta", "property", "article:published_time", "content"), "meta:article:published_time"),
        *[(_attribute(h, "meta", "name", n, "content"), f"meta:name:{n}") for n in DATE_NAMES],
        (F.nullif(F.trim(F.regexp_extract(h, r"""<time[^>]*\bdatetime=["']([^"']*)["']""", 1)), F.lit("")), "time:datetime"),
        (F.nullif(to_text(F.regexp_extract(h, r"(?is)<time[^>]*>(.*?)</time>", 1)), F.lit("")), "time:text"),
    ]
    found = F.array(*[F.struct(raw.alias("raw"), F.lit(source).alias("source")) for raw, source in steps])  # an array: each step stands in the plan once
    return F.try_element_at(F.filter(found, lambda x: x["raw"].isNotNull()), F.lit(1))
