"""Text predicates, scrubbing and tokens as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from talweg.functions.parsing import nfkc


def topic_key(c: Column, unicode_form: bool = False) -> Column:
    """Lower case without spaces and punctuation, for matching labels. ``unicode_form``: NFKC first."""
    return F.regexp_replace(F.lower(nfkc(c) if unicode_form else c), r"(?U)[\s\W_]+", "")


def matched_terms(c: Column, terms: list[str]) -> Column:
    """The terms that the text contains, in the order given."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t))


def label_match(c: Column, aliases: list[str], exclude: list[str] = (), unicode_form: bool = False) -> Column:
    """An alias is contained and no excluded term is."""
    key = topic_key(c, unicode_form)
    none = F.lit(True) if not exclude else F.size(matched_terms(key, list(exclude))) == 0
    return (F.size(matched_terms(key, aliases)) > 0) & none


#: In this order: each takes out what the next might misread.
SCRUBS = {
    "url": r"https?://\S+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"\+?[0-9][0-9() -]{7,}[0-9]",
    "date": r"[0-9]{2,4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{2,4}\s*年\s*[0-9]{1,2}\s*月(?:\s*[0-9]{1,2}\s*日)?",
    "page": r"第\s*[0-9]+\s*頁|(?i)\bpages?\s+[0-9]+",
    "identifier": r"\b[A-Za-z]{1,4}-?[0-9]{4,}\b",
    "number": r"[0-9]+",
}
#: The same matches without a try from each character of a word: from where one begins, or where the last match ended.
QUICK = {"email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"}
#: Titles that follow a person's name in minutes.
ROLES = ["主席", "主任委員", "副主任委員", "委員", "局長", "副局長", "科長", "處長", "主任", "專員", "代表"]


def scrub(c: Column, roles: list[str] = ()) -> tuple[Column, dict[str, Column]]:
    """(text without metadata, how many of each kind went). Format characters go first; names before ``roles`` last."""
    counts = {}
    c = F.regexp_replace(c, r"\p{Cf}", "")
    kinds = SCRUBS | QUICK
    if roles:
        kinds["role"] = rf"\p{{IsHan}}{{2,4}}?(?:{'|'.join(sorted(roles, key=len, reverse=True))})"
    for name, rx in kinds.items():
        counts[name] = F.regexp_count(c, F.lit(rx))
        c = F.regexp_replace(c, rx, " ")
    return c, counts


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often ``use`` names it: as the element of an array it has a name."""
    return F.get(F.transform(F.array(c), use), 0)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))


def mixed_tokens(c: Column, contained: list[str] = ()) -> Column:
    """Lower-case runs of Latin letters and digits, 2- to 4-grams of each run of Han characters, and the listed terms that the text contains."""
    def parts(own: Column, low: Column) -> Column:
        latin = F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9]+"), F.lit(0))
        han = F.regexp_extract_all(own, F.lit(r"\p{IsHan}+"), F.lit(0))
        grams = F.flatten(F.transform(han, lambda run: F.flatten(F.array(*(ngrams(run, n) for n in (2, 3, 4))))))
        return F.concat(latin, grams, *([matched_terms(low, [t.lower() for t in contained])] if contained else []))

    return once(c, lambda own: once(F.lower(own), lambda low: parts(own, low)))


def udf_tokens(tokenize: Callable[[str], Iterable[str]]) -> Callable[[Column], Column]:
    """A Python tokenizer as one on columns: Arrow batches, null texts have no tokens."""
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [] if x is None else list(tokenize(x)))

    return lambda c: F.pandas_udf(run, "array<string>")(c)


def kept_tokens(c: Column, stop: list[str] = (), protect: list[str] = (), low: int = 2, high: int = 12) -> Column:
    """Tokens of a length in bounds with a letter that are no stop words; a protected one may be a stop word."""
    def good(t: Column) -> Column:
        sound = F.length(t).between(low, high) & t.rlike(r"\p{L}")
        if not stop:
            return sound
        return sound & (~t.isin(*stop) | t.isin(*protect) if protect else ~t.isin(*stop))

    return F.filter(c, good)


def ngrams(c: Column, n: int) -> Column:
    """Character n-grams of a string, in order."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def visible_text(html: Column) -> Column:
    """HTML without scripts, styles, comments and tags, single-spaced."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def under_domain(url: Column, domains: list[str]) -> Column:
    """The host is one of the domains or under one; an unreadable address is not."""
    h = host(url)
    return F.coalesce(F.exists(F.array(*map(F.lit, domains)), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d))), F.lit(False))


def listed(html: Column, url: Column) -> Column:
    """Anchors of a page as array<struct<place, url, title>>: addresses made whole by the page's own, titles as they are seen; those without a title or to a place in the page are left out."""
    anchor = r'(?is)<a\b[^>]*?\bhref="([^"#][^"]*)"[^>]*>(.*?)</a>'
    site = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(url, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    whole = lambda h: F.when(h.rlike("^https?://"), h).when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(url, "^(https?:)", 1), h)).when(F.startswith(h, F.lit("/")), F.concat(site, h)).otherwise(F.concat(folder, h))
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(anchor), F.lit(1)).alias("h"), F.regexp_extract_all(html, F.lit(anchor), F.lit(2)).alias("t"))
    each = F.transform(pairs, lambda p, i: F.struct(i.alias("place"), whole(p["h"]).alias("url"), visible_text(p["t"]).alias("title")))
    return F.filter(each, lambda x: x["title"] != "")


def detail(html: Column) -> Column:
    """struct<title, heading, body> of a page: its title, its first heading, and what is seen of its article (else of all)."""
    first = lambda tag: visible_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    article = F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    body = F.when(article != "", article).otherwise(html)
    return F.struct(first("title").alias("title"), first("h1").alias("heading"), visible_text(body).alias("body"))
