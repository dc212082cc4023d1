"""Web pages: plain text, article, links, host lists, accept rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Named entities that are decoded in web pages, and in markup that parsers make; fixed values.
PAGE_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ensp": " ", "emsp": " ", "ldquo": "“", "rdquo": "”", "middot": "·"}
MARKUP_ENTITIES = PAGE_ENTITIES | {"thinsp": " ", "lsquo": "‘", "rsquo": "’", "times": "×", "divide": "÷", "plusmn": "±", "le": "≤", "ge": "≥", "deg": "°", "mdash": "—", "ndash": "–", "hellip": "…"}
ENTITY = "&(?:#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,9}|[a-zA-Z]{2,8});"
NOISE = "script|style|noscript|svg|head"
FRAME = f"{NOISE}|nav|header|footer|form|select|button"
BLOCK_END = r"(?i)</(p|div|li|tr|h[1-6]|section|article|table|ul|ol|td)>|<br\s*/?>"


def character(number: Column) -> Column:
    """The character of a code point; null for surrogates and numbers beyond the last one."""
    valid = number.between(0, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def entity(whole: Column, names: dict[str, str]) -> Column:
    """What an entity stands for; one that is not known stays as it is written."""
    body = F.substring(whole, F.lit(2), F.length(whole) - 2)
    number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 8), 16, 10).cast("long")).when(body.startswith("#"), F.substring(body, 2, 9).cast("long"))
    named = F.get(F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in names.items())), lambda x: x["n"] == body), F.lit(0))["c"]
    return F.coalesce(F.when(number.isNotNull(), character(number)).otherwise(named), whole)


def decode(text: Column, names: dict[str, str] = PAGE_ENTITIES) -> Column:
    """Entities decoded in one pass, so nothing is decoded twice: the text is cut at them and joined again. The text is
    worked out once, and cut only if it has a mark of an entity."""

    def one(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)), lambda x: entity(x, names))
        joined = F.array_join(F.zip_with(F.split(t, ENTITY, -1), found, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    return let(text, one)


def bare(html: Column, blocks: str) -> Column:
    """Without comments and the named blocks; a block ends at the first end tag of any of them."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), rf"(?is)<({blocks})\b[^>]*>.*?</({blocks})\s*>", " ")


def untagged(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<[^>]*>", " ")


def page_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(decode(untagged(bare(html, NOISE))), r"\s+", " "))


def article_title(html: Column) -> Column:
    """The first h1 with text, else the title."""
    def text(tag: str) -> Column:
        return F.trim(F.regexp_replace(decode(untagged(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))), r"\s+", " "))

    return F.coalesce(F.nullif(text("h1"), F.lit("")), F.nullif(text("title"), F.lit("")))


def article_lines(html: Column) -> Column:
    """Lines of the article: frames dropped, block ends as line ends, blank lines and repeats of the line before gone."""
    lines = F.split(decode(untagged(F.regexp_replace(bare(html, FRAME), BLOCK_END, "\n"))), "\n")
    lines = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return let(lines, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def article(pages: DataFrame, *keep: Column) -> DataFrame:
    """page_id, title, text: from after the first line that holds the title; and further columns of the pages."""
    names = [f"_k{i}" for i in range(len(keep))]
    rows = pages.select("page_id", *(c.alias(n) for c, n in zip(keep, names, strict=True)), article_title(F.col("html")).alias("title"), article_lines(F.col("html")).alias("lines"))
    at = F.coalesce(F.array_position(F.transform("lines", lambda x: F.contains(x, F.col("title"))), True), F.lit(0))
    return rows.select("page_id", "title", F.array_join(F.slice("lines", at.cast("int") + 1, F.greatest(F.size("lines"), F.lit(1))), "\n").alias("text"), *names)


def accepted(pages: DataFrame, least_article: int = 50, least_excerpt: int = 20) -> DataFrame:
    """page_id, text, from_article: the article, or the page's text where it is too short; pages with too little go."""
    rows = article(pages, page_text(F.col("html"))).select("page_id", F.col("text").alias("article"), F.col("_k0").alias("page"))
    good = F.length("article") >= least_article
    return rows.select("page_id", F.when(good, F.col("article")).otherwise(F.col("page")).alias("text"), good.alias("from_article")).filter(F.length("text") >= least_excerpt)


#: scheme, authority, path, query and fragment of a reference; RFC 3986, appendix B.
REFERENCE = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def without_dots(path: Column) -> Column:
    """A path without "." and ".." segments: a fold over its segments that keeps those that are open. ".." above the root
    stays at the root; at the end, both leave a slash."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).otherwise(F.array_append(a, x)))
    tail = F.when(path.rlike(r"(^|/)\.{1,2}$"), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(kept, "/"), tail)).otherwise(path)


def resolved(base: Column, href: Column) -> Column:
    """A reference resolved against the url of its page (RFC 3986, 5.2), the fragment kept."""
    part = lambda text, i: F.regexp_extract(text, REFERENCE, i)
    own_scheme, own_host = F.concat(part(base, 1), F.lit(":")), F.concat(F.lit("//"), part(base, 2))
    path, query, fragment = part(href, 3), part(href, 4), part(href, 5)
    folder = F.when(part(base, 3) == "", "/").otherwise(F.regexp_replace(part(base, 3), "[^/]*$", ""))
    merged = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    return (
        F.when(part(href, 1) != "", F.concat(part(href, 1), F.lit(":"), F.when(href.rlike("^[^/?#]*://"), F.concat(F.lit("//"), part(href, 2))).otherwise(""), without_dots(path), query, fragment))
        .when(href.startswith("//"), F.concat(own_scheme, F.lit("//"), part(href, 2), without_dots(path), query, fragment))
        .when(path == "", F.concat(own_scheme, own_host, part(base, 3), F.when(query != "", query).otherwise(part(base, 4)), fragment))
        .otherwise(F.concat(own_scheme, own_host, without_dots(merged), query, fragment))
    )


def links(pages: DataFrame, extensions: tuple[str, ...] = ()) -> DataFrame:
    """page_id, url, text of the anchors, relative ones resolved, the first of each url; with extensions only those
    whose url, text or title ends in one. Anchors within the page and other schemes than http(s) are left out; an anchor
    without text has its title."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), 1)
    rows = pages.select("page_id", "url", F.posexplode(anchors).alias("pos", "a"))
    rows = rows.withColumns({"href": F.trim(decode(F.regexp_extract("a", r"""(?is)\bhref\s*=\s*["']([^"']*)""", 1))), "title": F.trim(F.regexp_replace(decode(F.regexp_extract("a", r"""(?is)^<a\b[^>]*\btitle\s*=\s*["']([^"']*)""", 1)), r"\s+", " ")), "text": F.trim(F.regexp_replace(decode(untagged(F.col("a"))), r"\s+", " "))})
    rows = rows.filter((F.col("href") != "") & ~F.col("href").startswith("#"))
    rows = rows.select("page_id", "pos", "href", "title", F.when(F.col("text") != "", F.col("text")).otherwise(F.col("title")).alias("text"), resolved(F.col("url"), F.col("href")).alias("full")).filter(F.col("full").rlike("(?i)^https?://"))
    if extensions:
        ends = rf"(?i)\.({'|'.join(extensions)})([?#].*)?$"
        rows = rows.filter(F.col("full").rlike(ends) | F.col("text").rlike(ends) | F.col("title").rlike(ends))
    return rows.groupBy("page_id", F.col("full").alias("url")).agg(F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def allowed(rows: DataFrame, patterns: list[str], url_col: str = "url") -> DataFrame:
    """Rows with host and trusted: the host is one of the patterns or lies under it. Patterns may have a scheme, a
    leading "*." or "." and a path, which do not count."""
    import re

    names = sorted({re.sub(r"^[a-z]+://|^\*?\.|/.*$", "", re.sub(r"^[a-z]+://", "", p.strip().lower())) for p in patterns} - {""})
    host = host_of(F.col(url_col))
    # the host and what it lies under, one look-up each: the plan does not grow with the list
    labels = F.split(F.col("host"), "[.]")
    under = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return rows.withColumn("host", host).withColumn("trusted", F.coalesce(F.exists(under, lambda n: n.isin(names)), F.lit(False)) if names else F.lit(False))


def robots_allows(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """urls (host, path) that no rule (host, prefix) forbids."""
    r, u = rules.filter("prefix <> ''").alias("r"), urls.alias("u")
    return u.join(r, (F.col("u.host") == F.col("r.host")) & F.startswith(F.col("u.path"), F.col("r.prefix")), "left_anti")


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, prefix) that the groups for all agents forbid, from (host, text) of robots files."""
    lines = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    clean = lines.select("host", "n", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line"))
    agent = F.when(F.lower("line").startswith("user-agent:"), F.trim(F.regexp_replace("line", "(?i)^user-agent:", "")))
    from pyspark.sql import Window as W

    by = W.partitionBy("host").orderBy("n")
    marked = clean.withColumn("agent", F.last(agent, True).over(by))
    return marked.filter((F.col("agent") == "*") & F.lower("line").startswith("disallow:")).select("host", F.trim(F.regexp_replace("line", "(?i)^disallow:", "")).alias("prefix")).filter("prefix <> ''")


def download_name(url: Column, disposition: Column) -> Column:
    """A file name from the Content-Disposition header, else from the url's path."""
    star = F.url_decode(F.regexp_extract(disposition, r"(?i)filename\*\s*=\s*(?:UTF-8'')?([^;]+)", 1))
    plain = F.regexp_extract(disposition, r"""(?i)filename\s*=\s*"?([^";]+)""", 1)
    path = F.url_decode(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1))
    return F.coalesce(F.nullif(F.trim(star), F.lit("")), F.nullif(F.trim(plain), F.lit("")), F.nullif(path, F.lit("")), F.lit("download"))


# ---- result pages of search engines -------------------------------------------------------------------------------------
#: How two engines mark up a result: its block, its link and title, its excerpt; fixed patterns. The second begins blocks with
#: a tag that may carry the real address in an attribute.
FIRST_BLOCK, FIRST_LINK, FIRST_TEXT = r'(?s)<li class="b_algo\b[^"]*"(.*?)</li>', r'(?s)<h2[^>]*>\s*<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', r"(?s)<p[^>]*>(.*?)</p>"
SECOND_START, SECOND_LINK = r'<div[^>]*class="[^"]*\bc-container\b[^"]*"[^>]*>', r'(?s)<h3[^>]*>\s*<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
SECOND_TEXT = r'(?s)<(?:span|div)[^>]*class="[^"]*(?:content-right|c-abstract|c-span-last)[^"]*"[^>]*>(.*?)</(?:span|div)>'
#: Links that only count clicks: the target is in base64url behind a mark; and the host whose links never are the target.
TRACKER, OWN_HOST = r"^https?://(?:[^/?#]*\.)?bing\.com/ck/a\?(?:.*&)?u=a1([A-Za-z0-9_-]+)", r"^https?://(?:[^/?#]*\.)?baidu\.com(?:[:/?#]|$)"


def click_target(href: Column) -> Column:
    """The address behind a click counter, or the link itself where it is none or holds no address."""
    code = F.translate(F.regexp_extract(href, TRACKER, 1), "-_", "+/")
    padded = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("="))
    target = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.when((code != "") & target.rlike("^https?://"), target).otherwise(href)


def result_links(pages: DataFrame) -> DataFrame:
    """query_id, pos, url, title, snippet of result pages (query_id, html) of either engine, in the page's order; a block
    without a link is left out."""
    first = F.transform(F.regexp_extract_all("html", F.lit(FIRST_BLOCK), F.lit(1)), lambda b: F.struct(F.lit("").alias("start"), b.alias("block"), F.lit(1).alias("engine")))
    starts, gaps = F.regexp_extract_all("html", F.lit(SECOND_START), F.lit(0)), F.split("html", SECOND_START, -1)
    second = F.zip_with(starts, F.slice(gaps, 2, F.size(starts)), lambda s, g: F.struct(s.alias("start"), g.alias("block"), F.lit(2).alias("engine")))
    each = pages.filter("html is not null").select("query_id", F.posexplode(F.concat(first, second)).alias("pos", "x")).select("query_id", "pos", "x.*")
    one = F.col("engine") == 1
    part = lambda a, b, i: F.when(one, F.regexp_extract("block", a, i)).otherwise(F.regexp_extract("block", b, i))
    clean = lambda c: F.trim(F.regexp_replace(decode(F.regexp_replace(c, r"(?s)<[^>]*>", "")), r"\s+", " "))
    href = decode(part(FIRST_LINK, SECOND_LINK, 1))
    real = decode(F.regexp_extract("start", r'\bmu="([^"]+)"', 1))
    url = F.when(one, click_target(href)).when(real.rlike("^https?://") & ~real.rlike(OWN_HOST), real).otherwise(href)
    rows = each.withColumn("url", url).filter(href != "")
    return rows.select("query_id", "pos", "url", clean(part(FIRST_LINK, SECOND_LINK, 2)).alias("title"), clean(part(FIRST_TEXT, SECOND_TEXT, 1)).alias("snippet"))
