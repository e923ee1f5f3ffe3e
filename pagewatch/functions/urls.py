"""URL algebra as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.names import unused

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"

#: What is replaced in links, in this order.
ENTITIES = [
    ("&quot;", '"'), ("&#34;", '"'), ("&#x22;", '"'), ("&amp;", "&"), ("&#38;", "&"), ("&#x26;", "&"), ("&lt;", "<"), ("&#60;", "<"), ("&#x3C;", "<"),
    ("&gt;", ">"), ("&#62;", ">"), ("&#x3E;", ">"), ("&nbsp;", "%20"), ("&#160;", "%20"), ("&#xA0;", "%20"), (" ", "%20"),
]


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, SCHEME, 1)


def host(url: Column) -> Column:
    """the network location, with port and user; empty where there is none. Never raises."""
    return F.regexp_extract(url, AUTHORITY, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def remove_query(url: Column) -> Column:
    """up to the first ?, less one trailing slash."""
    return F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "/$", "")


def remove_port(url: Column) -> Column:
    """every :digits goes."""
    return F.regexp_replace(url, ":[0-9]+", "")


def remove_scheme(url: Column) -> Column:
    """F6."""
    return F.regexp_replace(url, "^https?://", "")


def request_url(url: Column) -> Column:
    """scheme and query go; a search engine's redirector is unwrapped."""
    bare = remove_scheme(url)
    wrapped = "www.google.com/url?sa=p&q="
    return remove_query(F.when(bare.startswith(wrapped), remove_scheme(F.substring(bare, len(wrapped) + 1, 1 << 30))).otherwise(bare))


def only_pattern(patterns: list[str]) -> str:
    """one anchored alternation of all patterns."""
    return "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def file_name(url: Column) -> Column:
    """host and path with - for /, then 12 digits of the query's SHA-256."""
    return F.concat(host(url), F.replace(path(url), F.lit("/"), F.lit("-")), F.right(F.sha2(query(url), 256), F.lit(12)))


def host_file(name: Column) -> Column:
    """F12."""
    return F.translate(name, ":.", "--")


def leading_int(text: Column) -> Column:
    """leading digits as a number, else 0."""
    return F.coalesce(F.regexp_extract(text, "^([0-9]+)", 1).try_cast("int"), F.lit(0))


def replace_entities(text: Column) -> Column:
    """Entities become their characters, line ends go."""
    plain = F.regexp_replace(F.trim(text), "[\r\n]", "")
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ENTITIES, plain)


def skipped_link(link: Column) -> Column:
    """P10: fragments, the root alone, and links that lead to no page."""
    low = F.lower(F.trim(link))
    return (low == "") | (low == "/") | low.startswith("#") | low.startswith("mailto:") | low.startswith("tel:") | low.startswith("javascript:")


def resolve_dots(route: Column) -> Column:
    """.. takes the segment before it away, never the root; . and empty segments go."""
    kept = F.aggregate(
        F.split(route, "/"),
        F.array().cast("array<string>"),
        lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)),
    )
    tail = F.when(route.rlike("/$|/\\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def absolute(link: Column, page: Column) -> Column:
    """link as seen from page, without resolving dots."""
    to = F.regexp_replace(F.trim(link), r"^\./", "")
    root, start = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.left(to, F.lit(1))
    folder = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?)", 1)
    return (
        F.when(to.rlike("(?i)^https?:"), to)
        .when(F.startswith(to, F.lit("//")), F.concat(scheme(page), F.lit(":"), to))
        .when(start == "/", F.concat(root, to))
        .when(start == "?", F.concat(root, path(page), to))
        .when(folder != "", F.concat(folder, to))
        .otherwise(F.concat(root, F.lit("/"), to))
    )


def with_normal(rows: DataFrame, link: str, page: str, name: str) -> DataFrame:
    """rows and the column `name`: link as seen from page, entities replaced, no fragment, dots resolved, doubtful queries cut off.

    In steps, so that what several parts need is computed once.
    """
    to, full, root, route, ask, one = unused(rows, "to", "full", "root", "route", "query", "made")
    rows = rows.withColumn(to, replace_entities(F.col(link)))
    rows = rows.withColumn(full, absolute(F.col(to), F.col(page))).drop(to)
    rows = rows.withColumn(full, F.replace(F.split_part(full, F.lit("#"), F.lit(1)), F.lit("?&"), F.lit("?")))
    rows = rows.withColumns({root: F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), route: path(F.col(full)), ask: query(F.col(full))})
    n_mark, n_and, n_is = (F.length(full) - F.length(F.replace(full, F.lit(c), F.lit(""))) for c in "?&=")
    plain = (n_mark == 1) & ~F.contains(ask, F.lit("&&")) & ~F.contains(ask, F.lit("==")) & (n_is == n_and + 1)
    made = F.concat(root, resolve_dots(F.col(route)), F.when(plain, F.concat(F.lit("?"), F.col(ask))).otherwise(""))
    # exploding one value keeps later filters above it; pushed down, they would hold all of this several times
    return rows.withColumn(one, F.array(made)).drop(name).select("*", F.explode(one).alias(name)).drop(one, full, root, route, ask)


def script_url(src: Column, page: Column) -> Column:
    """a script's address: absolute, entities replaced, dots resolved, no port."""
    full = absolute(replace_entities(src), page)
    ask = F.regexp_extract(full, r"(\?.*)$", 1)
    root = F.regexp_extract(full, r"(?i)^(https?://[^/?#]*)", 1)
    return remove_port(F.when(root != "", F.concat(root, resolve_dots(path(full)), ask)).otherwise(full))


def near_calendar_date(url: Column, now: int, most: int = 7_000_000) -> Column:
    """False for exact_date~<10 digits> that lie further than `most` seconds from now."""
    stamp = F.regexp_extract(url, "exact_date~([0-9]{10})", 1).try_cast("long")
    return F.coalesce(F.abs(F.lit(now) - stamp) <= most, F.lit(True))


def percent_decode(text: Column) -> Column:
    """%XX becomes its character, + stays; null where that is no UTF-8."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def percent_encode(text: Column) -> Column:
    """all but letters, digits, _ . - ~ and : / becomes %XX."""
    out = F.url_encode(text)
    for code, char in (("+", "%20"), ("%3A", ":"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out
