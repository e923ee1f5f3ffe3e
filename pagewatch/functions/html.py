"""HTML inspection by expressions over markup (F20-F23, P12-P15), and by a parser where markup is broken."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.urls import host, leading_int, path, script_url


#: The states of a tokeniser, as a lenient parser has them. A quote opens a value only behind =, and closes at the next one of its
#: kind; a tag in which that is missing is text up to the next >. Blanks are those of ASCII. Loops are possessive, so that long markup needs no stack.
_GAP = r"(?:\s|/(?!>))*+"
_VALUE = r"""("[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+)"""
_ATTRIBUTE = rf"""(?<=["'\s/])[^\s/>][^\s/=>]*+(?:\s*+=+\s*{_VALUE.replace('(', '(?:', 1)}\s*+)?+{_GAP}"""
_REST = rf"{_GAP}(?:{_ATTRIBUTE})*+\s*+"
_ANY = r"[a-z][^\t\n\r\f />\x00]*+"
#: Behind a < : comments, marked sections, declarations and end tags; tags that aren't any.
_SKIPPED = r"!--.*?--\s*+>|!\[cdata\[.*?\]\s*+\]\s*+>|[!?/][^>]*+>"
_BROKEN = r"[a-z][^>]*+>"


def _raw(number: int) -> str:
    """Scripts and styles, whose content is no markup, up to their end tag. number: that of the group that holds the name."""
    return rf"(script|style)(?=[\s/>]){_REST}>.*?(?=</\s*+\{number}\s*+>|\z)"


def markup(html: Column) -> Column:
    """Without comments and without what scripts and styles hold: what is left has tags only where a parser sees some."""
    return F.regexp_replace(html, rf"(?is)<!--.*?--\s*+>|(<(script|style)(?=[\s/>]){_REST}>).*?(?=</\s*+\2\s*+>|\z)|(<{_ANY}{_REST}/?+>|<{_BROKEN})", "$1$3")


def tags(html: Column, tag: str) -> Column:
    """Opening tags as text, any case. tag: a name, or a pattern of names."""
    wanted = rf"(<(?:{tag})(?=[\s/>\x00]){_REST}/?+>)"
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{_SKIPPED})|(?={wanted}|<)<(?:{_raw(2)}|{_ANY}{_REST}/?+>|{_BROKEN})"), F.lit(1))
    return F.filter(found, lambda t: t != "")


def tag_names(html: Column) -> Column:
    """The names of all opening tags in their order, in lower case."""
    return F.transform(tags(html, _ANY), lambda t: F.lower(F.regexp_extract(t, r"^<([^\t\n\r\f />\x00]+)", 1)))


def _before(name: str) -> str:
    """Of an opening tag, all before the value of the first attribute of that name that has one."""
    return rf"""(?is)^(<{_ANY}{_GAP}(?:(?!{name}\s*+=){_ATTRIBUTE})*+(?<=["'\s/]){name}\s*+=+\s*)"""


def _unquoted(value: Column) -> Column:
    return F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def attribute(tag: Column, name: str) -> Column:
    """One tag's attribute, in either quotes or none; null where it is absent or has no value. Entities stay as they are."""
    value = F.regexp_extract(tag, _before(name) + _VALUE, 2)
    return F.when(value != "", _unquoted(value))


def attributes(html: Column, tag: str, name: str) -> Column:
    """The values of an attribute in all tags that have it."""
    return F.filter(F.transform(tags(html, tag), lambda t: attribute(t, name)), lambda x: x.isNotNull())


def attribute_rows(rows: DataFrame, html: Column, tag: str, name: str, alias: str) -> DataFrame:
    """attributes() as rows: all columns of rows, and the value."""
    own = rows.withColumn(alias, F.explode(tags(html, tag)))
    return own.withColumn(alias, attribute(F.col(alias), name)).where(F.col(alias).isNotNull())


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def visible_text(html: Column) -> Column:
    """without comments, scripts, styles, title and tags; each leaves a blank, as does a tag that is text for a missing quote."""
    titles = rf"title(?=[\s/>]){_REST}>.*?</title[^>]*+>"
    bare = F.regexp_replace(html, rf"(?is)<(?:{_SKIPPED}|{titles}|{_raw(1)}|{_ANY}{_REST}/?+>)|(<{_BROKEN})", "$2 ")
    return F.trim(F.regexp_replace(bare, "[ \t\r\n]+", " "))


def invisible_style(style: Column) -> Column:
    """A style that hides, or sizes to at most 1 px, or no size at all."""
    sized = style.rlike("(?i)(width|height)[ ]*:")
    tiny = style.rlike("(?i)(width|height)[ ]*:[ ]*[01]([^0-9.]|$)")
    return style.isNull() | ~sized | style.rlike("(?i)(hidden|display[ ]*:[ ]*none)") | tiny


def invisible_iframe(tag: Column) -> Column:
    """No size or one under 3 in sum, and a style that doesn't show it."""
    width, height = attribute(tag, "width"), attribute(tag, "height")
    small = (leading_int(F.coalesce(width, F.lit("0"))) + leading_int(F.coalesce(height, F.lit("0")))) < 3
    return ((width.isNull() & height.isNull()) | small) & invisible_style(attribute(tag, "style"))


def strange_script_name(src: Column) -> Column:
    """A file stem of less than two letters, or one of the usual disguises."""
    stem = F.regexp_extract(F.split_part(src, F.lit("?"), F.lit(1)), r"([^/]*?)(\.[^./]*)?$", 1)
    return (F.length(stem) < 2) | stem.isin("ngg", "script", "js", "ri")  # fixed values


def refresh_target(html: Column) -> Column:
    """the url of the first meta refresh that has one, any case; empty where there is none."""
    kinds = F.filter(tags(html, "meta"), lambda t: F.lower(F.trim(attribute(t, "http-equiv"))) == "refresh")
    found = F.transform(kinds, lambda t: F.regexp_extract(F.coalesce(attribute(t, "content"), F.lit("")), r"(?i)url\s*=\s*[\"']?([^\"'>\s]*)", 1))
    return F.coalesce(F.get(F.filter(found, lambda u: u != ""), F.lit(0)), F.lit(""))


def rewrite_scripts(html: Column, page: Column) -> Column:
    """F8: every script's src as script_url gives it; other markup stays, that in comments and within scripts too."""
    whole = _before("src") + _VALUE + "(.*)$"
    group = lambda x, n: F.regexp_extract(x, whole, n)

    def rewritten(part: Column) -> Column:
        quote = F.when(group(part, 2).rlike("^'"), "'").otherwise('"')
        return F.when(part.rlike(whole), F.concat(group(part, 1), quote, script_url(_unquoted(group(part, 2)), page), quote, group(part, 3))).otherwise(part)

    parts = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{_SKIPPED}|{_raw(1)}|{_ANY}{_REST}/?+>|{_BROKEN})|[^<]++|<"), F.lit(0))
    script = rf"(?is)^<script(?=[\s/>]){_REST}/?+>"
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(script), rewritten(x)).otherwise(x)), "")


def unescaped(text: Column) -> Column:
    """A text node's characters: what a serialiser must write as entities is given back."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def source_list(html: Column, tag: str) -> Column:
    """Host and path of the src of every such tag, sorted; query, fragment and scheme are left out."""
    return F.array_sort(F.transform(F.filter(attributes(html, tag, "src"), lambda s: s != ""), lambda s: F.concat(host(s), path(s))))


def xml_links(xml: Column) -> Column:
    """the text of every link element of a feed; atom links have it in href."""
    plain = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<link\s*>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</link\s*>"), F.lit(1)), F.trim)
    return F.filter(F.concat(plain, attributes(xml, "link", "href")), lambda u: u != "")


def injected(html: Column, chosen: Column, iframe: str = '<iframe src="http://tampered.example.edu/" width="0" height="0"></iframe>') -> Column:
    """Chosen pages with an invisible iframe after their body begins, to test what finds it."""
    return F.when(chosen, F.regexp_replace(html, r"(?i)(<body[^>]*>)", "$1" + iframe)).otherwise(html)


class _Collector(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str, str, str]] = []
        self.elements = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.elements += 1
        self.found += [(self.elements, tag, k, v or "") for k, v in attrs if k in ("href", "src", "action", "content", "http-equiv", "style", "width", "height")]


def parsed_attributes(pages: DataFrame) -> DataFrame:
    """page_id, pos, element, tag, name, value of every attribute that matters, by a lenient parser; null html has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, html in zip(frame["page_id"], frame["html"], strict=True):
                collector = _Collector()
                collector.feed(html or "")
                collector.close()
                rows += [(page_id, i, *x) for i, x in enumerate(collector.found)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "element", "tag", "name", "value"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos int, element int, tag string, name string, value string")
