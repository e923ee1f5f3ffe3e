"""Url verdicts by an ordered cascade of rules."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions import urls
from pagewatch.functions.names import unused
from pagewatch.operators import lookup

#: Rules up to which verdict() is an expression; more are looked up in tables, with the same result.
LISTED = 64
#: Rules that rule_set() takes to the driver, and from there to every worker.
MOST_RULES = 1_000_000


def matches(rows: DataFrame, rules: DataFrame, boundary: bool = False) -> DataFrame:
    """The distinct (host, path) of rows for which some rule's host_suffix and path_prefix fit.

    boundary: a suffix must begin at a label; else any string suffix fits. Hosts are joined to rules on
    their suffixes of the lengths that rules have, so that neither side need be small.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("host_suffix")).distinct().collect())  # as many as hosts have lengths
    own = rows.select("host", "path").distinct()
    tails = own.select("host", "path", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("host"))).alias("n"))
    tails = tails.withColumn("host_suffix", F.right("host", F.col("n")))
    found = tails.join(rules.select("host_suffix", "path_prefix").distinct(), "host_suffix").where(F.startswith("path", "path_prefix"))
    if boundary:
        found = found.where((F.col("n") == F.length("host")) | F.startswith("host_suffix", F.lit(".")) | (F.substring("host", F.length("host") - F.col("n"), F.lit(1)) == "."))
    return found.select("host", "path").distinct()


def _listed(values: list, kind: str) -> Column:
    """An array of values, of any number, as one constant."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def any_suffix(host: Column, suffixes: list[str]) -> Column:
    """J2."""
    return F.exists(_listed(suffixes, "string"), lambda s: F.endswith(host, s)) if suffixes else F.lit(False)


def any_pair(host: Column, path: Column, pairs: list[tuple[str, str]]) -> Column:
    """J1 for a list of (host suffix, path prefix): an expression for each of a few, else a search through them."""
    if len(pairs) > LISTED:
        listed = _listed([{"suffix": s, "prefix": p} for s, p in pairs], "struct<suffix:string,prefix:string>")
        return F.exists(listed, lambda r: F.endswith(host, r["suffix"]) & F.startswith(path, r["prefix"]))
    return reduce(Column.__or__, (host.endswith(s) & path.startswith(p) for s, p in pairs), F.lit(False))


def any_part(text: Column, parts: list[str]) -> Column:
    return F.exists(_listed(parts, "string"), lambda s: F.contains(text, s)) if parts else F.lit(False)


def verdict(url: Column, rules: dict, address: Column | None = None, host: Column | None = None, path: Column | None = None, special: str = "link") -> Column:
    """The first that applies: no host, ONLY, special, white, denied, black, allowed, by address (P2), external.

    rules: only [pattern], link, request and white [(suffix, prefix)], deny and allow [suffix], black [substring], ip [prefix].
    special: the list of urls that were let through: `link` for what pages link to, `request` for what browsers ask for.
    address: what the host resolves to; null is unknown. Without it the address step is left out. Up to LISTED rules are compared
    one by one, within the JVM; longer lists are looked up.
    """
    host, path = urls.host(url) if host is None else host, urls.path(url) if path is None else path
    out = F.when(host == "", "EXTERNAL")
    if rules.get("only"):
        return out.when(url.rlike(urls.only_pattern(rules["only"])), "ALLOW").otherwise("BLACK")
    lists = [rules.get(k, []) for k in (special, "white", "deny", "black", "allow")]
    if sum(map(len, lists)) > LISTED:
        found = lookup.looked_up(lookup.Rules(*lists), url, host, path)
        out = out.when(found.isNotNull(), found)
    else:
        let, white, deny, black, allow = lists
        out = out.when(any_pair(host, path, let), "SPECIAL").when(any_pair(host, path, white), "ALLOW")
        out = out.when(any_suffix(host, deny), "EXTERNAL").when(any_part(url, black), "BLACK").when(any_suffix(host, allow), "ALLOW")
    if address is not None and rules.get("ip"):
        ips = rules["ip"]
        inside = lookup.has_prefix(ips, address) if len(ips) > LISTED else F.exists(_listed(ips, "string"), lambda s: F.startswith(address, s))
        out = out.when(address.isNull(), "UNKNOWN").when(inside, "BLACK")
    return out.otherwise("EXTERNAL")


def with_address(rows: DataFrame, dns: DataFrame, url: str = "url") -> DataFrame:
    """Rows and address, what the url's host resolves to by dns (host, address: one row a host); null where it doesn't."""
    of, host = unused(rows, "of", "host")
    own = dns.select(F.col("host").alias(host), "address")
    return rows.withColumn(of, urls.host(F.col(url))).join(own, F.col(of) == F.col(host), "left").drop(of, host)


def rule_set(rows: DataFrame) -> dict:
    """The rules that verdict() takes, of RULE rows. More than MOST_RULES raise an error: join such tables by matches()."""
    out = {k: [] for k in ("only", "link", "request", "white", "deny", "black", "allow", "ip")}
    own = rows.where(F.col("kind").isin(*(k.upper() for k in out))).orderBy("kind", "host_suffix", "path_prefix", "pattern").limit(MOST_RULES + 1).collect()
    if len(own) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; matches() joins them instead")
    for r in own:
        out[r.kind.lower()].append((r.host_suffix, r.path_prefix) if r.path_prefix is not None else r.pattern if r.pattern is not None else r.host_suffix)
    return out


def with_verdict(rows: DataFrame, url: str, rules: dict, name: str = "verdict", address: str | None = None, special: str = "link") -> DataFrame:
    """Rows and verdict(url); host and path are taken from the url once."""
    host, path = unused(rows, "host", "path")
    rows = rows.withColumns({host: urls.host(F.col(url)), path: urls.path(F.col(url))})
    found = verdict(F.col(url), rules, None if address is None else F.col(address), F.col(host), F.col(path), special)
    return rows.withColumn(name, found).drop(host, path)


def sent(links: DataFrame, scripts: DataFrame) -> DataFrame:
    """page_id, url, verdict: judged links, and scripts' urls, which are always fetched."""
    return links.select("page_id", "url", "verdict").unionByName(scripts.select("page_id", "url", F.lit("ALLOW").alias("verdict"))).distinct()


def strange(kind: Column) -> Column:
    """P4."""
    return kind.isin("EXTERNAL", "UNKNOWN")


#: Parts of content types, by route.
XML_TYPES = ["plain/xml", "text/xml", "application/xml"]
HTML_TYPES = ["html"]
JS_TYPES = [
    "application/javascript", "application/ecmascript", "application/x-ecmascript", "application/x-javascript", "text/javascript", "text/ecmascript",
    "text/jscript", "text/livescript", "text/x-ecmascript", "text/x-javascript",
]


def content_route(content_type: Column) -> Column:
    """P5: xml, html, js or file, the first of which a part occurs in the content type."""
    kind, out = F.lower(F.coalesce(content_type, F.lit(""))), F
    for route, parts in (("xml", XML_TYPES), ("html", HTML_TYPES), ("js", JS_TYPES)):
        out = out.when(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(kind, p)), route)
    return out.otherwise("file")


def redirect_kind(url: Column, final_url: Column) -> Column:
    """None, same (host) or other."""
    return F.when(url == final_url, "none").when(urls.host(url) == urls.host(final_url), "same").otherwise("other")


def fits(parts: Column, text: Column) -> Column:
    """Whether the text begins as a pattern says that was split at *, which stands for anything; all else is for itself.

    The first part begins the text; each other one is looked for behind the one before it.
    """
    behind = lambda at, p: F.when((at == 0) | (F.position(p, text, at) == 0), 0).otherwise(F.position(p, text, at) + F.length(p))
    first = F.get(parts, F.lit(0))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.startswith(text, first) & F.when(F.size(parts) == 1, True).otherwise(F.aggregate(rest, F.length(first) + 1, behind) > 0)


def robots_path(url: Column) -> Column:
    """What robots rules are held against: all behind the host, percent coding undone and done again; an empty path is /."""
    plain = urls.percent_decode(F.regexp_replace(url, "%(?![0-9A-Fa-f]{2})", "%25"))
    behind = F.regexp_replace(plain, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", "")
    behind = F.regexp_replace(F.regexp_replace(behind, r"^([^?#]*)[?](#|$)", "$1$2"), "#$", "")  # empty queries and fragments
    rooted = F.regexp_replace(behind, r"^(?=[?#]|$)", "/")
    return F.replace(urls.percent_encode(rooted), F.lit(":"), F.lit("%3A"))


def entry_for(rules: DataFrame, agent: str) -> DataFrame:
    """host, lines, delay, rate_requests, rate_seconds: each host's first entry for the agent, else the one for *; lines in order.

    rules: host, entry_no, agent, rule_no, path_pattern, allow, delay, rate_requests, rate_seconds. Lines are as many as a file has.
    An entry is for agents whose name begins as its own says, in which * stands for anything.
    """
    name = F.lit(agent.lower().split("/")[0])
    level = F.when(F.col("agent") == "*", 1).when(fits(F.split(F.lower("agent"), "[*]"), name), 0)
    line = F.struct(level.alias("level"), "entry_no", "rule_no", "allow", F.split("path_pattern", "[*]").alias("parts"), "delay", "rate_requests", "rate_seconds")
    every = rules.where(level.isNotNull()).groupBy("host").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    first = F.col("lines")[0]
    own = F.filter("lines", lambda x: (x["level"] == first["level"]) & (x["entry_no"] == first["entry_no"]))
    return every.select("host", own.alias("lines"), *(first[c].alias(c) for c in ("delay", "rate_requests", "rate_seconds")))


def with_can_fetch(rows: DataFrame, rules: DataFrame, agent: str, url: str = "url", name: str = "allowed") -> DataFrame:
    """Rows and whether the agent may fetch the url. rules: as entry_for takes them.

    In the host's entry the first line that fits path, query and fragment decides; without one, an entry or a url it is
    allowed. A url without a path has /.
    """
    host, path, own, lines = unused(rows, "host", "path", "rule_host", "lines")
    entries = entry_for(rules, agent).select(F.col("host").alias(own), F.col("lines").alias(lines))
    found = rows.withColumns({host: urls.host(F.col(url)), path: robots_path(F.col(url))}).join(entries, F.col(host) == F.col(own), "left")
    hit = F.get(F.filter(lines, lambda x: fits(x["parts"], F.col(path))), F.lit(0))["allow"]
    return found.withColumn(name, F.coalesce(hit, F.lit(True))).drop(host, path, own, lines)


def can_fetch(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """page_id, allowed per row of pages, each decided by its own url, whatever its page_id (see with_can_fetch)."""
    return with_can_fetch(pages.select("page_id", "url"), rules, agent).select("page_id", "allowed")


def crawl_waits(hosts: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """host, delay, rate_requests, rate_seconds that the agent must keep at each of hosts; nulls where nothing is said."""
    return hosts.select("host").distinct().join(entry_for(rules, agent).drop("lines"), "host", "left")
