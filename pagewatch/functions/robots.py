"""robots.txt files as rule rows."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse, urlunparse

import pandas as pd
from pyspark.sql import DataFrame

RULES = "host string, entry_no int, agent string, rule_no int, path_pattern string, allow boolean, delay int, rate_requests int, rate_seconds int"


def parse(text: str, status: int = 200) -> list[tuple]:
    """Entries' rules: (entry_no, agent, rule_no, path, allow, delay, requests, seconds); one row an agent and rule.

    Status 401 and 403 deny everything, others from 400 to 499 allow everything. An empty line ends an entry; agents
    without a line of their own before it, or before the file's end, are dropped. An entry that names * is for all others
    only, and the first such one counts. A line without a path allows all. Lines before an agent, and unknown keys, are left out.
    """
    if status in (401, 403):
        return [(0, "*", 0, "/", False, None, None, None)]
    if 400 <= status < 500:
        return []
    entries, agents, rules, extra, begun = [], [], [], [None, None, None], False

    def close() -> None:
        nonlocal agents, rules, extra, begun
        starred = any("*" in names for names, *_ in entries)
        if begun and not ("*" in agents and starred):
            entries.append((["*"] if "*" in agents else agents, rules or [("/", True)], extra))
        agents, rules, extra, begun = [], [], [None, None, None], False

    for line in text.splitlines():
        if not line:
            close()
            continue
        key, found, value = line.split("#", 1)[0].strip().partition(":")
        key, value = key.strip().lower(), unquote(value.strip())
        if not found:
            continue
        if key == "user-agent":
            if begun:
                close()
            agents.append(value.lower())
        elif agents and key in ("allow", "disallow"):
            rules.append((quote(urlunparse(urlparse(value)), safe="/*"), key == "allow") if value else ("/", True))
            begun = True
        elif agents and key == "crawl-delay":
            extra[0] = int(value) if value.isdigit() else extra[0]
            begun = True
        elif agents and key == "request-rate":
            parts = value.split("/")
            if len(parts) == 2 and all(p.strip().isdigit() for p in parts):
                extra[1:] = [int(p) for p in parts]
            begun = True
    close()
    return [(i, agent, j, path, allow, *more) for i, (names, lines, more) in enumerate(entries) for agent in names for j, (path, allow) in enumerate(lines)]


def robots_rules(files: DataFrame) -> DataFrame:
    """RULES of files: host, status, body. A null body has no rules."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RULES.split(", ")]
        for frame in frames:
            rows = [(host, *r) for host, status, body in zip(frame["host"], frame["status"], frame["body"], strict=True) for r in parse(body or "", int(status))]
            out = pd.DataFrame(rows, columns=names)
            for name in ("delay", "rate_requests", "rate_seconds"):
                out[name] = out[name].astype("Int32")
            yield out

    return files.select("host", "status", "body").mapInPandas(run, RULES)
