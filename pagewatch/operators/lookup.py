"""Rule lists of any length, looked up once a url instead of being compared one by one.

Suffixes of hosts and prefixes of paths and addresses lie in hash tables by length, so that a url costs as many look-ups as
rules have lengths; substrings lie in one automaton. A worker makes the tables once.
"""

from __future__ import annotations

from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts whose answer a worker keeps.
MEMO = 100_000


class Prefixes:
    """Whether some prefix fits."""

    def __init__(self, found: list[str]):
        self.found = set(found)
        self.lengths = sorted({len(p) for p in found})

    def fits(self, text: str) -> bool:
        return any(text[:n] in self.found for n in self.lengths if n <= len(text))


class Suffixes:
    """What belongs to the suffixes that fit."""

    def __init__(self, found: dict[str, object]):
        self.found, self.lengths, self.memo = found, sorted({len(s) for s in found}), {}

    def of(self, text: str) -> list:
        out = self.memo.get(text)
        if out is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            tails = (text[len(text) - n :] for n in self.lengths if n <= len(text))
            out = self.memo[text] = [self.found[t] for t in tails if t in self.found]
        return out


class Pairs:
    """Whether some (host suffix, path prefix) fits."""

    def __init__(self, pairs: list[tuple[str, str]]):
        by: dict[str, list[str]] = {}
        for suffix, prefix in pairs:
            by.setdefault(suffix, []).append(prefix)
        self.hosts = Suffixes({s: Prefixes(p) for s, p in by.items()})

    def fits(self, host: str, path: str) -> bool:
        return any(p.fits(path) for p in self.hosts.of(host))


class Parts:
    """Whether some string occurs; an empty one does in every text."""

    def __init__(self, found: list[str]):
        import ahocorasick

        self.always = "" in found
        self.automaton = ahocorasick.Automaton()
        for p in filter(None, found):
            self.automaton.add_word(p, None)
        self.automaton.make_automaton()

    def fits(self, text: str) -> bool:
        return self.always or (len(self.automaton) > 0 and next(iter(self.automaton.iter(text)), None) is not None)


class Rules:
    """The lists of rules.verdict(); what is looked up in is made where it is used."""

    def __init__(self, special: list, white: list, deny: list[str], black: list[str], allow: list[str]):
        self.lists = (special, white, deny, black, allow)

    def __reduce__(self):
        return Rules, self.lists

    @cached_property
    def tables(self) -> tuple:
        special, white, deny, black, allow = self.lists
        return Pairs(special), Pairs(white), Suffixes(dict.fromkeys(deny, True)), Parts(black), Suffixes(dict.fromkeys(allow, True))

    def verdict(self, url: str, host: str, path: str) -> str | None:
        special, white, deny, black, allow = self.tables
        if special.fits(host, path):
            return "SPECIAL"
        if white.fits(host, path):
            return "ALLOW"
        if deny.of(host):
            return "EXTERNAL"
        if black.fits(url):
            return "BLACK"
        return "ALLOW" if allow.of(host) else None


def looked_up(rules: Rules, url: Column, host: Column, path: Column) -> Column:
    """The verdict by host and url, null if no rule fits; null for a null url."""

    @F.pandas_udf("string")
    def run(urls: pd.Series, hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else rules.verdict(u, h, p) for u, h, p in zip(urls, hosts, paths, strict=True)], dtype=object)

    return run(url, host, path)


def has_prefix(prefixes: list[str], text: Column) -> Column:
    """Whether some prefix fits; null for null."""
    made = Prefixes(prefixes)

    @F.pandas_udf("boolean")
    def run(found: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else made.fits(t) for t in found], dtype=object)

    return run(text)
