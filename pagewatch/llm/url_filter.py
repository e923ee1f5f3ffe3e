"""URL filter: rules first; else naive Bayes over the words of hosts and paths, hosts segmented by Viterbi.

Words' frequencies over all pages' html are the unigram model; the likeliest split of a host's letters is
found per distinct piece, from the joined frequencies of its substrings, so that the dictionary is never
sent to a task. The Bayes model is multinomial and learns from the urls that the rules decide, allow against
block, with Laplace's smoothing: it carries the rules' judgement over to urls that no rule knows. Words' counts
and weights stay tables; the driver gets sums only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.llm.shared import table

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with its path.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]

#: Letters of the longest label of a host (RFC 1035), and so of the longest word in one.
LABEL = 63
#: Scores are sums of whole millionths, which no order of addition changes.
UNIT = 1_000_000


def host_path(url: Column) -> tuple[Column, Column]:
    """host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path) and its verdict; nulls where none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        name, verdict = F.when(fits, own + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def tokens(column: Column) -> Column:
    """Runs of a-z."""
    return F.filter(F.split(F.lower(column), "[^a-z]+"), lambda w: w != "")


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n over all html; words that no label of a host can hold are left out."""
    found = pages.select(F.explode(tokens(F.coalesce("html", F.lit("")))).alias("word")).where(F.length("word") <= LABEL)
    return found.groupBy("word").agg(F.count("*").alias("n"))


def viterbi(piece: str, known: dict[tuple[int, int], float], total: float, longest: int = LABEL) -> list[str]:
    """The likeliest split of piece; known: log probability by start and length; a stranger of k letters has 10 / (total x 10^k).

    Words have up to longest letters, which only matters to pieces that are longer than a label of a host may be.
    """
    best, back = [0.0] + [-np.inf] * len(piece), [0] * (len(piece) + 1)
    for end in range(1, len(piece) + 1):
        for start in range(max(0, end - longest), end):
            size = end - start
            p = best[start] + known.get((start, size), np.log(10 / total) - size * np.log(10))
            if p > best[end]:
                best[end], back[end] = p, start
    out, end = [], len(piece)
    while end:
        out.append(piece[back[end] : end])
        end = back[end]
    return out[::-1]


def segment(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """piece, words: each distinct piece (a column of letters) split by the unigram model of counts (word, n)."""
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    own = pieces.select("piece").distinct()
    cut = own.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("start"))
    cut = cut.select("piece", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LABEL), F.length("piece") - F.col("start") + 1))).alias("size"))
    cut = cut.withColumn("word", F.col("piece").substr(F.col("start"), F.col("size")))
    found = cut.join(counts, "word").groupBy("piece").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))  # at most LABEL a letter
    rows = own.join(found, "piece", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [viterbi(r["piece"], {(k["start"] - 1, k["size"]): np.log(k["n"] / total) for k in r["known"] or []}, total) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(split, pa.list_(pa.string()))], ["piece", "words"])

    return rows.mapInArrow(run, "piece string, words array<string>")


def bayes(counts: DataFrame, allowed: int, blocked: int) -> tuple[DataFrame, int]:
    """word, weight (log odds of block, in UNITs) of counts (word, allow, block), and the prior's; allowed, blocked: urls of each class."""
    sums = counts.agg(F.sum("allow"), F.sum("block"), F.count("*")).first()
    in_allow, in_block, words = (int(x or 0) for x in sums)
    share = lambda n, of: (F.col(n) + 1) / F.lit(float(of + words))
    weight = F.round(F.log(share("block", in_block) / share("allow", in_allow)) * UNIT).cast("long")
    return counts.select("word", weight.alias("weight")), round(float(np.log((blocked + 1) / (allowed + 1))) * UNIT)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score per row of pages; score: the log odds of block by the Bayes model.

    A null url, or one without ://, has an empty host and path; no rule fits those, and their score is the
    prior's. Null html has no words. Words that no url under a rule has don't weigh. Without urls under a rule all
    scores are 0, and the verdict is allow, as in any tie. Repeated rows come back one for one, and count as often in
    the model. Hosts and paths of any length are taken whole. Extra columns are ignored; an empty table gives an empty result.
    """
    host, path = host_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "verdict": verdict, "words": F.array_join(tokens(F.col("path")), " ")})
    classes = [F.count_if(F.col("verdict") == c).alias(c) for c in ("allow", "block")]
    hosts, paths = (table(rows.groupBy(c).agg(*classes), f"url-{c}") for c in ("host", "words"))
    pieces = hosts.select("host", F.explode(tokens(F.col("host"))).alias("piece"))
    split = segment(pieces, table(word_counts(pages), "words"))
    of_host = table(pieces.join(split, "piece").select("host", F.explode("words").alias("word")), "host-words")
    of_path = paths.select("words", F.explode(F.split("words", " ")).alias("word")).where("word <> ''")

    found = of_host.join(hosts, "host").select("word", "allow", "block").unionByName(of_path.join(paths, "words").select("word", "allow", "block"))
    counts = table(found.groupBy("word").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).where("allow + block > 0"), "url-words")
    allowed, blocked = (int(x or 0) for x in hosts.agg(F.sum("allow"), F.sum("block")).first())
    weights, prior = bayes(counts, allowed, blocked)
    by_host = of_host.join(weights, "word").groupBy("host").agg(F.sum("weight").alias("host_weight"))
    by_path = of_path.join(weights, "word").groupBy("words").agg(F.sum("weight").alias("path_weight"))
    scored = rows.join(by_host, "host", "left").join(by_path, "words", "left")
    scored = scored.withColumn("score", (F.lit(prior) + F.coalesce("host_weight", F.lit(0)) + F.coalesce("path_weight", F.lit(0))) / UNIT)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
