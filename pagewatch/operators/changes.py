"""Changes against history beyond the hash: states as of a run, likeness of pages, changed lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.functions import text
from pagewatch.functions.names import unused

#: Length of the runs that two signatures must share to be alike at all.
GRAM = 7
#: Signatures of either side that meet at once, and pairs that are scored at once.
BLOCK, PAIRS = 1024, 1 << 16
#: Prefix of the columns that as_of() adds.
BEFORE = "before_"


def as_of(now: DataFrame, history: DataFrame, states: list[str], key: str = "url", date: str = "run_date") -> DataFrame:
    """Rows of now, and of each of `states` before_<state>: what history last held of the key, present and before the row's date.

    Each state is looked up on its own, so that they may come from different runs; null where none was ever present. Of several
    values of one key and date the largest counts. A null key or date has nothing before it. Rows come back one for one.
    Both sides are first brought down to one row a key and date, so a key that has most rows is no task's burden.
    """
    own, day, side = unused(now, "as_of_key", "as_of_date", "as_of_side")
    held = history.where(F.col(key).isNotNull() & F.col(date).isNotNull()).groupBy(F.col(key).alias(own), F.col(date).alias(day)).agg(*(F.max(s).alias(BEFORE + s) for s in states))
    asked = now.where(F.col(key).isNotNull() & F.col(date).isNotNull()).select(F.col(key).alias(own), F.col(date).alias(day)).distinct()
    both = held.withColumn(side, F.lit(1)).unionByName(asked.withColumn(side, F.lit(0)), allowMissingColumns=True)
    earlier = Window.partitionBy(own).orderBy(day, side).rowsBetween(Window.unboundedPreceding, -1)
    last = both.select(own, day, side, *(F.last(BEFORE + s, ignorenulls=True).over(earlier).alias(BEFORE + s) for s in states)).where(F.col(side) == 0).drop(side)
    return now.join(last, (now[key] == last[own]) & (now[date] == last[day]), "left").drop(own, day)


def status(now: Column, before: Column) -> Column:
    """error (nothing now), new (nothing before), same or changed."""
    return F.when(now.isNull(), "error").when(before.isNull(), "new").when(now == before, "same").otherwise("changed")


def placed_runs(signature: Column) -> Column:
    """The distinct (size, run, prior) of a fuzzy hash: every run of GRAM with the block size of its piece and the character before it ('' at a start)."""
    parts = F.split(signature, ":")
    size = F.get(parts, F.lit(0)).cast("long")

    def runs(piece: Column, of: Column) -> Column:
        at = F.when(F.length(piece) >= GRAM, F.sequence(F.lit(1), F.length(piece) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
        prior = lambda i: F.when(i > 1, F.substring(piece, i - 1, F.lit(1))).otherwise("")
        return F.transform(at, lambda i: F.struct(of.alias("size"), F.substring(piece, i, F.lit(GRAM)).alias("run"), prior(i).alias("prior")))

    return F.array_distinct(F.concat(runs(F.get(parts, F.lit(1)), size), runs(F.get(parts, F.lit(2)), 2 * size)))


def signature_parts(signature: Column) -> Column:
    """The (block size, run of GRAM) of a fuzzy hash: those of its first part at its block size, of its second at the double."""
    return F.array_distinct(F.transform(placed_runs(signature), lambda x: F.struct(x["size"].alias("size"), x["run"].alias("run"))))


def _meetings(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows size, run, i, j, prior, side, signature, piece: signatures that share a run meet in a block (size, run, i, j) of some BLOCK rows of either side.

    Of a substring that two pieces share the first run is enough, before which they differ or one starts. Runs that have the same
    character before them everywhere are therefore left out, before the signatures themselves are sent.
    """
    runs = lambda rows, side: rows.select(F.xxhash64("signature").alias("id"), F.lit(side).alias("side"), F.explode(placed_runs(F.col("signature"))).alias("r")).select("id", "side", "r.size", "r.run", "r.prior")
    of_run = Window.partitionBy("size", "run")
    seen = runs(now, 0).unionByName(runs(before, 1)).withColumns({"n_now": F.sum(1 - F.col("side")).over(of_run), "n_before": F.sum("side").over(of_run), "low": F.min("prior").over(of_run), "high": F.max("prior").over(of_run)})
    kept = seen.where("n_now > 0 AND n_before > 0 AND (low = '' OR low <> high)").drop("low", "high")
    named = now.withColumn("side", F.lit(0)).unionByName(before.withColumn("side", F.lit(1))).withColumn("id", F.xxhash64("signature"))
    parts = F.split("signature", ":")
    piece = F.get(parts, F.when(F.get(parts, F.lit(0)).cast("long") == F.col("size"), 1).otherwise(2))
    # merge: an exploded side is far larger than it is estimated; contains: should two signatures have one id
    found = kept.join(named.hint("merge"), ["id", "side"]).drop("id").withColumn("piece", piece).where(F.contains("piece", "run"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    own = F.pmod(F.xxhash64("signature", F.lit(1)), F.when(F.col("side") == 0, blocks("n_now")).otherwise(blocks("n_before"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), (F.when(F.col("side") == 0, blocks("n_before")).otherwise(blocks("n_now")) - 1).cast("int")))
    dealt = found.withColumn("own", own).withColumn("other", others)
    place = [F.when(F.col("side") == side, F.col("own")).otherwise(F.col("other")).alias(name) for side, name in ((0, "i"), (1, "j"))]
    return dealt.select("size", "run", *place, "side", "prior", "signature", "piece")


def _scored(least: int):
    """For sorted _meetings(): the pairs of a block with a score of `least` or more at its size."""

    def score(rows: pd.DataFrame):
        block = rows[["size", "run", "i", "j"]]
        number = (block != block.shift()).any(axis=1).cumsum().to_numpy() - 1
        side, signature = rows["side"].to_numpy(), rows["signature"].to_numpy()
        prior, is_first = pd.factorize(rows["prior"])[0], (rows["prior"] == "").to_numpy()
        pieces, size = text.Pieces(rows["piece"].tolist()), rows["size"].to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        first, last = np.searchsorted(number[b], number[a], "left"), np.searchsorted(number[b], number[a], "right")
        chunk = np.cumsum(last - first) // PAIRS
        for some in np.split(np.arange(len(a)), np.flatnonzero(np.diff(chunk)) + 1):
            n = last[some] - first[some]
            x = np.repeat(a[some], n)
            y = b[np.arange(len(x)) + np.repeat(first[some] - (np.cumsum(n) - n), n)] if len(x) else x
            here = (prior[x] != prior[y]) | is_first[x]
            x, y = x[here], y[here]
            found = pieces.scores(x, y, size[x], least)
            here = found >= least
            yield pd.DataFrame({"signature": signature[x[here]], "before_signature": signature[y[here]], "score": found[here].astype("int32")})

    def scored(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            block = rows[["size", "run", "i", "j"]]
            begins = np.flatnonzero((block != block.shift()).any(axis=1))
            cut = int(begins[-1]) if len(begins) else 0
            held = rows.iloc[cut:].reset_index(drop=True)
            yield from score(rows.iloc[:cut])
        if held is not None:
            yield from score(held)

    return scored


def alike(now: DataFrame, before: DataFrame, least: int = 1) -> DataFrame:
    """signature, before_signature, score of all pairs with a score of `least` or more, which is over 0.

    now, before: a column `signature`; null ones have no pairs. Equal signatures are one, whatever number of pages has them. Only pairs
    that share a run at the same block size, or are equal, have a score; each is scored where it meets, so that only results are sent on.
    """
    once = lambda rows: rows.select("signature").where("signature is not null").distinct()
    a, b = once(now), once(before)
    block = ["size", "run", "i", "j"]
    tasks = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _meetings(a, b).repartition(tasks, *block).sortWithinPartitions(*block)
    shared = met.mapInPandas(_scored(least), "signature string, before_signature string, score int")
    equal = a.join(b.hint("merge"), "signature").select("signature", F.col("signature").alias("before_signature"), F.lit(100).alias("score"))
    return shared.unionByName(equal).where(F.col("score") >= least).groupBy("signature", "before_signature").agg(F.max("score").alias("score"))


def changed_lines(rows: DataFrame, now: str, before: str) -> DataFrame:
    """rows whose text was there before and is another, with both lengths and the changes of its lines."""
    diff = text.line_diff(F.col(before), F.col(now))
    found = rows.where(F.col(now).isNotNull() & F.col(before).isNotNull() & (F.col(now) != F.col(before)))
    return found.withColumns({"old_length": F.length(before), "new_length": F.length(now), "changes": diff})
