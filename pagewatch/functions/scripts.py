"""Obfuscation features of scripts and the published verdict tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewatch.functions.names import unused


def count_of(text: Column, char_class: str) -> Column:
    """Characters of a class; the others go by whole runs."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))


def longest_line(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, "\n"), F.length))


def counts(text: Column) -> dict[str, Column]:
    """what must be counted in the text."""
    return {
        "src_len": F.length(text), "visible_len": F.length(F.regexp_replace(text, "[ \t\r\n]+", "")), "alphabets": count_of(text, "a-zA-Z"), "numbers": count_of(text, "0-9"),
        "unique_chars": F.regexp_count(text, F.lit("[,;&]")), "unique_words": F.regexp_count(text, F.lit("http|div|:")), "max_line": longest_line(text),
    }


def with_features(rows: DataFrame, text: str) -> DataFrame:
    """rows, two lengths and eighteen features; of nothing, all is blank. The counts are made in one projection, what follows from them in others."""
    several, one = unused(rows, "counts", "c")
    rows = rows.withColumn(several, F.array(F.struct(*(c.alias(n) for n, c in counts(F.col(text)).items()))))
    rows = rows.select("*", F.explode(several).alias(one)).drop(several).select("*", f"{one}.*").drop(one)  # an explode keeps the projections apart
    rows = rows.withColumns({"symbols": F.col("visible_len") - F.col("alphabets") - F.col("numbers"), "blank": F.col("src_len") - F.col("visible_len")})
    out = {}
    for suffix, whole in (("per", "src_len"), ("pew", "visible_len")):
        for name in ("alphabets", "numbers", "symbols", "blank"):
            nothing = F.lit(1.0 if name == "blank" else 0.0)
            out[f"{name}_{suffix}"] = F.round(F.coalesce(F.try_divide(F.col(name).cast("double"), F.col(whole).cast("double")), nothing), 6)
    for name in ("unique_chars", "unique_words"):
        out[f"{name}_per"] = F.round(F.coalesce(F.try_divide(F.col(name).cast("double"), F.col("src_len").cast("double")), F.lit(0.0)), 6)
    return rows.withColumns(out | {"chars_over_words": F.col("unique_chars") > F.col("unique_words")})


def verdict(line: Column, chars: Column, words: Column) -> Column:
    """kind and branch of the tree; a ratio to nothing matches no bound. Null for a null text's features."""
    ratio = F.try_divide(line.cast("double"), chars.cast("double"))
    # fixed values: the published tree's thresholds
    return (
        F.when(line.isNull(), None)
        .when(line < 400, "NORMAL")
        .when((line < 2000) & (ratio < 200), "RANDOM1")
        .when((line < 2000) & (chars < words), "RANDOM2")
        .when(line < 2000, "ENCODE5")
        .when(ratio < 10, "ENCODE6")
        .when(ratio < 95, "RANDOM3")
        .when(chars > words, "ENCODE7")
        .otherwise("RANDOM4")
    )


def spread(rows: DataFrame, kind: str, feature: str) -> DataFrame:
    """Of each kind the number of rows, and a feature's least, greatest, mean and standard deviation."""
    x = F.col(feature)
    return rows.groupBy(kind).agg(F.count("*").alias("n"), *(F.round(f(x), 6).alias(n) for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg), ("spread", F.stddev_pop))))
