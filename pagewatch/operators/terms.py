"""Term statistics (A1-A5, J5, T1, T2, P16, P17). Tokens: host, page, word (one row an occurrence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewatch.functions.names import unused
from pagewatch.functions.text import every_word, is_counted


def tokens(docs: DataFrame, page: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Null texts have no words. Words that don't count go after the explode, where the filter is compiled."""
    rows = docs.select(F.col(host).alias("host"), F.col(page).alias("page"), F.explode(every_word(F.col(text))).alias("word"))
    return rows.where(is_counted(F.col("word")))


def counts(rows: DataFrame) -> DataFrame:
    """host, page, word, n."""
    return rows.groupBy("host", "page", "word").agg(F.count("*").alias("n"))


def term_frequency(counted: DataFrame) -> DataFrame:
    """A1: host, page, word, tf."""
    total = F.sum("n").over(Window.partitionBy("host", "page"))
    return counted.select("host", "page", "word", (F.col("n") / total).alias("tf"))


def document_frequency(counted: DataFrame) -> DataFrame:
    """A2: host, word, df."""
    return counted.groupBy("host", "word").agg(F.count("*").alias("df"))


def page_counts(counted: DataFrame) -> DataFrame:
    """host, n_pages: pages that have words."""
    return counted.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))


def text_counts(docs: DataFrame, page: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """page_counts() from texts: a search that ends at the first word that counts, as tokens() has it."""
    found = docs.where(F.lower(F.col(text)).rlike(r"[\p{L}\p{N}&&[^0-9a-z]]|[a-z][\p{L}\p{N}]|[\p{L}\p{N}][a-z]"))
    return found.select(F.col(host).alias("host"), F.col(page).alias("page")).distinct().groupBy("host").agg(F.count("*").alias("n_pages"))


def merge_frequencies(*parts: DataFrame) -> DataFrame:
    """A3."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("host", "word").agg(F.sum("df").alias("df"))


def inverse_frequency(df: DataFrame, pages: DataFrame) -> DataFrame:
    """A4: host, word, idf = ln(n_pages / df) + 1."""
    return df.join(pages, "host").select("host", "word", (F.log(F.col("n_pages") / F.col("df")) + 1).alias("idf"))


def frequent_words(df: DataFrame, most: int = 100) -> DataFrame:
    """Host, word, df, rank by df, ties by word."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("df"), "word"))
    return df.withColumn("rank", rank).where(F.col("rank") <= most)


def word_overlap(counted: DataFrame, frequent: DataFrame) -> DataFrame:
    """Page, known, other: how many of a page's words are among its host's frequent ones (host, word), and how many aren't."""
    known = frequent.select("host", "word", F.lit(1).alias("is_known"))
    out = counted.join(known, ["host", "word"], "left").groupBy("page").agg(F.count("is_known").alias("known"), F.count("*").alias("every"))
    return out.select("page", "known", (F.col("every") - F.col("known")).alias("other"))


def lacks_frequent(known: Column, is_new: Column, least: int = 6) -> Column:
    """A new page that has fewer than `least` of its host's frequent words."""
    return (known < least) & is_new


def contenders(counted: DataFrame, has_default: Column, most: int = 10) -> DataFrame:
    """Those of counts() that can be among a page's `most` top_terms(); the others' idf need not be known. Each page keeps some.

    has_default: words that have no idf, and so the default, which no idf is over. What is rarer than `most` of these comes
    after them, unless the scores are as near as their rounding, for which 2e-6 of the page's words are allowed.
    """
    page, low, place = Window.partitionBy("host", "page"), *unused(counted, "default_n", "default_place")
    placed = counted.withColumn(low, F.when(has_default, F.col("n")).otherwise(0)).withColumn(place, F.row_number().over(page.orderBy(F.desc(low))))
    least = F.coalesce(F.max(F.when(F.col(place) == most, F.col(low))).over(page), F.lit(0))
    total = F.sum("n").over(page)
    return placed.withColumns({low: least, place: total}).where(F.col("n") + 2e-6 * F.col(place) >= F.col(low)).withColumnRenamed(place, "total").drop(low)


def top_terms(tf: DataFrame, idf: DataFrame, pages: DataFrame, most: int = 10) -> DataFrame:
    """Host, page, word, tfidf, rank; a word without idf has its host's default, ln(n_pages) + 1."""
    scored = tf.join(idf, ["host", "word"], "left").join(pages, "host")
    score = F.round(F.col("tf") * F.coalesce("idf", F.log("n_pages") + 1), 6)
    scored = scored.select("host", "page", "word", score.alias("tfidf"))
    rank = F.row_number().over(Window.partitionBy("host", "page").orderBy(F.desc("tfidf"), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def symmetric_difference(a: Column, b: Column) -> Column:
    """U4."""
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def words_changed(top: Column, before: Column) -> Column:
    """P16."""
    return F.size(symmetric_difference(top, before)) > 0.8 * (F.size(top) + F.size(before))
