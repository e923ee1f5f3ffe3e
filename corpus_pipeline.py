"""The corpus pipeline: toxicity, exact dedup, near-dedup, benchmark decontamination, packing.

run() writes each stage's documents to the folder that the cluster shares and reads them again, so that a stage
starts from what its predecessor kept and a lost executor costs no earlier stage. A null text counts as
empty; rows with a null doc_id are kept unless their text is rejected or repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.llm import decontaminate, exact_dedup, near_copies, packing, toxicity
from pagewatch.llm.queries import vocabulary
from pagewatch.llm.shared import read, scratch, table, unused, written

#: No stage but exact dedup can be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier than not to have a severity grade over 0 go. Labels are of all documents; null texts stay, as empty ones do."""
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows repeated with it, one. Null texts are equal to empty ones."""
    rows = table(exact_dedup.dedup(docs), "copies")
    digest, keep, n = unused(docs, "digest", "keep_id", "n")
    kept = rows.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(F.col("digest").alias(digest), F.col("doc_id").alias(keep)).agg(F.count("*").alias(n))
    kept = table(kept, "kept")
    own = F.unhex(F.sha2(F.encode(F.coalesce(docs["text"], F.lit("")), "utf-8"), 256))
    found = docs.join(kept, (own == F.col(digest)) & docs["doc_id"].cast("long").eqNullSafe(F.col(keep)))
    once = found.where(F.col(n) == 1).select(docs.columns)
    if kept.where(F.col(n) > 1).isEmpty():
        return once
    return once.unionByName(found.where(F.col(n) > 1).dropDuplicates([digest]).select(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the rows with the smallest doc_id and its text stay; texts without words are one group."""
    own, text = unused(docs, "doc_id_gone", "node_gone")
    gone = near_copies.near_copies(docs).where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(own), F.col("node").alias(text)).distinct()
    gone = table(gone, "near-copies-gone")
    same = (near_copies.node_of(docs["text"]) == F.col(text)) & docs["doc_id"].cast("long").eqNullSafe(F.col(own))
    return docs.join(gone, same, "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go. Null texts have no words and stay; without items all stay."""
    return decontaminate.keep_uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most packing.LIMIT tokens; each row of docs, whatever its doc_id and text, has one at least."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as gone:
            docs, path = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
            gone += [before] if before else []
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
