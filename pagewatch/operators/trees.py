"""Stored decision trees over script features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that name a row or its kind, or that the eighteen features leave out.
NAMES = ("doc_id", "path", "kind", "label", "said", "src_len", "visible_len")


def _features(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in NAMES]


def train(rows: DataFrame, label: str, folder: str, depth: int = 3, seed: int = 1) -> None:
    """A tree on all other columns, stored in the folder with its kinds; ties between splits go by the columns' order."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    assembler = VectorAssembler(inputCols=[c for c in _features(rows) if c != label], outputCol="_x")
    tree = DecisionTreeClassifier(featuresCol="_x", labelCol="_label", predictionCol="_said", maxDepth=depth, seed=seed)
    back = IndexToString(inputCol="_said", outputCol="said", labels=indexer.labels)
    model = Pipeline(stages=[assembler, tree]).fit(indexer.transform(rows))
    Pipeline(stages=[*model.stages, back]).fit(rows).write().overwrite().save(folder)


def classified(rows: DataFrame, folder: str) -> DataFrame:
    """Rows and said, by the stored tree; a text of no length is NORMAL."""
    from pyspark.ml import PipelineModel

    out = PipelineModel.load(folder).transform(rows).drop("_x", "_said", "rawPrediction", "probability")
    return out.withColumn("said", F.when(F.col("src_len") == 0, "NORMAL").otherwise(F.col("said")))
