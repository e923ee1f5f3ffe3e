"""What the operators share: tables that cut lineage, whole-text columns, session settings."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewatch.sources.folders import shared_folder

#: Texts that a Python worker takes from an Arrow batch at once. Spark bounds the batch's bytes (64 MB by default).
TEXTS_AT_ONCE = 500


#: Folders of the scratches that this thread of the driver is in, outermost first.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())
#: Writes under way in each session, and the setting that holds again after the last.
_writes: dict[str, list] = {}
_lock = threading.Lock()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the folders that are made inside, but those to keep, when it ends; more may be added to its list."""
    made: list[str] = []
    before = _scratch.set((*_scratch.get(), made))
    try:
        yield made
    finally:
        _scratch.reset(before)
        for path in made:
            disk, hadoop = _disk(spark, path)
            disk.delete(hadoop, True)


def _disk(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def new_folder(spark: SparkSession, label: str, keep: bool = False) -> str:
    """An unused path in the shared folder, removed with the scratch that it is made in, or else when the driver's JVM ends.

    keep: it outlives the innermost scratch.
    """
    path = f"{shared_folder(spark)}/pagewatch-{label}-{uuid.uuid4().hex}"
    holders = _scratch.get()
    holders = holders[: len(holders) - keep]
    if holders:
        holders[-1].append(path)
    else:
        disk, hadoop = _disk(spark, path)
        disk.deleteOnExit(hadoop)
    return path


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches have TEXTS_AT_ONCE rows at most; after the last of the writes that run at once the session's setting holds again."""
    name, key = "spark.sql.execution.arrow.maxRecordsPerBatch", spark._jsparkSession.sessionUUID()
    with _lock:
        under_way = _writes.setdefault(key, [0, spark.conf.get(name)])
        under_way[0] += 1
        spark.conf.set(name, str(TEXTS_AT_ONCE))
    try:
        yield
    finally:
        with _lock:
            under_way[0] -= 1
            if not under_way[0]:
                spark.conf.set(name, _writes.pop(key)[1])


def written(df: DataFrame, label: str, keep: bool = False) -> tuple[DataFrame, str]:
    """df, written to the shared folder and read again, and where it is: lineage is cut and the rows survive executors.

    While it is written, Arrow batches are short (see short_batches).
    """
    spark = df.sparkSession
    path = new_folder(spark, label, keep)
    with short_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    return written(df, label, keep)[0]


def few_tasks(df: DataFrame) -> DataFrame:
    """df in a few tasks a core at most, however many files it is read from: for tasks that each give a result of fixed size."""
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and `more` columns; other columns are left out."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *more)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's strings as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of TEXTS_AT_ONCE rows, so that only a few MB of text are Python objects at a time."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in slices(batches):
        yield batch, utf8(batch.column(batch.schema.get_field_index("text")))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each prolonged until no column of docs has it in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
