"""States of a table that are published whole or not at all.

A state's files are written to a folder of their own, then a manifest that lists them with their lengths and SHA-256 digests
is written beside and renamed to its number: the rename publishes. A reader takes the largest number whose files are
all there in their lengths, which it learns from listings alone; data without a manifest is never read.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Versions:
    """The states of one table, numbered from 1, in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._disk = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> dict[str, int]:
        """Names and lengths of what a folder holds; nothing if it isn't there."""
        path = self._path(folder)
        if not self._disk.exists(path):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self._disk.listStatus(path)}

    def numbers(self) -> list[int]:
        """The published states, the newest first. Reads no data."""
        return sorted((int(n.removesuffix(".json")) for n in self._names(f"{self.folder}/manifests") if n.removesuffix(".json").isdigit()), reverse=True)

    def manifest(self, number: int) -> dict:
        rows = self.spark.read.text(f"{self.folder}/manifests/{number}.json", wholetext=True).collect()
        return json.loads(rows[0].value)

    def whole(self, number: int) -> bool:
        """Whether the state's files are there in the lengths that its manifest says."""
        try:
            said = self.manifest(number)
        except (ValueError, IndexError):
            return False
        there = self._names(f"{self.folder}/data/{said['data']}")
        return all(there.get(f["name"]) == f["length"] for f in said["files"])

    def _digests(self, data: str) -> list[dict]:
        """The files of a state with their lengths and digests, each read by a task."""
        names = self._names(f"{self.folder}/data/{data}")
        paths = [f"{self.folder}/data/{data}/{n}" for n in names if n.startswith("part-")]
        if not paths:
            return []
        rows = self.spark.read.format("binaryFile").load(paths)
        found = rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
        return [r.asDict() for r in found.orderBy("name").collect()]  # a row a file

    def publish(self, df: DataFrame) -> int:
        """Writes df as the next state and returns its number. What fails before the rename leaves older states as they were."""
        data = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/data/{data}")
        said = json.dumps({"data": data, "schema": df.schema.json(), "files": self._digests(data)})
        manifests = self._path(f"{self.folder}/manifests")
        self._disk.mkdirs(manifests)
        waiting = self._path(f"{self.folder}/manifests/.{data}")
        stream = self._disk.create(waiting, True)
        try:
            stream.write(bytearray(said.encode()))
        finally:
            stream.close()
        number = (self.numbers() or [0])[0] + 1
        while not self._renamed(waiting, self._path(f"{self.folder}/manifests/{number}.json")):  # another writer was faster
            number += 1
        return number

    def _renamed(self, old, new) -> bool:
        return not self._disk.exists(new) and self._disk.rename(old, new)

    def read(self, number: int) -> DataFrame:
        said = self.manifest(number)
        schema = StructType.fromJson(json.loads(said["schema"]))
        files = [f"{self.folder}/data/{said['data']}/{f['name']}" for f in said["files"]]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def newest(self) -> tuple[int, DataFrame] | None:
        """The newest whole state and its number; None if there is none."""
        for number in self.numbers():
            if self.whole(number):
                return number, self.read(number)
        return None

    def verified(self, number: int) -> bool:
        """Whether the files can be read and hold the bytes that were published; reads them all."""
        if not self.whole(number):
            return False
        said = self.manifest(number)
        try:
            return self._digests(said["data"]) == said["files"]
        except (PySparkException, Py4JJavaError):  # a file system with checksums of its own refuses them
            return False

    def clean(self, keep: int) -> None:
        """Removes all but the `keep` newest whole states, and the data of writes that were never published.

        Not to be called while a state is being written or an older one read.
        """
        kept = [n for n in self.numbers() if self.whole(n)][:keep]
        data = {self.manifest(n)["data"] for n in kept}
        for number in set(self.numbers()) - set(kept):
            self._disk.delete(self._path(f"{self.folder}/manifests/{number}.json"), False)
        for name in self._names(f"{self.folder}/data"):
            if name not in data:
                self._disk.delete(self._path(f"{self.folder}/data/{name}"), True)

    def damage(self, number: int) -> None:
        """For tests of what reads states: takes one of the state's files away, as a torn copy would lack it."""
        said = self.manifest(number)
        self._disk.delete(self._path(f"{self.folder}/data/{said['data']}/{said['files'][0]['name']}"), False)
