"""Stored tables in Spark's own buckets: merges move the incoming rows to the stored ones.

A table of Spark's catalog is clustered by its key, and incoming rows are sent to the same number of buckets, so the joins of
operators.merge need no exchange on the stored side. A merge writes its rows where they are read, to a new folder, and then
points the table at it, which is one change of the catalog: readers see the old rows or the new ones. The folder before the last
stays for readers that have begun. Merges of one table are not for two runs at a time, as the later one would win.

Each merge still reads and writes the whole table. What it saves is the shuffle of the stored rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class BucketedTable:
    """name: in the catalog; path: the folder of its versions; buckets: fixed when the table is made."""

    spark: SparkSession
    name: str
    key: str
    path: str
    buckets: int = 16

    def create(self, schema: T.StructType) -> None:
        """Make the table if the catalog doesn't have it."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self._version()}'")

    def _version(self) -> str:
        return f"{self.path.rstrip('/')}/v-{uuid.uuid4().hex}"

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def placed(self, incoming: DataFrame) -> DataFrame:
        """Incoming rows where the stored rows of their keys are. Rows should be folded by key before, as a key is one bucket's."""
        return incoming.repartition(self.buckets, self.key)

    def merge(self, incoming: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the rows by what change makes of the stored and the incoming ones."""
        stored = self.read()
        made, version = f"{self.name}_{uuid.uuid4().hex}", self._version()
        rows = change(stored, self.placed(incoming)).select(stored.columns)
        rows.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", version).saveAsTable(made)
        self.spark.sql(f"ALTER TABLE {self.name} SET LOCATION '{version}'")
        self.spark.sql(f"DROP TABLE {made}")  # its files stay, as the place is given
        self.spark.catalog.refreshTable(self.name)
        self._forget(version)

    def _forget(self, *kept: str) -> None:
        """Delete all versions but the newest two."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = sorted((x for x in files.listStatus(place) if x.getPath().getName().startswith("v-")), key=lambda x: x.getModificationTime())
        for x in found[:-2]:
            if x.getPath().getName() not in {k.rsplit("/", 1)[1] for k in kept}:
                files.delete(x.getPath(), True)
