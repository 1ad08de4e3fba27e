"""Versioned snapshot tables on any file system that Spark reaches.

A table is a folder of versions and of numbered manifests; the manifest with the largest number names the folders that
hold the table's rows. A write makes a new version and then a new manifest, which is moved into place whole: a reader, or
a run after a stop at any point, sees the old rows or the new ones, and never an empty table.

Tables with a key are kept in buckets of its hash, and a merge reads and rewrites the touched buckets only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ARTICLE_FEEDS, ARTICLES, FEEDS, MESSAGES

TABLES = {"feeds": FEEDS, "articles": ARTICLES, "article_feeds": ARTICLE_FEEDS, "outbox": MESSAGES}
#: Tables that are kept in buckets of a column.
KEYED = {"articles": "article_key", "article_feeds": "article_key"}
#: Manifests that stay, so that readers of older ones can end.
KEPT = 3


class SnapshotStore:
    """buckets: of each keyed table, fixed when it is made; many, so that a small merge rewrites little."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        if not root:
            raise ValueError("The store's address is not configured.")
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [x.getPath().getName() for x in self._files().listStatus(path)] if self._files().exists(path) else []

    def _numbers(self, table: str) -> list[int]:
        return sorted(int(x.removeprefix("manifest-")) for x in self._names(table) if x.startswith("manifest-"))

    def _manifest(self, table: str) -> dict | None:
        """Its number, buckets, and the folder of each bucket that has rows."""
        numbers = self._numbers(table)
        if not numbers:
            return None
        text = self.spark.read.text(self._path(table, f"manifest-{numbers[-1]}").toString(), wholetext=True).first()[0]
        return json.loads(text) | {"number": numbers[-1]}

    def _commit(self, table: str, manifest: dict) -> None:
        """Move a manifest into place under the number after that of the manifest that it was made from. If another writer
        has taken that number since, or a later one, nothing changes and this fails."""
        files, number = self._files(), manifest.get("number", (self._numbers(table) or [0])[-1]) + 1
        temporary, final = self._path(table, f".{uuid.uuid4().hex}"), self._path(table, f"manifest-{number}")
        out = files.create(temporary, True)
        out.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "number"}), "utf-8"))
        out.close()
        taken = any(n >= number for n in self._numbers(table)) or files.exists(final)
        if taken or not files.rename(temporary, final):
            files.delete(temporary, False)
            raise OSError(f"Another run has written {table} meanwhile.")
        for old in self._numbers(table)[:-KEPT]:
            files.delete(self._path(table, f"manifest-{old}"), False)

    def vacuum(self) -> int:
        """Delete the versions that no kept manifest names, and give their number. For times when no run writes."""
        gone = 0
        for table in TABLES:
            named = set()
            for number in self._numbers(table):
                text = self.spark.read.text(self._path(table, f"manifest-{number}").toString(), wholetext=True).first()[0]
                named |= {x.split("/")[0] for x in json.loads(text)["folders"].values()}
            for name in self._names(table):
                if name.startswith("v-") and name not in named:
                    self._files().delete(self._path(table, name), True)
                    gone += 1
        return gone

    def initialise(self) -> None:
        """Make the tables that don't exist yet."""
        for name in TABLES:
            if not self._numbers(name):
                self._commit(name, {"number": 0, "buckets": self.buckets if name in KEYED else 1, "folders": {}})

    def _existing(self, table: str) -> dict:
        manifest = self._manifest(table)
        if manifest is None:
            raise FileNotFoundError(f"{self.root}/{table} has not been initialised.")
        return manifest

    def _bucket(self, table: str, n: int) -> Column:
        return F.pmod(F.xxhash64(KEYED[table]), F.lit(n)).cast("int") if table in KEYED else F.lit(0)

    def read(self, table: str, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        return self._rows(table, self._existing(table), only)

    def _rows(self, table: str, manifest: dict, only: Iterable[int] | None = None) -> DataFrame:
        folders, schema = manifest["folders"], _nullable(TABLES[table])
        paths = [f"{self.root}/{table}/{folder}" for bucket, folder in sorted(folders.items()) if only is None or int(bucket) in set(only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, table: str, rows: DataFrame) -> None:
        """Replace a whole table by rows that aren't made of its own."""
        manifest = self._existing(table)
        self._replace(table, rows, manifest, range(manifest["buckets"]))

    def rewrite(self, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace a whole table by what change makes of its rows; fails if another run writes it meanwhile."""
        manifest = self._existing(table)
        self._replace(table, change(self._rows(table, manifest)), manifest, range(manifest["buckets"]))

    def merge(self, table: str, incoming: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the buckets that the keys of incoming fall in by what change makes of their rows; fails if another run
        writes the table meanwhile."""
        manifest = self._existing(table)
        touched = self._touched(table, incoming, manifest)
        if touched:
            self._replace(table, change(self._rows(table, manifest, touched)), manifest, touched)

    def touched(self, table: str, incoming: DataFrame) -> list[int]:
        """The buckets that the keys of incoming fall in."""
        return self._touched(table, incoming, self._existing(table))

    def _touched(self, table: str, incoming: DataFrame, manifest: dict) -> list[int]:
        return sorted(r[0] for r in incoming.select(self._bucket(table, manifest["buckets"])).distinct().collect())

    def _replace(self, table: str, rows: DataFrame, manifest: dict, touched: Iterable[int]) -> None:
        version = f"v-{uuid.uuid4().hex}"
        rows = rows.select(*(rows[f.name].cast(f.dataType) for f in TABLES[table].fields)).withColumn("bucket", self._bucket(table, manifest["buckets"]))
        # Files of a bucket are made of as many tasks as its size asks for.
        rows.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.root}/{table}/{version}")
        kept = {k: v for k, v in manifest["folders"].items() if int(k) not in set(touched)}
        made = {x.removeprefix("bucket="): f"{version}/{x}" for x in self._names(table, version) if x.startswith("bucket=")}
        self._commit(table, manifest | {"folders": kept | made})


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


#: DDL for engines that take it; columns only, as Spark's file tables know no keys.
def ddl() -> list[str]:
    return [f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema.fields)}) USING parquet" for name, schema in TABLES.items()]
