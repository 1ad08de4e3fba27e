"""Table access, shared storage and column helpers for the operators of this package."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Without one, a local session gets a folder of its own; a cluster fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share; set it before running this operator")
        base = tempfile.mkdtemp(prefix="pressmill-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Tasks hold a row group while they write it.
ROW_GROUP_BYTES = 16 << 20


class Steps:
    """Tables that one operator writes on its way, in one folder of the shared one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{scratch_dir(spark)}/stored-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, tasks: int | None = None, **measures: Column) -> tuple[DataFrame, dict]:
        """df, written and read back, and aggregates of its rows, taken while it is written.

        tasks: so many are enough for what df's last step reads, whatever the number of shuffle partitions. Each file costs
        the process that writes it a fork, where the file system is local.
        """
        path, seen = f"{self.path}/{uuid.uuid4().hex}", Observation()
        columns = [c.alias(k) for k, c in measures.items()]
        df = df if tasks is None else df.coalesce(max(1, tasks))
        writer = (df.observe(seen, *columns) if columns else df).write.option("parquet.block.size", ROW_GROUP_BYTES)
        writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), dict(seen.get) if columns else {}

    def clear(self) -> None:
        """Delete what was written; nothing that is still to be read may come from it."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends here and lost executors don't matter."""
    return Steps(df.sparkSession).store(df, tasks)[0]


#: Rows of ids and numbers that one task handles.
TASK_ROWS = 250_000


def tasks_for(rows: int) -> int:
    """Tasks for so many rows of ids and numbers at most."""
    return 8 + rows // TASK_ROWS


def few_tasks(spark: SparkSession) -> int:
    """Tasks for a table of groups, which is far smaller than what it is made of: a sixteenth of the shuffle partitions."""
    return 8 + int(spark.conf.get("spark.sql.shuffle.partitions")) // 16


#: Names kept for the key of rows; other columns, whatever their names, go through.
ROW_KEY = ("_pressmill_row_file", "_pressmill_row_index")


def _reads_files(docs: DataFrame) -> bool:
    """Whether docs reads files and does no more than choose rows and columns, so that a row of a file occurs once."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().startswith(("LogicalRelation", "Relation"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each row, however ids repeat: the file that it was read from and its place there.

    A frame that isn't just read from files is stored first. Columns of those names are replaced.
    """
    docs = docs.drop(*ROW_KEY)
    if not _reads_files(docs):
        docs = stored(docs)
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(ROW_KEY[0]), F.col("_metadata.row_index").alias(ROW_KEY[1]))


#: Arrow batches are made no larger than this.
BATCH_BYTES = 8 << 20


def tidy(run):
    """run, a function of batches, that gives back its memory when it ends: Python workers live on between tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of bounded bytes, as texts may be long."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name).rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(tidy(run), schema)


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves that remainder; an id that is null belongs to no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of ids that may be broadcast; more of them are joined by shuffle.
BROADCAST_IDS = 250_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it was measured to have few rows (of ids and numbers)."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs, as keyed gives it, without the rows whose keys are among rows."""
    rows, found = Steps(docs.sparkSession).store(rows.select(*ROW_KEY).distinct(), few_tasks(docs.sparkSession), n=F.count(F.lit(1)))
    return docs.join(small(rows, found["n"]), list(ROW_KEY), "left_anti").drop(*ROW_KEY)
