"""What the operators of this subpackage share: tables, words, and tables written in the cluster's shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts is a run of anything but a space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the identifier as text, by modulus; a null identifier counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def plain_words(text: str | None) -> list[bytes]:
    """Words as UTF-8, with A-Z lower-cased; bytes.lower and bytes.split know ASCII only, as the contracts ask."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: What clears a worker's caches; modules that keep something between tasks enter it here.
CACHES: list = []


def release(caches: bool = True) -> None:
    """Give back what earlier tasks of this Python worker left: workers live on from operator to operator."""
    import ctypes
    import gc

    import pyarrow as pa

    if caches:
        for clear in CACHES:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def tidy(task, caches: bool = True):
    """A task over Arrow batches that begins without earlier operators' caches and ends without its own leavings."""

    def run(batches):
        release(caches)
        yield from task(batches)
        release(False)

    return run


#: Rows of an Arrow batch: texts may be long, and both sides hold whole batches outside the JVM's heap.
BATCH = "500"


def small_batches(spark: SparkSession) -> None:
    """Fewer rows to a batch, unless the session has chosen a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


class Workspace:
    """Tables in a folder of their own below spark.checkpoint.dir, which driver and executors share.

    A table there cuts lineage and outlives a lost executor. Leaving the block deletes what ``result`` or ``keep`` did not name.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        jvm = spark._jvm
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            at = spark.sparkContext.getCheckpointDir()
            at = at.rsplit("/", 1)[0] if at else None
        if not at:  # a session in one process, as in tests: nobody named a shared folder
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            at = "file:///tmp/textloom-checkpoints"
            spark.conf.set("spark.checkpoint.dir", at)
        self.root = f"{at.rstrip('/')}/textloom-{name}-{uuid.uuid4().hex}"
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._names: list[str] = []
        self._kept: set[str] = set()
        self._tables: list[str] = []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        for name in self._tables:
            self.spark.sql(f"drop table if exists {name}")
        for name in self._names:
            if name not in self._kept:
                self.drop(name)
        if not self._kept:
            self._fs.delete(self._path(self.root), True)

    def path(self, name: str) -> str:
        if name not in self._names:
            self._names.append(name)
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def save_by(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Like ``save``, in buckets by a key: joins on the key read it without moving it."""
        entry = f"textloom_{re.sub('[^a-z0-9]', '_', name)}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).sortBy(key).option("path", self.path(entry)).format("parquet").saveAsTable(entry)
        self._tables.append(entry)
        return self.spark.table(entry)

    def settle(self) -> None:
        """Let the driver forget what has been written, so that executors delete the shuffle files behind it.

        The first collection frees what Python held, the second what that held in turn; executors are told in the background.
        """
        import gc
        import time

        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(1)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def keep(self, name: str) -> None:
        self._kept.add(name)

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Write what the operator returns, so that all else can go."""
        out = self.save(df, name)
        self.keep(name)
        return out


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for so many rows, not under the session's own number: tasks keep their size when the input grows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // per_task))
