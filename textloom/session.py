"""Sessions, table access and small helpers that every module uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(name: str = "textloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow exchange; ``conf`` adds to that or takes its place."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a dimension is broadcast; a larger one joins by shuffle.
SMALL = 200_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows; counting stops there."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession, rows: int = 200) -> None:
    """Fewer rows to an Arrow batch, where a row may be a file or a page, unless the session has chosen a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def digest_int(*parts: Column | str) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the parts alone: the first 32 bits of their MD5. Serves wherever a choice is 'random'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])), 1, 8), 16, 10).cast("long")


def whole(x: Column) -> Column:
    return x.cast("long")


def ordered_values(pos: Column, value: Column) -> Column:
    """Aggregate: values by ascending position."""
    return F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), value.alias("v")))), lambda x: x["v"])


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a session in one process may do without."""
    import re
    import tempfile

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/textloom"
    return at.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    import uuid

    return f"{shared_root(spark)}/textloom-{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
