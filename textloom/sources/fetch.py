"""Fetching a table of addresses, politely and without a failed job, and a log that is whole or absent.

Addresses are dealt to streams by host, so that one stream's delay is kept towards a host; a host of very many addresses gets ``streams`` of them.
An address that fails is a row with its error. The log is a data source's sink: tasks write files of their own, and only the commit names
those that count in a manifest, so a task that ran twice or a job that died leaves nothing that a reader sees.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

AGENT = {"User-Agent": "textloom"}
COLUMNS = "kind string, bytes long, sha256 string, body binary, created string, attempts int, seconds double, error string"


def opened(url: str, timeout: float) -> tuple[bytes, str | None]:
    """Body and header date of an address."""
    with urllib.request.urlopen(urllib.request.Request(url, headers=AGENT), timeout=timeout) as r:
        return r.read(), r.headers.get("Last-Modified")


def kind(body: bytes) -> str:
    """By the first bytes, whatever the address says."""
    head = body[:512].lower()
    return "pdf" if body[:4] == b"%PDF" else "docx" if body[:4] == b"PK\3\4" else "html" if b"<html" in head or b"<!doctype" in head else "text"


def fetch(
    urls: DataFrame, url: str = "url", keep: tuple[str, ...] = (), delay: float = 1.5, retries: int = 2, timeout: float = 20, streams: int = 1, parts: int | None = None,
    open_with: Callable[[str, float], tuple[bytes, str | None]] = opened,
) -> DataFrame:
    """``keep``, the address and ``COLUMNS`` for each row of ``urls``: a null or failing address has an error and no body.

    A stream waits ``delay`` seconds between calls to one host, and twice as long before each of ``retries``.
    """
    spark, kinds = urls.sparkSession, dict(urls.dtypes)
    host = F.coalesce(F.regexp_extract(url, "^[a-zA-Z]+:(?://)?([^/,;]*)", 1), F.lit(""))
    dealt = urls.select(*keep, F.col(url).alias("_url"), host.alias("_host")).repartition(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "_host", F.pmod(F.xxhash64("_url"), F.lit(streams)))

    def one(address: str | None, wait: Callable[[], None]) -> dict:
        out, start = {"body": None, "error": None, "created": None}, time.monotonic()
        for attempt in range(1, retries + 2):
            try:
                if address is None:
                    raise ValueError("no address")
                wait()
                out["body"], out["created"] = open_with(address, timeout)
                out["error"] = None
            except Exception as e:  # any fault of an address is told in its row
                out["error"] = f"{type(e).__name__}: {e}"[:200]
            if out["error"] is None or address is None:
                break
            time.sleep(delay * 2**attempt if attempt <= retries else 0)
        body = out["body"]
        told = {} if body is None else {"kind": kind(body), "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest()}
        return {"kind": None, "bytes": None, "sha256": None} | told | out | {"attempts": attempt, "seconds": time.monotonic() - start}

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}

        def wait(h: str) -> None:
            time.sleep(max(0.0, last.get(h, -1e9) + delay - time.monotonic()))
            last[h] = time.monotonic()

        for batch in batches:
            done = pd.DataFrame([one(None if pd.isna(u) else u, lambda h=h: wait(h)) for u, h in zip(batch["_url"], batch["_host"])])
            own = batch[[*keep, "_url"]].reset_index(drop=True)
            yield pd.concat([own, done], axis=1)[[*keep, "_url", *[c.split()[0] for c in COLUMNS.split(", ")]]]

    out = dealt.mapInPandas(task, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "_url string", COLUMNS]))
    return out.withColumnRenamed("_url", "url")


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class LogSink(DataSource):
    """Format ``textloom_log``: Parquet files below option ``path``, of which a manifest for each job names those that count."""

    @classmethod
    def name(cls) -> str:
        return "textloom_log"

    def writer(self, schema, overwrite: bool):
        return _LogWriter(self.options["path"], schema)


class _LogWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex
        self.schema = schema.json()

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator) -> Written:
        import pyarrow.parquet as pq

        at, base = self._at()
        at.create_dir(base, recursive=True)
        name, rows, out = f"{self.job}-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            out = out or pq.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=at)
            out.write_batch(batch)
            rows += batch.num_rows
        if out:
            out.close()
        return Written(name if rows else "", rows)

    def _put(self, name: str, told: dict) -> None:
        at, base = self._at()
        at.create_dir(base, recursive=True)
        with at.open_output_stream(f"{base}/{name}.tmp") as f:
            f.write(json.dumps(told).encode())
        at.move(f"{base}/{name}.tmp", f"{base}/{name}")

    def commit(self, messages) -> None:
        done = [m for m in messages if m is not None]
        self._put(f"manifest-{self.job}.json", {"files": [m.file for m in done if m.file], "rows": sum(m.rows for m in done), "schema": json.loads(self.schema), "at": datetime.now().isoformat(timespec="seconds")})

    def abort(self, messages) -> None:
        at, base = self._at()
        for m in messages:
            if m is not None and m.file:
                at.delete_file(f"{base}/{m.file}")


def write_log(df: DataFrame, path: str) -> None:
    """Appends a job's rows to the log below ``path``, all of them or none."""
    df.sparkSession.dataSource.register(LogSink)
    df.write.format("textloom_log").option("path", path).mode("append").save()


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that manifests name; None if no job has committed."""
    from pyspark.sql.types import StructType

    told = [json.loads(r["value"]) for r in spark.read.option("wholetext", True).option("pathGlobFilter", "manifest-*.json").text(path).collect()] if _any(spark, path) else []
    files = [f"{path}/{f}" for t in told for f in t["files"]]
    if not told:
        return None
    schema = StructType.fromJson(told[-1]["schema"])
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _any(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*.json")
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))
