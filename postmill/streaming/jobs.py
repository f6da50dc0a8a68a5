"""Incremental runs as Structured Streaming: resume, deduplication and patches."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.functions.text import blank
from postmill.operators.relational import patch

T = TypeVar("T")


def read_files(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """A stream of the parquet files that arrive under `path`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def resume(source: DataFrame, out: str, errors: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], text: str = "requirement", key: str = "url") -> StreamingQuery:
    """Process what has arrived since the last run and append to `out`; rows without text go to `errors` as empty_requirement.

    Progress lives in `checkpoint`, so a run that ends early goes on where it stopped. A key that `out` already
    holds is not processed again. Each batch is written to a folder of its own id, so a repeated batch overwrites itself.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        empty = blank(F.col(text))
        df.filter(empty).select(key, F.lit("empty_requirement").alias("error")).write.mode("overwrite").parquet(f"{errors}/batch={batch_id}")
        todo = df.filter(~empty)
        try:
            done = spark.read.parquet(out).filter(F.col("batch") != batch_id).select(key).distinct()
            todo = todo.join(done, key, "left_anti")
        except Exception as e:  # noqa: BLE001 - the first batch has nothing to read
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        rest = [c for c in todo.columns if c != key]
        # one row per key, the same one when the batch is repeated
        one = todo.groupBy(key).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("x")).select(key, "x.*") if rest else todo.distinct()
        process(one).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(source: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; state is kept for `delay` behind the latest time."""
    return source.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(source: DataFrame, time: str, by: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Rows per window and value, late rows up to `delay` included."""
    return source.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", by, "n")


def patch_stream(updates: DataFrame, base_path: str, out_path: str, checkpoint: str, key: str, columns: list[str], time: str) -> StreamingQuery:
    """Write `base_path` patched by all updates so far to `out_path`, a folder per batch; the highest batch is the state.

    A batch patches the output of the one before, the first one `base_path`, so no earlier patch is lost and a repeated batch gives the
    same. Within a batch the update of a key with the greatest `time` counts, of several at once the greatest values.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        before = [b for b in _batches(spark, out_path) if b < batch_id]
        base = spark.read.parquet(f"{out_path}/batch={max(before)}" if before else base_path)
        last = df.groupBy(key).agg(F.max(F.struct(time, *(c for c in columns if c != time))).alias("x")).select(key, *(F.col("x")[c].alias(c) for c in columns))
        patch(base, last, key, columns).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return updates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished batch folders under a path of any file system."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName().removeprefix("batch=")) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """What patch_stream has made of its base so far."""
    return spark.read.parquet(f"{path}/batch={max(_batches(spark, path))}")


def with_retries(call: Callable[[], T], attempts: int = 3, first_wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """The result of `call`, tried up to `attempts` times with waits that double from `first_wait` seconds; the last error is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 == attempts:
                raise
            sleep(first_wait * 2**k)
    raise ValueError("at least one attempt is needed")


def crawl_pending(urls: DataFrame, log: DataFrame, url: str = "url") -> DataFrame:
    """URLs still to be fetched: those the log (url, status) has neither as done nor as gone; failed ones come again."""
    over = log.filter(F.col("status").isin("done", "gone")).select(F.col(url).alias("__u")).distinct()
    return urls.join(over, urls[url] == F.col("__u"), "left_anti")
