"""Session and checkpoint helpers shared by every plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", name: str = "postmill") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table `name` under `base`."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of `df` through a reliable checkpoint.

    The folder is the one the cluster names in spark.checkpoint.dir, see shared_folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one of this process where none is named and the master is local.

    A cluster that names none is an error: other machines don't see this one's folders.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="postmill-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


#: The temporary folder of this process, once it has one.
_own: list[str] = []


def round_checkpointed(df: DataFrame) -> DataFrame:
    """checkpointed() for the tables of a loop, without the size estimate of the plan behind.

    A checkpoint keeps the estimate of the plan it cuts, and a join's estimate is the product of its sides': carried from
    round to round its digits would double each time until planning takes longer than the work.
    """
    spark = df.sparkSession
    cut = checkpointed(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(cut.queryExecution().toRdd(), cut.schema(), False), spark)


def within_broadcast_bound(df: DataFrame, max_rows: int) -> bool:
    """Whether `df` has at most `max_rows` rows; reads at most one row more than that."""
    return len(df.limit(max_rows + 1).take(max_rows + 1)) <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` marked for broadcast where it has at most `max_rows` rows, as it is otherwise."""
    return broadcast(df) if within_broadcast_bound(df, max_rows) else df
