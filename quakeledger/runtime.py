"""Session-level helpers shared by all operators: tables, checkpoints, bounded fetches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: what the cluster set, else, in local runs only, a temporary one; elsewhere an error."""
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quakeledger-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    got = df.checkpoint(eager=True)
    if (folders := _passing.get()) is not None:
        folders.append(got._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return got


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt to all cores by its columns. For rows that are few and small but dear to work on: left to itself Spark

    would put them into one task.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartition(n, *columns)


_written: list[tuple] = []
#: Folders made inside passing(); threads need a copy of the caller's context to add theirs.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove_written() -> None:
    for spark, folder in _written:
        try:
            _remove(spark, folder)
        except Exception:  # the session has ended before
            return


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Checkpoints and written tables made inside are removed at the end, and each job's shuffle files with the job.

    For parts of a large job whose results are written outside; nothing made inside may be read afterwards.
    """
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    folders: list[str] = []
    token = _passing.set(folders)
    try:
        yield
    finally:
        _passing.reset(token)
        spark.conf.unset(_SHUFFLE_CLEANUP) if before is None else spark.conf.set(_SHUFFLE_CLEANUP, before)
        for folder in folders:
            _remove(spark, folder)
        _written[:] = [x for x in _written if x[1] not in set(folders)]


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage like a checkpoint, and readers get only their columns.

    The table is removed when the program ends.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    if not _written:
        atexit.register(_remove_written)
    _written.append((df.sparkSession, folder))
    if (folders := _passing.get()) is not None:
        folders.append(folder)
    return df.sparkSession.read.parquet(folder)


def fetch_bounded(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that must be small; raises instead of flooding the driver when it is not."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows and can't be held on the driver")
    return rows


def present(column):
    """A double column with NaN and infinities read as missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)
