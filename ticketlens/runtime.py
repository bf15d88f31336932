"""Small helpers every job shares: written intermediate tables, scratch paths, size-checked small tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows a table may have and still be brought to the driver and sent back as a literal table.
SMALL_TABLE_ROWS = 10_000
#: Rows of a table that many passes go over which are worth a task of their own.
TASK_ROWS = 50_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_COLUMN_ROWS = "spark.sql.inMemoryColumnarStorage.batchSize"


def checkpoint_base(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: what the session names in ``spark.checkpoint.dir``.

    Only a local master may go without one and gets an own temporary folder; on a cluster that would be a folder per machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured is None and context.getCheckpointDir() is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="ticketlens-"))
    return configured or context.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from the written copy."""
    checkpoint_base(df.sparkSession)
    return df.checkpoint()


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str = "table", codec: str | None = None, by: str | None = None, folders: int = 0) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and go on from the written copy.

    Unlike a checkpoint it keeps columns apart, so later reads are pruned. The shuffle files behind it go when it is written.
    ``codec`` is the compression of the files; without it the session's. ``by`` names a column with at most ``folders`` values
    that get a folder each; as many files are open at a time, so that rows need no sort.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, **{_CLEANUP: "true"} | ({_WRITERS: str(folders + 1)} if by else {})):
        df.write.parquet(path, partitionBy=by, compression=codec)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def in_memory(df: DataFrame):
    """``df`` kept in memory inside the block, without disk: what doesn't fit is read anew each time."""
    with settings(df.sparkSession, **{_COLUMN_ROWS: "256"}):  # rows may be wide
        df.persist(StorageLevel(False, True, False, True))
        try:
            yield df
        finally:
            df.unpersist()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; no two calls return the same one."""
    return f"{checkpoint_base(spark).rstrip('/')}/ticketlens/{uuid.uuid4().hex}/{name}"


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """Rows as a literal table: Catalyst knows its exact size and ships it with the plan."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow_schema = to_arrow_schema(schema)
    table = pa.table(
        [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow_schema)],
        schema=arrow_schema,
    )
    return spark.createDataFrame(table, schema=schema)


def small_rows(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> list | None:
    """The rows of ``df`` if there are at most ``limit``, else None; never fetches more than that."""
    rows = df.take(limit + 1)
    return rows if len(rows) <= limit else None


def bounded(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> DataFrame:
    """``df`` as a literal table with a broadcast hint if it has at most ``limit`` rows, else unchanged."""
    rows = small_rows(df, limit)
    return df if rows is None else F.broadcast(local_table(df.sparkSession, rows, df.schema))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python functions of it can run there."""
    context = spark.sparkContext
    if getattr(context, "_ticketlens_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ticketlens-code-")) / "ticketlens_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(archive))
    context._ticketlens_shipped = True


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan of few files a task per core before costly work per row; a scan that has them stays as it is.

    Only for plain scans: asking a plan with shuffles for its partitions would run it.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df


def _tasks(df: DataFrame, rows: int) -> int:
    """How many tasks of about ``rows`` rows the table is worth, at most three per core; 0 if it has a task per core or as many already."""
    cores, now = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if now >= cores:
        return 0
    wanted = min(-(-df.count() // rows), 3 * cores)
    return wanted if now < wanted else 0


def evened(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """A pinned table in tasks of about ``rows`` rows, at most three per core; one that has as many, or a task per core, stays as it is.

    For tables that many passes go over: stored in fewer partitions than there are cores, each pass would leave cores idle.
    """
    wanted = _tasks(df, rows)
    return pinned(df.repartition(wanted)) if wanted else df


def dealt(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """The same for a scan at the start of a job: it is written as Parquet if it has too few tasks, while its rows are still narrow.

    For plain scans: a plan with shuffles is run for its partitions.
    """
    wanted = _tasks(df, rows)
    return written(df.repartition(wanted), "dealt") if wanted else df
