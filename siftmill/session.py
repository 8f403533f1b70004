"""Session helpers: table loading, materialised intermediates, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most this many rows; the operators that call
#: ``small`` have rows of a few dozen bytes, so that a broadcast stays within a few MB.
BROADCAST_ROWS = 30_000
#: Spark's setting for deleting a query's shuffle files at its end.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []
#: What ``materialise_only`` has written so far, where it runs.
_within: ContextVar[list[str] | None] = ContextVar("_within", default=None)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediates: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a local session gets a temporary folder; any other session raises an error, as
    no folder is known that all its machines share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siftmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str = "") -> str:
    """A new path in the shared folder, deleted when the session ends or by ``discard``."""
    path = f"{shared_dir(spark)}/siftmill/{name and name + '-'}{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    if (own := _within.get()) is not None:
        own.append(path)
    return path


def materialise(df: DataFrame, *, by: str | None = None) -> DataFrame:
    """Writes ``df`` once as parquet in the shared folder and returns the table read back.

    This cuts the lineage, survives the loss of executors and gives the planner true sizes. ``by`` names a column
    whose values get folders of their own, so that a filter on it reads only these. The files go when the session
    ends, or earlier through ``discard``; the shuffle files of the write go at its end.
    """
    spark = df.sparkSession
    path = folder(spark)
    out = df.write.option("compression", "zstd")
    with _shuffles_freed(spark):
        (out.partitionBy(by) if by else out).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._siftmill_path = path
    return back


def materialise_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """As ``materialise`` for the rows of all ``parts``, of one schema, which are written one after the other.

    Only one part's shuffle files are on disk at a time. A generator goes on when its part is written.
    """
    path = ""
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or folder(spark)
        with _shuffles_freed(spark):
            append(df, path)
    back = spark.read.schema(schema).parquet(path)
    back._siftmill_path = path
    return back


def materialise_only(build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, materialised; whatever else was written on the way is deleted."""
    own: list[str] = []
    outer = _within.set(own)
    try:
        out = build()
        out = out if hasattr(out, "_siftmill_path") else materialise(out)
    finally:
        _within.reset(outer)
    for path in own:
        if path != out._siftmill_path:
            _delete(out.sparkSession, path)
    if (around := _within.get()) is not None:
        around.append(out._siftmill_path)
    return out


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Plans that are executed within delete their shuffle files at their end, not when the driver next collects garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def append(df: DataFrame, path: str) -> None:
    """Adds the rows of ``df`` to the parquet table in ``path``."""
    df.write.option("compression", "zstd").mode("append").parquet(path)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def discard(*dfs: DataFrame | None) -> None:
    """Deletes the files of materialised tables that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_siftmill_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: its folder is the cluster's to clear
            return


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count finds at most ``limit`` rows, else unchanged.

    Unmarked sides go through a shuffle join, which adaptive execution splits where a key is skewed. Counting a
    materialised table reads only its footers.
    """
    return F.broadcast(df) if df.count() <= limit else df


def clean_id(column: Column | str) -> Column:
    """An id without the blanks and tabs around it."""
    return F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(" \t"))


def dense_codes(df: DataFrame, *order: Column | str, name: str = "code") -> DataFrame:
    """``df`` materialised with a dense bigint code from 0 in the given order.

    A range-partitioned sort numbers the rows within partitions; the partitions' sizes, one number each, give the
    offsets. No task sees all rows.
    """
    numbered = materialise(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = numbered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    offsets, at = [], 0
    for r in sizes:
        offsets.append((r.p, at))
        at += r.n
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p bigint, _o bigint")
    return (
        numbered.join(F.broadcast(table), part == F.col("_p"), "left")
        .withColumn(name, F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_m", "_p", "_o")
    )
