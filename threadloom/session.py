"""Session set-up and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark. On a cluster, bring your own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("threadloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("THREADLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session (tests, bench) gets a temporary folder when the
    setting is absent; a cluster without it is an error, since a machine-local
    folder would be lost with its machine.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") \
        or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="threadloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, in the session's own folder below the shared one."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def session_dir(spark: SparkSession) -> str:
    """The folder of everything this session writes in between; see :func:`clear_scratch`."""
    return f"{shared_dir(spark).rstrip('/')}/threadloom-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this session has written in between. Results read from it must have been saved before."""
    _remove(spark, session_dir(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Freeze the rows in a written table: survives lost executors, computed once.

    A checkpoint would compute the rows twice and keep the estimated size of
    the plan behind it. In a loop of joins these estimates multiply from round
    to round until the numbers themselves are too long to handle; a table has
    its own size, by which small ones are also joined without a shuffle.
    """
    return written(df, "cut")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint. Unlike a written table it keeps the estimated size of its plan.

    For a result that is read once or twice, outside of loops, and whose joins
    are to be planned alike at every size.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers in one file of a written table, at least.
FILE_ROWS = 100_000


def few_files(df: DataFrame, rows: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """``df``, of at most about ``rows`` rows, in no more partitions than hold ``file_rows`` rows each.

    A table is written as a file for every partition. A small one dealt over many partitions is many files of a few rows;
    each costs a request to the store and, on a local disk without Hadoop's native library, two processes that
    the executor starts to set permissions. Larger tables keep their partitions.
    """
    return df.coalesce(1 + rows // file_rows)


#: With it Spark drops the shuffle files of a write once the table is there. Otherwise they stay until the driver's collector runs.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Of each open :func:`passing`, the innermost last, the tables written in it and their folders.
_passing: ContextVar[tuple[list[tuple[DataFrame, str]], ...]] = ContextVar("_passing", default=())


@contextmanager
def passing(spark: SparkSession, opened: bool = True) -> Iterator[Callable[..., DataFrame]]:
    """Tables written inside are removed at the end, but for those written by what this yields, which takes what
    :func:`written` takes. They belong to the next ``passing`` further out, or stay until :func:`clear_scratch`.

    No result that is read later may still read a removed table: write it first. With ``opened`` false this holds only
    inside another ``passing``; a caller without one finds all tables in place.
    """
    outer = _passing.get()
    if not outer and not opened:
        yield written
        return
    mine: list[tuple[DataFrame, str]] = []

    def lasting(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        table = written(df, name, codec)
        entry = mine.pop()
        if outer:
            outer[-1].append(entry)
        return table

    token = _passing.set((*outer, mine))
    try:
        yield lasting
    finally:
        _passing.reset(token)
        for _, folder in mine:
            _remove(spark, folder)


def spent(*tables: DataFrame) -> None:
    """Remove tables that nothing reads again before their :func:`passing` ends. Tables written outside of any stay."""
    for held in _passing.get():
        for entry in [e for e in held if any(e[0] is t for t in tables)]:
            held[:] = [e for e in held if e is not entry]
            _remove(entry[0].sparkSession, entry[1])


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table that several later steps read, and read it back column by column.

    Nothing reads the shuffles behind it again, so they do not stay on disk beside it. ``codec`` is Parquet's
    compression, by default Spark's.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    if opened := _passing.get():
        opened[-1].append((table, path))
    return table
