"""Session set-up and lineage cutting."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tabulith", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own.

    Only here a folder of this machine stands in for the shared one, and only where
    the configuration names none.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tabulith-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    There is no substitute: on a cluster every executor would write to its own disk
    and a later read would miss files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named


def small_batches(spark: SparkSession, size: str = "4m", rows: int = 500) -> None:
    """Few rows, of a few megabytes at most, go to Python workers at once from now on, unless the session has a size of its own.

    Spark's 10,000 rows at once are tens of megabytes of text, held by the executor
    outside its heap and by the worker. For jobs whose workers see one stage after another.
    """
    for key, value in (("maxBytesPerBatch", size), ("maxRecordsPerBatch", str(rows))):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Workers import it by name; a driver that only extended its own ``sys.path`` would
    leave them without it. A package that is installed on the cluster is found first.
    """
    context = spark.sparkContext
    if getattr(context, "_tabulith_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tabulith-"), "tabulith.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("tabulith", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._tabulith_shipped = True


class _Written(threading.local):
    """Tables written in the blocks of ``scratch`` that are open in this thread, innermost last."""

    def __init__(self):
        self.open: list[list[str]] = []


_written = _Written()


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders through the file system that holds them."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that ``cut_lineage`` writes inside the block are deleted at its end, also after an error.

    For callers who have used up a result by then (written, collected or counted it).
    Yields the list of their paths.
    """
    paths: list[str] = []
    _written.open.append(paths)
    try:
        yield paths
    finally:
        # By identity: two empty lists are equal.
        _written.open[:] = [p for p in _written.open if p is not paths]
        delete_tables(spark, paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later readers prune columns and push filters into the written table, and a
    lost executor re-reads it instead of recomputing everything before it.
    """
    path = f"{shared_folder(df.sparkSession)}/tabulith-{uuid.uuid4().hex}"
    if _written.open:
        _written.open[-1].append(path)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
