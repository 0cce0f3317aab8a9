"""Session helpers: sensible defaults and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "assayer", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and AQE; cluster sizing stays with the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # call sites of every column cost more than planning does
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the cluster names none, a local master gets a temporary folder; on a
    real cluster that would be lost with the machine, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="assayer-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system the path names."""
    system, folder = _file_system(spark, path)
    return system.exists(folder)


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write a result to the shared folder and read it back.

    For a small table that several later steps need, such as a posterior: its
    lineage ends here, and losing an executor does not recompute it.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.settled_at = path
    if _scopes:
        _scopes[-1].append(made)
    return made


#: Results settled within each open :func:`scoped` block, the innermost last.
_scopes: list[list[DataFrame]] = []


@contextmanager
def scoped() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Release at the end what was settled within, but for what is passed to the function given.

    ::

        with scoped() as keep:
            answer = keep(settled(many_steps(df), "answer"))
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.pop()
        release(*(df for df in made if not any(df is k for k in kept)))
        if _scopes:
            _scopes[-1].extend(kept)


def release(*frames: DataFrame) -> None:
    """Remove the folders of :func:`settled` results that nothing reads any more.

    Call it when whatever is made from them has been written. Only the folder that
    ``settled`` made is removed, through the file system that holds it.
    """
    for df in frames:
        path = getattr(df, "settled_at", None)
        if path:
            system, folder = _file_system(df.sparkSession, path)
            system.delete(folder, True)
            df.settled_at = None


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
