"""Intermediate tables in the shared folder of the cluster.

A plan that reads the same derived rows several times, or needs row numbers to
stay put between two passes, writes them once as Parquet below
``spark.checkpoint.dir``.  The written table survives the loss of executors, cuts
the lineage, and keeps column pruning and pushdown for its readers.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_kept: dict[tuple[str, str], str] = {}
_to_clean: set[str] = set()
#: Folders made inside the ``short_lived`` blocks that are open.
_open_blocks: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="dayplan-")
    return _local_folders[app]


def app_folder(spark: SparkSession) -> str:
    """This application's own folder, which is deleted when its Python process ends."""
    app = spark.sparkContext.applicationId
    if app not in _to_clean:
        _to_clean.add(app)
        atexit.register(_release_quietly, spark, app)
    return f"{shared_folder(spark)}/dayplan-{app}"


def _release_quietly(spark: SparkSession, app: str) -> None:
    try:
        if spark.sparkContext.applicationId == app:
            release(spark)
    except Exception:
        pass  # The session was stopped before; the folder stays for the cluster to clean.


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{app_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    for made in _open_blocks:
        made.append(path)
    return path


@contextmanager
def short_lived(spark: SparkSession):
    """Delete what was staged inside the block when it ends, whether it fails or not."""
    made: list[str] = []
    _open_blocks.append(made)
    try:
        yield
    finally:
        _open_blocks.remove(made)
        for path in made:
            delete_path(spark, path)


def delete_path(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once, partitioned by the column ``by`` if given, and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_once(spark: SparkSession, label: str, identity: str, build) -> DataFrame:
    """The staged table for ``identity``, built on first use in this application."""
    mark = (spark.sparkContext.applicationId, f"{label}:{identity}")
    if mark not in _kept:
        path = new_path(spark, label)
        build().write.parquet(path)
        _kept[mark] = path
    return spark.read.parquet(_kept[mark])


def release(spark: SparkSession) -> None:
    """Delete every table this application staged."""
    delete_path(spark, app_folder(spark))
    app = spark.sparkContext.applicationId
    for mark in [mark for mark in _kept if mark[0] == app]:
        del _kept[mark]
