"""Intermediate tables in the shared folder of the cluster, and the few file operations beside them.

Spark has no public call to remove a folder or to create a file only where there is none, so these two go
through the file system that the session itself uses; nothing else here or elsewhere does.
"""

from __future__ import annotations

import functools
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


#: How rounds write what holds texts: it is written once and read once or twice, so size counts more than speed.
COMPACT = "zstd"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="postmill-")


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def stage(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write once, read back: cuts the lineage, survives lost executors, keeps columns prunable."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"
    held = _scratch.get()
    if held is not None:
        held.append(path)
    (df.write.option("compression", COMPACT) if compact else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All that is staged inside is removed at the end, so nothing that reads it may leave."""
    outer = _scratch.set([])
    try:
        yield
    finally:
        paths = _scratch.get()
        _scratch.reset(outer)
        for path in paths:
            remove(spark, path)


def unstage(frame: DataFrame) -> None:
    """Remove the files of a staged table that nobody will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        remove(frame.sparkSession, folder)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


def names(spark: SparkSession, folder: str, older_than: int = 0) -> list[str]:
    """Names in a folder, of what was changed at least so many seconds ago; none where the folder is not there."""
    files, at = _file_system(spark, folder)
    found = files.listStatus(at) if files.exists(at) else []
    limit = (time.time() - older_than) * 1000
    return sorted(f.getPath().getName() for f in found if not older_than or f.getModificationTime() <= limit)


def read_text(spark: SparkSession, path: str) -> str:
    files, at = _file_system(spark, path)
    stream = files.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a whole file unless there is one; says whether it did. Readers never see a part of it."""
    files, at = _file_system(spark, path)
    if files.exists(at):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{at.getParent()}/.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        # Without the option to overwrite, a rename onto a file fails.
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(draft, at, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception:
        if files.exists(at):
            return False
        raise
    finally:
        files.delete(draft, False)
