"""Tables that cut lineage, in the folder that the cluster shares, and their removal."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a folder of its own, and on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Of each discarding() that is open in this thread or task, the paths written inside.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that written() wrote inside."""
    own: list[str] = []
    token = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(token)
        for path in own:
            removed(spark, path)


def written(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None, outer: bool = False) -> DataFrame:
    """df, written to the shared folder and read back: a lost executor costs no recomputation of what came before.

    A table with a path of its own stays. With outer, the table outlives the discarding() that it is
    written in, but not the one around that.
    """
    spark = df.sparkSession
    if path is None:
        path, levels = work_path(spark, name), _open.get()
        if len(levels) > outer:
            levels[-1 - outer].append(path)
    df.write.mode("errorifexists").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
