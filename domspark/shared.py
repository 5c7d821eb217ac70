"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_FILE = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; in local mode a temporary one where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="domspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths of the tables written in each open scope, from the outermost in.
_SCOPES: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("scopes", default=())


def settle(df: DataFrame, rows: int | None = None, outer: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: later steps use it several times and a lost executor costs nothing.

    rows: about how many there are, if known; then small tables become few files. outer: the table outlives the innermost
    scratch(), as a result that is read later has to.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    scopes = _SCOPES.get()[: -1 if outer else None]
    if scopes:
        scopes[-1].append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_large(df: DataFrame) -> DataFrame:
    """settle() for tables of elements and of what is asked of them, which grow with the pages.

    Files of such rows are up to a hundred times smaller than the rows are in memory, and the planner knows only the
    files: it would take whole tables for small, collect them on the driver and send them to all. So they are joined by
    merging; the hint goes up to the next join.
    """
    return settle(df).hint("merge")


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that settle() writes inside are deleted at the end, but for outer ones."""
    own: list[tuple[SparkSession, str]] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for spark, path in own:
            _delete(spark, path)


def discard(settled: DataFrame) -> None:
    """Delete a table that settle() wrote; nothing may read it any more."""
    for folder in {f.rpartition("/")[0] for f in settled.inputFiles()}:
        _delete(settled.sparkSession, folder)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
