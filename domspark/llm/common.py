"""What the text operators share: tables, words, batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, scratch, settle, shared_folder  # noqa: F401

#: White space between words: U+0020 and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters that aren't white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != F.lit(""))


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def small_batches(df: DataFrame, rows: int = 2_000) -> None:
    """From now on Arrow batches hold so many rows at most: texts are long, and a batch stands in memory on both sides."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, rows + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most, so that what is made from a part stays small.

    At the end of a task what it has freed goes back to the system: the worker lives on, beside the executor's heap.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_rows(df: DataFrame, change) -> DataFrame:
    """df with each batch of rows as change(batch) returns it, in the same columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1_000):
            yield change(batch)

    return df.mapInArrow(run, df.schema)


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


#: A key that more than one of so many rows has is hot; fewer keys than this can be.
HOT = 10_000


def by_key(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with facts, which has one row for each key and in column n about how many of rows have it; n goes.

    Fewer than HOT keys can have more than one of HOT rows: their facts are broadcast and their rows stay where they are.
    All other keys meet by a shuffle that no key is large in. Both are read several times: give settled tables.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    hot = facts.where(F.col(n) * HOT > total).drop(n)
    cold = facts.where(F.col(n) * HOT <= total).drop(n)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key))
