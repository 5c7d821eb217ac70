"""A report as one named file, written by tasks.

    register(spark); rows.write.format("named_report").option("name", "locators.json").mode("append").save(folder)

rows have one column of text, in order; each task writes a part of its own name, and the driver's commit strings the parts
together under the report's name, a block at a time. There is no file if there are no rows, and none if the job fails. A
report of that name that is there already is replaced at the commit. Paths are those that pyarrow's filesystems open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BLOCK = 8 << 20


@dataclass
class _Part(WriterCommitMessage):
    number: int
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.name = options["path"], options["name"]
        self.between, self.end = options.get("between", "\n").encode(), options.get("end", "").encode()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        number, name, out = TaskContext.get().partitionId(), None, None
        for batch in iterator:
            for row in batch.column(0).to_pylist():
                if out is None:
                    name = f".{self.name}.{number:06d}.{uuid.uuid4().hex}"
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                else:
                    out.write(self.between)
                out.write(row.encode())
        if out is not None:
            out.close()
        return _Part(number, name)

    def commit(self, messages: list[_Part]) -> None:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        parts = [m.name for m in sorted((m for m in messages if m is not None), key=lambda m: m.number) if m.name]
        if not parts:
            return
        whole = f"{at}/.{self.name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(whole, compression=None) as out:
            for i, part in enumerate(parts):
                if i:
                    out.write(self.between)
                with fs.open_input_stream(f"{at}/{part}", compression=None) as f:
                    while block := f.read(BLOCK):
                        out.write(block)
            out.write(self.end)
        fs.move(whole, f"{at}/{self.name}")
        for part in parts:
            fs.delete_file(f"{at}/{part}")

    def abort(self, messages: list[_Part | None]) -> None:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{at}/{m.name}")


class NamedReport(DataSource):
    """Options: path (a folder), name, between (rows; a line's end by default), end (behind the last row; nothing by default)."""

    @classmethod
    def name(cls) -> str:
        return "named_report"

    def schema(self) -> str:
        return "row string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedReport)


def write_report(rows: DataFrame, folder: str, name: str, files: int, end: str = "") -> None:
    """rows (part, ord, row) in order as one file; files: how many tasks write it."""
    register(rows.sparkSession)
    ordered = rows.repartitionByRange(files, "part", "ord").sortWithinPartitions("part", "ord").select("row")
    ordered.write.format("named_report").option("name", name).option("end", end).mode("append").save(folder)
