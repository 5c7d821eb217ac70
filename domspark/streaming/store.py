"""A keyed table that streams write to: batches append what they change, readers merge, and each change can be followed.

    path/changes/version=V/bucket=B    the rows that version V changed: keys, columns, op (insert, update, delete), version
    path/base/version=V/bucket=B       all rows of a bucket up to V, written when many changes have gathered
    path/manifests/V.json              what a reader of version V has to read of each bucket; written last

Keys are dealt into buckets by hash. A write reads only the buckets that it touches and writes only rows that change, so
written bytes follow the batch, not the table; a bucket is written anew once MOST_CHANGES versions have changed it. A
write names its batch, and a batch that is run again does nothing. There is one writer at a time. Paths are those that
both Spark and pyarrow's filesystems open. Rows with a null key are passed over.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..shared import discard, settle

BUCKETS, MOST_CHANGES = 32, 8


def _folder(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def versions(path: str) -> list[int]:
    """The versions that can be read, ascending."""
    fs, at = _folder(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{at}/manifests", allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))


def manifest(path: str, version: int | None = None) -> dict[str, Any] | None:
    """Of the newest version, if none is named."""
    if version is None:
        known = versions(path)
        if not known:
            return None
        version = known[-1]
    fs, at = _folder(path)
    with fs.open_input_file(f"{at}/manifests/{version:012d}.json") as f:
        return json.loads(f.read())


def _commit(path: str, m: dict[str, Any]) -> None:
    fs, at = _folder(path)
    fs.create_dir(f"{at}/manifests", recursive=True)
    with fs.open_output_stream(f"{at}/manifests/.{m['version']}.tmp") as f:
        f.write(json.dumps(m).encode())
    fs.move(f"{at}/manifests/.{m['version']}.tmp", f"{at}/manifests/{m['version']:012d}.json")


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _merged(spark: SparkSession, path: str, m: dict[str, Any], buckets: list[int] | None = None) -> DataFrame:
    """The rows of some buckets as they are, with the version that wrote each."""
    schema = StructType.fromJson(m["schema"])
    wanted = m["files"] if buckets is None else {str(b): m["files"][str(b)] for b in buckets if str(b) in m["files"]}
    paths = [f"{path}/base/version={f['base']}/bucket={b}" for b, f in wanted.items() if f["base"] is not None] + [f"{path}/changes/version={v}/bucket={b}" for b, f in wanted.items() for v in f["changes"]]
    if not paths:
        return spark.createDataFrame([], schema)
    rest = [c for c in schema.names if c not in m["keys"]]
    rows = spark.read.schema(schema).parquet(*paths).groupBy(*m["keys"]).agg(F.max_by(F.struct(*rest), "version").alias("row"))
    return rows.select(*m["keys"], *[F.col(f"row.{c}").alias(c) for c in rest]).where("op <> 'delete'").select(*schema.names)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as it is, or was at a version; None before its first write."""
    m = manifest(path, version)
    return None if m is None else _merged(spark, path, m).drop("op", "version")


def _written(changed: DataFrame, path: str, m: dict[str, Any], batch: int | None) -> int:
    """Changed rows (with bucket, op, version) as the next version."""
    spark, v = changed.sparkSession, m["version"] + 1
    rows = settle(changed)
    touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
    if touched:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/changes/version={v}")
    discard(rows)
    files = {b: dict(f) for b, f in m["files"].items()}
    for b in touched:
        own = files.setdefault(str(b), {"base": None, "changes": []})
        own["changes"] = [*own["changes"], v]
    new = m | {"version": v, "batch": m["batch"] if batch is None else batch, "files": files, "changed": touched}
    full = [b for b in touched if len(files[str(b)]["changes"]) > MOST_CHANGES]
    if full:
        _merged(spark, path, new, full).withColumn("bucket", _bucket(m["keys"], m["buckets"])).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/version={v}")
        fs, at = _folder(path)
        for b in full:  # a bucket whose rows are all deleted has no base
            there = fs.get_file_info(f"{at}/base/version={v}/bucket={b}").type == pyarrow.fs.FileType.Directory
            files[str(b)] = {"base": v if there else None, "changes": []}
    _commit(path, new)
    return v


def write(rows: DataFrame, path: str, keys: list[str], batch: int | None = None, order: tuple[str, ...] = (), keep: tuple[str, ...] = (), buckets: int = BUCKETS) -> int:
    """rows over the table's: of a key the last one by order wins, the columns of keep hold their first value. Returns the version.

    Rows that change nothing aren't written. batch: a number that grows; one that was written before is passed over.
    """
    spark, m = rows.sparkSession, manifest(path)
    if m is not None and batch is not None and m["batch"] is not None and batch <= m["batch"]:
        return m["version"]
    rest = [c for c in rows.columns if c not in keys]
    if m is None:
        schema = rows.select(*keys, *rest).withColumns({"op": F.lit(""), "version": F.lit(0).cast("long")}).schema
        m = {"version": 0, "batch": None, "keys": keys, "buckets": buckets, "schema": json.loads(schema.json()), "files": {}}
    whole = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    last = whole.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order) if order else F.lit(1)).alias("row"), *[F.min(c).alias(f"_{c}") for c in keep]).withColumn("bucket", _bucket(keys, m["buckets"]))
    last = settle(last)
    touched = [r.bucket for r in last.select("bucket").distinct().collect()]
    old = _merged(spark, path, m, touched).select(*keys, F.struct(*rest).alias("before"))
    both = last.join(old, keys, "left")
    value = lambda c: F.coalesce(F.col(f"before.{c}"), F.col(f"_{c}")) if c in keep else F.col(f"row.{c}")
    out = both.select(*keys, *[value(c).alias(c) for c in rest], F.when(F.col("before").isNull(), "insert").otherwise("update").alias("op"), F.lit(m["version"] + 1).cast("long").alias("version"), "bucket", "before")
    v = _written(out.where(F.col("before").isNull() | ~F.col("before").eqNullSafe(F.struct(*rest))).drop("before"), path, m, batch)
    discard(last)
    return v


def delete(keys_of: DataFrame, path: str, batch: int | None = None) -> int:
    """The rows of these keys go."""
    spark, m = keys_of.sparkSession, manifest(path)
    gone = keys_of.select(*m["keys"]).distinct().withColumn("bucket", _bucket(m["keys"], m["buckets"]))
    touched = [r.bucket for r in gone.select("bucket").distinct().collect()]
    out = _merged(spark, path, m, touched).join(gone, m["keys"]).withColumns({"op": F.lit("delete"), "version": F.lit(m["version"] + 1).cast("long")})
    return _written(out, path, m, batch)


def expire(path: str, keep: int = 10) -> None:
    """Only the newest keep versions can be read and followed from now on; what no other needs is deleted."""
    fs, at = _folder(path)
    known = versions(path)
    old, kept = known[:-keep], known[-keep:]
    needed = {("changes", v) for v in kept}
    for v in kept:
        for f in manifest(path, v)["files"].values():
            needed |= {("base", f["base"])} | {("changes", c) for c in f["changes"]}
    for v in old:
        fs.delete_file(f"{at}/manifests/{v:012d}.json")
    for kind in ("changes", "base"):
        for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{at}/{kind}", allow_not_found=True)):
            if f.type == pyarrow.fs.FileType.Directory and (kind, int(f.base_name.partition("=")[2])) not in needed:
                fs.delete_dir(f.path)


@dataclass
class _File(InputPartition):
    path: str | None


class _Feed(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.since = options["path"], int(options.get("since", 0))

    def initialOffset(self) -> dict[str, int]:
        return {"version": self.since}

    def latestOffset(self) -> dict[str, int]:
        return {"version": max([self.since, *versions(self.path)[-1:]])}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[_File]:
        fs, at = _folder(self.path)
        known, found = set(versions(self.path)), []
        for v in range(start["version"] + 1, end["version"] + 1):
            if v not in known:
                raise ValueError(f"version {v} has expired")
            every = fs.get_file_info(pyarrow.fs.FileSelector(f"{at}/changes/version={v}", recursive=True, allow_not_found=True))
            found += [_File(f"{self.path}/{f.path.removeprefix(at).lstrip('/')}") for f in every if f.base_name.endswith(".parquet")]
        return found or [_File(None)]

    def read(self, partition: _File):
        if partition.path is None:
            return
        fs, at = _folder(partition.path)
        with fs.open_input_file(at) as f:
            yield from pyarrow.parquet.ParquetFile(f).iter_batches(batch_size=1_000)


class StoreChanges(DataSource):
    """The changes of a table as a stream, version by version. Options: path; since: a version, whose successors are followed."""

    @classmethod
    def name(cls) -> str:
        return "store_changes"

    def schema(self) -> StructType:
        return StructType.fromJson(manifest(self.options["path"])["schema"])

    def streamReader(self, schema: StructType) -> _Feed:
        return _Feed(dict(self.options))


def changes(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """The stream of changed rows, with op and version."""
    spark.dataSource.register(StoreChanges)
    return spark.readStream.format("store_changes").option("since", since).load(path)


def replayed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table that changes lead to."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("row")).where("row.op <> 'delete'")
    return last.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest if c not in ("op", "version")])
