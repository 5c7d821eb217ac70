"""The store as a text report and as JSON: one text row for each entry, joined by the writer, never on the driver."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settle
from ..sources.reports import write_report
from .review import clean_records

ROWS_PER_FILE = 200_000


def _json(s: Column) -> Column:
    """A JSON string."""
    a = F.to_json(F.array(s))
    return F.substring(a, F.lit(2), F.length(a) - 2)


def json_rows(store: DataFrame) -> DataFrame:
    """part, ord, row: the lines of a JSON array of clean records, indented by two blanks; nothing for an empty store."""
    clean = clean_records(store)
    pairs = F.transform(F.map_entries("locators"), lambda e: F.concat(F.lit("      "), _json(e["key"]), F.lit(": "), _json(e["value"])))
    inner = F.when(F.size(pairs) == 0, "{}").otherwise(F.concat(F.lit("{\n"), F.array_join(pairs, ",\n"), F.lit("\n    }")))
    body = F.concat(F.lit('  {\n    "name": '), _json(F.col("name")), F.lit(',\n    "tag": '), _json(F.col("tag")), F.lit(',\n    "locators": '), inner, F.lit("\n  }"))
    rows = clean.select("ord", body.alias("row"))
    last = rows.agg(F.max("ord").alias("last")).where("last is not null")  # one row
    joined = rows.crossJoin(F.broadcast(last)).select(F.lit(1).alias("part"), "ord", F.when(F.col("ord") == F.col("last"), F.col("row")).otherwise(F.concat("row", F.lit(","))).alias("row"))
    edge = lambda part, row: last.select(F.lit(part).alias("part"), F.col("last").alias("ord"), F.lit(row).alias("row"))
    return edge(0, "[").union(joined).union(edge(2, "]"))


def _counted(store: DataFrame) -> DataFrame:
    """store with i, the number of each entry by its place: counts of ranges of places first, then each range by itself."""
    ranges = max(1, -(-store.count() // ROWS_PER_FILE))
    rows = settle(store.repartitionByRange(ranges, "ord").withColumn("_range", F.spark_partition_id()))
    counts = rows.groupBy("_range").agg(F.count("*").alias("k"))  # a row for each file that is written
    before = counts.select("_range", F.coalesce(F.sum("k").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_range").withColumn("i", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("ord"))).drop("_range", "_before")


def text_rows(store: DataFrame, title: str) -> DataFrame:
    """part, ord, row: a report; its title is the caller's, as it holds the time; nothing for an empty store."""
    each = F.transform("locators", lambda x: F.concat(F.lit(" ["), F.upper(x["type"]), F.lit("]"), F.coalesce(F.concat(F.lit(" [stability="), x["stability"].cast("string"), F.lit("]")), F.lit("")), F.lit("\n "), x["value"], F.lit("\n\n")))
    hops = F.when(F.col("hops").isNotNull(), F.concat(F.lit("Hops: "), F.to_json("hops"), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("--- Element "), F.col("i").cast("string"), F.lit(" ---\nID: "), "id", F.lit("\nName: "), "name", F.lit("\nTag: <"), "tag", F.lit(">\n"))
    body = _counted(store).select(F.lit(1).alias("part"), "ord", F.concat(head, hops, F.lit("\n"), F.array_join(each, ""), F.lit("---------------------\n")).alias("row"))
    total = store.agg(F.count("*").alias("n"), F.min("ord").alias("ord")).where("n > 0")
    rule = "=" * 49
    return total.select(F.lit(0).alias("part"), "ord", F.concat(F.lit(f"{title}\n{rule}\n\nTotal Locators: "), F.col("n").cast("string"), F.lit("\n")).alias("row")).union(body)


def write_rows(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Ordered text files whose contents follow each other; files: how many, by default one for each ROWS_PER_FILE rows."""
    files = files or max(1, -(-rows.count() // ROWS_PER_FILE))
    rows.repartitionByRange(files, "part", "ord").sortWithinPartitions("part", "ord").select("row").write.mode("overwrite").text(path)


def file_stamp(ts: Column) -> Column:
    """The time as file names have it, UTC in a session of that zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")


def file_name(prefix: str, now: datetime, suffix: str) -> str:
    """With the time in UTC; a time without a zone is taken for UTC."""
    return f"{prefix}{(now.astimezone(timezone.utc) if now.tzinfo else now).strftime('%Y-%m-%dT%H-%M-%S')}.{suffix}"


def save_json(store: DataFrame, folder: str, now: datetime, prefix: str = "locators-") -> str:
    """The store as one JSON file in folder; returns its name. An empty store gives no file."""
    name = file_name(prefix, now, "json")
    rows = settle(json_rows(store))
    write_report(rows, folder, name, max(1, -(-rows.count() // ROWS_PER_FILE)))
    return name


def save_text(store: DataFrame, folder: str, now: datetime, title: str, prefix: str = "report-") -> str:
    """The same as a text report."""
    name = file_name(prefix, now, "txt")
    rows = settle(text_rows(store, title))
    write_report(rows, folder, name, max(1, -(-rows.count() // ROWS_PER_FILE)), "\n")
    return name
