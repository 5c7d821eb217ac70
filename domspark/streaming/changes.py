"""Changes of pages as streams: bursts are debounced, and the store follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.candidates import added
from ..operators.entries import entries
from ..operators.strategies import COLUMNS, locators
from ..shared import scratch, settle
from ..sources.diff import NEW, WHOLE
from ..sources.dom import nodes
from . import store
from .debounce import debounced_stream

GAP_MS = 500
GAP = f"{GAP_MS} milliseconds"


def debounced(changes: DataFrame, *keys: str, ts: str = "ts", gap: str = GAP, what: Column | None = None, last_only: bool = False, late: str | None = None) -> DataFrame:
    """keys, first, last, n, batch for each burst: changes of equal keys with pauses of at most gap.

    batch: what of all changes in the burst (the default: none is lost), or with last_only of the last one. late: the
    watermark's delay, for streams; the time is read as TIMESTAMP.
    """
    rows = changes.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        rows = rows.withWatermark(ts, late)
    w = F.session_window(ts, gap)
    value = F.col(ts) if what is None else what
    batch = F.max_by(F.array(value), ts) if last_only else F.array_sort(F.collect_list(value))
    out = rows.groupBy(w.alias("w"), *keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"), batch.alias("batch"))
    return out.drop("w")


def scanned(pages: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """Entries of page snapshots."""
    return entries(locators(nodes(pages, columns=COLUMNS), priority))


def rescanned(pages: DataFrame, priority: list[str] | None = None) -> DataFrame:
    """Entries of what is new in snapshots (page_id, html, before); of pages without a before, of all of it.

    New elements are held against the whole page as it is now; those that were there before aren't looked at again.
    """
    n = settle(nodes(pages, columns=COLUMNS, before="before"))
    new = n.where(F.col("fresh") == WHOLE).select("page_id", "nid").union(added(n, n.where(F.col("fresh") == NEW).select("page_id", "nid")).select("page_id", "nid"))
    return entries(locators(n, priority, only=new))


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The entries, now or at a version."""
    return store.read(spark, f"{path}/entries", version)


def entry_changes(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """The stream of inserted, updated and deleted entries."""
    return store.changes(spark, f"{path}/entries", since)


def write_over(pages: DataFrame, batch_id: int, path: str, priority: list[str] | None = None, by_page: bool = True, incremental: bool = False) -> None:
    """One micro-batch of snapshots (page_id, html; the last of a page by ts, if there is that column) into the store at path.

    The store holds entries, and pages as they were last seen. Pages that are as they were aren't scanned; changed ones are
    scanned anew, or, incremental, only what is new in them. Only entries that change are written. A batch that is run
    again changes nothing.
    """
    spark, keys = pages.sparkSession, ["page_id", "id"] if by_page else ["id"]
    with scratch():
        order = F.struct("ts", "html") if "ts" in pages.columns else F.struct("html")
        last = settle(pages.where("page_id is not null").groupBy("page_id").agg(F.max_by(F.coalesce("html", F.lit("")), order).alias("html")))
        known = store.read(spark, f"{path}/pages")
        seen = last.withColumn("before", F.lit(None).cast("string")) if known is None else last.join(known.select("page_id", F.col("html").alias("before")), "page_id", "left")
        seen = settle(seen.where(~F.col("html").eqNullSafe(F.col("before"))))
        if seen.isEmpty():
            return
        found = rescanned(seen if incremental else seen.withColumn("before", F.lit(None).cast("string")), priority)
        place = F.struct(F.lit(batch_id).cast("long").alias("batch"), "page_id", "seq")
        rows = found.select("page_id", "seq", "id", "name", "tag", "locators", "hops", place.alias("ord"))
        store.write(rows, f"{path}/entries", keys, batch_id, ("page_id", "seq"), ("ord",))
        # After the entries, so that a batch that broke off is done again.
        store.write(seen.select("page_id", "html"), f"{path}/pages", ["page_id"], batch_id)


def follow(pages: DataFrame, path: str, checkpoint: str, priority: list[str] | None = None, by_page: bool = True, incremental: bool = False, debounce: str | None = None, **trigger) -> StreamingQuery:
    """Starts the stream of snapshots (page_id, html, and ts with debounce) into the store; stop() of the query ends it, a restart goes on.

    debounce: the watermark's delay; then a page is scanned as its burst of changes left it, once the burst is over.
    """
    rows = pages if debounce is None else debounced_stream(pages, "page_id", gap_ms=GAP_MS, delay=debounce, last_only=True).select("page_id", "html", F.col("last").alias("ts"))
    return rows.writeStream.foreachBatch(lambda df, i: write_over(df, i, path, priority, by_page, incremental)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
