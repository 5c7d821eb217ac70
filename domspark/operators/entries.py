"""Entries: one keyed record for each element, and the store that keeps the last write of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.locators import css_segment
from ..functions.text import filled

ENTRY_COLUMNS = ("id", "name", "tag", "locators", "hops")


def entry_key(name: Column, tag: Column) -> Column:
    return F.concat_ws("::", F.coalesce(filled(name), F.lit("Unnamed")), F.coalesce(filled(tag), F.lit("div")))


def own_hops() -> Column:
    """The way to an element: its shadow hosts from the outermost in, and then its own segment."""
    kind = "array<struct<type:string,host:string,selector:string>>"
    hosts = F.transform("hosts", lambda h: F.struct(F.lit("shadow").alias("type"), css_segment(h["tag"], h["attrs"]).alias("host"), F.lit(None).cast("string").alias("selector")))
    leaf = F.array(F.struct(F.lit("leaf").alias("type"), F.lit(None).cast("string").alias("host"), css_segment(F.col("tag"), F.col("attrs")).alias("selector")))
    return F.concat(hosts.cast(kind), leaf.cast(kind))


def entries(located: DataFrame) -> DataFrame:
    """page_id, seq, id, name, tag, locators, hops of elements with locators; seq is the scan's order."""
    plain = F.transform("locators", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), x["stability"].alias("stability")))
    return located.select("page_id", F.col("scan_seq").alias("seq"), entry_key(F.col("name"), F.col("tag")).alias("id"), "name", "tag", plain.alias("locators"), own_hops().alias("hops"))


def upsert(store: DataFrame | None, new: DataFrame, by_page: bool = True, batch: int = 0) -> DataFrame:
    """store with new written over it: the last row of a key wins, at the place of its first one.

    Rows: page_id, seq, id, name, tag, ...; a store also has ord, the place: (batch, page_id, seq) of the first write.
    batch: the number of this write, larger than those before. Ids that are missing or empty are made from name and tag;
    rows without anything are passed over. by_page: keys of different pages are different.
    """
    rest = [c for c in new.columns if c not in ("page_id", "seq", "id", "ord")]
    made = F.coalesce(filled(F.col("id")), entry_key(F.col("name"), F.col("tag")))
    whole = F.coalesce("id", "name", "tag").isNotNull()
    own_place = F.struct(F.lit(batch).cast("long").alias("batch"), F.col("page_id").alias("page_id"), F.col("seq").alias("seq"))

    def dealt(df: DataFrame, late: int) -> DataFrame:
        written = F.struct(F.lit(late).alias("late"), F.col("page_id"), F.col("seq"))
        return df.where(whole).select("page_id", "seq", made.alias("id"), *rest, (own_place if late else F.col("ord")).alias("ord"), written.alias("written"))

    both = dealt(new, 1) if store is None else dealt(store, 0).unionByName(dealt(new, 1))
    keys = ["page_id", "id"] if by_page else ["id"]
    w = Window.partitionBy(*keys)  # most keys are written once, so there is little to merge before they meet
    kept = both.withColumns({"ord": F.min("ord").over(w), "late": F.row_number().over(w.orderBy(F.desc("written")))}).where("late = 1")
    return kept.select("page_id", "seq", "id", *rest, "ord")


def deleted(store: DataFrame, entry_id: str) -> DataFrame:
    return store.where(F.col("id") != entry_id)


def truncated(store: DataFrame) -> DataFrame:
    return store.limit(0)
