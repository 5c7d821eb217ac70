"""Search, rank and render what the store holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.locators import snippet
from ..functions.text import filled, js_trim


def name_search(entries: DataFrame, term: str | None) -> DataFrame:
    """Entries whose name holds the term, in either case; an empty term finds all."""
    return entries if not term else entries.where(F.contains(F.lower("name"), F.lower(F.lit(term))))


def may_be_named(term: str | None) -> Column:
    """Which elements (name, tag) to locate for name_search to find the same in the store: entries of one id have one name, or one of name and tag holds the mark between both."""
    mark = F.lit("::")
    return F.contains(F.lower("name"), F.lower(F.lit(term or ""))) | F.contains(F.col("name"), mark) | F.contains(F.col("tag"), mark)


def best_stability(locators: Column) -> Column:
    return F.aggregate(locators, F.lit(0), lambda a, x: F.greatest(a, F.coalesce(x["stability"], F.lit(0))))


def ranked(entries: DataFrame, *order: str) -> DataFrame:
    """Most stable first; ties keep the store's order."""
    return entries.withColumn("max_stability", best_stability(F.col("locators"))).orderBy(F.desc("max_stability"), *order)


def _placed(locators: Column) -> Column:
    return F.transform(locators, lambda x, i: F.struct(F.coalesce(F.array_position(F.array(F.lit("id"), F.lit("css"), F.lit("xpath")), x["type"]), F.lit(0)).alias("kind"), (-F.coalesce(x["stability"], F.lit(0))).alias("worse"), i.alias("ord"), x.alias("locator")))


def sorted_locators(locators: Column) -> Column:
    """By kind (others, id, css, xpath), then the most stable, then as they were."""
    return F.transform(F.array_sort(F.transform(_placed(locators), lambda x: F.struct(x["kind"], x["worse"], x["ord"], x["locator"]))), lambda x: x["locator"])


def best_locator(locators: Column) -> Column:
    """The most stable locator, the first of equals; absolute paths only if there is nothing else."""
    some = F.filter(locators, lambda x: x["type"] != "xpath-abs")
    pool = F.when(F.size(some) > 0, some).otherwise(locators)
    order = F.transform(pool, lambda x, i: F.struct((-F.coalesce(x["stability"], F.lit(0))).alias("worse"), i.alias("ord"), x.alias("locator")))
    return F.get(F.array_sort(order), F.lit(0))["locator"]


def first_of_type(locators: Column, kind: str) -> Column:
    return F.get(F.filter(locators, lambda x: x["type"] == kind), F.lit(0))


def with_snippets(entries: DataFrame, language: str) -> DataFrame:
    """A row for each locator of each entry, sorted for reading, with its test code."""
    rows = entries.select(*[c for c in entries.columns if c != "locators"], F.posexplode(sorted_locators(F.col("locators"))).alias("place", "locator"))
    return rows.withColumn("code", snippet(language, F.col("locator.type"), F.col("locator.value")))


def last_by_type(locators: Column) -> Column:
    """The last value of each kind, as a map in the order in which kinds first occur."""
    kinds = F.array_distinct(F.transform(locators, lambda x: x["type"]))
    last = lambda k: F.element_at(F.filter(locators, lambda x: x["type"] == k), -1)["value"]
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k.alias("key"), last(k).alias("value"))))


def clean_records(entries: DataFrame) -> DataFrame:
    return entries.select(*[c for c in ("page_id", "ord") if c in entries.columns], "name", "tag", last_by_type(F.col("locators")).alias("locators"))


def openable(url: Column) -> Column:
    """Whether pages of this address can be asked at all."""
    return F.coalesce(url.rlike("^(https?|file):"), F.lit(False))


def accessible_name(nodes: DataFrame) -> DataFrame:
    """page_id, nid, accessible_name: aria-label, the labelling element's text, an input's label, title, alt, or the text."""
    at = lambda n: filled(F.element_at(F.col("attrs"), n))
    text = js_trim(F.coalesce("text", F.lit("")))
    first = lambda df, key: df.groupBy("page_id", key).agg(F.min_by("t", "pre").alias("t"))
    light = nodes.where("scope = -1")
    named = first(light.select("page_id", "pre", at("id").alias("ref"), text.alias("t")).where("ref is not null"), "ref").withColumnRenamed("t", "by_ref")
    labels = first(light.where("tag = 'label'").select("page_id", "pre", at("for").alias("own"), text.alias("t")).where("own is not null"), "own").withColumnRenamed("t", "by_label")
    rows = nodes.select("page_id", "nid", "tag", "attrs", text.alias("t"), at("aria-labelledby").alias("ref"), F.when(F.col("tag") == "input", at("id")).alias("own"))
    rows = rows.join(named, ["page_id", "ref"], "left").join(labels, ["page_id", "own"], "left")
    return rows.select("page_id", "nid", F.coalesce(js_trim(at("aria-label")), "by_ref", "by_label", js_trim(at("title")), js_trim(at("alt")), filled(F.col("t"))).alias("accessible_name"))
