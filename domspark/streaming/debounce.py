"""Debounced changes as a stateful stream operator with timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """Waits for a pause of more than gap after each change of a key, then gives the burst away.

    Pending changes are state: their columns, and begin, end (microseconds) and number of the changes that each stands for.
    A timer stands at the end of each burst. A burst of more than most changes is given in parts, so that state stays
    bounded and nothing is lost. With last_only only the last change of a burst is kept, in state too.
    """

    def __init__(self, columns: StructType, gap: int, most: int, last_only: bool):
        self.columns, self.gap, self.most, self.last_only = columns, gap, most, last_only

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", StructType([*self.columns.fields, *(StructField(c, LongType()) for c in ("burst_begin", "burst_end", "burst_n"))]))

    def _bursts(self, rows: list[tuple]) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        for r in sorted(rows, key=lambda r: r[-2]):
            if out and r[-3] - out[-1][-1][-2] <= self.gap:
                out[-1].append(r)
            else:
                out.append([r])
        return out

    def _given(self, key: tuple, burst: list[tuple]) -> pd.DataFrame:
        about = (*key, min(r[-3] for r in burst), max(r[-2] for r in burst), sum(r[-1] for r in burst))
        return pd.DataFrame([(*about, *r[:-3]) for r in (burst[-1:] if self.last_only else burst)], dtype=object)

    def _kept(self, key: tuple, rows: list[tuple], until: int | None) -> Iterator[pd.DataFrame]:
        """Gives away bursts that ended before until, and parts of those that are too large; keeps the others."""
        keep: list[tuple] = []
        for burst in self._bursts(rows):
            end = burst[-1][-2] + self.gap
            if until is not None and end <= until:
                yield self._given(key, burst)
                continue
            if self.last_only:
                burst = [(*burst[-1][:-3], min(r[-3] for r in burst), burst[-1][-2], sum(r[-1] for r in burst))]
            elif len(burst) > self.most:
                yield self._given(key, burst[:-1])
                burst = burst[-1:]
            keep += burst
            self.handle.registerTimer(-(-end // 1000))
        if keep:
            self.pending.put(keep)
        else:
            self.pending.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, whole = self.columns.names, [isinstance(f.dataType, IntegralType) for f in self.columns.fields]
        every = [tuple(r) for r in self.pending.get()]
        for part in rows:
            for r in part[[*names, "event_us"]].itertuples(index=False, name=None):
                own = [None if not isinstance(x, (list, dict)) and pd.api.types.is_scalar(x) and pd.isna(x) else int(x) if w else x for x, w in zip(r, whole, strict=False)]
                every.append((*own, int(r[-1]), int(r[-1]), 1))
        yield from self._kept(key, every, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._kept(key, [tuple(r) for r in self.pending.get()], expiredTimerInfo.getExpiryTimeInMs() * 1000)

    def close(self) -> None:
        pass


def debounced_stream(changes: DataFrame, *keys: str, ts: str = "ts", gap_ms: int = 500, delay: str = "5 seconds", most: int = 10_000, last_only: bool = False) -> DataFrame:
    """keys, first, last, n and the other columns of each change, once its burst is over; changes is a stream.

    A burst is over when the watermark (delay behind the newest change of any key) has passed its last change by gap_ms;
    a pause of gap_ms exactly doesn't end it. n: how many changes the burst (or its part, see Debounce) has. Changes that
    are older than the watermark come too late and are dropped by Spark: choose the delay for the sources.
    """
    spark, kinds = changes.sparkSession, changes.schema
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:  # timers need it
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rest = [c for c in changes.columns if c not in (*keys, ts)]
    # Columns go by numbers inside, as Python's rows don't take all names.
    own = {f"key{i}": k for i, k in enumerate(keys)} | {f"col{i}": c for i, c in enumerate(rest)}
    rows = changes.select(*[F.col(c).alias(a) for a, c in own.items()], F.col(ts).cast("timestamp").alias("event_time")).withWatermark("event_time", delay).withColumn("event_us", F.unix_micros("event_time"))
    columns = StructType([StructField(f"col{i}", kinds[c].dataType) for i, c in enumerate(rest)])
    out = StructType([*(StructField(f"key{i}", kinds[k].dataType) for i, k in enumerate(keys)), *(StructField(c, LongType()) for c in ("begin", "end", "count")), *columns.fields])
    found = rows.groupBy(*[f"key{i}" for i in range(len(keys))]).transformWithStateInPandas(Debounce(columns, gap_ms * 1000, most, last_only), out, "Append", "EventTime")
    named = lambda part: [F.col(a).alias(c) for a, c in own.items() if a.startswith(part)]
    return found.select(*named("key"), F.timestamp_micros("begin").alias("first"), F.timestamp_micros("end").alias("last"), F.col("count").alias("n"), *named("col"))
