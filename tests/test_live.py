"""The store, its change feed, and the stateful debounce."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from domspark.streaming import store as S
from domspark.streaming.debounce import debounced_stream

T0 = datetime(2024, 1, 1)
ROW = "k long, seq int, name string, tags array<struct<a:string,b:int>>, first int"


def bursts(rows, gap=500):
    """By key: lists of (ms, what) with pauses of at most gap."""
    out = {}
    for k in {r[0] for r in rows}:
        own = sorted((ms, w) for key, ms, w in rows if key == k)
        groups = [[own[0]]]
        for x in own[1:]:
            if x[0] - groups[-1][-1][0] <= gap:
                groups[-1].append(x)
            else:
                groups.append([x])
        out[k] = groups
    return out


def fed(spark, folder, parts, stream, name):
    """What stream(changes) gives after each part of rows (key, ms, what) has come as a batch of its own."""
    schema = "k long, ts timestamp, what string, many int"
    for i, part in enumerate(parts):
        spark.createDataFrame([(k, T0 + timedelta(milliseconds=ms), w, len(w)) for k, ms, w in part], schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        q = stream(spark.readStream.schema(schema).parquet(str(folder / "in"))).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return spark.read.parquet(str(folder / "out")).collect()


def test_bursts_of_a_stream(spark, tmp_path):
    rng = random.Random(4)
    rows, at = [], {1: 0, 2: 0, 3: 300}
    for i in range(60):
        k = rng.choice([1, 2, 3])
        at[k] += rng.choice([100, 400, 500, 501, 900, 3000])
        rows.append((k, at[k], f"w{i}"))
    rows.sort(key=lambda r: r[1])
    parts = [rows[:25], rows[25:], [(9, rows[-1][1] + 60_000, "end")], [(9, rows[-1][1] + 130_000, "last")]]
    for p in parts:
        rng.shuffle(p)  # within a batch, and by delay, rows come in any order
    got = fed(spark, tmp_path, parts, lambda df: debounced_stream(df, "k", delay="30 seconds"), "a")
    want = [(k, b[0][0], b[-1][0], len(b), w) for k, groups in bursts(rows + parts[2]).items() for b in groups for _, w in b]
    ms = lambda t: round((t - T0).total_seconds() * 1000)
    assert sorted((r.k, ms(r.first), ms(r.last), r.n, r.what) for r in got if r.what != "last") == sorted(want)
    assert all(r.many == len(r.what) for r in got)


def test_only_the_last_change_and_bounded_state(spark, tmp_path):
    rows = [[(1, 0, "a"), (1, 300, "b")], [(1, 700, "c"), (1, 5_000, "d")], [(2, 200_000, "end")], [(2, 400_000, "x")]]
    last = fed(spark, tmp_path / "a", rows, lambda df: debounced_stream(df, "k", delay="1 minute", last_only=True), "a")
    assert sorted((r.k, r.n, r.what) for r in last if r.k == 1) == [(1, 1, "d"), (1, 3, "c")]
    parted = fed(spark, tmp_path / "b", [[(1, 100 * i, f"{i:02}") for i in range(20)], *rows[2:]], lambda df: debounced_stream(df, "k", delay="1 minute", most=8), "b")
    assert sorted(r.what for r in parted if r.k == 1) == [f"{i:02}" for i in range(20)] and {r.n for r in parted if r.k == 1} == {19, 1}


def test_changes_that_come_too_late_are_dropped(spark, tmp_path):
    got = fed(spark, tmp_path, [[(1, 0, "a")], [(1, 100_000, "b")], [(1, 10, "late"), (1, 98_000, "in time")], [(1, 300_000, "end")], [(1, 500_000, "x")]], lambda df: debounced_stream(df, "k", delay="5 seconds"), "a")
    assert [r.what for r in sorted(got, key=lambda r: r.last) if r.what in ("a", "b", "late", "in time")] == ["a", "in time", "b"]


def some(spark, rng, keys, batch):
    return spark.createDataFrame([(k, i, rng.choice("abc"), [(rng.choice("xy"), rng.randint(0, 2))], 100 * batch + i) for i, k in enumerate(keys)], ROW)


def table(rows):
    return {r.k: (r.seq, r.name, [tuple(t) for t in r.tags], r.first) for r in rows}


def test_store_and_its_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MOST_CHANGES", 3)
    rng, path, want, seen = random.Random(6), str(tmp_path / "store"), {}, {}
    assert S.read(spark, path) is None
    out, check = str(tmp_path / "feed"), str(tmp_path / "check")
    for batch in range(8):
        keys = [rng.randrange(40) for _ in range(rng.choice([3, 30]))]
        rows = some(spark, rng, keys, batch)
        version = S.write(rows, path, ["k"], batch, ("seq",), ("first",), buckets=4)
        first = {}
        for r in rows.collect():
            first[r.k] = min(first.get(r.k, r.first), r.first)
        for r in rows.collect():
            want[r.k] = (r.seq, r.name, [tuple(t) for t in r.tags], want.get(r.k, first[r.k])[3] if isinstance(want.get(r.k), tuple) else first[r.k])
        assert S.write(rows, path, ["k"], batch, ("seq",), ("first",)) == version  # once more: nothing
        if batch % 3 == 2:
            gone = rng.sample(sorted(want), 4)
            S.delete(spark.createDataFrame([(k,) for k in [*gone, 999]], "k long"), path)
            for k in gone:
                del want[k]
        assert table(S.read(spark, path).collect()) == want
        seen[S.versions(path)[-1]] = dict(want)
        if batch in (1, 4, 7):  # the feed is read now and then, from where it stopped
            q = S.changes(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
            assert table(S.replayed(spark.read.parquet(out), ["k"]).collect()) == want
    every = spark.read.parquet(out)
    assert {r.op for r in every.collect()} == {"insert", "update", "delete"} and every.groupBy("k", "version").count().where("count > 1").count() == 0
    for v, rows in seen.items():
        assert table(S.read(spark, path, v).collect()) == rows
    newest = S.versions(path)[-1]
    S.expire(path, 2)
    assert S.versions(path) == [newest - 1, newest] and table(S.read(spark, path).collect()) == want
    assert len(list((tmp_path / "store" / "changes").glob("version=*"))) < newest


def test_written_bytes_follow_the_batch(spark, tmp_path):
    path = str(tmp_path / "store")
    big = spark.range(50_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("name"))
    S.write(big, path, ["k"], 0)
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / "store").rglob(f"version={v}/**/*.parquet"))
    S.write(spark.createDataFrame([(5, "new"), (50_001, "x")], "k long, name string"), path, ["k"], 1)
    assert size(2) < size(1) / 100
    S.write(big, path, ["k"], 2)  # only one row differs from what is there
    assert size(3) < size(1) / 100 and S.read(spark, path).count() == 50_001
