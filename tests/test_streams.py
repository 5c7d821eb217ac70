from datetime import datetime, timedelta

from pyspark.sql import functions as F

from domspark.operators import entries as E
from domspark.streaming import changes as C

T0 = datetime(2024, 1, 1)


def test_debounce(spark):
    rows = [(1, T0 + timedelta(milliseconds=m), str(m)) for m in (0, 300, 800, 1400, 5000)]
    df = spark.createDataFrame(rows, "page_id long, ts timestamp, what string")
    got = C.debounced(df, "page_id", what=F.col("what")).orderBy("first").collect()
    assert [(r.n, r.batch) for r in got] == [(3, ["0", "300", "800"]), (1, ["1400"]), (1, ["5000"])]
    last = C.debounced(df, "page_id", what=F.col("what"), last_only=True).orderBy("first").collect()
    assert [r.batch for r in last] == [["800"], ["1400"], ["5000"]]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    schema = "page_id long, html string"
    first = spark.createDataFrame([(1, '<a href="/a">A</a>')], schema)
    second = spark.createDataFrame([(1, '<p>x</p><a href="/b">A</a>'), (2, "<p>y</p>")], schema)
    source = str(tmp_path / "in")
    store, check = str(tmp_path / "store"), str(tmp_path / "check")
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        C.follow(spark.readStream.schema(schema).parquet(source), store, check).awaitTermination()
    got = {(r.page_id, r.id): r.locators[-1].value for r in C.read_store(spark, store).collect()}
    want = E.upsert(E.upsert(None, C.scanned(first)), C.scanned(second), batch=1)
    assert got == {(r.page_id, r.id): r.locators[-1].value for r in want.collect()}
    assert got[1, "A::a"].endswith("/following-sibling::a[1]") or "b" in got[1, "A::a"]
    assert [r.id for r in want.where("page_id = 1").orderBy("ord").collect()][0] == "A::a"
