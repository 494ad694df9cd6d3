"""Streams that stop, go on from their checkpoint, and meet late or repeated rows."""

import datetime

from pyspark.sql import functions as F

from tidewire.streaming import jobs as J

DAY = datetime.datetime(2024, 1, 1)
SHAPE = "id long, canonical_url string, published_at timestamp"


def put(spark, folder, rows, shape=SHAPE):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)


def at(days):
    return DAY + datetime.timedelta(days=days)


def test_ingest_goes_on_and_doubles_nothing(spark, tmp_path):
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    schema = spark.createDataFrame([], SHAPE).schema
    ingest = lambda: J.stream_ingest(J.read_files(spark, source, schema), out, check, lambda df: df.withColumn("seen", F.lit(True)), 3)
    put(spark, source, [(2, "a", at(0)), (1, "a", at(0)), (3, "b", None)])
    ingest()
    put(spark, source, [(4, "a", at(3)), (5, "c", at(3)), (6, "b", None)])
    ingest()
    put(spark, source, [(7, "a", at(9)), (8, "c", at(5)), (9, None, at(5))])  # a comes back beyond the horizon
    ingest()
    want = [(1, "a", 0), (3, "b", 0), (5, "c", 1), (7, "a", 2), (9, None, 2)]
    read = lambda: sorted((r.id, r.canonical_url, r.batch) for r in spark.read.parquet(out).collect())
    assert read() == want
    for name in ("2", ".2.crc"):  # as if the driver had been lost before the last batch was marked as done
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    ingest()
    assert read() == want


def test_windows_come_once_and_late_rows_are_dropped(spark, tmp_path):
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    schema = spark.createDataFrame([], SHAPE).schema
    counts = lambda: J.stream_window_counts(J.read_files(spark, source, schema), out, check, {"n": F.count("*")}, "published_at", "1 day", "1 day")
    put(spark, source, [(1, "a", at(0)), (2, "b", at(0.5)), (3, "c", at(3.5))])
    counts()
    read = lambda: sorted((r.start, r.n) for r in spark.read.parquet(out).collect())
    assert read() == [(at(0), 2)]
    put(spark, source, [(4, "late", at(0.6)), (5, "d", at(2.6)), (6, "e", at(9))])  # the first is behind the watermark, the second isn't
    counts()
    assert read() == [(at(0), 2), (at(2), 1), (at(3), 1)]


def test_late_items_are_dropped_and_counted(spark, tmp_path):
    """Older than 14 days at ingest: out, and known by number; a URL's state goes a horizon after its last item."""
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    shape = "id long, canonical_url string, published_at timestamp, fetched_at timestamp"
    schema = spark.createDataFrame([], shape).schema
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    held = []
    try:
        for rows in (
            [(1, "a", at(0), at(1)), (2, "b", at(-20), at(1)), (3, "a", at(0), at(1)), (4, "c", None, at(1))],
            [(5, "a", at(1), at(2)), (6, "b", at(1), at(2)), (7, "d", at(-12.5), at(2))],
            [(8, "e", at(29), at(30))],  # the watermark passes the horizon of all before
            [(9, "a", at(30), at(31)), (10, "e", at(29), at(31))],
        ):
            put(spark, source, rows, shape)
            J.stream_late_drop(J.read_files(spark, source, schema), out, check)
            state = spark.read.format("statestore").option("stateVarName", "known").load(check)
            held.append(sorted(r.key.canonical_url for r in state.collect()))
    finally:
        spark.conf.unset(store)
    got = {r.id: r.what for r in spark.read.parquet(out).collect()}
    assert {got[1], got[3]} == {"new", "again"} and {k: v for k, v in got.items() if k not in (1, 3)} == {2: "late", 4: "late", 5: "again", 6: "new", 7: "late", 8: "new", 9: "new", 10: "again"}
    assert held[1] == ["a", "b"] and held[3] == ["a", "e"]


def test_new_since_visit_after_each_batch(spark, tmp_path):
    """Equal to a count over all that has come, with visits that move between the batches, and after a lost mark."""
    from tidewire.operators.snapshots import Snapshots

    source, visits, check = (f"file://{tmp_path}/{n}" for n in ("in", "visits", "check"))
    store, shape = Snapshots(spark, f"file://{tmp_path}/store"), "id long, ingested_at timestamp"
    schema, every = spark.createDataFrame([], shape).schema, []
    for n, (rows, seen) in enumerate((
        ([(1, at(0)), (2, at(0.01)), (3, at(1)), (4, None)], {1: at(0), 2: at(0.005), 3: at(5)}),
        ([(5, at(2)), (6, at(0.01))], {1: at(1), 2: at(0.005), 3: at(5), 4: at(-9)}),
        ([(7, at(5.0001)), (8, at(6))], {1: at(1), 2: at(2), 3: at(5)}),
    )):
        put(spark, source, rows, shape)
        spark.createDataFrame(list(seen.items()), "user_id long, last_seen_at timestamp").write.mode("overwrite").parquet(visits)
        every += [t for _, t in rows if t]
        for _ in range(2):
            J.stream_new_since_visit(J.read_files(spark, source, schema), visits, store, check)
            for name in (str(n), f".{n}.crc"):
                (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
        J.stream_new_since_visit(J.read_files(spark, source, schema), visits, store, check)
        got = {r.user_id: r.n_new for r in store.read("counters", J.COUNTERS).collect()}
        assert got == {u: sum(t > v for t in every) for u, v in seen.items()}


def test_sketches_by_day(spark, tmp_path):
    """Exact while few values are met, within the bounds beyond; a new day leaves the others' files alone."""
    import os

    from tidewire.operators import sketches as K

    folder = f"file://{tmp_path}/days"
    n = 40_000
    rows = spark.range(n).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 3 * 86400 + 60).alias("at"), F.expr("CAST(sqrt(id % 90000) AS INT)").alias("tag"), (F.col("id") % 9000).alias("outlet"), (F.col("id") % 2).alias("g"))
    K.write_days(rows, folder, "at", "tag", "outlet", ["g"], items=64)
    files = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "days") for f in fs if f.startswith("part")}
    more = rows.limit(10).withColumn("at", F.timestamp_seconds(F.lit(1704067200 + 4 * 86400))).withColumn("tag", F.lit(-1))
    K.write_days(more, folder, "at", "tag", "outlet", ["g"], items=64)
    now = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "days") for f in fs if f.startswith("part")}
    assert files.items() <= now.items() and len(now) > len(files)
    two = K.days(spark, folder, "2024-01-01", "2024-01-03")
    own = rows.where("at < TIMESTAMP '2024-01-03 00:00:00'")
    exact = {str(r.tag): r["count"] for r in own.groupBy("tag").count().collect()}
    total = sum(exact.values())
    assert all(abs(r.n - exact[r.value]) <= 3.5 / 64 * total for r in K.most_frequent(two, 10, items=64).collect())
    real = {r.g: r.n for r in own.groupBy("g").agg(F.countDistinct("outlet").alias("n")).collect()}
    assert all(abs(r.n - real[r.g]) <= 4 * 0.013 * real[r.g] for r in K.distinct_counts(two, ["g"]).collect())
    last = K.days(spark, folder, "2024-01-05", "2024-01-06")
    assert [(r.value, r.n) for r in K.most_frequent(last, 3, items=64).collect()] == [("-1", 10)]
    assert K.most_frequent(K.days(spark, folder, "2030-01-01", "2030-01-02"), 3).count() == 0
