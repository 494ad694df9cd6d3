"""Structured Streaming forms of the polling jobs. Streams end when what is there has been read (``availableNow``) and go on
from their checkpoint when started again."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.snapshots import Snapshots


def read_files(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(folder)


def run(query) -> None:
    query.trigger(availableNow=True).start().awaitTermination()


def stream_url_dedup(items: DataFrame, out: str, checkpoint: str, horizon: str = "14 days") -> None:
    """Items of a canonical URL once within the horizon; items behind it are dropped."""
    once = items.withWatermark("published_at", horizon).dropDuplicatesWithinWatermark(["canonical_url"])
    run(once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))


def stream_ingest(items: DataFrame, out: str, checkpoint: str, enrich, horizon_days: int = 14) -> None:
    """Each micro-batch: what the table doesn't have by canonical URL (the first by id of each) is enriched and appended.

    The table is partitioned by day of publication and batch. A batch reads one column of the days within the horizon of its
    own days, so its cost doesn't grow with the history; of an item that comes back under a day beyond the horizon nothing is
    known any more. A batch that is run again ignores what it had written and replaces it, so nothing is doubled. Items without
    a time of publication are kept under a day of their own.
    """
    spark = items.sparkSession

    def held(days: list, number: int) -> DataFrame | None:
        near = {d + datetime.timedelta(days=k) for d in days if d for k in range(-horizon_days, horizon_days + 1)}
        names = sorted(map(str, near)) + (["none"] if None in days else [])
        try:  # braces match the folders that are there
            done = spark.read.option("basePath", out).schema(SEEN).parquet(f"{out}/day={{{','.join(names)}}}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # no such day yet
        return done.where(F.col("batch") < number).select("canonical_url")

    def batch(df: DataFrame, number: int) -> None:
        rest = [c for c in df.columns if c != "canonical_url"]
        first = df.groupBy("canonical_url").agg(F.min_by(F.struct(*rest), "id").alias("r")).select("canonical_url", "r.*")
        days = [r[0] for r in df.select(F.to_date("published_at")).distinct().collect()]  # bounded by the calendar
        done = held(days, number)
        first = first if done is None else first.join(done, "canonical_url", "left_anti")
        day = F.coalesce(F.to_date("published_at").cast("string"), F.lit("none"))
        written = enrich(first).withColumns({"day": day, "batch": F.lit(number).cast("long")})
        written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(out)

    run(items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint))


SEEN = "canonical_url string, day string, batch long"


def stream_window_counts(
    rows: DataFrame, out: str, checkpoint: str, counts: dict[str, Column], at: str = "ran_at", length: str = "7 days", slide: str = "1 day", late: str = "1 day"
) -> None:
    """start and the given aggregates for each window of ``length``, a new one every ``slide``. A window is appended once, when no
    row for it can come any more: when a time more than ``late`` after its end was seen. Its state then goes."""
    seen = rows.withWatermark(at, late).groupBy(F.window(at, length, slide)).agg(*[v.alias(k) for k, v in counts.items()])
    out_rows = seen.select(F.col("window.start").alias("start"), *counts)
    run(out_rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))


class FreshUrls(StatefulProcessor):
    """Per canonical URL: whether it was served within the horizon. An item is late (published more than the horizon before it was
    fetched), again (its URL is known) or new. A URL is forgotten by a timer, a horizon after its last item was fetched."""

    def __init__(self, horizon_days: int) -> None:
        self.horizon = horizon_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", T.StructType([T.StructField("until", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.known.get()[0] if self.known.exists() else None
        until = held
        for pdf in rows:  # a URL's items of one batch, in parts
            fetched = pdf["fetched_at"].astype("datetime64[ms]").astype("int64")
            late = (fetched - pdf["published_at"].astype("datetime64[ms]").astype("int64")) > self.horizon
            what = late.map({True: "late", False: "again"}).to_numpy(object)
            fine = (~late).to_numpy()
            if fine.any():
                if until is None:
                    what[fine.argmax()] = "new"
                until = max(until or 0, int(fetched[fine].max()) + self.horizon)
            yield pd.DataFrame({"id": pdf["id"].to_list(), "canonical_url": [key[0]] * len(pdf), "what": what.tolist()}, dtype=object)
        if until is not None and until != held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(until)
            self.known.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        yield pd.DataFrame({"id": [], "canonical_url": [], "what": []}, dtype=object)

    def close(self) -> None:
        pass


def stream_late_drop(items: DataFrame, out: str, checkpoint: str, horizon_days: int = 14) -> None:
    """items: id, canonical_url, published_at, fetched_at. (id, canonical_url, what) by ``what``: new items, and beside them those that
    were dropped (late, again), so that their number is known. Needs the RocksDB state store. Items without either time are late."""
    far = F.lit("1970-01-01").cast("timestamp")
    told = items.select("id", "canonical_url", F.when(F.col("fetched_at").isNull(), far).otherwise(F.coalesce("published_at", far)).alias("published_at"), "fetched_at")
    told = told.withWatermark("fetched_at", "0 seconds").groupBy("canonical_url")
    what = told.transformWithStateInPandas(FreshUrls(horizon_days), "id long, canonical_url string, what string", "append", "eventTime")
    run(what.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("what").outputMode("append"))


def stream_new_since_visit(arrived: DataFrame, visits: str, store: Snapshots, checkpoint: str) -> None:
    """arrived: ingested_at. After each batch the table ``counters`` (user_id, n_new) of the store has, for each reader of the static
    table at ``visits`` (user_id, last_seen_at; read anew in each batch), the articles ingested since the last visit.

    What is kept of the articles is how many came at each instant of ingest, and readers are never paired with articles.
    """
    spark = arrived.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        base = store.state()
        if base["marks"].get("batch", -1) >= number:
            return
        held = store.read("arrivals", ARRIVALS, base["version"] or None)
        here = df.where("ingested_at IS NOT NULL").groupBy(F.col("ingested_at").cast("timestamp").alias("at")).agg(F.count("*").alias("n"))
        arrivals = held.unionByName(here).groupBy("at").agg(F.sum("n").alias("n"))
        readers = spark.read.parquet(visits).select("user_id", F.col("last_seen_at").cast("timestamp").alias("at"))
        store.commit(replace={"arrivals": arrivals, "counters": since_visit(arrivals, readers)}, marks={"batch": number}, base=base)

    run(arrived.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint))


ARRIVALS, COUNTERS = "at timestamp, n long", "user_id long, n_new long"


def since_visit(arrivals: DataFrame, readers: DataFrame) -> DataFrame:
    """arrivals: at, n; readers: user_id, at. (user_id, n_new): what arrived after each reader's instant: within an hour both stand in
    one order, and later hours are added whole."""
    both = arrivals.select(F.lit(None).cast("long").alias("user_id"), "at", "n").unionByName(readers.select(F.col("user_id").cast("long").alias("user_id"), "at", F.lit(0).cast("long").alias("n")))
    both = both.withColumn("hour", F.date_trunc("hour", "at"))
    after = F.sum("n").over(Window.partitionBy("hour").orderBy(F.desc("at"), F.col("user_id").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hours = both.groupBy("hour").agg(F.sum("n").alias("total"))
    later = hours.select("hour", (F.sum("total").over(Window.orderBy(F.desc("hour"))) - F.col("total")).alias("later"))  # a row for each hour
    return both.withColumn("own", after).where("user_id IS NOT NULL").join(later, "hour").select("user_id", (F.col("own") + F.col("later")).alias("n_new"))


class FailureStreak(StatefulProcessor):
    """Per source: failures since the last success; an event when they reach the limit."""

    def __init__(self, limit: int = 5) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("streak", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        events = []
        every = pd.concat([b[["ran_at", "id", "ok"]] for b in rows]).sort_values(["ran_at", "id"])  # three narrow columns of a source's batch
        for ok, at in zip(every["ok"], every["ran_at"]):
            n = 0 if ok else n + 1
            if n == self.limit:
                events.append((int(key[0]), at, int(n)))
        self.count.update((n,))
        yield pd.DataFrame(events, columns=["source_id", "at", "streak"])

    def close(self) -> None:
        pass


def stream_failure_streak(runs: DataFrame, out: str, checkpoint: str, limit: int = 5) -> None:
    """Needs the RocksDB state store; one event each time a source reaches the limit."""
    events = runs.groupBy("source_id").transformWithStateInPandas(FailureStreak(limit), "source_id int, at timestamp, streak long", "append", "none")
    run(events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append"))
