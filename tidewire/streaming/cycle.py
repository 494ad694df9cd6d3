"""The ingest cycle as a stream that commits: each micro-batch of landed items is one cycle, and its tables appear together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import models as M
from tidewire.operators import jobs as J
from tidewire.operators.shared import stage
from tidewire.operators.snapshots import Snapshots
from tidewire.operators.stories import story_outlets

MAX_FAILURES = 5

REASONS = "array<struct<rule: string, delta: int, detail: string>>"
ARTICLES = (
    "id long, canonical_url string, url string, title string, summary string, author string, publisher_domain string, source_id int, base_credibility int, published_at timestamp, category string, "
    f"org_slugs array<string>, tags array<string>, credibility int, reasons {REASONS}, is_rumour boolean, impact int, corroboration_count int, story_id long, v array<float>, model string"
)
DUPLICATES = "id long, article_id long, source_id int, url string, publisher_domain string"
MEMBERS = "id long, story_id long"
SCORES = f"id long, corroboration_count int, credibility int, reasons {REASONS}, is_rumour boolean, cycle long"
RUNS = "source_id int, ran_at timestamp, ok boolean, items_seen long, items_new long, items_duplicate long, pre_filtered long, error string"
SOURCE_STATE = "source_id int, last_polled_at timestamp, consecutive_failures int, enabled boolean, disabled_reason string"


def as_of_schema(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, cast to it; those that are missing are null."""
    from pyspark.sql import types as T

    fields = T._parse_datatype_string(schema).fields
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def read_articles(store: Snapshots, version: int | None = None) -> DataFrame:
    """The articles with the scores of the last cycle that changed them, and their story."""
    latest = store.read("scores", SCORES, version).groupBy("id").agg(F.max_by(F.struct("corroboration_count", "credibility", "reasons", "is_rumour"), F.struct("cycle", "corroboration_count")).alias("now"))
    a = store.read("articles", ARTICLES, version).join(latest, "id", "left")
    changed = ["corroboration_count", "credibility", "reasons", "is_rumour"]
    a = a.withColumns({c: F.when(F.col("now").isNotNull(), F.col("now")[c]).otherwise(F.col(c)) for c in changed}).drop("now", "story_id")
    return a.join(store.read("members", MEMBERS, version), "id", "left")


def corroborated(articles: DataFrame, duplicates: DataFrame, touched: DataFrame) -> DataFrame:
    """touched: id. (id, corroboration_count, credibility, reasons, is_rumour): counted anew from all duplicates and the story, and scored
    with the count."""
    own = articles.join(touched.select("id").distinct(), "id", "left_semi")
    outlets = story_outlets(articles.where("story_id IS NOT NULL"), duplicates)
    counts = J.recompute_corroboration(own, duplicates.join(own.select(F.col("id").alias("article_id")), "article_id", "left_semi"), outlets)
    c = F.col
    again = own.drop("corroboration_count").join(counts, "id").withColumn("scored", J.score_credibility_of(c("corroboration_count")))
    return again.select("id", "corroboration_count", c("scored.score").alias("credibility"), c("scored.reasons").alias("reasons"), c("scored.is_rumour").alias("is_rumour"))


def source_state(held: DataFrame, polls: DataFrame, now: str, limit: int = MAX_FAILURES) -> DataFrame:
    """polls: source_id, ok, error. A success clears failures and the reason; at ``limit`` failures in a row a source is switched off,
    with the number and the first 200 characters of the last error as the reason. Sources not polled stay as they are."""
    c = F.col
    both = held.withColumn("held", F.lit(True)).join(polls.select("source_id", "ok", "error"), "source_id", "full_outer")
    failures = F.when(c("ok").isNull(), c("consecutive_failures")).when(c("ok"), 0).otherwise(F.coalesce("consecutive_failures", F.lit(0)) + 1)
    off = (~c("ok")) & (failures >= limit)
    reason = F.concat(failures.cast("string"), F.lit(" consecutive failures: "), F.substring(F.coalesce("error", F.lit("")), 1, 200))
    return both.select(
        "source_id", F.when(c("ok").isNull(), c("last_polled_at")).otherwise(F.lit(now).cast("timestamp")).alias("last_polled_at"), failures.cast("int").alias("consecutive_failures"),
        F.when(off, False).otherwise(F.coalesce("enabled", F.lit(True))).alias("enabled"), F.when(off, reason).when(c("ok"), None).otherwise(c("disabled_reason")).alias("disabled_reason"),
    )


def run_cycle(store: Snapshots, landed: DataFrame, cycle: int, embedder: Callable = M.hashing_embedder, limit: int = MAX_FAILURES, **more) -> bool:
    """landed: items as for ``ingest_batch``, with fetched_at, and error: a row with an error is a failed poll of its source and no
    item. One cycle at the time of its latest fetch: what is new is written to articles, duplicates, scores (of articles that got
    duplicates), runs and source_state, in one version. False if the cycle was committed before."""
    base = store.state()
    if base["marks"].get("cycle", -1) >= cycle:
        return False
    landed = stage(landed)
    now = landed.agg(F.max("fetched_at").cast("string")).head()[0]
    if now is None:  # nothing has landed
        return False
    items = landed.where("error IS NULL").drop("error", "fetched_at")
    polls = landed.groupBy("source_id").agg(F.bool_or(F.col("error").isNull()).alias("ok"), F.max("error").alias("error"))
    polls = stage(polls.withColumn("error", F.when(~F.col("ok"), F.col("error"))))

    articles, duplicates = read_articles(store, base["version"] or None), store.read("duplicates", DUPLICATES, base["version"] or None)
    inserted, again, log = J.ingest_batch(items, articles, duplicates, now, embedder, **more)
    inserted = stage(as_of_schema(inserted.withColumn("corroboration_count", F.col("corroboration")), ARTICLES))
    again = stage(as_of_schema(again, DUPLICATES))
    everything, twice = articles.unionByName(inserted), duplicates.unionByName(again)
    scores = corroborated(everything, twice, again.select(F.col("article_id").alias("id"))).withColumn("cycle", F.lit(cycle).cast("long"))
    runs = polls.join(log, "source_id", "left").na.fill(0).withColumn("ran_at", F.lit(now).cast("timestamp"))
    runs = runs.withColumn("error", F.substring("error", 1, 500))
    state = source_state(store.read("source_state", SOURCE_STATE, base["version"] or None), polls, now, limit)
    append = {"articles": inserted, "duplicates": again, "scores": as_of_schema(scores, SCORES), "runs": as_of_schema(runs, RUNS)}
    store.commit(append, {"source_state": as_of_schema(state, SOURCE_STATE)}, {"cycle": cycle}, base)
    return True


STORIES = (
    "story_id long, headline string, summary string, category string, first_seen timestamp, last_updated timestamp, article_count long, source_count long, top_credibility int, max_impact int, "
    "org_slugs array<string>, tags array<string>, centroid array<double>, embedding_model string, clustered_by string"
)


def run_clusters(store: Snapshots, as_of: str, days: int = J.STORY_DAYS, **how) -> None:
    """Make the stories of the last days anew and write members, stories and scores in one version. Stories last updated before
    the window stay, and so do the stories of articles published before it."""
    base = store.state()
    version = base["version"] or None
    articles, duplicates = read_articles(store, version), store.read("duplicates", DUPLICATES, version)
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    out = J.cluster_cycle(articles, duplicates, as_of, days, **how)
    settled = articles.where((F.col("published_at") < since) & F.col("story_id").isNotNull()).select("id", "story_id")
    stories = store.read("stories", STORIES, version).where(F.col("last_updated") < since).unionByName(as_of_schema(out["stories"], STORIES))
    scores = as_of_schema(out["scores"].withColumn("cycle", F.lit(base["marks"].get("cycle", 0))), SCORES)
    store.commit({"scores": scores}, {"members": as_of_schema(settled.unionByName(out["members"]), MEMBERS), "stories": stories}, base=base)


def stream_cycles(landed: DataFrame, store: Snapshots, checkpoint: str, **more) -> None:
    """Every micro-batch is a cycle under the batch's number. A batch that is run again after its version was committed does nothing,
    and one that was lost before is worked out anew from the same version, so nothing is doubled or half there."""

    def batch(df: DataFrame, number: int) -> None:
        run_cycle(store, df, number, **more)

    landed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
