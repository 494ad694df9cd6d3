"""The feed: facets, filters, order, pages, and the statistics around it. Dimensions are joined without hints; Spark
broadcasts them by their measured size."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators import search

#: Categories of articles, in display order.
CATEGORIES = ["model-launch", "model-leak", "tool-launch", "feature-launch", "research-paper", "benchmark", "infra-compute", "deal", "policy", "people", "other"]
SORTS = ["newest", "credibility", "impact"]


@dataclass(frozen=True)
class FeedFilters:
    """A cleaned request: unknown or invalid parts fall back to their defaults."""

    q: str = ""
    categories: tuple[str, ...] = ()
    orgs: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    cred: int = 1
    unread: bool = False
    since: str | None = None
    until: str | None = None
    sort: str = "newest"
    page: int = 1
    extra: dict = field(default_factory=dict, compare=False)

    @classmethod
    def from_params(cls, params: dict) -> FeedFilters:
        def many(name: str) -> tuple[str, ...]:
            given = params.get(name) or []
            given = given if isinstance(given, list) else [given]
            return tuple(dict.fromkeys(x.strip() for v in given for x in str(v).split(",") if x.strip()))

        def number(name: str, default: int, least: int, most: float) -> int:
            try:
                n = int(float(params.get(name, default)))
            except (TypeError, ValueError, OverflowError):
                return default
            return n if least <= n <= most else default

        def day(name: str) -> str | None:
            try:
                return datetime.fromisoformat(str(params.get(name))).isoformat(sep=" ")
            except ValueError:
                return None

        sort = params.get("sort")
        return cls(
            q=str(params.get("q") or "").strip(), categories=tuple(c for c in many("category") if c in CATEGORIES), orgs=many("org"), tags=many("tag"), sources=many("source"),
            cred=number("cred", 1, 1, 5), unread=str(params.get("unread")) in ("1", "true", "True"), since=day("from"), until=day("to"), sort=sort if sort in SORTS else "newest", page=number("page", 1, 1, float("inf")),
        )

    def active(self) -> bool:
        return self != FeedFilters(sort=self.sort, page=self.page)


def feed_where(f: FeedFilters) -> Column:
    """Over articles joined to their source (muted_at, slug): the conjunction of what the request asks for; its text is looked up in
    the search index."""
    tests = [F.col("muted_at").isNull()]
    if f.categories:
        tests.append(F.col("category").isin(*f.categories))
    for name, wanted in (("org_slugs", f.orgs), ("tags", f.tags)):
        if wanted:
            tests.append(F.arrays_overlap(name, F.array(*map(F.lit, wanted))))
    if f.sources:
        tests.append(F.col("slug").isin(*f.sources))
    if f.cred > 1:
        tests.append(F.col("credibility") >= f.cred)
    if f.since:
        tests.append(F.col("published_at") >= F.lit(f.since).cast("timestamp"))
    if f.until:  # a midnight instant: the rest of that day is outside
        tests.append(F.col("published_at") <= F.lit(f.until).cast("timestamp"))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def feed_order(f: FeedFilters) -> list[Column]:
    if f.q:  # a text search is ordered by relevance, whatever else was asked for
        return [F.desc("rank"), F.desc("published_at"), F.asc("id")]
    first = {"newest": [], "credibility": [F.desc("credibility")], "impact": [F.desc("impact")]}[f.sort]
    return [*first, F.desc("published_at"), F.asc("id")]


def feed(articles: DataFrame, sources: DataFrame, reads: DataFrame, saved: DataFrame, user: int, f: FeedFilters, size: int = 60, stories: DataFrame | None = None, index: search.SearchIndex | None = None) -> DataFrame:
    """One page, with the reader's marks and the total of rows before paging. Marks are cut to the reader before the joins.

    stories: story_id, source_count; each row gets its story's count, or null. index: the search index of the articles, for
    a request with a text query; without it the rows that fit otherwise are indexed.
    """
    own = lambda df, mark: df.where(F.col("user_id") == user).select(F.col("article_id").alias("id"), F.lit(True).alias(mark))
    joined = articles.join(sources.select(F.col("id").alias("source_id"), "slug", F.col("name").alias("source_name"), "muted_at"), "source_id")
    found = joined.where(feed_where(f))
    marks = own(reads, "read")
    found = found.join(marks, "id", "left_anti").withColumn("read", F.lit(None).cast("boolean")) if f.unread else found.join(marks, "id", "left")
    if f.q:
        index = search.index(found) if index is None else index
        ranks = search.search_match(index, f.q).join(search.search_rank(index, f.q), "id", "left")
        found = found.join(ranks.select("id", F.col("score").alias("rank")), "id").na.fill(0.0, ["rank"])
    if stories is not None:
        found = found.join(stories.select("story_id", "source_count"), "story_id", "left")
    total = found.agg(F.count("*").alias("total"))
    page = found.join(own(saved, "saved"), "id", "left").orderBy(*feed_order(f)).offset((f.page - 1) * size).limit(size)
    page = page.withColumns({"is_read": F.col("read").isNotNull(), "is_saved": F.col("saved").isNotNull()})
    return page.crossJoin(total)  # a page and one row


def facet(values: DataFrame, by: str, top: int | None = None) -> DataFrame:
    out = values.groupBy(by).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), F.asc(by)).limit(top) if top else out


def facet_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    counts = articles.groupBy("source_id").agg(F.count("id").alias("n"))
    out = sources.where("muted_at IS NULL").join(counts, sources["id"] == counts["source_id"], "left").select("slug", "name", F.coalesce("n", F.lit(0)).alias("n"))
    return out.where("n > 0")


def feed_stats(articles: DataFrame, sources: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    heard = sources.where("muted_at IS NULL").select(F.col("id").alias("source_id"))
    a = articles.join(heard, "source_id").agg(F.count("*").alias("total"), F.count_if(F.col("ingested_at") >= now - F.expr("INTERVAL 24 HOURS")).alias("last_day"), F.count_if("is_rumour").alias("rumours"))
    streak = failure_streak(runs)
    s = sources.join(streak, sources["id"] == streak["source_id"], "left").agg(F.count_if("enabled").alias("active"), F.count_if(F.col("enabled") & (F.coalesce("streak", F.lit(0)) > 0)).alias("failing"))
    return a.crossJoin(runs.agg(F.max("ran_at").alias("last_run"))).crossJoin(s)  # three tables of one row


def failure_streak(runs: DataFrame, limit: int = 5) -> DataFrame:
    """Per source: failures since its last success, and whether they disable it, with the last error as the reason.

    The runs after the last success are found by one aggregate and a join, so no source's runs are sorted in one task.
    """
    last_ok = runs.groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.struct("ran_at", "id"))).alias("last_ok"))
    late = runs.where(~F.col("ok")).join(last_ok, "source_id").where(F.col("last_ok").isNull() | (F.struct("ran_at", "id") > F.col("last_ok")))
    tail = late.groupBy("source_id").agg(F.count("*").alias("streak"), F.max_by("error", F.struct("ran_at", "id")).alias("error"))
    out = last_ok.select("source_id").join(tail, "source_id", "left").select("source_id", F.coalesce("streak", F.lit(0)).alias("streak"), "error")
    off = F.col("streak") >= limit
    return out.select("source_id", "streak", off.alias("disabled"), F.when(off, F.concat(F.col("streak").cast("string"), F.lit(" consecutive failures: "), F.substring("error", 1, 200))).alias("disabled_reason"))


def latest_run(runs: DataFrame) -> DataFrame:
    last = F.struct("ran_at", "id")
    return runs.groupBy("source_id").agg(F.max_by("ok", last).alias("last_ok"), F.max_by("error", last).alias("last_error"), F.max("ran_at").alias("last_ran_at"))


def source_health(sources: DataFrame, articles: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    counts = articles.groupBy("source_id").agg(F.count("*").alias("articles"))
    week = runs.where(F.col("ran_at") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 7 DAYS")).groupBy("source_id").agg(F.sum("items_new").alias("new_7d"))
    out = sources.select(F.col("id").alias("source_id"), "slug", "meta")
    for part in (counts, week, latest_run(runs)):
        out = out.join(part, "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("source_id", "slug", zero("articles"), zero("new_7d"), "last_ok", "last_error", (F.get_json_object("meta", "$.managedBy") == "user").alias("m")).withColumn("managed", F.coalesce("m", F.lit(False))).drop("m")


def reader_counts(state: DataFrame, articles: DataFrame, sources: DataFrame, reads: DataFrame, saved: DataFrame) -> DataFrame:
    """One row for each reader: ingested since the last visit (all, without one), unread and saved, over unmuted sources.

    Readers are never paired with articles: within an hour both are put in one order and articles are counted as they come;
    later hours are added from the hours' totals.
    """
    heard = articles.join(sources.where("muted_at IS NULL").select(F.col("id").alias("source_id")), "source_id").select("id", F.col("ingested_at").cast("timestamp").alias("t"))
    visits = state.select("user_id", F.col("last_seen_at").cast("timestamp").alias("t"))
    both = heard.select(F.lit(None).cast("bigint").alias("user_id"), "t", F.lit(1).alias("one")).unionByName(visits.select("user_id", "t", F.lit(0).alias("one")))
    both = both.withColumn("hour", F.date_trunc("hour", "t"))
    after = F.sum("one").over(Window.partitionBy("hour").orderBy(F.desc("t"), "one").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hours = both.groupBy("hour").agg(F.sum("one").alias("n"))
    later = hours.select("hour", (F.sum("n").over(Window.orderBy(F.desc("hour"))) - F.col("n")).alias("later"))  # a row for each hour
    fresh = both.withColumn("own", after).where("user_id IS NOT NULL").join(later, "hour").select("user_id", (F.col("own") + F.col("later")).alias("fresh"))
    total = heard.agg(F.count("*").alias("total"))
    read = reads.join(heard.select(F.col("id").alias("article_id")), "article_id").groupBy("user_id").agg(F.count("*").alias("n_read"))
    kept = saved.groupBy("user_id").agg(F.count("*").alias("n_saved"))
    readers = state.select("user_id").union(reads.select("user_id")).union(saved.select("user_id")).distinct()
    out = readers.join(fresh, "user_id", "left").join(read, "user_id", "left").join(kept, "user_id", "left").crossJoin(total)
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select("user_id", F.coalesce("fresh", "total").cast("long").alias("new_since_visit"), (F.col("total") - n("n_read")).alias("unread"), n("n_saved").cast("long").alias("saved"))


def retired_listing(tombstones: DataFrame, registry: DataFrame) -> DataFrame:
    known = registry.select("slug", F.lit(True).alias("known"))
    return tombstones.join(known, "slug", "left").select("slug", "retired_at", F.col("known").isNotNull().alias("in_registry"))


def dedupe_by_story(rows: DataFrame, rank: list[Column]) -> DataFrame:
    """The first row of each story in rank order; rows without a story all stay. Only rows with a story are shuffled."""
    cols = rows.columns
    first = rows.where("story_id IS NOT NULL").withColumn("_row", F.row_number().over(Window.partitionBy("story_id").orderBy(*rank))).where("_row = 1").select(cols)
    return rows.where("story_id IS NULL").unionByName(first)


def digest_candidates(articles: DataFrame, sources: DataFrame, end: str, n: int = 25) -> DataFrame:
    stop = F.lit(end).cast("timestamp")
    recent = articles.where((F.col("published_at") >= stop - F.expr("INTERVAL 24 HOURS")) & (F.col("published_at") < stop) & (F.col("credibility") >= 3))
    joined = recent.join(sources.where("muted_at IS NULL").select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    rank = [F.desc("impact"), F.desc("credibility"), F.asc("id")]
    return dedupe_by_story(joined, rank).orderBy(*rank).limit(n)


def digest_fallback(candidates: DataFrame, top: int = 8) -> DataFrame:
    """One row: the title and the markdown of the brief that needs no model."""
    rank = [F.desc("impact"), F.desc("credibility"), F.asc("id")]
    best = candidates.orderBy(*rank).limit(top)
    part = F.concat(F.lit("### "), "title", F.lit("\n\n"), F.coalesce(F.substring("summary", 1, 240), F.lit("")), F.lit("\n\n- ["), "source_name", F.lit("]("), "url", F.lit(") — credibility "), F.col("credibility").cast("string"), F.lit("/5"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("impact")).alias("a"), (-F.col("credibility")).alias("b"), "id", part.alias("part"))))
    out = best.agg(F.count("*").alias("n"), parts.alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["part"]), "\n\n")
    return out.select(
        F.concat(F.col("n").cast("string"), F.lit(" things worth knowing")).alias("title"),
        F.concat(F.lit("_Generated without a model — ranked by impact score._\n\n"), body).alias("body_markdown"),
        F.array_join(F.transform("p", lambda x: x["id"].cast("string")), ",").alias("article_ids"),
    )
