"""Queries over the article views that SQL can express directly."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.stemmer import FOURTH, IRREGULAR, SECOND, STOP_WORDS, THIRD, lexeme
from tidewire.operators import feed as fd
from tidewire.operators import sketches as K
from tidewire.operators import state as st
from tidewire.operators.shared import new_folder
from tidewire.operators.snapshots import Snapshots
from tidewire.operators.stories import outlet
from tidewire.plans.registry import query
from tidewire.sources.views import AS_OF, ctes, view

NOW = f"TIMESTAMP '{AS_OF}'"
HEARD = "articles a JOIN sources s ON s.id = a.source_id AND s.muted_at IS NULL"


def text_times(df: DataFrame, *cols: str) -> DataFrame:
    """Instants as text, so that results do not depend on the reader's zone."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def with_labels(spark: SparkSession, d: str) -> DataFrame:
    """Articles with their org_slugs and tags as arrays, in order."""
    by = view(spark, d, "labels_of_articles").groupBy(F.col("article_id").alias("id"))
    arrays = by.agg(F.sort_array(F.collect_set("org_slug")).alias("org_slugs"), F.sort_array(F.collect_set("tag")).alias("tags"))
    return view(spark, d, "articles").join(arrays, "id", "left")


@query("facet_category", ctes("articles") + "SELECT category, count(*) AS n FROM articles GROUP BY 1")
def facet_category(spark: SparkSession, d: str) -> DataFrame:
    return fd.facet(view(spark, d, "articles"), "category")


@query("facet_org", ctes("labels_of_articles") + "SELECT org_slug, count(*) AS n FROM labels_of_articles GROUP BY 1")
def facet_org(spark: SparkSession, d: str) -> DataFrame:
    return fd.facet(with_labels_exploded(spark, d, "org_slugs").withColumnRenamed("value", "org_slug"), "org_slug")


def with_labels_exploded(spark: SparkSession, d: str, what: str) -> DataFrame:
    column = {"org_slugs": "org_slug", "tags": "tag"}[what]
    arrays = view(spark, d, "labels_of_articles").groupBy("article_id").agg(F.collect_list(column).alias(what))
    return arrays.select(F.explode(what).alias("value"))


@query("facet_tag", ctes("labels_of_articles") + "SELECT tag, count(*) AS n FROM labels_of_articles GROUP BY 1 ORDER BY n DESC, tag LIMIT 30")
def facet_tag(spark: SparkSession, d: str) -> DataFrame:
    return fd.facet(view(spark, d, "labels_of_articles"), "tag", 30)


@query("facet_top_n", ctes("labels_of_articles") + "SELECT * FROM (SELECT 'org' AS rail, org_slug AS value, count(*) AS n FROM labels_of_articles GROUP BY 2 ORDER BY n DESC, value LIMIT 16) UNION ALL SELECT * FROM (SELECT 'tag' AS rail, tag AS value, count(*) AS n FROM labels_of_articles GROUP BY 2 ORDER BY n DESC, value LIMIT 22)")
def facet_top_n(spark: SparkSession, d: str) -> DataFrame:
    labels = view(spark, d, "labels_of_articles")
    rail = lambda name, c, n: fd.facet(labels, c, n).select(F.lit(name).alias("rail"), F.col(c).alias("value"), "n")
    return rail("org", "org_slug", 16).unionByName(rail("tag", "tag", 22))


@query("facet_tag_approximate", ctes("articles", "labels_of_articles") + "SELECT tag, count(*) AS n FROM labels_of_articles l JOIN articles a ON a.id = l.article_id WHERE a.published_at >= TIMESTAMP '2024-01-05 00:00:00' AND a.published_at < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1 ORDER BY n DESC, tag LIMIT 30")
def facet_tag_approximate(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent tags of fifteen days from the days' sketches, which hold all of the few tags."""
    return K.most_frequent(K.days(spark, day_sketches(spark, d), "2024-01-05", "2024-01-20"), 30).select(F.col("value").alias("tag"), "n")


@query("outlet_count_approximate", ctes("articles") + "SELECT source_id % 4 AS g, count(DISTINCT coalesce(publisher_domain, CAST(source_id AS VARCHAR))) AS outlets FROM articles WHERE published_at >= TIMESTAMP '2024-01-05 00:00:00' AND published_at < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def outlet_count_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Distinct outlets of groups of sources over the same days; sketches of few values are exact."""
    own = K.days(spark, day_sketches(spark, d), "2024-01-05", "2024-01-20")
    return K.distinct_counts(own, ["g"]).select("g", F.col("n").alias("outlets"))


def day_sketches(spark: SparkSession, d: str) -> str:
    a = view(spark, d, "articles").select("id", "published_at", (F.col("source_id") % 4).alias("g"), outlet().alias("outlet"))
    rows = a.join(view(spark, d, "labels_of_articles").select(F.col("article_id").alias("id"), "tag"), "id")
    folder = new_folder(spark, "day-sketches")
    K.write_days(rows, folder, "published_at", "tag", "outlet", ["g"])
    return folder


@query("facet_source", ctes("articles", "sources") + "SELECT s.slug, s.name, count(a.id) AS n FROM sources s LEFT JOIN articles a ON a.source_id = s.id WHERE s.muted_at IS NULL GROUP BY 1, 2 HAVING count(a.id) > 0")
def facet_source(spark: SparkSession, d: str) -> DataFrame:
    return fd.facet_source(view(spark, d, "articles"), view(spark, d, "sources"))


STREAK = """lastok AS (SELECT source_id, max(CASE WHEN ok THEN ran_at END) AS t FROM ingest_runs GROUP BY 1),
lastid AS (SELECT r.source_id, max(r.id) AS i FROM ingest_runs r JOIN lastok l ON l.source_id = r.source_id AND l.t = r.ran_at WHERE r.ok GROUP BY 1),
tail AS (SELECT r.* FROM ingest_runs r JOIN lastok l USING (source_id) LEFT JOIN lastid i USING (source_id) WHERE NOT r.ok AND (l.t IS NULL OR r.ran_at > l.t OR (r.ran_at = l.t AND r.id > i.i))),
streaks AS (SELECT l.source_id, count(t.id) AS streak, arg_max(t.error, (t.ran_at, t.id)) AS error FROM lastok l LEFT JOIN tail t USING (source_id) GROUP BY 1) """


@query("feed_stats", ctes("articles", "sources", "ingest_runs").rstrip() + ", " + STREAK + f"""SELECT (SELECT count(*) FROM {HEARD}) AS total, (SELECT count(*) FROM {HEARD} WHERE a.ingested_at >= {NOW} - INTERVAL 24 HOUR) AS last_day,
(SELECT count(*) FROM {HEARD} WHERE a.is_rumour) AS rumours, (SELECT CAST(max(ran_at) AS VARCHAR) FROM ingest_runs) AS last_run, (SELECT count(*) FROM sources WHERE enabled) AS active,
(SELECT count(*) FROM sources s JOIN streaks k ON k.source_id = s.id WHERE s.enabled AND k.streak > 0) AS failing""")
def feed_stats(spark: SparkSession, d: str) -> DataFrame:
    return text_times(fd.feed_stats(view(spark, d, "articles"), view(spark, d, "sources"), view(spark, d, "ingest_runs"), AS_OF), "last_run")


@query("failure_streak", ctes("ingest_runs").rstrip() + ", " + STREAK + "SELECT source_id, streak, streak >= 5 AS disabled, CASE WHEN streak >= 5 THEN concat(streak, ' consecutive failures: ', substr(error, 1, 200)) END AS disabled_reason FROM streaks")
def failure_streak(spark: SparkSession, d: str) -> DataFrame:
    return fd.failure_streak(view(spark, d, "ingest_runs"))


@query("latest_run", ctes("ingest_runs") + "SELECT source_id, ok AS last_ok, error AS last_error, CAST(ran_at AS VARCHAR) AS last_ran_at FROM ingest_runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ran_at DESC, id DESC) = 1")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return text_times(fd.latest_run(view(spark, d, "ingest_runs")), "last_ran_at")


@query("source_health", ctes("articles", "sources", "ingest_runs") + f"""SELECT s.id AS source_id, s.slug, coalesce(c.n, 0) AS articles, CAST(coalesce(w.n, 0) AS BIGINT) AS new_7d, l.ok AS last_ok, l.error AS last_error, s.meta LIKE '%"managedBy":"user"%' AS managed
FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM articles GROUP BY 1) c ON c.source_id = s.id
LEFT JOIN (SELECT source_id, sum(items_new) AS n FROM ingest_runs WHERE ran_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1) w ON w.source_id = s.id
LEFT JOIN (SELECT * FROM ingest_runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ran_at DESC, id DESC) = 1) l ON l.source_id = s.id""")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    return fd.source_health(view(spark, d, "sources"), view(spark, d, "articles"), view(spark, d, "ingest_runs"), AS_OF)


@query("source_page_counts", ctes("articles", "sources", "ingest_runs").rstrip() + ", " + STREAK + """SELECT s.category, CASE s.category WHEN 'first_party' THEN 1 WHEN 'press' THEN 2 WHEN 'community' THEN 3 ELSE 4 END AS place, count(*) FILTER (WHERE s.enabled) AS enabled, count(*) FILTER (WHERE k.streak > 0) AS failing,
count(*) FILTER (WHERE s.muted_at IS NOT NULL) AS muted, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM articles a WHERE a.source_id = s.id)) AS contributing FROM sources s LEFT JOIN streaks k ON k.source_id = s.id GROUP BY 1""")
def source_page_counts(spark: SparkSession, d: str) -> DataFrame:
    s, streak = view(spark, d, "sources"), fd.failure_streak(view(spark, d, "ingest_runs")).select(F.col("source_id").alias("id"), "streak")
    has = view(spark, d, "articles").groupBy(F.col("source_id").alias("id")).agg(F.lit(True).alias("has"))
    place = F.when(F.col("category") == "first_party", 1).when(F.col("category") == "press", 2).when(F.col("category") == "community", 3).otherwise(4)
    out = s.join(streak, "id", "left").join(has, "id", "left").groupBy("category", place.alias("place"))
    return out.agg(F.count_if("enabled").alias("enabled"), F.count_if(F.col("streak") > 0).alias("failing"), F.count_if(F.col("muted_at").isNotNull()).alias("muted"), F.count_if("has").alias("contributing"))


READERS = "SELECT user_id FROM reader_state UNION SELECT user_id FROM article_reads UNION SELECT user_id FROM saved_articles"


@query("reader_counts", ctes("articles", "sources", "article_reads", "saved_articles", "reader_state").rstrip() + f""", heard AS (SELECT a.* FROM {HEARD}), readers AS ({READERS})
SELECT r.user_id, (SELECT count(*) FROM heard h WHERE t.last_seen_at IS NULL OR h.ingested_at > t.last_seen_at) AS new_since_visit,
(SELECT count(*) FROM heard) - (SELECT count(*) FROM article_reads x JOIN heard h ON h.id = x.article_id WHERE x.user_id = r.user_id) AS unread,
(SELECT count(*) FROM saved_articles x WHERE x.user_id = r.user_id) AS saved FROM readers r LEFT JOIN reader_state t ON t.user_id = r.user_id""")
def reader_counts(spark: SparkSession, d: str) -> DataFrame:
    return fd.reader_counts(*[view(spark, d, n) for n in ("reader_state", "articles", "sources", "article_reads", "saved_articles")])


@query("new_since_visit", ctes("articles", "sources", "reader_state") + f"SELECT t.user_id, (SELECT count(*) FROM {HEARD} WHERE a.ingested_at > t.last_seen_at) AS n_new FROM reader_state t")
def new_since_visit(spark: SparkSession, d: str) -> DataFrame:
    counts = fd.reader_counts(*[view(spark, d, n) for n in ("reader_state", "articles", "sources", "article_reads", "saved_articles")])
    return counts.join(view(spark, d, "reader_state").select("user_id"), "user_id", "left_semi").select("user_id", F.col("new_since_visit").alias("n_new"))


@query("outlet_count", ctes("articles") + "SELECT story_id, count(DISTINCT coalesce(publisher_domain, CAST(source_id AS VARCHAR))) AS outlets FROM articles WHERE story_id IS NOT NULL GROUP BY 1")
def outlet_count(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "articles").where("story_id IS NOT NULL")
    return a.groupBy("story_id").agg(F.countDistinct(F.coalesce("publisher_domain", F.col("source_id").cast("string"))).alias("outlets"))


@query("story_outlets", ctes("articles", "article_duplicates") + """SELECT story_id, count(DISTINCT o) AS outlets FROM (SELECT story_id, coalesce(publisher_domain, CAST(source_id AS VARCHAR)) AS o FROM articles WHERE story_id IS NOT NULL
UNION SELECT a.story_id, coalesce(x.publisher_domain, CAST(x.source_id AS VARCHAR)) FROM article_duplicates x JOIN articles a ON a.id = x.article_id WHERE a.story_id IS NOT NULL) GROUP BY 1""")
def story_outlets(spark: SparkSession, d: str) -> DataFrame:
    from tidewire.operators.stories import story_outlets as op

    return op(view(spark, d, "articles"), view(spark, d, "article_duplicates"))


@query("pending_enrichment", ctes("articles", "sources") + "SELECT a.id, a.title, CAST(a.published_at AS VARCHAR) AS published_at FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.enriched_by = 'heuristic' AND s.kind NOT IN ('arxiv') ORDER BY a.published_at DESC, a.id LIMIT 40")
def pending_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return text_times(pending(spark, d).orderBy(F.desc("published_at"), "id").limit(40).select("id", "title", "published_at"), "published_at")


def pending(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "sources").where("kind NOT IN ('arxiv')").select(F.col("id").alias("source_id"))
    return view(spark, d, "articles").where("enriched_by = 'heuristic'").join(s, "source_id")


@query("pending_count", ctes("articles", "sources") + "SELECT count(*) AS n FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.enriched_by = 'heuristic' AND s.kind NOT IN ('arxiv')")
def pending_count(spark: SparkSession, d: str) -> DataFrame:
    return pending(spark, d).agg(F.count("*").alias("n"))


@query("needs_embedding", ctes("articles") + "SELECT a.id, CAST(a.published_at AS VARCHAR) AS published_at FROM articles a LEFT JOIN embeddings e ON e.vec_id = a.id WHERE e.embedding IS NULL OR CASE WHEN e.label % 3 <> 0 THEN 'hash-64' END IS DISTINCT FROM 'hash-64'")
def needs_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("label") % 3 != 0, "hash-64").alias("model"))
    out = view(spark, d, "articles").join(e, "id", "left").where(F.col("embedding").isNull() | ~F.col("model").eqNullSafe("hash-64"))
    return text_times(out.select("id", "published_at"), "published_at")


@query("due_sources", ctes("sources") + f"SELECT id, slug FROM sources WHERE enabled AND (last_polled_at IS NULL OR date_diff('second', last_polled_at, {NOW}) >= poll_minutes * 60)")
def due_sources(spark: SparkSession, d: str) -> DataFrame:
    return st.due_sources(view(spark, d, "sources"), AS_OF).select("id", "slug")


@query("feed", ctes("articles", "sources", "labels_of_articles", "article_reads", "saved_articles") + """, found AS (SELECT a.*, s.name AS source_name FROM articles a JOIN sources s ON s.id = a.source_id WHERE s.muted_at IS NULL AND a.category IN ('model-launch', 'deal', 'policy') AND a.credibility >= 2
AND EXISTS (SELECT 1 FROM labels_of_articles l WHERE l.article_id = a.id AND l.org_slug IN ('org1', 'org2', 'org4')) AND a.published_at >= TIMESTAMP '2024-01-03 00:00:00' AND a.published_at <= TIMESTAMP '2024-01-29 00:00:00')
SELECT id, title, source_name, credibility, impact, CAST(published_at AS VARCHAR) AS published_at, id IN (SELECT article_id FROM article_reads WHERE user_id = 7) AS is_read, id IN (SELECT article_id FROM saved_articles WHERE user_id = 7) AS is_saved, (SELECT count(*) FROM found) AS total
FROM found ORDER BY impact DESC, published_at DESC, id LIMIT 60""".replace(", found", ", found", 1))
def feed(spark: SparkSession, d: str) -> DataFrame:
    f = fd.FeedFilters.from_params({"category": "model-launch,deal,policy,nonsense", "org": ["org1", "org2", "org4"], "cred": "2", "from": "2024-01-03", "to": "2024-01-29", "sort": "impact"})
    out = fd.feed(with_labels(spark, d), view(spark, d, "sources"), view(spark, d, "article_reads"), view(spark, d, "saved_articles"), 7, f)
    return text_times(out.select("id", "title", "source_name", "credibility", "impact", "published_at", "is_read", "is_saved", "total"), "published_at")


#: Endings of the invented prose; with the stemmer they give the word forms that count as one token on the SQL side.
ENDINGS = "s es ed er ers ing ly ment ate ates ated ating ation ness able ible al ance ence ic ism ous ive ize ful e edly ingly erly".split()
STOPPED = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


def forms(token: str) -> str:
    own = {token + a + b for a in ["", *ENDINGS] for b in ["", *ENDINGS] if lexeme(token + a + b) == token}
    return ", ".join(f"'{w}'" for w in sorted(own))


def every_form(token: str) -> str:
    """All words whose stem is the token: the stemmer's steps taken back one after another, then held against the stemmer."""

    def back(words: set[str], endings: Iterable[tuple[str, str]]) -> set[str]:
        return {w[: len(w) - len(to)] + of for w in words for of, to in endings if w.endswith(to)}

    own = {token}
    for step in ([("e", ""), ("ll", "l")], [(of, "") for of in FOURTH], THIRD.items(), SECOND.items(), [("y", "i")]):
        own |= back(own, step)
    cut = own | back(own, [("", "e"), *[(c + c, c) for c in "bdfgmnprt"]])
    own |= back(cut, [("ed", ""), ("ing", ""), ("edly", ""), ("ingly", "")]) | back(own, [("eed", "ee"), ("eedly", "ee")])
    own |= back(own, [("s", ""), ("sses", "ss"), ("ies", "i"), ("ied", "i"), ("ies", "ie"), ("ied", "ie")]) | IRREGULAR.keys()
    return ", ".join(f"'{w}'" for w in sorted(own) if lexeme(w) == token)


def indexed(rows: str, *tokens: str, forms: Callable[[str], str] = forms) -> str:
    """CTEs: k, the places of the words that are no stop words (id, t = 1 in titles, word, pos); x, those of the tokens."""
    split = "list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    which = " ".join(f"WHEN word IN ({forms(t)}) THEN '{t}'" for t in tokens)
    return f""", l AS (SELECT id, {split.format(c='title')} AS a, {split.format(c='summary')} AS b FROM {rows}),
kept AS (SELECT * FROM (SELECT id, 1 AS t, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS pos FROM l UNION ALL SELECT id, 0, unnest(b), unnest(range(1, len(b) + 1)) FROM l) WHERE word NOT IN ({STOPPED})),
k AS (SELECT id, t, word, CASE WHEN t = 1 THEN pos ELSE pos + coalesce(n, 0) END AS pos FROM kept LEFT JOIN (SELECT id, max(pos) AS n FROM kept WHERE t = 1 GROUP BY 1) USING (id)),
x AS MATERIALIZED (SELECT * FROM (SELECT id, t, pos, CASE {which} END AS token FROM k) WHERE token IS NOT NULL)"""


def ranked(rows: str, *tokens: str) -> str:
    """CTE r: id and the rank by the tokens' BM25 over the given rows."""
    named = ", ".join(f"'{t}'" for t in tokens)
    return f""", lg AS (SELECT r.id, coalesce(s.len, 0) AS len FROM {rows} r LEFT JOIN (SELECT id, sum(CASE WHEN t = 1 THEN 1.0::DOUBLE ELSE 0.4 END) AS len FROM k GROUP BY 1) s USING (id)), g AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lg),
o AS (SELECT id, token, sum(CASE WHEN t = 1 THEN 1.0::DOUBLE ELSE 0.4 END) AS tf FROM x WHERE token IN ({named}) GROUP BY 1, 2), fr AS (SELECT token, count(*) AS df FROM o GROUP BY 1),
r AS (SELECT o.id, sum(ln(1 + (g.n - fr.df + 0.5) / (fr.df + 0.5)) * o.tf * 2.2 / (o.tf + 1.2 * (0.25 + 0.75 * lg.len / g.avg_len))) AS rank FROM o JOIN fr USING (token) JOIN lg USING (id), g GROUP BY 1)"""


FOUND = ", fit AS (SELECT a.*, s.name AS source_name FROM articles a JOIN sources s ON s.id = a.source_id WHERE s.muted_at IS NULL AND a.credibility >= 2)" + indexed("fit", "anan", "ther") + """,
found AS (SELECT * FROM fit WHERE id IN (SELECT id FROM x WHERE token = 'anan') AND id IN (SELECT id FROM x WHERE token = 'ther'))""" + ranked("fit", "anan", "ther") + """
SELECT id, round(rank, 6) AS rank, (SELECT count(DISTINCT coalesce(x.publisher_domain, CAST(x.source_id AS VARCHAR))) FROM articles x WHERE x.story_id = found.story_id) AS story_sources, (SELECT count(*) FROM found) AS total FROM found JOIN r USING (id)"""


@query("feed_search", ctes("articles", "sources").rstrip() + FOUND)
def feed_search(spark: SparkSession, d: str) -> DataFrame:
    """A text request: every page's rows by relevance, with the number of outlets of their story."""
    a = view(spark, d, "articles")
    stories = a.where("story_id IS NOT NULL").groupBy("story_id").agg(F.countDistinct(outlet()).alias("source_count"))
    f = fd.FeedFilters.from_params({"q": "with anan ther", "cred": "2"})
    out = fd.feed(a, view(spark, d, "sources"), view(spark, d, "article_reads"), view(spark, d, "saved_articles"), 7, f, size=2_000_000_000, stories=stories)
    return out.select("id", F.round("rank", 6).alias("rank"), F.coalesce("source_count", F.lit(0)).alias("story_sources"), "total")


@query("mark_all_read", ctes("articles", "article_reads") + "SELECT user_id, article_id, CAST(read_at AS VARCHAR) AS read_at FROM article_reads UNION ALL SELECT 7, id, '2024-01-31 00:00:00' FROM articles WHERE id NOT IN (SELECT article_id FROM article_reads WHERE user_id = 7)")
def mark_all_read(spark: SparkSession, d: str) -> DataFrame:
    reads = view(spark, d, "article_reads").withColumn("read_at", F.col("read_at").cast("timestamp"))
    return text_times(st.mark_all_read(reads, view(spark, d, "articles"), 7, AS_OF), "read_at")


@query("cycle_summary", ctes("ingest_runs") + "SELECT count(*) AS polled, CAST(sum(items_new) AS BIGINT) AS inserted, CAST(sum(items_new % 3) AS BIGINT) AS duplicates, CAST(sum(items_new % 5) AS BIGINT) AS pre_filtered, count(*) FILTER (WHERE NOT ok) AS failed FROM ingest_runs")
def cycle_summary(spark: SparkSession, d: str) -> DataFrame:
    return st.cycle_summary(view(spark, d, "ingest_runs").withColumns({"items_duplicate": F.col("items_new") % 3, "pre_filtered": F.col("items_new") % 5}))


@query("json_merge", ctes("sources") + "SELECT slug, '{\"managedBy\":\"user\"}' AS meta FROM sources")
def json_merge(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "sources").select("slug", st.json_merge(F.col("meta"), "managedBy", "user").alias("meta"))


@query("reasons_json", ctes("articles") + "SELECT id, 'source' AS rule, credibility AS delta, title AS detail FROM articles")
def reasons_json(spark: SparkSession, d: str) -> DataFrame:
    """What is stored as text comes back as it was."""
    made = F.array(F.struct(F.lit("source").alias("rule"), F.col("credibility").alias("delta"), F.col("title").alias("detail")))
    back = view(spark, d, "articles").select("id", st.reasons_from_json(st.reasons_to_json(made)).alias("r"))
    return back.select("id", F.explode("r").alias("r")).select("id", "r.rule", "r.delta", "r.detail")


@query("rebuild_overwrite", ctes("articles") + "SELECT story_id, CAST(last_updated AS VARCHAR) AS last_updated, CASE WHEN last_updated < TIMESTAMP '2024-01-24 00:00:00' THEN 'old' ELSE 'new' END AS made FROM (SELECT story_id, max(published_at) AS last_updated FROM articles WHERE story_id IS NOT NULL GROUP BY 1)")
def rebuild_overwrite(spark: SparkSession, d: str) -> DataFrame:
    stories = view(spark, d, "articles").where("story_id IS NOT NULL").groupBy("story_id").agg(F.max("published_at").cast("timestamp").alias("last_updated"))
    since = "2024-01-24 00:00:00"
    rebuilt = stories.where(F.col("last_updated") >= F.lit(since).cast("timestamp")).withColumn("made", F.lit("new"))
    store = Snapshots(spark, new_folder(spark, "stories"))
    store.commit(replace={"stories": stories.withColumn("made", F.lit("old"))})
    st.rebuild_overwrite(store, "stories", rebuilt, "last_updated", since)
    return text_times(store.read("stories", rebuilt.schema), "last_updated")


@query("top_stories", ctes("articles") + "SELECT story_id, count(DISTINCT coalesce(publisher_domain, CAST(source_id AS VARCHAR))) AS source_count, CAST(max(published_at) AS VARCHAR) AS last_updated FROM articles WHERE story_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10")
def top_stories(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "articles").where("story_id IS NOT NULL")
    out = a.groupBy("story_id").agg(F.countDistinct(F.coalesce("publisher_domain", F.col("source_id").cast("string"))).alias("source_count"), F.max("published_at").cast("string").alias("last_updated"))
    return out.orderBy(F.desc("source_count"), F.desc("last_updated"), "story_id").limit(10)


@query("dedupe_by_story", ctes("articles") + "SELECT id, story_id FROM articles QUALIFY story_id IS NULL OR row_number() OVER (PARTITION BY story_id ORDER BY impact DESC, credibility DESC, id) = 1")
def dedupe_by_story(spark: SparkSession, d: str) -> DataFrame:
    return fd.dedupe_by_story(view(spark, d, "articles"), [F.desc("impact"), F.desc("credibility"), F.asc("id")]).select("id", "story_id")


CANDIDATES = """joined AS (SELECT a.*, s.name AS source_name FROM articles a JOIN sources s ON s.id = a.source_id WHERE s.muted_at IS NULL AND a.credibility >= 3 AND a.published_at >= TIMESTAMP '2024-01-19 00:00:00' AND a.published_at < TIMESTAMP '2024-01-20 00:00:00'),
candidates AS (SELECT * FROM (SELECT * FROM joined QUALIFY story_id IS NULL OR row_number() OVER (PARTITION BY story_id ORDER BY impact DESC, credibility DESC, id) = 1) ORDER BY impact DESC, credibility DESC, id LIMIT 25) """
DAY_END = "2024-01-20 00:00:00"


@query("digest_candidates", ctes("articles", "sources").rstrip() + ", " + CANDIDATES + "SELECT id, title, impact, credibility, story_id, source_name FROM candidates")
def digest_candidates(spark: SparkSession, d: str) -> DataFrame:
    return fd.digest_candidates(view(spark, d, "articles"), view(spark, d, "sources"), DAY_END).select("id", "title", "impact", "credibility", "story_id", "source_name")


@query("digest_fallback", ctes("articles", "sources").rstrip() + ", " + CANDIDATES + """, best AS (SELECT * FROM candidates ORDER BY impact DESC, credibility DESC, id LIMIT 8)
SELECT concat(count(*), ' things worth knowing') AS title, concat('_Generated without a model — ranked by impact score._', chr(10), chr(10), string_agg(concat('### ', title, chr(10), chr(10), coalesce(substr(summary, 1, 240), ''), chr(10), chr(10), '- [', source_name, '](', url, ') — credibility ', credibility, '/5'), chr(10) || chr(10) ORDER BY impact DESC, credibility DESC, id)) AS body_markdown,
string_agg(CAST(id AS VARCHAR), ',' ORDER BY impact DESC, credibility DESC, id) AS article_ids FROM best""")
def digest_fallback(spark: SparkSession, d: str) -> DataFrame:
    return fd.digest_fallback(fd.digest_candidates(view(spark, d, "articles"), view(spark, d, "sources"), DAY_END))


@query("saved_listing", ctes("articles", "sources", "saved_articles") + "SELECT v.user_id, a.id, a.title, s.name AS source_name, CAST(v.saved_at AS VARCHAR) AS saved_at FROM saved_articles v JOIN articles a ON a.id = v.article_id JOIN sources s ON s.id = a.source_id")
def saved_listing(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    a = view(spark, d, "articles").select("id", "title", "source_id").join(s, "source_id")
    return text_times(view(spark, d, "saved_articles").withColumnRenamed("article_id", "id").join(a, "id").select("user_id", "id", "title", "source_name", "saved_at"), "saved_at")


@query("story_timeline", ctes("articles", "article_duplicates") + """SELECT story_id, 'member' AS role, id, CAST(published_at AS VARCHAR) AS at, row_number() OVER (PARTITION BY story_id ORDER BY published_at, id) AS place FROM articles WHERE story_id IS NOT NULL
UNION ALL SELECT a.story_id, 'duplicate', x.id, CAST(a.published_at AS VARCHAR), row_number() OVER (PARTITION BY a.story_id ORDER BY a.published_at, x.id) FROM article_duplicates x JOIN articles a ON a.id = x.article_id WHERE a.story_id IS NOT NULL""")
def story_timeline(spark: SparkSession, d: str) -> DataFrame:
    from tidewire.operators.stories import story_timeline as op

    return text_times(op(view(spark, d, "articles"), view(spark, d, "article_duplicates")), "at")


@query("insert_ignore", ctes("articles") + "SELECT id, url, origin FROM (SELECT id, url, 'old' AS origin FROM articles WHERE id % 3 = 0 UNION ALL SELECT id, url, 'new' FROM articles WHERE id % 3 <> 0 AND id % 2 = 0)")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "articles").select("id", "url")
    old = a.where("id % 3 = 0").withColumn("origin", F.lit("old"))
    new = a.where("id % 2 = 0").withColumn("origin", F.lit("new"))
    return st.insert_ignore(old, new.unionByName(new), ["url"], [F.asc("id")])


@query("upsert_latest", ctes("reader_state") + "SELECT user_id, CAST(CASE WHEN user_id % 2 = 0 THEN last_seen_at + INTERVAL 1 DAY ELSE last_seen_at END AS VARCHAR) AS last_seen_at FROM reader_state")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    state = view(spark, d, "reader_state")
    moved = state.where("user_id % 2 = 0").withColumn("last_seen_at", F.col("last_seen_at") + F.expr("INTERVAL 1 DAY"))
    return text_times(st.upsert_latest(state.where("user_id % 4 <> 0"), moved, ["user_id"], "last_seen_at"), "last_seen_at")


@query("upsert_protected", ctes("sources") + """SELECT slug, CASE WHEN id % 6 = 0 AND id % 4 <> 3 OR id % 5 = 4 THEN name ELSE concat(name, ' (new)') END AS name, concat('https://', slug, CASE WHEN id % 6 = 0 AND id % 4 <> 3 OR id % 5 = 4 THEN '/old' ELSE '/new' END) AS feed_url, concat('https://', slug, CASE WHEN id % 6 = 0 AND id % 4 <> 3 OR id % 5 = 4 THEN '/home' ELSE '/home/new' END) AS url, CASE WHEN id % 5 = 4 THEN org_slug ELSE concat('org', id % 3) END AS org_slug,
CASE WHEN id % 6 = 0 AND id % 4 <> 3 OR id % 5 = 4 THEN base_credibility ELSE 5 END AS base_credibility, CASE WHEN id % 5 = 4 THEN kind ELSE 'rss' END AS kind, category, CASE WHEN id % 5 = 4 THEN poll_minutes ELSE 15 END AS poll_minutes, CASE WHEN id % 4 = 3 THEN '{}' ELSE meta END AS meta FROM sources WHERE NOT (id % 4 = 3 AND id % 5 = 4)""")
def upsert_protected(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "sources")
    at = lambda path: F.concat(F.lit("https://"), "slug", F.lit(path))
    current = s.where("id % 4 <> 3").withColumns({"feed_url": at("/old"), "url": at("/home")})
    registry = s.select("slug", F.concat("name", F.lit(" (new)")).alias("name"), at("/new").alias("feed_url"), at("/home/new").alias("url"), F.concat(F.lit("org"), (F.col("id") % 3).cast("string")).alias("org_slug"), F.lit(5).alias("base_credibility"), F.lit("rss").alias("kind"), "category", F.lit(15).alias("poll_minutes"), F.lit("{}").alias("meta"))
    return st.upsert_protected(current, registry, s.where("id % 5 = 4").select("slug"))


@query("apply_source_changes", ctes("sources", "ingest_runs") + """, c AS (SELECT source_id, id AS seq, CASE id % 6 WHEN 0 THEN 'enable' WHEN 1 THEN 'disable' WHEN 2 THEN 'mute' WHEN 3 THEN 'unmute' WHEN 4 THEN 'reset' ELSE 'edit' END AS action, ran_at AS at_, concat('Renamed ', id) AS name FROM ingest_runs WHERE source_id % 4 <> 1 AND id % 11 < 3),
e AS (SELECT source_id, arg_max(action, seq) AS action FROM c WHERE action IN ('enable', 'disable') GROUP BY 1), r AS (SELECT DISTINCT source_id FROM c WHERE action IN ('enable', 'reset')), m AS (SELECT source_id, arg_max(action, seq) AS action, arg_max(at_, seq) AS at_ FROM c WHERE action IN ('mute', 'unmute') GROUP BY 1), n AS (SELECT source_id, arg_max(name, seq) AS name, max(seq) AS seq FROM c WHERE action = 'edit' GROUP BY 1)
SELECT s.id, coalesce(n.name, s.name) AS name, CASE WHEN n.seq IS NOT NULL THEN concat('https://e.example.com/', n.seq) ELSE concat('https://f.example.com/', s.id) END AS feed_url, CASE WHEN n.seq IS NOT NULL THEN CAST(1 + n.seq % 5 AS INT) ELSE s.base_credibility END AS base_credibility, CASE WHEN n.seq IS NOT NULL THEN CAST(5 + n.seq % 60 AS INT) ELSE s.poll_minutes END AS poll_minutes,
CASE WHEN n.seq IS NULL THEN s.org_slug WHEN n.seq % 2 = 0 THEN concat('org', n.seq % 9) END AS org_slug, CASE WHEN e.action IS NOT NULL THEN e.action = 'enable' ELSE s.enabled END AS enabled, CASE e.action WHEN 'disable' THEN 'turned off manually' WHEN 'enable' THEN NULL ELSE 'old' END AS disabled_reason, CAST(CASE m.action WHEN 'mute' THEN m.at_ WHEN 'unmute' THEN NULL ELSE s.muted_at END AS VARCHAR) AS muted_at,
CASE WHEN r.source_id IS NOT NULL THEN 0 ELSE 3 END AS consecutive_failures, CASE WHEN n.name IS NOT NULL THEN '{"managedBy":"user"}' ELSE s.meta END AS meta FROM sources s LEFT JOIN e ON e.source_id = s.id LEFT JOIN r ON r.source_id = s.id LEFT JOIN m ON m.source_id = s.id LEFT JOIN n ON n.source_id = s.id""")
def apply_source_changes(spark: SparkSession, d: str) -> DataFrame:
    runs = view(spark, d, "ingest_runs").where("source_id % 4 <> 1 AND id % 11 < 3")
    names = F.array(*map(F.lit, ["enable", "disable", "mute", "unmute", "reset", "edit"]))
    changes = runs.select("source_id", F.col("id").alias("seq"), F.get(names, (F.col("id") % 6).cast("int")).alias("action"), F.col("ran_at").cast("timestamp").alias("at"), F.concat(F.lit("Renamed "), F.col("id").cast("string")).alias("name"),
        F.concat(F.lit("https://e.example.com/"), F.col("id").cast("string")).alias("feed_url"), (1 + F.col("id") % 5).cast("int").alias("base_credibility"), (5 + F.col("id") % 60).cast("int").alias("poll_minutes"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("org"), (F.col("id") % 9).cast("string"))).alias("org_slug"))
    s = view(spark, d, "sources").withColumns({"disabled_reason": F.lit("old"), "consecutive_failures": F.lit(3), "feed_url": F.concat(F.lit("https://f.example.com/"), F.col("id").cast("string"))})
    return text_times(st.apply_source_changes(s, changes), "muted_at")


@query("cascade_delete", ctes("sources", "articles", "article_reads", "saved_articles", "article_duplicates", "ingest_runs") + """, g AS (SELECT id FROM sources WHERE id % 5 = 2), dead AS (SELECT id FROM articles WHERE source_id IN (SELECT id FROM g))
SELECT 'sources' AS name, count(*) AS n FROM sources WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'articles', count(*) FROM articles WHERE source_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'ingest_runs', count(*) FROM ingest_runs WHERE source_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'article_duplicates', count(*) FROM article_duplicates WHERE article_id NOT IN (SELECT id FROM dead) UNION ALL SELECT 'article_reads', count(*) FROM article_reads WHERE article_id NOT IN (SELECT id FROM dead) UNION ALL SELECT 'saved_articles', count(*) FROM saved_articles WHERE article_id NOT IN (SELECT id FROM dead)
UNION ALL SELECT 'tombstones', count(*) FROM sources WHERE id % 5 = 2 OR id % 7 = 1""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    keys = {"sources": "id", "articles": "source_id", "ingest_runs": "source_id", "article_duplicates": "article_id", "article_reads": "article_id", "saved_articles": "article_id"}
    s = view(spark, d, "sources")
    left = st.cascade_delete(s.where("id % 5 = 2"), {n: (view(spark, d, n), k) for n, k in keys.items()}, s.where("id % 7 = 1").select("slug", "name"))
    counts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("restore_sources", ctes("sources") + "SELECT slug, name, 'source' AS kept FROM sources WHERE id % 4 <> 1 OR id % 8 = 1 UNION ALL SELECT slug, NULL, 'tombstone' FROM sources WHERE id % 4 = 1 AND id % 8 <> 1")
def restore_sources(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "sources").select("id", "slug", "name")
    live, left = st.restore_sources(s.where("id % 4 <> 1"), s.where("id % 4 = 1").select("slug"), s, s.where("id % 8 IN (0, 1)").select("slug"))
    return live.select("slug", "name", F.lit("source").alias("kept")).unionByName(left.select("slug", F.lit(None).cast("string").alias("name"), F.lit("tombstone").alias("kept")))


@query("retired_listing", ctes("sources") + "SELECT slug, CAST(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(id AS INT) AS VARCHAR) AS retired_at, id % 2 = 0 AS in_registry FROM sources WHERE id % 3 = 1")
def retired_listing(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "sources")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval("id")
    stones = s.where("id % 3 = 1").select("slug", at.alias("retired_at"))
    return text_times(fd.retired_listing(stones, s.where("id % 2 = 0")).orderBy(F.desc("retired_at")), "retired_at")


@query("toggle_saved", ctes("saved_articles", "article_reads") + """, t AS (SELECT user_id, article_id, read_at FROM article_reads WHERE article_id % 2 = 0 UNION ALL SELECT user_id, article_id, read_at FROM article_reads WHERE article_id % 6 = 0)
SELECT user_id, article_id FROM (SELECT user_id, article_id FROM saved_articles UNION ALL SELECT user_id, article_id FROM t) GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def toggle_saved(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "article_reads").select("user_id", "article_id", F.col("read_at").alias("at"))
    return st.toggle_saved(view(spark, d, "saved_articles"), r.where("article_id % 2 = 0").unionByName(r.where("article_id % 6 = 0"))).select("user_id", "article_id")


@query("mark_unread", ctes("article_reads", "saved_articles") + "SELECT user_id, article_id FROM article_reads ANTI JOIN saved_articles USING (user_id, article_id)")
def mark_unread(spark: SparkSession, d: str) -> DataFrame:
    return st.mark_unread(view(spark, d, "article_reads"), view(spark, d, "saved_articles")).select("user_id", "article_id")


@query("anti_already_seen", ctes("articles", "article_duplicates") + "SELECT min(id) AS id, canonical_url FROM (SELECT id, concat('https://c.example.com/', id // 3) AS canonical_url, url FROM articles) i WHERE canonical_url NOT IN (SELECT concat('https://c.example.com/', id) FROM articles WHERE id % 7 = 0) AND concat('https://dup.example.net/', id) NOT IN (SELECT url FROM article_duplicates) GROUP BY canonical_url")
def anti_already_seen(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "articles")
    canonical = lambda c: F.concat(F.lit("https://c.example.com/"), c.cast("string"))
    items = a.select("id", F.col("id").alias("position"), canonical(F.expr("id div 3")).alias("canonical_url"), F.concat(F.lit("https://dup.example.net/"), F.col("id").cast("string")).alias("url"))
    return st.anti_already_seen(items, a.where("id % 7 = 0").select(canonical(F.col("id")).alias("canonical_url")), view(spark, d, "article_duplicates")).select("id", "canonical_url")


@query("classify_poll_error", ctes("ingest_runs") + "SELECT CASE WHEN error LIKE '%HTTP 403%' OR error LIKE '%HTTP 401%' THEN 'refused' WHEN error LIKE '%HTTP 404%' THEN 'moved' WHEN error LIKE '%HTTP 429%' THEN 'rate-limited' WHEN error LIKE '%ENOTFOUND%' OR error LIKE '%getaddrinfo%' THEN 'unknown-host' ELSE 'other' END AS class, count(*) AS n FROM ingest_runs WHERE NOT ok GROUP BY 1")
def classify_poll_error(spark: SparkSession, d: str) -> DataFrame:
    from tidewire.functions.web import poll_error_class

    return view(spark, d, "ingest_runs").where("NOT ok").groupBy(poll_error_class(F.col("error")).alias("class")).agg(F.count("*").alias("n"))


DIGESTS = "SELECT CAST(published_at AS DATE) AS day, count(*) AS n, max(title) AS title FROM articles GROUP BY 1"


@query("digest_list", ctes("articles") + f"SELECT CAST(day AS VARCHAR) AS day, n, title FROM ({DIGESTS}) ORDER BY day DESC LIMIT 30")
def digest_list(spark: SparkSession, d: str) -> DataFrame:
    return digests(spark, d).orderBy(F.desc("day")).limit(30)


@query("digest_by_day", ctes("articles") + f"SELECT CAST(day AS VARCHAR) AS day, n, title FROM ({DIGESTS}) WHERE day = DATE '2024-01-12'")
def digest_by_day(spark: SparkSession, d: str) -> DataFrame:
    return digests(spark, d).where("day = '2024-01-12'")


def digests(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles").groupBy(F.to_date("published_at").cast("string").alias("day")).agg(F.count("*").alias("n"), F.max("title").alias("title"))
