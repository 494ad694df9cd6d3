"""Queries of the jobs: similarity, dedup, stories, scores that follow, radar, briefs, model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import models as M
from tidewire.functions import rules as R
from tidewire.functions import text as X
from tidewire.functions import web as W
from tidewire.operators import feed as fd
from tidewire.operators import jobs as J
from tidewire.operators import similarity as S
from tidewire.operators import stories as st
from tidewire.operators import vectors as V
from tidewire.operators.shared import new_folder
from tidewire.plans.enrichment import CATEGORY, JOINED, MENTIONS, ORGS, PLAIN, RULES, TAGS, TOKENS, WEIGHT, model_titles, sql_any
from tidewire.plans.registry import query
from tidewire.plans.relational import CANDIDATES, DAY_END, text_times
from tidewire.sources.views import AS_OF, ctes, view

C = F.col


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(C("vec_id").alias("id"), C("embedding").alias("v"), F.lit("m").alias("model"))


def with_vectors(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles").join(vectors(spark, d), "id", "left")


CLASSES = f"""t AS (SELECT id, list_sort(list_distinct({TOKENS})) AS t FROM articles), k AS (SELECT t, min(id) AS id, count(*) AS n FROM t WHERE len(t) > 0 GROUP BY 1) """


@query("title_similarity_join", ctes("articles").rstrip() + ", " + CLASSES + "SELECT a, b, round(s, 6) AS similarity FROM (SELECT x.id AS a, y.id AS b, len(list_intersect(x.t, y.t)) AS m, len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) AS s FROM k x JOIN k y ON x.id < y.id) WHERE s >= 0.42")
def title_similarity_join(spark: SparkSession, d: str) -> DataFrame:
    _, links = J.title_links(view(spark, d, "articles"), J.STORY_TITLE)
    return links.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("cosine_similarity_join", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35")
def cosine_similarity_join(spark: SparkSession, d: str) -> DataFrame:
    return S.cosine_similarity_join(vectors(spark, d), 0.35, model="model").select("a", "b", F.round("similarity", 6).alias("similarity"))


#: Each vector, and an echo of it without every eighth component, under an id of its own.
ECHOES = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN (i + vec_id) % 8 = 0 THEN 0.0 ELSE x END) FROM embeddings) """


def echoes(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("id", C("v").cast("array<double>").alias("v"))
    echo = F.transform("v", lambda x, i: F.when((i + 1 + C("id")) % 8 == 0, F.lit(0.0)).otherwise(x))
    return v.unionByName(v.select((C("id") + 1_000_000_000).alias("id"), echo.alias("v")))


@query("cosine_join_approximate", ECHOES + "SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.8")
def cosine_join_approximate(spark: SparkSession, d: str) -> DataFrame:
    """All pairs by products, or hyperplane tables with a share of one in ten thousand that may be missed at the bound itself. Echoes are exact in single precision."""
    v = echoes(spark, d).withColumn("v", C("v").cast("array<float>"))
    return V.cosine_join_approximate(v, 0.8, found=0.9999).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("nearest_article", ECHOES + "SELECT a.id, arg_min(b.id, (-list_cosine_similarity(a.v, b.v), b.id)) AS nearest, round(max(list_cosine_similarity(a.v, b.v)), 5) AS similarity FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0 GROUP BY 1")
def nearest_article(spark: SparkSession, d: str) -> DataFrame:
    """The nearest row of those whose id is divisible by 100, against all rows."""
    v = echoes(spark, d).withColumns({"at": C("id"), "since": F.lit(None).cast("long")})
    index = V.build_nearest(v, new_folder(spark, "nearest"), wanted=1.0)
    return V.nearest(index, v.where("id % 100 = 0")).select("id", "nearest", F.round("similarity", 5).alias("similarity"))


@query("dedup_leader")
def dedup_leader(spark: SparkSession, d: str) -> DataFrame:
    return J.dedup_leader(with_vectors(spark, d), vector_threshold=0.35)


@query("cluster_stories")
def cluster_stories(spark: SparkSession, d: str) -> DataFrame:
    return J.cluster_stories(with_vectors(spark, d), vector_threshold=0.35, as_of=AS_OF)


@query("cluster_cycle")
def cluster_cycle(spark: SparkSession, d: str) -> DataFrame:
    """The story rows of the month before AS_OF, with how many of their members gain in score."""
    from tidewire.plans.relational import with_labels

    s = view(spark, d, "sources").select(C("id").alias("source_id"), "base_credibility")
    a = with_labels(spark, d).join(s, "source_id").join(vectors(spark, d), "id", "left")
    out = J.cluster_cycle(a, view(spark, d, "article_duplicates"), AS_OF, days=31, vector_threshold=0.35)
    grown = out["members"].join(out["scores"].select("id"), "id").groupBy("story_id").agg(F.count("*").alias("n_rescored"))
    rows = out["stories"].join(grown, "story_id", "left").na.fill(0, ["n_rescored"])
    rows = rows.withColumns({"org_slugs": F.array_join("org_slugs", ","), "tags": F.array_join("tags", ","), "centroid": F.size("centroid")})
    return text_times(rows, "first_seen", "last_updated")


@query("story_components", ctes("articles").rstrip() + ", " + CLASSES + """, e AS (SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.id <> y.id WHERE len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) >= 0.42)
SELECT id, component FROM (WITH RECURSIVE r(id, root) USING KEY (id) AS (SELECT id, id FROM k UNION (SELECT e.b, min(r.root) FROM r JOIN e ON e.a = r.id JOIN recurring.r AS c ON c.id = e.b WHERE r.root < c.root GROUP BY e.b)) SELECT t.id, r.root AS component FROM r JOIN k ON k.id = r.id JOIN t ON t.t = k.t)""")
def story_components(spark: SparkSession, d: str) -> DataFrame:
    """Single-link groups by titles alone: copies stand as one class, classes are linked."""
    member, links = J.title_links(view(spark, d, "articles"), J.STORY_TITLE)
    parts = S.components(J.stage(links), member.select(C("class_id").alias("id")).distinct(), J.stage)
    return member.join(parts.select(C("id").alias("class_id"), "component"), "class_id").select("id", "component")


@query("story_aggregate", ctes("articles", "labels_of_articles") + """SELECT story_id, CAST(min(published_at) AS VARCHAR) AS first_seen, count(*) AS article_count, max(credibility) AS credibility, max(impact) AS impact,
(SELECT string_agg(DISTINCT l.org_slug, ',' ORDER BY l.org_slug) FROM labels_of_articles l JOIN articles b ON b.id = l.article_id WHERE b.story_id = a.story_id) AS orgs, arg_max(id, (credibility, published_at, -id)) AS lead_id, arg_max(title, (credibility, published_at, -id)) AS headline FROM articles a WHERE story_id IS NOT NULL GROUP BY story_id""")
def story_aggregate(spark: SparkSession, d: str) -> DataFrame:
    from tidewire.plans.relational import with_labels

    out = st.story_aggregate(with_labels(spark, d).where("story_id IS NOT NULL").withColumn("seq", C("id")))
    out = out.select("story_id", "first_seen", "article_count", "credibility", "impact", F.array_join(F.array_sort("org_slugs"), ",").alias("orgs"), "lead_id", "headline")
    return text_times(out, "first_seen")


def items(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "sources").select(C("id").alias("source_id"), "base_credibility", C("org_slug").alias("source_org"))
    a = view(spark, d, "articles").join(s, "source_id")
    hint = {f"is_{n}": C("id") % k == 0 for n, k in (("paper", 11), ("model_release", 13), ("release", 17))}
    return a.select("id", "title", C("summary").alias("content"), "url", "author", "publisher_domain", "base_credibility", "source_org", "published_at", "source_id", C("corroboration_count").alias("corroboration"), (C("id") % 50).alias("points"), (C("id") % 30).alias("upvotes"), F.lit(None).cast("array<string>").alias("keywords")).withColumns(hint)


HEDGED = f"CASE WHEN {sql_any(JOINED, [p for _, p in R.rt.RUMOUR_PATTERNS])} THEN 1 ELSE 0 END"
ENRICHED = ctes("articles", "sources").rstrip() + f""", n AS (SELECT a.*, s.base_credibility, s.org_slug, trim(a.summary, ' ' || chr(9) || chr(10) || chr(13)) AS s0, {PLAIN.format(c="a.title")} AS nt, {PLAIN.format(c="a.summary")} AS ns FROM articles a JOIN sources s ON s.id = a.source_id),
x AS (SELECT * REPLACE (CASE WHEN s0 = '' OR ns = nt OR (starts_with(ns, nt) AND length(ns) - length(nt) < 40) THEN NULL ELSE s0 END AS summary) FROM n),
y AS (SELECT id, url, org_slug, corroboration_count AS corr, {CATEGORY} AS category, [t for t in [{", ".join(f"CASE WHEN {sql_any(JOINED, ps)} THEN '{t}' END" for t, ps in TAGS)}] if t IS NOT NULL] AS tags,
regexp_matches(concat(' ', {JOINED}, ' '), '(?i)[^A-Za-z0-9_-](leur|ben|tion)[^A-Za-z0-9_-]') OR regexp_matches(url, '//src2\\.example\\.com/') AS two, regexp_matches(concat(' ', {JOINED}, ' '), '(?i)[^A-Za-z0-9_-](there|anan)[^A-Za-z0-9_-]') OR regexp_matches(url, '//src1\\.example\\.com/') AS one,
{HEDGED} AS hedge, CASE WHEN publisher_domain IS NOT NULL THEN 3 ELSE base_credibility END - {HEDGED} + CASE WHEN corroboration_count >= 2 THEN 1 ELSE 0 END AS raw FROM x),
z AS (SELECT *, CAST(greatest(1, least(5, raw)) AS INT) AS credibility FROM y)
SELECT id, url AS canonical_url, category, array_to_string([o for o in [CASE WHEN two THEN 'o-two' END, CASE WHEN one THEN 'o-one' END, 'o-three', org_slug] if o IS NOT NULL], ',') AS orgs, array_to_string(tags, ',') AS tags, credibility, credibility <= 2 AS is_rumour,
CAST(greatest(0, least(100, floor({WEIGHT} + 8 * (CAST(two AS INT) + CAST(one AS INT)) + credibility * 4 + corr * 3 + CASE WHEN id % 50 > 0 THEN least(log10(id % 50 + 1) * 8, 16) ELSE 0 END + CASE WHEN id % 30 > 0 THEN least(log10(id % 30 + 1) * 10, 20) ELSE 0 END + 0.5))) AS INT) AS impact,
CAST(1 + hedge + CASE WHEN corr >= 2 THEN 1 ELSE 0 END + CASE WHEN raw NOT BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS INT) AS n_reasons FROM z"""


@query("enrich_items", ENRICHED)
def enrich_items(spark: SparkSession, d: str) -> DataFrame:
    out = J.enrich_items(items(spark, d), RULES, TAGS, ORGS)
    return out.select("id", "canonical_url", "category", F.array_join("org_slugs", ",").alias("orgs"), F.array_join("tags", ",").alias("tags"), "credibility", "is_rumour", "impact", F.size("reasons").alias("n_reasons"))


OUTLETS = """outs AS (SELECT story_id, count(DISTINCT o) AS outlets FROM (SELECT story_id, coalesce(publisher_domain, CAST(source_id AS VARCHAR)) AS o FROM articles WHERE story_id IS NOT NULL
UNION SELECT a.story_id, coalesce(x.publisher_domain, CAST(x.source_id AS VARCHAR)) FROM article_duplicates x JOIN articles a ON a.id = x.article_id WHERE a.story_id IS NOT NULL) GROUP BY 1) """


@query("apply_corroboration", ctes("articles", "sources", "article_duplicates").rstrip() + ", " + OUTLETS + "SELECT a.id, CAST(greatest(a.corroboration_count, o.outlets - 1) AS INT) AS corroboration_count, CAST(greatest(1, least(5, CASE WHEN a.publisher_domain IS NOT NULL THEN 3 ELSE s.base_credibility END - " + HEDGED.replace("title", "a.title").replace("summary", "a.summary") + " + CASE WHEN greatest(a.corroboration_count, o.outlets - 1) >= 2 THEN 1 ELSE 0 END)) AS INT) AS rescored FROM articles a JOIN outs o USING (story_id) JOIN sources s ON s.id = a.source_id")
def apply_corroboration(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "articles").where("story_id IS NOT NULL")
    a = a.join(view(spark, d, "sources").select(C("id").alias("source_id"), "base_credibility"), "source_id")
    score = R.score_credibility(title=C("title"), summary=C("summary"), url=C("url"), base=C("base_credibility"), publisher=C("publisher_domain"), author=C("author"), has_date=F.lit(True), corroboration=C("corroboration_count"))["score"]
    return J.apply_corroboration(a, st.story_outlets(a, view(spark, d, "article_duplicates")), score).select("id", "corroboration_count", "rescored")


@query("recompute_corroboration", ctes("articles", "article_duplicates").rstrip() + ", " + OUTLETS + "SELECT a.id, greatest(coalesce((SELECT count(DISTINCT coalesce(x.publisher_domain, CAST(x.source_id AS VARCHAR))) FROM article_duplicates x WHERE x.article_id = a.id), 0), coalesce(o.outlets - 1, 0)) AS corroboration_count FROM articles a LEFT JOIN outs o USING (story_id)")
def recompute_corroboration(spark: SparkSession, d: str) -> DataFrame:
    a, x = view(spark, d, "articles"), view(spark, d, "article_duplicates")
    return J.recompute_corroboration(a, x, st.story_outlets(a, x))


RESCORED = ctes("articles", "sources").rstrip() + f""", s1 AS (SELECT a.id, a.credibility AS old, CASE WHEN a.publisher_domain IS NOT NULL THEN 3 ELSE s.base_credibility END AS start, {HEDGED.replace("title", "a.title").replace("summary", "a.summary")} AS hedge, a.corroboration_count >= 2 AS many FROM articles a JOIN sources s ON s.id = a.source_id)
SELECT id, old, new FROM (SELECT id, old, CAST(greatest(1, least(5, start - CASE WHEN hedge = 1 OR id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN many THEN 1 ELSE 0 END)) AS INT) AS new FROM s1) WHERE old <> new"""


@query("rescore", RESCORED)
def rescore(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose score changes, old and new, with the model's judgement recovered from the recorded rule."""
    s = view(spark, d, "sources").select(C("id").alias("source_id"), "base_credibility")
    a = view(spark, d, "articles").join(s, "source_id")
    rule = F.when(C("id") % 3 == 0, "llm-unconfirmed").when(C("id") % 3 == 1, "source")
    a = a.withColumn("reasons", F.array(F.struct(F.coalesce(rule, F.lit("publisher")).alias("rule"), F.lit(0).alias("delta"), F.lit("").alias("detail"))))
    new = R.score_credibility(title=C("title"), summary=C("summary"), url=C("url"), base=C("base_credibility"), publisher=C("publisher_domain"), author=C("author"), has_date=F.lit(True), corroboration=C("corroboration_count"), claim=J.claim_from_reasons(C("reasons")))
    moved = F.filter(F.array(new["score"]), lambda n: n != C("credibility"))  # a where() would work out the score in the join and again beyond it
    return a.select("id", C("credibility").alias("old"), F.explode(moved).alias("new"))


@query("score_movement", f"SELECT old, new, count(*) AS n FROM ({RESCORED}) GROUP BY 1, 2")
def score_movement(spark: SparkSession, d: str) -> DataFrame:
    """How many rows moved from which score to which in a rescoring."""
    return rescore(spark, d).groupBy("old", "new").agg(F.count("*").alias("n"))


def radar_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = view(spark, d, "sources").select(C("id").alias("source_id"), "kind")
    a = model_titles(spark, d).join(s, "source_id")
    return J.radar(a, AS_OF)


MODELS = """x AS (SELECT m.slug, a.*, s.kind FROM m JOIN articles a USING (id) JOIN sources s ON s.id = a.source_id), models AS (SELECT slug, count(*) AS mention_count, count(DISTINCT coalesce(publisher_domain, CAST(source_id AS VARCHAR))) AS outlets, max(credibility) AS credibility, bool_or(kind = 'hf_models') AS first_party,
max(published_at) AS last_seen, min(published_at) AS first_seen, arg_min(id, (-(2 * credibility + CASE category WHEN 'model-launch' THEN 6 WHEN 'model-leak' THEN 4 ELSE 0 END), published_at, id)) AS lead_id FROM x GROUP BY 1), s2 AS (SELECT *, CASE WHEN first_party THEN 'released' WHEN credibility >= 4 THEN 'confirmed' WHEN credibility >= 3 OR outlets >= 2 THEN 'reported' ELSE 'rumoured' END AS status FROM models) """
RADAR = ctes("articles", "sources").rstrip() + ", " + MENTIONS + ", " + MODELS


@query("radar", RADAR + "SELECT slug, mention_count, outlets, credibility, first_party, status, lead_id, CAST(first_seen AS VARCHAR) AS first_seen FROM s2")
def radar(spark: SparkSession, d: str) -> DataFrame:
    models, _ = radar_tables(spark, d)
    return text_times(models.select("slug", "mention_count", "outlets", "credibility", "first_party", "status", "lead_id", "first_seen"), "first_seen")


@query("radar_counts", RADAR + "SELECT status, count(*) AS n FROM s2 GROUP BY 1")
def radar_counts(spark: SparkSession, d: str) -> DataFrame:
    return radar_tables(spark, d)[0].groupBy("status").agg(F.count("*").alias("n"))


@query("top_models", RADAR + "SELECT slug, mention_count FROM s2 ORDER BY mention_count DESC, slug LIMIT 12")
def top_models(spark: SparkSession, d: str) -> DataFrame:
    return radar_tables(spark, d)[0].orderBy(F.desc("mention_count"), "slug").limit(12).select("slug", "mention_count")


@query("radar_board", RADAR + "SELECT slug, status, list_position(['rumoured', 'reported', 'confirmed', 'released'], status) AS status_rank, CAST(last_seen AS VARCHAR) AS last_seen, (SELECT url FROM articles a WHERE a.id = s2.lead_id) AS lead_url FROM s2")
def radar_board(spark: SparkSession, d: str) -> DataFrame:
    board = J.with_lead(J.radar_board(radar_tables(spark, d)[0]), view(spark, d, "articles"))
    return text_times(board.select("slug", "status", "status_rank", "last_seen", "lead_url"), "last_seen")


@query("model_timeline", ctes("articles", "sources", "article_reads").rstrip() + ", " + MENTIONS + "SELECT a.id, CAST(a.published_at AS VARCHAR) AS published_at, s.name AS source_name, a.id IN (SELECT article_id FROM article_reads WHERE user_id = 7) AS is_read FROM m JOIN articles a USING (id) JOIN sources s ON s.id = a.source_id WHERE m.slug = 'claude-4.3-opus'")
def model_timeline(spark: SparkSession, d: str) -> DataFrame:
    _, mentions = radar_tables(spark, d)
    read = view(spark, d, "article_reads").where("user_id = 7").select(C("article_id").alias("id"), F.lit(True).alias("r"))
    s = view(spark, d, "sources").select(C("id").alias("source_id"), C("name").alias("source_name"))
    own = mentions.where("model_slug = 'claude-4.3-opus'").select(C("article_id").alias("id"))
    out = view(spark, d, "articles").join(own, "id").join(s, "source_id").join(read, "id", "left").orderBy("published_at", "id")
    return text_times(out.select("id", "published_at", "source_name", C("r").isNotNull().alias("is_read")), "published_at")


def brief(candidates: DataFrame) -> DataFrame:
    """What a model would have answered: an item for each impact band, citing its candidates and one unknown id."""
    bands = candidates.groupBy((-F.floor(C("impact") / 20)).alias("band")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    item = F.struct(F.concat(F.lit("Band "), C("band").cast("string")).alias("headline"), F.lit("Body.").alias("body"), F.concat(F.array(F.lit(-1).cast("long")), "ids").alias("article_ids"))
    all_items = bands.agg(F.array_sort(F.collect_list(F.struct("band", item.alias("item")))).alias("x"))
    return all_items.select(F.lit("2024-01-19").alias("day"), F.lit(" The day ").alias("title"), F.lit(" Intro. ").alias("intro"), F.transform("x", lambda i: i["item"]).alias("items"))


RENDER = """, b AS (SELECT CAST(-floor(impact / 20) AS BIGINT) AS band, string_agg(concat('- [', title, '](', url, ') — ', source_name), chr(10) ORDER BY id) AS links, list(id ORDER BY id) AS ids FROM candidates GROUP BY 1)
SELECT '2024-01-19' AS day, 'The day' AS title, concat('Intro.', chr(10), chr(10), string_agg(concat('### Band ', band, chr(10), chr(10), 'Body.', chr(10), chr(10), links), chr(10) ORDER BY band)) AS body_markdown, array_to_string(flatten(list(ids ORDER BY band)), ',') AS article_ids FROM b"""


@query("digest_render", ctes("articles", "sources").rstrip() + ", " + CANDIDATES + RENDER)
def digest_render(spark: SparkSession, d: str) -> DataFrame:
    c = fd.digest_candidates(view(spark, d, "articles"), view(spark, d, "sources"), DAY_END)
    return J.digest_render(brief(c), c).select("day", "title", "body_markdown", F.array_join("article_ids", ",").alias("article_ids"))


@query("digest_run", ctes("articles", "sources").rstrip() + ", " + CANDIDATES + "SELECT day, title FROM (SELECT '2024-01-18' AS day, 'old' AS title UNION ALL SELECT '2024-01-19', concat(least(count(*), 8), ' things worth knowing') FROM candidates HAVING count(*) > 0)")
def digest_run(spark: SparkSession, d: str) -> DataFrame:
    """The brief of the day upserted by day; the table already has an older and a stale one."""
    from tidewire.operators.state import upsert_latest

    c = fd.digest_candidates(view(spark, d, "articles"), view(spark, d, "sources"), DAY_END)
    new = fd.digest_fallback(c).where("article_ids <> ''").select(F.lit("2024-01-19").alias("day"), "title", F.lit(2).alias("version"))
    days = c.select(F.explode(F.array(F.lit("2024-01-18"), F.lit("2024-01-19"))).alias("day")).distinct()
    return upsert_latest(days.select("day", F.lit("old").alias("title"), F.lit(1).alias("version")), new, ["day"], "version").drop("version")


@query("embed")
def embed(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "articles").select("id", X.embedding_text(C("title"), C("summary")).alias("text"))
    return M.embed(a).select("id", F.size("v").alias("dims"), "status")


@query("embed_backfill")
def embed_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Missing or stale vectors are worked out and upserted; the others stay."""
    from tidewire.operators.state import upsert_latest

    held = vectors(spark, d).withColumn("model", F.when(C("id") % 3 != 0, M.MODEL)).select("id", "v", "model", F.lit(0).alias("version"))
    a = view(spark, d, "articles").select("id", X.embedding_text(C("title"), C("summary")).alias("text"))
    need = a.join(held.where(C("model").eqNullSafe(M.MODEL)).select("id"), "id", "left_anti")
    made = M.embed(need).where("v IS NOT NULL").select("id", "v", F.lit(M.MODEL).alias("model"), F.lit(1).alias("version"))
    return upsert_latest(held, made, ["id"], "version").select("id", "model", F.size("v").alias("dims"))


@query("llm_enrich")
def llm_enrich(spark: SparkSession, d: str) -> DataFrame:
    return M.llm_enrich(view(spark, d, "articles")).select("id", "status", "prompt_tokens", "completion_tokens")


@query("llm_run_totals")
def llm_run_totals(spark: SparkSession, d: str) -> DataFrame:
    out = M.llm_enrich(view(spark, d, "articles"))
    return out.agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count_if(C("status") == "ok").alias("processed"), F.count_if(C("status") != "ok").alias("failed"))


@query("llm_enrich_apply")
def llm_enrich_apply(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "sources").select(C("id").alias("source_id"), "base_credibility")
    a = view(spark, d, "articles").join(s, "source_id")
    n = R.normalize_llm_response(C("raw"), fd.CATEGORIES, [o.slug for o in R.DEFAULT_ORGS])
    results = M.llm_enrich(a).where("status = 'ok'").select("id", n.alias("n"))
    out = J.llm_apply(a, results)
    return out.select("id", "category", "credibility", "impact", "enriched_by", F.length("summary").alias("n_summary"))


WRITTEN = """ SELECT '2024-01-19' AS day, 'The day' AS title, concat('Intro.', chr(10), chr(10), string_agg(concat('### ', title, chr(10), chr(10), 'Body.', chr(10), chr(10), '- [', title, '](', url, ') — ', source_name), chr(10) ORDER BY impact DESC, credibility DESC, id)) AS body_markdown, string_agg(id, ',' ORDER BY impact DESC, credibility DESC, id) AS article_ids FROM candidates HAVING count(*) > 0"""


@query("brief_writer", ctes("articles", "sources").rstrip() + ", " + CANDIDATES + WRITTEN)
def brief_writer(spark: SparkSession, d: str) -> DataFrame:
    """The day's brief by a writer that gives each candidate an item of its own."""
    def writer(given: list[dict]) -> dict:
        return {"title": "The day", "intro": "Intro.", "items": [{"headline": x["title"], "body": "Body.", "article_ids": [x["id"], -1]} for x in given]}

    c = fd.digest_candidates(view(spark, d, "articles"), view(spark, d, "sources"), DAY_END)
    return M.brief_writer(c, "2024-01-19", writer).select("day", "title", "body_markdown", F.array_join("article_ids", ",").alias("article_ids"))


def cycle(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, articles, duplicates) of a cycle at AS_OF: every feed serves all it has; the table holds what came in until a day ago."""
    served = items(spark, d).withColumn("position", C("id"))
    held = view(spark, d, "articles").where(C("ingested_at") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 1 DAY"))
    held = held.withColumn("canonical_url", W.canonicalize_url(C("url")))
    text = X.embedding_text(C("title"), C("summary"))
    v = M.embed(held.select("id", text.alias("text"))).select("id", "v", F.when(C("v").isNotNull(), M.MODEL).alias("model"))
    return served, J.stage(held.join(v, "id", "left")), view(spark, d, "article_duplicates")


@query("ingest_batch")
def ingest_batch(spark: SparkSession, d: str) -> DataFrame:
    """The log of one cycle by source. A lower bound for vectors than the job's own, since the fixture's texts are invented."""
    return J.ingest_batch(*cycle(spark, d), AS_OF, vector_threshold=0.6, rules=RULES, tags=TAGS, orgs=ORGS)[2]
