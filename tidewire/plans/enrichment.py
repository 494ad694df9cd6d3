"""Queries of the text, URL and rule functions over whole tables. Rules come from a small table over words that occur in the
invented prose; the default tables are covered by golden rows in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import rules as R
from tidewire.functions import text as X
from tidewire.functions import web as W
from tidewire.functions.rule_tables import CATEGORY_WEIGHT, STOPWORDS
from tidewire.operators.releases import release_history as history_op
from tidewire.operators.releases import releases as releases_op
from tidewire.operators.stories import centroid as centroid_op
from tidewire.plans.registry import query
from tidewire.sources.views import ctes, view

TRACK = W.TRACKING
RULES = [("model-launch", [r"(?i)\bthe\b.{0,20}\btion\w*\b", r"(?i)\bdes?\b.{0,9}\bqui\b"]), ("deal", [r"(?i)\bder\b", r"(?i)\bcon\b.{0,30}\bla\b"]), ("policy", [r"(?i)\bwith that\b", r"(?i)\bfrom\b"])]
TAGS = [("t-the", [r"(?i)\bthe\b"]), ("t-of", [r"(?i)\bof\b", r"(?i)\bund\b"]), ("t-la", [r"(?i)\bla\b"]), ("t-num", [r"[0-9]{4,}"])]
HEDGES = [("about", r"(?i)\babout\b"), ("that", r"(?i)\bthat\b"), ("pour", r"(?i)\bpour\b"), ("is", r"(?i)\bis\b")]
ORGS = [R.Org("o-one", 2, True, ("there", "anan"), ("src1.example.com",)), R.Org("o-two", 1, True, ("leur", "ben", "tion"), ("src2.example.com", "example.org")), R.Org("o-three", 3, False, (), ("example.com",))]


def sql_any(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + ")"


JOINED = "concat(coalesce(title, ''), chr(10), coalesce(summary, ''))"
PAGE_URL = "regexp_replace(url, '#.*$', '')"
HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"


@query("host_of", f"SELECT page_id, {HOST} AS host FROM pages")
def host_of(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", W.host_of(F.col("url")).alias("host"))


@query("canonicalize_url", f"""WITH p AS (SELECT page_id, {HOST} AS host, regexp_extract({PAGE_URL}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, string_split(regexp_extract({PAGE_URL}, '\\?(.*)$', 1), '&') AS q FROM pages),
c AS (SELECT page_id, host, regexp_replace(regexp_replace(regexp_replace(path, '(?i)/amp/?$', '/'), '(?i)\\.amp$', ''), '/+$', '') AS path, list_sort(list_filter(q, lambda x: x <> '' AND NOT regexp_matches(lower(string_split(x, '=')[1]), '{TRACK}'))) AS q FROM p)
SELECT page_id, concat('https://', host, CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) AS canonical_url FROM c""")
def canonicalize_url(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", W.canonicalize_url(F.col("url")).alias("canonical_url"))


@query("strip_html", """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script)[^>]*>.*?</script>|<(?:style)[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '\\s+', ' ', 'g')) AS text FROM pages""")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", W.strip_html(F.col("html")).alias("text"))


STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TOKENS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}\\s-]', ' ', 'g'), '\\s+'), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), lambda w: length(w) > 2 AND w NOT IN ({STOP}))"


@query("title_tokens", ctes("full_articles") + f"SELECT id, array_to_string(list_sort(list_distinct({TOKENS})), ' ') AS tokens FROM full_articles")
def title_tokens(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "full_articles").select("id", F.array_join(F.array_sort(X.title_tokens(F.col("title"))), " ").alias("tokens"))


@query("title_similarity", ctes("full_articles") + f""", t AS (SELECT id, list_distinct({TOKENS}) AS t FROM full_articles) SELECT a.id, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END AS similarity FROM t a JOIN t b ON b.id = a.id + 1""")
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "full_articles").select("id", X.title_tokens(F.col("title")).alias("t"))
    nxt = t.select((F.col("id") - 1).alias("id"), F.col("t").alias("u"))
    return t.join(nxt, "id").select("id", X.jaccard(F.col("t"), F.col("u")).alias("similarity"))


PLAIN = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query("useful_summary", ctes("full_articles") + f""", s AS (SELECT id, trim(summary, ' ' || chr(9) || chr(10) || chr(13)) AS s, {PLAIN.format(c='title')} AS nt, {PLAIN.format(c='summary')} AS ns FROM full_articles)
SELECT id, CASE WHEN s = '' OR ns = nt OR (starts_with(ns, nt) AND length(ns) - length(nt) < 40) THEN NULL ELSE s END AS summary FROM s""")
def useful_summary(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "full_articles").select("id", X.useful_summary(F.col("title"), F.col("summary")).alias("summary"))


FIRST_WORDS = "array_to_string(string_split(title, ' ')[1:1 + CAST(id % 4 AS INT)], ' ')"


@query("normalize_tag", ctes("full_articles") + f""", t AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(trim(lower({FIRST_WORDS})), '[^\\p{{L}}\\p{{N}}\\s-]', '', 'g'), '\\s+', '-', 'g'), '^-+|-+$', '', 'g') AS t FROM full_articles)
SELECT id, CASE WHEN length(t) BETWEEN 2 AND 28 AND len(string_split(t, '-')) <= 3 THEN t END AS tag FROM t""")
def normalize_tag(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_join(F.slice(F.split("title", " "), F.lit(1), (F.col("id") % 4 + 1).cast("int")), " ")
    return view(spark, d, "full_articles").select("id", X.normalize_tag(words).alias("tag"))


@query("strip_publisher_suffix", ctes("full_articles", "sources") + "SELECT a.id, CASE WHEN a.id % 3 = 0 THEN trim(a.title) WHEN a.id % 3 = 1 THEN trim(a.title) ELSE coalesce(nullif(trim(regexp_replace(a.title, '\\s+-\\s+[^-]{2,40}$', '')), ''), a.title) END AS title FROM full_articles a JOIN sources s ON s.id = a.source_id WHERE NOT contains(a.title, ' - ') AND trim(a.title) <> ''")
def strip_publisher_suffix(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "sources").select(F.col("id").alias("source_id"), "name")
    a = view(spark, d, "full_articles").where(~F.contains("title", F.lit(" - ")) & (F.trim("title") != "")).join(s, "source_id")
    raw = F.when(F.col("id") % 3 == 0, F.concat("title", F.lit(" - "), "name")).when(F.col("id") % 3 == 1, F.concat("title", F.lit(" - Other Paper"))).otherwise(F.col("title"))
    return a.select("id", X.strip_publisher_suffix(raw, F.when(F.col("id") % 3 == 0, F.col("name"))).alias("title"))


@query("clean_abstract", ctes("full_articles") + "SELECT id, trim(regexp_replace(regexp_replace(summary, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS abstract FROM full_articles WHERE NOT contains(summary, '<') AND NOT contains(summary, '&')")
def clean_abstract(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "full_articles").where("NOT contains(summary, '<') AND NOT contains(summary, '&')")
    return a.select("id", X.clean_abstract(F.concat(F.lit("arXiv:2501.00001v1 Announce Type: new \nAbstract: "), "summary")).alias("abstract"))


@query("arxiv_id", ctes("full_articles") + "SELECT id, CASE WHEN id % 4 <> 0 THEN concat('2501.', lpad(CAST(id AS VARCHAR), 5, '0'), CASE WHEN id % 2 = 0 THEN 'v2' ELSE '' END) END AS arxiv_id FROM full_articles")
def arxiv_id(spark: SparkSession, d: str) -> DataFrame:
    tail = F.concat(F.lpad(F.col("id").cast("string"), 5, "0"), F.when(F.col("id") % 2 == 0, "v2").otherwise(""))
    url = F.when(F.col("id") % 4 != 0, F.concat(F.lit("https://arxiv.org/abs/2501."), tail)).otherwise(F.col("url"))
    return view(spark, d, "full_articles").select("id", X.arxiv_id(url).alias("arxiv_id"))


@query("subreddit_from", ctes("sources") + "SELECT id, CASE WHEN id % 2 = 0 THEN slug END AS subreddit FROM sources")
def subreddit_from(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://www.reddit.com/r/"), "slug", F.lit("/.rss"))).otherwise(F.lit("https://x.example.com/feed"))
    return view(spark, d, "sources").select("id", X.subreddit_from(url).alias("subreddit"))


@query("is_derivative_variant", "SELECT p_partkey, p_partkey % 3 = 0 AS derivative FROM part")
def is_derivative_variant(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ["-GGUF", "-Chat", "gguf-2"]))
    model = F.concat(F.lit("org-fp8/m"), F.col("p_partkey").cast("string"), F.get(names, (F.col("p_partkey") % 3).cast("int")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", X.is_derivative_variant(model).alias("derivative"))


RELEASES = ctes("release_articles").rstrip() + ", r AS (SELECT id, url, published_at, regexp_extract(url, 'github\\.com/([^/]+/[^/]+)/releases/tag/', 1) AS repo, regexp_extract(url, '/releases/tag/(.+)$', 1) AS tag FROM release_articles) "


@query("repo_from_url", RELEASES + "SELECT id, repo FROM r")
def repo_from_url(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "release_articles").select("id", W.repo_from_url(F.col("url")).alias("repo"))


@query("tag_from_url", RELEASES + "SELECT id, tag FROM r")
def tag_from_url(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "release_articles").select("id", W.tag_from_url(F.replace("url", F.lit(".0-a"), F.lit(".0%2Da"))).alias("tag"))


@query("project_name", RELEASES + "SELECT id, string_split(repo, '/')[2] AS project FROM r")
def project_name(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "release_articles").select("id", W.project_name(W.repo_from_url(F.col("url"))).alias("project"))


@query("parse_tag", RELEASES + "SELECT id, CASE id % 4 WHEN 0 THEN substr(tag, 2) WHEN 1 THEN substr(tag, 7) WHEN 2 THEN tag ELSE substr(tag, 2) END AS version, CASE id % 4 WHEN 1 THEN 'alpha' WHEN 3 THEN 'rc' END AS channel, id % 2 = 1 AS is_prerelease, id % 4 = 2 AS is_build FROM r")
def parse_tag(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "release_articles").select("id", W.parse_tag(W.tag_from_url(F.col("url"))).alias("t")).select("id", "t.*")


@query("credibility_label", ctes("full_articles") + "SELECT credibility, CASE credibility WHEN 1 THEN 'Rumour' WHEN 2 THEN 'Unverified' WHEN 3 THEN 'Reported' WHEN 4 THEN 'Well sourced' WHEN 5 THEN 'Confirmed' ELSE 'Unrated' END AS label, count(*) AS n FROM full_articles GROUP BY 1, 2")
def credibility_label(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "full_articles").groupBy("credibility", X.credibility_label(F.col("credibility")).alias("label")).agg(F.count("*").alias("n"))


CADENCE = """, a AS (SELECT repo, count(*) AS n, date_diff('second', min(published_at::TIMESTAMP), max(published_at::TIMESTAMP)) / 604800.0 AS span FROM r GROUP BY 1), c AS (SELECT repo, n, CASE WHEN n < 2 OR span < 0.05 THEN 0.0 ELSE n / span END AS per_week FROM a) """


@query("cadence_label", RELEASES.rstrip() + CADENCE + "SELECT repo, CASE WHEN per_week <= 0 THEN '—' WHEN per_week >= 14 THEN 'multiple daily' WHEN per_week >= 5 THEN '~daily' WHEN per_week >= 1.5 THEN 'few per week' WHEN per_week >= 0.5 THEN '~weekly' ELSE 'occasional' END AS label FROM c")
def cadence_label(spark: SparkSession, d: str) -> DataFrame:
    return release_table(spark, d).select("repo", W.cadence_label(F.col("per_week")).alias("label"))


def release_table(spark: SparkSession, d: str) -> DataFrame:
    return releases_op(view(spark, d, "release_articles"), "1998-08-01")


@query("releases", RELEASES.rstrip() + CADENCE + """SELECT c.repo, c.n AS n_releases, round(c.per_week, 6) AS per_week, (SELECT count(*) FROM r WHERE r.repo = c.repo AND r.published_at >= TIMESTAMP '1998-07-25 00:00:00') AS last_7d, (SELECT tag FROM r WHERE r.repo = c.repo ORDER BY published_at DESC, id DESC LIMIT 1) AS latest_tag FROM c""")
def releases(spark: SparkSession, d: str) -> DataFrame:
    return release_table(spark, d).select("repo", "n_releases", F.round("per_week", 6).alias("per_week"), "last_7d", "latest_tag")


@query("release_history", RELEASES + "SELECT repo, tag, place FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY published_at DESC, id DESC) AS place FROM r) WHERE place <= 8")
def release_history(spark: SparkSession, d: str) -> DataFrame:
    return history_op(view(spark, d, "release_articles")).select("repo", "tag", F.col("place").cast("long").alias("place"))


CATEGORY = "CASE WHEN id % 11 = 0 THEN 'research-paper' WHEN id % 13 = 0 THEN 'model-launch' WHEN id % 17 = 0 THEN 'tool-launch' " + " ".join(f"WHEN {sql_any(JOINED, ps)} THEN '{n}'" for n, ps in RULES) + " ELSE 'other' END"


@query("classify", ctes("full_articles") + f"SELECT id, {CATEGORY} AS category FROM full_articles")
def classify(spark: SparkSession, d: str) -> DataFrame:
    hint = lambda n: F.col("id") % n == 0
    return view(spark, d, "full_articles").select("id", R.classify(F.col("title"), F.col("summary"), hint(11), hint(13), hint(17), RULES).alias("category"))


@query("is_case_study", ctes("full_articles") + f"SELECT id, regexp_matches({JOINED}, '(?i)\\b(customer|case) stor(y|ies)\\b') OR id % 7 = 0 AS case_study FROM full_articles")
def is_case_study(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("id") % 7 == 0, F.concat(F.lit("A customer story: "), "title")).otherwise(F.col("title"))
    return view(spark, d, "full_articles").select("id", R.is_case_study(title, F.col("summary")).alias("case_study"))


HEDGE = "CASE " + " ".join(f"WHEN regexp_matches({JOINED}, '{p}') THEN '{n}'" for n, p in HEDGES) + " END"


@query("rumour_label", ctes("full_articles") + f"SELECT id, {HEDGE} AS hedge FROM full_articles")
def rumour_label(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "full_articles").select("id", R.rumour_label(R.joined(F.col("title"), F.col("summary")), HEDGES).alias("hedge"))


@query("extract_tags", ctes("full_articles") + "SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql_any(JOINED, ps)} THEN '{t}' END" for t, ps in TAGS) + ", CASE WHEN id % 2 = 0 THEN 'kw-' || CAST(id % 5 AS VARCHAR) END], lambda x: x IS NOT NULL), ',') AS tags FROM full_articles")
def extract_tags(spark: SparkSession, d: str) -> DataFrame:
    extra = F.when(F.col("id") % 2 == 0, F.array(F.concat(F.lit("KW "), (F.col("id") % 5).cast("string")), F.lit("x")))
    return view(spark, d, "full_articles").select("id", F.array_join(R.extract_tags(R.joined(F.col("title"), F.col("summary")), extra, TAGS), ",").alias("tags"))


@query("match_orgs", ctes("full_articles") + f"SELECT id, array_to_string(list_filter([CASE WHEN regexp_matches(concat(' ', {JOINED}, ' '), '(?i)[^A-Za-z0-9_-](leur|ben|tion)[^A-Za-z0-9_-]') OR regexp_matches(url, '//src2\\.example\\.com/') THEN 'o-two' END, CASE WHEN regexp_matches(concat(' ', {JOINED}, ' '), '(?i)[^A-Za-z0-9_-](there|anan)[^A-Za-z0-9_-]') OR regexp_matches(url, '//src1\\.example\\.com/') THEN 'o-one' END, 'o-three'], lambda x: x IS NOT NULL), ',') AS orgs FROM full_articles")
def match_orgs(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "full_articles").select("id", F.array_join(R.match_orgs(R.joined(F.col("title"), F.col("summary")), F.col("url"), ORGS), ",").alias("orgs"))


TIERS = {"pub1.example.com": 2, "pub3.example.com": 2, "pub5.example.com": 4, "pub7.example.com": 4}
TIER = "CASE WHEN publisher_domain IN ('pub1.example.com', 'pub3.example.com') THEN 2 WHEN publisher_domain IN ('pub5.example.com', 'pub7.example.com') THEN 4 WHEN publisher_domain IS NOT NULL THEN 5 END"


@query("tier_for_domain", ctes("full_articles") + f"SELECT id, coalesce({TIER}, 0) AS tier FROM full_articles")
def tier_for_domain(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "full_articles").select("id", F.coalesce(R.tier_for_domain(F.col("publisher_domain"), TIERS, ORGS), F.lit(0)).alias("tier"))


@query("domain_suffix_join", f"WITH h AS (SELECT page_id, {HOST} AS host FROM pages), k AS (SELECT host AS domain, row_number() OVER (ORDER BY host) AS place FROM (SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS host FROM h) WHERE host <> '') SELECT page_id, host, arg_min(domain, place) AS domain FROM h JOIN k ON host = domain OR ends_with(host, '.' || domain) GROUP BY 1, 2")
def domain_suffix_join(spark: SparkSession, d: str) -> DataFrame:
    from tidewire.operators.similarity import domain_suffix_join as op

    hosts = spark.read.parquet(f"{d}/pages.parquet").select("page_id", W.host_of(F.col("url")).alias("host"))
    known = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("domain")).where("domain <> ''").distinct()
    return op(hosts, known.withColumn("place", F.col("domain")), "page_id", "host")


SCORE = "(CASE WHEN publisher_domain IS NOT NULL THEN 3 ELSE base_credibility END)"


@query("score_credibility", ctes("full_articles", "sources") + f""", s AS (SELECT a.id, {SCORE} AS start, CASE WHEN {sql_any(JOINED, [p for _, p in R.rt.RUMOUR_PATTERNS])} THEN 1 ELSE 0 END AS hedge, a.corroboration_count >= 2 AS many, a.publisher_domain IS NOT NULL AS named, a.author IS NULL AND a.id % 2 = 0 AS bare FROM full_articles a JOIN sources s ON s.id = a.source_id),
t AS (SELECT *, start - hedge + CASE WHEN many THEN 1 ELSE 0 END - CASE WHEN bare THEN 1 ELSE 0 END AS raw FROM s)
SELECT id, CAST(greatest(1, least(5, raw)) AS INT) AS score, greatest(1, least(5, raw)) <= 2 AS is_rumour, concat_ws(',', CASE WHEN named THEN 'publisher-unknown:0' ELSE 'source:0' END, CASE WHEN hedge = 1 THEN 'hedged:-1' END, CASE WHEN many THEN 'corroborated:1' END, CASE WHEN bare THEN 'no-provenance:-1' END,
  CASE WHEN raw NOT BETWEEN 1 AND 5 THEN concat('clamped:', CAST(CAST(greatest(1, least(5, raw)) - raw AS INT) AS VARCHAR)) END) AS reasons FROM t""")
def score_credibility(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "sources").select(F.col("id").alias("source_id"), "base_credibility")
    c = lambda n: F.col(n)
    scored = R.score_credibility(title=c("title"), summary=c("summary"), url=c("url"), base=c("base_credibility"), publisher=c("publisher_domain"), author=c("author"), has_date=c("id") % 2 == 1, corroboration=c("corroboration_count"))
    return view(spark, d, "full_articles").join(s, "source_id").select("id", scored.alias("s")).select("id", "s.score", "s.is_rumour", F.array_join(F.transform("s.reasons", lambda r: F.concat(r["rule"], F.lit(":"), r["delta"].cast("string"))), ",").alias("reasons"))


WEIGHT = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CATEGORY_WEIGHT.items()) + " END"


@query("score_impact", ctes("full_articles") + f"""SELECT id, CAST(greatest(0, least(100, floor({WEIGHT} + CASE WHEN id % 7 IN (0, 1) THEN 8 ELSE 0 END + credibility * 4 + corroboration_count * 3 + CASE WHEN id % 50 > 0 THEN least(log10(id % 50 + 1) * 8, 16) ELSE 0 END + CASE WHEN id % 30 > 0 THEN least(log10(id % 30 + 1) * 10, 20) ELSE 0 END - CASE WHEN id % 6 = 0 THEN 25 ELSE 0 END + 0.5))) AS INT) AS impact FROM full_articles""")
def score_impact(spark: SparkSession, d: str) -> DataFrame:
    orgs = F.array(F.concat(F.lit("org"), (F.col("id") % 7).cast("string")))
    c = F.col
    out = R.score_impact(category=c("category"), credibility=c("credibility"), orgs=orgs, corroboration=c("corroboration_count"), points=c("id") % 50, upvotes=c("id") % 30, case_study=c("id") % 6 == 0, primary=["org0", "org1"])
    return view(spark, d, "full_articles").select("id", out.alias("impact"))


def model_titles(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose title speaks of products by a fixed scheme."""
    n = lambda k: (F.col("id") % k).cast("string")
    said = F.concat(F.lit("GPT-"), n(13), F.lit(" meets Claude Opus 4."), n(6), F.lit(", Qwen "), n(40), F.lit("b and gemini 2.5 Pro: "), "title")
    return view(spark, d, "full_articles").withColumn("title", said)


MENTIONS = """m AS (SELECT id, 'gpt-' || CAST(id % 13 AS VARCHAR) AS slug, 1 AS place FROM full_articles WHERE id % 13 <= 10 UNION ALL SELECT id, 'claude-4.' || CAST(id % 6 AS VARCHAR) || '-opus', 2 FROM full_articles UNION ALL SELECT id, 'gemini-2.5-pro', 4 FROM full_articles) """


@query("extract_models", ctes("full_articles").rstrip() + ", " + MENTIONS + "SELECT id, string_agg(slug, ',' ORDER BY place) AS slugs FROM m GROUP BY 1")
def extract_models(spark: SparkSession, d: str) -> DataFrame:
    found = R.extract_models(R.joined(F.col("title"), F.col("summary")))
    return model_titles(spark, d).select("id", F.array_join(F.transform(found, lambda m: m["slug"]), ",").alias("slugs"))


@query("derive_status", ctes("full_articles") + "SELECT id, CASE WHEN id % 9 = 0 THEN 'released' WHEN credibility >= 4 THEN 'confirmed' WHEN credibility >= 3 OR corroboration_count >= 2 THEN 'reported' ELSE 'rumoured' END AS status FROM full_articles")
def derive_status(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "full_articles").select("id", R.derive_status(F.col("id") % 9 == 0, F.col("credibility"), F.col("corroboration_count")).alias("status"))


@query("same_outlet", ctes("full_articles") + "SELECT a.id, CASE WHEN a.publisher_domain IS NOT NULL AND b.publisher_domain IS NOT NULL THEN a.publisher_domain = b.publisher_domain WHEN a.publisher_domain IS NULL AND b.publisher_domain IS NULL THEN a.source_id = b.source_id ELSE false END AS same FROM full_articles a JOIN full_articles b ON b.id = a.id + 46 OR b.id = a.id + 40 OR b.id = a.id + 1")
def same_outlet(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "full_articles").select("id", "source_id", "publisher_domain")
    near = a.select("id", "source_id", "publisher_domain", F.explode(F.array(*[F.col("id") + k for k in (1, 40, 46)])).alias("other"))
    b = a.select(F.col("id").alias("other"), F.col("source_id").alias("s"), F.col("publisher_domain").alias("p"))
    return near.join(b, "other").select("id", R.same_outlet(F.col("source_id"), F.col("publisher_domain"), F.col("s"), F.col("p")).alias("same"))


def llm_raw(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    answer = F.struct(
        F.concat(F.lit(" About "), c("source_id").cast("string"), F.lit(" ")).alias("summary"), F.when(c("id") % 3 == 0, "nonsense").otherwise(c("category")).alias("category"),
        F.array(F.lit("Some Tag"), F.lit("x"), F.lit("some-tag"), F.concat(F.lit("T"), (c("id") % 5).cast("string"))).alias("tags"), F.array(F.concat(F.lit("org"), (c("id") % 9).cast("string")), F.lit("org1")).alias("orgs"),
        F.when(c("id") % 4 == 0, "confirmed").when(c("id") % 4 == 1, "unconfirmed").otherwise("maybe").alias("claim_status"), F.lit(" because ").alias("status_reason"),
    )
    return view(spark, d, "full_articles").withColumn("raw", F.to_json(answer))


@query("normalize_llm_response", ctes("full_articles") + "SELECT id, concat('About ', source_id) AS summary, CASE WHEN id % 3 = 0 THEN 'other' ELSE category END AS category, concat('some-tag,t', id % 5) AS tags, CASE WHEN id % 9 = 1 THEN 'org1' WHEN id % 9 < 7 THEN concat('org', id % 9, ',org1') ELSE 'org1' END AS orgs, CASE id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'unconfirmed' ELSE 'reported' END AS claim, 'because' AS reason FROM full_articles")
def normalize_llm_response(spark: SparkSession, d: str) -> DataFrame:
    from tidewire.operators.feed import CATEGORIES

    n = R.normalize_llm_response(F.col("raw"), CATEGORIES, [f"org{k}" for k in range(7)])
    return llm_raw(spark, d).select("id", n.alias("n")).select("id", "n.summary", "n.category", F.array_join("n.tags", ",").alias("tags"), F.array_join("n.orgs", ",").alias("orgs"), "n.claim", "n.reason")


@query("detect_kind", ctes("sources") + "SELECT id, kind FROM sources")
def detect_kind(spark: SparkSession, d: str) -> DataFrame:
    #: A feed URL of each kind.
    urls = {"rss": "https://a.example.com/feed.xml", "github_releases": "https://github.com/a/b/releases.atom", "google_news": "https://news.google.com/rss/search?q=x", "arxiv": "https://rss.arxiv.org/rss/cs.AI".replace("rss.arxiv", "arxiv"), "hf_papers": "https://huggingface.co/api/daily_papers", "hf_models": "https://huggingface.co/api/models?author=a", "hn": "https://hn.algolia.com/api/v1/search", "reddit": "https://www.reddit.com/r/x/.rss"}
    url = F.create_map(*[F.lit(x) for p in urls.items() for x in p])[F.col("kind")]
    return view(spark, d, "sources").select("id", W.detect_kind(F.concat(url, F.lit("#"), "slug")).alias("kind"))


@query("cosine_similarity", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(X.cosine_similarity(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query("centroid", "SELECT label, pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def centroid(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    out = centroid_op(e, "label", "embedding", "vec_id").select("label", F.posexplode("centroid").alias("pos", "x"))
    return out.select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


