"""What small tables don't show: ids of many digits, rare word forms, indexes larger than their files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.functions.stemmer import FOURTH, SECOND, THIRD, lexeme
from tidewire.llm import simhash
from tidewire.operators import similarity as S
from tidewire.operators import vectors
from tidewire.operators.shared import stage
from tidewire.plans import catalog, feeds
from tidewire.plans.relational import ENDINGS, every_form, forms


def test_items_of_long_ids_keep_their_links(spark, sf, tmp_path):
    """Ids beyond 99,999 that begin with the same five digits."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.withColumn("doc_id", F.col("doc_id") + 1_000_000).write.parquet(str(tmp_path / "documents.parquet"))
    found = feeds.route_payloads(spark, str(tmp_path)).collect()
    assert len(found) == 8 and all(r.urls == r.n for r in found), found


def test_every_word_form_is_listed():
    """Against the stemmer over two endings, of the steps' tables too."""
    ends = ["", "e", *ENDINGS, *SECOND, *THIRD, *FOURTH]
    for token in ("anan", "ther"):
        listed = set(every_form(token)[1:-1].split("', '"))
        assert set(forms(token)[1:-1].split("', '")) < listed
        assert {token + a + b + c for a in ends for b in ends for c in ("", "s") if lexeme(token + a + b + c) == token} <= listed
        assert all(lexeme(w) == token for w in listed)


def test_index_of_hyperplanes_is_not_broadcast(spark, monkeypatch):
    """Its files are far smaller than its rows: neither it nor the vectors may go to the driver."""
    rows = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(16)), lambda j: F.sin(F.col("id") * j + j)).alias("v"))
    plans = []
    monkeypatch.setattr(vectors, "stage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stage(df))[1])
    out = vectors.cosine_join_approximate(rows, 0.8)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3 and not any("Broadcast" in p for p in plans)


def test_texts_that_a_pattern_needs(spark):
    """Patterns are searched only where such a text stands; none is taken from what may be missing."""
    assert rules.needed(r"(?i)\bopen[- ]?(weight|source)s?\b") == ["weight", "source"]
    assert rules.needed(r"(?i)\bcolou?rs? of (the )?water\b") == ["water"]
    assert rules.needed(r"\b(ban(ned|s)?|x)\b") == [] and rules.needed("model card|mcp") == [] and rules.needed(r"(rare){0,1}(?!never)[a-z]+") == []
    text = [("The LEAKİ of a leakK, leaked",), ("Customer\nSTORY, case Stories",), ("colours of water",), ("",), (None,)]
    rows = spark.createDataFrame(text, "t string").select(*[rules.any_of(F.col("t"), [p]).alias(f"p{n}") for n, p in enumerate([r"(?i)\bleak(ed|s)?\b", r"(?i)\b(customer|case) stor(y|ies)\b", r"(?i)\bcolou?rs? of (the )?water\b"])])
    assert [tuple(bool(v) for v in r) for r in rows.collect()] == [(True, False, False), (False, True, False), (False, False, True), (False,) * 3, (False,) * 3]


def test_bundles_are_told_without_a_join(spark, monkeypatch):
    """The least row of a key comes with the key's counts, so that a large bundle makes no rows of a join."""
    staged, plans = simhash.staged, {}
    monkeypatch.setattr(simhash, "staged", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), staged(df, name))[1])
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*words[:k], f"x{k}", *words[k + 1 :]])) for k in range(40)] + [(90, "a text of its own that no other is like")]
    table = spark.createDataFrame(rows, "row long, text string")
    got = {r.row: r.group for r in simhash.similar_groups(staged(table, "test-rows")).collect()}
    assert got == {k: 90 if k == 90 else 0 for k, _ in rows} and "Join" not in plans["similar-stars"]


def test_first_fit_writes_no_link_by_vectors(spark, monkeypatch):
    """1,500 vectors that all match: over a million links, of which none is written or gathered in a task; and a chain of titles."""
    from tidewire.operators import jobs, similarity

    written = []

    def counted(df):
        out = stage(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(jobs, "stage", counted)
    monkeypatch.setattr(similarity, "stage", counted)
    n = 1500
    v = F.array(F.lit(1.0), F.col("id") / F.lit(10.0 * n)).cast("array<float>")
    rows = spark.range(n).select("id", F.concat(F.lit("word"), "id").alias("title"), v.alias("v"), F.lit("m").alias("model"), F.timestamp_seconds(n - F.col("id")).alias("published_at"))
    got = jobs.cluster_stories(rows, vector_threshold=0.9)
    assert got.where(f"story = {n - 1}").count() == n and max(written) <= 2 * n
    chain = spark.range(90).select("id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(F.lit("word"), F.col("id") + k)).alias("words"))
    chain = chain.select("id", F.array_join("words", " ").alias("title"), F.lit(None).cast("array<float>").alias("v"), F.lit(None).cast("string").alias("model"), F.timestamp_seconds("id").alias("published_at"))
    assert jobs.cluster_stories(chain).where("story = 0").count() == 90


def test_a_rescored_row_is_scored_once(spark, sf):
    """A filter on the score must not have every pattern searched in the join and again for the rows that pass."""
    for name in ("rescore", "score_movement"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") == len(rules.rt.RUMOUR_PATTERNS), name


def test_a_repeated_title_like_many_makes_few_links(spark):
    """300 rows of a title and two more repeated ones, like 150 titles that come once: links follow the rows, and the groups are those of a loop. One repeated class doesn't match itself."""
    rng = np.random.default_rng(4)
    places = rng.permutation(510)
    classes = ["a"] * 300 + ["b"] * 40 + ["c"] * 20 + [f"s{k}" for k in range(150)]
    number = {c: n for n, c in enumerate(dict.fromkeys(classes))}
    rows = spark.createDataFrame([(k, int(p), number[c]) for k, (p, c) in enumerate(zip(places, classes))], "id long, place long, class long")
    like = {(x, y) for x in "abc" for y in number if y[0] == "s" and rng.random() < (0.9 if x == "a" else 0.02)} | {("a", "b"), ("b", "c")}
    like |= {(y, x) for x, y in like} | {("a", "a"), ("b", "b")} | {(x, x) for x in number if x[0] == "s"}
    edges = spark.createDataFrame([(number[x], number[y]) for x, y in like], "item long, lead long")
    links, chains, apart = S.earlier_links(rows.select("id", F.col("place").alias("pos"), "class"), edges)
    assert links.count() < 700 and chains.count() == 340 and apart.count() == 20

    none = spark.createDataFrame([], "id long, v array<float>, m string")
    reached: dict[int, int] = {}
    in_order = sorted(zip(places, classes, range(510)))
    for n, (_, c, k) in enumerate(in_order):
        reached[k] = min([k_ for k_ in [reached[o] for _, d, o in in_order[:n] if (c, d) in like]], key=lambda g: places[g], default=k)
    assert {r.id: r.group for r in S.ordered_pass(rows, edges, none, 0.5).collect()} == reached


@pytest.mark.parametrize("threshold", [0.2, 0.75])
def test_vectors_are_held_against_the_least_labels_first(spark, threshold):
    """Few first leads and small rounds of items, against all pairs."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    g = np.where(rng.random(400) < 0.5, np.arange(400), np.arange(400) // 3)
    kind, leads = rng.integers(2, size=400), rng.random(400) < 0.8
    df = spark.createDataFrame([(k, int(g[k]), v[k].tolist(), f"m{kind[k]}", k // 50, bool(leads[k])) for k in range(400)], "node long, g long, v array<float>, m string, b int, lead boolean")
    found = S.least_earlier(df.drop("lead"), df.where("lead").drop("lead"), threshold, few=20, held=120)
    got = {r.node: r.h for r in found.groupBy("node").agg(F.min("h").alias("h")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u.astype(float) @ u.astype(float).T
    want = {k: min([int(g[o]) for o in range(k) if leads[o] and kind[o] == kind[k] and s[k, o] >= threshold], default=int(g[k])) for k in range(400)}
    assert all(min(got.get(k, g[k]), g[k]) == min(want[k], g[k]) for k in range(400)) and any(want[k] < g[k] for k in want)
    assert S.least_earlier(df.drop("lead"), df.where("lead").drop("lead").limit(0), threshold) is None


def test_tables_where_products_are_more_work_are_not_broadcast(spark, monkeypatch):
    """The path of ``cosine_join_approximate`` for more rows; and products send no more than a part of the vectors at once."""
    rows = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(16)), lambda j: F.sin(F.col("id") * j + j)).alias("v"))
    plans = []
    monkeypatch.setattr(vectors, "stage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stage(df))[1])
    out = vectors.cosine_join_approximate(rows, 0.8, products=0)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3 and "SortMergeJoin" in plans[-1] and not any("Broadcast" in p for p in plans)
    plans.clear()
    vectors.cosine_join_by_products(rows.select(F.col("id").alias("k"), F.lit("").alias("m"), "v"), 0.8, held_mb=0.01)
    assert len(plans) == 1 + 4 and not any("Broadcast" in p or "Join" in p for p in plans)
