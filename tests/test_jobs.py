"""Similarity joins and ordered passes against plain loops."""

import collections
import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import pytest
from tidewire.functions.models import FatalModelError, brief_writer, hashing_embedder
from tidewire.operators.jobs import llm_apply
from tidewire.operators.state import upsert_latest
from tidewire.functions import text as X
from tidewire.functions import web as W
from tidewire.operators import jobs as J
from tidewire.operators import similarity as S
from tidewire.plans import catalog
from tidewire.plans.stories import cycle, with_vectors
from tidewire.sources.views import view


def by_time(rows):
    cols = ["id", "title", "v", "model", "published_at", "source_id", "publisher_domain", X.title_tokens(F.col("title")).alias("tokens")]
    return rows.select(*cols).orderBy("published_at", "id").collect()


def by_titles(a, b):
    s, t = set(a.tokens or []), set(b.tokens or [])
    return len(s & t) / len(s | t) if s and t else 0.0


def by_vectors(a, b):
    x, y = np.array(a.v, float), np.array(b.v, float)
    return x @ y / max(np.linalg.norm(x), 1e-300) / max(np.linalg.norm(y), 1e-300) if a.model is not None and a.model == b.model else 0.0


def first_fit(rows):
    def match(a, b):
        return by_vectors(a, b) >= 0.35 - 1e-12 if a.v is not None and b.v is not None else by_titles(a, b) >= J.STORY_TITLE - 1e-12

    groups: list[list] = []
    for r in rows:
        g = next((g for g in groups if any(match(m, r) for m in g)), None)
        groups.append([r]) if g is None else g.append(r)
    return {r.id: (g[0].id if len(g) > 1 else None) for g in groups for r in g}


def leaders(rows, hours=None):
    made, want = [], {}
    for n, r in enumerate(rows):
        recent = [(k, m) for k, m in made if hours is None or r.published_at - m.published_at <= datetime.timedelta(hours=hours)]
        if r.v is not None:
            near = [(round(by_vectors(m, r), 12), k, m) for k, m in recent if m.v is not None and by_vectors(m, r) >= 0.35 - 1e-12]
        else:
            near = [(by_titles(m, r), k, m) for k, m in recent if by_titles(m, r) >= J.DUPLICATE_TITLE - 1e-12]
        if not near:
            made.append((n, r))
            want[r.id] = (r.id, "inserted")
            continue
        m = max(near, key=lambda x: x[:2])[2]
        both, neither = r.publisher_domain and m.publisher_domain, not r.publisher_domain and not m.publisher_domain
        same = r.publisher_domain == m.publisher_domain if both else r.source_id == m.source_id if neither else False
        want[r.id] = (m.id, "skipped" if same else "duplicate")
    return want


def got_leaders(rows, **more):
    return {r.id: (r.leader, r.status) for r in J.dedup_leader(rows, vector_threshold=0.35, **more).collect()}


def test_first_fit_equals_loop(spark, sf):
    want = first_fit(by_time(with_vectors(spark, sf)))
    got = {r.id: r.story for r in J.cluster_stories(with_vectors(spark, sf), vector_threshold=0.35).collect()}
    assert got == want and any(want.values())
    recent = with_vectors(spark, sf).where("published_at >= TIMESTAMP '2024-01-24 00:00:00'")
    assert {r.id: r.story for r in catalog.queries()["cluster_stories"](spark, sf).collect()} == first_fit(by_time(recent))


def test_leader_equals_loop(spark, sf):
    rows = with_vectors(spark, sf)
    assert {r.id: (r.leader, r.status) for r in catalog.queries()["dedup_leader"](spark, sf).collect()} == leaders(by_time(rows), 72)
    assert got_leaders(rows, hours=None) == leaders(by_time(rows))


def mixed(spark, seed, n=160):
    """Rows with repeated titles and vectors, some without, some of a null or another model, of zero length or without words."""
    rng = np.random.default_rng(seed)
    titles = ["alpha bravo charlie delta", "alpha bravo charlie echo", "kilo lima mike november oscar", "kilo lima mike november papa", "", None, "the of"]
    vectors = [None, [1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.7, 0.7], [0.0, 0.0, 0.0]]
    start = datetime.datetime(2024, 1, 1)
    pick = lambda xs: xs[rng.integers(len(xs))]
    rows = [
        (k, pick(titles), pick(vectors), pick(["m", "m", "n", None]), start + datetime.timedelta(hours=int(rng.integers(0, 600))), int(rng.integers(3)), pick([None, "p", "q"]))
        for k in range(n)
    ]
    shape = "id long, title string, v array<float>, model string, published_at timestamp, source_id long, publisher_domain string"
    return spark.createDataFrame(rows, shape)


@pytest.mark.parametrize("seed", [1, 2])
def test_passes_equal_loops_on_copies_and_gaps(spark, seed):
    rows = mixed(spark, seed)
    in_time = by_time(rows)
    assert got_leaders(rows) == leaders(in_time, 72)
    assert {r.id: r.story for r in J.cluster_stories(rows, vector_threshold=0.35).collect()} == first_fit(in_time)


def test_look_back_ends_after_its_hours(spark):
    at = [0, 72, 73, 100, 300]
    rows = [(k, "alpha bravo charlie", None, None, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h), k, None) for k, h in enumerate(at)]
    df = spark.createDataFrame(rows, "id long, title string, v array<float>, model string, published_at timestamp, source_id long, publisher_domain string")
    assert {k: v[0] for k, v in got_leaders(df).items()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert {k: v[0] for k, v in got_leaders(df, hours=None).items()} == dict.fromkeys(range(5), 0)
    assert J.dedup_leader(df.limit(0)).count() == 0 and J.cluster_stories(df.limit(0)).count() == 0


def test_a_title_repeated_often_makes_no_pairs(spark):
    df = spark.range(60_000).select("id", F.lit("alpha bravo charlie").alias("title"), F.lit(None).cast("array<float>").alias("v"), F.lit(None).cast("string").alias("model"))
    df = df.withColumns({"published_at": F.timestamp_seconds("id"), "source_id": F.col("id"), "publisher_domain": F.lit(None).cast("string")})
    rows, edges = J.linked_classes(df, 0.6, 0.88, 72 * 3_600_000_000, True)
    assert edges.count() == 1 and J.dedup_leader(df).where("leader = 0").count() == 60_000


def test_spans_keep_the_pairs_of_adjoining_spans(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [float(x) for x in rng.normal(size=4)], int(rng.integers(0, 5))) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<float>, g int")
    unit = {k: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for k, v, _ in rows}
    want = {(a, b) for a, _, g in rows for b, _, h in rows if a < b and abs(g - h) <= 1 and unit[a] @ unit[b] >= 0.5}
    assert {(r.a, r.b) for r in S.cosine_similarity_join(df, 0.5, block=7, span="g").collect()} == want and want


def test_prefix_join_equals_brute_force(spark, sf):
    rows = view(spark, sf, "articles").select("id", X.title_tokens(F.col("title")).alias("tokens")).collect()
    want = {(a.id, b.id) for a in rows for b in rows if a.id < b.id and a.tokens and b.tokens and len(set(a.tokens) & set(b.tokens)) / len(set(a.tokens) | set(b.tokens)) >= 0.3}
    df = spark.createDataFrame([(r.id, r.tokens) for r in rows], "id long, tokens array<string>")
    assert {(r.a, r.b) for r in S.title_similarity_join(df, 0.3).collect()} == want and want


def walked(rows, edges, look_back=None):
    """rows: (id, place, class, fixed); edges: item -> [(lead, similarity)]. The ordered pass as a loop over all rows."""
    latest, out = {}, {}
    for n, (k, place, c, fixed) in enumerate(sorted(rows, key=lambda r: (not r[3], r[1], r[0]))):
        met = [] if fixed else [(s, *latest[o][1:]) for o, s in edges.get(c, ()) if o in latest and (look_back is None or latest[o][0] >= place - look_back)]
        out[k] = max(met)[2] if met else k
        if not met:
            latest[c] = (place, n, k)
    return out


def in_rounds(spark, rows, edges, **more):
    links = pd.DataFrame([(a, b, s) for a, own in edges.items() for b, s in own], columns=["item", "lead", "similarity"])
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "place", "class", "fixed"]))
    return {r.id: r.group for r in S.leader_pass(df, spark.createDataFrame(links, "item long, lead long, similarity double"), **more).collect()}


@pytest.mark.parametrize("look_back", [None, 40])
@pytest.mark.parametrize("in_range", [7, 20_000])
def test_rounds_equal_a_loop(spark, look_back, in_range):
    """Classes of several rows, some fixed, some that only lead; a class lies within one span of the look-back."""
    rng = np.random.default_rng(look_back or 1)
    kind = {c: rng.choice(["item", "item", "item", "lead", "alone"] if look_back else ["item", "item", "lead", "fixed", "alone"]) for c in range(120)}
    base = {c: int(rng.integers(0, 12)) * 40 for c in kind}
    rows = [(1000 + k, base[c] + int(rng.integers(40)), c, kind[c] == "fixed") for k, c in enumerate(rng.integers(0, 120, 700).tolist())]
    edges = {}
    for c in kind:
        if kind[c] == "item":
            edges[c] = [(c, 1.0)] + [(int(o), float(rng.choice([0.7, 0.8, 0.9]))) for o in rng.choice(120, 5, replace=False) if o != c]
        elif kind[c] == "alone" and c % 2:
            edges[c] = [(c, 1.0)]
    assert in_rounds(spark, rows, edges, look_back=look_back, in_range=in_range) == walked(rows, edges, look_back)


def test_rounds_take_one_component_of_many_rows(spark):
    """A chain through 200,000 rows, each linked with its neighbours in the order and some of far away."""
    n = 200_000
    rng = np.random.default_rng(2)
    far = rng.integers(0, n, n // 4)
    edges = {k: [(k, 1.0), *[(o, 0.7) for o in (k - 1, k + 1) if 0 <= o < n]] for k in range(n)}
    for a, b in zip(rng.integers(0, n, n // 4).tolist(), far.tolist()):
        if abs(a - b) > 1:
            edges[a].append((b, 0.8))
            edges[b].append((a, 0.8))
    edges = {k: list(dict(v).items()) for k, v in edges.items()}
    rows = [(k, k // 2, k, False) for k in range(n)]
    assert in_rounds(spark, rows, edges) == walked(rows, edges)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 103)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [*range(1, 41), 100, 101, 103, 500]], "id long")
    got = {r.id: r.component for r in S.components(edges, nodes, J.stage).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 103: 100, 500: 500}


def test_embedding_failures_stay_in_their_rows(spark):
    from tidewire.functions.models import embed, llm_enrich

    def bad(texts):
        if "boom" in texts:
            raise ValueError
        return [[0.0] * 3 if t == "short" else [1.0] * 64 for t in texts]

    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "short")], "id long, text string").coalesce(1)
    got = {r.id: r.status for r in embed(df, bad, batch=1).collect()}
    assert got == {1: "ok", 2: "failed: ValueError", 3: "wrong size"}

    def client(title, body):
        return {"a": "{}"}[title]

    got = {r.id: r.status for r in llm_enrich(spark.createDataFrame([(1, "a", None), (2, "b", None)], "id long, title string, summary string"), client).collect()}
    assert got == {1: "ok", 2: "failed: KeyError"}


def test_all_vectors_count(spark, sf):
    given = {r.vec_id for r in spark.read.parquet(sf + "/embeddings.parquet").select("vec_id").collect()}
    rows = with_vectors(spark, sf).select("id", "v").collect()
    assert {r.id for r in rows if r.v is not None} == {r.id for r in rows} & given and any(r.v is not None and r.id % 2 for r in rows)


def test_missing_vectors_and_other_models(spark):
    one, two, same, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], "alpha bravo charlie delta", "kilo lima mike november"
    own = [
        (1, "red orange yellow", one, "m"), (3, "green blue violet", one, "m"),  # by vectors alone
        (5, "north south east", one, "n"), (7, "red orange yellow", two, "n"),  # other models; with vectors titles don't count
        (9, same, None, None), (10, same, [0.0, 0.0, 1.0], "m"),  # one vector is missing: by titles
        (11, other, None, None), (13, other, None, None), (15, "five six seven", None, None),
    ]
    rows = spark.createDataFrame([(*r, r[0], f"p{r[0]}") for r in own], "id long, title string, v array<float>, model string, source_id long, publisher_domain string")
    rows = rows.withColumn("published_at", F.timestamp_seconds("id"))
    got = {r.id: r.story for r in J.cluster_stories(rows, vector_threshold=0.35).collect()}
    assert got == {1: 1, 3: 1, 5: None, 7: None, 9: 9, 10: 9, 11: 11, 13: 11, 15: None}
    led = {r.id: (r.leader, r.status) for r in J.dedup_leader(rows, vector_threshold=0.35).collect()}
    assert led == {**{k: (k, "inserted") for k in (1, 5, 7, 9, 11, 15)}, 3: (1, "duplicate"), 10: (10, "inserted"), 13: (11, "duplicate")}


def test_latest_version_wins_and_late_rows_lose(spark):
    held = spark.createDataFrame([(1, "held", 5), (2, "held", 5), (3, "held", 5)], "id int, name string, version int")
    new = spark.createDataFrame([(1, "late", 4), (2, "new", 6), (3, "same", 5), (4, "first", 1)], held.schema)
    got = {r.id: r.name for r in upsert_latest(held, new, ["id"], "version").collect()}
    assert got == {1: "held", 2: "new", 3: "same", 4: "first"}


def test_rows_without_a_result_stay_as_they_are(spark):
    shape = "id long, title string, summary string, url string, base_credibility int, publisher_domain string, author string, corroboration_count int, category string, credibility int, enriched_by string"
    a = spark.createDataFrame([(k, "T", "S", "https://a.b/c", 3, None, "x", 0, "deal", 2, "rules") for k in (1, 2)], shape)
    n = F.struct(F.lit("new").alias("summary"), F.lit("policy").alias("category"), F.array(F.lit("t")).alias("tags"), F.array().cast("array<string>").alias("orgs"), F.lit("confirmed").alias("claim"), F.lit("").alias("reason"))
    out = {r.id: r for r in llm_apply(a, a.where("id = 1").select("id", n.alias("n"))).collect()}
    assert (out[1].summary, out[1].category, out[1].enriched_by, out[1].credibility) == ("new", "policy", "llm", 3)
    assert (out[2].summary, out[2].category, out[2].enriched_by, out[2].credibility) == ("S", "deal", "rules", 2)


def test_brief_falls_back_only_on_fatal_errors(spark):
    c = spark.createDataFrame([(1, "A", "sa", "u", "S", 9, 4, "s1"), (2, "B", None, "v", "S", 8, 4, None)], "id long, title string, summary string, url string, source_name string, impact int, credibility int, story_id string")

    def fatal(given):
        raise FatalModelError

    def broken(given):
        raise KeyError("x")

    plain = brief_writer(c, "2024-01-19", None).collect()
    assert plain == brief_writer(c, "2024-01-19", fatal).collect() and list(plain[0].article_ids) == [1, 2]
    with pytest.raises(KeyError):
        brief_writer(c, "2024-01-19", broken)
    assert brief_writer(c.limit(0), "2024-01-19", broken).count() == 0


def test_cycle_equals_loop(spark, sf):
    """Statuses and the log by source against a loop over the new items in order of time."""
    now = datetime.datetime(2024, 1, 31)
    given, held, known = cycle(spark, sf)
    inserted, again, log = J.ingest_batch(given, held, known, str(now), vector_threshold=0.6)
    urls, folded = {r.canonical_url for r in held.collect()}, {r.url for r in known.collect()}
    fresh = [r for r in given.withColumn("c", W.canonicalize_url(F.col("url"))).collect() if r.published_at >= now - datetime.timedelta(days=14)]
    new = sorted((r for r in fresh if r.c not in urls and r.url not in folded), key=lambda r: (r.published_at, r.id))
    text = {r.id: r.t for r in given.select("id", X.embedding_text(F.col("title"), F.col("content")).alias("t")).collect()}
    unit = lambda t: np.float32(hashing_embedder([t])[0]).astype(float)
    lead = [(r.published_at, np.float32(r.v).astype(float), r) for r in held.orderBy("published_at", "id").collect()]
    assert all(text[r.id] for r in new) and len(new) > 3
    want = {}
    for r in new:
        v = unit(text[r.id])
        near = [(round(v @ w / np.linalg.norm(v) / np.linalg.norm(w), 9), n, m) for n, (at, w, m) in enumerate(lead) if at >= now - datetime.timedelta(hours=72)]
        near = [x for x in near if x[0] >= 0.6]
        m = max(near, key=lambda x: x[:2])[2] if near else None
        if m is None:
            lead.append((r.published_at, v, r))
            want[r.id] = None
        else:
            same = r.publisher_domain == m.publisher_domain if r.publisher_domain and m.publisher_domain else not (r.publisher_domain or m.publisher_domain) and r.source_id == m.source_id
            want[r.id] = "skipped" if same else m.id
    assert {r.id for r in inserted.collect()} == {k for k, m in want.items() if m is None}
    assert {r.id: r.article_id for r in again.collect()} == {k: m for k, m in want.items() if m not in (None, "skipped")}
    got = {r.source_id: (r.items_seen, r.items_new, r.items_duplicate) for r in log.collect()}
    of = {r.id: r.source_id for r in new}
    count = lambda test: collections.Counter(of[k] for k, m in want.items() if test(m))
    seen, fine, twice = collections.Counter(r.source_id for r in fresh), count(lambda m: m is None), count(lambda m: m not in (None, "skipped"))
    assert got == {s: (n, fine[s], twice[s]) for s, n in seen.items()}


def test_cycle_without_vectors_and_held_rows_that_match_each_other(spark):
    """Failing calls leave the title; held rows lead each by itself; items of before the look-back are inserted but match nothing."""
    now = datetime.datetime(2024, 1, 31)
    one, two = "alpha bravo charlie delta", "kilo lima mike november"
    a = [(k, one, now - datetime.timedelta(hours=h)) for k, h in ((1, 10), (2, 5), (3, 200))]
    shape = "id long, title string, published_at timestamp"
    held = spark.createDataFrame(a, shape).withColumns({"canonical_url": F.concat(F.lit("https://h.x/"), "id"), "v": F.lit(None).cast("array<float>"), "model": F.lit(None).cast("string"), "source_id": F.lit(9), "publisher_domain": F.lit("h.x")})
    b = [(11, one, 4), (12, two, 100), (13, two, 3), (14, two, 2), (15, "", 1), (16, one, 400)]
    given = spark.createDataFrame([(k, t, now - datetime.timedelta(hours=h)) for k, t, h in b], shape)
    null = lambda kind: F.lit(None).cast(kind)
    given = given.withColumns({
        "content": null("string"), "url": F.concat(F.lit("https://n.x/"), "id"), "author": null("string"), "publisher_domain": null("string"), "base_credibility": F.lit(3),
        "source_org": null("string"), "source_id": F.col("id").cast("int"), "corroboration": F.lit(0), "points": F.lit(0), "upvotes": F.lit(0), "keywords": null("array<string>"),
        "is_paper": F.lit(False), "is_model_release": F.lit(False), "is_release": F.lit(False), "position": F.col("id"),
    })

    def down(texts):
        raise OSError

    known = spark.createDataFrame([("https://other.x/1",)], "url string")
    inserted, again, log = J.ingest_batch(given, held, known, str(now), down)
    assert {r.id for r in inserted.collect()} == {12, 13, 15} and {r.id: r.article_id for r in again.collect()} == {11: 2, 14: 13}
    assert log.where("source_id = 16").count() == 0 and log.agg(F.sum("items_seen")).head()[0] == 5
    none = J.ingest_batch(given.limit(0), held, known, str(now))
    assert [x.count() for x in none] == [0, 0, 0]


def test_a_fatal_error_stops_a_tasks_calls(spark, tmp_path):
    """One call after another until the fatal one, and none after it; the rows say which they are."""
    from tidewire.functions.models import embed, llm_enrich

    calls = tmp_path / "calls"

    def fatal(texts):
        with open(calls, "a") as f:
            f.write("x")
        if "3" in texts:
            raise FatalModelError
        return [[1.0] * 64 for _ in texts]

    df = spark.range(10).select("id", F.col("id").cast("string").alias("text")).coalesce(1)
    got = [r.status for r in embed(df, fatal, batch=1).orderBy("id").collect()]
    assert got == ["ok"] * 3 + ["fatal"] + ["not tried"] * 6 and calls.read_text() == "xxxx"

    def client(title, body):
        if title == "2":
            raise FatalModelError
        return "{}"

    out = llm_enrich(df.select("id", F.col("text").alias("title"), F.lit("").alias("summary")), client)
    assert [r.status for r in out.orderBy("id").collect()] == ["ok"] * 2 + ["fatal"] + ["not tried"] * 7


def test_model_queries_give_what_their_callables_say(spark, sf):
    """embed, embed_backfill, llm_enrich, llm_run_totals and the applied results, against the callables in a loop."""
    from tidewire.functions import models as M

    q = catalog.queries()
    a = view(spark, sf, "articles").select("id", "title", "summary", "category", X.embedding_text(F.col("title"), F.col("summary")).alias("t")).collect()
    vector = {r.id: M.hashing_embedder([r.t or ""])[0] for r in a}
    assert {(r.id, r.dims, r.status) for r in q["embed"](spark, sf).collect()} == {(k, 64 if v else -1, "ok" if v else "empty") if v else (k, None, "empty") for k, v in vector.items()}
    held = {r.vec_id: (M.MODEL if r.vec_id % 3 else None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = {k: m for k, m in held.items()} | {k: M.MODEL for k, v in vector.items() if v and held.get(k) != M.MODEL}
    assert {r.id: r.model for r in q["embed_backfill"](spark, sf).collect()} == want
    said = {r.id: M.heuristic_client(r.title or "", (r.summary or "")[:1500]) for r in a}
    tokens = {r.id: (len(r.title or "") + len((r.summary or "")[:1500])) // 4 for r in a}
    assert {(r.id, r.status, r.prompt_tokens, r.completion_tokens) for r in q["llm_enrich"](spark, sf).collect()} == {(k, "ok", tokens[k], len(s) // 4) for k, s in said.items()}
    total = q["llm_run_totals"](spark, sf).head()
    assert (total.prompt_tokens, total.completion_tokens, total.processed, total.failed) == (sum(tokens.values()), sum(len(s) // 4 for s in said.values()), len(a), 0)
    assert {(r.id, r.category, r.enriched_by) for r in q["llm_enrich_apply"](spark, sf).collect()} == {(k, "other", "llm") for k in said}


def test_meta_as_variant_is_stored_typed(spark, tmp_path):
    from tidewire.operators.state import due_sources, managed_by_user, typed_meta

    metas = ['{"managedBy":"user"}', '{"managedBy": "registry"}', '{"managedBy":{"user":1}}', "{}", "[1]", "no json", None]
    df = spark.createDataFrame(list(enumerate(metas)), "id int, meta string")
    want = {r.id: r.u for r in df.select("id", F.coalesce(F.get_json_object("meta", "$.managedBy") == "user", F.lit(False)).alias("u")).collect()}
    df.select("id", typed_meta(F.col("meta")).alias("meta")).write.parquet(f"file://{tmp_path}/v")
    stored = spark.read.parquet(f"file://{tmp_path}/v")
    assert dict(stored.dtypes)["meta"] == "variant"
    assert {r.id: r.u for r in stored.select("id", managed_by_user(F.col("meta")).alias("u")).collect()} == want == {k: k == 0 for k in range(7)}
    assert {r.id for r in df.where(managed_by_user(F.col("meta"))).collect()} == {0}
    s = spark.createDataFrame([("a", False, None, 30), ("b", True, None, 30)], "slug string, enabled boolean, last_polled_at timestamp, poll_minutes int")
    assert [r.slug for r in due_sources(s, "2024-01-01").collect()] == ["b"] and [r.slug for r in due_sources(s, "2024-01-01", ["a"]).collect()] == ["a"]


def test_cluster_cycle_equals_a_loop(spark, sf):
    """Story rows, outlets, centroids and the scores that follow, from the groups of the loop."""
    from tidewire.plans.relational import with_labels

    s = view(spark, sf, "sources").select(F.col("id").alias("source_id"), "base_credibility")
    a = with_labels(spark, sf).join(s, "source_id").drop("story_id").join(with_vectors(spark, sf).select("id", "v", "model"), "id")
    twice = view(spark, sf, "article_duplicates")
    out = J.cluster_cycle(a, twice, "2024-01-31 00:00:00", days=28, vector_threshold=0.35)
    recent = with_vectors(spark, sf).where("published_at >= TIMESTAMP '2024-01-03 00:00:00'")
    groups = {}
    for k, g in first_fit(by_time(recent)).items():
        if g is not None:
            groups.setdefault(g, []).append(k)
    assert {r.id: r.story_id for r in out["members"].collect()} == {k: g for g, own in groups.items() for k in own}
    row = {r.id: r for r in a.collect()}
    folded = collections.defaultdict(set)
    for r in twice.collect():
        folded[r.article_id].add(r.publisher_domain or str(r.source_id))
    got, grown = {r.story_id: r for r in out["stories"].collect()}, {}
    assert set(got) == set(groups) and got
    for g, own in groups.items():
        members = sorted((row[k] for k in own), key=lambda r: (r.published_at, r.id))
        lead = min(members, key=lambda r: (-r.credibility, -r.published_at.timestamp(), members.index(r)))
        outlets = {m.publisher_domain or str(m.source_id) for m in members}.union(*[folded[m.id] for m in members])
        vs = [np.array(m.v, float) for m in members if m.v is not None]
        r = got[g]
        assert (r.headline, r.category, r.article_count, r.source_count, r.top_credibility, r.max_impact) == (lead.title, lead.category, len(own), len(outlets), max(m.credibility for m in members), max(m.impact for m in members))
        assert (r.first_seen, r.last_updated) == (members[0].published_at, members[-1].published_at) and r.clustered_by == ("embedding" if any(m.v is not None for m in members[1:]) else "title")
        assert set(r.org_slugs) == {o for m in members for o in m.org_slugs} and len(r.tags) <= 12
        assert (r.centroid is None) == (not vs) and (not vs or np.allclose(r.centroid, sum(vs) / len(vs)))
        grown |= {m.id: len(outlets) - 1 for m in members if len(outlets) - 1 > m.corroboration_count}
    assert {r.id: r.corroboration_count for r in out["scores"].collect()} == grown and grown
