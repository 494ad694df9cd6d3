"""Tables that change as one, and the ingest cycle that is lost at any point and run again."""

import datetime
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tidewire.operators.snapshots import Snapshots, StaleVersion
from tidewire.streaming import cycle as C
from tidewire.streaming.jobs import read_files


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long").coalesce(1)


def values(store, version=None, name="t"):
    return sorted(r.x for r in store.read(name, "x long", version).collect())


def test_versions_are_whole_and_old_ones_stay_until_a_vacuum(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    assert values(store) == [] and store.versions() == []
    store.commit(append={"t": table(spark, 1), "u": table(spark, 9)}, marks={"n": 1})
    store.commit(append={"t": table(spark, 2)})
    reader = store.read("t", "x long")  # as of version 2
    store.commit(replace={"t": table(spark, 5)})
    assert values(store) == [5] and values(store, 2) == [1, 2] and values(store, name="u") == [9] and store.state()["marks"] == {"n": 1}
    assert sorted(r.x for r in reader.collect()) == [1, 2]
    store.commit(append={"t": table(spark, 6)})
    store.fold("t")
    assert values(store) == [5, 6] and len(store.state()["tables"]["t"]) == 1
    assert store.vacuum(keep=1) == 4 and store.versions() == [5] and values(store) == [5, 6] and values(store, name="u") == [9]


def test_a_reader_during_a_rebuild_sees_the_version_before(spark, tmp_path):
    """Parts without a version file are no part of the table, and a second writer on the same base is refused."""
    store = Snapshots(spark, f"file://{tmp_path}/s")
    store.commit(replace={"t": table(spark, 1, 2, 3)})
    base = store.state()
    seen = []

    def slow(name, rows, real=store.write_part):
        part = real(name, rows)
        seen.append(values(Snapshots(spark, store.folder)))
        return part

    store.write_part = slow
    store.commit(replace={"t": table(spark, 7)}, base=base)
    assert seen == [[1, 2, 3]] and values(store) == [7]
    with pytest.raises(StaleVersion):
        store.commit(append={"t": table(spark, 8)}, base=base)
    assert values(store) == [7]
    assert store.vacuum(keep=1) == 2 and values(store) == [7]


ITEMS = (
    "id long, title string, content string, url string, author string, publisher_domain string, base_credibility int, source_org string, published_at timestamp, source_id int, corroboration int, "
    "points int, upvotes int, keywords array<string>, is_paper boolean, is_model_release boolean, is_release boolean, position long, fetched_at timestamp, error string"
)
START = datetime.datetime(2024, 1, 1)


def item(k, title, source, hour, fetched, url=None, publisher=None):
    when = START + datetime.timedelta(hours=hour)
    return (k, title, None, url or f"https://x.example.com/{k}", "a", publisher, 3, None, when, source, 0, 0, 0, None, False, False, False, k, START + datetime.timedelta(hours=fetched), None)


def failed(k, source, fetched, error):
    return (k, *[None] * 8, source, *[None] * 8, START + datetime.timedelta(hours=fetched), error)


CYCLES = [
    [item(1, "alpha bravo charlie delta", 1, 1, 3), item(2, "kilo lima mike november", 2, 2, 3, publisher="p.example.com"), failed(3, 3, 3, "HTTP 500")],
    [item(11, "alpha bravo charlie delta", 2, 4, 6), item(12, "alpha bravo charlie delta", 4, 5, 6), item(13, "alpha bravo charlie delta", 1, 5, 6), item(14, "x", 1, 1, 6, url="https://x.example.com/1"), failed(15, 3, 6, "HTTP 404 " + "x" * 600)],
    [item(21, "something else entirely new", 3, 7, 8), item(22, "old thing", 1, -24 * 20, 8), failed(23, 2, 8, "down")],
]


def no_vectors():
    """An embedder whose calls fail, so that titles decide."""

    def down(texts):
        raise OSError

    return down


def put(spark, folder, rows):
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, name, lost=None):
    """The cycles one after another; the second is lost after so many written parts and started again."""
    source, check = f"file://{folder}/{name}-in", f"file://{folder}/{name}-check"
    store = Snapshots(spark, f"file://{folder}/{name}")
    stream = lambda: C.stream_cycles(read_files(spark, source, spark.createDataFrame([], ITEMS).schema), store, check, embedder=no_vectors(), limit=2)
    for n, rows in enumerate(CYCLES):
        put(spark, source, rows)
        if n == 1 and lost is not None:
            with dying(store, lost), pytest.raises(Exception, match="lost"):
                stream()
        stream()
    return store, stream


@contextmanager
def dying(store, after):
    """The writer is lost after so many parts."""
    real, left = store.write_part, [after]

    def dies(table, df):
        if not left[0]:
            raise RuntimeError("lost")
        left[0] -= 1
        return real(table, df)

    store.write_part = dies
    yield
    store.write_part = real


def told(store):
    a = C.read_articles(store)
    return {
        "articles": sorted((r.id, r.corroboration_count, r.credibility) for r in a.collect()),
        "duplicates": sorted((r.id, r.article_id) for r in store.read("duplicates", C.DUPLICATES).collect()),
        "runs": sorted((r.ran_at, r.source_id, r.ok, r.items_seen, r.items_new, r.items_duplicate, r.pre_filtered, (r.error or "")[:8]) for r in store.read("runs", C.RUNS).collect()),
        "state": sorted((r.source_id, r.consecutive_failures, r.enabled, (r.disabled_reason or "")[:35]) for r in store.read("source_state", C.SOURCE_STATE).collect()),
    }


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """A run whose second cycle was lost once, as a stream."""
    return run(spark, tmp_path_factory.mktemp("cycles"), "whole", lost=2)


@pytest.fixture(scope="module")
def whole(ran):
    return told(ran[0])


def test_cycles(whole):
    """Two outlets repeat article 1 (one row is of its own outlet), so that it gains a point; two failures switch source 3 off,
    a success later clears them."""
    assert [(k, n) for k, n, _ in whole["articles"]] == [(1, 2), (2, 0), (21, 0)]
    assert whole["duplicates"] == [(11, 1), (12, 1)]
    scores = {k: s for k, _, s in whole["articles"]}
    assert scores[1] == 4 and scores[21] == 3
    assert [(r[1:]) for r in whole["runs"]] == [
        (1, True, 1, 1, 0, 0, ""), (2, True, 1, 1, 0, 0, ""), (3, False, 0, 0, 0, 0, "HTTP 500"),
        (1, True, 2, 0, 0, 1, ""), (2, True, 1, 0, 1, 0, ""), (3, False, 0, 0, 0, 0, "HTTP 404"), (4, True, 1, 0, 1, 0, ""),
        (1, True, 0, 0, 0, 0, ""), (2, False, 0, 0, 0, 0, "down"), (3, True, 1, 1, 0, 0, ""),
    ]
    assert whole["state"] == [(1, 0, True, ""), (2, 1, True, ""), (3, 0, False, ""), (4, 0, True, "")]


@pytest.mark.parametrize("lost", [0, 1, 3, 4])  # 2 is what the stream was lost after
def test_a_cycle_lost_after_any_part_is_run_again(spark, tmp_path, ran, lost):
    """From the version before: whatever of the five parts had been written, the next run gives the same version."""
    import shutil

    shutil.copytree(ran[0].folder.removeprefix("file://"), tmp_path / "s")
    store = Snapshots(spark, f"file://{tmp_path}/s")
    for v in (2, 3):
        (tmp_path / "s" / "_versions" / f"{v:012d}.json").unlink()
    want = lambda s, v: [sorted(map(str, s.read(n, t, v).drop("reasons").collect())) for n, t in (("articles", C.ARTICLES), ("duplicates", C.DUPLICATES), ("scores", C.SCORES), ("runs", C.RUNS), ("source_state", C.SOURCE_STATE))]
    before, rows = want(store, 1), spark.createDataFrame(CYCLES[1], ITEMS)
    with dying(store, lost), pytest.raises(RuntimeError):
        C.run_cycle(store, rows, 1, embedder=no_vectors(), limit=2)
    assert store.versions() == [1] and want(store, None) == before
    assert C.run_cycle(store, rows, 1, embedder=no_vectors(), limit=2) and want(store, None) == want(ran[0], 2)
    assert not C.run_cycle(store, rows, 1, embedder=no_vectors(), limit=2) and store.versions() == [1, 2]


def test_a_batch_committed_but_not_marked_is_not_doubled(ran, whole):
    store, stream = ran
    check = store.folder.removeprefix("file://") + "-check/commits"
    for name in ("2", ".2.crc"):
        Path(check, name).unlink(missing_ok=True)
    stream()
    assert told(store) == whole and store.versions() == [1, 2, 3]


def test_sources_are_switched_off_with_their_reason(spark):
    held = spark.createDataFrame([(1, None, 1, True, None), (2, None, 4, True, "x"), (3, None, 0, False, "turned off manually")], C.SOURCE_STATE)
    polls = spark.createDataFrame([(1, False, "HTTP 404"), (2, True, None), (5, False, "new")], "source_id int, ok boolean, error string")
    got = {r.source_id: (r.consecutive_failures, r.enabled, r.disabled_reason) for r in C.source_state(held, polls, "2024-01-02", 2).collect()}
    assert got == {1: (2, False, "2 consecutive failures: HTTP 404"), 2: (0, True, None), 3: (0, False, "turned off manually"), 5: (1, True, None)}


def test_clusters_are_made_anew_in_one_version(spark, tmp_path):
    """Stories of the window are replaced, older ones stay; members gain what their story's outlets corroborate."""
    store = Snapshots(spark, f"file://{tmp_path}/s")
    rows = [item(k, t, k, 24 * day, 24 * 20, publisher=f"p{k}.example.com") for k, t, day in ((1, "alpha bravo charlie delta", 1), (2, "alpha bravo charlie delta echo", 12), (3, "alpha bravo charlie delta foxtrot", 13), (4, "kilo lima mike", 13), (5, "alpha bravo charlie delta golf", 14))]
    made = spark.createDataFrame(rows, ITEMS).withColumns({"canonical_url": F.col("url"), "summary": F.lit(None).cast("string"), "category": F.lit("deal"), "credibility": F.lit(3), "impact": F.col("id").cast("int"), "corroboration_count": F.lit(0)})
    old = spark.createDataFrame([(900, "old", START)], "story_id long, headline string, last_updated timestamp")
    stale = spark.createDataFrame([(901, "stale", START + datetime.timedelta(days=13))], old.schema)
    store.commit({"articles": C.as_of_schema(made, C.ARTICLES), "members": spark.createDataFrame([(1, 900), (4, 901)], C.MEMBERS), "stories": C.as_of_schema(old.unionByName(stale), C.STORIES)})
    C.run_clusters(store, "2024-01-16 00:00:00")
    assert store.versions() == [1, 2]
    assert {r.id: (r.story_id, r.corroboration_count, r.credibility) for r in C.read_articles(store).collect()} == {1: (900, 0, 3), 2: (2, 2, 4), 3: (2, 2, 4), 4: (None, 0, 3), 5: (2, 2, 4)}
    told = {r.story_id: (r.headline, r.article_count, r.source_count, r.clustered_by) for r in store.read("stories", C.STORIES).collect()}
    assert told == {900: ("old", None, None, None), 2: ("alpha bravo charlie delta golf", 3, 3, "title")}
