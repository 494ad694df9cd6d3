"""The stemmer on its published word pairs; the inverted index against a scan of all texts."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.functions.stemmer import lexeme, stem
from tidewire.operators import search as S
from tidewire.operators.shared import new_folder, stage
from tidewire.sources.views import view

#: Words and stems of the algorithm's sample vocabulary.
PAIRS = """consigned consign consigning consign consignment consign consist consist consistency consist consistently consist consolation
consol consolatory consolatori console consol consolidating consolid consolingly consol consonant conson consorting consort conspicuous
conspicu conspiracy conspiraci conspirators conspir conspiring conspir constables constabl constancy constanc constant constant knack knack
knackeries knackeri knag knag knaves knave knavish knavish kneading knead kneel kneel kneeling kneel kneels kneel knees knee knell knell knew
knew knives knive knightly knight knitting knit knockers knocker knocking knock knopp knopp generate generat generic generic general general
generously generous communism communism ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop hoping hope sky sky skies sky
dying die news news inning inning proceed proceed luxuriated luxuri cry cri by by say say organization organ relational relat happiness happi
hopefully hope agreed agre feed feed rational ration adoption adopt controlling control rolling roll electricity electr apologize apolog""".split()


def test_stems():
    assert [(w, stem(w)) for w in PAIRS[::2]] == list(zip(PAIRS[::2], PAIRS[1::2]))
    assert lexeme("with") is None and stem("") == "" and stem("été") == "été"


def laid(title, summary):
    """The places of the tokens of an article: stop words count, the summary goes on after the title's last token."""
    out, start = {}, 0
    for text in (title, summary):
        last = start
        for n, w in enumerate((x for x in re.split(r"[\W_]+", (text or "").lower()) if x), start + 1):
            if (t := lexeme(w)) is not None:
                out.setdefault(t, set()).add(n)
                last = n
        start = last
    return out


def fits(places, q):
    def has(tokens):
        first, *rest = tokens
        return any(all(p - first[0] + n in places.get(t, ()) for n, t in rest) for p in places.get(first[1], ()))

    return any(all(has(tokens) is wanted for wanted, tokens in terms) for terms in S.parse_query(q))


@pytest.fixture(scope="module")
def articles(spark, sf):
    odd = [(-1, None, None), (-2, "", ""), (-3, "The and of", "The"), (-4, "Running dogs", "of the runner's dog, dogs' running."), (-4, "repeated id", "dogs running")]
    odd = spark.createDataFrame(odd[:4], "id long, title string, summary string").withColumn("length", F.lit(1))
    return view(spark, sf, "full_articles").select("id", "title", "summary", F.lit(1).alias("length")).unionByName(odd).cache()


@pytest.fixture(scope="module")
def stored(spark, articles):
    """An index of half of the articles, with the others' appended."""
    folder = new_folder(spark, "search-index")
    S.write_index(S.index(articles.where("id % 2 = 0")), folder)
    S.write_index(S.index(articles.where("id % 2 <> 0")), folder, "append")
    return S.read_index(spark, folder)


def test_fifty_queries_equal_a_scan(spark, articles, stored):
    places = {r.id: laid(r.title, r.summary) for r in articles.collect()}
    rng = random.Random(8)
    texts = [w for r in articles.where("length(summary) > 40").limit(40).collect() if len(w := re.split(r"[\W_]+", r.summary.lower())) > 8]
    # words by how many texts they are in, so that queries find some
    common = [w for w, _ in sorted({w: sum(w in t for t in texts) for t in texts for w in t if w}.items(), key=lambda x: -x[1])[:150]]
    queries = ["the of", "", "-the", "dog", "dogs running", '"dog run"', '"running dogs of the runner"', '"dogs the runner" OR consign', "-dog", "OR OR dog"]
    while len(queries) < 50:
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(texts)
            at = rng.randrange(len(t) - 3)
            parts.append(rng.choice(["", "", "-"]) + rng.choice([rng.choice(common), rng.choice(common), '"' + " ".join(t[at : at + rng.randint(2, 3)]) + '"']))
            if rng.random() < 0.2:
                parts.append("OR")
        queries.append(" ".join(parts))
    found = 0
    for q in queries:
        got = sorted(r.id for r in S.search_match(stored, q).collect())
        assert got == sorted(k for k, p in places.items() if fits(p, q)), q
        found += bool(got)
    assert found > 25


def test_plan_reads_the_postings_of_its_tokens_alone(spark, stored):
    plan = S.search_match(stored, '"running dogs" -cats')._jdf.queryExecution().executedPlan().toString()
    assert "full_articles" not in plan and "summary" not in plan and "documents" not in plan
    assert plan.count("PartitionFilters: [isnotnull(bucket") == plan.count("FileScan") == 3


def test_totals_after_append_and_rank(stored, articles):
    assert stored.totals.head()["n"] == articles.count()
    ranks = {r.id: r.score for r in S.search_rank(stored, "dogs consign").collect()}
    assert set(ranks) == {-4} and ranks[-4] > 0
    assert S.search_rank(stored, "the").count() == 0


def test_empty_table(articles):
    none = S.index(articles.limit(0))
    assert S.search_match(none, "dog -cat").count() == 0 and S.search_rank(none, "dog").count() == 0


def test_index_reads_the_texts_once_and_shuffles_nothing(articles, monkeypatch):
    plans = []
    monkeypatch.setattr(S, "stage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stage(df))[1])
    S.index(articles)
    assert sum("regexp_replace" in p or "split(" in p for p in plans) == 1
    assert not any("Join" in p or "hashpartitioning" in p for p in plans)


def test_a_posting_for_each_token_and_text(articles):
    ix = S.index(articles)
    got = {(r.id, r.token): (list(r.positions), r.n_title) for r in ix.postings.collect()}
    assert ix.postings.count() == len(got)
    places = {r.id: (laid(r.title, r.summary), laid(r.title, "")) for r in articles.collect()}
    assert got == {(k, t): (sorted(at), len(title.get(t, ()))) for k, (whole, title) in places.items() for t, at in whole.items()}
    lengths = {r.id: r.length for r in ix.documents.collect()}
    assert lengths.keys() == places.keys() and lengths[-1] == lengths[-2] == lengths[-3] == 0
    assert lengths[-4] == 2 * S.TITLE + 4 * S.SUMMARY and {(r.id, r.length) for r in ix.postings.collect()} <= lengths.items()


def test_blocks_of_texts_give_the_same_rows():
    texts = ["", "the dogs run", "été dogs of dog 12", "of"]
    given = pa.RecordBatch.from_arrays([pa.array(range(16)), pa.array([a for a in texts for _ in texts]), pa.array(texts * 4)], ["id", "title", "summary"])
    every = [sorted(map(repr, (r for b in S.places(block)(iter([given, given.slice(0, 0)])) for r in b.to_pylist()))) for block in (1, 40, 10**9)]
    assert every[0] == every[1] == every[2] and sum("'token': None" in r for r in every[0]) == 16
