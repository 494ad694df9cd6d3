"""Sorted projection passes against all pairs."""

import numpy as np
import pytest

from tidewire.llm.embedding_dedup import forest, near_vectors, op11_embedding_dedup, passes_for

SIZE = 32


def all_pairs(rows):
    """{id: (links, component)} of rows with distinct ids, by the whole matrix of cosines."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([[*rows[i][1], *[0.0] * (SIZE - len(rows[i][1]))] for i in good], float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, True)
    root, out = forest(near), {k: (0, k) for k, _ in rows}
    for j, i in enumerate(good):
        out[rows[i][0]] = (int(near[j].sum()) - 1, min(rows[good[q]][0] for q in np.flatnonzero(root == root[j])))
    return out


def around(rng, middle, cosine):
    """A vector whose cosine with the middle is the given one."""
    middle = middle / np.linalg.norm(middle)
    z = rng.normal(size=len(middle))
    z -= z @ middle * middle
    return cosine * middle + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


@pytest.fixture(scope="module")
def vectors(spark):
    """Groups from tight to diffuse, pairs at all cosines from the bound on, copies, and vectors that can't be compared."""
    rng = np.random.default_rng(3)
    own = []
    for n, c in ((300, 0.99), (200, 0.955), (150, 0.92), (60, 0.9)):
        middle = rng.normal(size=SIZE)
        own += [around(rng, middle, np.sqrt(c)) for _ in range(n)]
    own += [rng.normal(size=SIZE) for _ in range(500)]
    for _ in range(100):
        v = rng.normal(size=SIZE)
        own += [v, around(rng, v, rng.uniform(0.9, 0.99))]
    own += [rng.normal(size=SIZE)] * 50
    odd = [None, [], [0.0] * SIZE, [None, *[1.0] * (SIZE - 1)], [float("nan"), *[1.0] * (SIZE - 1)], [float("inf")] * SIZE, [1e30] * 3, [2e30] * 3]
    every = [(k, None if v is None else [None if x is None else float(x) for x in v], 7) for k, v in enumerate([*own, *odd])]
    return spark.createDataFrame(every, "vec_id long, embedding array<float>, n_links int").repartition(5).cache()


@pytest.fixture(scope="module")
def expected(vectors):
    return all_pairs([(r.vec_id, r.embedding) for r in vectors.collect()])


@pytest.mark.parametrize("more", [{}, {"small": 8, "run": 16, "block": 32, "rows_of_part": 256}])
def test_equals_all_pairs(vectors, expected, more):
    """Whole groups in a task, and through balls and blocks."""
    got = near_vectors(vectors, **more).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == expected and len(got) == len(expected)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_of_single_pairs_at_the_bound(spark):
    """Pairs without other partners, at 0.9 itself: at least nine of ten are found."""
    rng = np.random.default_rng(5)
    own = []
    for _ in range(1500):
        v = rng.normal(size=64)
        own += [v, around(rng, v, 0.9001)]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(own)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links = 1").count()
    assert got >= 0.9 * len(rows)


def test_passes_follow_the_rows():
    few, many = passes_for(10_000, 48, 0.95), passes_for(100_000_000, 48, 0.95)
    assert few[0] < many[0] < 40 and few[1] <= many[1] <= 9


def test_nulls_ties_and_empty_tables(spark, vectors):
    same, other = [1.0, 2.0, 3.0], [-1.0, 5.0, 0.5]
    rows = [(1, same), (1, same), (None, same), (None, other), (None, None), (4, None)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [
        ("1", 2, "1", True), ("1", 2, "1", True), ("4", 0, "4", True), ("None", 0, "None", True), ("None", 0, "None", True), ("None", 2, "1", False),
    ]
    assert near_vectors(vectors.limit(0)).count() == 0


def test_query_equals_sql(spark, sf, oracle):
    from compare import rows

    from tidewire.llm.embedding_dedup import oracle_sql

    assert rows(op11_embedding_dedup(spark, sf).toPandas()) == rows(oracle(oracle_sql()["op11_embedding_dedup"]))
