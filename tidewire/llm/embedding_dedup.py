"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors by a key of random hashes, most significant first. A hash projects the vector on 64 random
directions and says which projection is largest and with which sign (7 bits), so that near vectors share long prefixes and stand
near each other. In that order each vector is compared with at least the ``window`` before it, by cosine in double precision.
What a pass finds is kept as links of a spanning forest of each window; the passes' links are united, and their components come
from star steps. A pair of cosine 0.9 keeps a hash with probability 0.46, so the number of passes follows the number of vectors:
it is the one with which such a pair among vectors spread at random meets in a window with probability ``found`` (closer pairs,
and vectors with several partners, more often). Windows end at the borders of partitions, which lie elsewhere in each pass.

The window bounds what a pass compares, not what counts: within each component every vector is then held against all others of
it, so that ``n_links`` is exact there. Components of up to ``small`` vectors share tasks. In larger ones, runs of the sorted order
are gathered into balls around their centres, and balls into larger balls while that shrinks them; by the triangle inequality a
vector is linked to all of a ball, to none of it, or, near the bound, is compared with its members in blocks. Only counts leave
a task, never pairs. Vectors that are equal are one class throughout. Groups whose pairs have cosines above 0.95 are settled by
balls alone; a diffuse group at the bound itself costs the square of its size in products (in blocks of bounded memory).

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing: n_links 0, their own
id as component. Vectors of different lengths never link. Repeated rows each get a row and count each other as links (equal
usable vectors). A null id gets a component but never names one (of null ids alone: null, kept). An empty table gives an empty
table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, exp, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import staged, table
from tidewire.llm.simhash import components

DIRECTIONS = 64  # of a hash
BITS = 7  # what it says
SLACK = 1e-9  # of angles; what is nearer to the bound is compared itself


def passes_for(rows: int, window: int, found: float) -> tuple[int, int]:
    """(passes, hashes of a key). A hash at cosine 0.9 agrees with probability 0.46, which is exp(-0.11) for each of its bits."""
    bits = max(1.0, log2(max(2, rows) / window))
    meets = exp(-0.11 * bits)
    return max(6, ceil(log(1 - found) / log(1 - meets))), min(9, 2 + ceil(bits / BITS))


def usable(v: Column) -> Column:
    big = F.lit(float("inf"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(raw: pd.Series, kind: str) -> np.ndarray:
    """Packed vectors of one length as rows of length one, in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keyed(vector: Column, kind: str, passes: int, hashes: int, seed: int) -> Column:
    """The packed vector and its key in each pass."""

    @F.pandas_udf("struct<v: binary, keys: array<long>>")
    def of(vectors: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for batch in vectors:
            packed = batch.map(lambda v: np.asarray(v, kind).tobytes())
            keys = np.zeros((len(batch), passes), np.int64)
            size = batch.map(len).to_numpy()
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                x = unit(packed.iloc[own], kind)
                if dim not in known:
                    known[dim] = np.random.default_rng([seed, int(dim)]).normal(size=(passes, hashes, dim, DIRECTIONS))
                for p in range(passes):
                    key = np.zeros(len(own), np.int64)
                    for h in range(hashes):
                        y = x @ known[dim][p, h]
                        top = np.abs(y).argmax(axis=1)
                        key = (key << BITS) + 2 * top + (y[np.arange(len(own)), top] > 0)
                    keys[own, p] = key
            yield pd.DataFrame({"v": packed, "keys": list(keys)}, index=batch.index)

    return of(vector)


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the least row that it reaches."""
    n = len(near)
    root = np.arange(n)
    while True:
        least = np.where(near, root[None, :], n).min(axis=1)
        if (least == root).all():
            return root
        root = least


def window_links(similarity: float, window: int, kind: str):
    """Sorted rows (dim, node, v) in; links (a, b) that connect what is linked within each window."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, held, dim = np.zeros(0, np.int64), np.zeros((0, 1)), -1
        for pdf in batches:
            out = []
            for d, own in pdf.groupby("dim", sort=True):
                if d != dim:
                    nodes, held, dim = np.zeros(0, np.int64), np.zeros((0, d)), d
                x, ids = unit(own["v"], kind), own["node"].to_numpy()
                for at in range(0, len(x), window):
                    new = x[at : at + window]
                    both, names, before = np.vstack([held, new]), np.concatenate([nodes, ids[at : at + window]]), len(held)
                    sims = new @ both.T >= similarity
                    if sims.sum() > len(new):
                        near = np.eye(len(both), dtype=bool)
                        near[before:] |= sims
                        near[:, before:] |= sims.T
                        root = forest(near)
                        some = root != np.arange(len(root))
                        out.append(pd.DataFrame({"a": names[root[some]], "b": names[some]}))
                    held, nodes = both[-window:], names[-window:]
            if out:
                yield pd.concat(out)

    return links


def small_counts(similarity: float, kind: str):
    """All vectors of some components: for each the number of rows linked with it, its own class counted in."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("root"):
            x, n = unit(own["v"], kind), own["n"].to_numpy()
            near = x @ x.T >= similarity
            np.fill_diagonal(near, True)
            out.append(pd.DataFrame({"node": own["node"], "linked": near @ n}))
        return pd.concat(out)

    return count


BALL = "root long, item long, key long, center binary, radius double, n long, items array<long>"


def gather(limit: float, run: int):
    """Sorted rows (root, item, key, center, radius, n) in; balls of at most ``run`` of them, of radius up to half the bound."""

    def balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for root, own in pdf.groupby("root", sort=False):
                for at in range(0, len(own), run):
                    part = own.iloc[at : at + run]
                    x, r, n = np.stack(part["center"].map(np.frombuffer)), part["radius"].to_numpy(), part["n"].to_numpy()
                    item, key = part["item"].to_numpy(), part["key"].to_numpy()
                    left = np.ones(len(x), bool)
                    while left.any():
                        seed = int(left.argmax())
                        into = left & (np.arccos(np.clip(x @ x[seed], -1, 1)) + r <= limit)
                        c = (x[into] * n[into, None]).sum(axis=0)
                        c /= max(np.linalg.norm(c), 1e-300)
                        far = np.arccos(np.clip(x @ c, -1, 1)) + r
                        into &= far <= limit / 2 - SLACK
                        if not into[seed]:
                            into = np.arange(len(x)) == seed
                            c, far = x[seed], r
                        out.append((root, item[seed], key[seed], c.tobytes(), far[into].max(), n[into].sum(), item[into]))
                        left &= ~into
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BALL.split(", ")])

    return balls


def against_balls(limit: float, kind: str):
    """Some vectors of a component and some of its balls: the rows of balls that are linked as a whole, and the balls to open."""

    def held(own: pd.DataFrame, balls: pd.DataFrame) -> pd.DataFrame:
        if own.empty or balls.empty:
            return pd.DataFrame({"node": np.zeros(0, np.int64), "linked": np.zeros(0, np.int64), "open": [[]][:0]})
        apart = np.arccos(np.clip(unit(own["v"], kind) @ np.stack(balls["center"].map(np.frombuffer)).T, -1, 1))
        r = balls["radius"].to_numpy()[None, :]
        sure, never = apart + r <= limit - SLACK, apart - r > limit + SLACK
        at, names = ~sure & ~never, balls["item"].to_numpy()
        return pd.DataFrame({"node": own["node"].to_numpy(), "linked": sure @ balls["n"].to_numpy(), "open": [names[row] for row in at]})

    return held


def opened(similarity: float, kind: str):
    """Some vectors and some members of a ball: the members' rows that each is linked with."""

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"node": np.zeros(0, np.int64), "linked": np.zeros(0, np.int64)})
        near = unit(left["v"], kind) @ unit(right["w"], kind).T >= similarity
        near |= left["node"].to_numpy()[:, None] == right["other"].to_numpy()[None, :]
        return pd.DataFrame({"node": left["node"].to_numpy(), "linked": near @ right["n"].to_numpy()})

    return count


def chunks(rows: DataFrame, by: str, size: int, name: str) -> DataFrame:
    """(by, name): how many chunks of about ``size`` rows each group is dealt to."""
    return rows.groupBy(by).agg(F.ceil(F.count("*") / size).cast("int").alias(name))


def dealt(key: str, n: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(n)).cast("int")


def all_of(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def large_counts(members: DataFrame, similarity: float, kind: str, run: int, block: int) -> DataFrame:
    """members: root, node, n, v, key. (node, linked) as of ``small_counts``, through balls."""
    limit = acos(similarity)

    @F.pandas_udf("binary")
    def center(vectors: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in unit(vectors, kind)] if vectors.map(len).nunique() == 1 else [unit(pd.Series([v]), kind)[0].tobytes() for v in vectors])

    items = members.select("root", F.col("node").alias("item"), "key", center("v").alias("center"), F.lit(0.0).alias("radius"), "n")
    of, total = None, members.count()
    while True:
        order = items.repartitionByRange(1 + total // (32 * run), "root", "key", "item").sortWithinPartitions("root", "key", "item")
        balls = staged(order.mapInPandas(gather(limit, run), BALL), "vector-balls")
        step = balls.select(F.explode("items").alias("item"), F.col("item").alias("ball"))
        of = step.withColumnRenamed("item", "node") if of is None else of.withColumnRenamed("ball", "item").join(step, "item").select("node", "ball")
        of = staged(of, "vector-of-ball")
        before, total = total, balls.count()
        items = balls.drop("items")
        if 2 * total > before:
            break

    blocks = chunks(members, "root", block, "rows").join(chunks(items, "root", block, "balls"), "root")
    left = members.join(blocks, "root").select("root", "node", "v", dealt("node", "rows").alias("x"), all_of("balls").alias("y"))
    right = items.join(blocks, "root").select("root", "item", "center", "radius", "n", all_of("rows").alias("x"), dealt("item", "balls").alias("y"))
    told = left.groupBy("root", "x", "y").cogroup(right.groupBy("root", "x", "y")).applyInPandas(against_balls(limit, kind), "node long, linked long, open array<long>")
    told = staged(told, "vector-counts")

    near = staged(told.select("node", F.explode("open").alias("ball")), "vector-open")
    inside = of.join(near.select("ball").distinct(), "ball", "left_semi")
    sides = chunks(near, "ball", block, "rows").join(chunks(inside, "ball", block, "others"), "ball")
    left = near.join(sides, "ball").select("ball", "node", dealt("node", "rows").alias("x"), all_of("others").alias("y")).join(members.select("node", "v"), "node")
    right = inside.join(members.select("node", "n", "v"), "node").join(sides, "ball").select("ball", F.col("node").alias("other"), "n", F.col("v").alias("w"), all_of("rows").alias("x"), dealt("node", "others").alias("y"))
    more = left.groupBy("ball", "x", "y").cogroup(right.groupBy("ball", "x", "y")).applyInPandas(opened(similarity, kind), "node long, linked long")
    return told.select("node", "linked").unionByName(more).groupBy("node").agg(F.sum("linked").alias("linked"))


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", similarity: float = 0.9, *, window: int = 48, found: float = 0.95, passes: int | None = None,
    small: int = 1024, run: int = 256, block: int = 2048, rows_of_part: int = 8192, seed: int = 11,
) -> DataFrame:
    """(key, n_links, component_id, kept) for each row. ``passes`` None: as many as the count asks for (see above)."""
    double = dict(vectors.dtypes)[vector] != "array<float>"
    kind = "<f8" if double else "<f4"
    v = F.col(vector).cast("array<double>") if double else F.col(vector)
    hashed = [F.when(usable(v), F.xxhash64(F.lit(i), v)).alias(f"h{i}") for i in (1, 2)]
    many, hashes = passes_for(vectors.count(), window, found)
    many = passes or many

    classes = vectors.where(usable(v)).select(F.col(key).alias("id"), v.alias("v"), *hashed).groupBy("h1", "h2")
    classes = classes.agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("v").alias("v"))
    points = classes.select("h1", "h2", "n", "least", F.size("v").alias("dim"), keyed(F.col("v"), kind, many, hashes, seed).alias("k"))
    points = staged(points.select("h1", "h2", "n", "least", "dim", "k.*", F.monotonically_increasing_id().alias("node")), "vector-points")

    parts, links = 1 + points.count() // rows_of_part, None
    for p in range(many):
        order = points.select("dim", F.get("keys", F.lit(p)).alias("key"), F.xxhash64(F.lit(p), "node").alias("tie"), "node", "v")
        order = order.repartitionByRange(parts, "dim", "key", "tie").sortWithinPartitions("dim", "key", "tie").select("dim", "node", "v")
        own = staged(order.mapInPandas(window_links(similarity, window, kind), "a long, b long"), "vector-links")
        links = own if links is None else links.unionByName(own)
    roots = components(staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "vector-links"))
    roots = staged(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "vector-roots")

    members = points.select("node", "n", "v", F.get("keys", F.lit(0)).alias("key")).join(roots, "node")
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    few = members.join(sizes.where(F.col("size") <= small).select("root"), "root")
    buckets = 1 + roots.count() // (4 * small)
    linked = few.groupBy(F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("bucket")).applyInPandas(small_counts(similarity, kind), "node long, linked long")
    if not sizes.where(F.col("size") > small).isEmpty():
        many_of = staged(members.join(sizes.where(F.col("size") > small).select("root"), "root"), "vector-large")
        linked = linked.unionByName(large_counts(many_of, similarity, kind, run, block))

    named = points.select("h1", "h2", "node", "n", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    told = named.join(least, "root").join(linked, "node", "left").select("h1", "h2", (F.coalesce("linked", "n") - 1).alias("n_links"), "component_id", F.lit(True).alias("told"))
    rows = vectors.select(F.col(key), *hashed).join(told, ["h1", "h2"], "left")
    component = F.when(F.col("told"), F.col("component_id")).otherwise(F.col(key))
    return rows.select(key, F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """WITH e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
roots AS (WITH RECURSIVE r(id, root) USING KEY (id) AS (SELECT vec_id, vec_id FROM e UNION (SELECT l.b, min(r.root) FROM r JOIN links l ON l.a = r.id JOIN recurring.r AS c ON c.id = l.b WHERE r.root < c.root GROUP BY l.b)) SELECT id, root FROM r)
SELECT t.vec_id, coalesce(n.n, 0) AS n_links, coalesce(r.root, t.vec_id) AS component_id, coalesce(r.root, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN roots r ON r.id = t.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = t.vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op11_embedding_dedup": SQL}
