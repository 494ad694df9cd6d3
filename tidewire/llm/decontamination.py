"""Benchmark decontamination by winnowing, in DataFrame functions throughout.

Words are runs of ``0-9 a-z`` and non-ASCII characters after A-Z are lower-cased. A window is ``window`` consecutive words of an
item, or the whole item if it is shorter. Windows are looked for by winnowing: of the hashes of all k-grams in a window the
least is its fingerprint (k about half of the window, so a window has several k-grams, and neighbouring windows mostly share
one fingerprint, which is looked up once for the run of windows that share it). Equal windows have equal fingerprints, so every
shared span of ``window`` words or more is found; a fingerprint that is found is then extended: all windows of its run are
compared with the items' windows word for word.

The rows are numbered in a written table (so that each reading of them numbers them alike). One scan makes the runs for all
lengths of windows as short rows (number, length, place, fingerprint) and joins them to the items' fingerprints: by broadcast
up to ``block`` fingerprints, beyond that by a shuffle of the runs. Only documents with a run that is found are read again for
their words, and each makes one row for each window of those runs, so memory and work are linear in a text's length.
Equal windows of several items count as one window with a list of items.

Hot keys: rows are grouped by document; a common passage is a key of the last join (hits with items' windows), which Spark
broadcasts while the items' windows are few and otherwise splits by its skew rule, since nothing above needs a key's rows together.

Defined results: a null or empty text (or one without words) has no words, no hits, no items and the hash of the empty string;
an item without words is ignored; repeated rows of documents each get a row; items with equal ids and different texts count as
one item; null item ids are ignored; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import ascii_lower, staged, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def with_fingerprints(df: DataFrame, words: str, length: int, k: int, out: str = "prints") -> DataFrame:
    """Adds for each window of ``length`` words the least hash of its k-grams, in order.

    A column for each step, so that no step is worked out twice: the hashes of k-grams, then least of 1, 2, 4 ... neighbours.
    """

    def step(df: DataFrame, value: Column, n: int) -> DataFrame:
        """n: neighbouring words that an entry stands for."""
        return df.withColumn(out, value).withColumn(out, F.slice(out, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0))))

    def least(df: DataFrame, by: int) -> DataFrame:
        n = F.greatest(F.size(out) - by, F.lit(0))
        return df.withColumn(out, F.zip_with(F.slice(out, F.lit(1), n), F.slice(out, F.lit(1 + by), n), lambda x, y: F.least(x, y)))

    w = F.col(words)
    df = step(df, F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])), k)
    span, width = 1, length - k + 1
    while 2 * span <= width:
        df, span = least(df, span), 2 * span
    return least(df, width - span) if span < width else df


def benchmark_windows(benchmark: DataFrame, window: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(length, words as text, items): each distinct window with the ids of the items that have it; (fp) its fingerprint."""
    own = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("w"))
    own = own.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window)))
    own = own.select("item", "length", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at"))
    own = own.select("item", "length", F.slice("w", F.col("at"), F.col("length")).alias("w")).distinct()
    return own.groupBy("length", "w").agg(F.collect_set("item").alias("items")).withColumn("text", F.array_join("w", " "))


def gram_of(length: int) -> int:
    """Words of the k-grams by which windows of a length are fingerprinted."""
    return length if length < 4 else length // 2


def starts_of(prints: Column) -> Column:
    """The places (from 0) of fingerprints that differ from the one before."""
    places = F.when(F.size(prints) > 0, F.sequence(F.lit(0), F.size(prints) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (F.get(prints, i) != F.get(prints, i - 1)))


def runs_of(prints: str, starts: str, length: int) -> Column:
    """For each stretch of equal neighbouring fingerprints: its length of windows, first place (from 1), windows and fingerprint."""
    p, s = F.col(prints), F.col(starts)
    one = lambda i, k: F.struct(
        F.lit(length).alias("length"), (i + 1).alias("at"), (F.coalesce(F.get(s, k + 1), F.size(p)) - i).alias("n"), F.get(p, i).alias("known")
    )
    return F.transform(s, one)


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 10, block: int = 1_000_000, row: str | None = None) -> DataFrame:
    """A row for each document: its id, n_words, n_hit and items (sorted as strings).

    row: a column that numbers the rows of ``docs``, if ``docs`` is a written table that has one; else the rows are written here.
    """
    windows = staged(benchmark_windows(benchmark, window), "benchmark-windows")
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    rows = rows if row else staged(rows, "winnow-rows")

    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most ``window`` numbers
    cut = rows.select("row", "id", words_of(F.col("text")).alias("words"))
    known, runs = None, [F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("at"), F.size("words").alias("n"), F.xxhash64("row").alias("known")))]
    for length in lengths:
        own = with_fingerprints(windows.where(F.col("length") == length), "w", length, gram_of(length))
        own = own.select("length", F.get("prints", F.lit(0)).alias("known")).distinct()
        known = own if known is None else known.unionByName(own)
        prints, starts = f"prints_{length}", f"starts_{length}"
        cut = with_fingerprints(cut, "words", length, gram_of(length), prints)
        cut = cut.withColumn(starts, starts_of(F.col(prints)))
        runs.append(runs_of(prints, starts, length))
    # the first entry, of length 0, stands for the document itself
    some = cut.select("row", "id", F.explode(F.concat(*runs)).alias("r")).select("row", "id", "r.*")
    if known is None:
        some = some.where("length = 0")
    else:
        known = staged(known.withColumn("found", F.lit(True)), "benchmark-fingerprints")
        known = F.broadcast(known) if known.count() <= block else known
        some = some.join(known, ["length", "known"], "left").where("length = 0 OR found")
    found = staged(some.select("row", "id", "length", "at", "n"), "winnowed")

    hits = found.where("length > 0")
    hit_rows = hits.select("row").distinct()
    hit_rows = F.broadcast(hit_rows) if hit_rows.count() <= block else hit_rows
    spans = hits.groupBy("row").agg(F.collect_list(F.struct("length", "at", "n")).alias("spans"))
    words = rows.join(hit_rows, "row", "left_semi").select("row", words_of(F.col("text")).alias("words")).join(spans, "row")
    one = lambda s: F.transform(
        F.sequence(s["at"], s["at"] + s["n"] - 1),
        lambda at: F.struct(s["length"].alias("length"), at.alias("at"), F.array_join(F.slice("words", at, s["length"]), " ").alias("text")),
    )
    spread = words.select("row", F.explode(F.flatten(F.transform("spans", one))).alias("x")).select("row", "x.*")
    # the windows' texts are compared whole, by the join
    hits = staged(spread.join(windows.select("length", "text", "items"), ["length", "text"]).select("row", "at", "length", "items"), "windows-hit")
    ends = F.max(F.col("at") + F.col("length")).over(Window.partitionBy("row").orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("at") + F.col("length") - F.greatest("at", F.coalesce(ends, F.lit(0))))
    counted = hits.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    items = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = found.where("length = 0").join(counted, "row", "left").join(items, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def oracle_sql() -> dict[str, str]:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({low}, '{word}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all({low}, '{word}') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, item, i, n FROM dw JOIN bw USING (n, t)),
hit AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS j FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""
    return {"op7_decontamination": sql}
