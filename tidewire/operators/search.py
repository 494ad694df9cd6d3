"""Full-text search: a web-style query (all words, "a phrase", OR, -not) over an inverted index, and BM25F rank.

The index is built once and read by every query: postings (token, id, positions, n_title, length), the documents' lengths, and
their number and mean. Tokens are English stems without stop words; the distinct words of a block of texts are stemmed, those
met before looked up. Positions count all words, stop words too; the summary's go on where the title's last indexed word stands, so
that a phrase may run from the one into the other. Postings are stored in buckets of the token, so a query reads those of its
own tokens alone: OR is a union, all words are semi joins of posting lists, not is an anti join, and a phrase is a
join on positions less the word's place in it. The rank is the published BM25 with the title weighing 1.0, the summary 0.4.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.stemmer import lexeme
from tidewire.operators.shared import stage

BUCKETS = 64
TITLE, SUMMARY = 1.0, 0.4


@dataclass(frozen=True)
class SearchIndex:
    """postings: bucket, token, id, positions in order, n_title, length (a row of each token and id);
    documents: id, length; totals: one row (n, mean)."""

    postings: DataFrame
    documents: DataFrame
    totals: DataFrame


def words(text: Column) -> Column:
    """In lower case, with one space between them: a string is passed on with less effort than an array of its words."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


@lru_cache(1 << 18)
def token_of(word: str) -> str | None:
    """A worker's own dictionary of the words that it met last; no token of the one empty word that an empty text is split into."""
    return lexeme(word) if word else None


def laid(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, the row of each and its place in its text, from 1."""
    split = pc.split_pattern(texts, " ")
    n = split.value_lengths().to_numpy()
    return split.flatten(), np.repeat(np.arange(len(n)), n), np.arange(1, n.sum() + 1) - np.repeat(n.cumsum() - n, n)


def posted(rows: pa.RecordBatch) -> pa.RecordBatch:
    """A row without token for each text, then one for each token and text, by token."""
    key, n = rows.column(0), rows.num_rows
    (a, row_a, at_a), (b, row_b, at_b) = laid(rows.column(1)), laid(rows.column(2))
    coded = pa.concat_arrays([a, b]).dictionary_encode()
    stems = [token_of(w) for w in coded.dictionary.to_pylist()]
    tokens = sorted({t for t in stems if t is not None})
    number = {t: k for k, t in enumerate(tokens)} | {None: -1}
    code = np.array([number[t] for t in stems], np.int64)[coded.indices.to_numpy()]
    last = np.zeros(n, np.int64)
    np.maximum.at(last, row_a, np.where(code[: len(a)] >= 0, at_a, 0))
    kept = np.flatnonzero(code >= 0)
    row, at, in_title = np.concatenate([row_a, row_b])[kept], np.concatenate([at_a, at_b + last[row_b]])[kept], kept < len(a)
    length = np.bincount(row[in_title], minlength=n) * TITLE + np.bincount(row[~in_title], minlength=n) * SUMMARY
    pair = code[kept] * n + row
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    own, token = pair[starts] % n, pair[starts] // n
    of, no = np.concatenate([np.arange(n), own]), np.zeros(n, np.int64)
    named = pa.array(np.concatenate([no, token]), mask=np.arange(len(of)) < n)
    ends = np.concatenate([no, starts, [len(order)]])
    n_title = np.add.reduceat(in_title[order], starts, dtype=np.int64) if len(starts) else starts
    positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[order], pa.int32()))
    columns = [pa.array(tokens, pa.string()).take(named), key.take(pa.array(of)), positions, pa.array(np.concatenate([no, n_title]), pa.int32()), pa.array(length[of])]
    return pa.RecordBatch.from_arrays(columns, ["token", "id", "positions", "n_title", "length"])


def places(block: int = 6_000_000):
    """From batches of (id, title, summary), the latter two as ``words``, to ``posted`` of some texts with about ``block`` bytes together."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            size = sum(pc.binary_length(given.column(k)).to_numpy().astype(np.int64) for k in (1, 2))
            cuts = np.flatnonzero(np.diff((size.cumsum() - size) // block, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], given.num_rows]):
                yield posted(given.slice(a, b - a))

    return of


def index(articles: DataFrame) -> SearchIndex:
    """articles: id, title, summary. Null texts have no words; an article without words is a document of length 0.

    The texts are read once, nothing is shuffled or joined: tokens and their places are gathered where the texts are read, for the
    texts of a block at once. A block's rows lie by token, so that the pages of other tokens are skipped by their least and greatest.
    """
    own = articles.select("id", words(F.col("title")).alias("title"), words(F.col("summary")).alias("summary"))
    kind = own.schema["id"].dataType.simpleString()
    rows = stage(own.mapInArrow(places(), f"token string, id {kind}, positions array<int>, n_title int, length double"))
    documents = rows.where("token IS NULL").select("id", "length")
    postings = rows.where("token IS NOT NULL").select(bucket_of(F.col("token")).alias("bucket"), *rows.columns)
    return SearchIndex(postings, documents, stage(totals(documents)))


def bucket_of(token: Column) -> Column:
    return (F.crc32(token) % BUCKETS).cast("int")


def totals(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))


def write_index(ix: SearchIndex, folder: str, mode: str = "error") -> None:
    """Store an index, or with ``mode`` append add one of further articles to it. Frequent tokens lie in several files."""
    laid = ix.postings.repartitionByRange("bucket", "token", "id").sortWithinPartitions("bucket", "token", "id")
    laid.write.mode(mode).partitionBy("bucket").parquet(f"{folder}/postings")
    ix.documents.write.mode(mode).parquet(f"{folder}/documents")
    totals(ix.documents.sparkSession.read.parquet(f"{folder}/documents")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")


def read_index(spark: SparkSession, folder: str) -> SearchIndex:
    return SearchIndex(*[spark.read.parquet(f"{folder}/{name}") for name in ("postings", "documents", "totals")])


Term = tuple[bool, list[tuple[int, str]]]


def parse_query(q: str) -> list[list[Term]]:
    """Alternatives of terms; a term is (wanted, its tokens with their places in it). Stop words only leave their place; a term
    of stop words alone is no term."""
    out: list[list[Term]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', q):
        if word == "OR" and not minus:
            out.append([])
            continue
        parts = [w for w in re.split(r"[\W_]+", (phrase or word).lower()) if w]
        tokens = [(n, t) for n, w in enumerate(parts) if (t := lexeme(w))]
        if tokens:
            out[-1].append((not minus, tokens))
    return [a for a in out if a]


def posting(ix: SearchIndex, token: str) -> DataFrame:
    return ix.postings.where((F.col("bucket") == zlib.crc32(token.encode()) % BUCKETS) & (F.col("token") == token))


def having(ix: SearchIndex, tokens: list[tuple[int, str]]) -> DataFrame:
    """(id): documents with the token, or with the tokens at their places."""
    if len(tokens) == 1:
        return posting(ix, tokens[0][1]).select("id")
    starts = [posting(ix, t).select("id", F.explode(F.transform("positions", lambda p: p - n)).alias("start")) for n, t in tokens]
    return reduce(lambda a, b: a.join(b, ["id", "start"], "left_semi"), starts).select("id")


def search_match(ix: SearchIndex, q: str) -> DataFrame:
    """(id) of the documents that fit, once each. A query without any token finds nothing."""

    def alternative(terms: list[Term]) -> DataFrame:
        wanted, unwanted = ([having(ix, tokens) for w, tokens in terms if w is side] for side in (True, False))
        found = reduce(lambda a, b: a.join(b, "id", "left_semi"), wanted) if wanted else ix.documents.select("id")
        return reduce(lambda a, b: a.join(b, "id", "left_anti"), unwanted, found)

    alternatives = [alternative(terms) for terms in parse_query(q)]
    return reduce(DataFrame.unionByName, alternatives).distinct() if alternatives else ix.documents.select("id").limit(0)


def search_rank(ix: SearchIndex, q: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents that have any wanted token: only these tokens' postings are read."""
    tokens = sorted({t for terms in parse_query(q) for wanted, ts in terms if wanted for _, t in ts})
    own = reduce(DataFrame.unionByName, [posting(ix, t) for t in tokens]) if tokens else ix.postings.limit(0)
    tf = F.col("n_title") * TITLE + (F.size("positions") - F.col("n_title")) * SUMMARY
    own = own.groupBy("token", "id").agg(F.sum(tf).alias("tf"), F.first("length").alias("length"))
    df = own.groupBy("token").agg(F.count("*").alias("df"))  # a row for each token of the query
    out = own.join(df, "token").crossJoin(ix.totals)  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return out.groupBy("id").agg(F.sum(idf * weight).alias("score"))
