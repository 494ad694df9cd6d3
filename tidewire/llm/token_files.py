"""Token-id files with a minimal perfect hash index.

Files under one folder:

* ``ids-*.bin``: raw ids, little-endian, 2 bytes each if the vocabulary fits, else 4; documents end to end in key order.
* ``index-*.mph``: one for each bucket of keys (by hash, about ``bucket_keys`` each): a minimal perfect hash over the bucket's
  distinct keys, and for each slot a 32-bit fingerprint of its key and the entries (file, offset, length) of the key.
* ``manifest``: a Parquet table of the id files with the ids before each, ``catalog``: a Parquet table of the index files.

A look-up (``KeyedReader.get``) hashes the key to its bucket, the bucket's hash to one slot, compares the fingerprint and reads the
byte ranges it needs of one index file and one range of one id file for each document: the time does not grow with the number of keys.
``read_token_files`` looks up whole tables of keys, and reads each index file and each id file once. The manifest and the catalog name the files of committed tasks only, so what a
lost or retried task has left behind is never read.

Defined results: a null text is an empty document and has just the end id. Rows with equal keys are stored one after another
and a look-up returns all of them; a null key is a key like any other and comes first. An empty table makes empty tables.
Other columns are ignored. Keys must be integers: a key column of another type is an error.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import input_parts, new_dir, staged, table
from tidewire.llm.tokenizing import WORD_BPE, encoder

MAGIC = b"TWMPH1\0\0"
ENTRY = "key long, part long, shard long, file string, first long, lengths array<int>"


def _fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))  # the object store's other names in Hadoop


def _put(folder: str, name: str, data: bytes) -> None:
    system, root = _fs(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(data)


def _get(folder: str, name: str) -> bytes:
    system, root = _fs(folder)
    with system.open_input_file(f"{root}/{name}") as f:
        return f.readall()


# --- the minimal perfect hash -------------------------------------------------------------------------------------------


def mix(x: np.ndarray, seed) -> np.ndarray:
    """A 64-bit finaliser over x and a seed (arrays broadcast)."""
    x = x ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64), np.where(null, 2, 1).astype(np.uint64))


def build_mph(hashes: np.ndarray) -> np.ndarray:
    """For distinct hashes: a number for each group of about four; at 0 or more the seed that sends the group's keys to free
    slots, below 0 the slot of the group's only key."""
    m = len(hashes)
    groups = (hashes % np.uint64(max(1, (m + 3) // 4))).astype(np.int64)
    order = np.argsort(groups, kind="stable")
    names, firsts, sizes = np.unique(groups[order], return_index=True, return_counts=True)
    told = np.zeros(max(1, (m + 3) // 4), np.int64)
    free = np.ones(m, bool)
    for g in np.argsort(-sizes, kind="stable"):
        own = hashes[order[firsts[g] : firsts[g] + sizes[g]]]
        if sizes[g] == 1:
            break
        seed = 1
        while True:
            seeds = np.arange(seed, seed + 32, dtype=np.uint64)
            at = (mix(own[None, :], seeds[:, None]) % np.uint64(m)).astype(np.int64)
            ok = free[at].all(axis=1)
            for k in np.flatnonzero(ok):
                if len(set(at[k].tolist())) == len(own):
                    break
            else:
                seed += 32
                continue
            told[names[g]] = seed + int(k)
            free[at[k]] = False
            break
    alone = names[sizes == 1]
    told[alone] = -1 - np.flatnonzero(free)[: len(alone)]
    return told


def slots(hashes: np.ndarray, told: np.ndarray, m: int) -> np.ndarray:
    d = told[(hashes % np.uint64(len(told))).astype(np.int64)]
    return np.where(d < 0, -1 - d, (mix(hashes, np.maximum(d, 0).astype(np.uint64)) % np.uint64(max(1, m))).astype(np.int64))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 77) >> np.uint64(32)).astype(np.uint32)


def write_index(entries: pd.DataFrame) -> bytes:
    """entries: key, null, shard, first, n, with all rows of equal keys together or apart."""
    hashes = key_hash(entries["key"].to_numpy(), entries["null"].to_numpy())
    distinct, inverse = np.unique(hashes, return_inverse=True)
    told = build_mph(distinct)
    slot = slots(distinct, told, len(distinct))
    prints = np.empty(len(distinct), np.uint32)
    prints[slot] = fingerprints(distinct)
    order = np.lexsort((entries["first"], entries["shard"], slot[inverse]))
    ends = np.cumsum(np.bincount(slot[inverse], minlength=len(distinct)))
    cols = [entries[c].to_numpy()[order] for c in ("shard", "first", "n")]
    head = MAGIC + struct.pack("<qqq", len(told), len(distinct), len(entries))
    return head + b"".join(a.astype(t).tobytes() for a, t in [(told, "<i8"), (prints, "<u4"), (ends, "<i8"), *((c, "<i8") for c in cols)])


class Index:
    def __init__(self, data: bytes) -> None:
        assert data[:8] == MAGIC
        r, m, n = struct.unpack_from("<qqq", data, 8)
        at, parts = 32, []
        for size, kind in ((r, "<i8"), (m, "<u4"), (m, "<i8"), (n, "<i8"), (n, "<i8"), (n, "<i8")):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        self.told, self.prints, self.ends, self.shard, self.first, self.n = parts

    def find(self, keys: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its first and end entry; both 0 for a key whose fingerprint isn't there."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        hashes = key_hash(keys, null)
        at = slots(hashes, self.told, len(self.prints))
        there = self.prints[at] == fingerprints(hashes)
        end = self.ends[at]
        begin = np.where(at > 0, self.ends[np.maximum(at - 1, 0)], 0)
        return np.where(there, begin, 0), np.where(there, end, 0)


# --- writing ------------------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, tokenizer: str = WORD_BPE, tokenizer_path: str | None = None, shard_ids: int = 4_000_000, shard_docs: int = 65_536, bucket_keys: int = 50_000) -> None:
    """Encode, sort by key and write id files, manifest, index files and catalog under ``folder``.

    One range shuffle of the texts orders the documents; rows of one key may lie on both sides of a cut (they are ordered by
    a hash of their text as well), so a key with many rows is split. A task holds one file's ids at a time.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"the keys in {key} must be integers")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(input_parts(docs), F.col("key").asc_nulls_first(), "tie").sortWithinPartitions(F.col("key").asc_nulls_first(), "tie")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, token = encoder(tokenizer, tokenizer_path), TaskContext.get().partitionId(), uuid.uuid4().hex
        kind = "<u2" if enc.whole.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        held: list[bytes] = []
        entries: list[list] = []
        shard = n_ids = n_docs = 0

        def flush() -> pd.DataFrame:
            name = f"ids-{part:06d}-{shard:06d}-{token}{kind[1:]}.bin"
            _put(folder, name, np.frombuffer(b"".join(held), "<u4").astype(kind).tobytes())
            out = pd.DataFrame(entries, columns=["key", "first", "lengths"]).astype({"key": "Int64"})
            return out.assign(part=part, shard=shard, file=name)[["key", "part", "shard", "file", "first", "lengths"]]

        for pdf in batches:
            for k, t in zip(pdf["key"].astype("Int64"), pdf["text"]):
                k = None if k is pd.NA else int(k)
                ids = enc.encode(t) + end
                n = len(ids) // 4
                if held and (n_ids + n > shard_ids or n_docs >= shard_docs):
                    yield flush()
                    held, entries, shard, n_ids, n_docs = [], [], shard + 1, 0, 0
                if entries and entries[-1][0] == k:
                    entries[-1][2].append(n)
                else:
                    entries.append([k, n_ids, [n]])
                held.append(ids)
                n_ids, n_docs = n_ids + n, n_docs + 1
        if held:
            yield flush()

    written = staged(rows.select("key", "text").mapInPandas(write, ENTRY), "token-entries")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    files = written.groupBy("part", "shard", "file").agg(F.sum(total).alias("n_ids"))
    # one row for each file of some millions of ids: few enough for one task
    order = Window.orderBy("part", "shard")
    files = files.withColumn("number", F.row_number().over(order).cast("long")).withColumn("before", F.sum("n_ids").over(order) - F.col("n_ids"))
    files.write.parquet(f"{folder}/manifest")
    manifest = spark.read.parquet(f"{folder}/manifest")

    n_buckets = max(1, -(-written.count() // bucket_keys))
    spark.createDataFrame([(n_buckets,)], "n long").write.parquet(f"{folder}/buckets")

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        name = f"index-{bucket:06d}-{uuid.uuid4().hex}.mph"
        rows = [(k, k is None, s, f) for k, s, f in ((None if k is pd.NA else k, s, f) for k, s, f in zip(pdf["key"].astype("Int64"), pdf["number"], pdf["first"]))]
        flat = [(k or 0, null, s, f + at, n) for (k, null, s, f), ls in zip(rows, pdf["lengths"]) for n, at in zip(ls, np.cumsum([0, *ls[:-1]]))]
        _put(folder, name, write_index(pd.DataFrame(flat, columns=["key", "null", "shard", "first", "n"])))
        return pd.DataFrame({"bucket": [bucket], "file": [name], "n_entries": [len(flat)]})

    numbered = written.join(manifest.select("part", "shard", "number"), ["part", "shard"])
    catalog = numbered.withColumn("bucket", _bucket(F.col("key"), n_buckets)).select("bucket", "key", "number", "first", "lengths")
    catalog.groupBy("bucket").applyInPandas(index, "bucket long, file string, n_entries long").write.parquet(f"{folder}/catalog")


def _bucket(key, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("long")


# --- reading ------------------------------------------------------------------------------------------------------------


def read_token_files(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """For each distinct key all its documents: key, start (ids of all documents before it) and ids (unsigned 32-bit bytes).

    Keys go to their bucket's index, the entries found go to their file; each file is read once, one at a time in a task.
    """
    spark = keys.sparkSession
    n_buckets = spark.read.parquet(f"{folder}/buckets").head()[0]
    catalog = spark.read.parquet(f"{folder}/catalog").select("bucket", F.col("file").alias("index_file"))
    manifest = spark.read.parquet(f"{folder}/manifest").select(F.col("number").alias("shard"), "file", "before")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        index = Index(_get(folder, pdf["index_file"].iloc[0]))
        own = pdf["key"].astype("Int64")
        null = own.isna().to_numpy()
        begin, end = index.find(own.fillna(0).to_numpy(np.int64), null)
        rows = np.repeat(np.arange(len(own)), end - begin)
        at = np.repeat(begin, end - begin) + np.arange(len(rows)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
        return pd.DataFrame({"key": own.array[rows], "shard": index.shard[at], "first": index.first[at], "n": index.n[at]})

    wanted = keys.select(F.col(key).cast("long").alias("key")).distinct().withColumn("bucket", _bucket(F.col("key"), n_buckets))
    found = wanted.join(catalog, "bucket").groupBy("bucket").applyInPandas(find, "key long, shard long, first long, n long")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, data, wide = None, b"", 2
        for pdf in batches:
            out: list[tuple] = []
            size = 0
            for k, file, before, first, n in zip(pdf["key"].astype("Int64"), pdf["file"], pdf["before"], pdf["first"], pdf["n"]):
                if file != name:
                    name, data, wide = file, _get(folder, file), 2 if file.endswith("u2.bin") else 4
                ids = np.frombuffer(data, f"<u{wide}", n, first * wide).astype("<u4").tobytes()
                out.append((k, before + first, ids))
                size += len(ids)
                if size > 16_000_000:
                    yield pd.DataFrame(out, columns=["key", "start", "ids"])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=["key", "start", "ids"]).astype({"key": "Int64", "start": "int64"})

    placed = found.join(manifest, "shard").select("key", "file", "before", "first", "n")
    placed = placed.repartition("file").sortWithinPartitions("file", "first")
    return placed.mapInPandas(load, "key long, start long, ids binary").withColumnRenamed("key", key)


class KeyedReader:
    """Single keys, without Spark: byte ranges of the bucket's index file, then one range of the id file for each document."""

    def __init__(self, folder: str) -> None:
        from pyarrow import dataset

        self.system, self.root = _fs(folder)
        rows = lambda name: dataset.dataset(f"{self.root}/{name}", filesystem=self.system, format="parquet").to_table().to_pylist()
        self.buckets = rows("buckets")[0]["n"]
        self.catalog = {r["bucket"]: r["file"] for r in rows("catalog")}
        self.manifest = {r["number"]: (r["file"], r["before"]) for r in rows("manifest")}

    def get(self, key: int | None) -> list[tuple[int, np.ndarray]]:
        """(start, ids) of each document of the key; empty if there is none."""
        from xxhash import xxh64_intdigest

        hashed = 42 if key is None else xxh64_intdigest(struct.pack("<q", key), 42)  # as Spark hashes a long
        name = self.catalog.get((hashed - (1 << 64) * (hashed >> 63)) % self.buckets)
        if name is None:
            return []
        with self.system.open_input_file(f"{self.root}/{name}") as f:

            def read(kind: str, n: int, at: int) -> np.ndarray:
                return np.frombuffer(f.read_at(n * np.dtype(kind).itemsize, at), kind)

            r, m, n = (int(x) for x in read("<i8", 3, 8))
            own = key_hash(np.array([key or 0]), np.array([key is None]))
            told = int(read("<i8", 1, 32 + 8 * int(own[0] % np.uint64(r)))[0])
            slot = -1 - told if told < 0 else int(mix(own, np.uint64(told))[0] % np.uint64(m))
            prints = 32 + 8 * r
            if read("<u4", 1, prints + 4 * slot)[0] != fingerprints(own)[0]:
                return []
            ends = prints + 4 * m
            begin, end = (0, *read("<i8", 1, ends)) if slot == 0 else read("<i8", 2, ends + 8 * (slot - 1))
            entries = ends + 8 * m
            shard, first, sizes = (read("<i8", int(end - begin), entries + 8 * (n * c + int(begin))) for c in range(3))
        out = []
        for s, at, size in zip(shard.tolist(), first.tolist(), sizes.tolist()):
            file, before = self.manifest[s]
            kind = "<u2" if file.endswith("u2.bin") else "<u4"
            wide = np.dtype(kind).itemsize
            with self.system.open_input_file(f"{self.root}/{file}") as f:
                out.append((before + at, np.frombuffer(f.read_at(size * wide, at * wide), kind).astype("<u4")))
        return out


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_dir(spark, "token-files")
    write_token_files(docs, folder)
    back = read_token_files(docs.select("doc_id"), folder)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
