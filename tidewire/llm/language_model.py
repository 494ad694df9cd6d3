"""Language-model scores: add-0.1 unigrams as a base, and a hashed maximum-entropy model with a class-factored softmax.

``P(word | before) = P(class | before) * P(word | class, before)``. The ``HEADS * SLOTS`` most frequent words (the end of a text
is the first) have classes by rank; any other word has one of ``TAILS`` classes by a hash of its ending. Both factors are
maximum-entropy models over hashed features of the three words before, as they are: n-grams (1, 12) and skips (2, 13). Each
feature is a row of weights in a table of ``buckets`` rows, with a weight for each class in the first factor; in the second,
where the feature is hashed together with the word's class, a weight for each word of that class. To the weights come the logs
of the unigram shares, so that without any weight the model is the base. A word of a tail class has its share of the class's
training tokens (add-0.1, with one unseen word for each class, as the base has one for all).

Training goes through all training tokens once, a part in each of ``rounds``: every task begins with the weights so far, takes
gradient steps (scaled by the gradients seen, for each row of weights) over its own texts in numpy batches, and gives what it has
changed, in blocks of rows. Spark sums the blocks and the next round begins with the mean change over the tasks that
met a row. Only rows of features that occur are touched and only rows of known size (``buckets * (classes + slots)`` weights, 17 MB)
come to the driver, at any size of input.

Where the work is: each task reads its texts in chunks of about ``chunk_tokens`` tokens, numbers the chunk's distinct words and
writes texts as numbers. Only a chunk's distinct words are shuffled: they are counted by word (with a partial step) into a
written table, and each chunk's words are joined to it; Spark splits that join where a word is in very many chunks. Every word
of every training text counts.

Defined results: a null or empty text is its end token alone; a null id is in no fold, neither learnt from nor held out;
repeated rows are each learnt from and scored; with no training texts the base is log10 of 1 for each token (0) and so is the
score; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import crc_fold, frame, release, staged, table

ENCODED = "chunk long, id long, fold int, n_tokens long, ids binary, word string, local int, n long"
CODED = "id long, fold int, n_tokens long, n_known long, base_score double, tail_score double, codes binary"
HEADS, SLOTS, TAILS = 16, 32, 16
CLASSES, HEAD_WORDS = HEADS + TAILS, HEADS * SLOTS
ALPHA = 0.1
#: Which of the words 1, 2 and 3 places before make up each feature.
FEATURES = [(1,), (1, 2), (2,), (1, 3)]
NEVER = -30.0  # log weight of classes and slots that no word has


# --- texts as numbers ---------------------------------------------------------------------------------------------------


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def encode(docs: DataFrame, key: str, text: str, folds: int, chunk_tokens: int) -> DataFrame:
    """Rows with ``ids``: a text as numbers of its chunk's words. Rows with ``word``: a word of a chunk, its number and its count in training texts."""
    rows = docs.select(F.col(key).cast("long").alias("id"), crc_fold(key, folds).cast("int").alias("fold"), F.coalesce(text, F.lit("")).alias("text"))
    kinds = pa.schema([("chunk", pa.int64()), ("id", pa.int64()), ("fold", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("word", pa.string()), ("local", pa.int32()), ("n", pa.int64())])

    def batch(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in kinds], schema=kinds)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        seen = Numbers({b"": 0})
        learnt: list[np.ndarray] = []
        held = 0

        def words() -> Iterator[pa.RecordBatch]:
            every = list(seen)
            counts = np.bincount(np.concatenate(learnt), minlength=len(every)) if learnt else np.zeros(len(every), np.int64)
            for at in range(0, len(every), 200_000):
                own = every[at : at + 200_000]
                n = len(own)
                yield batch(n, chunk=pa.array(np.full(n, chunk)), word=pa.array(own, pa.binary()).cast(pa.string()), local=pa.array(np.arange(at, at + n, dtype=np.int32)), n=pa.array(counts[at : at + n].astype(np.int64)))

        def texts(out: list[tuple]) -> pa.RecordBatch:
            ids, folds_, blobs = zip(*out)
            sizes = np.array([len(b) // 4 for b in blobs], np.int64)
            return batch(len(out), chunk=pa.array(np.full(len(out), chunk)), id=pa.array(ids, pa.int64()), fold=pa.array(folds_, pa.int32()), n_tokens=pa.array(sizes), ids=pa.array(blobs, pa.binary()))

        for b in batches:
            out: list[tuple] = []
            for doc, fold, t in zip(*[b.column(k).to_pylist() for k in range(3)]):
                tokens = t.encode().lower().split()
                ids = np.zeros(len(tokens) + 1, np.uint32)
                ids[:-1] = np.fromiter(map(seen.__getitem__, tokens), np.uint32, len(tokens))
                if fold:
                    learnt.append(ids)
                out.append((doc, fold, ids.tobytes()))
                held += len(ids)
                if held >= chunk_tokens:
                    yield texts(out)
                    yield from words()
                    out, held, learnt, chunk, seen = [], 0, [], chunk + 1, Numbers({b"": 0})
            if out:
                yield texts(out)
        if held:
            yield from words()

    return staged(rows.mapInArrow(numbered, ENCODED), "lm-encoded")


def ending_class(word):
    """The tail class of a word: by its last two letters."""
    ending = F.right(F.rtrim(word, F.lit(".,;:!?'\"#$%&*|)]")), F.lit(2))
    return (F.pmod(F.xxhash64(ending), F.lit(TAILS)) + HEADS).cast("int")


class Vocabulary:
    """What the counts say: N, V, the head words in order, and tokens and words of each class."""

    def __init__(self, encoded: DataFrame) -> None:
        words = encoded.where("word IS NOT NULL AND n > 0")
        self.counts = staged(words.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
        top = self.counts.where("word <> ''").orderBy(F.desc("c"), "word").limit(HEAD_WORDS - 1).collect()
        self.end = sum(r["c"] for r in self.counts.where("word = ''").collect())
        self.heads = [("", self.end), *((r["word"], r["c"]) for r in top)]
        self.spark = encoded.sparkSession
        tails = self.counts.join(self.head_table(), "word", "left_anti").groupBy(ending_class(F.col("word")).alias("cls")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
        self.tail_n, self.tail_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in tails:
            self.tail_n[r["cls"]], self.tail_v[r["cls"]] = r["n"], r["v"]
        self.n = int(sum(c for _, c in self.heads) + self.tail_n.sum())
        self.v = int(sum(c > 0 for _, c in self.heads) + self.tail_v.sum())

    def head_table(self) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(w, k) for k, (w, _) in enumerate(self.heads)], "word string, rank int"))  # HEAD_WORDS rows

    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """Log shares of the classes, and of the slots within each head class (any other class has one slot)."""
        c = np.zeros(HEAD_WORDS)
        c[: len(self.heads)] = [max(n, ALPHA) for _, n in self.heads]
        c = c.reshape(HEADS, SLOTS)
        n = np.concatenate([c.sum(axis=1), self.tail_n[HEADS:] + ALPHA * (self.tail_v[HEADS:] + 1)])
        with np.errstate(divide="ignore", invalid="ignore"):
            classes = np.where(n > 0, np.log(n / n.sum()), NEVER)
            slots = np.where(c > 0, np.log(c / c.sum(axis=1, keepdims=True)), NEVER)
        return classes.astype(np.float32), slots.astype(np.float32)


def code_texts(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A row for each text: base score, log10 of its tail words within their classes, and its words as codes (4 bytes each).

    The code of a head word is its rank; of another, ``HEAD_WORDS`` plus 16 times a hash of it plus its class among the tails.
    """
    words = encoded.where("word IS NOT NULL").select("chunk", "local", "word")
    words = words.join(vocabulary.counts, "word", "left").join(vocabulary.head_table(), "word", "left")
    tail = F.lit(HEAD_WORDS) + F.pmod(F.xxhash64("word"), F.lit(1 << 26)) * TAILS + ending_class(F.col("word")) - HEADS
    words = words.select(F.col("chunk").alias("of_chunk"), "local", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("rank", tail).cast("int").alias("code"))
    n, v, tail_n, tail_v = float(vocabulary.n), float(vocabulary.v), vocabulary.tail_n, vocabulary.tail_v

    def coded(texts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        at = own["local"].to_numpy()
        c, codes = np.zeros(len(own)), np.zeros(len(own), np.uint32)
        c[at], codes[at] = own["c"].to_numpy(), own["code"].to_numpy()
        base = np.log10((c + ALPHA) / (n + ALPHA * (v + 1)))
        cls = class_of(codes)
        tail = np.where(codes < HEAD_WORDS, 0.0, np.log10((c + ALPHA) / (tail_n[cls] + ALPHA * (tail_v[cls] + 1))))
        out = []
        for doc, fold, blob in zip(texts["id"].astype("Int64"), texts["fold"].astype("Int32"), texts["ids"]):
            ids = np.frombuffer(blob, np.uint32)
            out.append((None if doc is pd.NA else doc, None if fold is pd.NA else fold, len(ids), int(np.count_nonzero(c[ids])), float(base[ids].sum()), float(tail[ids].sum()), codes[ids].tobytes()))
        return frame(out, CODED)

    texts = encoded.where("word IS NULL").select("chunk", "id", "fold", "ids")
    return staged(texts.groupBy("chunk").cogroup(words.groupBy("of_chunk")).applyInPandas(coded, CODED), "lm-coded")


# --- the maximum-entropy model ------------------------------------------------------------------------------------------


def class_of(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.int64)
    return np.where(codes < HEAD_WORDS, codes // SLOTS, HEADS + (codes - HEAD_WORDS) % TAILS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(before: list[np.ndarray]) -> np.ndarray:
    """Hashes of the features of each place (a row of FEATURES columns); before: the codes 1, 2 and 3 places before."""
    out = np.empty((len(before[0]), len(FEATURES)), np.uint64)
    for k, places in enumerate(FEATURES):
        h = np.full(len(before[0]), k + 1, np.uint64)
        for p in places:
            h = _mixed(h * np.uint64(0xBF58476D1CE4E5B9) + before[p - 1].astype(np.uint64) + np.uint64(1))
        out[:, k] = h
    return out


def rows_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of weights; small numbers where they fit, which sort much faster."""
    return (hashes % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)


def of_class(hashes: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The hashes of the second factor's features."""
    return _mixed(hashes + (cls[:, None].astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))


def logits(weights: np.ndarray, rows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Sums of weights and offset (a row for all, or one for each), less the largest of each place."""
    z = np.take(weights, rows[:, 0], axis=0, mode="clip")
    z += offset
    for k in range(1, rows.shape[1]):
        z += np.take(weights, rows[:, k], axis=0, mode="clip")
    z -= z.max(axis=1, keepdims=True)
    return z


def batches_of(texts: Iterator[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, code, codes before as 3 rows) of at most ``size`` places; before a text there are ends."""
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    n = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(owner), np.concatenate([h[3:] for h in held]), np.stack([np.concatenate([h[3 - p : len(h) - p] for h in held]) for p in (1, 2, 3)])

    for k, codes in enumerate(texts):
        padded = np.concatenate([np.zeros(3, np.uint32), codes])
        for at in range(0, len(codes), size):
            own = padded[at : at + size + 3]
            held.append(own)
            owner.append(np.full(len(own) - 3, k))
            n += len(own) - 3
            if n >= size:
                yield joined()
                held, owner, n = [], [], 0
    if held:
        yield joined()


class Maxent:
    """Weights of both factors and their offsets."""

    def __init__(self, buckets: int, class_offset: np.ndarray, slot_offset: np.ndarray) -> None:
        self.buckets, self.class_offset, self.slot_offset = buckets, class_offset, slot_offset
        self.weights = [np.zeros((buckets, CLASSES), np.float32), np.zeros((buckets, SLOTS), np.float32)]

    def parts(self, codes: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each factor: its number, the places it covers, their rows of weights, offsets and what is right."""
        hashes, cls = features(list(before)), class_of(codes)
        yield 0, np.arange(len(codes)), rows_of(hashes, self.buckets), self.class_offset, cls
        head = np.flatnonzero(codes < HEAD_WORDS)
        if len(head):
            yield 1, head, rows_of(of_class(hashes[head], cls[head]), self.buckets), self.slot_offset[cls[head]], (codes[head] % SLOTS).astype(np.int64)

    def log10(self, codes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of each place: its class, and for a head word the word in its class."""
        out = np.zeros(len(codes))
        for f, at, rows, offset, right in self.parts(codes, before):
            z = logits(self.weights[f], rows, offset)
            own = z[np.arange(len(at)), right]
            out[at] += own - np.log(np.exp(z, out=z).sum(axis=1))
        return out / np.log(10)


def sums_by_row(rows: np.ndarray, values: np.ndarray, short: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and for each the sum of the values of the places that have it (once for each time)."""
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    flat, places = flat[order], order // rows.shape[1]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(flat)]]))
    sums = values[places[starts]]
    for k in range(1, short):  # most rows are met a few times: these are added time by time
        more = np.flatnonzero((lengths > k) & (lengths <= short))
        if len(more):
            sums[more] += values[places[starts[more] + k]]
    long = np.flatnonzero(lengths > short)
    if len(long):
        inside = places[np.repeat(lengths > short, lengths)]
        sums[long] = np.add.reduceat(values[inside], np.concatenate([[0], np.cumsum(lengths[long])[:-1]]), axis=0)
    return flat[starts], sums


class Steps:
    """Gradient steps of one task from the given weights; ``seen`` holds the squares of each row's gradients."""

    def __init__(self, model: Maxent, speed: float) -> None:
        self.model, self.speed = model, speed
        self.begin = [w.copy() for w in model.weights]
        self.seen = [np.zeros(model.buckets, np.float32) for _ in model.weights]

    def step(self, codes: np.ndarray, before: np.ndarray) -> None:
        for f, _, rows, offset, right in self.model.parts(codes, before):
            g = logits(self.model.weights[f], rows, offset)
            np.exp(g, out=g)
            g /= g.sum(axis=1, keepdims=True)
            g[np.arange(len(right)), right] -= 1
            own, sums = sums_by_row(rows, g)
            seen = self.seen[f][own] + np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
            self.seen[f][own] = seen
            sums *= (self.speed / np.sqrt(seen + 1e-2))[:, None]
            self.model.weights[f][own] -= sums

    def changes(self, block: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(factor, block, changes of its rows, which rows were met), for blocks that were met."""
        for f, (now, before, seen) in enumerate(zip(self.model.weights, self.begin, self.seen)):
            for b in range(0, self.model.buckets, block):
                met = seen[b : b + block] > 0
                if met.any():
                    yield f, b // block, (now[b : b + block] - before[b : b + block]).tobytes(), met.astype(np.float32).tobytes()


CHANGES = "factor int, block int, change binary, met binary"


def _codes(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    return (np.frombuffer(b, np.uint32) for b in pdf["codes"])


def train(coded: DataFrame, model: Maxent, rounds: int, speed: float, batch: int, task_tokens: int, block: int = 1024) -> Maxent:
    """One pass over all training texts, a part of them (by a hash of the text) in each round."""
    spark = coded.sparkSession
    learnt = coded.where("fold <> 0").withColumn("part", F.pmod(F.xxhash64("codes"), F.lit(rounds)))
    n_tokens = learnt.agg(F.sum("n_tokens")).head()[0]
    if not n_tokens:
        return model
    tasks = max(1, min(coded.rdd.getNumPartitions(), -(-n_tokens // (task_tokens * rounds))))
    for r in range(rounds):
        told = spark.sparkContext.broadcast(model)

        def own_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine = Maxent(told.value.buckets, told.value.class_offset, told.value.slot_offset)
            mine.weights = [w.copy() for w in told.value.weights]
            steps = Steps(mine, speed)
            for _, codes, before in batches_of((c for pdf in batches for c in _codes(pdf)), batch):
                steps.step(codes, before)
            for change in steps.changes(block):
                yield frame([change], CHANGES)

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[int, int], list[np.ndarray]] = {}  # at most all blocks of the model
            for pdf in batches:
                for f, b, change, met in zip(pdf["factor"], pdf["block"], pdf["change"], pdf["met"]):
                    own = [np.frombuffer(x, np.float32) for x in (change, met)]
                    sums[f, b] = [x + y for x, y in zip(sums[f, b], own)] if (f, b) in sums else own
            for (f, b), (change, met) in sums.items():
                yield frame([(f, b, change.tobytes(), met.tobytes())], CHANGES)

        changes = learnt.where(F.col("part") == r).select("codes").coalesce(tasks).mapInPandas(own_steps, CHANGES)
        total = changes.repartition("factor", "block").mapInPandas(summed, CHANGES).toPandas()  # at most the size of the model
        weights = [w.copy() for w in model.weights]
        for f, b, change, met in zip(total["factor"], total["block"], total["change"], total["met"]):
            own = weights[f][b * block : (b + 1) * block]
            own += np.frombuffer(change, np.float32).reshape(own.shape) / np.maximum(np.frombuffer(met, np.float32), 1)[:, None]
        model = Maxent(model.buckets, model.class_offset, model.slot_offset)
        model.weights = weights
        told.unpersist()
    return model


def language_model(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 10, chunk_tokens: int = 3_000_000, buckets: int = 1 << 16, rounds: int = 2, speed: float = 0.1, batch: int = 16_384, task_tokens: int = 8_000_000) -> DataFrame:
    """A row for each text: held_out, n_tokens, n_known, train_tokens, base_score and score (both log10)."""
    encoded = encode(docs, key, text, folds, chunk_tokens)
    vocabulary = Vocabulary(encoded)
    coded = code_texts(encoded, vocabulary)
    release(encoded)
    release(vocabulary.counts)
    model = train(coded, Maxent(buckets, *vocabulary.offsets()), rounds, speed, batch, task_tokens)
    told = docs.sparkSession.sparkContext.broadcast(model)
    empty = vocabulary.n == 0

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = told.value
        for pdf in batches:
            score = np.zeros(len(pdf))
            if not empty:
                for owner, codes, before in batches_of(_codes(pdf), batch):
                    score += np.bincount(owner, model.log10(codes, before), len(pdf))
                score += pdf["tail_score"].to_numpy()
            yield pdf.drop(columns=["codes", "tail_score"]).assign(score=score).astype({"id": "Int64"})

    out = coded.select("id", F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "base_score", "codes", "tail_score")
    out = out.mapInPandas(add, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(vocabulary.n).cast("long").alias("train_tokens"), "base_score", "score")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(table(spark, sf_dir, "documents"))
