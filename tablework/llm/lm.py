"""Language-model scoring: a log-bilinear model over word classes, trained in numpy with noise-contrastive estimation.

The most frequent words are classes of their own, all others share classes by their last bytes. The model gives P(class | class before),
normalised by matrix products over all classes; inside a shared class known words get their count less a discount, and what the discount
frees goes to unknown words. What the corpus is counted for (words, pairs of classes) covers every training text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from tablework.llm.common import crc_of, field, map_arrow, most_frequent, row_key, stage, text_bytes
from tablework.llm.hashing import LOWER

#: Words with a class of their own, shared classes, and words at most that every task holds with their counts; counts of others are joined.
OWN, SHARED, HEAD = 768, 256, 200_000
#: Last bytes of a word that choose its shared class.
TAIL = 3
DISCOUNT = 0.75
DIMENSION, BATCH, NOISE, STEPS, RATE = 32, 2048, 256, 1500, 0.15
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000
END = b""


def class_of(word: bytes, own: dict[bytes, int]) -> int:
    found = own.get(word)
    return len(own) + zlib.crc32(word[-TAIL:]) % SHARED if found is None else found


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts (one column of bytes), A-Z lower-cased, with one empty word for each end."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(text.translate(LOWER).split())
                if len(counts) > COUNTED:
                    yield [list(counts.keys()), list(counts.values())]
                    counts.clear()
            counts[END] += batch.num_rows
        yield [list(counts.keys()), list(counts.values())]

    return map_arrow(texts, StructType([StructField("word", BinaryType()), StructField("n", LongType())]), rows).groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, own: dict[bytes, int]) -> np.ndarray:
    """How often each class follows each class, over all texts; the class of the end stands before the first word."""
    size = len(own) + SHARED
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(own)
    schema = StructType([StructField("before", IntegerType()), StructField("counts", BinaryType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        own = shared.value
        known: dict[bytes, int] = {}
        table = np.zeros(size * size, dtype=np.int64)
        end = class_of(END, own)
        for batch in batches:
            ids = [end]
            for text in batch.column(0).to_pylist():
                words = text.translate(LOWER).split()
                ids += _classes(words, known, own)
                ids.append(end)
                if len(ids) > 1_000_000:
                    table += _pairs(ids, size)
                    ids = [end]
            table += _pairs(ids, size)
        lines = table.reshape(size, size)
        yield [list(range(size)), [line.tobytes() for line in lines]]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for before, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line = np.frombuffer(counts, dtype=np.int64)
                total[before] = total[before] + line if before in total else line
        yield [list(total), [x.tobytes() for x in total.values()]]

    out = np.zeros((size, size))
    for r in map_arrow(map_arrow(texts, schema, counted).repartition("before"), schema, summed).collect():
        out[r["before"]] += np.frombuffer(r["counts"], dtype=np.int64)
    return out


def _classes(words: list[bytes], known: dict[bytes, int], own: dict[bytes, int]) -> list[int]:
    """Classes of words; ``known`` remembers them by word, up to a bound."""
    if len(known) > COUNTED:
        known.clear()
    found = list(map(known.get, words))
    if None in found:
        for i, c in enumerate(found):
            if c is None:
                found[i] = known[words[i]] = class_of(words[i], own)
    return found


def _pairs(ids: list[int], size: int) -> np.ndarray:
    at = np.array(ids, dtype=np.int64)
    return np.bincount(at[:-1] * size + at[1:], minlength=size * size)


def log10_after(context: np.ndarray, target: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Normalised log probabilities of all classes after each class, a batch of contexts at a time."""
    out = np.empty((len(context), len(target)))
    for k in range(0, len(out), BATCH):
        scores = context[k : k + BATCH] @ target.T + bias
        top = scores.max(axis=1, keepdims=True)
        out[k : k + BATCH] = (scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))) / math.log(10)
    return out


class LogBilinear:
    """Score of a class after another: context vector times class vector, plus the class's bias."""

    def __init__(self, context: np.ndarray, target: np.ndarray, bias: np.ndarray) -> None:
        self.context, self.target, self.bias = context, target, bias

    def log10(self) -> np.ndarray:
        return log10_after(self.context, self.target, self.bias)


def train(pairs: np.ndarray, seed: int = 1) -> LogBilinear:
    """Noise-contrastive estimation on pairs drawn by their counts, against noise from the classes' shares; Adagrad steps."""
    size = len(pairs)
    random = np.random.default_rng(seed)
    share = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * size)
    log_share = np.log(share).astype(np.float32)
    model = LogBilinear(random.normal(0, 0.1, (size, DIMENSION)).astype(np.float32), random.normal(0, 0.1, (size, DIMENSION)).astype(np.float32), log_share.copy())
    total = np.cumsum(pairs.ravel())
    if not total[-1]:
        return model
    shares = np.cumsum(share)
    squares = [np.full_like(x, 1e-6) for x in (model.context, model.target, model.bias)]

    def step(x: np.ndarray, square: np.ndarray, index: np.ndarray, gradient: np.ndarray) -> None:
        order = np.argsort(index, kind="stable")
        rows, first = np.unique(index[order], return_index=True)
        g = np.add.reduceat(gradient[order], first, axis=0)
        square[rows] += g * g
        x[rows] += RATE * g / np.sqrt(square[rows])

    for _ in range(STEPS):
        drawn = np.minimum(np.searchsorted(total, random.random(BATCH) * total[-1], side="right"), size * size - 1)
        c, w = drawn // size, drawn % size
        noise = np.minimum(np.searchsorted(shares, random.random(NOISE) * shares[-1], side="right"), size - 1)
        q, r, rn = model.context[c], model.target[w], model.target[noise]
        log_k = np.float32(math.log(NOISE))
        true = 1 / (1 + np.exp((q * r).sum(axis=1) + model.bias[w] - log_k - log_share[w]))  # 1 - P(data)
        false = -1 / (1 + np.exp(np.clip(log_k + log_share[noise] - q @ rn.T - model.bias[noise], -30, 30)))  # -P(data)
        weight = np.float32(1 / BATCH)
        step(model.context, squares[0], c, weight * (true[:, None] * r + false @ rn))
        index = np.concatenate([w, noise])
        step(model.target, squares[1], index, weight * np.concatenate([true[:, None] * q, false.T @ q]))
        step(model.bias, squares[2], index, weight * np.concatenate([true, false.sum(axis=0)]))
    return model


class Model:
    """Table of word counts, the words that tasks hold, the classes' sizes and the trained model."""

    def __init__(self, counts: DataFrame, head: list[tuple[bytes, int]], own: dict[bytes, int], classes: dict[int, tuple[int, int]], tokens: int, types: int, net: LogBilinear) -> None:
        self.counts, self.head, self.own, self.classes, self.tokens, self.types, self.net = counts, head, own, classes, tokens, types, net


def learn(texts: DataFrame) -> Model:
    """Learn from all rows of one column of bytes. Passes HEAD words, SHARED class sizes and a square of class pairs through the driver."""
    counts = stage(word_counts(texts))
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # the end always comes along, as scoring joins counts of words only
    frequent = most_frequent(counts, "n", HEAD).unionByName(counts.where("length(word) = 0 AND n > 0"))
    head = sorted({(bytes(r["word"]), r["n"]) for r in frequent.collect()}, key=lambda x: (-x[1], x[0]))
    own = {w: i for i, w in enumerate([END, *(w for w, _ in head if w != END)][:OWN])}
    spark = texts.sparkSession
    named = spark.createDataFrame([(bytearray(w),) for w in own], "word binary")
    shared = counts.join(F.broadcast(named), "word", "left_anti").groupBy(F.pmod(F.crc32(F.expr(f"substring(word, -{TAIL}, {TAIL})")), F.lit(SHARED)).alias("c"))
    classes = {len(own) + r["c"]: (r["n"], r["v"]) for r in shared.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    return Model(counts, head, own, classes, tokens, types, train(pair_counts(texts, own)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text and its end).

    Null and empty texts are one end; repeated rows are scored alike; without training texts every word is unknown; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    below = math.log10(model.tokens + model.types + 1)
    own = model.own
    size = len(own) + SHARED
    # plain arrays: a broadcast names classes by their module, which executors need not have
    shared = spark.sparkContext.broadcast((model.head, own, model.classes, (model.net.context, model.net.target, model.net.bias)))
    tails = ArrayType(StructType([StructField("word", BinaryType()), StructField("m", IntegerType())]))
    schema = StructType([
        field(docs, id_col, "_id"), StructField("_key", BinaryType()), StructField("n_tokens", LongType()), StructField("n_known", LongType()),
        StructField("base", DoubleType()), StructField("own", DoubleType()), StructField("tails", tails),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        head, own, classes, net = shared.value
        after = log10_after(*net).ravel()
        place = {w: i for i, (w, _) in enumerate(head)}
        number = np.array([class_of(w, own) for w, _ in head], dtype=np.int64)
        count = np.array([n for _, n in head], dtype=float)
        base = np.log10(count + 1) - below
        sizes = np.array([1.0 if c < len(own) else classes[c][0] for c in number.tolist()])
        inside = np.where(number < len(own), 0.0, np.log10(np.where(number < len(own), 1.0, np.maximum(count - DISCOUNT, 1e-9)) / sizes))
        end, end_class = place.get(END, -1), class_of(END, own)
        known: dict[bytes, int] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column(2).to_pylist():
                words = text.translate(LOWER).split()
                found = [place.get(w, -1) for w in words]
                found.append(end)
                at = np.array(found, dtype=np.int64)
                there = at >= 0
                ids = number[at] if len(number) else np.zeros(len(at), dtype=np.int64)
                ids[-1] = end_class
                rest: list[dict] = []
                if not there.all():
                    miss = np.flatnonzero(~there[:-1])
                    other = [words[i] for i in miss.tolist()]
                    ids[miss] = _classes(other, known, own)
                    rest = [{"word": w, "m": m} for w, m in Counter(other).items()]
                held = at[there]
                before = np.concatenate([[end_class], ids[:-1]])
                missing_end = 0.0 if there[-1] else -below
                for c, x in zip(out, (len(at), len(held), float(base[held].sum()) + missing_end, float(after[before * size + ids].sum() + inside[held].sum()), rest), strict=True):
                    c.append(x)
            yield [batch.column(0), batch.column(1), *out]

    main = stage(map_arrow(docs.select(id_col, row_key(id_col, text_col), text_bytes(text_col)), schema, rows))
    some = main.where(F.size("tails") > 0).select("_key", "tails")
    if not main.groupBy("_key").count().where("count > 1").isEmpty():
        some = some.dropDuplicates(["_key"])
    classes = spark.createDataFrame([(c - len(own), n, v) for c, (n, v) in model.classes.items()] or [(-1, 1, 1)], "c long, size long, types long")
    words = some.select("_key", F.explode("tails").alias("t")).select("_key", "t.word", "t.m")
    joined = words.join(model.counts, "word", "left").withColumn("c", F.pmod(F.crc32(F.expr(f"substring(word, -{TAIL}, {TAIL})")), F.lit(SHARED))).join(F.broadcast(classes), "c", "left")
    inside = F.when(F.col("size").isNull(), F.lit(0.0)).otherwise(F.log10(F.coalesce(F.col("n") - DISCOUNT, DISCOUNT * F.col("types")) / F.col("size")))
    tail = joined.groupBy("_key").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("t_known"),
        F.sum(F.col("m") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - below)).alias("t_base"), F.sum(F.col("m") * inside).alias("t_own"),
    )
    return main.drop("tails").join(tail, "_key", "left").select(
        F.col("_id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("t_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("t_base", F.lit(0.0))).alias("base_score"), (F.col("own") + F.coalesce("t_own", F.lit(0.0))).alias("score"),
    )


def held_out(id_col: str = "doc_id"):
    return F.pmod(crc_of(id_col), F.lit(7)) == 2
