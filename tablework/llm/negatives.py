"""Hard negatives by exact inner products with the method of the Four Russians.

Vectors become integers. Of an anchor, every group of eight dimensions has a table of the sums of all 256 subsets of its components. A candidate is
kept as bit planes: one byte for each group and binary digit of its components. A byte read from an anchor's table, shifted by the digit, adds up to
the whole inner product; the sign digit counts negative. Scores are exact, and nothing is cut off before they are known.

The anchors are a stated set of queries, scored against all rows in blocks: a task streams its candidates, takes SLICE of them and BLOCK anchors at a
time and hands on the best rows only. The first pass finds the positives of all anchors, the second one the negatives within their limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tablework.llm.common import SLICE, map_arrow, stage

GROUP = 8
#: Anchors that are scored at once.
BLOCK = 64
#: Bytes of anchors that are broadcast at once; more are worked off one slice after the other.
ANCHOR_BYTES = 16 << 20
#: Pairs that a task should score, a few seconds' work.
PAIRS = 20_000_000
LEAST = np.iinfo(np.int64).min


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v): components as floor(scale * x). Rows without id, label or vector, or with a null or non-finite component, are left out.

    Rows that repeat an id count once, the one with the least label and vector."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    given = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = given.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(~bad)
    whole = stage(good.select("id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")))
    if whole.groupBy("id").count().where("count > 1").isEmpty():
        return whole
    return stage(whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of ``dims`` integers; shorter ones end in zeros."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def bit_planes(values: np.ndarray, digits: int) -> np.ndarray:
    """(digits, groups, rows) bytes: bit d of the two's complement of each component, eight dimensions a byte."""
    rows, dims = values.shape
    wide = np.zeros((rows, -(-dims // GROUP) * GROUP), dtype=np.int64)
    wide[:, :dims] = values
    bits = (wide[None] >> np.arange(digits)[:, None, None]) & 1
    return np.ascontiguousarray(np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").transpose(0, 2, 1))


def subset_sums(values: np.ndarray) -> np.ndarray:
    """(groups, 256, rows): for every byte the sum of a row's components in that group whose bits are set."""
    rows, dims = values.shape
    wide = np.zeros((rows, -(-dims // GROUP) * GROUP), dtype=np.int64)
    wide[:, :dims] = values
    parts = wide.reshape(rows, -1, GROUP).transpose(1, 2, 0)
    table = np.zeros((len(parts), 1 << GROUP, rows), dtype=np.int64)
    for k in range(GROUP):
        table[:, 1 << k : 2 << k] = table[:, : 1 << k] + parts[:, k : k + 1]
    return table


def all_scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products: for every digit, from the sign down, the sum so far is doubled and the lookups are added."""
    digits, groups, rows = planes.shape
    total = np.zeros((rows, tables.shape[2]), dtype=np.int64)
    for d in range(digits - 1, -1, -1):
        found = np.zeros_like(total)
        for g in range(groups):
            found += tables[g][planes[d, g]]
        total = -found if d == digits - 1 else (total << 1) + found
    return total


def packed(vectors: DataFrame, dims: int, digits: int) -> DataFrame:
    """Candidates as (id, label, planes): the bytes of all digits and groups of a vector one after the other."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            planes = bit_planes(_matrix(batch.column(2), dims), digits).transpose(2, 0, 1)
            yield [batch.column(0), batch.column(1), [x.tobytes() for x in planes]]

    return map_arrow(vectors.select("id", "label", "v"), StructType([StructField("id", LongType()), StructField("label", LongType()), StructField("planes", BinaryType())]), rows)


def _best(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest keys of each column, without those that are LEAST."""
    if len(keys) > k:
        top = np.argpartition(keys, len(keys) - k, axis=0)[len(keys) - k :]
    else:
        top = np.broadcast_to(np.arange(len(keys))[:, None], keys.shape)
    there = np.take_along_axis(keys, top, axis=0) > LEAST
    return top[there], np.broadcast_to(np.arange(keys.shape[1]), top.shape)[there]


FOUND = StructType([StructField("anchor_id", LongType()), StructField("place", IntegerType()), StructField("id", LongType()), StructField("score", LongType())])


def _search(candidates: DataFrame, count: int, anchors: DataFrame, dims: int, digits: int, k: int, percent: int | None) -> DataFrame:
    """(anchor_id, place, id, score, rank): the k best rows of each anchor's label, or, with ``percent``, of other labels within the limits of each of
    its positives. ``anchors``: written id, label, v, limits, and each is in one of the slices that are broadcast one after the other."""
    spark = candidates.sparkSession
    asked = anchors.count()
    slices = max(1, -(-asked * (dims + 8) * 8 // ANCHOR_BYTES))
    tasks = -(-count * -(-asked // slices) // PAIRS)
    spread = candidates if tasks <= candidates.rdd.getNumPartitions() else candidates.repartition(tasks)
    found = []
    for number in range(slices):
        part = anchors.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == number).collect()
        held = spark.sparkContext.broadcast([(r["id"], r["label"], np.array(r["v"] + [0] * (dims - len(r["v"])), dtype=np.int64), r["limits"]) for r in part])
        found.append(stage(_scored(spread, held, digits, k, percent)))
        held.unpersist()
    order = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(candidates: DataFrame, held: Broadcast, digits: int, k: int, percent: int | None) -> DataFrame:
    """(anchor_id, place, id, score): the k best rows of every batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        blocks = []
        for at in range(0, len(held.value), BLOCK):
            ids, labels, values, limits = zip(*held.value[at : at + BLOCK], strict=True)
            blocks.append((np.array(ids), np.array(labels), subset_sums(np.stack(values)), limits))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            order = np.argsort(ids, kind="stable")
            ids, labels = ids[order], labels[order]
            planes = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(ids), digits, -1)[order].transpose(1, 2, 0)
            planes = np.ascontiguousarray(planes)
            for a_ids, a_labels, tables, limits in blocks:
                scores = all_scores(planes, tables)
                keys = scores * len(ids) + np.arange(len(ids) - 1, -1, -1)[:, None]  # of equal scores the least id is the largest
                same = labels[:, None] == a_labels
                if percent is None:
                    wanted = [(0, same & (ids[:, None] != a_ids))]
                else:
                    wanted = []
                    for j in range(max(map(len, limits))):
                        top = np.array([x[j] if j < len(x) else LEAST // 100 for x in limits])  # no score is that low
                        wanted.append((j, ~same & (100 * scores >= percent * top) & (scores <= top)))
                out: list[list[np.ndarray]] = [[], [], [], []]
                for j, able in wanted:
                    row, column = _best(np.where(able, keys, LEAST), k)
                    for c, x in zip(out, (a_ids[column], np.full(len(row), j, dtype=np.int32), ids[row], scores[row, column]), strict=True):
                        c.append(x)
                yield [np.concatenate(x) for x in out]

    return map_arrow(candidates, FOUND, rows)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """For each anchor and each of its positives the hardest rows of other labels: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: a written table of id, label and v (``integer_vectors``). Positives are the best other rows of the anchor's label; negatives score
    at least ``percent`` per cent of the positive and no more than it. Ties go to the smaller id. A vector of another length counts as if it ended
    in zeros. A positive without such rows gives none; an empty table gives no rows. Components so large that scores could leave the range of
    exact numbers raise an error. Scoring is queries times rows by its nature: anchors in blocks, against all rows.
    """
    count, size, low, high = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    dims, low, high = max(1, size or 0), low or 0, high or 0
    most = max(abs(low), abs(high))
    if dims * most * most * SLICE >= 1 << 62:  # a score and a place in a chunk are one number
        raise ValueError(f"components up to {most} in {dims} dimensions are too large for exact scores")
    digits = max((x if x >= 0 else -x - 1).bit_length() for x in (low, high)) + 1
    candidates = stage(packed(vectors, dims, digits))
    none = F.array().cast("array<long>")
    anchors = stage(vectors.where(is_anchor).select("id", "label", "v", none.alias("limits")))
    best = _search(candidates, count, anchors, dims, digits, positives, None)
    near = stage(best.select("anchor_id", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # one row for each anchor, with as many scores as positives are asked for at most
    limits = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))), lambda r: r["positive_score"]).alias("limits"))
    asked = stage(anchors.drop("limits").join(limits.withColumnRenamed("anchor_id", "id"), "id"))
    found = _search(candidates, count, asked, dims, digits, negatives, percent)
    far = found.select("anchor_id", (F.col("place") + 1).alias("at"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(near.withColumnRenamed("rank", "at"), ["anchor_id", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, **limits: int) -> DataFrame:
    """``mine`` over the rows that take part (``integer_vectors``); ``is_anchor`` is said of the column ``id``. Other columns are ignored."""
    return mine(integer_vectors(rows, id_col, vector_col, label_col, scale), is_anchor, **limits)
