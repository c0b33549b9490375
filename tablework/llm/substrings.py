"""Repeated byte strings by a depth-limited radix sort over all windows of a fixed width.

Only the order up to the threshold matters: windows are split by most-significant-digit passes, and a group that is still together after
the last digit is one repeated window. Digits are chosen so that neighbouring windows share them and travel as one row:

1. The least hash of the ``GRAM``-byte strings in a window. A *run* is a stretch of windows with the same least hash; equal windows have
   equal digits wherever they stand. A run whose digit occurs nowhere else has no repeated window and is dropped here.
2. The whole content of the run. Runs of equal content are repeated window by window.
3. For runs whose first digit recurs with other contents: blocks of ``BLOCK`` windows, placed relative to the least string, by the bytes that
   all windows of a block share, then by the bytes of the whole block.
4. For blocks that only the former tell to be shared: the windows themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tablework.llm.common import BROADCAST_ROWS, field, join_checked, map_arrow, per_row, row_key, rows_at, stage, text_bytes
from tablework.llm.hashing import Rolling

WIDTH = 400
GRAM = 200
BLOCK = 16
SEED = 3
#: Rows that a task hands on at once.
FLUSH = 20_000


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window."""
    out, size = values, 1
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def runs_of(rolling: Rolling, text: bytes, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Digit, first window, number of windows, content, place of the least string and whether it stands there more than once, of each run."""
    data = np.frombuffer(text, dtype=np.uint8)
    sums = rolling.sums(data)
    grams = rolling.windows(sums, gram)
    least = sliding_min(grams, width - gram + 1)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    end = np.concatenate([start[1:], [len(least)]])
    content = rolling.ranges(sums, start, end - 1 + width)
    digit = least[start]
    place, again = np.empty(len(digit), dtype=np.int64), np.empty(len(digit), dtype=bool)
    for i, (d, a, b) in enumerate(zip(digit, start.tolist(), (end + width - gram).tolist(), strict=True)):
        hit = np.flatnonzero(grams[a:b] == d)
        place[i], again[i] = a + hit[0], len(hit) > 1
    return digit.view(np.int64), start, end - start, content.view(np.int64), place, again


RUN = StructType([
    StructField("key", BinaryType()), StructField("digit", LongType()), StructField("content", LongType()), StructField("start", IntegerType()),
    StructField("n", IntegerType()), StructField("place", IntegerType()), StructField("again", BooleanType()),
])


def run_table(docs: DataFrame, id_col: str, text_col: str, width: int, gram: int) -> DataFrame:
    """The runs of all texts of at least ``width`` bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        rolling = Rolling(SEED)
        for batch in batches:
            found, index = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if len(text) >= width:
                    found.append(runs_of(rolling, text, width, gram))
                    index.append(np.full(len(found[-1][0]), i))
            if found:
                digit, start, n, content, place, again = (np.concatenate(c) for c in zip(*found, strict=True))
                yield [rows_at(batch.column(0), np.concatenate(index)), digit, content, start.astype(np.int32), n.astype(np.int32), place.astype(np.int32), again]

    return map_arrow(docs.select(row_key(id_col, text_col), text_bytes(text_col)), RUN, rows)


def _gathered(parts: Iterator[tuple], kinds: list[str]) -> Iterator[list]:
    """Batches of about FLUSH rows made of tuples of equally long arrays and numbers that hold for all of them."""
    held: list[tuple] = []
    n = 0
    for part in parts:
        m = len(part[-1])
        held.append(tuple(x if isinstance(x, np.ndarray) else np.full(m, x) for x in part))
        n += m
        if n >= FLUSH:
            yield [np.concatenate(c).astype(t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]
            held, n = [], 0
    if held:
        yield [np.concatenate(c).astype(t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]


def _blocks(runs: DataFrame, width: int) -> DataFrame:
    """The blocks of runs (digit, content, weight, place, n, text): digit, content, weight, at (of the block, from the least string on), inner and
    whole (what all its windows share, and all of it), first (window in the run), n."""
    fields = [("digit", LongType()), ("content", LongType()), ("weight", LongType()), ("at", IntegerType()), ("inner", LongType()), ("whole", LongType()), ("first", IntegerType()), ("n", IntegerType())]
    kinds = ["i8", "i8", "i8", "i4", "i8", "i8", "i4", "i4"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rolling = Rolling(SEED)
        for batch in batches:
            for digit, content, weight, place, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums = rolling.sums(np.frombuffer(text, dtype=np.uint8))
                at = np.arange(-place // BLOCK, (n - 1 - place) // BLOCK + 1)
                lo = np.maximum(place + BLOCK * at, 0)
                hi = np.minimum(place + BLOCK * at + BLOCK, n) - 1
                inner = rolling.ranges(sums, place + BLOCK * (at + 1) - 1, place + BLOCK * at + width)
                whole = rolling.ranges(sums, lo, hi + width) ^ (lo - place - BLOCK * at).astype(np.uint64)
                yield digit, content, weight, at, inner.view(np.int64), whole.view(np.int64), lo, hi - lo + 1

    schema = StructType([StructField(*f) for f in fields])
    return map_arrow(runs.select("digit", "content", "weight", "place", "n", "text"), schema, lambda batches: _gathered(parts(batches), kinds))


def _windows(runs: DataFrame, width: int) -> DataFrame:
    """The windows of parts of runs (digit, content, weight, place, first, n, text): digit, at (the window, from the least string on), hash, weight,
    content, first, n.

    Where ``place`` is null, ``at`` is 0, windows that recur in the part are one row with the weight of all, and rows with at = 1 and hash 0 tell
    their places (first, n) and do not count."""
    fields = [("digit", LongType()), ("content", LongType()), ("weight", LongType()), ("at", IntegerType()), ("hash", LongType()), ("first", IntegerType()), ("n", IntegerType())]
    kinds = ["i8", "i8", "i8", "i4", "i8", "i4", "i4"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rolling = Rolling(SEED)
        for batch in batches:
            for digit, content, weight, place, first, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums = rolling.sums(np.frombuffer(text, dtype=np.uint8))
                lo = np.arange(first, first + n)
                hashes = rolling.ranges(sums, lo, lo + width).view(np.int64)
                if place is not None:
                    yield digit, content, weight, lo - place, hashes, lo, np.ones(n, dtype=np.int64)
                    continue
                values, index, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                yield digit, content, weight * counts, 0, values, lo[index], np.ones(len(values), dtype=np.int64)
                again = np.concatenate([[0], counts[inverse] > 1, [0]])
                edges = np.flatnonzero(np.diff(again))
                if len(edges):
                    yield digit, content, weight, 1, 0, first + edges[::2], edges[1::2] - edges[::2]

    schema = StructType([StructField(*f) for f in fields])
    return map_arrow(runs.select("digit", "content", "weight", "place", "first", "n", "text"), schema, lambda batches: _gathered(parts(batches), kinds))


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(key, start, n): stretches of n windows from byte ``start`` on, each of which also starts anywhere else. Stretches may meet."""
    runs = stage(run_table(docs, id_col, text_col, width, gram))
    digits = stage(runs.groupBy("digit").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 OR again").select("digit", "again"))
    live = stage(join_checked(runs, digits.select("digit"), ["digit"], rows=4 * BROADCAST_ROWS))  # a row is one number
    contents = stage(live.groupBy("digit", "content").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("key", "start", "n", "place")).alias("one"), F.max("again").alias("again")))
    groups = stage(contents.groupBy("digit").agg(F.count(F.lit(1)).alias("contents"), F.max("again").alias("again")).where("contents > 1 OR again").select("digit", F.col("again").alias("flat")))
    same = contents.where("weight > 1").select("digit", "content")
    spans = live.join(same, ["digit", "content"]).select("key", "start", "n")

    chosen = stage(join_checked(contents.drop("again"), groups, ["digit"]).select("digit", "content", "weight", "flat", "one.*"))
    wanted = stage(chosen.groupBy("key").agg(F.collect_list(F.struct("digit", "content", "weight", "flat", "start", "n", "place")).alias("runs")))
    source = docs.select(row_key(id_col, text_col).alias("key"), text_bytes(text_col).alias("text"))
    n_chosen = chosen.count()
    held = join_checked(source, wanted, ["key"], counted=n_chosen).select("text", F.explode("runs").alias("r")).select("r.*", "text")
    texts = stage(held.select("digit", "content", "weight", "flat", "n", (F.col("place") - F.col("start")).alias("place"), F.substring("text", F.col("start") + 1, F.col("n") + width - 1).alias("text")))

    if texts.count() != n_chosen:  # rows that repeat id and text
        texts = stage(texts.dropDuplicates(["digit", "content"]))

    # third digit: what all windows of a block share, and the whole of it
    blocks = stage(_blocks(texts.where("NOT flat"), width))
    wholes = stage(blocks.groupBy("digit", "at", "inner", "whole").agg(F.sum("weight").alias("weight"), F.min(F.struct("content", "first", "n")).alias("one")))
    inners = wholes.groupBy("digit", "at", "inner").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("digit", "at", "inner")
    open_blocks = wholes.join(inners, ["digit", "at", "inner"])
    sure = blocks.where("weight = 1").join(wholes.where("weight > 1").select("digit", "at", "inner", "whole"), ["digit", "at", "inner", "whole"]).select("digit", "content", "first", "n")

    # last digit: the windows themselves; where the least string stands twice in a run, a window's place relative to it says nothing
    look = open_blocks.select("digit", F.col("one.content").alias("content"), "weight", F.col("one.first").alias("first"), F.col("one.n").alias("n"))
    some = texts.select("digit", "content", "place", "text").join(look, ["digit", "content"])
    every = texts.where("flat").select("digit", "content", F.lit(None).cast("int").alias("place"), "text", "weight", F.lit(0).alias("first"), "n")
    windows = stage(_windows(some.unionByName(every), width))
    counted = windows.where("at != 1 OR hash != 0")
    again = counted.groupBy("digit", "at", "hash").agg(F.sum("weight").alias("all")).where("all > 1")
    found = counted.where("weight = 1").join(again, ["digit", "at", "hash"]).select("digit", "content", "first", "n")
    found = found.unionByName(windows.where("at = 1 AND hash = 0").select("digit", "content", "first", "n"))

    # the windows found stand in runs whose content occurs once; blocks found are placed in every run that has them
    once = chosen.where("weight = 1").select("digit", "content", "key", "start")
    parts = found.unionByName(sure).join(once, ["digit", "content"]).select("key", (F.col("start") + F.col("first")).alias("start"), "n")
    return spans.unionByName(parts)


def remove_spans(text: bytes, starts: list[int] | None, counts: list[int] | None, width: int) -> tuple[bytes, int]:
    """The text without the windows, and the number of stretches that went."""
    kept, at, gone, end = [], 0, 0, -1
    for a, n in sorted(zip(starts or (), counts or (), strict=True)):
        b = a + n - 1 + width
        if a > end:
            gone += 1
            kept.append(text[at:a])
        at = end = max(end, b)
    kept.append(text[at:])
    return b"".join(kept), gone


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_text (bytes), kept_sha256.

    Removes each byte that a string of ``width`` bytes covers which also starts anywhere else, in the same document or another; strings are
    judged on the input. Null text is empty; texts shorter than ``width`` stay whole; rows that repeat are copies of each other; an empty
    table gives no rows; other columns are ignored.
    """
    spans = stage(repeated_spans(docs, id_col, text_col, width, gram))
    lists = stage(spans.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("s")).select("key", F.col("s.start").alias("starts"), F.col("s.n").alias("counts")))
    source = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("key"), text_bytes(text_col).alias("_text"))
    joined = join_checked(source, lists, ["key"], "left", counted=spans.count())
    schema = StructType([field(source, "_id"), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept_text", BinaryType()), StructField("kept_sha256", StringType())])

    def one(text: bytes, starts: list | None, counts: list | None) -> tuple:
        kept, gone = remove_spans(text, starts, counts, width)
        return len(text), len(text) - len(kept), gone, kept, hashlib.sha256(kept).hexdigest()

    return per_row(joined.select("_id", "_text", "starts", "counts"), schema, 1, lambda: one).withColumnRenamed("_id", id_col)
