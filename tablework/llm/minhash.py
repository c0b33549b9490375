"""Circulant MinHash signatures, banding, and exact links between sets of word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tablework.llm.common import BROADCAST_ROWS, join_checked, map_arrow, stage
from tablework.llm.hashing import Rolling, mix, shingles, word_hashes

U64 = np.uint64
#: Places that the first permutation deals shingles to.
PLACES = 1 << 20
#: Shingles whose rows of the second permutation are held at once.
CHUNK = 1024
WORD_SEED = 11
#: A shingle that at most so many of the compared sets have is rare.
RARE = 8


class Circulant:
    """Signatures from two permutations: the first deals each shingle to a place, the second, shifted by one place for each coordinate,
    gives its value there. All values of a shingle stand next to each other, and a coordinate is the least value of a set."""

    def __init__(self, size: int, seed: int = 5) -> None:
        order = np.argsort(mix(np.arange(PLACES, dtype=U64) + U64(seed << 32)), kind="stable").astype(np.uint32)
        self.size, self.seed = size, U64(seed)
        self.rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:size]]), size)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes ^ self.seed) >> U64(44)).astype(np.int64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        least = self.rows[at[:CHUNK]].min(axis=0)
        for k in range(CHUNK, len(at), CHUNK):
            np.minimum(least, self.rows[at[k : k + CHUNK]].min(axis=0), out=least)
        return least


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of so many coordinates; along the last axis."""
    parts = signature.reshape(*signature.shape[:-1], -1, rows).astype(U64)
    key = np.broadcast_to(np.arange(1, parts.shape[-2] + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), parts.shape[:-1]).copy()
    for k in range(rows):
        key = mix(key ^ parts[..., k])
    return key.view(np.int64)


def set_id(hashes: np.ndarray) -> bytes:
    """16 bytes that name a set of sorted hashes."""
    import hashlib

    return hashlib.md5(hashes.tobytes()).digest()


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) with ``shared`` and ``either``: sizes of the intersection and the union of the whole sets. ``texts``: id, text (bytes)."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    schema = StructType([StructField("a", BinaryType()), StructField("b", BinaryType()), StructField("shared", LongType()), StructField("either", LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        rolling = Rolling(WORD_SEED)
        known: dict[bytes, np.ndarray] = {}

        def of(name: bytes, text: bytes) -> np.ndarray:
            if name not in known:
                if len(known) >= 32:
                    known.clear()
                known[name] = shingles(word_hashes(rolling, text), width)
            return known[name]

        for batch in batches:
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            shared, either = [], []
            for x, y, s, t in zip(a, b, left, right, strict=True):
                one, other = of(y, t), of(x, s)
                n = len(np.intersect1d(one, other, assume_unique=True))
                shared.append(n)
                either.append(len(one) + len(other) - n)
            yield [batch.column(0), batch.column(1), shared, either]

    return map_arrow(both.select("a", "b", "left", "right"), schema, rows)


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every linked id; the root is the least id that can be reached.

    In every round each id points to its least smaller neighbour, pointers are followed to their ends, and the ends take the places of the ids
    in the edges, until no edge is left. An id is settled in one round only, so the rounds' pointers together name the root of each. A round
    takes two groupings; joins take no shuffle while the pointers are few."""

    def renamed(up: DataFrame, key: str, value: str) -> DataFrame:
        return up.select(F.col("id").alias(key), F.col("root").alias(value))

    def followed(up: DataFrame) -> DataFrame:
        while True:
            further = join_checked(up, renamed(up, "root", "next"), ["root"], "left")
            jumped = stage(further.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            up = jumped.select("id", "root")
            if not jumped.agg(F.max("moved")).first()[0]:
                return up

    def edges_of(a: Column, b: Column, df: DataFrame) -> DataFrame:
        return stage(df.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct())

    edges = edges_of(F.col("a"), F.col("b"), links)
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        up = followed(stage(edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")))
        rounds.append(up)
        ends = join_checked(join_checked(edges, renamed(up, "a", "a_root"), ["a"]), renamed(up, "b", "b_root"), ["b"], "left")
        edges = edges_of(F.col("a_root"), F.coalesce("b_root", "b"), ends)
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    found = rounds.pop()
    while rounds:
        last = join_checked(rounds.pop(), renamed(found, "root", "next"), ["root"], "left")
        found = stage(last.select("id", F.coalesce("next", "root").alias("root")).unionByName(found))
    return found.unionByName(found.select(F.col("root").alias("id"), "root").distinct())


def shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    """(id, h): the distinct shingles of texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        rolling = Rolling(WORD_SEED)
        for batch in batches:
            yield [batch.column(0), [shingles(word_hashes(rolling, t), width).view(np.int64) for t in batch.column(1).to_pylist()]]

    schema = StructType([StructField("id", BinaryType()), StructField("hashes", ArrayType(LongType()))])
    return map_arrow(texts.select("id", "text"), schema, rows).select("id", F.explode("hashes").alias("h"))


def link_sets(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], width: int, percent: int) -> DataFrame:
    """(id, root) of the classes linked with others: Jaccard similarity of the whole sets of at least ``percent``.

    ``classes`` is a written table of distinct sets: id, n, copies, bands. ``texts_of`` turns a table with ids into (id, text).

    1. In every band each set is compared with one of them only, the one with the most copies, so a band of m sets gives m - 1 comparisons.
    2. Bands whose sets then lie in one component are done. In the others, sets of different components still have to be compared, unless
       shingles that few sets have rule a link out: two sets share at most the rare shingles that both have and what the smaller rest allows.
       Pairs with a rare shingle in common are found by that shingle (RARE sets at most, so their number is linear); pairs without one by
       their bands, and then both sets must consist of common shingles so far that a link is possible.
    """
    rows = classes.where("n > 0").select("id", "n", "copies", F.explode("bands").alias("band"))
    often = stage(rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band"))
    shared = stage(join_checked(rows, often, ["band"], rows=4 * BROADCAST_ROWS))  # a row is one number
    first = shared.groupBy("band").agg(F.max(F.struct("copies", "id", "n")).alias("p"))
    members = stage(shared.join(first, "band").select("band", "id", "n", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n")))

    def possible(n: str, m: str, most: Column | None = None) -> Column:
        """Whether sets of these sizes, with at most so many shingles in common, can be linked."""
        most = F.least(n, m) if most is None else most
        return most * (100 + percent) >= percent * (F.col(n) + F.col(m))

    def compared(pairs: DataFrame) -> DataFrame:
        written = stage(pairs.distinct())
        needed = written.select(F.col("a").alias("id")).unionByName(written.select(F.col("b").alias("id"))).distinct()
        return stage(verified(written, stage(texts_of(needed)), width))

    is_link = 100 * F.col("shared") >= percent * F.col("either")
    stars = compared(members.where(F.col("id") != F.col("pivot")).where(possible("n", "pivot_n")).select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    found = stage(components(stars.where(is_link)))

    placed = join_checked(members, found, ["id"], "left").withColumn("root", F.coalesce("root", "id"))
    mixed = stage(placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi AND size > 2").select("band"))
    if mixed.isEmpty():
        return found
    known = stage(join_checked(placed, mixed, ["band"]).select("band", "id", "n", "root", "pivot"))
    sets = stage(known.groupBy("id").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.array_sort(F.collect_set("band")).alias("bands")))
    content = stage(shingle_rows(texts_of(sets.select("id")), width))
    rare = stage(content.join(content.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= RARE), "h").select("h", "id", "df"))
    sized = stage(sets.join(rare.groupBy("id").agg(F.count(F.lit(1)).alias("few")), "id", "left").withColumn("common", F.col("n") - F.coalesce("few", F.lit(0))).drop("few"))

    holders = rare.where("df > 1").groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    couples = holders.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    ends = [sized.select(*(F.col(c).alias(f"{side}_{c}" if c != "id" else side) for c in ("id", "n", "root", "common"))) for side in ("a", "b")]
    by_rare = join_checked(join_checked(couples, ends[0], ["a"]), ends[1], ["b"]).where("a_root != b_root").where(possible("a_n", "b_n", F.col("both") + F.least("a_common", "b_common"))).select("a", "b")

    # sets outside of the component of the band's pivot, with every set of the band; each pair in the first band that it shares
    able = sized.where(100 * F.col("common") >= percent * F.col("n")).select("id", "common", "bands")
    mains = found.select(F.col("id").alias("pivot"), F.col("root").alias("main"))
    full = stage(join_checked(join_checked(known, able, ["id"]), mains, ["pivot"], "left").withColumn("main", F.coalesce("main", "pivot")))
    x = full.where("root != main").select(*(F.col(c).alias(f"x_{c}" if c != "band" else c) for c in ("band", "id", "n", "root", "common", "bands")))
    y = full.select(*(F.col(c).alias(f"y_{c}" if c != "band" else c) for c in ("band", "id", "n", "root", "common", "bands", "main")))
    once = (F.col("y_root") == F.col("y_main")) | (F.col("x_id") < F.col("y_id"))
    fits = possible("x_n", "y_n", F.least("x_common", "y_common")) & (F.col("x_root") != F.col("y_root")) & once
    lowest = F.array_min(F.array_intersect("x_bands", "y_bands")) == x["band"]
    by_band = x.join(y, (x["band"] == y["band"]) & fits & lowest).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))

    rest = compared(by_rare.unionByName(by_band))
    more = rest.where(is_link)
    if more.isEmpty():
        return found
    # components of what is linked so far: the old roots take the place of the sets
    old = [found.select(F.col("id").alias(side), F.col("root").alias(f"{side}_root")) for side in ("a", "b")]
    ends = join_checked(join_checked(more, old[0], ["a"], "left"), old[1], ["b"], "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    merged = stage(components(ends)).select(F.col("id").alias("root"), F.col("root").alias("new"))
    single = merged.select(F.col("root").alias("id"), F.col("new").alias("root")).join(found.select("id"), "id", "left_anti")
    return join_checked(found, merged, ["root"], "left").select("id", F.coalesce("new", "root").alias("root")).unionByName(single)
