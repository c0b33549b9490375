"""Building blocks that keep operators safe when one key holds a large part of all rows.

Spark already spreads ordinary aggregates (they combine before the shuffle) and top-k filters over
``row_number`` (the limit is applied before the shuffle).  What it does not spread is a window over
one huge group.  The helpers here split such groups by order-preserving chunks:

* ``hot_buckets`` counts rows per hash bucket of the key.  Buckets with more than ``hotMinRows``
  rows, what one task should hold whatever the size of the input, come back: at most ``BUCKETS``
  numbers.  The job reads the key columns only and sends at most ``BUCKETS`` counts per task.
* rows of a hot bucket get a chunk number that never decreases along the requested order, with as
  many chunks as its rows need.  Chunk borders come from a hash-selected sample of the order
  values, which is the same set on every evaluation.
* ranks, previous values and fills are computed inside (group, chunk) and completed with a small
  per-chunk table (counts, last values).

Inputs whose estimated size is below ``spark.tablework.splitBytes`` skip all of this: there a group
cannot outgrow a task that spills.  Without a hot bucket the plan is the plain window as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.session import checkpointed

BUCKETS = 65536
MAX_CHUNKS = 65536
SAMPLES = 16

_DEFAULTS = {
    "spark.tablework.splitBytes": str(1 << 30),
    "spark.tablework.broadcastBytes": str(64 << 20),
    "spark.tablework.hotMinRows": "4000000",
    "spark.tablework.walkRows": "500000",
    "spark.tablework.taskBytes": str(4 << 20),
}
MAX_PARTITIONS = 20000


def setting(df: DataFrame, name: str) -> float:
    key = "spark.tablework." + name
    return float(df.sparkSession.conf.get(key, _DEFAULTS[key]))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (no job is run)."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def source_bytes(df: DataFrame) -> int | None:
    """Size of the files that a plan reads, each as often as it is read; None where Spark knows no size (no job is run).

    Unlike ``estimated_bytes`` it does not multiply the sides of a join."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if all(n < 1 << 60 for n in sizes) else None


def task_count(df: DataFrame) -> int | None:
    """Partitions in which a shuffle gives every task the same share however large the input is; None where the cores are enough."""
    n = min(MAX_PARTITIONS, math.ceil((source_bytes(df) or 0) / setting(df, "taskBytes")))
    return n if n > df.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, n: int | None, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by key to ``n`` partitions; as Spark sees fit without a number."""
    return df if n is None else df.repartition(n, *keys)


def is_large(df: DataFrame) -> bool:
    return estimated_bytes(df) > setting(df, "splitBytes")


def fits_broadcast(df: DataFrame) -> bool:
    return estimated_bytes(df) <= setting(df, "broadcastBytes")


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast hint only when the estimated size is below the limit; otherwise Spark decides."""
    return F.broadcast(df) if fits_broadcast(df) else df


def with_ordinal(df: DataFrame, order_by: Sequence[str] | None, name: str = "__ord") -> tuple[DataFrame, list[str]]:
    """Input order: the given columns, or an ordinal added right after the scan."""
    if order_by:
        return df, list(order_by)
    return df.withColumn(name, F.monotonically_increasing_id()), [name]


def first_per_group(df: DataFrame, keys: Sequence[str | Column], order_by: Sequence[Column | str], k: int = 1) -> DataFrame:
    """First ``k`` rows per group.  The filter on the rank is pushed below the shuffle as a window
    group limit, so every map task sends at most ``k`` rows of a hot group."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def bucket_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(BUCKETS)).cast("int") if keys else F.lit(0)


def hot_buckets(df: DataFrame, keys: Sequence[str]) -> dict[int, int]:
    """Row counts of the hash buckets with more rows than a task should hold ({} when the input is small)."""
    if not is_large(df):
        return {}
    counts = df.groupBy(bucket_of(keys).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return {r["b"]: r["n"] for r in counts.filter(F.col("n") >= F.lit(setting(df, "hotMinRows"))).collect()}


def split_by_heat(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None, dict[int, int]]:
    """(cold rows, hot rows or None, hot buckets)."""
    hot = hot_buckets(df, keys)
    if not hot:
        return df, None, hot
    inside = bucket_of(keys).isin(*hot)
    return df.filter(~inside), df.filter(inside), hot


def with_chunk(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], hot: dict[int, int]) -> DataFrame:
    """Add ``__chunk`` along ``order_by`` to the rows of hot buckets; a chunk holds about half of ``hotMinRows`` rows."""
    half = max(1.0, setting(df, "hotMinRows") / 2)
    chunks = {b: int(min(MAX_CHUNKS, max(2, -(-n // half)))) for b, n in hot.items()}
    sizes = df.sparkSession.createDataFrame([(b, c, max(1, hot[b] // (c * SAMPLES)), math.isqrt(c - 1) + 1) for b, c in chunks.items()], "__bucket int, __n int, __every long, __step int")
    tagged = df.withColumns({"__bucket": bucket_of(keys), "__o": F.struct(*[F.col(c) for c in order_by])})
    picked = (
        tagged.select("__bucket", "__o").join(F.broadcast(sizes), "__bucket")
        .filter(F.pmod(F.xxhash64("__o"), F.col("__every")) == 0)
        .groupBy("__bucket", "__n", "__step")
        .agg(F.sort_array(F.collect_set("__o")).alias("__s"))
    )
    at = lambda i: F.get(F.col("__s"), F.floor(i * F.size("__s") / F.col("__n")).cast("int"))
    borders = picked.select("__bucket", "__step", "__n", F.transform(F.sequence(F.lit(1), F.col("__n") - 1), at).alias("__borders"))
    strides = F.floor((F.col("__n") - 1) / F.col("__step")).cast("int")
    coarse = F.transform(F.sequence(F.lit(1), F.greatest(strides, F.lit(1))), lambda i: F.get(F.col("__borders"), i * F.col("__step") - 1))
    borders = borders.withColumn("__coarse", F.slice(coarse, F.lit(1), strides)).drop("__n")
    # One row for each hot bucket, with a border for each of its chunks; a row looks at two short stretches of them.
    joined = tagged.join(F.broadcast(borders), "__bucket", "left")
    joined = joined.withColumn("__c", F.size(F.filter("__coarse", lambda b: b <= F.col("__o"))))
    part = F.slice("__borders", F.col("__c") * F.col("__step") + 1, F.col("__step") - 1)
    fine = F.size(F.filter(part, lambda b: b <= F.col("__o")))
    chunk = F.when(F.col("__borders").isNull(), 0).otherwise(F.col("__c") * F.col("__step") + fine)
    return joined.withColumn("__chunk", chunk.cast("int")).drop("__bucket", "__o", "__borders", "__coarse", "__c", "__step")


def match_parts(left: DataFrame, right: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Left join on ``parts`` where NULL equals NULL."""
    renamed = right.withColumnsRenamed({p: f"__r_{i}" for i, p in enumerate(parts)})
    cond = F.lit(True)
    for i, p in enumerate(parts):
        cond = cond & left[p].eqNullSafe(renamed[f"__r_{i}"])
    return left.join(renamed, cond, "left").drop(*[f"__r_{i}" for i in range(len(parts))])


def rank_in_group(df: DataFrame, group: Sequence[str], order_by: Sequence[str], out: str) -> DataFrame:
    """1-based position inside the group (plain window)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order_by)).cast("long"))


def rank_in_hot_group(df: DataFrame, group: Sequence[str], order_by: Sequence[str], out: str) -> DataFrame:
    """Same result as ``rank_in_group`` on rows that carry ``__chunk``, spread over many tasks."""
    parts = [*group, "__chunk"]
    counts = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("__cn"))
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.sum("__cn").over(before)).filter(F.col("__off") > 0).drop("__cn")
    local = F.row_number().over(Window.partitionBy(*parts).orderBy(*order_by)).cast("long")
    joined = match_parts(df.withColumn(out, local), offsets, parts)
    return joined.withColumn(out, F.col(out) + F.coalesce(F.col("__off"), F.lit(0))).drop("__off")


def rank(df: DataFrame, group: Sequence[str], order_by: Sequence[str], out: str) -> DataFrame:
    """Position inside the group, split where a group is hot; in a large table without groups by ranges of the order."""
    if not group and is_large(df):
        return running_sum(df.withColumn("__one", F.lit(1)), [], order_by, "__one", out).drop("__one")
    cold, warm, hot = split_by_heat(df, group)
    ranked = rank_in_group(dealt(cold, task_count(df) if group else None, group), group, order_by, out)
    if warm is None:
        return ranked
    chunked = with_chunk(warm, group, order_by, hot)
    return ranked.unionByName(rank_in_hot_group(chunked, group, order_by, out).drop("__chunk"))


def running_sum(df: DataFrame, group: Sequence[str], order_by: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to this one, as long.

    Without a group, rows are dealt by ranges of their order instead, so that no task gets all of them; their sums are completed per range."""
    total = lambda w: F.sum(value).over(w).cast("long")
    upto = lambda *parts: Window.partitionBy(*parts).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)

    def completed(rows: DataFrame) -> DataFrame:
        parts = [*group, "__chunk"]
        sums = rows.groupBy(*parts).agg(F.sum(value).alias("__cs"))
        before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.withColumn("__off", F.sum("__cs").over(before)).filter(F.col("__off") != 0).drop("__cs")
        joined = match_parts(rows.withColumn(out, total(upto(*parts))), offsets, parts)
        return joined.withColumn(out, F.col(out) + F.coalesce(F.col("__off"), F.lit(0)).cast("long")).drop("__off", "__chunk")

    if not group:
        return completed(checkpointed(df.repartitionByRange(*order_by).withColumn("__chunk", F.spark_partition_id())))
    cold, warm, hot = split_by_heat(df, group)
    plain = cold.withColumn(out, total(upto(*group)))
    return plain if warm is None else plain.unionByName(completed(with_chunk(warm, group, order_by, hot)))


def previous(df: DataFrame, group: Sequence[str], order_by: Sequence[str], value: Column, out: str) -> DataFrame:
    """``value`` of the previous row of the group in order (NULL on the first row).

    Hot groups: lag inside (group, chunk) plus the last value of the chunk before it."""
    cold, warm, hot = split_by_heat(df, group)
    plain = cold.withColumn(out, F.lag(value).over(Window.partitionBy(*group).orderBy(*order_by)))
    if warm is None:
        return plain
    chunked = with_chunk(warm.withColumn("__v", F.struct(value.alias("v"))), group, order_by, hot)
    parts = [*group, "__chunk"]
    last = chunked.groupBy(*parts).agg(F.max_by("__v", F.struct(*order_by)).alias("__last"))
    carry = last.withColumn("__carry", F.lag("__last").over(Window.partitionBy(*group).orderBy("__chunk")))
    carry = carry.filter("__carry is not null").drop("__last")
    inside = F.lag("__v").over(Window.partitionBy(*parts).orderBy(*order_by))
    joined = match_parts(chunked.withColumn("__in", inside), carry, parts)
    joined = joined.withColumn(out, F.coalesce("__in", "__carry")["v"])
    return plain.unionByName(joined.drop("__v", "__in", "__carry", "__chunk"))


def fill_down(df: DataFrame, group: Sequence[str], order_by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Last non-null value at or before the row, per output name."""
    cold, warm, hot = split_by_heat(df, group)
    w = Window.partitionBy(*group).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    plain = cold.withColumns({n: F.last(c, ignorenulls=True).over(w) for n, c in values.items()})
    if warm is None:
        return plain
    tmp = {n: f"__f_{i}" for i, n in enumerate(values)}
    chunked = with_chunk(warm.withColumns({tmp[n]: c for n, c in values.items()}), group, order_by, hot)
    parts = [*group, "__chunk"]
    last = chunked.groupBy(*parts).agg(
        *[F.max_by(t, F.when(F.col(t).isNotNull(), F.struct(*order_by))).alias(t) for t in tmp.values()]
    )
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*parts, *[F.last(t, ignorenulls=True).over(before).alias(t + "c") for t in tmp.values()])
    inside = Window.partitionBy(*parts).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    filled = chunked.withColumns({t: F.last(t, ignorenulls=True).over(inside) for t in tmp.values()})
    joined = match_parts(filled, carry, parts).withColumns({n: F.coalesce(t, t + "c") for n, t in tmp.items()})
    return plain.unionByName(joined.drop("__chunk", *tmp.values(), *[t + "c" for t in tmp.values()]))


def all_set(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``left`` to a right side that has one row per key (``how``: left or inner).

    A small right side is broadcast.  Otherwise the hot keys of the left side (a bounded number, so
    their right rows are a bounded number too) are joined by broadcast without moving a left row,
    rows without a key skip the join, and the rest goes through an ordinary shuffled join."""
    keys = list(keys)
    if fits_broadcast(right):
        return left.join(F.broadcast(right), keys, how)
    hot = hot_buckets(left, keys)
    if not hot:
        return left.join(right, keys, how)
    keyed = left.filter(all_set(keys))
    limit = min(hot.values())
    warm_keys = (
        keyed.filter(bucket_of(keys).isin(*hot)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") >= limit / 2).drop("__n")
    )
    few = F.broadcast(warm_keys)
    warm = keyed.join(few, keys, "left_semi").join(F.broadcast(right.join(few, keys, "left_semi")), keys, how)
    out = warm.unionByName(keyed.join(few, keys, "left_anti").join(right, keys, how))
    if how == "left":
        out = out.unionByName(left.filter(~all_set(keys)), allowMissingColumns=True)
    return out


def walk_groups(df: DataFrame, group: Sequence[str], order_by: Sequence[str], walk: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``walk(key, rows)`` for every group; ``rows`` are the other columns as tuples, in order.

    The groups of a task are streamed in key order: one sort per partition replaces one pandas call
    per group, and a task holds a single group at a time.  Only for inputs whose groups are bounded
    (counts per date, near values of one key)."""
    group = list(group)
    rest = [c for c in df.columns if c not in group]
    names = [c.strip().split()[0].strip("`") for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        rows: list[tuple] = []
        for pdf in frames:
            out: list[tuple] = []
            keys = zip(*[pdf[g].tolist() for g in group])
            for k, row in zip(keys, zip(*[pdf[c].tolist() for c in rest])):
                if k != key:
                    if rows:
                        out.extend(walk(key, rows))
                    key, rows = k, []
                rows.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        out = list(walk(key, rows)) if rows else []
        if out:
            yield pd.DataFrame(out, columns=names)

    ordered = df.select(*group, *rest).repartition(*group).sortWithinPartitions(*group, *order_by)
    return ordered.mapInPandas(run, schema)


def spread(df: DataFrame, grows: bool = False) -> DataFrame:
    """Use all cores for heavy work per row when the input is small enough to sit in a few splits, in shares that do not grow with the input.

    Large inputs have more splits than cores and are left alone, apart from rows that grow (``grows``) so much that a split would be too much for a task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(task_count(df) or cores) if grows or estimated_bytes(df) < cores * (64 << 20) else df
