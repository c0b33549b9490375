"""Lookups: first match by key, tier by breakpoint, tier and zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework import scale
from tablework.functions.columns import normalize_key
from tablework.functions.names import require_columns

#: Rows of a tile, an ordered run of one key's rows.
TILE = 256


def lookup(left: DataFrame, right: DataFrame, key: str | Sequence[str], bring: Sequence[str] | None = None, order_by: Sequence[str] | None = None, case_sensitive: bool = False) -> DataFrame:
    """Every left row once, with columns of the first right row of the same key.

    Text keys match in any letter case unless ``case_sensitive``; a name clash gets ``_lookup``."""
    keys = [key] if isinstance(key, str) else list(key)
    bring = list(bring) if bring is not None else [c for c in right.columns if c not in left.columns]
    require_columns(left.columns, keys, "left table")
    require_columns(right.columns, [*keys, *bring], "right table")
    if not bring:
        raise ValueError("lookup needs columns to bring")

    def parts(df):
        same = {f"__k{i}": df.schema[k].dataType for i, k in enumerate(keys)}
        mode = "trim" if case_sensitive else "trim_lower"
        out = {}
        for (n, t), k in zip(same.items(), keys):
            text = normalize_key(F.col(f"`{k}`"), mode, t)
            out[n] = F.when(text != "", text)
        return out

    names = {c: (c + "_lookup" if c in left.columns else c) for c in bring}
    right, order = scale.with_ordinal(right, order_by)
    made = parts(right)
    first = scale.first_per_group(
        right.withColumns(made).filter(scale.all_set(list(made))), list(made), [F.col(o) for o in order]
    ).select(*made, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    joined = scale.join_unique(left.withColumns(parts(left)), first, list(made))
    return joined.select(*[F.col(f"`{c}`") for c in [*left.columns, *names.values()]])


def tier_lookup(df: DataFrame, tiers: DataFrame, value: str, tier: str, bring: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns of the largest tier at or below the value (per ``by``); none found gives NULL and
    ``tier_found`` = false.

    Tiers without a breakpoint or a ``by`` value fit nothing; of tiers with one breakpoint the one with the largest columns counts."""
    by = list(by)
    require_columns(df.columns, [value, *by], "table")
    require_columns(tiers.columns, [tier, *bring, *by], "tier table")
    keys = {f"__b{i}": F.col(f"`{b}`") for i, b in enumerate(by)}
    known = tiers.withColumn("__at", F.col(f"`{tier}`").cast("double")).dropna(subset=["__at", *by])
    best = known.groupBy(*[c.alias(k) for k, c in keys.items()], "__at").agg(F.max(F.struct(*[F.col(f"`{c}`") for c in bring])).alias("__best"))
    out = as_of(df.withColumns(keys), best, F.col(f"`{value}`").cast("double"), list(keys), "__t")
    return out.drop(*keys).withColumn("tier_found", F.col("__t").isNotNull()).withColumns({c: F.col("__t")["__best"][c] for c in bring}).drop("__t")


def as_of(left: DataFrame, right: DataFrame, at: Column, keys: Sequence[str], out: str) -> DataFrame:
    """Every left row with the right row (a struct) of the same ``keys`` and the largest ``__at`` that is not above ``at``; NULL where there is none.

    ``right`` has one row for each key and ``__at``. Its rows become tiles, ordered runs of at most TILE rows of a key. A left row finds its tile
    among the starts of its key's tiles, and its row inside of the tile, both by binary search. So left rows are never sorted, a right
    side that fits is broadcast and moves no left row, and a larger one is joined by key and tile, which spreads a hot key over its tiles."""
    keys = list(keys)
    ranked = scale.rank(right, keys, ["__at"], "__rk")
    entry = F.struct("__at", *[F.col(c) for c in right.columns if c not in (*keys, "__at")])
    tiles = ranked.groupBy(*keys, F.floor((F.col("__rk") - 1) / TILE).cast("int").alias("__tile")).agg(F.array_sort(F.collect_list(entry)).alias("__rows"))
    tiles = tiles.withColumn("__ats", F.transform("__rows", lambda r: r["__at"]))
    start = F.struct("__tile", F.get("__ats", F.lit(0)).alias("at"))
    starts = tiles.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(start)), lambda s: s["at"]).alias("__starts"))
    with_at = left.withColumn("__v", at)
    found = scale.join_unique(with_at, starts, keys) if keys else with_at.join(scale.small_side(starts), F.lit(True), "left")
    found = found.withColumn("__tile", last_at_or_below(F.col("__starts"), F.col("__v"))).drop("__starts")
    found = scale.join_unique(found, tiles, [*keys, "__tile"])
    return found.withColumn(out, F.get("__rows", last_at_or_below(F.col("__ats"), F.col("__v")))).drop("__v", "__tile", "__rows", "__ats")


def last_at_or_below(ordered: Column, value: Column) -> Column:
    """Place of the last element that is not above the value, by binary search; NULL where there is none."""
    bits = F.floor(F.log2(F.size(ordered))).cast("int")
    steps = F.transform(F.sequence(bits, F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    at = F.aggregate(steps, F.lit(-1), lambda i, step: F.when(F.get(ordered, i + step) <= value, i + step).otherwise(i))
    return F.when((F.size(ordered) > 0) & value.isNotNull() & (at >= 0), at)


def two_key_rate(df: DataFrame, rates: DataFrame, weight: str, zone: str, tier: str, price: str) -> DataFrame:
    """Price by weight tier inside the zone."""
    return tier_lookup(df, rates, weight, tier, [price], [zone])
