"""Nearest-date pairing of leftover rows.

The greedy rule (each left row, in order, takes the unused right row with the smallest day
difference) depends on rows only through their key and day.  So rows are first counted per
(group, key, day); the greedy walk runs on those counts, which per group are bounded by the number
of distinct dates, and is cut further at gaps wider than the window.  Its answer, ranges of ranks,
is joined back to the rows in fixed-size blocks.  No task ever holds the rows of a group.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework import scale

BLOCK = 65536
SEGMENTS = (
    "l_key string, l_day int, l_from long, l_count long, r_key string, r_day int, r_from long, diff int, tie boolean"
)


def attach_by_window(rest: DataFrame, order: Sequence[str], days: int) -> DataFrame:
    """``rest`` holds open rows with ``__side, __nk, __grp, __day``; returns ``__state`` = window for
    pairs (with ``__diff`` and ``__tie``) and NULL for rows that stay single."""
    n = scale.task_count(rest)
    ranked = scale.rank(rest, ["__nk", "__day", "__side"], order, "__rn")
    runs = rest.groupBy("__grp", "__nk", "__day", "__side").agg(F.count(F.lit(1)).alias("__n"))
    segments = _segments(_islands(runs, days), days)

    lo = F.floor((F.col("l_from") - 1) / BLOCK)
    hi = F.floor((F.col("l_from") + F.col("l_count") - 2) / BLOCK)
    blocks = segments.withColumn("__block", F.explode(F.sequence(lo, hi)))
    lefts = ranked.filter("__side = 0").withColumn("__block", F.floor((F.col("__rn") - 1) / BLOCK)).drop("__r")
    inside = F.col("__rn").between(F.col("l_from"), F.col("l_from") + F.col("l_count") - 1)
    same = (F.col("__nk") == F.col("l_key")) & (F.col("__day") == F.col("l_day"))
    lefts = scale.dealt(lefts, n, ["__nk", "__day", "__block"])
    hits = lefts.join(
        scale.dealt(blocks.withColumnRenamed("__block", "__b"), n, ["l_key", "l_day", "__b"]), same & (F.col("__block") == F.col("__b")) & inside, "left"
    ).select(
        F.col("__key").alias("l_out"),
        "__l",
        # Single rows get a key of their own that no right row has, so they spread evenly.
        F.coalesce("r_key", "__nk").alias("jk"),
        F.coalesce("r_day", "__day").alias("jd"),
        F.when(F.col("r_key").isNull(), -F.col("__rn"))
        .otherwise(F.col("r_from") + F.col("__rn") - F.col("l_from"))
        .alias("jr"),
        F.col("diff").alias("__diff"),
        F.col("tie").alias("__tie"),
    )
    rights = ranked.filter("__side = 1").select(
        F.col("__nk").alias("jk"), F.col("__day").alias("jd"), F.col("__rn").alias("jr"), "__r", F.col("__key").alias("r_out")
    )
    both = F.col("l_out").isNotNull() & F.col("r_out").isNotNull()
    near = ["jk", "jd", "jr"]
    return scale.dealt(hits, n, near).join(scale.dealt(rights, n, near), near, "full_outer").select(
        F.when(both, "window").alias("__state"),
        F.coalesce("l_out", "r_out").alias("__key"),
        F.when(F.col("l_out").isNull(), 1).otherwise(0).alias("__side"),
        "__l",
        "__r",
        "__diff",
        "__tie",
    )


def _islands(runs: DataFrame, days: int) -> DataFrame:
    """Cut each group where consecutive days are further apart than the window; keep islands that
    have both sides.  No pair can cross such a gap."""
    order = ["__day", "__side", "__nk"]
    runs = scale.previous(runs, ["__grp"], order, F.col("__day"), "__prev")
    start = F.when(F.col("__prev").isNull() | (F.col("__day") - F.col("__prev") > days), F.col("__day"))
    runs = scale.fill_down(runs, ["__grp"], order, {"__island": start})
    sides = runs.groupBy("__grp", "__island").agg(F.min("__side").alias("a"), F.max("__side").alias("b"))
    return runs.join(sides.filter("a < b").select("__grp", "__island"), ["__grp", "__island"], "left_semi")


def _segments(runs: DataFrame, days: int) -> DataFrame:
    def walk(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        return greedy_runs(rows, days)

    cols = ["__grp", "__island", "__nk", "__day", "__side", "__n"]
    return scale.walk_groups(runs.select(*cols), ["__grp", "__island"], ["__nk", "__day"], walk, SEGMENTS)


def greedy_runs(runs: list[tuple], days: int) -> Iterator[tuple]:
    """Walk left runs (sorted by key) in order; yield ranges of ranks paired with ranges of right ranks."""
    lefts = [(key, day, n) for key, day, side, n in runs if side == 0]
    rights = [(key, day, n) for key, day, side, n in runs if side == 1]
    r_key, r_day = [r[0] for r in rights], [r[1] for r in rights]
    left_over = [r[2] for r in rights]
    next_rank = [1] * len(r_key)
    axis = sorted(set(r_day))
    queue: dict[int, list[int]] = {d: [] for d in axis}
    for i in range(len(r_key) - 1, -1, -1):
        queue[r_day[i]].append(i)  # last element = first run of that day
    alive = {d: sum(left_over[i] for i in queue[d]) for d in axis}
    # Nearest day that still has rows: up[i] looks at axis[i] and later, down[i] at axis[i - 1] and earlier.
    up, down = list(range(len(axis) + 1)), list(range(len(axis) + 1))

    def find(parent: list[int], i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for key, day, count in lefts:
        done = 1
        at = bisect_left(axis, day)
        while count > 0:
            hi = find(up, at)
            lo = find(down, at)
            later = axis[hi] - day if hi < len(axis) else None
            earlier = day - axis[lo - 1] if lo > 0 else None
            near = min([d for d in (later, earlier) if d is not None], default=None)
            if near is None or near > days:
                break
            best = [axis[hi]] if later == near else []
            if earlier == near:
                best.append(axis[lo - 1])
            open_rows = sum(alive[d] for d in best)
            run = min(queue[d][-1] for d in best)
            take = min(count, left_over[run])
            ties = min(take, open_rows - 1)  # the last row on offer is no tie
            for size, tie in ((ties, True), (take - ties, False)):
                if size:
                    yield (key, day, done, size, r_key[run], r_day[run], next_rank[run], near, tie)
                    done += size
                    next_rank[run] += size
            left_over[run] -= take
            count -= take
            d = r_day[run]
            alive[d] -= take
            if left_over[run] == 0:
                queue[d].pop()
            if alive[d] == 0:
                i = bisect_left(axis, d)
                up[i] = i + 1
                down[i + 1] = i
