"""Equal-row matching when numbers may differ by a tolerance.

"Within t of each other" is not transitive, so among several rows of one key the order of the rows
decides.  Keys with at most one row per side (the bulk) are paired natively.  The others are cut
into parts whose values are too far apart to match (gaps wider than t in any compare column); parts
of identical rows are paired by rank, and only parts that mix different values run the ordered walk.
That walk sees row numbers and compare values, never the rows themselves, and no more than
``spark.tablework.walkRows`` rows of each side at a time: a part is cut into blocks of rows in order, and
left block i meets right block j once both (i - 1, j) and (i, j - 1) are done.  What is still open
after one meeting is handed to the next; meetings with the same i + j run together.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework import scale
from tablework.functions.columns import NUMBER_RE
from tablework.session import checkpointed


def match_within_tolerance(df: DataFrame, key: str, order: Sequence[str], rank, compare: Sequence[str], tolerance: float, equal: Column, pair, deal=None) -> DataFrame:
    """``deal`` is given where no key is hot and the rows of a key lie in one partition; it brings them there again."""
    group = [*dict.fromkeys(["__nk", key])]
    finished, open_rows = df.filter("__state is not null"), df.filter("__state is null")
    several = (
        open_rows.groupBy(*group)
        .agg(F.count_if(F.col("__side") == 0).alias("a"), F.count_if(F.col("__side") == 1).alias("b"))
        .filter("a > 0 and b > 0 and (a > 1 or b > 1)")
    )
    cols = df.columns
    if deal is not None:
        size = int(scale.setting(df, "walkRows"))
        most = several.agg(F.max(F.greatest("a", "b"))).first()[0] or 0
        if most <= size:
            return _together(df, group, key, order, rank, compare, tolerance, equal, deal, most).select(*cols)
    tagged = scale.join_unique(open_rows, several.select(*group, F.lit(True).alias("__many")), group)
    singles = pair(tagged.filter("__many is null").drop("__many"), group, order, rank, "conflict", key)
    agreed = (F.col("__state") == "conflict") & equal
    singles = singles.withColumn("__state", F.when(agreed, F.lit("matched")).otherwise(F.col("__state")))
    many = tagged.filter("__many").drop("__many")
    rest = _many(many, group, key, order, rank, compare, tolerance, pair)
    return finished.unionByName(singles.select(*cols)).unionByName(rest.select(*cols))


def _together(df, group, key, order, rank, compare, tolerance, equal, deal, most):
    """All rows in one stream: what the other way finds by joins comes from windows over the partition that holds the key, so rows move once,
    behind the walk. Keys hold at most ``walkRows`` rows of a side here."""
    columns = df.columns
    df = df.withColumn("__open", F.col("__state").isNull())
    group = [*group, "__open"]
    of_side = lambda side, parts: F.count_if(F.col("__side") == side).over(Window.partitionBy(*parts))
    single = (of_side(0, group) <= 1) & (of_side(1, group) <= 1)
    df = df.withColumn("__single", single)
    parts = []
    if most:
        cells = F.split(F.col("__sig"), "\x1f", -1)
        for i in range(len(compare)):
            df, name = _cut_here(df, group, F.get(cells, F.lit(i)), tolerance, i)
            parts.append(name)
    part = [*group, *parts]
    spread = Window.partitionBy(*part)
    kind = (
        F.when(~F.col("__open"), "done").when(F.col("__single"), "single")
        .when(F.min("__side").over(spread) == F.max("__side").over(spread), "alone")
        .when(F.min("__sig").over(spread) == F.max("__sig").over(spread), "same").otherwise("mixed")
    )
    # Single rows keep the whole key as their part: they pair whether or not their values agree.
    df = df.withColumn("__kind", kind).withColumns({p: F.when(~F.col("__single"), F.col(p)) for p in parts})
    df = rank(df, [*part, "__side"], order, "__pos")
    alone = -(F.col("__pos") * 2 + F.col("__side"))
    df = df.withColumn("__pair", F.when(F.col("__kind").isin("single", "same"), F.col("__pos")).otherwise(alone))
    if most:
        df = deal(_walk_here(df, part, tolerance))
    w = Window.partitionBy(*part, "__pair").orderBy("__side")
    df = df.withColumns({"__mate": F.lead("__r").over(w), "__paired": F.col("__open") & (F.count(F.lit(1)).over(Window.partitionBy(*part, "__pair")) == 2)})
    df = df.filter(~F.col("__paired") | (F.col("__side") == 0)).withColumn("__r", F.when(F.col("__paired"), F.col("__mate")).otherwise(F.col("__r")))
    matched = F.when((F.col("__kind") == "single") & ~F.coalesce(equal, F.lit(False)), "conflict").otherwise("matched")
    df = df.withColumns({"__state": F.when(F.col("__paired"), matched).otherwise(F.col("__state")), "__key": F.when(F.col("__paired"), F.col(key)).otherwise(F.col("__key"))})
    return df.select(*columns)


def _cut_here(df: DataFrame, group, cell: Column, tolerance: float, i: int) -> tuple[DataFrame, str]:
    """``_cut`` for rows whose key lies in one partition."""
    name, num, txt = f"__p{i}", f"__v{i}", f"__t{i}"
    df = df.withColumn(txt, cell).withColumn(num, F.when(F.col(txt).rlike(NUMBER_RE), F.col(txt).try_cast("double")))
    w = Window.partitionBy(*group).orderBy(num)
    df = df.withColumn("__prev", F.lag(num).over(w))
    first = F.when(F.col("__prev").isNull() | (F.col(num) - F.col("__prev") > tolerance), F.col(num))
    df = df.withColumn("__first", first).withColumn("__first", F.last("__first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    label = F.when(F.col(num).isNotNull(), F.concat(F.lit("n"), F.col("__first").cast("string"))).otherwise(F.concat(F.lit("t"), F.col(txt)))
    return df.withColumn(name, label).drop("__prev", "__first", num, txt), name


def _walk_here(df: DataFrame, part, tolerance: float) -> DataFrame:
    """``__pair`` of mixed parts, set by the walk; a part's rows pass by in order and are held until its last one has come."""
    schema = df.schema
    names = [*part, "__side", "__pos", "__sig", "__kind", "__pair"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            cells = {n: rows.column(n).to_pylist() for n in names}
            keys = list(zip(*[cells[p] for p in part]))
            pairs = cells["__pair"]
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    if cells["__kind"][at] == "mixed":
                        spots = {(cells["__side"][k], cells["__pos"][k]): k for k in range(at, i)}
                        found = sorted((p, s, cells["__sig"][k]) for (s, p), k in spots.items())
                        for a, b in greedy_tolerance([(s, p, sig) for p, s, sig in found], tolerance):
                            pairs[spots[0, a]] = pairs[spots[1, b]] = a
                    at = i
            place = rows.schema.get_field_index("__pair")
            yield from rows.set_column(place, rows.schema.field(place), pa.array(pairs, type=rows.schema.field(place).type)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows of the last part of a batch wait for the next batch, which may go on with it.
            last = [batch.column(batch.schema.get_field_index(p)) for p in part]
            tail = tuple(c[-1].as_py() for c in last)
            same = lambda k: tuple(c[k].as_py() for c in last) == tail
            cut = bisect_left(range(batch.num_rows), True, key=same)
            if cut or held and tuple(held[-1].column(held[-1].schema.get_field_index(p))[-1].as_py() for p in part) != tail:
                yield from finish(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from finish(pa.Table.from_batches(held))

    ordered = df.sortWithinPartitions(*part, "__side", "__pos")
    return ordered.mapInArrow(run, schema)


def _many(df, group, key, order, rank, compare, tolerance, pair):
    columns = df.columns
    cells = F.split(F.col("__sig"), "\x1f", -1)
    parts = []
    for i in range(len(compare)):
        df, name = _cut(df, group, F.get(cells, F.lit(i)), tolerance, i)
        parts.append(name)
    part = [*group, *parts]
    # Read by every branch below; holds the rows of keys with several rows only.
    df = checkpointed(df)
    kinds = (
        df.groupBy(*part)
        .agg(
            F.min("__side").alias("a"), F.max("__side").alias("b"), F.min("__sig").alias("s"), F.max("__sig").alias("t"),
            F.greatest(F.count_if(F.col("__side") == 0), F.count_if(F.col("__side") == 1)).alias("__size"),
        )
        .withColumn("__kind", F.when(F.col("a") == F.col("b"), "alone").when(F.col("s") == F.col("t"), "same").otherwise("mixed"))
        .drop("a", "b", "s", "t")
    )
    most = kinds.filter("__kind = 'mixed'").agg(F.max("__size")).first()[0] or 0
    df = scale.join_unique(df, kinds, part, "inner")
    alone = df.filter("__kind = 'alone'").select(*columns)
    same = pair(df.filter("__kind = 'same'").select(*columns, *parts), part, order, rank, "matched", key).select(*columns)
    mixed = rank(df.filter("__kind = 'mixed'").drop("__kind"), [*part, "__side"], order, "__pos")
    ids = _walk(mixed.select(*part, "__size", "__side", "__pos", "__sig"), part, tolerance, most)
    # The right row of a pair and the left row of it carry the left row's position.
    numbered = mixed.drop("__size").join(ids, [*part, "__side", "__pos"], "left")
    w = Window.partitionBy(*part, "__pair").orderBy("__side")
    paired = F.col("__pair").isNotNull()
    # Unpaired rows keep to their own position so that they do not gather in one window.
    numbered = numbered.withColumn("__free", ~paired).withColumn("__pair", F.coalesce("__pair", -(F.col("__pos") * 2 + F.col("__side"))))
    numbered = numbered.withColumn("__mate", F.lead("__r").over(w))
    numbered = numbered.filter(F.col("__free") | (F.col("__side") == 0))
    hit = ~F.col("__free")
    done = numbered.withColumns(
        {
            "__r": F.when(hit, F.col("__mate")).otherwise(F.col("__r")),
            "__state": F.when(hit, F.lit("matched")).otherwise(F.col("__state")),
            "__key": F.when(hit, F.col(key)).otherwise(F.col("__key")),
        }
    ).select(*columns)
    return alone.unionByName(same).unionByName(done)


def _cut(df: DataFrame, group, cell: Column, tolerance: float, i: int) -> tuple[DataFrame, str]:
    """Part name per row: first value of its run of near numbers, or the text itself."""
    name, num, txt = f"__p{i}", f"__v{i}", f"__t{i}"
    df = df.withColumn(txt, cell).withColumn(num, F.when(F.col(txt).rlike(NUMBER_RE), F.col(txt).try_cast("double")))
    values = df.filter(F.col(num).isNotNull()).select(*group, num).distinct()
    values = scale.previous(values, group, [num], F.col(num), "__prev")
    first = F.when(F.col("__prev").isNull() | (F.col(num) - F.col("__prev") > tolerance), F.col(num))
    values = scale.fill_down(values, group, [num], {"__first": first}).select(*group, num, "__first")
    df = scale.join_unique(df, values, [*group, num])
    label = F.when(F.col(num).isNotNull(), F.concat(F.lit("n"), F.col("__first").cast("string"))).otherwise(
        F.concat(F.lit("t"), F.col(txt))
    )
    return df.withColumn(name, label).drop("__first", num, txt), name


def _walk(rows: DataFrame, part, tolerance: float, most: int) -> DataFrame:
    """Pairs of all parts as ``(part, side, position, pair)``; no part has more than ``most`` rows on one side.

    An early left row takes a right row of an early block before one of a later block, and only left rows before it may
    take that one from it, so block by block gives the pairs of the walk over the whole part."""
    fields = ", ".join(f"`{p}` string" for p in part) + ", `__side` int, `__pos` long, `__pair` long"
    size = int(scale.setting(rows, "walkRows"))

    def walk(key: tuple, found: list[tuple]) -> list[tuple]:
        out = []
        for a, b in greedy_tolerance(found, tolerance):
            out += [(*key[:-1], 0, a, a), (*key[:-1], 1, b, a)]
        return out

    spot = [*part, "__side", "__pos"]
    rows = rows.withColumns({"__block": F.floor((F.col("__pos") - 1) / size), "__blocks": F.ceil(F.col("__size") / size)}).drop("__size")
    found, meetings = [], 2 * max(1, math.ceil(most / size)) - 1
    for n in range(meetings):
        facing = n - F.col("__block")
        meeting = F.when(F.col("__side") == 0, F.col("__block")).otherwise(facing).alias("__meeting")
        now = rows.filter((facing >= 0) & (facing < F.col("__blocks"))).select(*part, meeting, "__side", "__pos", "__sig")
        pairs = scale.walk_groups(now, [*part, "__meeting"], ["__pos"], walk, fields)
        if meetings > 1:
            pairs = checkpointed(pairs)
            # Done are pairs, and blocks that have met all others.
            rows = checkpointed(rows.filter(facing + 1 < F.col("__blocks")).join(pairs.select(*spot), spot, "left_anti"))
        found.append(pairs)
    return reduce(DataFrame.unionByName, found)


def _number(text: str) -> float | None:
    return float(text) if re.fullmatch(NUMBER_RE, text) else None


def greedy_tolerance(rows: list[tuple], tolerance: float) -> list[tuple[int, int]]:
    """Rows ``(side, position, cells)`` sorted by position.  Each left row, in order, takes the first free right row whose cells all agree.

    Right rows with the same cells form one queue, so a left row looks at the queues whose first
    cell lies inside the tolerance and takes the one with the earliest head."""
    parsed: dict[str, tuple] = {}

    def cells(sig: str) -> tuple:
        if sig not in parsed:
            texts = sig.split("\x1f")
            parsed[sig] = tuple((_number(t), t) for t in texts)
        return parsed[sig]

    def agree(a, b) -> bool:
        for (x, s), (y, t) in zip(a, b):
            if x is not None and y is not None:
                if abs(x - y) > tolerance:
                    return False
            elif s != t:
                return False
        return True

    queues: dict[str, list[int]] = {}
    for side, pos, sig in rows:
        if side == 1:
            queues.setdefault(sig, []).append(pos)
    heads = {s: 0 for s in queues}
    # Queues whose first cell is a number are looked up by value, the others by their text.
    numeric = sorted((cells(s)[0][0], s) for s in queues if cells(s)[0][0] is not None)
    axis = [v for v, _ in numeric]
    by_text: dict[str, list[str]] = {}
    for s in queues:
        if cells(s)[0][0] is None:
            by_text.setdefault(cells(s)[0][1], []).append(s)
    memo: dict[str, list[str]] = {}

    def partners(sig: str) -> list[str]:
        if sig not in memo:
            first = cells(sig)[0]
            if first[0] is None:
                near = by_text.get(first[1], [])
            else:
                pad = tolerance * (1 + 1e-9) + abs(first[0]) * 1e-12
                lo, hi = bisect_left(axis, first[0] - pad), bisect_right(axis, first[0] + pad)
                near = [s for _, s in numeric[lo:hi]]
            memo[sig] = [s for s in near if agree(cells(sig), cells(s))]
        return memo[sig]

    pairs = []
    for side, pos, sig in rows:
        if side == 1:
            continue
        best = None
        for s in partners(sig):
            if heads[s] < len(queues[s]) and (best is None or queues[s][heads[s]] < queues[best][heads[best]]):
                best = s
        if best is not None:
            pairs.append((pos, queues[best][heads[best]]))
            heads[best] += 1
    return pairs
