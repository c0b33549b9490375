"""Sums, counts, weighted averages, pivots and distributions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework import scale
from tablework.functions.columns import normalize_key
from tablework.functions.names import aggregation, match_field, require_columns
from tablework.operators.filters import filter_rows, predicate



def sum_by(df: DataFrame, group: str, value: str, total: str = "合计", order_by: Sequence[str] | None = None, ignore_case: bool = False) -> DataFrame:
    """Total per trimmed, non-blank group; the label is the first raw value seen."""
    require_columns(df.columns, [group, value])
    df, order = scale.with_ordinal(df, order_by)
    key = normalize_key(F.col(f"`{group}`"), "trim_lower" if ignore_case else "trim", df.schema[group].dataType)
    out = df.withColumn("__g", key).filter("__g <> ''").groupBy("__g")
    label = F.min_by(F.col(f"`{group}`"), F.struct(*order)).alias(group)
    return out.agg(label, F.sum(F.col(f"`{value}`")).alias(total)).drop("__g")


def _criteria(df: DataFrame, criteria: Sequence[dict]) -> Column:
    tests = [predicate(df, c["column"], c["op"], c.get("value"), c.get("value2")) for c in criteria]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def sum_if(df: DataFrame, value: str, criteria: Sequence[dict], by: Sequence[str] = (), out: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(F.when(_criteria(df, criteria), F.col(value))).alias(out))


def count_if(df: DataFrame, criteria: Sequence[dict], by: Sequence[str] = (), out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(_criteria(df, criteria)).alias(out))


def weighted_avg(df: DataFrame, weight: str, value: str, by: Sequence[str] = (), floor: float | None = None, divide: bool = True, out: str = "weighted") -> DataFrame:
    """Sum of weight x value, divided by the sum of weights unless they already add up to 1."""
    total = F.sum(F.col(weight) * F.col(value))
    avg = F.try_divide(total, F.sum(weight)) if divide else total
    if floor is not None:
        avg = F.greatest(avg, F.lit(floor))
    return df.groupBy(*by).agg(avg.alias(out))


def pivot_table(
    df: DataFrame,
    rows: Sequence[str] = (),
    columns: Sequence[str] = (),
    values: Sequence[dict] = (),
    filters: Sequence[dict] = (),
    column_values: Sequence | None = None,
    totals: bool | str = False,
) -> DataFrame:
    """Row fields down, column values across.  ``values`` = ``{field, aggregation}``.

    Column values are told apart field by field, NULL from blank text too; values that read alike get numbered names.
    They are names of columns of the result, so all of them pass through the driver.

    With ``totals`` every prefix of the row fields gets a subtotal row (``__level`` counts the
    rolled-up fields) and every value a total over all columns. With ``totals="all"`` every set of row fields is rolled up
    (``__rolled``: one bit a row field, the first the highest, set where it is rolled up), and columns are totalled over every set of column fields,
    named ``total`` in the place of what is rolled up."""
    if totals not in (False, True, "all"):
        raise ValueError(f"totals: False, True or 'all', not {totals!r}")
    rows = [match_field(r, df.columns) for r in rows]
    columns = [match_field(c, df.columns) for c in columns]
    if not rows and not columns:
        raise ValueError("name at least one row or column field")
    if not values:
        raise ValueError("name at least one value field")
    if filters:
        df = filter_rows(df, filters)
    specs = [(match_field(v["field"], df.columns), aggregation(v.get("aggregation"))) for v in values]
    fields = [F.col(f"`{c}`").cast("string") for c in columns]
    if columns and column_values is None:
        found = {tuple(r) for r in df.select(*fields).distinct().collect()}
    else:
        found = {tuple(v) if isinstance(v, tuple | list) else (v,) for v in column_values or ()}
    wanted = sorted((tuple(None if x is None else str(x) for x in v) for v in found), key=lambda v: [(x is not None, x or "") for x in v])
    need = {*rows, *columns, *[f for f, _ in specs]}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c in need])
    every = object()  # stands for all values of a column field
    if totals == "all" and columns:
        some = {tuple(every if i in gone else x for i, x in enumerate(v)) for v in wanted for k in range(1, len(columns)) for gone in combinations(range(len(columns)), k)}
        wanted += sorted(some, key=lambda v: [(x is not every, x is not None, x if isinstance(x, str) else "") for x in v])
    aggs = []
    labels: list[str] = []
    for v in wanted:
        label, n = "_".join("total" if x is every else x or "" for x in v), 2
        while label in labels:
            label, n = f"{'_'.join('total' if x is every else x or '' for x in v)}_{n}", n + 1
        labels.append(label)
        at = reduce(lambda a, b: a & b, [f.eqNullSafe(F.lit(x)) for f, x in zip(fields, v, strict=True) if x is not every], F.lit(True))
        aggs += [getattr(F, a)(F.when(at, F.col(f"`{f}`"))).alias(f"{label}_{a}_{f}") for f, a in specs]
    if totals or not columns:
        prefix = "total_" if columns else ""
        aggs += [getattr(F, a)(F.col(f"`{f}`")).alias(f"{prefix}{a}_{f}") for f, a in specs]
    if totals and rows:
        rolled = [F.grouping(F.col(f"`{r}`")).cast("int") for r in rows]
        if totals == "all":
            return base.cube(*[F.col(f"`{r}`") for r in rows]).agg(*aggs, F.grouping_id().cast("int").alias("__rolled"))
        return base.rollup(*rows).agg(*aggs, reduce(lambda a, b: a + b, rolled).alias("__level"))
    return base.groupBy(*rows).agg(*aggs)


def price_distribution(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Count, minimum, quartiles (interpolated, exact) and maximum per group.

    Equal values are counted before the shuffle. A group's running counts tell between which of its values a quantile lies, so only those
    are gathered: values are sorted with spilling to disk, and those of a hot group, or of a table without groups, by many tasks."""
    asked = quantiles if quantiles is not None else {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    by = list(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    whole = counted.groupBy(*by).agg(F.sum("__n").alias("n"), F.min("__v").alias("min_value"), F.max("__v").alias("max_value"))
    upto = scale.running_sum(counted, by, ["__v"], "__n", "__upto")
    ends = whole.select(*by, F.col("n").alias("__all"))
    placed = upto.join(F.broadcast(ends) if not by else scale.small_side(ends), reduce(lambda a, b: a & b, [upto[b].eqNullSafe(ends[b]) for b in by], F.lit(True)))
    placed = placed.select(*[upto[b] for b in by], "__v", "__n", "__upto", "__all")

    def at(place: Column) -> Column:
        return F.min(F.when((F.col("__upto") > place) & (F.col("__upto") - F.col("__n") <= place), F.col("__v")).cast("double"))

    exact = {name: (F.col("__all") - 1) * F.lit(float(p)) for name, p in asked.items()}
    near = reduce(lambda a, b: a | b, [(F.col("__upto") > F.floor(x)) & (F.col("__upto") - F.col("__n") <= F.ceil(x)) for x in exact.values()], F.lit(False))
    found = placed.filter(near).groupBy(*by, "__all").agg(*[f(c).alias(f"__{side}_{name}") for name, x in exact.items() for side, f, c in (("lo", at, F.floor(x)), ("hi", at, F.ceil(x)))])
    cells = [(F.col(f"__lo_{n}") + (x - F.floor(x)) * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n) for n, x in exact.items()]
    found = found.select(*by, *cells)
    joined = whole.join(found, reduce(lambda a, b: a & b, [whole[b].eqNullSafe(found[b]) for b in by], F.lit(True)))
    return joined.select(*[whole[b] for b in by], "n", "min_value", *asked, "max_value")


def band_distribution(df: DataFrame, by: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Rows and share per value band; band i is [edges[i-1], edges[i])."""
    band = F.lit(0)
    for edge in edges:
        band = band + F.when(F.col(value) >= edge, 1).otherwise(0)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def concentration(df: DataFrame, by: Sequence[str], entity: str, value: str, k: int = 3) -> DataFrame:
    """Share of the k largest entities in the group total."""
    by = list(by)
    per = df.groupBy(*by, entity).agg(F.sum(value).alias("__v"))
    top = scale.first_per_group(per, by, [F.col("__v").desc(), F.col(entity)], k).groupBy(*by).agg(F.sum("__v").alias("top_value"))
    total = per.groupBy(*by).agg(F.sum("__v").alias("total_value"), F.count(F.lit(1)).alias("entities"))
    share = F.try_divide(F.col("top_value").cast("double"), F.col("total_value").cast("double"))
    return total.join(top, by).withColumn("top_share", share)


def top_k_per_group(df: DataFrame, by: Sequence[str], metric: str, k: int = 20, tie: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), *tie)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def organic_rank(df: DataFrame, by: Sequence[str], order_by: Sequence[str], is_ad: Column) -> DataFrame:
    """Drop advertisements and number the rest in page order."""
    return scale.rank(df.filter(~F.coalesce(is_ad, F.lit(False))), list(by), list(order_by), "organic_rank")
