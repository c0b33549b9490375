"""Row-level reconciliation of two tables.

Both sides are tagged, united and shuffled once by the (normalised) key.  Everything up to the
one-sided leftovers then happens in local sorts of that single partitioning: rank inside
``(key, compare signature)``, pair equal ranks, rank the leftovers inside the key, pair again.
Keys that hold a large share of the rows take the same steps with chunked ranks (see ``scale``),
so they are spread over many tasks.  Rows with a blank key never match and skip the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework import scale
from tablework.functions.columns import NUMBER_RE, key_of, normalize_key, to_date, trim_ws
from tablework.functions.names import require_columns
from tablework.operators.datewindow import attach_by_window
from tablework.operators.tolerance import match_within_tolerance
from tablework.session import checkpointed

MODES = ("exact", "normalize", "date_window")
REVIEW = "需复核"
STATUSES = ("matched", "conflict", "left_only", "right_only")


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str] | None = None,
    mode: str = "exact",
    key_normalize: str = "trim",
    window_days: int = 0,
    left_date: str | None = None,
    right_date: str | None = None,
    tolerance: float = 0.0,
    audit_columns: bool | None = None,
    order_by: Sequence[str] | None = None,
    right_order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Pair the rows of two tables; every input row appears in exactly one output row.

    Output: ``status, key, left_*, right_*, conflict_columns`` and, unless ``mode`` is exact,
    ``__match_mode, __match_score, __review``.  ``order_by`` fixes which of several equal rows is
    taken first (input order when absent)."""
    keys = list(keys)
    _check(left, right, keys, mode, window_days, left_date, right_date)
    if compare is None:
        compare = [c for c in left.columns if c in right.columns and c not in keys]
    require_columns(left.columns, compare, "left table")
    require_columns(right.columns, compare, "right table")
    tolerance = max(0.0, tolerance or 0.0)
    normal = key_normalize if mode != "exact" else "trim"

    rows, order = _tagged(left, right, keys, compare, normal, order_by, right_order_by or order_by)
    blank = F.translate("__k0", "\x1f", "") == ""
    pending = rows.filter(~blank)
    steps = _Stages(left, right, compare, tolerance, order, two_keys=normal != "trim")
    cold, warm, hot = scale.split_by_heat(pending, ["__nk"])
    n = scale.task_count(pending)
    deal = lambda df: df.repartition(n, "__nk") if n else df.repartition("__nk")
    paired = steps.run(deal(cold), scale.rank_in_group, deal)
    if warm is not None:
        chunked = scale.with_chunk(warm, ["__nk"], ["__k0", *order], hot)
        paired = paired.unionByName(steps.run(chunked, _rank_hot).drop("__chunk"))
    if mode == "date_window":
        paired = _window_stage(paired, left, right, keys, normal, left_date, right_date, window_days, order)
    audit = mode != "exact" if audit_columns is None else audit_columns
    loose = rows.filter(blank).withColumns({"__state": F.lit(None).cast("string"), "__key": F.lit("")})
    return _result(paired, loose, left, right, compare, tolerance, window_days, audit)


def _rank_hot(df, group, order, out):
    # The ranked frame is read twice (counts and rows), so its lineage is cut first.
    return scale.rank_in_hot_group(checkpointed(df), group, order, out)


def _check(left, right, keys, mode, window_days, left_date, right_date):
    require_columns(left.columns, keys, "left table")
    require_columns(right.columns, keys, "right table")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "date_window":
        if not window_days or window_days <= 0:
            raise ValueError("date_window needs window_days > 0")
        if not left_date or not right_date:
            raise ValueError("date_window needs left_date and right_date")
        require_columns(keys, [left_date, right_date], "keys")


def _tagged(left, right, keys, compare, normal, left_order, right_order):
    """Both tables as ``__side, __k0, __nk, __sig, order columns, __l, __r``."""
    frames, order = [], []
    for side, (df, by) in enumerate(((left, left_order), (right, right_order))):
        names = df.columns
        df, by = scale.with_ordinal(df, by)
        require_columns(df.columns, by, "order_by")
        order = [f"__o{i}" for i in range(len(by))]
        whole = F.struct(*[F.col(f"`{n}`") for n in names])
        frames.append(
            df.select(
                F.lit(side).alias("__side"),
                key_of(df, keys, "trim").alias("__k0"),
                key_of(df, keys, normal).alias("__nk"),
                key_of(df, list(compare), "trim").alias("__sig") if compare else F.lit("").alias("__sig"),
                *[F.col(f"`{b}`").alias(o) for b, o in zip(by, order)],
                (whole if side == 0 else F.lit(None).cast(_struct_of(left))).alias("__l"),
                (whole if side == 1 else F.lit(None).cast(_struct_of(right))).alias("__r"),
            )
        )
    return frames[0].unionByName(frames[1]), order


def _struct_of(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])


class _Stages:
    """Equal pairs, then positional conflicts; on the trimmed key and, if asked, the normalised one."""

    def __init__(self, left, right, compare, tolerance, order, two_keys):
        self.left, self.right, self.compare = left, right, compare
        self.tolerance, self.order, self.two_keys = tolerance, order, two_keys

    def run(self, df: DataFrame, rank, deal=None) -> DataFrame:
        """``deal``, where no key is hot: brings the rows of a key into one partition again."""
        df = df.withColumns({"__state": F.lit(None).cast("string"), "__key": F.col("__nk")})
        df = self._stage(df, "__k0", self.order, rank, deal)
        if self.two_keys:
            if deal and self.tolerance > 0:
                df = deal(checkpointed(df))  # the next stage counts its keys first
            df = self._stage(df, "__nk", ["__k0", *self.order], rank, deal)
        return df

    def _stage(self, df, key, order, rank, deal):
        if self.tolerance > 0:
            df = match_within_tolerance(df, key, order, rank, self.compare, self.tolerance, self._equal_all(), pair, deal)
        else:
            df = pair(df, ["__nk", key, "__sig"], order, rank, "matched", key)
        return pair(df, ["__nk", key], order, rank, "conflict", key)

    def _equal_all(self) -> Column:
        tests = [cells_equal(self.left, self.right, c, self.tolerance) for c in self.compare]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def pair(df: DataFrame, group: Sequence[str], order: Sequence[str], rank, state: str, key: str) -> DataFrame:
    """Join the n-th open left row of a group to its n-th open right row.

    The right row moves into ``__r`` of the left row and disappears; finished rows pass through."""
    group = [*dict.fromkeys(group)]
    df = df.withColumn("__done", F.col("__state").isNotNull())
    df = rank(df, [*group, "__done", "__side"], order, "__rn")
    w = Window.partitionBy(*group, "__done", "__rn").orderBy("__side")
    open_left = ~F.col("__done") & (F.col("__side") == 0)
    df = df.withColumns({"__mate": F.lead("__r").over(w), "__taken": F.lag("__side").over(w).isNotNull()})
    df = df.filter(F.col("__done") | ~F.col("__taken"))
    hit = open_left & F.col("__mate").isNotNull()
    return df.withColumns(
        {
            "__r": F.when(hit, F.col("__mate")).otherwise(F.col("__r")),
            "__state": F.when(hit, F.lit(state)).otherwise(F.col("__state")),
            "__key": F.when(hit, F.col(key)).otherwise(F.col("__key")),
        }
    ).drop("__mate", "__taken", "__done", "__rn")


def _numeric(c: Column, dtype: T.DataType) -> Column | None:
    """A cell as a finite number for tolerance tests, or NULL."""
    if isinstance(dtype, T.NumericType):
        v = c.cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    if isinstance(dtype, T.StringType):
        s = trim_ws(c)
        return F.when(s.rlike(NUMBER_RE), s.try_cast("double"))
    return F.lit(None).cast("double")


def cells_equal(left: DataFrame, right: DataFrame, name: str, tolerance: float) -> Column:
    lt, rt = left.schema[name].dataType, right.schema[name].dataType
    a, b = F.col("__l")[name], F.col("__r")[name]
    same = normalize_key(a, "trim", lt) == normalize_key(b, "trim", rt)
    if tolerance > 0:
        x, y = _numeric(a, lt), _numeric(b, rt)
        return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(same)
    return same


def _window_stage(paired, left, right, keys, normal, left_date, right_date, days, order):
    """Leftovers of the key stages, paired by nearest date inside the window."""
    # Read by the pairs found so far, the counts per date and the rows of the window stage.
    paired = checkpointed(paired)
    rest = paired.filter(F.col("__state").isNull())

    def group_text(side, df, date):
        parts = [normalize_key(F.col(side)[k], normal, df.schema[k].dataType) for k in keys if k != date]
        return F.concat_ws("\x1f", *parts) if parts else F.lit("")

    def day(side, df, date):
        return F.unix_date(to_date(F.col(side)[date], df.schema[date].dataType))

    is_left = F.col("__side") == 0
    rest = rest.withColumns(
        {
            "__grp": F.when(is_left, group_text("__l", left, left_date)).otherwise(group_text("__r", right, right_date)),
            "__day": F.when(is_left, day("__l", left, left_date)).otherwise(day("__r", right, right_date)),
        }
    )
    usable = F.col("__day").isNotNull() & (F.translate("__grp", "\x1f", "") != "")
    done = attach_by_window(rest.filter(usable), ["__k0", *order], days)
    keep = ["__state", "__key", "__side", "__l", "__r"]
    extra = {"__diff": F.lit(None).cast("int"), "__tie": F.lit(None).cast("boolean")}
    before = paired.filter(F.col("__state").isNotNull()).select(*keep)
    unusable = rest.filter(~usable).select(*keep)
    return before.unionByName(unusable).withColumns(extra).unionByName(done.select(*keep, *extra))


def _result(paired, loose, left, right, compare, tolerance, days, audit):
    cols = ["__state", "__key", "__side", "__l", "__r"]
    if "__diff" in paired.columns:
        loose = loose.select(*cols, F.lit(None).cast("int").alias("__diff"), F.lit(None).cast("boolean").alias("__tie"))
        cols = [*cols, "__diff", "__tie"]
    df = paired.select(*cols).unionByName(loose.select(*cols))
    differing = (
        F.array_join(
            F.array_compact(
                F.array(*[F.when(~cells_equal(left, right, c, tolerance), F.lit(c)) for c in compare])
            ),
            ",",
        )
        if compare
        else F.lit("")
    )
    both = F.col("__state").isNotNull()
    df = df.withColumn("conflict_columns", F.when(both & (F.col("__state") != "matched"), differing).otherwise(""))
    windowed = F.col("__state") == "window"
    conflict = F.col("__state") == "conflict"
    if days:
        conflict = conflict | (windowed & (F.col("__tie") | (F.col("conflict_columns") != "")))
    status = (
        F.when(~both & (F.col("__side") == 0), "left_only")
        .when(~both, "right_only")
        .when(conflict, "conflict")
        .otherwise("matched")
    )
    out = [
        status.alias("status"),
        F.col("__key").alias("key"),
        *[F.col("__l")[c].alias(f"left_{c}") for c in left.columns],
        *[F.col("__r")[c].alias(f"right_{c}") for c in right.columns],
        F.col("conflict_columns"),
    ]
    if audit:
        score = F.when(status == "matched", F.lit(1.0)).otherwise(0.0)
        label = F.when(status == "matched", F.lit("exact")).otherwise(status)
        review = status == "conflict"
        if days:
            near = windowed & (status == "matched")
            score = F.when(near, 1 - F.col("__diff") / F.lit(float(days + 1))).otherwise(score)
            label = F.when(near, "date_window").otherwise(label)
            review = review | F.coalesce(windowed, F.lit(False))
        out += [
            label.alias("__match_mode"),
            score.alias("__match_score"),
            F.when(review, REVIEW).otherwise("auto").alias("__review"),
        ]
    return df.select(*out)


def reconcile_counts(result: DataFrame) -> DataFrame:
    """One row: number of rows per status, total, pairs waiting for review and the match rate."""
    aggs = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    review = F.col("__review") == REVIEW if "__review" in result.columns else F.col("status") == "conflict"
    out = result.agg(*aggs, F.count(F.lit(1)).alias("total"), F.count_if(review).alias("review_pending"))
    return out.withColumn("match_rate", F.try_divide(F.col("matched").cast("double"), F.col("total").cast("double")))


def diff_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """What was added, removed, changed or kept between two states of one table."""
    out = reconcile(old, new, keys, compare, order_by=order_by)
    change = (
        F.when(F.col("status") == "matched", "unchanged")
        .when(F.col("status") == "conflict", "changed")
        .when(F.col("status") == "left_only", "removed")
        .otherwise("added")
    )
    renames = {f"left_{c}": f"old_{c}" for c in old.columns} | {f"right_{c}": f"new_{c}" for c in new.columns}
    out = out.withColumn("status", change).withColumnsRenamed(renames)
    return out.withColumnsRenamed({"status": "change", "conflict_columns": "changed_columns"})
