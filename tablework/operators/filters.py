"""Row selection, ordering, limits and flags."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.columns import is_blank
from tablework.functions.names import resolve_column

# Accepted operator spellings.
OPERATORS = {
    "gt": ("gt", ">", "greaterthan"),
    "gte": ("gte", ">=", "greaterthanorequal"),
    "lt": ("lt", "<", "lessthan"),
    "lte": ("lte", "<=", "lessthanorequal"),
    "eq": ("eq", "=", "equal", "equals"),
    "ne": ("ne", "<>", "!=", "notequal"),
    "contains": ("contains",),
    "notcontains": ("notcontains",),
    "begins": ("beginswith", "startswith", "begins"),
    "ends": ("endswith", "ends"),
    "blank": ("blank", "blanks", "empty", "isempty"),
    "nonblank": ("nonblank", "nonblanks", "notblank", "notempty"),
    "between": ("between",),
}
_SPELLING = {s: op for op, spellings in OPERATORS.items() for s in spellings}


def operator(name: str) -> str:
    key = re.sub(r"[\s_-]", "", str(name).strip().lower())
    if key not in _SPELLING:
        raise ValueError(f"unsupported operator {name!r}")
    return _SPELLING[key]


def _like(c: Column, op: str, value: str, wildcard: bool) -> Column:
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    value = str(value).lower()
    if wildcard:
        body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in value)
        shape = {"contains": f"(?s).*{body}.*", "begins": f"(?s){body}.*", "ends": f"(?s).*{body}"}[op]
        return text.rlike(f"^{shape}$")
    return {"contains": text.contains, "begins": text.startswith, "ends": text.endswith}[op](value)


def predicate(df: DataFrame, column: str | int, op: str, value=None, value2=None, wildcard: bool = False) -> Column:
    """One filter as a boolean column; bounds are cast to the column's type so they push down."""
    name = resolve_column(df.columns, column)
    dtype, c, op = df.schema[name].dataType, F.col(f"`{name}`"), operator(op)
    if op in ("blank", "nonblank"):
        blank = is_blank(c) if isinstance(dtype, T.StringType) else c.isNull()
        return blank if op == "blank" else ~blank
    if op in ("contains", "begins", "ends"):
        return _like(c, op, value, wildcard)
    if op == "notcontains":
        return ~_like(c, "contains", value, wildcard)
    cast = lambda v: F.lit(v).cast(dtype) if isinstance(v, str) else F.lit(v)
    if op == "between":
        return c.between(cast(value), cast(value2))
    v = cast(value)
    if op == "ne":
        return c.isNull() | (c != v)
    return {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v, "eq": c == v}[op]


def filter_rows(df: DataFrame, filters: Sequence[dict], wildcard: bool = False) -> DataFrame:
    """Keep rows that satisfy every filter ``{column, op, value, value2}``."""
    tests = [predicate(df, f["column"], f["op"], f.get("value"), f.get("value2"), wildcard) for f in filters]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def sort_rows(df: DataFrame, keys: Sequence[dict]) -> DataFrame:
    """Sort by ``{column, order}``; blanks last in both directions."""
    if not keys:
        raise ValueError("sort needs at least one key")
    cols = []
    for key in keys:
        c = F.col(f"`{resolve_column(df.columns, key['column'])}`")
        down = str(key.get("order", "ascending")).lower().startswith("desc")
        cols.append(c.desc_nulls_last() if down else c.asc_nulls_last())
    return df.orderBy(*cols)


def sample_head(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def top_n(df: DataFrame, column: str, n: int = 10, top: bool = True) -> DataFrame:
    """The n largest (or smallest) cells with ties.

    The n-th cell is found first, from at most n cells of every task; then rows are kept by comparison, so ties never meet in one task."""
    c = F.col(f"`{column}`")
    cells = df.select(c.alias("__c")).filter("__c is not null").orderBy(F.col("__c").desc() if top else F.col("__c")).limit(n)
    edge = cells.agg((F.min if top else F.max)("__c")).scalar()
    return df.filter(c >= edge if top else c <= edge)


def flag_rule(df: DataFrame, column: str, op: str = "gt", value=0, value2=None, out: str = "flag") -> DataFrame:
    return df.withColumn(out, F.coalesce(predicate(df, column, op, value, value2), F.lit(False)))


def scale_min_max(df: DataFrame, column: str, out: str = "position") -> DataFrame:
    """Position of the value between the column's minimum and maximum (0..1)."""
    ends = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    pos = F.try_divide((F.col(column) - ends["lo"]).cast("double"), (ends["hi"] - ends["lo"]).cast("double"))
    return df.withColumn(out, pos)
