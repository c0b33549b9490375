"""Deduplicate, extract, unpivot, split, coerce, find and replace."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework import scale
from tablework.functions import columns as C
from tablework.functions.names import require_columns, unique_headers


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _key_columns(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    return {f"__k{i}": C.normalize_key(_quoted(k), "trim", df.schema[k].dataType) for i, k in enumerate(keys)}


def dedupe(df: DataFrame, keys: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """First row per key in order; keys compare as trimmed text, blank keys included."""
    keys = list(keys or df.columns)
    require_columns(df.columns, keys)
    names = df.columns
    df, order = scale.with_ordinal(df, order_by)
    made = _key_columns(df, keys)
    return scale.first_per_group(df.withColumns(made), list(made), order).select(*[_quoted(n) for n in names])


def dedupe_counts(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows in, kept and dropped."""
    keys = list(keys or df.columns)
    made = _key_columns(df, keys)
    per_key = df.select(*[c.alias(n) for n, c in made.items()]).groupBy(*made).agg(F.count(F.lit(1)).alias("n"))
    out = per_key.agg(F.sum("n").alias("source_rows"), F.count(F.lit(1)).alias("kept"))
    return out.withColumn("dropped", F.col("source_rows") - F.col("kept"))


def drop_blank_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    tests = [C.is_blank(_quoted(c)) for c in (columns or df.columns)]
    return df.filter(~reduce(lambda a, b: a & b, tests))


def extract_columns(df: DataFrame, columns: Sequence[str], case: str = "title", unique: bool = False) -> DataFrame:
    """Normalised text of the chosen columns without blank rows, optionally distinct."""
    require_columns(df.columns, columns)
    heads = unique_headers(columns)
    out = df.select(*[C.normalize_text(_quoted(c), case).alias(h) for c, h in zip(columns, heads)])
    out = out.filter(F.concat(*[_quoted(h) for h in heads]) != "")
    return out.distinct() if unique else out


def extract_counts(df: DataFrame, columns: Sequence[str], case: str = "title") -> DataFrame:
    """Source rows, blank rows dropped and repeats a unique extract would drop."""
    heads = unique_headers(columns)
    cells = df.select(*[C.normalize_text(_quoted(c), case).alias(h) for c, h in zip(columns, heads)])
    per = cells.groupBy(*[_quoted(h) for h in heads]).agg(F.count(F.lit(1)).alias("__n"))
    blank = F.concat(*[_quoted(h) for h in heads]) == ""
    return per.agg(
        F.sum("__n").alias("source_rows"),
        F.coalesce(F.sum(F.when(blank, F.col("__n"))), F.lit(0)).alias("blank_dropped"),
        F.coalesce(F.sum(F.when(~blank, F.col("__n") - 1)), F.lit(0)).alias("unique_dropped"),
    )


def unpivot(df: DataFrame, ids: Sequence[str] | None = None, values: Sequence[str] | None = None, attr: str = "属性", val: str = "值") -> DataFrame:
    """Wide to long; NULL cells stay.  Columns of different types become text."""
    ids = list(ids or df.columns[:1])
    values = list(values or [c for c in df.columns if c not in ids])
    require_columns(df.columns, [*ids, *values])
    types = [df.schema[v].dataType for v in values]
    if any(not isinstance(t, T.NumericType) for t in types) and len({t.simpleString() for t in types}) > 1:
        df = df.withColumns({v: C.cell_text(_quoted(v), t) for v, t in zip(values, types)})
    return df.unpivot([_quoted(i) for i in ids], [_quoted(v) for v in values], attr, val)


def split_column(df: DataFrame, column: str, sep: str = ",", max_parts: int | None = None) -> DataFrame:
    """Split at a literal separator into ``column_1 ..``; the source column goes away."""
    require_columns(df.columns, [column])
    sep = sep or ","
    parts = F.split(C.normalize_key(_quoted(column), "trim", df.schema[column].dataType), "\\Q" + sep + "\\E", -1)
    if not max_parts or max_parts <= 0:
        max_parts = max(1, df.agg(F.max(F.size(parts))).first()[0] or 1)
    made = {f"{column}_{i + 1}": F.coalesce(C.trim_ws(F.get(parts, F.lit(i))), F.lit("")) for i in range(max_parts)}
    rest = [c for c in df.columns if c != column]
    return df.select(*[_quoted(c) for c in rest], *[c.alias(n) for n, c in made.items()])


def coerced(c: Column, dtype: T.DataType, to: str) -> Column:
    if to == "number":
        return C.to_number(c, dtype)
    if to == "date":
        return C.to_date(c, dtype)
    if to == "text":
        return C.to_text(c, dtype)
    raise ValueError("type must be number, text or date")


def coerce(df: DataFrame, column: str, to: str = "number") -> DataFrame:
    require_columns(df.columns, [column])
    return df.withColumn(column, coerced(_quoted(column), df.schema[column].dataType, to))


def coerce_counts(df: DataFrame, column: str, to: str = "number") -> DataFrame:
    """How many cells a coercion converts, blanks or leaves."""
    dtype, c = df.schema[column].dataType, _quoted(column)
    kind = C.date_kind(c, dtype) if to == "date" else F.lit("same") if to == "text" else C.number_kind(c, dtype)
    kinds = ("same", "converted", "blanked")
    return df.select(kind.alias("k")).agg(*[F.count_if(F.col("k") == k).alias(k) for k in kinds])


def coerce_columns(df: DataFrame, kinds: dict[str, str] | None = None, sample: int | None = None) -> DataFrame:
    """Apply one semantic kind per column (inferred from all rows, or from ``sample`` rows if given)."""
    if kinds is None:
        from tablework.operators.infer import infer_kinds

        kinds = {r["column"]: r["kind"] for r in infer_kinds(df, sample).collect()}
    require_columns(df.columns, list(kinds))

    def one(name: str) -> Column:
        dtype, c, kind = df.schema[name].dataType, _quoted(name), kinds.get(name)
        if kind is None:
            return c
        if kind == "id_text":
            return C.to_id_text(c, dtype)
        if kind == "datetime":
            return C.to_date(c, dtype)
        if kind in ("number", "amount"):
            return C.to_number(c, dtype, currency=True)
        if kind == "percent" and isinstance(dtype, T.NumericType):
            return c
        return C.to_text(c, dtype)

    return df.select(*[one(c).alias(c) for c in df.columns])


def _replaced(c: Column, find: str, replace: str, match_case: bool, whole: bool) -> Column:
    if whole:
        same = c == find if match_case else F.lower(c) == find.lower()
        return F.when(same, F.lit(replace)).otherwise(c)
    if match_case:
        return F.replace(c, F.lit(find), F.lit(replace))
    return F.regexp_replace(c, "(?iu)\\Q" + find + "\\E", re.sub(r"([\\$])", r"\\\1", replace))


def find_replace(df: DataFrame, find: str, replace: str, columns: Sequence[str] | None = None, match_case: bool = False, whole: bool = False) -> DataFrame:
    """Literal find and replace in the text columns."""
    if find == "":
        raise ValueError("find must not be empty")
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    require_columns(df.columns, columns)
    return df.withColumns({c: _replaced(_quoted(c), find, replace, match_case, whole) for c in columns})


def replace_counts(df: DataFrame, find: str, replace: str, columns: Sequence[str] | None = None, match_case: bool = False, whole: bool = False) -> DataFrame:
    """One row: number of cells a replacement changes."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    changed = [F.count_if(_replaced(_quoted(c), find, replace, match_case, whole) != _quoted(c)) for c in columns]
    return df.agg(reduce(lambda a, b: a + b, changed).alias("replaced"))


def attach_master_rows(df: DataFrame, is_master: Column, columns: Sequence[str], order_by: Sequence[str], source: Sequence[str] = ()) -> DataFrame:
    """Give every detail row the fields of the master row above it; master rows stay."""
    group = list(source)
    if not group:
        # One flat sheet: ordered as a whole, which the chunked fill can still split.
        df, group = df.withColumn("__all", F.lit(1)), ["__all"]
    values = {f"master_{c}": F.when(is_master, F.struct(_quoted(c).alias("v"))) for c in columns}
    out = scale.fill_down(df, group, order_by, values)
    return out.withColumns({n: F.col(n)["v"] for n in values}).drop("__all")
