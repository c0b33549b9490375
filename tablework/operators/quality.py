"""Table profiles, cell classes, error tokens, validation rules, key checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.columns import cell_text, is_blank, to_date, to_number, trim_ws
from tablework.functions.names import letter, require_columns
from tablework.operators.infer import infer_kinds

# Error texts a spreadsheet can hold, and the text form of an input number.
ERROR_TOKENS = (
    "#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!", "#GETTING_DATA", "#SPILL!", "#CALC!", "#FIELD!",
    "#BLOCKED!", "#CONNECT!", "#UNKNOWN!",
)
INPUT_CELL = r"^[-+]?\d+(\.\d+)?([eE][-+]?\d+)?$"
# Accepted rule and operator names.
RULE_TYPES = {
    "list": "list", "dropdown": "list", "drop": "list", "whole": "whole", "integer": "whole", "decimal": "decimal",
    "number": "decimal", "date": "date", "textlength": "textLength", "length": "textLength", "custom": "custom", "formula": "custom",
}
RULE_OPERATORS = {
    "between": "between", "notbetween": "notbetween", "equal": "eq", "equals": "eq", "eq": "eq", "notequal": "ne", "ne": "ne",
    "greaterthan": "gt", "gt": "gt", "greaterthanorequal": "gte", "gte": "gte", "lessthan": "lt", "lt": "lt",
    "lessthanorequal": "lte", "lte": "lte",
}


def is_error(c: Column) -> Column:
    """The cell starts with an error text, in any letter case."""
    return trim_ws(c.cast("string")).rlike("(?i)^(" + "|".join(re.escape(t) for t in ERROR_TOKENS) + ")")


def cell_class(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.when(c.isNull(), "empty").otherwise("input")
    s = trim_ws(c.cast("string"))
    return (
        F.when(s.isNull() | (s == ""), "empty").when(is_error(c), "error").when(s.rlike(INPUT_CELL), "input").otherwise("label")
    )


def classify_cells(df: DataFrame) -> DataFrame:
    """Empty, label, input and error cells per column, in one pass."""
    kinds = ("empty", "label", "input", "error")
    tagged = df.select(*[cell_class(F.col(f"`{n}`"), df.schema[n].dataType).alias(f"c{i}") for i, n in enumerate(df.columns)])
    wide = tagged.agg(*[F.count_if(F.col(f"c{i}") == k).alias(f"{k}{i}") for i in range(len(df.columns)) for k in kinds])
    entry = [F.struct(F.lit(n).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in kinds]) for i, n in enumerate(df.columns)]
    return wide.select(F.explode(F.array(*entry)).alias("e")).select("e.*")


def scan_error_tokens(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Position (key columns and column name) and text of every error cell."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keys]
    hits = F.array_compact(
        F.array(*[F.when(is_error(F.col(f"`{c}`")), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"))) for c in texts])
    )
    out = df.select(*keys, F.explode(hits).alias("e")).select(*keys, "e.column", "e.value")
    return out.limit(limit) if limit else out


def profile_tables(spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Name, row and column count and headers per table (catalog tables when none are given)."""
    if tables is None:
        tables = {t.name: spark.table(t.name) for t in spark.catalog.listTables()}
    if not tables:
        raise ValueError("no tables")
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("cols"), F.lit(",".join(df.columns)).alias("headers")
        )
        out = one if out is None else out.unionByName(one)
    return out


def profile_table(df: DataFrame, samples: int = 5, kind_rows: int | None = None) -> DataFrame:
    """Index, letter, header, kind and up to ``samples`` sample cells per column."""
    head = df.limit(samples)
    cells = head.agg(*[F.collect_list(cell_text(F.col(f"`{n}`"), df.schema[n].dataType)).alias(f"s{i}") for i, n in enumerate(df.columns)])
    entry = [F.struct(F.lit(i).alias("idx"), F.col(f"s{i}").alias("samples")) for i in range(len(df.columns))]
    sampled = cells.select(F.explode(F.array(*entry)).alias("e")).select("e.*")
    # Both sides have one row per column of the table.
    return infer_kinds(df, kind_rows).join(F.broadcast(sampled), "idx", "left").select("idx", "letter", "column", "kind", "samples")


def _name(raw: str, names: dict[str, str], what: str) -> str:
    key = re.sub(r"[\s_-]", "", str(raw).strip().lower())
    if key not in names:
        raise ValueError(f"unsupported {what} {raw!r}")
    return names[key]


def rule_test(df: DataFrame, rule: dict) -> Column:
    """True where the cell satisfies the rule."""
    require_columns(df.columns, [rule["column"]])
    c, dtype = F.col(f"`{rule['column']}`"), df.schema[rule["column"]].dataType
    kind = _name(rule["type"], RULE_TYPES, "rule type")
    if kind == "list":
        allowed = rule.get("source")
        allowed = [s.strip() for s in allowed.split(",")] if isinstance(allowed, str) else list(allowed or [])
        if not allowed:
            raise ValueError("a list rule needs source")
        ok = trim_ws(cell_text(c, dtype)).isin(*allowed)
    elif kind == "custom":
        if not rule.get("formula"):
            raise ValueError("a custom rule needs formula")
        ok = F.expr(rule["formula"])
    else:
        op = _name(rule.get("operator") or "between", RULE_OPERATORS, "operator")
        lo, hi = rule.get("formula1"), rule.get("formula2")
        if lo is None or (op in ("between", "notbetween") and hi is None):
            raise ValueError(f"{kind} rule needs its bounds")
        if kind == "date":
            v, cast = to_date(c, dtype), lambda x: F.lit(x).cast("date")
        elif kind == "textLength":
            v, cast = F.length(cell_text(c, dtype)), lambda x: F.lit(float(x))
        else:
            v, cast = to_number(c, dtype), lambda x: F.lit(float(x))
        lo = cast(lo)
        tests = {"eq": v == lo, "ne": v != lo, "gt": v > lo, "gte": v >= lo, "lt": v < lo, "lte": v <= lo}
        ok = tests[op] if op in tests else v.between(lo, cast(hi))
        ok = ~ok if op == "notbetween" else ok
        if kind == "whole":
            ok = ok & (v == F.floor(v))
    blank = is_blank(c) if isinstance(dtype, T.StringType) else c.isNull()
    return F.when(blank, F.lit(bool(rule.get("allow_blank", True)))).otherwise(F.coalesce(ok, F.lit(False)))


def validate(df: DataFrame, rules: Sequence[dict], keys: Sequence[str]) -> DataFrame:
    """One row per broken rule: key columns, rule number, column, cell text and message."""
    broken = [
        F.when(
            ~rule_test(df, r),
            F.struct(
                F.lit(i).alias("rule"),
                F.lit(r["column"]).alias("column"),
                cell_text(F.col(f"`{r['column']}`"), df.schema[r["column"]].dataType).alias("value"),
                F.lit(r.get("message") or "").alias("message"),
            ),
        )
        for i, r in enumerate(rules)
    ]
    found = F.filter(F.array(*broken), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(found).alias("v")).select(*keys, "v.rule", "v.column", "v.value", "v.message")


def required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows in which a required column is blank, per column."""
    require_columns(df.columns, required)
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(is_blank(F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(required)])
    entry = [F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(required)]
    return wide.select(F.explode(F.array(*entry)).alias("e")).select("e.*")


def primary_key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    require_columns(df.columns, keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
