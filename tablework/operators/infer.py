"""Column kinds from headers and cell patterns, and table profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions.columns import cell_text, collapse_ws
from tablework.functions.names import letter

# What headers and cells of each kind look like.
ID_HEADER = r"(?i)单号|编号|号码|面单|运单|order\s*id|waybill|tracking|快递|sku"
NOT_ID_HEADER = r"(?i)时间|日期|时区|timestamp|date"
DATE_HEADER = r"(?i)时间|日期|timestamp|date|utc|gmt|时区"
AMOUNT_HEADER = r"(?i)金额|amount|price|售价|成本|cost|fee|运费|单价"
PERCENT_HEADER = r"(?i)率|percent|ratio|占比"
NOT_PERCENT_HEADER = "效率|概率"
ID_CELL = r"^[A-Za-z]{1,4}\d{8,}$|^\d{11,}$|^(?=.*\d)[A-Za-z0-9-]{12,}$"
DATE_CELL = r"^\d{4}[-/]\d{1,2}[-/]\d|^\d{1,2}/\d{1,2}/\d{2,4}|GMT|UTC|[+-]\d{2}:\d{2}$"
NUMBER_CELL = r"^-?[\d,]+(\.\d+)?$"
LEADING_ZERO = r"^0\d"


def _cells(df: DataFrame, name: str) -> Column:
    text = collapse_ws(cell_text(F.col(f"`{name}`"), df.schema[name].dataType))
    return F.when(text != "", text)


def kind_rates(df: DataFrame, sample: int | None = None) -> DataFrame:
    """Share of non-empty cells per pattern, one row per column, in one pass.

    The whole table counts unless ``sample`` limits the rows looked at."""
    src = df.limit(sample) if sample else df
    tests = {
        "id_rate": lambda s: s.rlike(ID_CELL),
        "date_rate": lambda s: s.rlike(DATE_CELL),
        "numeric_rate": lambda s: F.translate(s, ",", "").rlike(NUMBER_CELL),
        "zero_rate": lambda s: s.rlike(LEADING_ZERO),
        "amount_rate": lambda s: F.regexp_replace(s, r"[¥$€,\s]", "").rlike(NUMBER_CELL),
    }
    cells = src.select(*[_cells(df, n).alias(f"c{i}") for i, n in enumerate(df.columns)])
    aggs = []
    for i, _ in enumerate(df.columns):
        c = F.col(f"c{i}")
        aggs.append(F.count(c).alias(f"n{i}"))
        aggs += [F.coalesce(F.avg(t(c).cast("double")), F.lit(0.0)).alias(f"{n}{i}") for n, t in tests.items()]
    wide = cells.agg(*aggs)
    entry = lambda i, n: F.struct(
        F.lit(i).alias("idx"),
        F.lit(letter(i)).alias("letter"),
        F.lit(n).alias("column"),
        F.col(f"n{i}").alias("filled"),
        *[F.col(f"{t}{i}").alias(t) for t in tests],
    )
    return wide.select(F.explode(F.array(*[entry(i, n) for i, n in enumerate(df.columns)])).alias("e")).select("e.*")


def infer_kinds(df: DataFrame, sample: int | None = None) -> DataFrame:
    """``kind_rates`` plus the kind: id_text, datetime, plain_text, amount, percent or number."""
    h = F.trim("column")
    id_head = (h != "") & ~h.rlike(NOT_ID_HEADER) & h.rlike(ID_HEADER)
    kind = (
        F.when(id_head | (F.col("id_rate") >= 0.5), "id_text")
        .when(F.col("date_rate") >= 0.4, "datetime")
        .when(h.rlike(DATE_HEADER) & (F.col("numeric_rate") == 0), "datetime")
        .when(F.col("zero_rate") > 0, "plain_text")
        .when(h.rlike(AMOUNT_HEADER), "amount")
        .when((F.col("amount_rate") >= 0.6) & (F.col("date_rate") < 0.2), "amount")
        .when(h.rlike(PERCENT_HEADER) & ~h.rlike(NOT_PERCENT_HEADER), "percent")
        .when(F.col("numeric_rate") >= 0.7, "number")
        .otherwise("plain_text")
    )
    return kind_rates(df, sample).withColumn("kind", kind)
