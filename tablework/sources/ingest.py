"""Pushed payloads ``(job_id, url, rows ARRAY<ARRAY<STRING>>)`` to grid rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tablework import scale
from tablework.functions.columns import trim_ws
from tablework.functions.urls import host_key, sheet_name_from_url

ROW_CAP = 500
#: The column that holds packed rows, and their type.
PACKED, GRID = "__packed_rows", ArrayType(ArrayType(StringType()))


def payload_status(rows: Column) -> Column:
    """``ok``, ``no_table`` (nothing pushed) or ``blank`` (no cell with text)."""
    filled = F.exists(rows, lambda r: F.exists(r, lambda c: F.coalesce(trim_ws(c), F.lit("")) != ""))
    return F.when(rows.isNull() | (F.size(rows) == 0), "no_table").when(F.coalesce(filled, F.lit(False)), "ok").otherwise("blank")


def summarize_payloads(payloads: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per payload: status, sheet name, rows kept and pushed, truncation, width, sample head."""
    kept = F.slice("rows", 1, cap) if cap else F.col("rows")
    shown = F.transform(F.slice(F.coalesce(F.get(F.col("rows"), F.lit(0)), F.array()), 1, 8), lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 24))
    given = F.btrim(F.col("sheet_name")) if "sheet_name" in payloads.columns else F.lit("")
    name = F.when(F.coalesce(given, F.lit("")) != "", given).when(F.coalesce("url", F.lit("")) != "", sheet_name_from_url("url")).otherwise("取数_网页")
    return payloads.select(
        "job_id",
        "url",
        payload_status(F.col("rows")).alias("status"),
        name.alias("sheet_name"),
        F.size(kept).alias("row_count"),
        F.size("rows").alias("source_rows"),
        (F.size("rows") > F.size(kept)).alias("truncated"),
        F.coalesce(F.array_max(F.transform(kept, lambda r: F.size(r))), F.lit(0)).alias("col_count"),
        shown.alias("sample_head"),
    )


def packed_rows(payloads: DataFrame) -> DataFrame:
    """Rows as JSON text where they are to be shuffled: as arrays of arrays, each cell takes several times its text.

    Cells that are no valid UTF-8 would not come back as they were; their payloads stay as they are."""
    if payloads.schema["rows"].dataType.simpleString() != GRID.simpleString():
        return payloads
    exact = F.forall("rows", lambda r: r.isNull() | F.forall(r, lambda c: c.isNull() | F.is_valid_utf8(c)))
    return payloads.withColumn(PACKED, F.when(exact, F.to_json("rows"))).withColumn("rows", F.when(F.col(PACKED).isNull(), F.col("rows")))


def unpacked_rows(payloads: DataFrame) -> DataFrame:
    """What ``packed_rows`` was given."""
    if PACKED not in payloads.columns:
        return payloads
    given = F.from_json(PACKED, GRID, {"maxStringLen": str((1 << 31) - 1)})
    return payloads.withColumn("rows", F.when(F.col(PACKED).isNull(), F.col("rows")).otherwise(given)).drop(PACKED)


def ingest_rows(payloads: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows of usable payloads; missing cells become empty text.  Every row is kept unless ``cap`` (say ``ROW_CAP``) is given."""
    kept = F.slice("rows", 1, cap) if cap else F.col("rows")
    if not payloads.isStreaming:
        payloads = unpacked_rows(scale.spread(payloads, grows=True))
    good = payloads.filter(payload_status(F.col("rows")) == "ok")
    # The host is worked out per payload, before the rows are spread out.
    good = good.withColumn("host", host_key("url"))
    out = good.select("job_id", "url", "host", F.posexplode(kept).alias("row_idx", "cells"))
    return out.withColumn("cells", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))))


def archive_by_host(rows: DataFrame, path: str, date_column: str = "ingest_date") -> None:
    """Append below host / date folders; a host's rows of a day go to as many files as tasks hold them."""
    if date_column not in rows.columns:
        rows = rows.withColumn(date_column, F.current_date())
    rows.write.mode("append").partitionBy("host", date_column).parquet(path)
