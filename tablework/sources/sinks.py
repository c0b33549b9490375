"""New tables, audit rows and schema snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.functions.names import free_name, letter

AUDIT_SCHEMA = (
    "timestamp timestamp, packId string, packVersion string, runType string, matched long, left_only long, right_only long, "
    "conflict long, review_pending long, sourceHash_orders string, sourceHash_ads string, note string"
)
CONFIDENCE = ("high", "medium", "low")


def write_new_table(df: DataFrame, base: str, fmt: str = "parquet") -> str:
    """Save under the first free of base, base2, base3 ..; an empty input is refused.  Returns the name."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    catalog = df.sparkSession.catalog
    name = free_name(base.lower(), [t.name.lower() for t in catalog.listTables()])
    df.write.format(fmt).mode("errorifexists").saveAsTable(name)
    return name


def audit_row(counts: DataFrame, pack_id: str, pack_version: str, run_type: str, orders_hash: str = "", ads_hash: str = "", note: str = "") -> DataFrame:
    """The audit record of a reconcile run, from ``reconcile_counts``."""
    text = F.concat_ws(
        "；",
        F.when(F.lit(note) != "", F.lit(note)),
        F.concat(F.lit("matched="), F.col("matched").cast("string"), F.lit("/"), F.col("total").cast("string")),
        F.concat(F.lit("review_pending="), F.col("review_pending").cast("string")),
    )
    return counts.select(
        F.current_timestamp().alias("timestamp"),
        F.lit(pack_id).alias("packId"),
        F.lit(pack_version).alias("packVersion"),
        F.lit(run_type).alias("runType"),
        *[F.col(c).cast("long").alias(c) for c in ("matched", "left_only", "right_only", "conflict", "review_pending")],
        F.lit(orders_hash).alias("sourceHash_orders"),
        F.lit(ads_hash).alias("sourceHash_ads"),
        text.alias("note"),
    )


def append_audit(row: DataFrame, path: str) -> None:
    """Append one record to the audit log."""
    row.write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).parquet(path)


def schema_snapshot(df: DataFrame, name: str) -> DataFrame:
    """One row per column: table, position, letter, header, type and the table's row count."""
    entry = [
        F.struct(F.lit(i).alias("idx"), F.lit(letter(i)).alias("letter"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
        for i, f in enumerate(df.schema.fields)
    ]
    counted = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("e", F.explode(F.array(*entry)))
    return counted.select(F.lit(name).alias("table"), "e.*", "rows")


def valid_inferences(notes: Sequence[dict]) -> list[dict]:
    """Only claims with evidence and a known confidence are kept."""
    return [
        n for n in notes or []
        if str(n.get("claim") or "").strip() and str(n.get("evidence") or "").strip() and n.get("confidence") in CONFIDENCE
    ]


def save_snapshot(df: DataFrame, name: str, path: str, inferences: Sequence[dict] = ()) -> int:
    """Append a snapshot version; earlier versions stay readable.  Returns the version."""
    spark = df.sparkSession
    try:
        last = spark.read.parquet(path).filter(F.col("table") == name).agg(F.max("version")).first()[0] or 0
    except Exception as exc:  # noqa: BLE001 - the first snapshot has no folder yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        last = 0
    kept = valid_inferences(inferences)
    claims = F.array(*[F.struct(*[F.lit(str(n[k])).alias(k) for k in ("claim", "evidence", "confidence")]) for n in kept])
    claims = claims.cast("array<struct<claim:string,evidence:string,confidence:string>>")
    snap = schema_snapshot(df, name).withColumns({"inferences": claims, "version": F.lit(last + 1), "saved_at": F.current_timestamp()})
    snap.write.mode("append").parquet(path)
    return last + 1


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed, retyped, moved or the same between two snapshots of one table."""
    a = old.select("column", F.col("idx").alias("old_idx"), F.col("type").alias("old_type"))
    b = new.select("column", F.col("idx").alias("new_idx"), F.col("type").alias("new_type"))
    change = (
        F.when(F.col("old_idx").isNull(), "added")
        .when(F.col("new_idx").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
        .when(F.col("old_idx") != F.col("new_idx"), "moved")
        .otherwise("same")
    )
    return a.join(b, "column", "full_outer").withColumn("change", change)
