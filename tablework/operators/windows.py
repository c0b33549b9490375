"""Checks against the previous row of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework import scale


def flag_non_monotonic(df: DataFrame, by: Sequence[str], tier: Sequence[str], price: str) -> DataFrame:
    """Mark a price lower than the price of the tier before it."""
    out = scale.previous(df, list(by), list(tier), F.col(price), "previous_price")
    return out.withColumn("inverted", F.coalesce(F.col(price) < F.col("previous_price"), F.lit(False)))


def flag_snapshot_anomaly(df: DataFrame, item: Sequence[str], at: Sequence[str], reviews: str, stars: str, sales: str, rank: str, review_drop: float = 0.3, star_change: float = 0.1) -> DataFrame:
    """Label each snapshot: ``imputed`` (a value is missing), ``data_delay`` (no sales but a rank),
    ``review_cleanup`` (reviews fall sharply while the stars stay) or ``normal``."""
    prev = F.struct(F.col(reviews).cast("double").alias("r"), F.col(stars).cast("double").alias("s"))
    out = scale.previous(df, list(item), list(at), prev, "__p")
    missing = F.col(reviews).isNull() | F.col(stars).isNull() | F.col(sales).isNull()
    dropped = F.col(reviews) < F.col("__p")["r"] * F.lit(1 - review_drop)
    steady = F.abs(F.col(stars) - F.col("__p")["s"]) <= star_change
    label = (
        F.when(missing, "imputed")
        .when((F.col(sales) == 0) & F.col(rank).isNotNull(), "data_delay")
        .when(dropped & steady, "review_cleanup")
        .otherwise("normal")
    )
    return out.withColumn("anomaly", label).drop("__p")


def flag_repeat_fetch(log: DataFrame, host: str, ts: str, hours: float = 24, tie: Sequence[str] = ()) -> DataFrame:
    """Mark a fetch when the fetch of the same host before it was less than ``hours`` ago."""
    out = scale.previous(log, [host], [ts, *tie], F.col(ts), "previous_fetch")
    age = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("previous_fetch").cast("timestamp"))) / F.lit(3.6e9)
    return out.withColumn("repeat_fetch", F.coalesce(age < hours, F.lit(False)))
