"""Shipment pricing: billable weight, tier and zone price, surcharges, fuel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions.names import require_columns
from tablework.operators.filters import predicate
from tablework.operators.lookup import two_key_rate

# Volume divisors by unit system.
VOLUME_FACTORS = {"cm_kg": 6000.0, "in_lb": 250.0}


def billable_weight(length: Column, width: Column, height: Column, actual: Column, factor: float) -> Column:
    """The larger of actual and volume weight, rounded up to a whole unit."""
    return F.ceil(F.greatest(actual, length * width * height / F.lit(float(factor)))).cast("double")


def surcharge_total(df: DataFrame, rules: Sequence[dict], address_type: str | None = None) -> Column:
    """Expected sum of all triggered surcharges.

    A rule: ``{measure, op, value, amount, residential, commercial, probability}``.  The trigger is a
    filter on a measure column; variants apply by address type; probability scales the amount."""
    total = F.lit(0.0)
    for rule in rules:
        amount = F.lit(float(rule.get("amount") or 0.0))
        for variant in ("residential", "commercial"):
            if rule.get(variant) is not None:
                if not address_type:
                    raise ValueError("residential or commercial amounts need the address type column")
                amount = F.when(F.lower(F.col(address_type)) == variant, float(rule[variant])).otherwise(amount)
        chance = rule.get("probability")
        cost = amount * F.lit(1.0 if chance is None else float(chance))
        hit = predicate(df, rule["measure"], rule.get("op", "gt"), rule.get("value"), rule.get("value2"))
        total = total + F.when(hit, cost).otherwise(0.0)
    return total


def apply_surcharges(df: DataFrame, rules: Sequence[dict], address_type: str | None = None, out: str = "surcharges") -> DataFrame:
    return df.withColumn(out, surcharge_total(df, rules, address_type))


def rate_shipments(
    df: DataFrame,
    rates: DataFrame,
    length: str,
    width: str,
    height: str,
    weight: str,
    zone: str,
    factor: float = VOLUME_FACTORS["cm_kg"],
    fuel_rate: float = 0.0,
    surcharges: Sequence[dict] = (),
    address_type: str | None = None,
    tier: str = "tier",
    price: str = "price",
) -> DataFrame:
    """Billable weight, base price, surcharges, fuel (on the base price only) and total.

    Shipments without a tier keep NULL prices and ``tier_found`` = false."""
    require_columns(df.columns, [length, width, height, weight, zone], "shipments")
    dims = [F.col(c).cast("double") for c in (length, width, height, weight)]
    df = df.withColumn("billable_weight", billable_weight(*dims, factor))
    df = two_key_rate(df, rates, "billable_weight", zone, tier, price).withColumnRenamed(price, "base_price")
    df = apply_surcharges(df, surcharges, address_type)
    df = df.withColumn("fuel", F.col("base_price") * F.lit(float(fuel_rate)))
    return df.withColumn("total", F.col("base_price") + F.col("fuel") + F.col("surcharges"))


def zone_weighted_price(rates: DataFrame, tier: str, price: str, share: str, floor: float | None = None) -> DataFrame:
    """Per tier the zone prices weighted by zone share, not below the declared floor."""
    from tablework.operators.aggregate import weighted_avg

    return weighted_avg(rates, share, price, [tier], floor, divide=False, out="weighted_price")
