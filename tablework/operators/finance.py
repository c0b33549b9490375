"""Profit, refunds, advertising metrics and scenarios.  Rates are parameters; money is decimal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework import scale
from tablework.functions.columns import normalize_key, safe_ratio, trim_ws
from tablework.functions.names import require_columns

MONEY = "decimal(18,4)"
# Illustrative default rates, and default inputs of the profit formula.
DEFAULT_RATES = {
    "referral_rate": 0.15, "fba_fee_rate": 0.12, "return_rate": 0.03, "ad_rate": 0.08, "cogs_rate": 0.35, "inbound_rate": 0.02,
    "storage_rate": 0.01, "fx_loss_rate": 0.01, "vat_rate": 0.0, "duty_rate": 0.0, "other_rate": 0.02,
}
DEFAULT_INPUTS = {
    "commission_rate": 0.15, "fulfilment_fee": 3.22, "fuel_rate": 0.035, "storage_fee": 1.50, "payment_rate": 0.025,
    "refund_rate": 0.08, "other_fee": 0.0, "target_margin": 0.10,
}
DEFAULT_FX = {"USD": 7.2, "EUR": 7.8, "GBP": 9.0}
# Flag limits of the advertising metrics.
AD_LIMITS = {"ctr": 0.003, "tacos": 0.15, "roas": 2.0}
# Platform statuses and the five common ones.
STATUS_MAP = {
    "completed": "completed", "shipped": "completed", "closed": "completed", "refunded": "refunded", "partialrefund": "partial_refund",
    "partial_refund": "partial_refund", "settlementadjustment": "partial_refund", "cancelled": "cancelled", "canceled": "cancelled",
    "pending": "pending",
}


def map_status(df: DataFrame, column: str, mapping: dict[str, str] | None = None, out: str = "order_status") -> DataFrame:
    """Platform status to a common one (NULL when unknown); the raw text stays in ``raw_erp_status``."""
    pairs = mapping or STATUS_MAP
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    raw = F.col(column)
    return df.withColumn("raw_erp_status", raw).withColumn(out, table[F.lower(F.replace(trim_ws(raw), F.lit(" "), F.lit("")))])


def profit_assumptions(df: DataFrame, id_column: str, overrides: DataFrame | None = None, defaults: dict[str, float] | None = None) -> DataFrame:
    """One row of rates per non-blank id; a rate given in ``overrides`` wins over the default."""
    rates = {**DEFAULT_RATES, **(defaults or {})}
    ids = df.select(normalize_key(F.col(id_column), "trim", df.schema[id_column].dataType).alias(id_column))
    ids = ids.filter(F.col(id_column) != "").distinct()
    if overrides is None:
        return ids.select(id_column, *[F.lit(v).alias(k) for k, v in rates.items()])
    own = [k for k in rates if k in overrides.columns]
    given = overrides.select(
        normalize_key(F.col(id_column), "trim", overrides.schema[id_column].dataType).alias(id_column),
        *[F.col(k).alias(f"__{k}") for k in own],
    )
    given = scale.first_per_group(given, [id_column], [F.col(f"__{k}") for k in own])
    joined = scale.join_unique(ids, given, [id_column])
    return joined.select(id_column, *[(F.coalesce(f"__{k}", F.lit(v)) if k in own else F.lit(v)).alias(k) for k, v in rates.items()])


def apply_assumption_overrides(df: DataFrame, scenarios: dict[str, dict[str, float]], computed: Sequence[str] = (), base: dict[str, float] | None = None) -> DataFrame:
    """Every row once per scenario with the scenario's inputs as columns, side by side.

    Only inputs may be changed: naming a computed column raises."""
    base = {**DEFAULT_INPUTS, **(base or {})}
    if not scenarios:
        raise ValueError("name at least one scenario")
    for label, changes in scenarios.items():
        for name in changes:
            if name in computed or name in df.columns:
                raise ValueError(f"scenario {label!r} would overwrite the computed column {name!r}")
            if name not in base:
                raise ValueError(f"unknown input {name!r}; inputs: {', '.join(base)}")
    entries = [
        F.struct(F.lit(label).alias("scenario"), *[F.lit(str(changes.get(k, v))).cast(MONEY).alias(k) for k, v in base.items()])
        for label, changes in scenarios.items()
    ]
    return df.withColumn("__s", F.explode(F.array(*entries))).select(*df.columns, "__s.*")


def convert_currency(df: DataFrame, amount: str, currency: str, rates: dict[str, float] | None = None, out: str = "amount_local") -> DataFrame:
    """Amount times the user's rate of its currency; an unknown currency gives NULL and is labelled."""
    rates = DEFAULT_FX if rates is None else rates
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(str(x)).cast(MONEY) for kv in rates.items() for x in kv])
    rate = table[F.upper(trim_ws(F.col(currency)))]
    return df.withColumns(
        {out: (F.col(amount).cast(MONEY) * rate).cast(MONEY), "fx_source": F.when(rate.isNotNull(), "user").otherwise("missing")}
    )


def refund_estimate(status: Column, refund_amount: Column, margin: Column, rate: Column) -> Column:
    """Actual refund if above 0; else rate x margin for refunded rows; completed rows 0."""
    refunded = F.lower(status).isin("refunded", "partial_refund", "partialrefund")
    return (
        F.when(refund_amount > 0, refund_amount.cast(MONEY))
        .when(refunded, (rate * margin).cast(MONEY))
        .otherwise(F.lit(0).cast(MONEY))
    )


def net_profit(df: DataFrame, revenue: str, cogs: str, ads: str, status: str, refund_amount: str) -> DataFrame:
    """Adds the cost items, ``net_profit``, ``net_margin`` and ``below_target``.

    Expects the inputs of ``apply_assumption_overrides`` as columns and amounts in one currency."""
    require_columns(df.columns, [revenue, cogs, ads, status, refund_amount, *DEFAULT_INPUTS])
    rev, cost, ad = (F.coalesce(F.col(c), F.lit(0)).cast(MONEY) for c in (revenue, cogs, ads))
    fulfil = F.col("fulfilment_fee") * (1 + F.col("fuel_rate"))
    margin = F.col("gross_margin")
    df = df.withColumns(
        {
            "commission": (rev * F.col("commission_rate")).cast(MONEY),
            "fulfilment": fulfil.cast(MONEY),
            "payment": (rev * F.col("payment_rate")).cast(MONEY),
            "gross_margin": (rev - cost).cast(MONEY),
        }
    )
    df = df.withColumn("refund", refund_estimate(F.col(status), F.col(refund_amount), margin, F.col("refund_rate")))
    costs = ("commission", "fulfilment", "storage_fee", "payment", "refund", "other_fee")
    net = rev - cost - ad
    for c in costs:
        net = net - F.col(c)
    df = df.withColumn("net_profit", net.cast(MONEY))
    df = df.withColumn("net_margin", safe_ratio(F.col("net_profit"), F.col(revenue)))
    return df.withColumn("below_target", F.coalesce(F.col("net_margin") < F.col("target_margin"), F.lit(False)))


def ad_metrics(df: DataFrame, impressions: str, clicks: str, cost: str, attributed: str, total_sales: str, margin: str | None = None, cpc_mean: float | None = None) -> DataFrame:
    """CTR, CPC, ACoS, TACoS and ROAS with their flags; blank where the denominator is 0."""
    df = df.withColumns(
        {
            "ctr": safe_ratio(clicks, impressions),
            "cpc": safe_ratio(cost, clicks),
            "acos": safe_ratio(cost, attributed),
            "tacos": safe_ratio(cost, total_sales),
            "roas": safe_ratio(attributed, cost),
        }
    )
    no = F.lit(False)
    flags = {
        "low_ctr": F.coalesce(F.col("ctr") < AD_LIMITS["ctr"], no),
        "high_tacos": F.coalesce(F.col("tacos") > AD_LIMITS["tacos"], no),
        "low_roas": F.coalesce(F.col("roas") < AD_LIMITS["roas"], no),
    }
    if margin:
        flags["loss_making"] = F.coalesce(F.col("acos") > F.col(margin), no)
    if cpc_mean is not None:
        flags["high_cpc"] = F.coalesce(F.col("cpc") > cpc_mean, no)
    return df.withColumns(flags)


def discount_rate(price: Column | str, list_price: Column | str) -> Column:
    """1 - price / list price; blank when either is missing or the list price is 0."""
    return 1 - safe_ratio(price, list_price)
