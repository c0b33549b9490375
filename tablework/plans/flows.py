"""The named flows: short compositions of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablework.functions.names import LOOKUP_KEY_PREFERENCE, infer_join_keys, infer_value_column
from tablework.operators import headers, reshape
from tablework.operators.aggregate import pivot_table, sum_by
from tablework.operators.lookup import lookup
from tablework.operators.project import infer_projection, profile_columns, project, resolve_template
from tablework.operators.reconcile import reconcile, reconcile_counts
from tablework.operators.finance import profit_assumptions
from tablework.session import checkpointed
from tablework.sources.sinks import audit_row

ATTRIBUTION_DAYS = 7


def reconcile_flow(left: DataFrame, right: DataFrame, key_hint: str | None = None, **options) -> DataFrame:
    return reconcile(left, right, infer_join_keys(left.columns, right.columns, key_hint), **options)


def extract_flow(df: DataFrame, columns: Sequence[str], case: str = "title", unique: bool = False) -> DataFrame:
    return reshape.extract_columns(df, columns, case, unique)


def project_flow(df: DataFrame, targets: Sequence[str], name: str = "", url: str = "", templates: dict | None = None, has_header: bool | None = None) -> DataFrame:
    """A template when one fits, otherwise an inferred projection."""
    found = resolve_template(name, url, templates or {}, targets)
    if found:
        return project(df, found["columns"], found["headerless"])
    if has_header is None:
        has_header = not headers.detect_headerless(df, name)
    return project(df, infer_projection(profile_columns(df, has_header=has_header), targets), not has_header)


def flatten_header_flow(grid: DataFrame, header_rows: int = 2, sep: str = "_") -> DataFrame:
    return headers.flatten_header(grid, header_rows, sep)


def reshape_flow(df: DataFrame, op: str, **options) -> DataFrame:
    ops = {
        "dedupe": reshape.dedupe, "unpivot": reshape.unpivot, "split": reshape.split_column, "coerce": reshape.coerce,
        "coerce_columns": reshape.coerce_columns, "project": project, "flatten_header": headers.flatten_header,
    }
    if op not in ops:
        raise ValueError(f"unknown reshape {op!r}; use one of {', '.join(ops)}")
    return ops[op](df, **options)


def calculate_flow(df: DataFrame, op: str, other: DataFrame | None = None, key: str | None = None, bring: Sequence[str] | None = None, group: str | None = None, value: str | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    if op == "lookup":
        keys = infer_join_keys(df.columns, other.columns, key, LOOKUP_KEY_PREFERENCE)
        return lookup(df, other, keys, bring, order_by)
    if op == "sum":
        return sum_by(df, group, value or infer_value_column(df.columns, group), order_by=order_by)
    raise ValueError("calculate knows lookup and sum")


def finance_closed_loop(orders: DataFrame, ads: DataFrame, keys: Sequence[str] = ("platform_sku", "biz_date"), window_days: int = ATTRIBUTION_DAYS, order_by: Sequence[str] | None = None, right_order_by: Sequence[str] | None = None, price: str = "item_price", spend: str = "spend", orders_hash: str = "", ads_hash: str = "", note: str = "") -> dict[str, DataFrame]:
    """Reconcile orders with advertising inside a date window, then sum, pivot and audit the result.

    The reconcile result feeds three outputs, so it is materialised once in the shared folder."""
    sku, day = keys
    result = checkpointed(
        reconcile(orders, ads, keys, mode="date_window", window_days=window_days, left_date=day, right_date=day, order_by=order_by, right_order_by=right_order_by)
    )
    counts = reconcile_counts(result)
    return {
        "reconcile": result,
        "assumptions": profit_assumptions(orders, sku),
        "profit": sum_by(result, f"left_{sku}", f"left_{price}", order_by=[f"left_{sku}"]),
        "pivot": pivot_table(
            result, [f"left_{sku}", f"left_{day}"], values=[{"field": f"left_{price}"}, {"field": f"right_{spend}"}]
        ),
        "counts": counts,
        "audit": audit_row(counts, "finance", "1", "finance-reconciliation", orders_hash, ads_hash, note),
    }


FLOWS = {
    "reconcile": reconcile_flow, "extract": extract_flow, "project": project_flow, "flatten_header": flatten_header_flow,
    "reshape": reshape_flow, "calculate": calculate_flow, "finance": finance_closed_loop,
}


def run_flow(name: str, *args, **options):
    if name not in FLOWS:
        raise ValueError(f"unknown flow {name!r}; flows: {', '.join(FLOWS)}")
    return FLOWS[name](*args, **options)
