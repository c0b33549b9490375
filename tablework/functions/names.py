"""Driver-side resolution of column names and other arguments."""

from __future__ import annotations

import re
from collections.abc import Sequence

# Shared columns preferred as join keys, and value columns preferred for sums.
JOIN_KEY_PREFERENCE = ("订单号", "单号", "订单编号", "OrderID", "order_id", "ID")
LOOKUP_KEY_PREFERENCE = ("订单号", "单号", "ID", "id")
VALUE_PREFERENCE = ("金额", "数量", "合计", "总额", "Amount", "Qty")
# Aggregation names.
AGGREGATIONS = {
    "sum": "sum", "求和": "sum", "count": "count", "计数": "count", "average": "avg", "avg": "avg", "mean": "avg",
    "平均": "avg", "min": "min", "最小": "min", "max": "max", "最大": "max",
}


def require_columns(columns: Sequence[str], names: Sequence[str], what: str = "table") -> None:
    for name in names:
        if name not in columns:
            raise ValueError(f"no column {name!r} in {what}; existing columns: {', '.join(columns)}")


def letter(index: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    text, n = "", index + 1
    while n > 0:
        n, rest = divmod(n - 1, 26)
        text = chr(65 + rest) + text
    return text


def letter_index(text: str) -> int:
    s = str(text).strip().upper()
    if not re.fullmatch("[A-Z]+", s):
        raise ValueError(f"not a column letter: {text!r}")
    value = 0
    for ch in s:
        value = value * 26 + ord(ch) - 64
    return value - 1


def resolve_column(columns: Sequence[str], ref: str | int) -> str:
    """Column by 0-based number, header (exact, then any case), 1-based digits or letter."""
    if isinstance(ref, int):
        if not 0 <= ref < len(columns):
            raise ValueError(f"column index {ref} out of range 0..{len(columns) - 1}")
        return columns[ref]
    text = str(ref).strip()
    if not text:
        raise ValueError("column required")
    if text in columns:
        return text
    folded = [c for c in columns if c.strip().lower() == text.lower()]
    if folded:
        return folded[0]
    if text.isdigit():
        return resolve_column(columns, int(text) - 1)
    if re.fullmatch("[A-Za-z]+", text):
        return resolve_column(columns, letter_index(text))
    raise ValueError(f"no column {text!r}; existing columns: {', '.join(columns)}")


def match_field(wanted: str, columns: Sequence[str]) -> str:
    """Exact, else the only case-insensitive match, else the only containment either way."""
    q = str(wanted or "").strip()
    if not q:
        raise ValueError("empty field name")
    if q in columns:
        return q
    for hits in (
        [c for c in columns if c.strip().lower() == q.lower()],
        [c for c in columns if q in c or c in q],
    ):
        if len(hits) == 1:
            return hits[0]
    raise ValueError(f"no field {q!r}; existing columns: {', '.join(columns)}")


def unique_headers(headers: Sequence[str | None]) -> list[str]:
    """Blank -> 列N; repeats get _2, _3 ..."""
    seen: dict[str, int] = {}
    out = []
    for i, raw in enumerate(headers):
        base = str(raw or "").strip() or f"列{i + 1}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def infer_join_keys(left: Sequence[str], right: Sequence[str], hint: str | None = None, preferred: Sequence[str] = JOIN_KEY_PREFERENCE) -> list[str]:
    """The hint if both sides have it, else a preferred shared column, else the only shared one."""
    if hint:
        if hint in left and hint in right:
            return [hint]
        raise ValueError(f"key {hint!r} is not on both sides")
    shared = [c for c in left if c in right]
    for name in preferred:
        if name in shared:
            return [name]
    if len(shared) == 1:
        return shared
    raise ValueError(f"name the key column; shared columns: {', '.join(shared) or '(none)'}")


def infer_value_column(columns: Sequence[str], group: str, preferred: Sequence[str] = VALUE_PREFERENCE) -> str:
    for name in preferred:
        if name in columns and name != group:
            return name
    rest = [c for c in columns if c != group]
    if len(rest) == 1:
        return rest[0]
    raise ValueError(f"name the value column; existing columns: {', '.join(columns)}")


def aggregation(name: str | None) -> str:
    key = str(name or "sum").strip().lower()
    if key not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {name!r}; use one of {', '.join(sorted(AGGREGATIONS))}")
    return AGGREGATIONS[key]


def free_name(base: str, taken: Sequence[str]) -> str:
    """base, base2, base3 ... whichever is free."""
    name, i = base, 2
    while name in taken:
        name, i = f"{base}{i}", i + 1
    return name
