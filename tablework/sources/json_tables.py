"""The best table inside JSON payloads of unknown shape, and typed JSON columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework import scale

# Keys that hold secrets, and keys that usually hold the list of records.
SECRET_KEY = re.compile(r"(?i)^(password|passwd|pwd|secret|token|access[_-]?token|refresh[_-]?token|cookie|authorization|captcha)$")
LIST_KEYS = ("list", "records", "rows", "items", "content", "result", "data", "datas", "table", "dataset", "entries")


def flat_text(value, object_values: int | None = None) -> str:
    """Scalar as text; list parts joined by "; "; the values of an object (the first ones, if a number is given) by " / "."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    if isinstance(value, list):
        return "; ".join(t for t in (flat_text(v, object_values) for v in value) if t)
    if isinstance(value, dict):
        kept = [v for k, v in value.items() if not SECRET_KEY.match(k)][:object_values]
        return " / ".join(t for t in (flat_text(v, object_values) for v in kept) if t)
    return str(value)


def _from_objects(items: list[dict], key_rows: int | None, max_keys: int | None, max_rows: int | None, object_values: int | None) -> list[list[str]]:
    keys: dict[str, None] = {}
    for item in items[:key_rows]:
        for k in item:
            if not SECRET_KEY.match(k) and (max_keys is None or len(keys) < max_keys):
                keys[k] = None
    body = [[flat_text(item.get(k), object_values) for k in keys] for item in items[:max_rows]]
    return [list(keys), *body] if any(any(r) for r in body) else []


def best_table(data, key_rows=None, max_keys=None, max_rows=None, max_depth=None, object_values=None) -> list[list[str]]:
    """Grid (first row = header for object lists) with the largest area; the first found wins a tie.

    Likely list keys are visited before the others."""
    best: list[list[str]] = []
    best_area = 0
    todo = [(data, 0)]
    while todo:
        node, depth = todo.pop()
        if node is None or (max_depth is not None and depth > max_depth):
            continue
        grid: list[list[str]] = []
        if isinstance(node, list):
            objects = [x for x in node if isinstance(x, dict)]
            lists = [x for x in node if isinstance(x, list)]
            if len(objects) >= 2:
                grid = _from_objects(objects, key_rows, max_keys, max_rows, object_values)
            elif len(lists) >= 2 and lists[0]:
                grid = [[flat_text(c, object_values) for c in r] for r in lists[:max_rows]]
        elif isinstance(node, dict):
            first = [node[k] for k in LIST_KEYS if k in node]
            rest = [v for k, v in node.items() if k not in LIST_KEYS]
            todo += [(v, depth + 1) for v in reversed(first + rest)]
        area = len(grid) * max((len(r) for r in grid), default=0)
        if area > best_area:
            best, best_area = grid, area
    return best


def json_payload_to_table(df: DataFrame, source: str, payload: str, key_rows: int | None = None, max_keys: int | None = None, max_rows: int | None = None, max_depth: int | None = None, object_values: int | None = None) -> DataFrame:
    """Grid rows ``(source_id, table_idx, row_idx, cells)`` per payload.

    Nothing is capped unless asked for (80 rows scanned for keys, 40 keys, 500 rows, depth 6 and 6 values of an inner object are usual caps)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf[source], pdf[payload]):
                try:
                    data = json.loads(text or "null")
                except ValueError:
                    continue
                out += [(key, 0, i, row) for i, row in enumerate(best_table(data, key_rows, max_keys, max_rows, max_depth, object_values))]
            yield pd.DataFrame(out, columns=["source_id", "table_idx", "row_idx", "cells"])

    kind = df.schema[source].dataType.simpleString()
    return scale.spread(df.select(source, payload)).mapInPandas(run, f"source_id {kind}, table_idx int, row_idx int, cells array<string>")


def grid_to_long(grids: DataFrame) -> DataFrame:
    """``(source_id, row_idx, col, value)`` with the first row as column names."""
    heads = grids.filter("row_idx = 0").select("source_id", "table_idx", F.col("cells").alias("__h"))
    body = scale.join_unique(grids.filter("row_idx > 0"), heads, ["source_id", "table_idx"], "inner")
    pairs = F.arrays_zip(F.col("__h").alias("col"), F.col("cells").alias("value"))
    return body.select("source_id", "row_idx", F.explode(pairs).alias("p")).select("source_id", "row_idx", "p.col", "p.value")


def parse_json_column(df: DataFrame, column: str, schema: str, prefix: str = "") -> DataFrame:
    """Known shape: typed fields as columns, with whole-stage code and column pruning."""
    parsed = df.withColumn("__j", F.from_json(column, schema))
    names = parsed.schema["__j"].dataType.fieldNames()
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *[F.col("__j")[n].alias(prefix + n) for n in names])


def flatten_list(column, sep: str = "; "):
    """A typed ARRAY as text: non-empty parts joined."""
    texts = F.transform(column, lambda x: F.coalesce(x.cast("string"), F.lit("")))
    return F.array_join(F.filter(texts, lambda x: x != ""), sep)
