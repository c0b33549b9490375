"""Named user functions with declared parameters."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("scalar", "pandas", "rows", "table")
_TYPES = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict}


@dataclass
class UserFunction:
    name: str
    fn: Callable
    schema: str | None
    kind: str
    parameters: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()


class FunctionRegistry:
    """Functions of one session.  Scalar, pandas and table functions are also usable from SQL."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._known: dict[str, UserFunction] = {}

    def register(self, name: str, fn: Callable, schema: str | None, kind: str = "scalar", parameters: dict[str, str] | None = None, required: tuple[str, ...] = ()) -> UserFunction:
        """``fn`` of kind table is a class with ``eval``; without a schema its ``analyze`` tells the columns from the arguments of a call."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        if schema is None and not (kind == "table" and hasattr(fn, "analyze")):
            raise ValueError(f"{name} needs a schema, or as a table function the method analyze")
        sql_name = name.replace(".", "_")
        if kind == "scalar":
            self.spark.udf.register(sql_name, fn, schema)
        elif kind == "pandas":
            self.spark.udf.register(sql_name, F.pandas_udf(fn, schema))
        elif kind == "table":
            self.spark.udtf.register(sql_name, self._table_function(fn, schema))
        known = UserFunction(name, fn, schema, kind, dict(parameters or {}), tuple(required))
        self._known[name] = known
        return known

    def names(self) -> list[str]:
        return sorted(self._known)

    def _checked(self, name: str, args: dict) -> UserFunction:
        if name not in self._known:
            raise ValueError(f"unknown function {name!r}; registered: {', '.join(self.names()) or '(none)'}")
        f = self._known[name]
        for p in f.required:
            if p not in args:
                raise ValueError(f"{name} needs parameter {p!r}")
        for p, v in args.items():
            if p not in f.parameters:
                raise ValueError(f"{name} has no parameter {p!r}")
            if not isinstance(v, _TYPES[f.parameters[p]]):
                raise ValueError(f"{name}: parameter {p!r} must be {f.parameters[p]}")
        return f

    @staticmethod
    def _table_function(fn: type, schema: str | None):
        return F.udtf(fn) if schema is None else F.udtf(fn, returnType=schema)

    def apply_table(self, name: str, df: DataFrame, partition_by: Sequence[str] = (), order_by: Sequence[str] = (), **args) -> DataFrame:
        """Table function over a DataFrame, with one instance for each group of ``partition_by`` that sees its rows in order.

        Without groups every partition of ``df`` has an instance of its own.  The same call in SQL is
        ``SELECT * FROM name(TABLE(t) PARTITION BY k ORDER BY x, arg => value)``."""
        f = self._checked(name, args)
        if f.kind != "table":
            raise ValueError(f"{name} is not a table function")
        if order_by and not partition_by:
            raise ValueError("an order needs groups")
        rows = df.asTable()
        if partition_by:
            rows = rows.partitionBy(*partition_by)
        if order_by:
            rows = rows.orderBy(*order_by)
        return self._table_function(f.fn, f.schema)(rows, **{k: F.lit(v) for k, v in args.items()})

    def apply_rows(self, name: str, df: DataFrame, **args) -> DataFrame:
        """Row-set function over a DataFrame.  The function maps one pandas batch to another.  A batch that fails is
        halved until the rows that fail stand alone; each gives one row with ``status`` = error, the message and
        those of its own cells that the result has columns for."""
        f = self._checked(name, args)
        if f.kind != "rows":
            raise ValueError(f"{name} is not a row-set function")
        fn, payload = f.fn, json.dumps(args)
        names = [c.name for c in self.spark.createDataFrame([], f.schema).schema.fields]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            params = json.loads(payload)
            for pdf in batches:
                todo, good, bad = [pdf], [], []
                while todo:
                    part = todo.pop()
                    try:
                        good.append(fn(part, **params)[names])
                    except Exception as exc:  # noqa: BLE001 - reported as data
                        if len(part) > 1:
                            half = len(part) // 2
                            todo += [part.iloc[half:], part.iloc[:half]]
                            continue
                        own = {n: part[n].iloc[0] if n in part and len(part) else None for n in names}
                        bad.append({**own, "status": "error", "error": str(exc)})
                # The halves go on together, as far as their columns are of the same kinds.
                for _, alike in groupby(good, key=lambda out: list(out.dtypes)):
                    yield pd.concat(list(alike), ignore_index=True).assign(status="ok", error=None)
                if bad:
                    yield pd.DataFrame(bad)

        return df.mapInPandas(run, f"{f.schema}, status string, error string")
