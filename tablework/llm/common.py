"""Helpers shared by the operators on documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tablework.session import checkpointed, give_back, removed

#: A side of a join with at most so many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000

#: Rows that a Python task turns into objects at once.
SLICE = 1000

#: Tables staged since the innermost ``passing`` began.
STAGED: ContextVar[list[DataFrame] | None] = ContextVar("staged", default=None)


def stage(df: DataFrame) -> DataFrame:
    """A table written once and read back; inside of ``passing`` it goes when that ends."""
    written, made = checkpointed(df), STAGED.get()
    if made is not None:
        made.append(written)
    return written


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged meanwhile are removed at the end, apart from those that are staged by the function it gives; nothing else may be read from them later."""
    outer, made = STAGED.get(), []

    def kept(df: DataFrame) -> DataFrame:
        STAGED.set(outer)
        try:
            return stage(df)
        finally:
            STAGED.set(made)

    STAGED.set(made)
    try:
        yield kept
    finally:
        STAGED.set(outer)
    for table in made:
        removed(table)


def field(df: DataFrame, column: str, name: str | None = None) -> StructField:
    """The type of a column, under a name."""
    return StructField(name or column, df.schema[column].dataType, True)


def free_names(df: DataFrame, n: int) -> list[str]:
    """So many names that are not among the columns of a table, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return list(islice((x for x in (f"_x{k}" for k in count()) if x not in taken), n))


def text_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def row_key(id_col: str, text_col: str) -> Column:
    """16 bytes that name a row by its id and text, so a lost and recomputed partition gives the same.

    Rows that repeat both have one key; what the operators compute for them is equal as well."""
    known = F.concat(F.lit("k"), F.col(id_col).cast("string"))
    return F.unhex(F.md5(F.concat(F.coalesce(known, F.lit("n")), F.lit("\x00"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))))


def crc_of(id_col: str) -> Column:
    """CRC-32 of an id as text; null as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def _offsets(sizes: Sequence[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def arrow_column(values: Sequence | np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    """What ``pa.array`` makes of a list or numpy array, put together from its buffers: ``pa.array`` loads pandas, about 40 MB in every worker."""
    if isinstance(values, pa.Array):
        return values
    n, valid = len(values), None
    if not isinstance(values, np.ndarray) and any(v is None for v in values):
        there = np.array([v is not None for v in values])
        valid = pa.py_buffer(np.packbits(there, bitorder="little"))
    if pa.types.is_boolean(kind):
        return pa.Array.from_buffers(kind, n, [valid, pa.py_buffer(np.packbits(np.asarray(values, dtype=bool), bitorder="little"))])
    if pa.types.is_integer(kind) or pa.types.is_float32(kind) or pa.types.is_float64(kind):
        numbers = np.ascontiguousarray([v or 0 for v in values] if valid else values, dtype=str(kind) if pa.types.is_integer(kind) else f"f{kind.bit_width // 8}")
        return pa.Array.from_buffers(kind, n, [valid, pa.py_buffer(numbers)])
    if pa.types.is_binary(kind) or pa.types.is_string(kind):
        parts = [v.encode() if isinstance(v, str) else v or b"" for v in values]
        ends = _offsets(list(map(len, parts)))
        if ends[-1] < 1 << 31:
            return pa.Array.from_buffers(kind, n, [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(parts))])
    elif pa.types.is_list(kind):
        rows = [() if v is None else v for v in values]
        ends = _offsets(list(map(len, rows)))
        inner = np.concatenate(rows) if rows and all(isinstance(v, np.ndarray) for v in rows) else list(chain.from_iterable(rows))
        return pa.Array.from_buffers(kind, n, [valid, pa.py_buffer(ends.astype(np.int32))], children=[arrow_column(inner, kind.value_type)])
    return pa.array(values, type=kind)


def rows_at(column: pa.Array, index: Sequence[int] | np.ndarray) -> pa.Array:
    """The values at some places."""
    return column.take(arrow_column(index, pa.int64()))


def map_arrow(df: DataFrame, schema: StructType, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[list[list]]]) -> DataFrame:
    """``rows`` turns Arrow batches of at most SLICE rows into lists of column values; every list of columns becomes one batch."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([arrow_column(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def per_row(df: DataFrame, schema: StructType, keep: int, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row per row: the first ``keep`` columns as they are, then what the function of ``make()`` returns for the others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        function = make()
        for batch in batches:
            if batch.num_rows:
                found = [function(*x) for x in zip(*(c.to_pylist() for c in batch.columns[keep:]), strict=True)]
                yield [*batch.columns[:keep], *map(list, zip(*found, strict=True))]

    return map_arrow(df, schema, rows)


def join_checked(big: DataFrame, small: DataFrame, on: list[str] | Column, how: str = "inner", rows: int = BROADCAST_ROWS, counted: int | None = None) -> DataFrame:
    """Join with a side that is counted first: broadcast if it has at most ``rows`` rows, else shuffled with skew handling.

    Hand in a side that was written already, as counting it then reads no column; where its rows hold lists, hand in the number of their
    elements as ``counted``."""
    n = small.count() if counted is None else counted
    return big.join(F.broadcast(small) if n <= rows else small, on, how)


def most_frequent(counts: DataFrame, column: str, rows: int) -> DataFrame:
    """The rows with the largest counts, at most so many, cut where the logarithm of the count takes an eighth of a step.

    An ordered limit would send so many rows of every partition to the driver; this sends one number for each step."""
    step = F.floor(F.log2(F.col(column)) * 8)
    sizes = {r["step"]: r["n"] for r in counts.where(F.col(column) > 0).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, None
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > rows:
            break
        least = k
    return counts.where((F.col(column) > 0) & (step >= least)) if least is not None else counts.where(F.lit(False))
