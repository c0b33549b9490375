"""Header rows of raw grids ``(row_idx, cells)``: flatten, pick, detect.  Only header rows reach the driver."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.functions.columns import to_id_text
from tablework.functions.names import unique_headers
from tablework.operators.infer import ID_HEADER, NOT_ID_HEADER

# Header texts that are data.
NOISY_HEADER = r"(?i)CNY|¥|\$\s?\d|颗星|选项:|^\+?\d+(\.\d+)?$"


class _Part:
    """One cell of a header path, taken apart once: the text, a bare form to compare and start names with, and a form that stands alone."""

    def __init__(self, cell: str | None) -> None:
        self.text = " ".join(str(cell or "").split())
        plain = self.text.translate({ord(c): None for c in "()（）"})
        self.bare = plain.translate({ord(c): None for c in ". \t"})
        self.alone = "_".join(filter(None, plain.replace(".", "_").split("_")))
        self.qualified = any(c in self.text for c in ".(（")


def _tail(name: str, part: _Part) -> str:
    """What a cell says beyond the name it starts with."""
    return _Part(part.text[len(name) :].lstrip(" ._-:：")).bare


# What a cell below a name makes of it: the first rule that fits.
_BELOW = (
    (lambda name, part: not name or part.text == name, lambda name, part, sep: part.alone or name),
    (lambda name, part: part.text.startswith(name), lambda name, part, sep: sep.join(filter(None, (name, _tail(name, part))))),
    (lambda name, part: part.qualified or not part.alone, lambda name, part, sep: part.alone or name),
    (lambda name, part: True, lambda name, part, sep: name + sep + part.alone),
)


def flatten_names(rows: Sequence[Sequence[str | None]], sep: str = "_") -> list[str]:
    """One unique name per column from several header rows; the cells of the first row reach to the right, and where nothing stands above
    a cell, so does the last cell of its own row."""
    paths = list(zip_longest(*rows)) if rows else []
    reach = [""] * len(rows)
    names = []
    for path in paths:
        parts = [_Part(cell) for cell in path]
        reach = [part.bare or last for part, last in zip(parts, reach, strict=True)]
        name = reach[0]
        for part, above in list(zip(parts, reach, strict=True))[1:]:
            if part.text:
                name = name or above
                name = next(make for fits, make in _BELOW if fits(name, part))(name, part, sep)
        names.append(name or None)
    return unique_headers(names)


def _spread(grid: DataFrame, names: Sequence[str], first: int, cells: str, row: str) -> DataFrame:
    """Rows after the header as columns; id-like columns as plain text."""
    body = grid.filter(F.col(row) >= first)
    cols = []
    for i, n in enumerate(names):
        c = F.coalesce(F.get(F.col(cells), F.lit(i)), F.lit(""))
        is_id = bool(re.search(ID_HEADER.replace("(?i)", ""), n, re.I)) and not re.search(NOT_ID_HEADER.replace("(?i)", ""), n, re.I)
        cols.append((to_id_text(c) if is_id else c).alias(n))
    return body.select(F.col(row), *cols)


def _head(grid: DataFrame, count: int, cells: str, row: str) -> list[list[str]]:
    found = grid.filter(F.col(row) < count).select(row, cells).limit(count).collect()
    return [list(r[cells] or []) for r in sorted(found, key=lambda r: r[row])]


def flatten_header(grid: DataFrame, header_rows: int = 2, sep: str = "_", cells: str = "cells", row: str = "row_idx") -> DataFrame:
    """Several header rows become one; the body stays distributed and unchanged."""
    header_rows = max(1, int(header_rows))
    head = _head(grid, header_rows, cells, row)
    if len(head) < header_rows:
        raise ValueError("the grid needs more rows than header rows")
    return _spread(grid, flatten_names(head, sep or "_"), header_rows, cells, row)


def pick_header_row(grid: DataFrame, use: int, header_rows: int, cells: str = "cells", row: str = "row_idx") -> DataFrame:
    """Of ``header_rows`` rows take row ``use`` (1-based) as the names."""
    head = _head(grid, header_rows, cells, row)
    if not 1 <= use <= len(head):
        raise ValueError(f"header row {use} is outside 1..{len(head)}")
    return _spread(grid, unique_headers(head[use - 1]), header_rows, cells, row)


def detect_headerless(df: DataFrame, name: str) -> bool:
    """The header of a fetched table is data: it repeats the first row or holds noisy cells."""
    heads = [str(c).strip() for c in df.columns]
    if "取数_" not in name or len(heads) < 4:
        return False
    first = df.limit(1).collect()
    cells = ["" if v is None else str(v).strip() for v in first[0]] if first else []
    if cells and sum(h == c for h, c in zip(heads, cells)) > len(heads) * 0.5:
        return True
    return sum(bool(re.search(NOISY_HEADER, h)) for h in heads) >= 2
