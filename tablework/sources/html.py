"""Tables and readable text of HTML pages, parsed page by page inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework import scale

TEXT_LIMIT = 4000
# Elements whose content is not text, and table roles used by script-built grids.
SILENT = ("script", "style", "noscript")
GRID_ROLES = {"grid": "table", "table": "table", "row": "tr", "gridcell": "td", "cell": "td", "columnheader": "td"}
# Classes by which component libraries mark grids, header parts, header cells, rows and cells.
COMPONENTS = frozenset(("ant-table", "el-table", "vxe-table", "kd-table"))
COMPONENT_HEADS = frozenset(("ant-table-thead", "el-table__header"))
COMPONENT_TITLES = frozenset(("vxe-header--column",))
COMPONENT_ROWS = frozenset(("ant-table-row", "el-table__row", "vxe-body--row"))
COMPONENT_CELLS = frozenset(("vxe-body--column",))
_VOID = ("br", "img", "input", "hr", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr")


class _Reader(HTMLParser):
    """Shared handling of elements whose content is skipped."""

    silent = SILENT

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.muted = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.silent:
            self.muted += 1
        elif not self.muted:
            self.opened(tag, dict(attrs))

    def handle_endtag(self, tag):
        if tag in self.silent:
            self.muted = max(0, self.muted - 1)
        elif not self.muted:
            self.closed(tag)

    def handle_data(self, data):
        if not self.muted:
            self.text(data)

    def opened(self, tag, attrs): ...

    def closed(self, tag): ...

    def text(self, data): ...


class _Nested(_Reader):
    """Remembers what the open elements mean, so that an end tag also ends what was left open inside."""

    def __init__(self) -> None:
        super().__init__()
        self.done: list[tuple[int, list[list[str]]]] = []
        self.open: list[tuple[str, str]] = []  # (tag, meaning)

    def closed(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for _, meaning in reversed(self.open[i:]):
                    self.ended(meaning)
                del self.open[i:]
                return

    def ended(self, meaning): ...

    def grids(self, html: str) -> list[list[list[str]]]:
        """The grids of a page in the order in which they begin."""
        self.feed(html)
        self.close()
        while self.open:
            self.ended(self.open.pop()[1])
        return [rows for _, rows in sorted(self.done, key=lambda t: t[0])]


class _Tables(_Nested):
    """Collects tables; an inner table is kept beside the outer one.

    ARIA roles (grid, row, cell) stand in for table elements."""

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[dict] = []
        self.count = 0

    def opened(self, tag, attrs):
        meaning = {"table": "table", "tr": "tr", "td": "td", "th": "td"}.get(tag) or GRID_ROLES.get((attrs.get("role") or "").lower(), "")
        if tag not in _VOID:
            self.open.append((tag, meaning))
        if meaning == "table":
            self.stack.append({"no": self.count, "rows": [], "row": None, "cell": None})
            self.count += 1
        elif self.stack:
            table = self.stack[-1]
            if meaning == "tr":
                self._end_row(table)
                table["row"] = []
            elif meaning == "td" and table["row"] is not None:
                self._end_cell(table)
                table["cell"] = []

    def ended(self, meaning):
        if not self.stack or not meaning:
            return
        table = self.stack[-1]
        if meaning == "td":
            self._end_cell(table)
        elif meaning == "tr":
            self._end_row(table)
        else:
            self._end_row(table)
            self.stack.pop()
            if table["rows"]:
                self.done.append((table["no"], table["rows"]))

    @staticmethod
    def _end_cell(table):
        if table["cell"] is not None and table["row"] is not None:
            table["row"].append(" ".join("".join(table["cell"]).split()))
        table["cell"] = None

    def _end_row(self, table):
        self._end_cell(table)
        if table["row"] and any(table["row"]):
            table["rows"].append(table["row"])
        table["row"] = None

    def text(self, data):
        if self.stack and self.stack[-1]["cell"] is not None:
            self.stack[-1]["cell"].append(data)


class _Components(_Nested):
    """Collects grids of component libraries, whose header and body are often tables of their own; a row belongs to the innermost grid."""

    def __init__(self) -> None:
        super().__init__()
        self.roots: list[dict] = []
        self.count = 0

    def opened(self, tag, attrs):
        classes = set((attrs.get("class") or "").split())
        meaning = ""
        if classes & COMPONENTS:
            meaning = "root"
            self.roots.append({"no": self.count, "titles": [], "rows": [], "heads": 0, "row": None, "cell": None, "title": False})
            self.count += 1
        elif self.roots:
            root = self.roots[-1]
            if classes & COMPONENT_TITLES or (tag == "th" and root["heads"]):
                meaning = "cell"
                self._end_cell(root)
                root["cell"], root["title"] = [], True
            elif tag == "thead" or classes & COMPONENT_HEADS:
                meaning = "head"
                root["heads"] += 1
            elif classes & COMPONENT_ROWS or (tag == "tr" and not root["heads"]):
                meaning = "row"
                self._end_row(root)
                root["row"] = []
            elif root["row"] is not None and (tag == "td" or classes & COMPONENT_CELLS):
                meaning = "cell"
                self._end_cell(root)
                root["cell"], root["title"] = [], False
        if tag not in _VOID:
            self.open.append((tag, meaning))

    def ended(self, meaning):
        if not self.roots or not meaning:
            return
        root = self.roots[-1]
        self._end_cell(root)
        if meaning == "head":
            root["heads"] -= 1
        elif meaning == "row":
            self._end_row(root)
        elif meaning == "root":
            self._end_row(root)
            self.roots.pop()
            rows = [r for r in (root["titles"], *root["rows"]) if any(r)]
            if rows:
                self.done.append((root["no"], rows))

    @staticmethod
    def _end_cell(root):
        if root["cell"] is not None:
            (root["titles"] if root["title"] else root["row"]).append(" ".join("".join(root["cell"]).split()))
        root["cell"] = None

    def _end_row(self, root):
        self._end_cell(root)
        if root["row"]:
            root["rows"].append(root["row"])
        root["row"] = None

    def text(self, data):
        if self.roots and self.roots[-1]["cell"] is not None:
            self.roots[-1]["cell"].append(data)


class _Text(_Reader):
    silent = (*SILENT, "svg")

    def __init__(self) -> None:
        super().__init__()
        self.lines: list[str] = []

    def text(self, data):
        line = " ".join(data.split())
        if line:
            self.lines.append(line)


def tables_of(html: str | None) -> list[list[list[str]]]:
    """Tables of a page, then its component-library grids, whose parts are among the tables as well."""
    body = html or ""
    grids = _Tables().grids(body)
    return grids + _Components().grids(body) if any(c in body for c in COMPONENTS) else grids


def text_of(html: str | None) -> str:
    reader = _Text()
    reader.feed(html or "")
    reader.close()
    return "\n".join(reader.lines)


def html_tables(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """``(source_id, table_idx, row_idx, cells)`` of every table with text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, body in zip(pdf[page], pdf[html]):
                for t, rows in enumerate(tables_of(body)):
                    out += [(key, t, r, cells) for r, cells in enumerate(rows)]
            yield pd.DataFrame(out, columns=["source_id", "table_idx", "row_idx", "cells"])

    kind = pages.schema[page].dataType.simpleString()
    return scale.spread(pages.select(page, html)).mapInPandas(run, f"source_id {kind}, table_idx int, row_idx int, cells array<string>")


@F.pandas_udf(T.StringType())
def html_text_udf(html: pd.Series) -> pd.Series:
    return html.map(text_of)


def html_text(pages: DataFrame, html: str = "html", out: str = "text", max_chars: int | None = None) -> DataFrame:
    """Readable text: one line per text node; whole unless ``max_chars`` (say ``TEXT_LIMIT``) is given."""
    text = html_text_udf(F.col(html))
    return scale.spread(pages).withColumn(out, F.substring(text, 1, max_chars) if max_chars else text)


def app_shell(html: Column, text: Column, tables: Column) -> Column:
    """No table and no text, or two scripts and under 400 characters: the page needs a browser."""
    body = F.btrim(F.coalesce(text, F.lit("")))
    scripts = F.regexp_count(F.lower(F.coalesce(html, F.lit(""))), F.lit("<script"))
    return (F.coalesce(tables, F.lit(0)) == 0) & ((body == "") | ((scripts >= 2) & (F.length(body) < 400)))


def flag_app_shell(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text_chars``, ``tables`` and ``app_shell``; text and tables are read in one batch pass."""

    @F.pandas_udf("struct<text: string, tables: int>")
    def read(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": s.map(text_of), "tables": s.map(lambda h: len(tables_of(h)))})

    out = scale.spread(pages).withColumn("__r", read(F.col(html)))
    return out.withColumns(
        {
            "text_chars": F.length("__r.text"),
            "tables": F.col("__r.tables"),
            "app_shell": app_shell(F.col(html), F.col("__r.text"), F.col("__r.tables")),
        }
    ).drop("__r")
