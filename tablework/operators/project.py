"""Declarative projections: specs, templates, column profiles and inferred specs."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions.columns import cell_text, collapse_ws, to_date, to_number, to_text, trim_ws
from tablework.functions.names import letter, resolve_column

COERCIONS = ("number", "text", "date")


def normalize_specs(raw: Sequence[dict]) -> list[dict]:
    """Usable specs only: an output name, a source, and a known coercion."""
    out = []
    for spec in raw or []:
        name = str((spec or {}).get("as") or "").strip()
        if not name:
            continue
        merge = [int(m) if str(m).isdigit() else m for m in spec.get("merge") or []]
        if not merge and spec.get("from") in (None, ""):
            continue
        entry: dict = {"as": name}
        if merge:
            entry |= {"merge": merge, "separator": str(spec.get("separator") or "")}
        else:
            entry["from"] = spec["from"]
        if spec.get("coerce") in COERCIONS:
            entry["coerce"] = spec["coerce"]
        out.append(entry)
    return out


def headerless(df: DataFrame) -> DataFrame:
    """The header row is data: columns become A, B, C .. and the header comes back as a row."""
    names = [letter(i) for i in range(len(df.columns))]
    body = df.select(*[cell_text(F.col(f"`{c}`"), df.schema[c].dataType).alias(n) for c, n in zip(df.columns, names)])
    head = body.sparkSession.createDataFrame([tuple(df.columns)], ", ".join(f"`{n}` string" for n in names))
    return head.unionByName(body)


def _value(df: DataFrame, spec: dict) -> Column:
    if spec.get("merge"):
        names = [resolve_column(df.columns, r) for r in spec["merge"]]
        parts = [F.coalesce(trim_ws(cell_text(F.col(f"`{n}`"), df.schema[n].dataType)), F.lit("")) for n in names]
        return F.concat_ws(spec.get("separator") or "", *parts)
    return F.col(f"`{resolve_column(df.columns, spec['from'])}`")


def project(df: DataFrame, specs: Sequence[dict], headerless_input: bool = False, reserved: bool = False) -> DataFrame:
    """Output columns from ``{as, from}`` or ``{as, merge, separator}`` with an optional coercion.

    Audit columns (names starting with ``__``) are neither read nor written unless ``reserved``."""
    for i, spec in enumerate(specs or [{}]):
        if not str(spec.get("as") or "").strip():
            raise ValueError(f"spec {i} needs 'as'")
        if not spec.get("merge") and spec.get("from") is None:
            raise ValueError(f"spec {i} needs 'from' or 'merge'")
    if not reserved:
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("__")])
        specs = [s for s in specs if not str(s["as"]).startswith("__")]
    if headerless_input:
        df = headerless(df)
    out = []
    for spec in specs:
        value, kind = _value(df, spec), spec.get("coerce")
        source = None if spec.get("merge") else df.schema[resolve_column(df.columns, spec["from"])].dataType
        if kind == "number":
            value = to_number(value, source)
        elif kind == "date":
            value = to_date(value, source)
        elif kind == "text":
            value = to_text(value, source)
        elif kind is not None:
            raise ValueError(f"unknown coercion {kind!r}")
        out.append(value.alias(str(spec["as"]).strip()))
    return df.select(*out)


def resolve_template(sheet_name: str, url: str, templates: dict, targets: Sequence[str] = ()) -> dict | None:
    """Pick a projection: by sheet-name pattern, else by host (from the sheet name or the URL).

    ``templates``: ``{"sheets": [{"pattern", "columns", "headerless"}], "hosts": {host: {...}}}``.
    With targets the template must offer at least min(3, n) of them and is cut to their order."""
    name = str(sheet_name or "").strip()
    found = next((t for t in templates.get("sheets", []) if name and re.search(t["pattern"], name, re.I)), None)
    if found is None:
        host = re.match(r"(?i)取数[_-](.+)", name)
        source = "https://" + host.group(1).split("_")[0] if host else str(url or "")
        authority = re.match(r"(?i)https?://([^/?#:]+)", source)
        key = authority.group(1).lower().replace("www.", "") if authority else ""
        found = templates.get("hosts", {}).get(key)
    if not found:
        return None
    columns = normalize_specs(found.get("columns"))
    if targets:
        by_name = {c["as"]: c for c in columns}
        columns = [by_name[t] for t in targets if t in by_name]
        if len(columns) < min(3, len(targets)):
            return None
    return {"columns": columns, "headerless": bool(found.get("headerless"))} if columns else None


# ------------------------------------------------------------------ profiles
# Cell patterns counted per column.
PATTERNS = {
    "numeric": r"^\+?\d+$",
    "price": r"^\d{3,}$|^\.$|^(?i:CNY)",
    "star_word": "颗星",
    "star_number": r"^\d\.\d",
    "rank": r"^\+?\d{1,4}$",
    "bought": "(?i)购买|past month|month|bought",
    "shipping": "(?i)配送|shipping|预计|送达|delivery",
    "list_price": "(?i)市场价|list price|was price",
    "size": "(?i)尺码|尺寸|选项:",
    "review": r"万|\([\d.]+万\)|,\d{3,}|^\([\d.]+\)$",
    "review_half": r"^-\d+$",
    "size_count": r"^\d{1,2}$",
    "kinds": "种",
    "cny": "(?i)^CNY",
    "digits": r"^\d+$",
    "dot": r"^[.．]$",
    "cents": r"^\d{1,2}$",
    "bracket": r"万|\(",
}


def profile_columns(df: DataFrame, sample: int | None = None, has_header: bool = True) -> DataFrame:
    """Mean cell length and the share of cells matching each pattern, one row per column.

    Looks at the whole table, or at ``sample`` rows of it if given; one pass either way."""
    src = df if has_header else headerless(df)
    names = src.columns
    if sample:
        src = src.limit(sample)
    cells = []
    for i, n in enumerate(names):
        text = collapse_ws(cell_text(F.col(f"`{n}`"), src.schema[n].dataType))
        cells.append(F.when(text != "", text).alias(f"c{i}"))
    aggs = []
    for i in range(len(names)):
        c = F.col(f"c{i}")
        hit = {k: c.rlike(p) for k, p in PATTERNS.items()}
        hit["star"] = hit["star_word"] | (hit["star_number"] & (F.coalesce(c.try_cast("double"), F.lit(9.0)) <= 5))
        weights = {k: h.cast("double") for k, h in hit.items()}
        weights["review"] = weights["review"] + weights["review_half"] * 0.5
        aggs += [F.count(c).alias(f"filled{i}"), F.coalesce(F.avg(F.length(c)), F.lit(0.0)).alias(f"mean_length{i}")]
        aggs += [F.coalesce(F.avg(w), F.lit(0.0)).alias(f"{k}{i}") for k, w in weights.items()]
    keep = ["filled", "mean_length", *PATTERNS, "star"]
    entry = [
        F.struct(F.lit(i).alias("idx"), F.lit(letter(i)).alias("letter"), *[F.col(f"{k}{i}").alias(k) for k in keep])
        for i in range(len(names))
    ]
    return src.select(*cells).agg(*aggs).select(F.explode(F.array(*entry)).alias("e")).select("e.*")


def _over(x: float) -> float:
    return math.nextafter(x, math.inf)


ANY = math.inf
# How much each measure of a column counts for a role, what a measure in [low, high) adds, what rules a column out,
# and the least score.  ``left`` and ``right`` are a column's places from either end, ``tail`` its place from the right in wide tables.
ROLES: dict[str, dict] = {
    "排名": {"weights": {"rank": 2}, "adds": [("left", 0, 1, 0.3)]},
    "标题": {
        "weights": {"mean_length": 0.08},
        "adds": [("price", -ANY, 0.3, 0.2), ("left", 1, 2, 0.6), ("left", 2, 4, 0.1), ("left", 4, ANY, -0.2)],
        "never": [("bought", _over(0.2), ANY), ("rank", _over(0.5), ANY), ("left", 0, 1)],
    },
    "售价": {"merged": True, "coerce": "number"},
    "评分": {"weights": {"star": 3}, "coerce": "number"},
    "尺码数": {
        "weights": {"size_count": 2.5},
        "adds": [("left", 0, 7, 0.35)],
        "never": [("kinds", _over(0), ANY), ("left", 0, 2), ("left", 13, ANY), ("price", _over(0.4), ANY), ("size_count", -ANY, 0.4)],
    },
    "评论数": {
        "weights": {"review": 3, "rank": -1},
        "adds": [("mean_length", 5, ANY, 0.15)],
        "never": [("price", _over(0.5), ANY), ("short_digits", 1, ANY)],
        "coerce": "number", "as_text": ("bracket", _over(0), ANY),
    },
    "月购买": {"weights": {"bought": 3}, "never": [("bought", -ANY, 0.3)]},
    "市场价": {
        "weights": {"list_price": 3, "price": 0.3},
        "adds": [("tail", 0, 10, 0.4)],
        "never": [("bought", _over(0.2), ANY), ("review", _over(0.3), ANY)],
        "coerce": "number",
    },
    "配送费": {"weights": {"shipping": 3}, "adds": [("tail", 0, 4, 0.5), ("right", 0, 1, 0.3)], "coerce": "number"},
}
LEAST_SCORE = 0.05
WIDE = 18
# What the neighbouring columns of one price hold, and how many of them are no part of the number.
PRICE_RUNS = (("cny digits dot cents", 1), ("digits dot cents", 0), ("cny digits dot|cents", 1))


def _measures(profile: DataFrame) -> list[dict]:
    """The profile's rows in column order with the places and marks that roles look at."""
    made = sorted((r.asDict() for r in profile.collect()), key=lambda r: r["idx"])
    width = len(made)
    for c in made:
        c["left"], c["right"] = c["idx"], width - 1 - c["idx"]
        c["tail"] = c["right"] if width >= WIDE else ANY
        c["short_digits"] = float(c["filled"] > 0 and c["digits"] == 1 and c["mean_length"] <= 4)
    return made


def _suits(column: dict, role: dict) -> float:
    """Weighted sum of a column's measures and additions; minus infinity where something rules it out."""
    if any(low <= column[m] < high for m, low, high in role.get("never", ())):
        return -ANY
    return sum(w * column[m] for m, w in role["weights"].items()) + sum(x for m, low, high, x in role.get("adds", ()) if low <= column[m] < high)


def _price_run(columns: list[dict]) -> list[int]:
    """Numbers of free neighbouring columns that spell a price, the first kind of run found anywhere."""
    for run, skipped in PRICE_RUNS:
        wanted = [w.split("|") for w in run.split()]
        for line in zip(*(columns[k:] for k in range(len(wanted))), strict=False):
            if not any(c["taken"] or not c["filled"] for c in line) and all(any(c[w] == 1 for w in ws) for c, ws in zip(line, wanted, strict=True)):
                return [c["idx"] for c in line][skipped:]
    return []


def infer_projection(profile: DataFrame, targets: Sequence[str]) -> list[dict]:
    """A spec list for ``project``: roles take the free column that suits them best, in the order of ROLES.

    Works on the profile table only (one row per column).  Too few hits raise."""
    if not targets:
        raise ValueError("name the target columns")
    columns = [c | {"taken": False} for c in _measures(profile)]
    if len(columns) < 2:
        raise ValueError("the table is too narrow to infer a projection")
    specs = {}
    for name, role in ROLES.items():
        if name not in targets:
            continue
        if role.get("merged"):
            chosen = _price_run(columns)
            spec: dict = {"as": name, "merge": chosen, "separator": ""}
        else:
            best = max((c for c in columns if not c["taken"]), key=lambda c: _suits(c, role), default=None)
            chosen = [best["idx"]] if best is not None and _suits(best, role) > LEAST_SCORE else []
            spec = {"as": name, "from": chosen[0] if chosen else None}
        if not chosen:
            continue
        mark, low, high = role.get("as_text", ("idx", ANY, ANY))
        if "coerce" in role and not any(low <= columns[k][mark] < high for k in chosen):
            spec["coerce"] = role["coerce"]
        specs[name] = spec
        for k in chosen:
            columns[k]["taken"] = True
    if len(specs) < min(3, len(targets)):
        raise ValueError(f"only {len(specs)} of {len(targets)} targets found; give the projection explicitly")
    return [specs[t] for t in targets if t in specs]
