"""CSV feeds in mixed encodings: read, map headers, canonicalise, conform."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions import columns as C
from tablework.operators.reshape import drop_blank_rows
from tablework.sources import quoted

# Feed columns as (name, type, required) and their known header spellings.
FEEDS = {
    "orders": (
        ("order_id", "string", True), ("order_date", "date", True), ("platform_sku", "string", True), ("asin", "string", False),
        ("quantity", "number", True), ("item_price", "number", True), ("currency", "string", True), ("order_status", "string", False),
        ("is_refund", "boolean", False), ("biz_date", "date", True), ("marketplace_id", "string", False),
        ("traffic_source_tag", "string", False), ("rate_lock_type", "string", False), ("raw_erp_status", "string", False),
    ),
    "ads": (
        ("ad_date", "date", True), ("platform_sku", "string", True), ("campaign_id", "string", False), ("spend", "number", True),
        ("currency", "string", True), ("impressions", "number", False), ("clicks", "number", False), ("biz_date", "date", True),
        ("parent_sku", "string", False), ("shop_id", "string", False), ("attribution_model", "string", False),
        ("raw_erp_status", "string", False),
    ),
    "inventory": (
        ("snapshot_date", "date", True), ("platform_sku", "string", True), ("quantity_on_hand", "number", True),
        ("warehouse", "string", False), ("marketplace_id", "string", False),
    ),
}
PRIMARY_KEYS = {
    "orders": ("platform_sku", "biz_date"), "ads": ("platform_sku", "biz_date"), "inventory": ("platform_sku", "snapshot_date"),
}
ALIASES = {
    "order_id": ("订单号", "orderid"), "order_date": ("order date", "成交日"), "platform_sku": ("sku", "seller_sku"),
    "quantity": ("qty", "数量"), "item_price": ("price", "单价", "item price"), "currency": ("币种",),
    "order_status": ("status", "订单状态"), "is_refund": ("refund", "退款"), "ad_date": ("click_date", "date", "点击日"),
    "campaign_id": ("campaign",), "spend": ("cost", "广告费"), "impressions": ("展示",), "clicks": ("点击",),
    "quantity_on_hand": ("on_hand", "qty", "库存"), "warehouse": ("仓",), "snapshot_date": ("date", "快照日"),
}
_TYPES = {"string": "string", "number": "double", "date": "date", "boolean": "boolean"}


def _feed(feed: str):
    if feed not in FEEDS:
        raise ValueError(f"unknown feed {feed!r}; feeds: {', '.join(FEEDS)}")
    return FEEDS[feed]


def header_key(name: str) -> str:
    return str(name or "").strip().lower().replace(" ", "_")


def map_header_aliases(df: DataFrame, feed: str, on_clash: str = "raise") -> DataFrame:
    """Raw headers to feed names; unknown columns go.  Two headers for one name raise, or the last wins."""
    wanted = [n for n, _, _ in _feed(feed)]
    known = {header_key(a): n for n in wanted for a in (n, *ALIASES.get(n, ()))}
    chosen: dict[str, str] = {}
    for raw in df.columns:
        name = known.get(header_key(raw))
        if name is None:
            continue
        if name in chosen and on_clash != "last":
            raise ValueError(f"columns {chosen[name]!r} and {raw!r} both mean {name!r}")
        chosen[name] = raw
    return df.select(*[F.col(f"`{raw}`").alias(n) for n, raw in chosen.items()])


def canonicalize_feed(df: DataFrame, feed: str, keep_raw: bool = False) -> DataFrame:
    """Typed cells: sku trimmed and lower-cased, dates, numbers, booleans; ``biz_date`` from the feed's
    date.  With ``keep_raw`` number and date columns keep their text and a flag for unparsable cells."""
    out: dict[str, Column] = {}
    for name, kind, _ in _feed(feed):
        if name not in df.columns:
            continue
        c, dtype = F.col(f"`{name}`"), df.schema[name].dataType
        if name == "platform_sku":
            out[name] = C.normalize_sku(c)
        elif kind == "date":
            out[name] = C.to_date(c, dtype)
        elif kind == "number":
            out[name] = C.to_number(c, dtype, currency=True)
        elif kind == "boolean":
            out[name] = C.to_bool(c)
        else:
            out[name] = C.trim_ws(c.cast("string"))
        if keep_raw and kind in ("date", "number"):
            out[f"{name}_raw"] = c
            out[f"{name}_bad"] = ~C.is_blank(c) & out[name].isNull()
    source = {"orders": "order_date", "ads": "ad_date", "inventory": "snapshot_date"}[feed]
    if source in out and feed != "inventory":
        own = out.get("biz_date")
        out["biz_date"] = F.coalesce(out[source], own) if own is not None else out[source]
    return df.select(*[c.alias(n) for n, c in out.items()])


def conform(df: DataFrame, feed: str) -> DataFrame:
    """Exactly the feed's columns, in order and type; absent ones are NULL."""
    return df.select(
        *[(F.col(n) if n in df.columns else F.lit(None)).cast(_TYPES[t]).alias(n) for n, t, _ in _feed(feed)]
    )


@F.pandas_udf(T.BooleanType())
def _decodes_as_gbk(line: pd.Series) -> pd.Series:
    def ok(raw) -> bool:
        try:
            bytes(raw or b"").decode("gbk")
            return True
        except UnicodeDecodeError:
            return False

    return line.map(ok)


def route_by_charset(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``(file, charset, multiline)`` per file: UTF-8, else GBK, else Latin-1.

    Reads the raw lines in splits, so large files are checked by many tasks; only lines that are not
    UTF-8 reach Python.  ``multiline`` is set where a quoted cell spans lines."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    # The text source keeps the bytes of a line as they are.
    lines = spark.read.text(paths).select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("raw"))
    lines = lines.withColumns(
        {"utf8": F.is_valid_utf8(F.col("raw").cast("string")), "odd": F.regexp_count(F.col("raw").cast("string"), F.lit('"')) % 2 == 1}
    )
    good = lines.filter("utf8").groupBy("file").agg(F.bool_or("odd").alias("odd"))
    bad = lines.filter("not utf8").withColumn("gbk", _decodes_as_gbk("raw")).groupBy("file").agg(
        F.bool_and("gbk").alias("gbk"), F.bool_or("odd").alias("odd_bad")
    )
    charset = F.when(F.col("gbk").isNull(), "UTF-8").when(F.col("gbk"), "GBK").otherwise("ISO-8859-1")
    odd = F.coalesce("odd", F.lit(False)) | F.coalesce("odd_bad", F.lit(False))
    return good.join(bad, "file", "full_outer").select("file", charset.alias("charset"), odd.alias("multiline"))


def read_csv_parts(spark: SparkSession, paths: Sequence[str] | str, **options) -> list[DataFrame]:
    """One DataFrame of text columns per charset and header among the files."""
    routes = route_by_charset(spark, paths).collect()  # one row per file, like the file listing itself
    if not routes:
        raise ValueError("no lines found")
    groups: dict[tuple[str, bool], list[str]] = {}
    for r in routes:
        groups.setdefault((r["charset"], r["multiline"]), []).append(r["file"])
    if any(cs == "GBK" for cs, _ in groups):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    parts = []
    for (charset, multiline), files in sorted(groups.items()):
        reader = spark.read.options(header=True, encoding=charset, multiLine=multiline, escape='"', **options)
        # Files with different headers must not be read under one header.
        for same in _by_header(spark, files):
            if multiline and set(options) <= {"sep"}:
                parts.append(quoted.read_quoted(spark, same, charset, options.get("sep", ",")))
            else:
                parts.append(reader.csv(same))
    return parts


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv_any_charset(spark: SparkSession, paths: Sequence[str] | str, **options) -> DataFrame:
    """All files as text columns, each read in its own charset; columns are united by name."""
    return _united(read_csv_parts(spark, paths, **options))


def _by_header(spark: SparkSession, files: list[str]) -> list[list[str]]:
    """File names grouped by their first line."""
    if len(files) == 1:
        return [files]
    rows = spark.read.text(files).select(
        F.input_file_name().alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value"
    )
    firsts = rows.filter("at = 0").groupBy("f").agg(F.min_by(F.hex("value"), "i").alias("head"))
    heads: dict[str, list[str]] = {}
    for r in sorted(firsts.collect(), key=lambda r: r["f"]):
        heads.setdefault(r["head"], []).append(r["f"])
    return list(heads.values())


def load_feed(spark: SparkSession, path: Sequence[str] | str, feed: str, on_clash: str = "raise") -> DataFrame:
    """Files of a feed as its canonical table; rows without any text are dropped."""
    raw = [map_header_aliases(drop_blank_rows(p), feed, on_clash) for p in read_csv_parts(spark, path)]
    return _united([conform(canonicalize_feed(p, feed), feed) for p in raw])


def source_fingerprint(spark: SparkSession, path: Sequence[str] | str) -> DataFrame:
    """First 16 hex digits of the SHA-256 of every file."""
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", "length", F.substring(F.sha2("content", 256), 1, 16).alias("source_hash"))
