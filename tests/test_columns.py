"""Cell cleaning, names, filters and reshape: literal cases."""

import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablework.functions import columns as C
from tablework.functions import names as N
from tablework.operators import filters as L
from tablework.operators import reshape as S
from tablework.operators.infer import infer_kinds


def table(spark, **cols):
    return spark.createDataFrame(pa.table({k: pa.array(v) for k, v in cols.items()}))


def values(df, *exprs):
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_white_space_and_case(spark):
    df = table(spark, s=["  a　\t b ﻿", "o'brien  mcDONALD-x", None, "中文 ABCéd"])
    assert values(df, C.trim_ws("s"), C.collapse_ws("s"))[0] == ("a　\t b", "a b")
    assert [r[0] for r in values(df, C.normalize_text("s", "title"))] == ["A B", "O'Brien Mcdonald-X", "", "中文 AbcéD"]
    with pytest.raises(ValueError):
        C.normalize_text("s", "shout")


def test_to_number(spark):
    df = table(spark, s=["1,234", " 12.5 ", "x", "", None, " ", "1d", "Infinity", "$1,000.5", "-3e2", "0x10"])
    got = values(df, C.to_number("s"), C.number_kind("s"), C.to_number("s", currency=True))
    assert [g[0] for g in got] == [1234.0, 12.5, None, None, None, None, None, None, None, -300.0, None]
    assert [g[1] for g in got[:6]] == ["converted", "converted", "blanked", "same", "same", "blanked"]
    assert got[8][2] == 1000.5
    counts = S.coerce_counts(table(spark, 金额=["1,234", " 12.5 ", "x"]), "金额").first()
    assert (counts["same"], counts["converted"], counts["blanked"]) == (0, 2, 1)


def test_to_date(spark):
    five = datetime.date(2024, 1, 5)
    text = table(spark, s=["20240105", "2024-01-05", "2024/1/5", "2024-01-05 00:00:00 UTC", "1/5/2024", "5 Jan 2024", "bad", "", None, "2026-02-30", "20261399"])
    assert [r[0] for r in values(text, C.to_date("s"))] == [five] * 6 + [None] * 5
    num = table(spark, n=[45296.0, 20240105.0, 70000.0, 0.0, 45295.6])
    assert [r[0] for r in values(num, C.to_date("n", num.schema["n"].dataType))] == [five, five, None, None, five]
    flag = table(spark, b=[True])
    assert values(flag, C.to_date("b", flag.schema["b"].dataType)) == [(None,)]
    assert values(num.limit(1), C.day_to_iso(F.lit(45296))) == [("2024-01-05",)]


def test_plain_numbers_ids_and_booleans(spark):
    df = table(spark, n=[1e7, 10.0, 0.00012, 1234567890123456.0, -2.5, 1.0e-5])
    assert [r[0] for r in values(df, C.number_to_plain_text("n"))] == ["10000000", "10", "0.00012", "1234567890123456", "-2.5", "0.00001"]
    ids = table(spark, v=[123456789012345.0], t=["1.23457E+14"], u=["000123"])
    t = ids.schema["v"].dataType
    assert values(ids, C.to_id_text("v", t, F.col("t")), C.to_id_text("v", t, F.col("u"))) == [("123456789012345", "000123")]
    words = table(spark, s=[" TRUE", "是", "y", "no", None])
    assert [r[0] for r in values(words, C.to_bool("s"))] == [True, True, True, False, False]


def test_names():
    assert [N.letter(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert N.letter_index("aa") == 26
    cols = ["title", "Price", "订单 金额"]
    assert [N.resolve_column(cols, r) for r in (1, "title", "PRICE", "C", "2")] == ["Price", "title", "Price", "订单 金额", "Price"]
    with pytest.raises(ValueError, match="existing columns"):
        N.resolve_column(cols, "no such")
    with pytest.raises(ValueError):
        N.resolve_column(cols, "Z")
    assert N.match_field("金额", cols) == "订单 金额"
    assert N.unique_headers(["a", "", "a", None]) == ["a", "列2", "a_2", "列4"]
    assert N.infer_join_keys(["x", "订单号"], ["订单号", "x"]) == ["订单号"]
    with pytest.raises(ValueError):
        N.infer_join_keys(["a", "b"], ["b", "a"])
    assert N.infer_value_column(["类别", "金额", "z"], "类别") == "金额"
    with pytest.raises(ValueError):
        N.aggregation("median")


def test_dedupe_keeps_first(spark):
    df = table(spark, id=["a ", "a", "B", "b", None, ""], n=[1, 2, 3, 4, 5, 6])
    assert rows(S.dedupe(df, ["id"], ["n"]).select("n")) == [(1,), (3,), (4,), (5,)]
    assert S.dedupe_counts(df, ["id"]).first().asDict() == {"source_rows": 6, "kept": 4, "dropped": 2}
    with pytest.raises(ValueError, match="existing columns"):
        S.dedupe(df, ["zz"])


def test_extract_unpivot_split(spark):
    df = table(spark, 店铺=[" Amazon ", "", "tmall", None, "AMAZON"])
    assert rows(S.extract_columns(df, ["店铺"], unique=True)) == [("Amazon",), ("Tmall",)]
    counts = S.extract_counts(df, ["店铺"]).first()
    assert (counts["source_rows"], counts["blank_dropped"], counts["unique_dropped"]) == (5, 2, 1)
    wide = table(spark, id=["x"], a=[1], b=["t"], c=[None])
    assert S.unpivot(wide.withColumn("c", F.lit(None).cast("long"))).columns == ["id", "属性", "值"]
    assert rows(S.unpivot(wide.drop("c"))) == [("x", "a", "1"), ("x", "b", "t")]
    tags = table(spark, 姓名=["p", "q", "r"], 标签=["a,b , c", "d", None])
    out = S.split_column(tags, "标签")
    assert out.columns == ["姓名", "标签_1", "标签_2", "标签_3"]
    assert rows(out) == [("p", "a", "b", "c"), ("q", "d", "", ""), ("r", "", "", "")]
    assert rows(S.split_column(table(spark, s=["a|b|c"]), "s", "|", 2)) == [("a", "b")]


def test_find_replace(spark):
    df = table(spark, s=["Foo foo", "bar", "a.b"])
    assert [r[0] for r in values(S.find_replace(df, "FOO", "x$1"), "s")] == ["x$1 x$1", "bar", "a.b"]
    assert [r[0] for r in values(S.find_replace(df, "Foo", "x", match_case=True), "s")] == ["x foo", "bar", "a.b"]
    assert [r[0] for r in values(S.find_replace(df, "BAR", "z", whole=True), "s")] == ["Foo foo", "z", "a.b"]
    assert S.replace_counts(df, "b", "c").first()[0] == 2
    with pytest.raises(ValueError):
        S.find_replace(df, "", "x")


def test_filters(spark):
    df = table(spark, n=[1, 2, 3, None], s=["Apple", "pineapple", "", None])
    keep = lambda **f: rows(L.filter_rows(df, [f]).select("n"))
    assert keep(column="n", op=">=", value="2") == [(2,), (3,)]
    assert keep(column="n", op="not equal", value=2) == [(1,), (3,), (None,)]
    assert keep(column="n", op="between", value=1, value2=2) == [(1,), (2,)]
    assert keep(column="S", op="begins_with", value="APP") == [(1,)]
    assert keep(column="s", op="contains", value="APP") == [(1,), (2,)]
    assert keep(column="s", op="is empty") == [(3,), (None,)]
    assert rows(L.filter_rows(df, [{"column": "s", "op": "contains", "value": "p*le"}], wildcard=True).select("n")) == [(1,), (2,)]
    assert keep(column="s", op="contains", value="p*le") == []
    with pytest.raises(ValueError, match="unsupported"):
        L.operator("like")
    down = L.sort_rows(df, [{"column": "n", "order": "descending"}]).collect()
    assert [r["n"] for r in down] == [3, 2, 1, None]
    assert rows(L.top_n(table(spark, v=[5, 5, 4, 1]), "v", 2)) == [(5,), (5,)]


def test_top_n_sends_no_row_to_a_single_task(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") > 3, F.col("id") % 7))
    out = L.top_n(df, "v", 3)
    assert {r["v"] for r in out.collect()} == {6} and out.count() == 14
    assert {r["v"] for r in L.top_n(df, "v", 3, top=False).collect()} == {0}
    assert L.top_n(df.filter("v is null"), "v", 3).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "TakeOrderedAndProject" in plan


def test_infer_kinds(spark):
    df = table(
        spark, 运单号=["1", "2"], code=["002", "010"], rate=["0.25", "0.5"], 日期天数=["120", "365"], 时间=["2024-01-05", "x"], 折扣率=["a", "b"],
        sku_list=["SF123456789012", "x"], 备注=["hello", None], price=["¥1,200", "n/a"],
    )
    got = {r["column"]: r["kind"] for r in infer_kinds(df).collect()}
    assert got == {
        "运单号": "id_text", "code": "plain_text", "rate": "amount", "日期天数": "amount", "时间": "datetime", "折扣率": "percent", "sku_list": "id_text",
        "备注": "plain_text", "price": "amount",
    }
    out = S.coerce_columns(df.select("运单号", "时间", "price", "备注")).first()
    assert tuple(out) == ("1", datetime.date(2024, 1, 5), 1200.0, "hello")


def test_attach_master_rows(spark):
    df = table(spark, n=[1, 2, 3, 4, 5], kind=["d", "m", "d", "m", "d"], plan=["x", "P1", "y", None, "z"])
    out = S.attach_master_rows(df, F.col("kind") == "m", ["plan"], ["n"]).select("n", "master_plan")
    assert rows(out) == [(1, None), (2, "P1"), (3, "P1"), (4, None), (5, None)]
