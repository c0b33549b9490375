"""Lookups, pivots, pricing, finance, quality and projections: literal cases."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablework.operators import aggregate as A
from tablework.operators import finance as P
from tablework.operators import headers as H
from tablework.operators import infer as I
from tablework.operators import lookup as J
from tablework.operators import project as PR
from tablework.operators import quality as Q
from tablework.operators import rating as RT
from tablework.operators import reshape as S
from tablework.operators import windows as W
from tablework.plans.flows import calculate_flow, project_flow, reconcile_flow, reshape_flow, run_flow


def table(spark, **cols):
    return spark.createDataFrame(pa.table({k: pa.array(v) for k, v in cols.items()}))


def test_lookup_first_match_any_case(spark):
    left = table(spark, 订单号=["a1", "B2", "c3", None], 客户=["x", "y", "z", "w"])
    right = table(spark, 订单号=["A1", "a1", "b2 "], 金额=[10, 20, 30], 客户=["r", "s", "t"], n=[1, 2, 3])
    out = J.lookup(left, right, "订单号", ["金额", "客户"], ["n"])
    assert out.columns == ["订单号", "客户", "金额", "客户_lookup"]
    assert rows(out) == [("B2", "y", 30, "t"), ("a1", "x", 10, "r"), ("c3", "z", None, None), (None, "w", None, None)]
    exact = J.lookup(left, right, "订单号", ["金额"], ["n"], case_sensitive=True)
    assert rows(exact.select("金额")) == [(20,), (None,), (None,), (None,)]


def test_tier_lookup_list_and_ordered_forms_agree(spark):
    df = table(spark, w=[0.5, 1.0, 7.0, 99.0, None, 3.0], zone=["a", "a", "b", "a", "a", "zz"])
    tiers = table(spark, tier=[1.0, 5.0, 2.0], price=[10.0, 50.0, 7.0], zone=["a", "a", "b"])
    want = [(0.5, None, False), (1.0, 10.0, True), (3.0, None, False), (7.0, 7.0, True), (99.0, 50.0, True), (None, None, False)]
    assert rows(J.tier_lookup(df, tiers, "w", "tier", ["price"], ["zone"]).select("w", "price", "tier_found")) == want
    spark.conf.set("spark.tablework.broadcastBytes", "0")
    try:
        assert rows(J.tier_lookup(df, tiers, "w", "tier", ["price"], ["zone"]).select("w", "price", "tier_found")) == want
    finally:
        spark.conf.unset("spark.tablework.broadcastBytes")


@pytest.mark.parametrize(("by", "tile", "split"), [([], 3, False), (["z"], 3, False), ([], 256, True), (["z"], 2, True)])
def test_tier_lookup_equals_a_plain_search(spark, by, tile, split, monkeypatch, request):
    """Random breakpoints, equal ones among them, in tiles of a few rows and with shuffled joins; NaN is above all, null fits nothing."""
    monkeypatch.setattr(J, "TILE", tile)
    if split:
        request.getfixturevalue("split_groups")
    rng = random.Random(tile)
    zone = lambda: rng.choice(["a", "b", "c", None])
    tiers = [(rng.choice([None, -1.0, *(x / 2 for x in range(60))]), zone(), rng.randrange(1000)) for _ in range(70)]
    values = [(i, rng.choice([None, float("nan"), -5.0, 1e9, *(x / 4 for x in range(140))]), zone()) for i in range(300)]
    df = spark.createDataFrame(values, "id long, v double, z string")
    out = J.tier_lookup(df, spark.createDataFrame(tiers, "t double, z string, p int"), "v", "t", ["p"], by)
    want = {}
    for i, v, z in values:
        able = [(t, p) for t, y, p in tiers if t is not None and v is not None and (t <= v or v != v) and (not by or (z is not None and y == z))]
        want[i] = max(able)[1] if able else None
    assert {r["id"]: r["p"] for r in out.collect()} == want
    assert out.filter("tier_found != (p IS NOT NULL)").count() == 0 and out.columns == ["id", "v", "z", "tier_found", "p"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    none = J.tier_lookup(df, spark.createDataFrame([], "t double, z string, p int"), "v", "t", ["p"], by)
    assert none.count() == 300 and none.filter("tier_found").count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_quantiles_equal_the_plain_form(spark, split, request):
    if split:
        request.getfixturevalue("split_groups")
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)])) for _ in range(400)] + [("one", 7)]
    df = spark.createDataFrame(data, "g string, v int")
    asked = {"lo": 0.0, "q": 0.3, "mid": 0.5, "hi": 1.0}
    for by in (["g"], []):
        out = A.price_distribution(df, by, "v", asked)
        groups = {g for g, v in data if v is not None} if by else {None}
        want = []
        for g in groups:
            x = sorted(v for h, v in data if v is not None and (not by or h == g))
            cut = lambda p, x=x: x[int((len(x) - 1) * p)] + ((len(x) - 1) * p - int((len(x) - 1) * p)) * (x[min(len(x) - 1, int((len(x) - 1) * p) + 1)] - x[int((len(x) - 1) * p)])
            want.append((*([g] if by else []), len(x), x[0], *(round(float(cut(p)), 6) for p in asked.values()), x[-1]))
        got = [tuple(round(c, 6) if isinstance(c, float) else c for c in r) for r in out.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert A.price_distribution(df.filter("false"), ["g"], "v").count() == 0


def test_pivot_with_every_subtotal(spark):
    df = spark.createDataFrame([("a", "x", "p", 1), ("a", "y", "p", 2), ("b", "x", "q", 4), (None, "x", "total", 8)], "r string, s string, c string, v int").withColumn("d", F.col("s"))
    out = A.pivot_table(df, ["r", "s"], ["c", "d"], [{"field": "v"}], totals="all")
    got = {(r["r"], r["s"], r["__rolled"]): r for r in out.collect()}
    assert len(got) == 4 + 3 + 2 + 1
    whole = got[(None, None, 3)]
    assert (whole["total_sum_v"], whole["total_x_sum_v"], whole["p_total_sum_v"], whole["p_y_sum_v"]) == (15, 8, 3, 2)
    assert whole["total_x_2_sum_v"] == 13  # a value that reads like a total keeps its own column
    assert got[(None, "x", 2)]["total_sum_v"] == 13 and got[("a", None, 1)]["p_total_sum_v"] == 3 and got[(None, None, 1)]["total_sum_v"] == 8
    with pytest.raises(ValueError, match="totals"):
        A.pivot_table(df, ["r"], [], [{"field": "v"}], totals="some")


def test_sum_by_and_weighted(spark):
    df = table(spark, 类别=["食品", " 食品", "饮料", "", None], 金额=[10, 5, 8, 1, 1], n=[1, 2, 3, 4, 5])
    assert rows(A.sum_by(df, "类别", "金额", order_by=["n"])) == [("食品", 15), ("饮料", 8)]
    assert rows(calculate_flow(df, "sum", group="类别", order_by=["n"])) == [("食品", 15), ("饮料", 8)]
    w = table(spark, s=[0.25, 0.75], p=[8.0, 4.0])
    assert A.weighted_avg(w, "s", "p", divide=False).first()[0] == 5.0
    assert A.weighted_avg(w, "s", "p", floor=7.81).first()[0] == 7.81


def test_pivot_with_totals(spark):
    df = table(spark, r=["a", "a", "b"], c=["x", "y", "x"], v=[1, 2, 4])
    out = A.pivot_table(df, ["R"], ["c"], [{"field": "v", "aggregation": "求和"}], totals=True)
    assert out.columns == ["r", "x_sum_v", "y_sum_v", "total_sum_v", "__level"]
    assert rows(out) == [("a", 1, 2, 3, 0), ("b", 4, None, 4, 0), (None, 5, 2, 7, 1)]
    with pytest.raises(ValueError):
        A.pivot_table(df, [], [], [{"field": "v"}])
    with pytest.raises(ValueError, match="existing columns"):
        A.pivot_table(df, ["zz"], [], [{"field": "v"}])


def test_non_monotonic_and_repeat(spark):
    df = table(spark, zone=["2", "2", "2", "3"], w=[10, 51, 60, 1], price=[8.43, 6.98, 7.5, 1.0])
    assert rows(W.flag_non_monotonic(df, ["zone"], ["w"], "price").filter("inverted").select("w")) == [(51,)]


def test_rate_shipments(spark):
    rates = table(spark, zone=["2", "2"], tier=[1.0, 11.0], price=[5.0, 9.0])
    ship = table(spark, id=[1, 2, 3], l=[50.0, 10.0, 10.0], w=[40.0, 10.0, 10.0], h=[33.0, 10.0, 10.0], kg=[3.2, 0.4, 2.0], zone=["2", "2", "9"], addr=["Residential", "commercial", "x"])
    rules = [
        {"measure": "l", "op": "gt", "value": 48, "amount": 20.0},
        {"measure": "kg", "op": "gte", "value": 0, "residential": 2.48, "commercial": 0.0, "probability": 0.5},
    ]
    out = RT.rate_shipments(ship, rates, "l", "w", "h", "kg", "zone", 6000, 0.25, rules, "addr").select("id", "billable_weight", "base_price", "surcharges", "fuel", F.round("total", 6), "tier_found")
    assert rows(out) == [(1, 11.0, 9.0, 21.24, 2.25, 32.49, True), (2, 1.0, 5.0, 0.0, 1.25, 6.25, True), (3, 2.0, None, 0.0, None, None, False)]


def test_scenarios_refuse_computed_columns(spark):
    df = table(spark, rev=["100"], x=[1])
    with pytest.raises(ValueError, match="overwrite"):
        P.apply_assumption_overrides(df, {"s": {"net_profit": 1.0}}, ["net_profit"])
    with pytest.raises(ValueError, match="unknown input"):
        P.apply_assumption_overrides(df, {"s": {"nope": 1.0}})
    out = P.apply_assumption_overrides(df, {"a": {}, "b": {"refund_rate": 0.2}}).select("scenario", F.col("refund_rate").cast("double"))
    assert rows(out) == [("a", 0.08), ("b", 0.2)]


def test_quality(spark):
    df = table(spark, id=["1", "2", "3"], a=["x", "#N/A", ""], n=[1, None, 3])
    assert rows(Q.classify_cells(df)) == [("a", 1, 1, 0, 1), ("id", 0, 0, 3, 0), ("n", 1, 0, 2, 0)]
    assert rows(Q.scan_error_tokens(df, ["id"])) == [("2", "a", "#N/A")]
    rules = [{"column": "a", "type": "list", "source": "x,y", "allow_blank": False, "message": "pick"}, {"column": "n", "type": "whole", "operator": "notbetween", "formula1": 2, "formula2": 4}]
    assert rows(Q.validate(df, rules, ["id"])) == [("2", 0, "a", "#N/A", "pick"), ("3", 0, "a", "", "pick"), ("3", 1, "n", "3", "")]
    with pytest.raises(ValueError, match="source"):
        Q.rule_test(df, {"column": "a", "type": "list"})
    with pytest.raises(ValueError, match="bounds"):
        Q.rule_test(df, {"column": "n", "type": "whole", "formula1": 1})
    assert [tuple(r) for r in Q.profile_table(df).select("letter", "column", "samples").collect()][1] == ("B", "a", ["x", "#N/A", ""])


def test_flatten_header():
    three = [["Harvest", None, None, "Site", ""], ["Harvest weight", "Harvest (gross)", "crates", "Site", None], [None, "kg", "", "geo.lat", "Remark"]]
    assert H.flatten_names(three) == ["Harvest_weight", "Harvest_gross_kg", "Harvest_crates", "geo_lat", "Site_Remark"]
    assert H.flatten_names([["Net", "Net", None], ["", "", ""]]) == ["Net", "Net_2", "Net_3"]
    assert H.flatten_names([["v. 2 (beta)"], ["v2beta"]]) == ["v2beta"]
    assert H.flatten_names([[None, "x"], [None]]) == ["列1", "x"] and H.flatten_names([]) == []


def test_flatten_and_pick_on_grid(spark):
    grid = spark.createDataFrame([(0, ["g", ""]), (1, ["运单号", "n"]), (2, ["007", "1"])], "row_idx long, cells array<string>")
    assert H.flatten_header(grid, 2).columns == ["row_idx", "g_运单号", "g_n"]
    assert rows(H.pick_header_row(grid, 2, 2)) == [(2, "007", "1")]
    with pytest.raises(ValueError):
        H.flatten_header(grid, 9)


def scrape(spark):
    cols = {
        "c0": ["+1", "+2", "3"], "c1": ["Long product title number one", "Another quite long product title", "Third title of a product"], "c2": ["x", "y", "z"], "c3": ["5", "7", "9"],
        "c4": ["CNY", "CNY", "CNY"], "c5": ["67", "50", "120"], "c6": [".", ".", "."], "c7": ["29", "00", "50"], "c8": ["4.5 颗星", "4.1 颗星", "3.9 颗星"], "c9": ["(1.2万)", "(3万)", "(2,345)"],
        "c10": ["过去一个月有1千+顾客购买", "100+ bought in past month", "50+ bought"], "c11": ["市场价: 99", "市场价: 88", "list price 150"], "c12": ["配送费 10", "shipping 12", "delivery 9"],
    }
    return table(spark, **cols)


def test_infer_projection(spark):
    targets = ["排名", "标题", "尺码数", "评分", "评论数", "月购买", "售价", "市场价", "配送费"]
    specs = {s["as"]: s for s in PR.infer_projection(PR.profile_columns(scrape(spark)), targets)}
    at = {k: s.get("from", s.get("merge")) for k, s in specs.items()}
    assert at == {"排名": 0, "标题": 1, "尺码数": 3, "评分": 8, "评论数": 9, "月购买": 10, "售价": [5, 6, 7], "市场价": 11, "配送费": 12}
    assert "coerce" not in specs["评论数"]
    out = project_flow(scrape(spark), ["排名", "标题", "售价"])
    assert sorted(r["售价"] for r in out.collect()) == [50.0, 67.29, 120.5]
    with pytest.raises(ValueError, match="found"):
        PR.infer_projection(PR.profile_columns(table(spark, a=["q"], b=["r"])), ["排名", "尺码数", "月购买"])


def test_project_specs_and_templates(spark):
    raw = [{"as": " x ", "from": "A", "coerce": "odd"}, {"as": "", "from": 1}, {"as": "y"}, {"as": "z", "merge": ["1", 2]}]
    assert PR.normalize_specs(raw) == [{"as": "x", "from": "A"}, {"as": "z", "merge": [1, 2], "separator": ""}]
    templates = {"sheets": [{"pattern": "1688选品", "columns": [{"as": "标题", "from": "title"}]}], "hosts": {"shop.com": {"headerless": True, "columns": [{"as": "a", "from": 0}, {"as": "b", "from": 1}]}}}
    assert PR.resolve_template("我的1688选品", "", templates)["columns"] == [{"as": "标题", "from": "title"}]
    assert PR.resolve_template("取数_shop.com_2", "", templates)["headerless"]
    assert PR.resolve_template("", "https://www.shop.com/x", templates, ["b", "a"])["columns"][0]["as"] == "b"
    assert PR.resolve_template("", "https://www.shop.com/x", templates, ["q", "a"]) is None
    df = table(spark, title=["t"], __note=["n"])
    assert PR.project(df, [{"as": "标题", "from": "title"}, {"as": "__x", "from": "title"}]).columns == ["标题"]
    with pytest.raises(ValueError):
        PR.project(df, [{"as": "x"}])


def test_headerless_projection(spark):
    df = spark.createDataFrame([("2", "8", "50", ".", "00")], "`1` string, `7` string, `67` string, `.` string, `29` string")
    out = PR.project(df, [{"as": "rank", "from": "A"}, {"as": "price", "merge": [2, 3, 4], "coerce": "number"}], headerless_input=True)
    assert rows(out) == [("1", 67.29), ("2", 50.0)]
    assert H.detect_headerless(table(spark, **{"1": ["1"], "CNY": ["CNY"], "3": ["x"], "y": ["y"]}), "取数_x")


def test_flows(spark):
    left, right = table(spark, 订单号=["a"], v=[1]), table(spark, 订单号=["a"], v=[2])
    assert reconcile_flow(left, right).first()["status"] == "conflict"
    assert rows(run_flow("reshape", left, "coerce", column="v", to="text")) == [("a", "1")]
    with pytest.raises(ValueError):
        reshape_flow(left, "nope")
    with pytest.raises(ValueError):
        run_flow("nope")


def test_kinds_are_told_from_all_rows(spark):
    """Numbers first, texts later: nothing may be blanked on account of the first rows."""
    df = table(spark, v=[str(i) if i < 20 else f"word {i}" for i in range(300)], w=[str(i) for i in range(300)])
    out = S.coerce_columns(df)
    assert out.filter("v IS NOT NULL").count() == 300
    kinds = {r["column"]: r["kind"] for r in I.infer_kinds(df).collect()}
    assert kinds == {"v": "plain_text", "w": "amount"}


@pytest.mark.parametrize("tile", [1, 512])
def test_tiers_without_breakpoint_fit_nothing(spark, tile, monkeypatch):
    monkeypatch.setattr(J, "TILE", tile)
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, "a"), (3, 5.0, None), (4, 0.5, "a"), (5, 9.0, "a")], "id int, w double, z string")
    tiers = spark.createDataFrame([(None, "a", "pnull"), (1.0, None, "pn"), (1.0, "a", "p1"), (8.0, "a", "p8"), (8.0, "a", "p9"), (8.0, "a", "p7")], "t double, z string, p string")
    got = {r["id"]: (r["p"], r["tier_found"]) for r in J.tier_lookup(df, tiers, "w", "t", ["p"], ["z"]).collect()}
    assert got == {1: ("p1", True), 2: (None, False), 3: (None, False), 4: (None, False), 5: ("p9", True)}


def test_pivot_tells_fields_apart(spark):
    df = spark.createDataFrame([("a_b", "c", 1), ("a", "b_c", 10), (None, "x", 5), ("", "x", 7)], "f string, g string, v int")
    out = A.pivot_table(df, columns=["f", "g"], values=[{"field": "v", "aggregation": "sum"}]).first().asDict()
    assert sorted(out.values()) == [1, 5, 7, 10] and len(out) == 4


def test_embedding_holds_few_grams_at_a_time():
    """A batch of long texts is embedded piece by piece; pieces of one text give the vector of the whole."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from tablework.functions import text as X

    texts = pd.Series(["Some words é🙂 and more of them. " * 100] * 1000 + [None, "", "a", "ab"])
    tracemalloc.start()
    vectors = X.hash_embed.func(texts)
    assert tracemalloc.get_traced_memory()[1] < 250 << 20
    tracemalloc.stop()
    cleaned = [X.clean(t) for t in texts[-8:]]
    assert np.array_equal(np.stack(vectors[-8:]), X.embed_batch(*X.packed_grams(cleaned), 8))
    assert np.array_equal(X.embed_texts(cleaned, 7), np.stack(vectors[-8:]))


def test_rows_of_a_failing_batch_come_back_together(spark):
    """One frame of good rows and one of failing ones for a batch, not one for each half."""
    from tablework.functions.registry import FunctionRegistry

    reg = FunctionRegistry(spark)
    reg.register("user.check", lambda pdf: pdf.assign(v=[100 / (i % 10) for i in pdf["id"]]), "id long, v double", "rows")
    out = reg.apply_rows("user.check", spark.range(0, 500, 1, 1)).collect()
    assert [r["status"] for r in out] == ["ok"] * 450 + ["error"] * 50
    assert all(r["v"] == 100 / (r["id"] % 10) for r in out[:450]) and all(r["v"] is None and r["error"] for r in out[450:])
