"""Feeds, JSON, HTML, grids, ingest, sinks, retrieval, streams and user functions."""

import datetime
import glob
import json
import math
import random
import time
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablework.functions import text as X
from tablework.functions import urls as U
from tablework.functions.registry import FunctionRegistry
from tablework.operators import retrieval as T
from tablework.operators import windows as W
from tablework.plans.queries import QUERIES
from tablework.sources import feeds as FD
from tablework.sources import grids as G
from tablework.sources import html as HT
from tablework.sources import ingest as N
from tablework.sources import json_tables as JT
from tablework.sources import quoted
from tablework.sources import sinks as K
from tablework.session import checkpointed
from tablework.streaming.streams import dedupe_stream, flag_repeat_fetch_stream, ingest_stream


def table(spark, **cols):
    return spark.createDataFrame(pa.table({k: pa.array(v) for k, v in cols.items()}))


def test_feed_in_three_charsets(spark, tmp_path):
    text = "订单号,成交日,sku,数量,单价,币种\n{},2026-01-15,Widget-{} ,2,\"$1,019.99\",USD\n,,,,,\n"
    (tmp_path / "g.csv").write_bytes(text.format("O-gbk", "Gbk").encode("gbk"))
    (tmp_path / "u.csv").write_bytes(text.format("O-utf", "Utf").encode("utf-8-sig"))
    (tmp_path / "l.csv").write_bytes("order_id,order_date,sku,status\nO-l,2026/1/5,caf\xe9,\"two\nlines \xe9\xff\"\n".encode("latin-1"))
    files = [str(tmp_path / f) for f in ("g.csv", "u.csv", "l.csv")]
    routes = {r["file"][-5:]: (r["charset"], r["multiline"]) for r in FD.route_by_charset(spark, files).collect()}
    assert routes == {"g.csv": ("GBK", False), "u.csv": ("UTF-8", False), "l.csv": ("ISO-8859-1", True)}
    got = {r["order_id"]: r for r in FD.load_feed(spark, files, "orders").collect()}
    assert sorted(got) == ["O-gbk", "O-l", "O-utf"]
    assert got["O-gbk"]["platform_sku"] == "widget-gbk" and got["O-utf"]["item_price"] == 1019.99
    assert got["O-l"]["platform_sku"] == "café" and got["O-l"]["order_status"] == "two\nlines éÿ"
    assert str(got["O-l"]["biz_date"]) == "2026-01-05"
    assert len(FD.source_fingerprint(spark, files[0]).first()["source_hash"]) == 16


@pytest.mark.parametrize("split, charset, end", [(40, "UTF-8", "\n"), (97, "GBK", "\r\n"), (100000, "ISO-8859-1", "\n")])
def test_quoted_breaks_in_splits(spark, tmp_path, split, charset, end):
    """Small splits that begin inside and outside of cells give the rows of the reader that takes whole files."""
    rng = random.Random(split)
    odd = "中文" if charset == "GBK" else "é"
    cell = lambda: rng.choice(["", "7", odd, 'inch 5"', '"a, b"', f'"one{end}two"', f'"say ""x""{end}{end},{odd}"', '"" ""'.replace(" ", ""), '"q"z'])
    for f in range(3):
        lines = ["id,text,more", *(f"{f}-{i},{cell()},{cell()}" + rng.choice(["", "", ",extra", end]) for i in range(60))]
        (tmp_path / f"{f}.csv").write_bytes((end.join(lines) + rng.choice(["", end])).encode(charset))
    files = [str(tmp_path / f"{f}.csv") for f in range(3)]
    expected = [tuple(r) for r in spark.read.options(header=True, encoding=charset, multiLine=True, escape='"').csv(files).collect()]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = quoted.read_quoted(spark, files, charset)
        assert out.columns == ["id", "text", "more"]
        key = lambda r: [(x is None, x) for x in r]
        assert sorted(map(tuple, out.collect()), key=key) == sorted(expected, key=key)
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, keep[k]) if k in keep else spark.conf.unset(k)


def test_open_quotes_at_line_ends():
    for line, outside, inside in ((b"a,b", False, True), (b'a,"b', True, False), (b'"', True, False), (b'""', False, True), (b'x"y,"z"', False, False), (b'a"', False, False), (b'"a""', True, False)):
        assert (quoted.ends_inside(line, False, b","), quoted.ends_inside(line, True, b",")) == (outside, inside), line


def test_feed_aliases(spark):
    df = table(spark, sku=["a"], SKU_=["b"], seller_sku=["c"])
    with pytest.raises(ValueError, match="both mean"):
        FD.map_header_aliases(df, "ads")
    assert rows(FD.map_header_aliases(df, "ads", "last")) == [("c",)]
    out = FD.canonicalize_feed(FD.map_header_aliases(table(spark, cost=["N/A", "$2"], click_date=["2026/1/5", "x"]), "ads"), "ads", keep_raw=True)
    assert [(r["spend"], r["spend_bad"], r["ad_date_bad"]) for r in out.collect()] == [(None, True, False), (2.0, False, True)]
    with pytest.raises(ValueError, match="unknown feed"):
        FD.conform(df, "nope")


def test_json_tables(spark):
    records = {"meta": {"page": 3}, "payload": {"items": [{"buoy": "N4", "temp": 11, "token": "q"}, {"temp": 9.5, "buoy": "S1"}, {"buoy": "S2"}]}}
    assert JT.best_table(records) == [["buoy", "temp"], ["N4", "11"], ["S1", "9.5"], ["S2", ""]]
    assert JT.best_table({"when": "now", "tags": ["one"]}) == []
    assert JT.best_table([["depth", "salt"], [40, None], [60, 3.5]]) == [["depth", "salt"], ["40", ""], ["60", "3.5"]]
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": records}}}}}}}}
    assert JT.best_table(deep) == JT.best_table(records) and JT.best_table(deep, max_depth=6) == []
    wide = {f"k{i}": i for i in range(9)}
    assert JT.flat_text(wide) == " / ".join(map(str, range(9))) and JT.flat_text(wide, 6) == " / ".join(map(str, range(6)))
    assert JT.flat_text({"a": [1, None, "x"], "pwd": "s", "b": True}) == "1; x / true"
    df = table(spark, id=[1, 2], payload=[json.dumps(records), "not json"])
    long = JT.grid_to_long(JT.json_payload_to_table(df, "id", "payload"))
    assert rows(long.filter("row_idx < 3")) == [(1, 1, "buoy", "N4"), (1, 1, "temp", "11"), (1, 2, "buoy", "S1"), (1, 2, "temp", "9.5")]
    many = [{"k": i} for i in range(700)]
    assert len(JT.best_table(many, max_rows=500)) == 501 and len(JT.best_table(many)) == 701


def test_grid_predicates(spark):
    grid = [(1, 0, i, [f"c{j}" for j in range(3)]) for i in range(10)] + [(2, 0, 0, ["a", "b"]), (2, 0, 1, ["", " "])]
    df = spark.createDataFrame(grid, "source_id int, table_idx int, row_idx int, cells array<string>")
    out = {r["source_id"]: (r["usable"], r["capture"]) for r in G.grid_summary(df).collect()}
    assert out == {1: (True, False), 2: (False, False)}


def test_html(spark):
    page = "<p>Hi  there</p><script>var a='<table>';</script><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td> 2\n3</td></tr><tr><td></td></tr></table>"
    assert HT.tables_of(page) == [[["A", "B"], ["1", "2 3"]]]
    assert HT.text_of(page).split("\n")[0] == "Hi there" and "var a" not in HT.text_of(page)
    nested = "<table><tr><td>out<table><tr><td>in</td></tr></table></td><td>x</td></tr></table>"
    assert HT.tables_of(nested) == [[["out", "x"]], [["in"]]]
    aria = '<div role="grid"><div role="row"><span role="gridcell">a</span><span role="gridcell">b</span></div></div>'
    assert HT.tables_of(aria) == [[["a", "b"]]]
    vxe = '<div class="vxe-table"><div><b class="vxe-header--column">A</b><b class="vxe-header--column">B</b></div><div class="vxe-body--row"><i class="vxe-body--column">1</i><i class="vxe-body--column"> 2 </i></div></div>'
    assert HT.tables_of(vxe) == [[["A", "B"], ["1", "2"]]]
    ant = '<div class="ant-table"><table><thead><tr><th>A<th>B</tr></thead><tbody><tr><td>1<td>2</tr><tr><td><td></tr></tbody></table></div><p>after</p>'
    assert HT.tables_of(ant) == [[["A", "B"], ["1", "2"]]] * 2
    assert HT.tables_of('<div class="kd-table"><table><tr><td>x') == [[["x"]]] * 2 and HT.tables_of('<i class="el-table">') == []
    shells = table(spark, page_id=[1, 2, 3], html=["<script></script><script></script><div>hi</div>", page, ""])
    assert {r["page_id"]: r["app_shell"] for r in HT.flag_app_shell(shells).collect()} == {1: True, 2: False, 3: True}


def test_slice_and_stack(spark):
    schema = "source_id int, table_idx int, row_idx int, cells array<string>"
    g = spark.createDataFrame([(1, 0, 0, ["a", "b", "c"]), (1, 0, 1, ["1", "2"]), (1, 0, 2, ["x"])], schema)
    assert [r["cells"] for r in G.slice_grid(g, 2, 9, "C", "B").orderBy("row_idx").collect()] == [["2"], [""]]
    assert [r["cells"] for r in G.slice_grid(g, 1, 2, "B", "C").orderBy("row_idx").collect()] == [["b", "c"], ["2", ""]]
    s = spark.createDataFrame([(1, 0, 0, ["h", "k"]), (1, 0, 1, ["1", "2"]), (1, 1, 0, ["h ", "k"]), (1, 1, 1, ["3", "4"]), (1, 2, 0, ["z", "q"]), (1, 3, 0, ["", " "])], schema)
    got = [(r["table_idx"], r["cells"]) for r in G.stack_grids(s).orderBy("table_idx", "row_idx").collect()]
    assert got == [(0, ["h", "k"]), (0, ["1", "2"]), (1, ["3", "4"]), (2, ["z", "q"])]
    assert [r["row_idx"] for r in G.append_rows(["h", "k "], s.filter("table_idx = 1")).collect()] == [1]


def test_boxes_and_headers(spark):
    kind = "page_id int, boxes array<struct<x: double, y: double, w: double, h: double, t: string>>"
    shelf = [(12.0, 8.0, 60.0, 18.0, "pear"), (140.0, 11.0, 55.0, 18.0, "3 kg"), (14.0, 44.0, 60.0, 18.0, " red   plum "), (143.0, 44.0, 20.0, 18.0, "1"), (139.0, 46.0, 30.0, 18.0, "12 kg"), (12.0, 80.0, 50.0, 18.0, "fig")]
    pages = [(1, [*shelf, (0.0, 0.0, 400.0, 200.0, "all of the shelf"), (200.0, 300.0, 5.0, 5.0, "  ")]), (2, []), (3, None), (1, [(None, None, None, None, "alone")])]
    got = G.cells_to_grid(spark.createDataFrame(pages, kind).coalesce(1)).collect()
    assert [(r["source_id"], r["row_idx"], r["cells"]) for r in got] == [(1, 0, ["pear", "3 kg"]), (1, 1, ["red plum", "12 kg"]), (1, 2, ["fig", ""]), (1, 0, ["alone"])]
    df = spark.createDataFrame(
        [(1, 0, 0, ["店铺", "金额", "日期"]), (1, 0, 1, ["A", "1", "2"]), (2, 0, 0, ["CNY 12", "4.5 颗星", "title"]), (2, 0, 1, ["x", "y", "z"]), (3, 0, 0, ["a", "b"]), (3, 0, 1, ["a", "b"])],
        "source_id int, table_idx int, row_idx int, cells array<string>",
    )
    assert {r["source_id"]: r["has_header"] for r in G.flag_header_rows(df).collect()} == {1: True, 2: False, 3: False}


def plain_boxes(boxes):
    """Box by box, every box against every other."""
    inside = lambda a, b: a[0] >= b[0] and a[1] >= b[1] and a[0] + a[2] <= b[0] + b[2] and a[1] + a[3] <= b[1] + b[3] and a[2] * a[3] < b[2] * b[3]
    kept = [b for b in boxes if not any(inside(a, b) for a in boxes)]
    middle = lambda v: sorted(v)[len(v) // 2]
    lines, groups = [], []
    for b in sorted(kept, key=lambda b: (b[1], b[0])):
        centre = b[1] + b[3] / 2
        means = [sum(x[1] + x[3] / 2 for x in line) / len(line) for line in lines[-1:]]
        if means and abs(centre - means[0]) <= max(8, 0.55 * middle([b[3] for b in kept])):
            lines[-1].append(b)
        else:
            lines.append([b])
    for x in sorted(b[0] for b in kept):
        if groups and x - groups[-1][-1] <= max(12, 0.35 * middle([b[2] for b in kept])):
            groups[-1].append(x)
        else:
            groups.append([x])
    columns = [sum(g) / len(g) for g in groups]
    grid = []
    for line in lines:
        cells = [""] * len(columns)
        for b in sorted(line, key=lambda b: b[0]):
            k = min(range(len(columns)), key=lambda j: abs(b[0] - columns[j]))
            if len(b[4]) > len(cells[k]):
                cells[k] = b[4]
        grid.append(cells)
    return grid


def test_boxes_equal_a_plain_walk():
    rng = random.Random(4)
    for n in (0, 1, 2, 9, 40, 40, 90):
        boxes = [(rng.randrange(300), rng.randrange(200), rng.choice([10, 20, 25, 90]), rng.choice([8, 10, 14, 60]), rng.choice("abc") * rng.randrange(1, 5)) for _ in range(n)]
        x, y, w, h = (np.array([b[i] for b in boxes], dtype=float) for i in range(4))
        assert G.boxes_to_rows(x, y, w, h, [b[4] for b in boxes]) == plain_boxes(boxes)


def test_a_page_of_many_boxes():
    """100 slanted rows of 50 boxes, with a wrapper around each row and one around the page."""
    boxes = [(60.0 * c, 40.0 * r + 0.2 * c, 50.0, 20.0, f"{r}.{c}") for r in range(100) for c in range(50)]
    boxes += [(0.0, 40.0 * r, 3000.0, 39.0, "row") for r in range(100)] + [(0.0, 0.0, 3000.0, 4000.0, "page")]
    start = time.monotonic()
    x, y, w, h = (np.array([b[i] for b in boxes]) for i in range(4))
    assert G.boxes_to_rows(x, y, w, h, [b[4] for b in boxes]) == [[f"{r}.{c}" for c in range(50)] for r in range(100)]
    assert time.monotonic() - start < 5


def test_urls(spark):
    urls = {
        "http://127.0.0.1/": False, "http://10.1.2.3/x": False, "http://169.254.169.254/": False, "http://2130706433/": False, "file:///etc/passwd": False,
        "https://example.com/a": True, "http://8.8.8.8:8080/": True, "https://u:p@example.com": False, "http://printer.local": False, "http://[::1]/": False,
        "http://[2606:4700::1111]/": True, "http://[fe80::1]/": False, "http://localhost:3000": False, "http://192.168.1.1": False, "": False,
    }
    df = table(spark, u=list(urls))
    assert {r[0]: r[1] for r in df.select("u", U.url_is_safe("u")).collect()} == urls
    keys = table(spark, u=["https://www.Detail.1688.com/x", "https://shop.example.com:8080", "nope"])
    assert [tuple(r) for r in keys.select(U.host_key("u"), U.sheet_name_from_url("u")).collect()] == [
        ("1688.com", "取数_detail.1688.com"), ("shop.example.com", "取数_shop.example.com"), ("unknown", "取数_取数")]


def test_ingest(spark):
    data = [("a", "https://www.x.com", [["h", None], ["1", "2"]]), ("b", "", []), ("c", "", [["", " "]]), ("d", "", [[str(i)] for i in range(600)])]
    df = spark.createDataFrame(data, "job_id string, url string, rows array<array<string>>")
    got = {r["job_id"]: r for r in N.summarize_payloads(df).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "ok", "b": "no_table", "c": "blank", "d": "ok"}
    assert (got["d"]["row_count"], got["d"]["source_rows"], got["d"]["truncated"]) == (600, 600, False)
    capped = N.summarize_payloads(df, N.ROW_CAP).filter("job_id = 'd'").first()
    assert (capped["row_count"], capped["source_rows"], capped["truncated"]) == (500, 600, True)
    assert got["a"]["sheet_name"] == "取数_x.com" and got["b"]["sheet_name"] == "取数_网页"
    out = N.ingest_rows(df)
    assert out.count() == 602 and N.ingest_rows(df, N.ROW_CAP).count() == 502
    assert out.filter("job_id = 'a' and row_idx = 0").first()["cells"] == ["h", ""]


def test_archive_audit_and_snapshots(spark, tmp_path):
    rows_df = N.ingest_rows(spark.createDataFrame([("a", "https://x.com", [["1"]])], "job_id string, url string, rows array<array<string>>"))
    N.archive_by_host(rows_df, str(tmp_path / "arc"))
    N.archive_by_host(rows_df, str(tmp_path / "arc"))
    assert spark.read.parquet(str(tmp_path / "arc")).filter("host = 'x.com'").count() == 2
    df = table(spark, a=[1], b=["x"])
    notes = [{"claim": "c", "evidence": "e", "confidence": "high"}, {"claim": "no proof", "evidence": "", "confidence": "high"}]
    assert [K.save_snapshot(df, "t", str(tmp_path / "snap"), notes) for _ in range(2)] == [1, 2]
    saved = spark.read.parquet(str(tmp_path / "snap"))
    assert saved.count() == 4 and len(saved.first()["inferences"]) == 1
    counts = spark.createDataFrame([(1, 2, 3, 4, 10, 5)], "matched long, conflict long, left_only long, right_only long, total long, review_pending long")
    for _ in range(2):
        K.append_audit(K.audit_row(counts, "p", "1", "run"), str(tmp_path / "audit"))
    log = K.read_audit(spark, str(tmp_path / "audit"))
    assert log.count() == 2 and log.first()["note"] == "matched=1/10；review_pending=5"
    with pytest.raises(ValueError, match="nothing"):
        K.write_new_table(df.filter("a > 9"), "t")


def test_grams_are_taken_without_a_step_for_each(spark):
    texts = ["a", "", None, "ab", "a\nb c", "😀😀x 😀😀", "  Aa  b\r\nC", "x y\x85z\u2028", "aaaa"]
    df = table(spark, s=texts).select("s", X.char_ngrams("s").alias("g"))
    for text, got in df.collect():
        t = X.clean(text)
        assert got == list(dict.fromkeys(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)))
    assert "zip_with" not in df._jdf.queryExecution().analyzed().toString()


def test_text_measures(spark):
    sample = "Hello  WORLD 中文"
    squeezed = X.clean(sample)
    grams = {squeezed[i : i + n] for n in (2, 3) for i in range(len(squeezed) - n + 1)}
    df = table(spark, s=[sample, "", "a"])
    assert [set(r[0]) for r in df.select(X.char_ngrams("s")).collect()] == [grams, set(), set()]
    vec = [0.0] * X.DIM
    for n in (2, 3):
        for i in range(len(squeezed) - n + 1):
            vec[zlib.crc32(squeezed[i : i + n].encode()) % X.DIM] += 1
    vec = [math.log1p(v) for v in vec]
    norm = math.sqrt(sum(v * v for v in vec))
    got = df.select(X.hash_embed("s")).collect()
    assert got[0][0] == pytest.approx([v / norm for v in vec]) and got[1][0] == [0.0] * X.DIM
    over = df.select(X.lexical_overlap(F.lit("World"), "s"), X.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()
    assert [r[0] for r in over] == [1.0, 0.0, 0.0] and over[0][1] == 0.0


def test_chunks():
    assert T.chunks_of("") == [] and T.chunks_of("a\r\n\r\nb") == ["a\n\nb"]
    long = "x" * 2000
    out = T.chunks_of("head\n\n" + long + "\n \ntail")
    assert [len(c) for c in out] == [4, 900, 900, 440, 4] and out[0] == "head"
    assert all(len(c) <= 900 for c in T.chunks_of("\n\n".join("y" * 400 for _ in range(7))))


def test_hybrid_search_equals_brute_force(spark):
    texts = [f"document {i} about {w} and {v}" for i, (w, v) in enumerate((a, b) for a in ("invoice", "shipment", "refund", "退货运费") for b in ("alpha", "beta", "gamma"))]
    chunks = table(spark, doc_id=list(range(len(texts))), chunk_index=[0] * len(texts), text=texts).withColumn("chunk_index", F.lit(0))
    queries = ["refund beta", "退货", "x"]

    def vector(t):
        return X.embed_batch(*X.packed_grams([X.clean(t)]), 1)[0]

    def grams(t):
        t = X.clean(t)
        return {t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)}

    want = []
    for q, text in enumerate(queries):
        g = grams(text)
        scored = [(-(0.6 * float(vector(text) @ vector(t)) + 0.4 * (len(g & grams(t)) / len(g) if g else 0)), i) for i, t in enumerate(texts)]
        want += [(q, i, p + 1, round(-s, 4)) for p, (s, i) in enumerate(sorted(scored)[:4])]
    got = T.hybrid_search(chunks.repartition(3), queries, 4).select("query_id", "doc_id", "position", "score")
    assert sorted((r[0], r[2], r[3]) for r in got.collect()) == sorted((w[0], w[2], w[3]) for w in want)
    assert [r["doc_id"] for r in got.filter("query_id = 0 and position = 1").collect()] == [7]
    frame = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    assert rows(T.hybrid_search(chunks, frame, 4).select("query_id", "position", "score")) == rows(got.select("query_id", "position", "score"))
    assert T.hybrid_search(chunks, "refund", 99).count() == min(99, chunks.count())
    stored = T.hybrid_search(T.embed_chunks(chunks), queries, 4).select("query_id", "doc_id", "position", "score")
    assert rows(stored) == rows(got)
    named = spark.createDataFrame([("first", "refund"), ("second", "ship")], "query_id string, query string")
    assert {r["query_id"] for r in T.hybrid_search(chunks, named, 2).collect()} == {"first", "second"}
    with pytest.raises(ValueError):
        T.hybrid_search(chunks, " ")


def brute_search(chunks, queries, k):
    """All chunks scored against all queries, by sets and plain loops."""
    def grams(t):
        return {t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)}

    texts = [X.clean(t) for *_, t in chunks]
    vectors, sets = X.embed_batch(*X.packed_grams(texts), len(texts)), [grams(t) for t in texts]
    out = []
    for q, text in queries:
        own, g = X.embed_batch(*X.packed_grams([X.clean(text)]), 1)[0], grams(X.clean(text))
        scored = sorted((-round(0.6 * float(v @ own) + 0.4 * len(g & s) / max(1, len(g)), 9), d, i) for (d, i, _), v, s in zip(chunks, vectors, sets))
        out += [(q, d, i, n + 1, round(-s, 4)) for n, (s, d, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "asked"), [(128, 256), (7, 3)])
def test_search_in_blocks(spark, block, asked, monkeypatch):
    """Random texts with copies and ties; small blocks, so that most are ruled out by their bounds."""
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "QUERY_BLOCK", asked)
    rng = random.Random(block)
    words = ["".join(rng.choice("abcdefé ") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    chunks = [(d, i, text(rng.randrange(0, 60))) for d in range(90) for i in range(2)]
    chunks += [(d + 500, 0, chunks[d][2]) for d in range(30)] + [(900, 0, ""), (901, 0, None), (902, 0, "z" * 3000)]
    queries = [(f"q{i}", text(rng.randrange(1, 12))) for i in range(40)] + [("copy", chunks[5][2] or "a b"), ("none", "日本"), ("short", "a"), ("blank", "  ")]
    df = spark.createDataFrame([(d, i, t, "x") for d, i, t in chunks], "doc_id long, chunk_index int, text string, score string").repartition(3)
    asked_for = spark.createDataFrame(queries, "query_id string, query string").repartition(2)
    want = brute_search([(d, i, t or "") for d, i, t in chunks], [q for q in queries if q[0] != "blank"], 4)
    columns = ["query_id", "doc_id", "chunk_index", "position", "score"]
    assert sorted(map(tuple, T.hybrid_search(df, asked_for, 4).select(*columns).collect())) == want
    index = checkpointed(T.search_index(T.embed_chunks(df)))
    assert sorted(map(tuple, T.hybrid_search(index, asked_for, 4).select(*columns).collect())) == want
    some = T.hybrid_search(index, asked_for, 4, doc_ids=list(range(20)), with_text=False).select(*columns)
    assert sorted(map(tuple, some.collect())) == brute_search([(d, i, t or "") for d, i, t in chunks if d < 20], [q for q in queries if q[0] != "blank"], 4)
    assert T.hybrid_search(df, asked_for.where("false")).count() == 0 and T.hybrid_search(df.where("false"), asked_for).count() == 0


def test_index_is_held_in_small_parts(spark, tmp_path, monkeypatch):
    """Rows of an index are large: a task reads a row group and is sent an Arrow batch at a time, so both are bounded."""
    monkeypatch.setattr(T, "BLOCK", 2)
    texts = [f"text {i} of {'refund' if i % 3 else 'invoice'}" for i in range(400)]
    table(spark, doc_id=list(range(400)), text=texts).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, item_id=[1, 2], text=["text 7 of refund", "invoice"]).write.parquet(f"{tmp_path}/benchmark.parquet")
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(limit, str(64 << 20))
    found = QUERIES["hybrid_search_stored"](spark, str(tmp_path))
    assert int(spark.conf.get(limit)) == T.BATCH_BYTES
    want = brute_search([(i, 0, t) for i, t in enumerate(texts)], [("1", "text 7 of refund"), ("2", "invoice")], 5)
    assert sorted(map(tuple, found.select("query_id", "doc_id", "chunk_index", "position", "score").collect())) == want
    groups = []
    for file in (urlparse(f).path for f in found.inputFiles() if "/stage-" in f):
        meta = pq.ParquetFile(file).metadata
        groups.append([meta.row_group(i).num_rows for i in range(meta.num_row_groups)])
    assert sum(map(sum, groups)) >= 200 and max(map(max, groups)) <= T.INDEX_ROWS < max(map(sum, groups))
    spark.conf.set(limit, "1000000")
    T.hybrid_search(T.chunk_text(table(spark, doc_id=[1], text=["a"])), "a")
    assert int(spark.conf.get(limit)) == 1_000_000  # a lower one stays
    spark.conf.unset(limit)


def test_stored_vectors_as_a_matrix():
    """Whatever the Arrow array looks like, the same as from lists of numbers."""
    for values, kind in [([[1.5, 2], [3, 4]], pa.float64()), ([[1.5, 2], [3, 4]], pa.float32()), ([[1.5, None], [3, 4]], pa.float64()), ([[], []], pa.float64()), ([None, None], pa.float64())]:
        column = pa.array([[9.0], *values, [9.0]], type=pa.list_(kind)).slice(1, 2)
        np.testing.assert_array_equal(T._matrix(column), np.array(values, dtype=float).reshape(2, -1))
    with pytest.raises(ValueError):
        T._matrix(pa.array([[1.0], [2.0, 3.0]], type=pa.list_(pa.float64())))


def test_upsert(spark):
    cur = table(spark, name=["a", "b"], text=["1", "2"])
    new = table(spark, name=["a", "a", "c", "d"], text=["x", "y", "z", " "], saved_at=[1, 2, 1, 1])
    assert rows(T.upsert_documents(cur, new)) == [("a", "y"), ("b", "2"), ("c", "z")]


def test_dedupe_stream_in_blocks(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in ([(" a", 1), ("b", 2)], [("a", 3), ("c", 4)]):
        spark.createDataFrame(part, "k string, n int").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k string, n int").option("maxFilesPerTrigger", 1).parquet(src)
    q = dedupe_stream(stream, ["k"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "st")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert sorted(r["k"].strip() for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_user_functions(spark):
    reg = FunctionRegistry(spark)
    reg.register("user.twice", lambda v: None if v is None else v * 2, "long")
    assert spark.sql("select user_twice(4L)").first()[0] == 8
    reg.register("user.plus", lambda s: s + 1, "long", "pandas")
    assert spark.sql("select user_plus(id) x from range(2)").count() == 2

    class Words:
        def eval(self, text: str):
            for w in text.split():
                yield (w,)

    reg.register("user.words", Words, "word string", "table")
    assert spark.sql("select * from user_words('a b')").count() == 2

    with pytest.raises(ValueError, match="needs a schema"):
        reg.register("user.words", Words, None, "table")
    with pytest.raises(ValueError, match="not a table function"):
        reg.apply_table("user.plus", spark.range(1))
    with pytest.raises(ValueError, match="an order needs groups"):
        reg.apply_table("user.words", spark.range(1), order_by=["id"])

    def bad(pdf, limit):
        raise RuntimeError("no good")

    reg.register("user.bad", bad, "id long", "rows", {"limit": "integer"}, ("limit",))
    out = reg.apply_rows("user.bad", spark.range(3).coalesce(1), limit=1).collect()
    assert [(r["id"], r["status"], r["error"]) for r in out] == [(i, "error", "no good") for i in range(3)]
    reg.register("user.invert", lambda pdf: pdf.assign(v=[100 // i for i in pdf["id"]]), "id long, v long", "rows")
    out = reg.apply_rows("user.invert", spark.range(-50, 50).coalesce(1)).collect()
    assert sorted((r["id"], r["status"]) for r in out) == [(i, "ok" if i else "error") for i in range(-50, 50)]
    with pytest.raises(ValueError, match="must be integer"):
        reg.apply_rows("user.bad", spark.range(1), limit="x")
    with pytest.raises(ValueError, match="needs parameter"):
        reg.apply_rows("user.bad", spark.range(1))
    with pytest.raises(ValueError, match="unknown function"):
        reg.apply_rows("user.none", spark.range(1))


def pushed(spark, folder, batches, schema, start):
    """Runs a stream once for each batch of rows, as files that come one after the other."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).repartition(2).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(schema).parquet(f"{folder}/in")).awaitTermination()
    return spark.read.parquet(f"{folder}/in")


def test_repeat_fetch_stream_equals_the_batch_form(spark, tmp_path):
    """Busy hosts over several Arrow batches, rows out of order over several micro-batches, equal times, a null host and null times."""
    rng = random.Random(3)
    start = datetime.datetime(2026, 1, 1)
    log = [(f"h{h}" if h else None, start + datetime.timedelta(hours=(30 if h else 1) * (i // 2 if h == 2 else i))) for h in range(3) for i in range(700)]
    log += [("h1", None), ("h1", None), (None, None), ("h9", None)]
    rng.shuffle(log)
    ahead = [("h1", start + datetime.timedelta(days=9000))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        def run(stream):
            flagged = flag_repeat_fetch_stream(stream, late="2000 days")
            return flagged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))

        pushed(spark, tmp_path, [log[:800], log[800:1500], log[1500:], ahead], "host string, ts timestamp", run)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.read.parquet(str(tmp_path / "out"))
    want = W.flag_repeat_fetch(spark.createDataFrame(log, "host string, ts timestamp"), "host", "ts").select("host", "ts", "previous_fetch", "repeat_fetch")
    assert rows(got.select(*want.columns)) == rows(want)


def test_repeat_fetch_stream_waits_for_the_watermark(spark, tmp_path):
    """A fetch comes out once the watermark is past it, in its place; one beyond the watermark is left out."""
    at = lambda h: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h)
    run = lambda s: flag_repeat_fetch_stream(s, hours=3, late="5 hours").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    pushed(spark, tmp_path, [[("a", at(10))], [("a", at(8)), ("a", at(12))], [("a", at(1)), ("b", at(30))]], "host string, ts timestamp", run)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()]
    assert got == [("a", at(8), None, False), ("a", at(10), at(8), True), ("a", at(12), at(10), True)]


def test_streamed_rows_are_shuffled_as_text_and_come_back(spark):
    cells = ["", " ", "7", "null", 'say "x"', "back\\slash", "one\ntwo\r\t", "\x00\x1f", "\u2028é中🙂", None]
    grids = [[cells], [[c] for c in cells], [None, [], ["a", None]], [], None, [[None]], [["word"] * 400] * 3]
    made = spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "job_id long, rows array<array<string>>")
    broken = spark.range(1).select(F.lit(99).cast("long").alias("job_id"), F.array(F.array(F.unhex(F.lit("61FF62")).cast("string"))).alias("rows"))
    payloads = made.unionByName(broken)
    packed = N.packed_rows(payloads)
    assert {r["job_id"] for r in packed.where("rows IS NOT NULL").collect()} == {99}
    back = N.unpacked_rows(packed)
    assert back.columns == payloads.columns
    assert {r["job_id"]: r["rows"] for r in back.where("job_id < 99").collect()} == dict(enumerate(grids))
    assert back.where("job_id = 99").select(F.hex(F.col("rows")[0][0].cast("binary"))).first()[0] == "61FF62"
    numbers = spark.createDataFrame([(1, [[1, 2]])], "job_id long, rows array<array<int>>")
    assert N.unpacked_rows(N.packed_rows(numbers)).first()["rows"] == [[1, 2]]


def test_stages_leave_no_shuffle_files(spark):
    from tablework.session import shared_dir

    shared_dir(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = [f.getAbsolutePath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = held()
    table(spark, k=list(range(1000))).repartition(3, "k").write.format("noop").mode("overwrite").save()
    assert held() - before  # an action of its own keeps them until the driver collects garbage
    before = held()
    made = checkpointed(table(spark, k=list(range(1000))).repartition(3, "k"))
    limit = time.time() + 10
    while held() - before and time.time() < limit:
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(key, "false") == "false" and made.count() == 1000


@pytest.mark.parametrize("remember", [None, "1 day"])
def test_ingest_stream_writes_a_job_once(spark, tmp_path, remember):
    at = lambda h: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h)
    one, two = [["a", "b"], ["c", None]], [["x"]]
    batches = [
        [("j1", "https://a.com/", one, at(0)), ("j1", "https://a.com/", one, at(0)), ("j2", "https://a.com/", [["", " "]], at(0)), (None, "https://a.com/", two, at(0))],
        [("j1", "https://a.com/", one, at(1)), ("j2", "https://a.com/", two, at(1)), (None, "https://a.com/", two, at(1)), ("j3", None, None, at(1))],
        [("j1", "https://a.com/", one, at(2)), ("j2", "https://a.com/", two, at(2))],
    ]
    schema = "job_id string, url string, rows array<array<string>>, pushed_at timestamp"
    start = lambda s: ingest_stream(s, str(tmp_path / "out"), str(tmp_path / "state"), received="pushed_at", remember=remember)
    pushed(spark, tmp_path, batches, schema, start)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("job_id").count()
    assert rows(got) == rows(spark.createDataFrame([("j1", 2), ("j2", 1), (None, 2)], "job_id string, count long"))
