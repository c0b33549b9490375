"""URL filters and chat formatting against plain Python."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablework.llm import chat, queries, urlfilter

BPE = public_tokenizers.path("byte_bpe_50k.json")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def judge(url, rules):
    host, path = parts(url)
    found = [(k, a) for a, k in rules for h, p in [k.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    rule, _ = max(found, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, "block" if (rule, "block") in found else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://a.com", "http://a.COM/", "HTTP://WWW.Example.Com/en/x?y#z", "x://example.com/en/", "x://notexample.com/en/", "http://example.com/en",
    "http://sub.www.example.com/en/a", "http://m.example.com/en//b", "https://a.net/es/", "https://a.net/fr/q", "https://net/es/", "https://a.net/es?x=/es/", "http://b.org#://c.com/en/",
    "http://a.com:80/en/", "http://.com/", "http://com./", "http://é.com/Ü/", "http://a\nb.com/c", "http://x.net/" + "es/" * 3000, "http://" + "a." * 3000 + "com/", "http://a.com/en/",
]


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_url_filter(spark, bits, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_BITS", bits)
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*URLS, URLS[6]])], "page_id long, url string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "action string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.url_filter(df, rules).collect()}
    assert got == {i: judge(u, queries.URL_RULES) for i, u in enumerate([*URLS, URLS[6]])}
    assert urlfilter.url_filter(df.where("false"), rules).count() == 0
    assert urlfilter.url_filter(df, rules.where("false")).where("rule IS NOT NULL OR verdict != 'allow'").count() == 0


@pytest.mark.parametrize("bits", [16, 1])
def test_cascade_is_exact(spark, bits, monkeypatch):
    """With one bit for a key most levels let keys through wrongly, so the cascade is deep."""
    monkeypatch.setattr(urlfilter, "BITS", bits)
    rng = random.Random(bits)
    universe = [f"k{i}" for i in range(400)]
    listed = set(rng.sample(universe, 120)) | {"beyond"}
    table = spark.createDataFrame([(k,) for k in universe], "key string")
    cascade = urlfilter.Cascade(spark.createDataFrame([(k,) for k in listed], "key string"), table)
    got = {r["key"] for r in table.where(cascade.has(F.col("key"))).collect()}
    assert got == listed & set(universe)
    assert len(cascade.levels) > (3 if bits == 1 else 0)


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = urlfilter.url_filter(df, spark.createDataFrame(queries.URL_RULES, "action string, key string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def conversations(rng, n):
    bits = ["[", "INST]", "/", "\\", "<", "s>", "</s>", "[INST]", "<<SYS>>", " ok", "é", "日", "\n", " ", "🙂", "[\\INST]", "[TEXT]", "[/TURN]", "<|endoftext|>"]
    roles = ["user", "assistant", "system", "tool", "[TURN]", "", None]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
    return [(c, t, rng.choice(roles), text()) for c in range(n) for t in range(rng.randrange(1, 6))]


def check_chats(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, formatted int")
    blocks = chat.format_chats(df.repartition(5), BPE)
    got = {r["conv_id"]: r for r in chat.read_back(blocks).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert sum(r["formatted_chars"] for r in got.values()) == sum(len(r["formatted"]) for r in blocks.collect())
    return blocks


def test_chats(spark):
    rows = conversations(random.Random(6), 150)
    rows += [(None, 0, "assistant", "no id"), (None, 1, "user", "x"), (500, None, "user", "first"), (500, 0, "assistant", "then"), (501, 1, "assistant", "tie b"), (501, 1, "assistant", "tie a"), (501, 1, "assistant", "tie a")]
    rows += [(502, 0, "user", "long " * 100_000), (502, 1, "assistant", "answer " * 50_000)]
    blocks = check_chats(spark, rows)
    assert chat.read_back(chat.format_chats(blocks.where("false").selectExpr("_conv AS conv_id", "block AS turn", "formatted AS role", "formatted AS text"), BPE)).count() == 0


def test_long_conversations_are_cut_between_turns(spark, monkeypatch):
    whole = check_chats(spark, rows := [(1, t, "assistant" if t % 2 else "user", f"turn {t}!") for t in range(300)]).collect()
    monkeypatch.setattr(chat, "BLOCK_CHARS", 200)
    cut = sorted(check_chats(spark, rows).collect(), key=lambda r: r["block"])
    assert len(whole) == 1 and len(cut) > 5
    assert [i for r in cut for i in r["token_ids"]] == whole[0]["token_ids"]
    assert [m for r in cut for m in r["loss_mask"]] == whole[0]["loss_mask"]


def test_masks():
    spans = np.array([[2, 5], [5, 7], [10, 11]])
    offsets = np.array([[0, 2], [2, 3], [3, 6], [7, 7], [7, 10], [9, 12], [11, 12]])
    assert chat.masked(spans, offsets).tolist() == [False, True, True, False, False, True, False]
    assert chat.masked(spans[:0], offsets).tolist() == [False] * 7
