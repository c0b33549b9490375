"""Spelling variants and hard negatives against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablework.llm import negatives, spelling

WORDS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def variants(counts, ratio=5):
    """Brute force: every word with every other."""
    out = {}
    for w, n in counts.items():
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(close), form, counts.get(form))
    roots = {}
    for w in out:
        r = w
        while out[r][2] is not None:
            r = out[r][2]
        roots[w] = r
    return {w: (*x, roots[w]) for w, x in out.items()}


def plain_counts(rows, every):
    counts = Counter()
    for i, text in rows:
        for w in WORDS.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def collected(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def edited(rng, w, letters):
    k = rng.randrange(len(w) + 1)
    kind = rng.randrange(3)
    return w[:k] + (rng.choice(letters) if kind else "") + w[k + (kind < 2) :]


@pytest.mark.parametrize("letters", ["ab", "abcdeéÀ÷ÿz"])
def test_group_variants(spark, letters):
    """Few letters give many words that share all of them, so signatures meet far more pairs than there are near ones."""
    rng = random.Random(len(letters))
    counts = {}
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
        for _ in range(8):
            counts.setdefault(w, rng.choice([5, 7, 25, 26, 130, 130, 700, 4000]))
            w = edited(rng, w, letters)
    df = spark.createDataFrame([(w, n, "x", "y", 3) for w, n in counts.items()] + [(None, 9, "x", "y", 3)], "word string, n int, form string, key string, root int").repartition(3)
    expected = variants(counts)
    assert collected(spelling.group_variants(df)) == expected
    assert max(x[1] for x in expected.values()) > 3 and any(expected[x[2]][2] for x in expected.values() if x[2])


def test_forms_follow_to_the_last(spark):
    chain = {"aaaaaa" + "b" * k: 5**k for k in range(1, 9)}
    got = collected(spelling.group_variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert {r[4] for r in got.values()} == {"aaaaaa" + "b" * 8} and got["aaaaaab"][2] == "aaaaaabb"


def test_signatures_are_not_broadcast(spark):
    """Spark's own limit lets the words be broadcast, and takes the 42 signatures of each for one."""
    words = spark.createDataFrame([(f"wordly{k:03}", k) for k in range(50)], "word string, n long")
    plan = spelling.near_pairs(spelling.stage(words))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_spelling_variants_of_documents(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("etaoinshrdlé") for _ in range(rng.randrange(4, 10))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice([w, w.upper(), w.title(), edited(rng, w, "etÉ")]) + rng.choice(["", ",", "1", "\n"]) for w in rng.choices(base, k=n))
    texts = [None, "", " 12 ", text(30_000), *(text(rng.randrange(1, 900)) for _ in range(40))]
    rows = [*enumerate(texts), (None, texts[5]), (7, texts[7])]
    df = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], "doc_id long, text string, word string, n int, crc string").repartition(4)
    for every in (None, 3):
        expected = variants(plain_counts(rows, every))
        assert len(expected) > 50
        assert collected(spelling.spelling_variants(df, every=every)) == expected
    assert spelling.spelling_variants(df.where("false")).count() == 0


def mined(rows, step, positives=5, negatives=5, percent=80):
    """Brute force with whole numbers of Python."""
    known = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        known[i] = min(known.get(i, whole), whole)
    out = set()
    for a, (label, v) in known.items():
        if a % step:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in known.items()}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if i != a and known[i][0] == label][:positives]:
            able = [i for i in order if known[i][0] != label and percent * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(able[:negatives])}
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, id string, score long, rank string"


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (4, dims))
    made = rng.normal(0, 0.5, (n, dims)) + centres[rng.integers(0, 4, n)]
    rows = [(i, [float(x) for x in np.float32(v)], int(rng.integers(0, 3))) for i, v in enumerate(made)]
    same = rows[3][1]
    rows += [(n + k, same, k % 2) for k in range(40)]  # equal vectors
    rows += [(n + 50, None, 1), (n + 51, [None] * dims, 1), (n + 52, [float("nan")] + same[1:], 1), (n + 53, [float("inf")] + same[1:], 1), (n + 54, same, None), (None, same, 1)]
    rows += [rows[20], (21, same, 2), (n + 60, same[:5], 1), (n + 61, [], 1), (n + 62, [0.0] * dims, 2), (n + 63, [-x for x in same], 2)]
    return rows


@pytest.mark.parametrize(("dims", "size"), [(64, 16 << 20), (11, 700)])
def test_hard_negatives(spark, dims, size, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", size)
    rows = vectors(dims, 260, dims)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 20 == 0).collect()]
    expected = mined(rows, 20)
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 10


def test_no_negatives(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, "x", 1, "y"), (20, [1.0, 2.0], 1, "x", 1, "y")], SCHEMA)
    assert negatives.hard_negatives(df, F.col("id") % 20 == 0).count() == 0
    assert negatives.hard_negatives(df.where("false"), F.col("id") % 20 == 0).count() == 0
    with pytest.raises(ValueError, match="too large"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e9, 1.0], 1)], "vec_id long, embedding array<float>, label int"), F.col("id") == 0)


@pytest.mark.parametrize("digits", [3, 9, 20])
def test_shift_add_lookups_are_inner_products(digits):
    rng = np.random.default_rng(digits)
    low, high = -(1 << (digits - 1)), 1 << (digits - 1)
    rows, anchors = rng.integers(low, high, (50, 19)), rng.integers(low, high, (7, 19))
    assert (negatives.all_scores(negatives.bit_planes(rows, digits), negatives.subset_sums(anchors)) == rows @ anchors.T).all()
