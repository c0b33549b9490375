"""Personal data: plain forms against plain patterns, the tagger against brute force and numerical gradients, and accuracy on held-out windows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tablework.llm import personal, tagger

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The patterns as they are stated."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    doubled = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and doubled(digits(m)) % 10 == 0]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def random_texts(n):
    rng = random.Random(n)
    bits = ["a", "é", "@", ".", "-", " ", "+", "(", ")", "1", "255", "256", "00001", "4111111111111111", "5500 0000 0000 0004", "b.c", "x@y.z", "1.2.3.4", "\n", "日", "🙂", "+1 (555) 123-4567", "٣", "１", "_", "%"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_plain_forms():
    texts = ["", "@", "a@b", "a@b.c@d.e", "x" * 3000 + "@" + "y" * 3000 + ".com", "1" * 5000, "1." * 5000, "+" * 200, "+1" + " " * 900 + "2", "@" * 900, "1.2.3.4.5.6.7.8.9", "0000000255.1.1.1", *random_texts(4000)]
    for t in texts:
        assert personal.base_spans(t) == plain(t), t


def small(seed, tags=4, classes=7):
    rng = np.random.default_rng(seed)
    params = {k: (v + rng.normal(0, 0.4, v.shape)).astype(np.float64) for k, v in tagger.start_params(classes, tags, 3, 4, seed).items()}
    mask = np.arange(5) < np.array([[5], [3], [1]])
    return params, rng.integers(0, classes, (3, 5)), mask, rng.integers(0, tags, (3, 5))


def path_score(params, scores, tags):
    return params["first"][tags[0]] + params["last"][tags[-1]] + sum(s[t] for s, t in zip(scores, tags)) + sum(params["move"][a, b] for a, b in itertools.pairwise(tags))


def test_sums_and_best_paths_equal_all_paths():
    params, ids, mask, _ = small(1)
    scores = tagger.emissions(params, ids, mask)
    total, _ = tagger.log_partition(params, scores, mask)
    best = tagger.best_paths(params, scores, mask)
    for row, n in enumerate(mask.sum(axis=1)):
        paths = {p: path_score(params, scores[:n, row], p) for p in itertools.product(range(4), repeat=int(n))}
        assert np.isclose(total[row], np.log(sum(np.exp(list(paths.values())))), atol=1e-4)
        assert tuple(best[row, :n]) == max(paths, key=paths.get)


def test_reader_reads_every_place_as_emissions_do():
    """Windows of all sizes at once; a window is called plain only if no path beats 0 everywhere, and tagged ones are all others."""
    rng = np.random.default_rng(4)
    sizes = np.concatenate([np.full(30, 40), rng.integers(1, 41, 70)])
    mask = np.arange(40) < sizes[:, None]
    plain = []
    for seed, bias in itertools.product(range(4), (-1, 2, 6)):
        params, *_ = small(seed, personal.TAGS, personal.CLASSES)
        params["emit_bias"][0] += bias
        ids = rng.integers(0, personal.CLASSES, mask.shape).astype(np.uint8)
        reader, want = tagger.Reader(params), tagger.emissions(params, ids, mask)
        for rows in (slice(None), slice(0, 30)):
            scores = reader.scores(ids[rows], sizes[rows])
            assert np.allclose(np.where(mask.T[:, rows, None], scores - want[:, rows], 0), 0, atol=1e-4)
        best = tagger.best_paths(params, want, mask)
        plain.append(reader.plain(want, sizes))
        assert not best[plain[-1]].any()
        found = {k: tags for k, tags, _ in personal.tagged(reader, [x[:n] for x, n in zip(ids, sizes)])}
        assert sorted(found) == np.flatnonzero(best.any(axis=1)).tolist()
        assert all((tags == best[k, : sizes[k]]).all() for k, tags in found.items())
    assert 0 < np.mean(plain) < 1


def test_gradients(monkeypatch):
    """Against differences of the loss, in double precision."""
    monkeypatch.setattr(np, "float32", np.float64)
    params, ids, mask, tags = small(2)
    _, grads = tagger.loss_and_gradients(params, ids, mask, tags)
    rng = np.random.default_rng(0)
    for name, value in params.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in value.shape)
            old = value[at]
            value[at] = old + 1e-5
            up, _ = tagger.loss_and_gradients(params, ids, mask, tags)
            value[at] = old - 1e-5
            down, _ = tagger.loss_and_gradients(params, ids, mask, tags)
            value[at] = old
            assert np.isclose(grads[name][at], (up - down) / 2e-5, atol=1e-5), (name, at)


def test_reconciled_spans():
    whole = (0, 10, 30, 5.0, False, False)
    assert personal.reconciled([whole, whole]) == [(0, 10, 30)]
    assert personal.reconciled([(0, 10, 64, 4.0, False, True), (0, 0, 64, 1.0, True, False)]) == []
    assert personal.reconciled([(0, 100, 192, 4.0, False, True), (0, 128, 210, 4.0, True, False)]) == [(0, 100, 210)]
    assert personal.reconciled([(0, 10, 20, 3.0, False, False), (1, 15, 30, 5.0, False, False), (2, 25, 40, 3.0, False, False)]) == [(0, 10, 20), (2, 25, 40)]
    for n in (1, 100, 128, 129, 400):
        cover = personal.windows(7, 7 + n)
        assert cover[0][0] == 7 and cover[-1][1] == 7 + n
        assert all(any(a <= s and s + 64 <= b for a, b in cover) for s in range(7, 7 + n - 63))


def sample(n, seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Thu", "an", "ély", "ness", "ka", "or,", "ti.", "shé", "of"]) + rng.choice("aeiou")
    num = lambda a, b: rng.randrange(a, b)

    def card():
        d = "".join(str(num(0, 10)) for _ in range(15))
        return next(d + str(k) for k in range(10) if personal.luhn(d + str(k)))

    kinds = [
        lambda: f"{word()}.{num(10, 99)}@mail{num(0, 9)}.example.com", lambda: ".".join(str(num(1, 256)) for _ in range(4)), card, lambda: f"+1 ({num(100, 999)}) 555-{num(1000, 9999)}",
        lambda: str(num(10, 10**9)), lambda: f"{num(1900, 2100)}-0{num(1, 10)}-{num(10, 29)}", lambda: word(),
    ]
    return [" ".join([*(word() for _ in range(num(5, 40))), kinds[k % len(kinds)](), *(word() for _ in range(num(5, 40)))]) for k in range(n)]


@pytest.fixture(scope="module")
def params(spark):
    docs = spark.createDataFrame(list(enumerate(sample(500))), "doc_id long, text string")
    return personal.learn(docs)


def test_held_out_accuracy(params):
    """Rewritten forms in texts that were not learnt from."""
    table, rng = personal.class_table(), random.Random(5)
    hit = missed = wrong = 0
    for text in sample(350, seed=77):
        spans = personal.base_spans(text)
        made, want, at = "", [], 0
        for kind, lo, hi in spans:
            put = personal.rewritten(kind, text[lo:hi], rng)
            made += text[at:lo]
            want.append((kind, len(made), len(made) + len(put)))
            made, at = made + put, hi
        made += text[at:]
        base = personal.base_spans(made)
        got = set(base) | set(personal.added_spans(params, [made], [base], [personal.stretches(made)], table)[0])
        hit, missed, wrong = hit + len(got & set(want)), missed + len(set(want) - got), wrong + len(got - set(want))
    assert hit / (hit + missed) > 0.85 and hit / (hit + wrong) > 0.95, (hit, missed, wrong)


def test_documents(spark, params):
    long = " ".join(sample(3000, seed=9))
    texts = [None, "", "no sign", long, *sample(40, seed=4), "1" * 20_000, "call (555) 123-4567 or mail an.12 (at) mail3 (dot) example (dot) com today", "x" * 70 + "@" + "y" * 70 + ".com"]
    rows = [(i, t, "x", 3, "y") for i, t in enumerate([*texts, texts[5]])] + [(None, texts[6], "x", 3, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int, kind string").repartition(3)
    out = personal.find(df, params)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    for i, t, *_ in rows:
        base = personal.as_text(plain(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == k for s in plain(t or "")) for k in range(4)]
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(",")) and got[i]["n_added"] == len([s for s in got[i]["spans"].split(",") if s]) - len(plain(t or ""))
    assert [got[k]["spans"] for k in range(3)] == ["", "", ""]
    assert got[len(texts)]["spans"] == got[5]["spans"]
    assert personal.find(df.where("false"), params).count() == 0
    nothing = personal.learn(df.where("false"))
    assert personal.find(df, nothing).where("n_added > 0").count() == 0


def test_every_place_of_a_text_is_tagged(spark):
    """A tagger that takes every character for an address is asked about every place of a text, also without digits and at-signs."""
    eager = tagger.start_params(personal.CLASSES, personal.TAGS)
    eager["emit_bias"][2] = 50
    texts = ["john.smith at example dot com", "a" * 300 + ".smith at example dot com", "", None]
    found = personal.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), eager).collect()
    assert {r["doc_id"]: r["spans"] for r in found} == {0: "email:0:29", 1: "email:0:325", 2: "", 3: ""}
