"""The operators on documents against plain Python, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablework.llm import decontamination, lm, minhash, neardup, packing, passages, quality, substrings, toxicity
from tablework.llm.common import join_checked, most_frequent, stage, text_bytes
from tablework.llm.hashing import mix

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, n long, n_words string, kept string, root int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, words=400):
    return " ".join(rng.choice(["Thu", "an", "Ély", "ness", "ka", "or,", "ti.", "shé"]) + str(rng.randrange(words)) for _ in range(n))


def sample_texts():
    rng = random.Random(4)
    base = [prose(rng, n) for n in (60, 90, 150, 400, 900)]
    passage, item = prose(rng, 70), prose(rng, 14)
    near = base[2].split()
    near[40] = "other"
    texts = [None, "", "   \n\t", "one two", "one two", *base, base[2], " ".join(near), base[0] + "\n" + base[1], base[3] + " " + passage, prose(rng, 40) + " " + passage + " " + prose(rng, 40)]
    texts += ["the " * 700, "ab" * 900, "x", prose(rng, 30) + "\n" + prose(rng, 5) + "\n" + prose(rng, 5)]
    line = prose(rng, 25)
    texts += [f"{line}\nshort\n{line}\nshort\n", base[1].upper(), prose(rng, 20) + " " + item + " " + prose(rng, 20), "a\x1cb\x85c\u2003d e", "🙂" * 300 + " <|endoftext|> it's", prose(rng, 6000)]
    return texts


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(d, t, None, f"h{k % 3}" if k % 4 else None, len(t or ""), "x", None, 5, "y", "z", 1) for k, (d, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return sample_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """The sample, the last row twice, and a row without an id."""
    n = len(texts)
    return frame(spark, [*texts, texts[-1], texts[5]], [*range(n), n - 1, None]).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


# -- quality rules


def test_quality(docs, texts, nothing):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert quality.quality_rules(docs).count() == len(texts) + 2
    for d, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(again))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert r["base_failed"] or r["kept"]
    assert quality.quality_rules(nothing).count() == 0 and quality.keep_good(nothing).columns == nothing.columns
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in quality.quality_rules(docs).collect() if r["kept"])


def test_bad_host_goes(spark):
    rng = random.Random(1)
    rows = [(d, prose(rng, 40) if d % 10 or host < 2 else "junk", f"h{host}") for host in range(3) for d in range(host * 100, host * 100 + 100)]
    rows += [(1000 + d, "junk" if d < 90 else prose(rng, 40), "bad") for d in range(100)] + [(2000, "junk", "tiny"), (2001, prose(rng, 40), "tiny"), (2002, prose(rng, 40), None)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[1000 + d] for d in range(100)) and got[2001] and got[2002] and all(got[d] for d in range(200))


# -- repeated substrings


def removed(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("rows", [2_000_000, 0])
def test_substrings(docs, texts, nothing, rows, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", rows // 4)
    monkeypatch.setattr(substrings, "join_checked", lambda *a, **k: join_checked(*a, **{**k, "rows": rows}))
    want = removed([*texts, texts[-1], texts[5]], 400)
    got = substrings.dedup_substrings(docs)
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()]
    ids = [*range(len(texts)), len(texts) - 1, None]
    assert sorted(map(str, found)) == sorted(str((d, *w)) for d, w in zip(ids, want, strict=True))
    assert sum(w[1] for w in want) > 5000
    if rows:
        assert substrings.dedup_substrings(nothing).count() == 0


def test_substrings_random(spark):
    """Short strings over few letters, so that windows overlap themselves and each other in all ways."""
    rng = random.Random(9)
    pool = ["".join(rng.choice("ab") for _ in range(30)) for _ in range(4)] + ["a" * 40, "abc" * 15]
    texts = ["".join(rng.choice(pool)[rng.randrange(8) :] for _ in range(rng.randrange(5))) for _ in range(60)]
    got = substrings.dedup_substrings(frame(spark, texts), width=24, gram=12).collect()
    want = removed(texts, 24)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == dict(enumerate(want))


# -- packing


def check_packing(rows):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_packing(docs, texts, nothing):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack(docs, WORD_BPE).collect()
    check_packing(rows)
    for d, t in enumerate(texts[:-1]):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        mine = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        at = 0
        for r in mine:
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(nothing, WORD_BPE).count() == 0


def test_words_are_encoded_as_texts_are():
    rng = random.Random(2)
    signs = ["a", "B", "é", "É", "\u0301", "'s", "'S", "!", ".", ",", "?", "1", "9", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", " ", "\n", "\x85", "\xa0", "\u2003", "İ", "Σ", "ß", "…", "-", "🙂", "\x1c", "\u200b", "n't"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(3000)]
    got = packing.WordIds(WORD_BPE).encode([t.encode() for t in texts])
    want = Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)
    assert [np.array(e.ids, dtype="<u4").tobytes() for e in want] == list(got)


def test_words_are_remembered_without_the_signs_at_their_end():
    words = packing.WordIds(WORD_BPE)
    text = "abc, abc. (abc) é, é. É; ×, x\u0301! 12. a,b. İ, 中, abc"
    (ids,) = words.encode([text.encode()])
    assert np.frombuffer(ids, dtype="<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert {b"abc", b",", b".", b"12", "é".encode()} <= set(words) and not {b"abc,", b"abc.", b"12.", "é,".encode(), "é.".encode()} & set(words)


def test_words_that_a_task_remembers_are_bounded_inside_of_a_text(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 50)
    ends = ["", ".", "$$$", ",###", "!?\"'s", "...***", "'", "é.", "é$$", "×.", "e\u0301.&", "ß,%%%", "İ.", "42;", "ǽ~"]
    text = " ".join(f"the {chr(97 + k % 26)}{'xy'[k % 2]}{chr(97 + k // 26 % 26)}{ends[k % len(ends)]} {k * 7919} Of<|endoftext|>, word{ends[k % 9]}" for k in range(700))
    words = packing.WordIds(WORD_BPE)
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in words.encode([text.encode(), b"", text.lower().encode()])]
    tokenizer = Tokenizer.from_file(WORD_BPE)
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", text.lower())]
    assert sum(len(d) for d in [words, *vars(words).values()] if isinstance(d, dict)) <= 100



def test_plan_uses_every_length_with_little_padding():
    rng = random.Random(3)
    counts = Counter(min(4096, int(rng.lognormvariate(6.5, 1.2)) + 1) for _ in range(20_000))
    plan = packing.plan_sequences(dict(counts))
    used = Counter()
    for n, lengths in plan:
        assert n > 0 and sum(lengths) <= 4096
        for x in lengths:
            used[x] += n
    assert used == counts
    fill = sum(x * n for x, n in counts.items()) / (4096 * sum(n for n, _ in plan))
    assert fill > 0.99
    assert packing.plan_sequences({}) == []


def test_one_length_for_all(spark):
    rows = packing.pack(frame(spark, ["one two three"] * 300), WORD_BPE).collect()
    assert check_packing(rows) == math.ceil(300 * rows[0]["length"] / 4096)


# -- decontamination


def contaminated(texts, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: pattern.findall((t or "").translate(LOWER))
    out = []
    windows = defaultdict(set)
    for name, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(name)
    sizes = {len(x) for x in windows}
    for t in texts:
        w, hit, names = cut(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= found
        out.append((len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("block", [8_000_000, 60])
def test_decontamination(spark, docs, texts, nothing, block, monkeypatch):
    monkeypatch.setattr(decontamination.item_blocks, "__defaults__", (block,))
    source = texts[21].split()
    items = [(3, " ".join(source[22:34])), (20, " ".join(source[30:42]) + "!"), (1, "TWO"), (100, "a b c"), (7, None), (None, "ka1 unheard of"), (8, ""), (9, "…?!"), (3, " ".join(source[22:34]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs, table).collect()
    names = [("" if n is None else str(n), t) for n, t in items]
    want = contaminated([*texts, texts[-1], texts[5]], names)
    ids = [*range(len(texts)), len(texts) - 1, None]
    assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"])) for r in got) == sorted(str((d, *w)) for d, w in zip(ids, want, strict=True))
    assert sum(w[1] > 0 for w in want) >= 3
    left = decontamination.drop_contaminated(docs, table)
    assert left.columns == docs.columns and left.count() == sum(w[1] == 0 for w in want)
    assert decontamination.decontaminate(nothing, table).count() == 0
    assert decontamination.decontaminate(docs, table.where("false")).where("contaminated").count() == 0


def test_word_ranges_map_to_the_text():
    text = "Où?! été… Zwei\tdrei".encode()
    assert [text[a:b].decode() for a, b in decontamination.word_spans(text, [(0, 1), (1, 3)])] == ["Où", "été… Zwei"]


# -- near duplicates


def sets_of(texts, width):
    out = []
    for t in texts:
        w = words_of(t)
        out.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    return out


def linked(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


def chain(rng, n, steps, edits):
    """Texts of n words, each a few edits away from the one before."""
    words = prose(rng, n, 10**6).split()
    out = []
    for _ in range(steps):
        out.append(" ".join(words))
        words = words[:]
        for _ in range(edits):
            words[rng.randrange(n)] = str(rng.random())
    return out


def test_near_duplicates(docs, texts, nothing):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    sets = sets_of(texts, 3)
    for d, root in enumerate(linked(sets, 85)):
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (len(sets[d]), root, root == d)
    assert got[None]["component_id"] == 5 and not got[None]["kept"]
    assert neardup.near_duplicates(nothing).count() == 0 and neardup.keep_one(nothing).columns == nothing.columns
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    roots = linked(sets_of(texts, 5), 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d, root in enumerate(roots) if d == root]


def test_chains_and_templates(spark):
    """Chains around the threshold and texts that share a template: many sets of different components meet in one band."""
    rng = random.Random(7)
    texts = chain(rng, 120, 25, 3) + chain(rng, 60, 20, 2) + chain(rng, 9, 6, 1)
    template = prose(rng, 90, 10**6)
    texts += [template + " " + prose(rng, 4 + k % 9, 10**6) for k in range(60)]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert [got[d] for d in range(len(texts))] == linked(sets_of(texts, 3), 85)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    name = lambda x: x.to_bytes(2, "big")
    df = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r["id"], "big"): int.from_bytes(r["root"], "big") for r in minhash.components(df).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert minhash.components(df.where("false")).count() == 0


@pytest.mark.parametrize("rows", [minhash.BROADCAST_ROWS, 0])
def test_components_of_long_chains(spark, rows, monkeypatch):
    monkeypatch.setattr(join_checked, "__defaults__", ("inner", rows, None))
    dealt = random.Random(3)
    names = [dealt.sample(range(k, 10_000, 4), 60) for k in range(3)]
    chains = [sorted(names[0]), sorted(names[1], reverse=True), names[2]]  # upwards, downwards, in any order
    pairs = [p for c in chains for p in zip(c, c[1:], strict=False)] + [(9_999, 9_999), (3, 7), (7, 3), (3, 7)]
    df = spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in pairs], "a binary, b binary")
    got = sorted((int.from_bytes(r["id"], "big"), int.from_bytes(r["root"], "big")) for r in minhash.components(df).collect())
    assert got == sorted([(x, min(c)) for c in chains for x in c] + [(3, 3), (7, 3)])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (600, 200, 200))
    circulant = minhash.Circulant(512)
    agree = (circulant.signature(np.concatenate([common, a])) == circulant.signature(np.concatenate([common, b]))).mean()
    assert abs(agree - 0.6) < 0.08


# -- passages


def test_passages(docs, texts, nothing):
    got = {r["doc_id"]: r for r in passages.dedup_passages(docs).collect()}
    assert len(got) == len(texts) + 1
    lines = [(d, x) for d, t in enumerate(texts) for x in (t or "").split("\n") if len(words_of(x)) >= passages.MIN_WORDS]
    sets = [s for s in sets_of([x for _, x in lines], 5)]
    similar = {lines[k][0] for i, s in enumerate(sets) for j in range(i) if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]) for k in (i, j)}
    words = [words_of(t) for t in texts]
    grams = lambda n: Counter(g for w in words for g in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    many, few = grams(49), Counter(tuple(w[i : i + 20]) for w in words for i in range(len(w) - 19))
    for d, w in enumerate(words):
        shared = any(many[tuple(w[i : i + 49])] > 1 for i in range(len(w) - 48))
        possible = any(few[tuple(w[i : i + 20])] > 1 for i in range(len(w) - 19))
        if d in similar or shared:
            assert got[d]["n_repeated"] > 0, d
        elif not possible and d not in (5, len(texts) - 1):
            assert got[d]["n_repeated"] == got[d]["n_removed"] == 0 and bytes(got[d]["kept_text"]).decode() == (texts[d] or "")
    assert got[14]["n_removed"] > 0 and 13 in got[14]["copied_from"]  # the passage inside of two paragraphs
    assert got[10]["n_removed"] > 0 and got[11]["n_removed"] > 0  # a copy and a near copy of line 7
    assert got[7]["n_removed"] == 0
    assert passages.dedup_passages(nothing).count() == 0
    left = passages.drop_passages(docs)
    assert left.columns == docs.columns
    by_id = {r["doc_id"]: r for r in left.collect()}
    assert 10 not in by_id and by_id[7]["text"] == texts[7] and by_id[14]["n_chars"] == len(by_id[14]["text"])
    assert passages.drop_passages(nothing).columns == nothing.columns


def test_runs_from_one_sum_hash_as_polynomials():
    words = np.random.default_rng(1).integers(0, 1 << 63, 70).astype(np.uint64)
    factor, whole = 0xD6E8FEB86659FD93, passages.Grams(0xD6E8FEB86659FD93)(words, 20, 20)
    plain = []
    for i in range(51):
        h = 20
        for w in words[i : i + 20].tolist():
            h = (h * factor + w) & (1 << 64) - 1
        plain.append(h)
    assert (whole == mix(np.array(plain, dtype=np.uint64))).all()
    assert (passages.Grams(factor)(words, 20, 20, np.array([3, 50])) == whole[[3, 50]]).all()


def test_staged_tables_of_passages_go(spark, tmp_path, monkeypatch):
    text = " ".join(f"w{k}" for k in range(80))
    rows = spark.createDataFrame([(1, f"{text}\nbefore {text}"), (2, f"{text} after"), (3, "alone")], "doc_id long, text string")
    monkeypatch.setattr("tablework.session.shared_dir", lambda spark: str(tmp_path))
    found = passages.dedup_passages(rows)
    left = [spark.read.parquet(str(x)).columns for x in tmp_path.iterdir()]
    assert found.count() == 3 and max(r["n_removed"] for r in found.collect()) > 300
    assert sorted(map(len, left)) == [3, 8]  # the units with a copy, and their lists by row


def test_whole_passages_go(spark):
    """Passages of 60 to 400 words between other words, also where their ends stand elsewhere too, leave nothing; text without copies stays."""
    rng = random.Random(11)
    passage = [prose(rng, n, 10**6) for n in (60, 51, 100, 200, 400)]
    ends = " ".join(passage[2].split()[-55:])
    texts = [prose(rng, 40, 10**6) + " " + ends + " " + prose(rng, 40, 10**6)]
    texts += [prose(rng, 40, 10**6) + "\n" + prose(rng, 5, 10**6) + " " + p + " " + prose(rng, 40, 10**6) for p in passage]
    around = [(prose(rng, 40, 10**6), prose(rng, 40, 10**6)) for _ in range(3 * len(passage))]
    texts += [a + " " + passage[k % len(passage)] + " " + b for k, (a, b) in enumerate(around)]
    got = {r["doc_id"]: r for r in passages.dedup_passages(frame(spark, texts)).collect()}
    for d, (a, b) in enumerate(around, 1 + len(passage)):
        assert bytes(got[d]["kept_text"]).decode().split() == [*a.split(), *b.split()], d
    assert all(got[d]["n_removed"] == 0 for d in (0, 1, 2, 4, 5))
    assert len(bytes(got[3]["kept_text"]).split()) == len(texts[3].split()) - 55


def planted(rng, kind):
    """(what the first document says, what the copy says): a passage, changed or wrapped in the copy."""
    words = prose(rng, {"one change": 80, "two changes": 100, "wrapped": 80, "as it is": 52, "a word less": 70}[kind], 10**6).split()
    copy = list(words)
    for k in {"one change": [40], "two changes": [30, 65], "wrapped": [37]}.get(kind, []):
        copy[k] = prose(rng, 1, 10**6)
    if kind == "a word less":
        del copy[35]
    joined = " ".join(copy)
    if kind == "wrapped":
        joined = "\n".join(" ".join(copy[i : i + 11]) for i in range(0, len(copy), 11))
    return " ".join(words), joined


@pytest.mark.parametrize("kind", ["one change", "two changes", "wrapped", "as it is", "a word less"])
def test_near_copies_inside_of_lines_go(spark, kind):
    """At least nine of ten near copies inside longer lines are found and go nearly whole; nothing around them goes, and no first copy."""
    rng = random.Random(len(kind))
    pairs = [planted(rng, kind) for _ in range(40)]
    around = [(prose(rng, 40, 10**6), prose(rng, 40, 10**6)) for _ in pairs]
    texts = [prose(rng, 30, 10**6) + " " + p + " " + prose(rng, 30, 10**6) for p, _ in pairs] + [f"{a} {c} {b}" for (_, c), (a, b) in zip(pairs, around, strict=True)]
    got = {r["doc_id"]: bytes(r["kept_text"]).decode() for r in passages.dedup_passages(frame(spark, texts)).collect()}
    assert all(got[d] == texts[d] for d in range(40))
    left = []
    for d, ((_, copy), (a, b)) in enumerate(zip(pairs, around, strict=True), 40):
        kept = got[d].split()
        assert kept[:40] == a.split() and kept[-40:] == b.split()
        left.append((len(kept) - 80) / len(copy.split()))
    assert sum(x < 1 for x in left) >= 36 and sum(x <= 0.1 for x in left) >= 36, left


def test_text_that_repeats_itself_keeps_its_first_copy(spark):
    rng = random.Random(6)
    part = prose(rng, 90, 10**6)
    texts = [f"{part} {prose(rng, 30, 10**6)} {part}", "word " * 400, f"{part} {part} {part}"]
    got = {r["doc_id"]: bytes(r["kept_text"]).decode() for r in passages.dedup_passages(frame(spark, texts)).collect()}
    assert part in " ".join(got[0].split()) and len(got[0].split()) <= 125
    assert 0 < len(got[1].split()) < 400


NAMES = ["_failed", "_text", "_units", "_new", "_gone", "_key", "_clean", "_keys", "_fits", "_x0", "_X1", "_id", "id", "key", "n", "root", "first_id", "count", "lo", "_chosen"]


@pytest.mark.parametrize("apply", [quality.keep_good, neardup.keep_one, passages.drop_passages, "clean"])
def test_column_names_of_any_kind_pass_through(spark, apply):
    """Columns named as anything that the stages use inside; a row twice, null texts and null ids."""
    rng = random.Random(1)
    passage, item = prose(rng, 60, 10**6), prose(rng, 12, 10**6)
    texts = [prose(rng, 50, 10**6) for _ in range(5)]
    texts += [texts[0], texts[1] + " " + passage, passage + " " + texts[2], texts[3] + " " + item, "short", None, None, ""]
    rows = [(i if i != 4 else None, t, "h", len(t or ""), *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    if apply == "clean":
        out = decontamination.drop_contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    else:
        out = apply(df)
    assert out.columns == df.columns
    given = {r["_key"]: r for r in df.collect()}
    left = out.collect()
    assert 3 <= len(left) < len(rows) + 1 or apply is passages.drop_passages and len(left) <= len(rows) + 1
    assert all(r[n] == given[r["_key"]][n] for r in left for n in ["doc_id", *NAMES])


# -- toxicity


def toxic_rows(rng, n):
    rows = []
    for d in range(n):
        words = prose(rng, 60).split()
        toxic = d % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["gribble", "snorkface", "plonkeroo", "plonkerix"])
        rows.append((d, " ".join(words), int(toxic)))
    return rows


def test_toxicity(spark, nothing):
    rows = toxic_rows(random.Random(3), 600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs.where(~toxicity.held_out()), labels)
    assert any("gribble".startswith(p) for p in model.weights) and any("plonkeraa".startswith(p) for p in model.weights)
    assert not any(p.startswith(("thu", "ness")) for p in model.weights)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[d]["predicted"] == y for d, _, y in rows)
    odd = spark.createDataFrame([(1, "You GR1BBLE!"), (2, "gríbblе here"), (3, None), (4, ""), (5, "a plonkerzz of it " * 5000)], "doc_id long, text string")
    scores = {r["doc_id"]: r for r in toxicity.score(odd, model).collect()}
    assert [scores[d]["predicted"] for d in range(1, 6)] == [1, 1, 0, 0, 1]
    assert all(0 <= r["score"] <= 1 for r in scores.values())
    assert toxicity.score(nothing, model).count() == 0
    plain = toxicity.learn(docs, labels.where("false"))
    assert toxicity.score(odd, plain).where("score >= 0.3").count() == 0


def test_rare_and_short_words_enter_the_lexicon(spark):
    """Toxic words far rarer than ordinary ones, and short ones, whatever the number of toxic texts."""
    rng = random.Random(8)
    rows = []
    for d in range(24_000):
        toxic = d % 2
        word = "zug" if d % 4 == 1 else "grobnix" if d % 400 == 3 else "snorkface" if toxic else "fine"
        rows.append((d, f"so{rng.randrange(40)} {word} then", toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    one = toxicity.Lexicon(model.weights)
    assert one.found(b"a zug") == ["zug "] and one.found(b"a zugspitz") == [] and one.features(b"a z\xc3\xbcg, b")[2] == 1
    assert "grobnix".startswith(tuple(model.weights))  # 60 of 12,000 toxic texts


def test_companions_are_counted_in_all_texts(spark):
    """41,000 texts: a word with 1,000 of which 790 hold a more frequent one stays, one with 810 goes; the more frequent one has to stay itself."""
    found = [["many"]] * 39_000 + [["many", "most"]] * 810 + [["most"]] * 190 + [["many", "less"]] * 790 + [["less"]] * 210 + [["most", "last"]] * 9 + [["last"]]
    texts = stage(spark.createDataFrame([(x,) for x in found], "found array<string>").repartition(7))
    assert sorted(toxicity.without_companions({"many": 5.0, "most": 5.0, "less": 5.0, "last": 5.0, "none": 5.0}, texts)) == ["last", "less", "many", "none"]


def test_exceptions_excuse_a_word():
    lexicon = toxicity.Lexicon({"trash": 5.0}, ["trash can"])
    assert lexicon.features(b"Put it in the tr4sh can.")[2] == 0
    assert lexicon.features(b"What trash, can you say")[2] == 0
    assert lexicon.features(b"the trash can is trash")[2] == 1


# -- language model


def test_scores(docs, texts, nothing):
    train = docs.where("doc_id % 3 != 1")
    model = lm.learn(train.select(text_bytes("text")))
    tokens = {d: [*words_of(t), None] for d, t in enumerate(texts)}
    counts = Counter(x for r in train.collect() for x in tokens[r["doc_id"]])
    n, v = sum(counts.values()), len(counts)
    rows = lm.score(docs, model).collect()
    assert len(rows) == len(texts) + 2
    got = {r["doc_id"]: r for r in rows}
    for d, w in tokens.items():
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert got[d]["base_score"] == pytest.approx(base)
        assert got[d]["score"] < 0
    assert lm.score(nothing, model).count() == 0
    none = lm.learn(nothing.select(text_bytes("text")))
    assert lm.score(docs, none).where("n_known > 0 OR score > 0").count() == 0


def test_tail_words_are_scored_alike(docs, monkeypatch):
    """Words beyond the bounded head are joined; the scores must not depend on where the head ends."""
    monkeypatch.setattr(lm, "OWN", 10)
    texts = docs.select(text_bytes("text"))
    whole = lm.learn(texts)
    short = lm.Model(whole.counts, whole.head[:40], whole.own, whole.classes, whole.tokens, whole.types, whole.net)
    a, b = (sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score(docs, m).collect())) for m in (whole, short))
    assert a == b


@pytest.mark.parametrize("head", [60, 10])
def test_the_end_is_known_if_all_words_are_more_frequent(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "OWN", 8)
    words = [f"a{k}" for k in range(50)] * 4 + [f"b{k}" for k in range(100)] * 2
    docs = frame(spark, [" ".join(words), "a1 b2 never", ""])
    model = lm.learn(docs.where("doc_id = 0").select(text_bytes("text")))
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    p = lambda *counts: sum(math.log10((c + 1) / (401 + 151 + 1)) for c in counts)
    assert [got[d]["n_known"] for d in range(3)] == [401, 3, 1]
    assert got[0]["base_score"] == pytest.approx(p(*[4] * 200, *[2] * 200, 1))
    assert got[1]["base_score"] == pytest.approx(p(4, 2, 0, 1)) and got[2]["base_score"] == pytest.approx(p(1))


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    pairs = rng.integers(1, 5, (40, 40)).astype(float)
    pairs[:20, :20] *= 30
    pairs[20:, 20:] *= 30
    table = lm.train(pairs).log10()
    assert np.allclose((10**table).sum(axis=1), 1)
    unigram = np.log10(pairs.sum(axis=0) / pairs.sum())
    assert (pairs * table).sum() > (pairs * unigram).sum() + 0.2 * pairs.sum()


def test_stage_and_checked_join(spark, docs):
    small = stage(docs.select("doc_id").where("doc_id < 5").distinct())
    for rows in (0, 100):
        assert join_checked(docs, small, ["doc_id"], rows=rows).count() == 5
    assert docs.where(F.col("doc_id").isNull()).count() == 1


def test_most_frequent(spark):
    df = spark.createDataFrame([(f"w{i}", 1 + i // 10) for i in range(200)], "w string, n long")
    for rows in (0, 9, 10, 55, 1000):
        got = [r["n"] for r in most_frequent(df, "n", rows).collect()]
        assert len(got) <= rows and (not got or sorted(got) == sorted(1 + i // 10 for i in range(200))[-len(got) :])
    assert most_frequent(df, "n", 1000).count() == 200 and most_frequent(df.where("false"), "n", 5).count() == 0
