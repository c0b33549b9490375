"""Personal data: patterns for the plain forms, and a character tagger (two LSTMs and a CRF) for other ways to write the same.

Plain e-mail addresses, IP addresses, card and telephone numbers are found by their patterns. Their spans in a bounded sample of texts are the
labels that the tagger learns from: as they stand, rewritten (obscured signs, other separators and groupings), and against look-alikes such as
dates, versions and order numbers; the windows to learn from lie around digits and at-signs. Every text is tagged whole, in windows that
overlap. What the windows say is reconciled over the whole text, checked exactly (check digits, ranges, lengths), and added to the plain spans.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tablework.llm import tagger
from tablework.llm.common import crc_of, field, map_arrow, stage, text_bytes

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

#: Texts and windows that the tagger learns from at most, and what each labelled window is rewritten to.
SAMPLE_TEXTS, SAMPLE_WINDOWS, REWRITES = 20_000, 2000, 3
STEPS = 260
#: Characters of a window, of a step from one to the next, and around a sign of personal data. A span of up to WINDOW - STRIDE characters is whole
#: in some window; longer ones are put together.
WINDOW, STRIDE, AROUND = 128, 64, 32
#: Windows that are tagged at once.
ROWS = 512

LABEL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@０-９＠﹫]|[\[({<]\s?[aA][tT]\s?[\])}>]")


# ------------------------------------------------------------------ plain forms
def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the plain forms, leftmost and without overlaps of a kind; by kind, then by start. Matches that fail their check go."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        # the characters before the sign as far back as they may belong to an address, looked at in growing stretches
        back = 64
        while (local := LOCAL.search(text, max(done, at - back), at)) and local.start() == at - back > done:
            back *= 4
        end = LABEL.match(text, at + 1) if local else None
        if end:
            out.append((0, local.start(), end.end()))
            done = end.end()
        at = text.find("@", max(at + 1, done))
    for m in DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts, start = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k : k + 4])) + 3
                if all(map(_small, parts[k : k + 4])):
                    out.append((1, start, start + size))
                start += size + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(digits := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# ------------------------------------------------------------------ characters and windows
def _folded(code: int) -> str:
    plain = unicodedata.normalize("NFKC", chr(code))
    return plain.lower() if len(plain) == 1 else chr(code)


def class_table() -> np.ndarray:
    """Class of each code point below 65,536: 1 line break, 2 other space, 3 digit, 4 to 29 letters, 30 other letters, 31 to 62 ASCII signs, 63 others."""
    signs = {c: 31 + k for k, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")}

    def of(code: int) -> int:
        c = _folded(code) if not 0xD800 <= code < 0xE000 else "�"
        if c in signs:
            return signs[c]
        if c.isascii():
            return 3 if c.isdigit() else 4 + ord(c) - 97 if c.isalpha() else 1 if c == "\n" else 2
        return 2 if c.isspace() else 3 if c.isdecimal() else 30 if c.isalpha() else 63

    return np.array([of(c) for c in range(0x10000)], dtype=np.uint8)


CLASSES, TAGS = 64, 1 + 2 * len(KINDS)


def classes_of(text: str, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 63).astype(np.uint8)


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text within AROUND characters of a sign of personal data."""
    out: list[tuple[int, int]] = []
    for m in SIGN.finditer(text):
        lo, hi = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def windows(lo: int, hi: int) -> list[tuple[int, int]]:
    """Windows that cover a stretch and overlap by WINDOW - STRIDE."""
    out = [(lo, min(hi, lo + WINDOW))]
    while out[-1][1] < hi:
        lo += STRIDE
        out.append((lo, min(hi, lo + WINDOW)))
    return out


# ------------------------------------------------------------------ labelled examples
def rewritten(kind: int, text: str, rng: random.Random) -> str:
    """The same datum written in another way."""
    if kind == 0:
        at = rng.choice(["@", " @ ", "(at)", " (at) ", "[at]", " [at] ", " at ", "{at}", "＠"])
        dot = rng.choice([".", ".", " . ", "(dot)", " (dot) ", "[dot]", " [dot] ", " dot "]) if at not in ("@", "＠") else "."
        local, _, host = text.rpartition("@")
        return local + at + host.replace(".", dot)
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return rng.choice(["[.]", "(.)", " . ", "[dot]", ". ", "."]).join(text.split("."))
    if kind == 2:
        gap = rng.choice(["", " ", "-", ".", " ", "  ", "_"])
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    gap = rng.choice(["-", ".", " ", "/"])
    area, middle, rest = digits[-10:-7] or "555", digits[-7:-4], digits[-4:]
    lead = rng.choice(["", "", "", "1" + gap, "001" + gap, "+1" + gap, "+" + digits[:-10] + " " if digits[:-10] else ""])
    return lead + rng.choice([f"({area}) {middle}{gap}{rest}", f"({area}){middle}{gap}{rest}", f"{area}{gap}{middle}{gap}{rest}"])


def look_alike(rng: random.Random) -> str:
    """Digits that are no personal data."""
    n = lambda a, b: str(rng.randrange(a, b))
    return rng.choice([
        lambda: f"{n(1900, 2100)}-{n(1, 13).zfill(2)}-{n(1, 29).zfill(2)}", lambda: f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", lambda: f"{n(0, 24)}:{n(10, 60)}", lambda: f"{n(1, 40)}.{n(0, 40)}.{n(0, 40)}",
        lambda: f"{n(1, 10**6)}.{n(10, 100)}", lambda: n(1, 10 ** rng.randrange(2, 16)), lambda: f"{n(1, 999)},{n(100, 1000)}", lambda: f"{n(1, 99)}%", lambda: f"$ {n(1, 99999)}", lambda: f"@{rng.choice(['here', 'all', 'team'])}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(8, 41))), lambda: f"{n(1, 999)}/{n(1, 999)}", lambda: f"{n(256, 999)}.{n(256, 999)}.{n(0, 256)}.{n(0, 256)}", lambda: f"{n(1, 99)}-{n(1, 99)}",
    ])()


def examples(parts: list[tuple[str, list[Span]]], seed: int = 0) -> list[tuple[str, list[Span]]]:
    """Labelled windows as they stand, rewritten, and with look-alikes in the place of personal data."""
    rng = random.Random(seed)
    out = list(parts)
    for text, spans in parts:
        for k in range(REWRITES + 1 if spans else 0):
            made, new, at = "", [], 0
            for kind, lo, hi in sorted(spans, key=lambda s: s[1]):
                made += text[at:lo]
                put = rewritten(kind, text[lo:hi], rng) if k < REWRITES else look_alike(rng)
                if k < REWRITES:
                    new.append((kind, len(made), len(made) + len(put)))
                made, at = made + put, hi
            made += text[at:]
            if len(made) <= WINDOW:
                out.append((made, new))
    return out


def matrices(labelled: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, mask and tags of labelled windows: 0 outside, and for each kind one tag for the first and one for the other characters."""
    table = class_table()
    ids, tags = (np.zeros((len(labelled), WINDOW), dtype=np.uint8) for _ in range(2))
    mask = np.zeros((len(labelled), WINDOW), dtype=bool)
    for row, (text, spans) in enumerate(labelled):
        ids[row, : len(text)] = classes_of(text, table)
        mask[row, : len(text)] = True
        for kind, lo, hi in spans:
            tags[row, lo:hi] = 2 + 2 * kind
            tags[row, lo] = 1 + 2 * kind
    return ids, mask, tags.astype(np.int64)


def labelled_windows(text: str) -> Iterator[tuple[str, list[Span]]]:
    """The windows of a text with its plain spans, apart from those that cut one, or in which spans of two kinds overlap."""
    if not SIGN.search(text):
        return
    spans = sorted(base_spans(text), key=lambda s: s[1])
    starts = [s[1] for s in spans]
    for lo, hi in (w for s in stretches(text) for w in windows(*s)):
        near = spans[max(0, bisect.bisect_left(starts, lo) - 4) : bisect.bisect_left(starts, hi)]
        inside = [(k, a - lo, b - lo) for k, a, b in near if a < hi and b > lo]
        whole = all(a >= 0 and b <= hi - lo for _, a, b in inside)
        if whole and all(x[2] <= y[1] for x, y in zip(inside, inside[1:], strict=False)):
            yield text[lo:hi], inside


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tagger.Params:
    """Weights learnt from the plain spans of at most about SAMPLE_TEXTS texts (chosen by a hash of their ids) and SAMPLE_WINDOWS windows of
    each kind and of none. Without any window the tagger finds nothing."""
    share = min(1.0, SAMPLE_TEXTS / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(crc_of(id_col)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else docs
    schema = StructType([StructField("kind", IntegerType()), StructField("part", StringType()), StructField("spans", StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = list(labelled_windows(text.decode("utf-8", "replace")))
                for k in range(0, len(found), 5000):
                    part = found[k : k + 5000]
                    yield [[s[0][0] if s else -1 for _, s in part], [t for t, _ in part], [";".join(",".join(map(str, x)) for x in s) for _, s in part]]

    parts = stage(map_arrow(some.select(text_bytes(text_col)), schema, rows))
    sizes = {r["kind"]: r["n"] for r in parts.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = F.lit(False)
    for kind, n in sizes.items():
        least = least | ((F.col("kind") == kind) & (F.pmod(F.xxhash64("part", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, SAMPLE_WINDOWS / n) * (1 << 30))))
    taken = parts.where(least).dropDuplicates(["part"]).collect()
    known = [(r["part"], [tuple(map(int, x.split(","))) for x in r["spans"].split(";") if x]) for r in sorted(taken, key=lambda r: r["part"])]
    params = tagger.start_params(CLASSES, TAGS)
    return tagger.train(params, *matrices(examples(known)), STEPS) if known else params | {"emit_bias": np.array([50.0] + [0.0] * (TAGS - 1), np.float32)}


# ------------------------------------------------------------------ tagging and reconciling
def tagged(reader: tagger.Reader, ids: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, best tags, and by how much each beats the tag of other text, of the windows that have any other tag; every window is read."""
    order = sorted(range(len(ids)), key=lambda k: len(ids[k]))
    for at in range(0, len(order), ROWS):
        rows = order[at : at + ROWS]
        sizes = np.array([len(ids[k]) for k in rows])
        block = np.zeros((len(rows), sizes[-1]), dtype=np.uint8)
        for row, k in enumerate(rows):
            block[row, : sizes[row]] = ids[k]
        scores = reader.scores(block, sizes)
        some = np.flatnonzero(~reader.plain(scores, sizes))
        if not len(some):
            continue
        scores, sizes = scores[:, some], sizes[some]
        best = tagger.best_paths(reader.params, scores, np.arange(block.shape[1]) < sizes[:, None])
        over = np.take_along_axis(scores.transpose(1, 0, 2), best[:, :, None], axis=2)[:, :, 0] - scores[:, :, 0].T
        for row, n in enumerate(sizes.tolist()):
            if best[row, :n].any():
                yield rows[some[row]], best[row, :n], over[row, :n]


def spans_of(tags: np.ndarray, gains: np.ndarray, lo: int, inner: tuple[bool, bool]) -> list[tuple]:
    """(kind, start, end, weight, cut before, cut after) of a window's tags; cut where a span meets an edge that is not an edge of its stretch."""
    out = []
    begins = np.flatnonzero((tags > 0) & np.concatenate([[True], (tags[1:] % 2 == 1) | ((tags[1:] + 1) // 2 != (tags[:-1] + 1) // 2)]))
    for b in begins.tolist():
        kind = (int(tags[b]) - 1) // 2
        e = b + 1
        while e < len(tags) and tags[e] == 2 + 2 * kind:
            e += 1
        out.append((kind, lo + b, lo + e, float(gains[b:e].sum()), inner[0] and b == 0, inner[1] and e == len(tags)))
    return out


def reconciled(found: list[tuple]) -> list[Span]:
    """One set of spans for a text: overlapping ones of a kind are one span, those that stay cut go, and of all others the heaviest set without
    overlaps is chosen."""
    joined: list[tuple] = []
    for kind in range(len(KINDS)):
        for s in sorted((s for s in found if s[0] == kind), key=lambda s: (s[1], s[2])):
            if joined and joined[-1][0] == kind and s[1] < joined[-1][2]:
                k, a, b, w, x, y = joined.pop()
                ends = y if b > s[2] else s[5] if s[2] > b else y and s[5]
                begins = x and s[4] if a == s[1] else x
                s = (k, a, max(b, s[2]), max(w, s[3]), begins, ends)
            joined.append(s)
    whole = sorted((s for s in joined if not s[4] and not s[5]), key=lambda s: s[2])
    ends = [s[2] for s in whole]
    best: list[tuple[float, int]] = [(0.0, 0)]  # weight, and 1 if the span is taken
    for k, s in enumerate(whole):
        before = bisect.bisect_right(ends, s[1], 0, k)
        take = best[before][0] + max(s[3], 1e-6)
        best.append((take, 1) if take > best[-1][0] else (best[-1][0], 0))
    out, k = [], len(whole)
    while k:
        if best[k][1]:
            out.append(whole[k - 1][:3])
            k = bisect.bisect_right(ends, whole[k - 1][1], 0, k - 1)
        else:
            k -= 1
    return out[::-1]


AT = r"\s?(?:@|[\[({<]\s?at\s?[\])}>]|\sat\s)\s?"
DOT = r"(?:\s?\.\s?|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)"
OTHER_EMAIL = re.compile(rf"[a-z0-9._%+-]+{AT}[a-z0-9-]+(?:{DOT}[a-z0-9-]+)+", re.I)
OTHER_IP = re.compile(rf"([0-9]+){DOT}([0-9]+){DOT}([0-9]+){DOT}([0-9]+)", re.I)
OTHER_CARD = re.compile(r"[0-9]{4,}(?:[-._\s]{0,2}[0-9]{2,}){0,5}")
OTHER_PHONE = re.compile(r"(?:\+|00)?(?:[0-9]{1,3}[-./\s])?(?:\([0-9]{2,5}\)\s?|[0-9]{2,5}[-./\s])[0-9]{2,5}(?:[-./\s][0-9]{2,5})+|(?:\+|00)?(?:[0-9]{1,3}[-./\s])?\([0-9]{2,5}\)\s?[0-9]{5,8}")


def checked(kind: int, text: str) -> bool:
    """Whether what was tagged can be such a datum at all: its form, ranges and check digits."""
    plain = "".join(c if len(f := unicodedata.normalize("NFKC", c)) != 1 else f for c in text)
    if kind == 0:
        return bool(OTHER_EMAIL.fullmatch(plain))
    if kind == 1:
        m = OTHER_IP.fullmatch(plain)
        return bool(m) and all(map(_small, m.groups()))
    digits = re.sub("[^0-9]", "", plain)
    if kind == 2:
        return bool(OTHER_CARD.fullmatch(plain)) and 16 <= len(digits) <= 19 and luhn(digits)
    return bool(OTHER_PHONE.fullmatch(plain)) and 9 <= len(digits) <= 15


def trimmed(span: Span, text: str) -> Span:
    """Without white space and closing signs at its ends."""
    kind, lo, hi = span
    while lo < hi and text[lo] in " \t\n\r.,;:-/ ":
        lo += 1
    while lo < hi and text[hi - 1] in " \t\n\r.,;:-/ !?":
        hi -= 1
    return kind, lo, hi


def added_spans(params: tagger.Params, texts: list[str], base: list[list[Span]], parts: list[list[tuple[int, int]]], table: np.ndarray) -> list[list[Span]]:
    """What the tagger adds to the plain spans of each text in the given parts (``find`` hands in whole texts); only spans are kept of windows that were tagged."""
    found: list[list[tuple]] = [[] for _ in texts]
    reader = tagger.Reader(params)
    every = ((n, lo, hi, part[a - lo : b - lo], a, b) for n, p in enumerate(parts) for lo, hi in p for part in [classes_of(texts[n][lo:hi], table)] for a, b in windows(lo, hi))
    while some := list(islice(every, 16 * ROWS)):
        for k, tags, gains in tagged(reader, [part for _, _, _, part, _, _ in some]):
            n, lo, hi, _, a, b = some[k]
            found[n] += spans_of(tags, gains, a, (a > lo, b < hi))
    out = []
    for text, plain, spans in zip(texts, base, found, strict=True):
        taken = sorted((lo, hi) for _, lo, hi in plain)
        reach = np.maximum.accumulate([hi for _, hi in taken]).tolist() if taken else []
        good = []
        for s in reconciled(spans):
            kind, lo, hi = trimmed(s, text)
            before = bisect.bisect_left(taken, (hi, 0))  # plain spans that start before its end
            if lo < hi and not (before and reach[before - 1] > lo) and checked(kind, text[lo:hi]):
                good.append((kind, lo, hi))
        out.append(good)
    return out


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for k, lo, hi in sorted(spans, key=lambda s: (s[0], s[1], s[2])))


def find(docs: DataFrame, params: tagger.Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone (plain spans), base_sha256 (of the plain spans as kind:start:end, joined by commas),
    spans (plain and added ones, so joined), n_added. Places are code points, the end is exclusive.

    Null and empty texts have no spans; very long texts are looked at whole, ROWS windows at a time; repeated rows are judged alike; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    held: Broadcast = docs.sparkSession.sparkContext.broadcast(dict(params))
    schema = StructType([
        field(docs, id_col), *(StructField(f"n_{k}", LongType()) for k in KINDS), StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_added", LongType()),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        table = class_table()
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(held.value, texts, base, [[(0, len(t))] if t else [] for t in texts], table)
            counts = [[sum(s[0] == k for s in spans) for spans in base] for k in range(len(KINDS))]
            digest: Callable[[list[Span]], str] = lambda spans: hashlib.sha256(as_text(spans).encode()).hexdigest()
            yield [batch.column(0), *counts, [digest(s) for s in base], [as_text(s + m) for s, m in zip(base, more, strict=True)], [len(m) for m in more]]

    return map_arrow(docs.select(F.col(f"`{id_col}`"), text_bytes(f"`{text_col}`")), schema, rows)
