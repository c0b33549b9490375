"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tablework.llm.common import crc_of, field, join_checked, map_arrow, per_row, stage, text_bytes

#: Word starts of so many letters are candidates for the lexicon, and whole words from so few letters on (with a space at the end).
SHORTEST, LONGEST = 4, 12
SHORT_WORD = 2
#: A word start is tested if so many toxic texts have it.
LEAST_TEXTS = 3
#: So many word starts that stand out are too many for a lexicon in memory; that is an error.
MAX_STARTS = 500_000
#: Rows that the calibration is fitted on.
FIT_ROWS = 20_000
#: Word starts that a task counts before it passes them on.
COUNTED = 300_000
THRESHOLD = 0.3
#: Least odds ratio of a word start.
LEAST_ODDS = 20
#: A word start goes if so large a share of its texts has one that so many times more texts have: words of copied texts, not of toxic ones.
COVERED, TIMES = 0.8, 4
#: Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁɡαβεικνορτυχℓı", "abekmhopctyxijsdgabeikvoptuxli", strict=True))
DIGITS = dict(zip("013457@$", "oieastas", strict=True))
#: Harmless phrases around words that a lexicon may hold.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "scum line", "sore loser bracket")


def folding() -> dict[int, str]:
    """Lower case without accents, look-alikes and digits as letters, everything but letters as a space, invisible characters gone."""
    table: dict[int, str] = {}
    for c in [*range(0x20, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        low = "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x))
        low = "".join(HOMOGLYPHS.get(x, DIGITS.get(x, x)) for x in low)
        table[c] = low if low.isalpha() else " "
    table |= {ord(k): v for k, v in HOMOGLYPHS.items()}
    table |= {c: " " for c in range(0x20)}
    table |= {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}
    return table


def fold(text: str, table: dict[int, str]) -> str:
    return f" {' '.join(text.translate(table).split())} "


def _starts(words: Iterable[str]) -> set[str]:
    words = set(words)
    return {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)} | {f"{w} " for w in words if SHORT_WORD <= len(w) < SHORTEST}


def _counted(texts: DataFrame) -> DataFrame:
    """Texts of either label that have a word start: pattern, toxic, clean. ``texts`` has toxic and the bytes of the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        table = folding()
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> list:
            names = list(set(counts[0]) | set(counts[1]))
            made = [names, [counts[1][x] for x in names], [counts[0][x] for x in names]]
            counts[0].clear()
            counts[1].clear()
            return made

        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _starts(set(fold(text.decode("utf-8", "replace"), table).split()))
                counts[toxic].update(found)
                if len(counts[toxic]) > COUNTED:
                    yield out()
        yield out()

    schema = StructType([StructField("pattern", StringType()), StructField("toxic", LongType()), StructField("clean", LongType())])
    return map_arrow(texts, schema, rows).groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def standing_out(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """The word starts (pattern, toxic, clean) that stand out beyond chance, with their surprise and weight (log odds ratio).

    ``counts`` is a written table of all word starts; every one that LEAST_TEXTS toxic texts have is tested."""
    tested = counts.where(F.col("toxic") >= LEAST_TEXTS)
    needed = math.log(tested.count() + 1) + 7
    rate = (toxic + 1) / (toxic + clean + 2)
    t, c, p = F.col("toxic"), F.col("clean"), (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1)
    surprise = F.when(p > rate, t * F.log(p / rate) + c * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    weight = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    return tested.withColumn("weight", weight).where((surprise > needed) & (F.col("weight") > math.log(LEAST_ODDS)))


def choose(strong: list[tuple[str, int, float]]) -> dict[str, float]:
    """Weights of the lexicon's entries out of word starts that stand out (pattern, toxic texts, weight).

    Of nested starts the longest one with about the texts of the shorter stays, and those it covers go."""
    known = {p: (t, w) for p, t, w in strong}
    longer: dict[str, int] = {}
    for p in known:
        longer[p[:-1]] = max(longer.get(p[:-1], 0), known[p][0])
    ends = {p for p in known if longer.get(p, 0) < 0.98 * known[p][0]}
    kept: dict[str, float] = {}
    for p in sorted(ends, key=len):
        w = known[p][1]
        if not any(p[:k] in kept and kept[p[:k]] > w - 0.7 for k in range(SHORTEST, len(p))):
            kept[p] = w
    return kept


def without_companions(weights: dict[str, float], texts: DataFrame) -> dict[str, float]:
    """The lexicon without word starts that come along with much more frequent ones; ``texts`` is a written table of those found in each toxic text.

    Every text counts. What a word start depends on has TIMES as many texts, so they are settled in steps of TIMES, one pass for each."""
    names = sorted(weights)
    support = {r["p"]: r["n"] for r in texts.select(F.explode("found").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    top = max(support.values(), default=1)
    steps: dict[int, list[str]] = {}
    for p in names:
        k = 0
        while support.get(p, 0) * TIMES ** (k + 1) <= top and p in support:
            k += 1
        steps.setdefault(k, []).append(p)
    kept = set(steps.pop(0, ()))
    schema = StructType([StructField("p", StringType()), StructField("n", LongType())])
    for k in sorted(steps):
        covered = map_arrow(texts, schema, _covered({p: support[p] for p in kept if p in support}, {p: TIMES * support[p] for p in steps[k]}))
        counts = {r["p"]: r["n"] for r in covered.groupBy("p").agg(F.sum("n").alias("n")).collect()}
        kept |= {p for p in steps[k] if counts.get(p, 0) < COVERED * support[p]}
    return {p: weights[p] for p in weights if p in kept}


def _covered(kept: dict[str, int], asked: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[list]]:
    """Counts the texts in which a word start comes along with a kept one of at least so many texts as asked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        counts: Counter = Counter()
        for batch in batches:
            for found in batch.column(0).to_pylist():
                most = max((kept.get(q, 0) for q in found), default=0)
                counts.update(p for p in found if asked.get(p, most + 1) <= most)
        yield [list(counts.keys()), list(counts.values())]

    return rows


class Lexicon:
    """Finds weighted word starts and exception phrases in folded text."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS) -> None:
        import ahocorasick

        self.table = folding()
        self.automaton = ahocorasick.Automaton()
        for p, w in weights.items():
            self.automaton.add_word(f" {p}", (len(p), w, p))
        for p in exceptions:
            words = fold(p, self.table)[:-1]
            self.automaton.add_word(words + " ", (len(words) - 1, None, p))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def found(self, text: bytes) -> list[str]:
        """The word starts that a text has."""
        folded = fold(text.decode("utf-8", "replace"), self.table)
        return sorted({p for _, (_, w, p) in self.automaton.iter(folded) if w is not None}) if not self.empty else []

    def features(self, text: bytes) -> tuple[float, float, int, int]:
        """Log of the summed weights, log of the weight for a thousand words, hits, words. Of word starts at one place the heaviest counts."""
        folded = fold(text.decode("utf-8", "replace"), self.table)
        n = folded.count(" ") - 1 if len(folded) > 2 else 0
        if self.empty or not n:
            return 0.0, 0.0, 0, n
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, w, _) in self.automaton.iter(folded):
            if w is None:
                excused.append((end - size, end))
            else:
                best[end - size + 1] = max(w, best.get(end - size + 1, 0.0))
        if excused:
            best = {at: w for at, w in best.items() if not any(a <= at < b for a, b in excused)}
        total = sum(best.values())
        return math.log1p(total), math.log1p(1000 * total / n), len(best), n


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    """Weights of the lexicon and the calibration."""

    def __init__(self, weights: dict[str, float], coefficients: tuple[float, ...]) -> None:
        self.weights, self.coefficients = weights, coefficients


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from documents with a label of 0 or 1 (of several labels of one id the larger): the lexicon from all of them, the calibration from at most FIT_ROWS of them.

    Without both labels the lexicon is empty."""
    known = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IN (0, 1)")
    known = stage(known.groupBy("_label_id").agg(F.max("toxic").alias("toxic")))
    texts = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_text"))
    training = stage(join_checked(texts, known, texts["_id"] == known["_label_id"]).select("_id", "toxic", "_text"))
    sizes = {r["toxic"]: r["count"] for r in training.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model({}, (0.0, 0.0, math.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 4.5))))
    strong = stage(standing_out(stage(_counted(training.select("toxic", "_text")).where(F.col("toxic") >= LEAST_TEXTS)), sizes[1], sizes[0]))
    if strong.count() > MAX_STARTS:
        raise ValueError(f"more than {MAX_STARTS} word starts stand out in toxic texts")
    weights = choose([(r["pattern"], r["toxic"], r["weight"]) for r in strong.collect()])
    candidates = weights

    def finder() -> Callable[[bytes], tuple]:
        lexicon = Lexicon(candidates)
        return lambda text: (lexicon.found(text),)

    bad = training.where("toxic = 1")
    lists = per_row(bad.select("_text"), StructType([StructField("found", ArrayType(StringType()))]), 0, finder)
    weights = without_companions(weights, stage(lists))
    share = FIT_ROWS / sum(sizes.values())
    drawn = training.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else training
    scored = features(drawn, ["toxic"], "_text", weights).collect()
    x = np.array([[r["log_weight"], r["log_density"]] for r in scored]).reshape(-1, 2)
    return Model(weights, tuple(fit_logistic(x, np.array([r["toxic"] for r in scored], dtype=float)).tolist()))


def features(docs: DataFrame, columns: list[str], text_col: str, weights: dict[str, float]) -> DataFrame:
    """``columns``, log_weight, log_density, n_hits and n_words of every whole text."""
    names = [StructField("log_weight", DoubleType()), StructField("log_density", DoubleType()), StructField("n_hits", IntegerType()), StructField("n_words", LongType())]

    def make() -> Callable[[bytes], tuple]:
        return Lexicon(weights).features

    return per_row(docs.select(*columns, text_bytes(text_col)), StructType([*(field(docs, c) for c in columns), *names]), len(columns), make)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, score (0 to 1), predicted, n_hits, n_words.

    Null and empty texts have no hits and get the score of such a text; repeated rows are scored alike; an empty table gives no rows; other
    columns are ignored."""
    a, b, c = model.coefficients
    found = features(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id"], "_text", model.weights)
    logit = F.lit(a) * F.col("log_weight") + F.lit(b) * F.col("log_density") + F.lit(c)
    value = 1 / (1 + F.exp(-logit))
    return found.select(F.col("_id").alias(id_col), value.alias("score"), (value >= threshold).cast("int").alias("predicted"), "n_hits", "n_words")


def held_out(id_col: str = "doc_id"):
    return F.pmod(crc_of(id_col), F.lit(4)) == 2
