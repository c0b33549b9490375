"""Character n-grams, hashed embeddings and similarity."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.columns import WS_CLASS
from tablework.session import give_back

DIM = 384
#: Characters whose grams are worked on at once, and vectors that are scaled at once.
PIECE, ROWS = 1 << 20, 512
EMBED_VERSION = 2


def squeezed(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(F.regexp_replace(F.lower(c), WS_CLASS + "+", " "), F.lit(" "))


def char_ngrams(c: Column | str) -> Column:
    """Distinct 2- and 3-grams of the lower-cased text with single spaces."""
    t = F.coalesce(squeezed(c), F.lit(""))

    def grams(x: Column) -> Column:
        # One character is passed at a time, and those from it on are taken.
        return F.array_distinct(F.concat(F.regexp_extract_all(x, F.lit("(?s)(?=(..)).")), F.regexp_extract_all(x, F.lit("(?s)(?=(...))."))))

    return F.get(F.transform(F.array(t), grams), F.lit(0))


def lexical_overlap(query: Column | str, text: Column | str) -> Column:
    """Share of the query's n-grams found in the text."""
    both = F.array(F.struct(char_ngrams(query).alias("q"), char_ngrams(text).alias("t")))
    share = F.transform(
        both, lambda b: F.try_divide(F.size(F.array_intersect(b["q"], b["t"])).cast("double"), F.size(b["q"]).cast("double"))
    )
    return F.coalesce(F.get(share, F.lit(0)), F.lit(0.0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of two unit vectors; 0 when a vector is empty or the lengths differ."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    dot = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), dot).otherwise(0.0)


# ------------------------------------------------------------------ batch arithmetic inside tasks
# Java reads \s as ASCII white space; so must the tasks, or both forms cut texts differently.
_SPACE = re.compile(WS_CLASS + "+", re.ASCII)


def clean(text: str | None) -> str:
    return _SPACE.sub(" ", str(text or "").lower()).strip(" ")


def packed_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All 2- and 3-grams of a batch as (text number, packed code points)."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) for t in texts]
    owners, grams = [], []
    for i, p in enumerate(points):
        for packed in ((p[:-1] << 21) | p[1:], (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]):
            grams.append(packed)
            owners.append(np.full(len(packed), i, dtype=np.int64))
    if not grams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(grams)


def _slot(packed: int) -> int:
    chars = [chr((packed >> s) & 0x1FFFFF) for s in (42, 21, 0)]
    gram = "".join(chars[1:] if packed >> 42 == 0 else chars)
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % DIM


def embed_batch(owners: np.ndarray, grams: np.ndarray, count: int) -> np.ndarray:
    """log1p gram counts over hashed slots, scaled to unit length; one row per text."""
    distinct, where = np.unique(grams, return_inverse=True)
    return embed_counted(owners, distinct, where, count, {})


def embed_counted(owners: np.ndarray, distinct: np.ndarray, where: np.ndarray, count: int, known: dict[int, int]) -> np.ndarray:
    """``embed_batch`` of grams that are numbered already; ``known`` remembers slots by gram."""
    names = distinct.tolist()
    for g in names:
        if g not in known:
            known[g] = _slot(g)
    slots = np.fromiter(map(known.__getitem__, names), dtype=np.int64, count=len(names))
    return _unit(_slot_counts(owners, slots[where], count))


def _slot_counts(owners: np.ndarray, slots: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(owners * DIM + slots, minlength=count * DIM).reshape(count, DIM).astype(float) if len(slots) else np.zeros((count, DIM))


def _unit(counts: np.ndarray) -> np.ndarray:
    for at in range(0, len(counts), ROWS):  # in place, as copies of all rows are large
        vec = np.log1p(counts[at : at + ROWS])
        norm = np.sqrt((vec * vec).sum(axis=1, keepdims=True))
        counts[at : at + ROWS] = vec / np.where(norm == 0, 1.0, norm)
    return counts


def pieces(texts: Iterable[str | None], size: int) -> Iterator[tuple[list[int], list[str], list[bool]]]:
    """Cleaned texts in turn as (numbers, parts, whether the text goes on), of about ``size`` characters; parts of a longer text share two characters."""
    found: list[tuple[int, str, bool]] = []
    length = 0
    for i, t in enumerate(texts):
        t = clean(t)
        for at in range(0, max(1, len(t) - 2), size):
            part = t[at : at + size + 2]
            if found and length + len(part) > size:
                yield tuple(map(list, zip(*found)))
                found, length = [], 0
            found.append((i, part, at + size < len(t) - 2))
            length += len(part)
    if found:
        yield tuple(map(list, zip(*found)))


def embed_texts(texts: Sequence[str | None], size: int = PIECE) -> np.ndarray:
    """``embed_batch`` of whole texts, with the grams of about ``size`` characters in memory at a time."""
    counts = np.zeros((len(texts), DIM))
    for numbers, parts, goes_on in pieces(texts, size):
        owners, grams = packed_grams(parts)
        distinct, where = np.unique(grams, return_inverse=True)
        slots = np.fromiter(map(_slot, distinct.tolist()), dtype=np.int64, count=len(distinct))[where]
        np.add.at(counts, numbers, _slot_counts(owners, slots, len(parts)))
        for number, part, more in zip(numbers, parts, goes_on):
            if more:  # the next part has this pair as well
                counts[number, _slot((ord(part[-2]) << 21) | ord(part[-1]))] -= 1
    return _unit(counts)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embed(text: pd.Series) -> pd.Series:
    """384 slots of hashed 2- and 3-grams, as a unit vector (zeros for empty text)."""
    vectors = embed_texts(text.tolist())
    give_back()
    return pd.Series(list(vectors))
