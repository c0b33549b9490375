"""Spelling variants: words one edit apart, found by PartEnum signatures of letter multisets, and the form that each word stands for.

A word is the multiset of its letters, a binary vector over (letter, how often). One replaced letter changes two places of it, one letter more or
less changes one. The letters are dealt to PARTS partitions, so a replacement leaves all partitions but two as they are and an insertion all but
one: signatures enumerate what may stay. Each signature also names the lengths and the half of the word that the edit leaves alone, as an edit
lies in one half only, which keeps apart words that merely share letters. Equal signatures are joined, and edit distance settles each pair.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tablework.llm.common import arrow_column, join_checked, map_arrow, stage, text_bytes
from tablework.llm.hashing import LOWER

#: Partitions of the letters.
PARTS = 6
#: Bytes of text that a task looks at at once, as far as words allow.
PIECE = 4 << 20
#: Words of more bytes are hashed one by one.
LONG = 64
NO_LETTER = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Which bytes are letters by themselves: a-z, as A-Z are lower-cased, and C3, the first byte of all letters from U+00C0 to U+00FF.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x61, 0x7B), 0xC3]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def _crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges that go on from other CRC-32s, all words at once, one byte after the other; long ones by zlib."""
    out = ~before
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG]
    at, now, sizes = start[order], out[order], size[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k, side="left"))
        now[:m] = table[(now[:m] ^ data[at[:m] + k]) & 255] ^ now[:m] >> 8
    out[order] = now
    out = ~out
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = zlib.crc32(data[start[k] : start[k] + size[k]].tobytes(), int(before[k]))
    return out


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of about PIECE bytes, cut where no letter is."""
    at = 0
    while len(text) - at > PIECE:
        cut = NO_LETTER.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def words_of(texts: list[bytes], names: list[bytes], letters: int, every: int | None, table: np.ndarray) -> tuple[pa.Array, list[bytes]]:
    """The runs of at least so many letters of texts, and those among them that lose a letter, already shorter."""
    data = np.frombuffer(b"\n".join([*texts, b""]).translate(LOWER), dtype=np.uint8)
    letter = LETTER[data]
    letter[1:] |= data[:-1] == 0xC3
    edges = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]])))
    start, end = edges[::2], edges[1::2]
    wide = np.concatenate([[0], np.cumsum(data == 0xC3)])
    points = end - start - (wide[end] - wide[start])
    long = points >= letters
    start, end, points = start[long], end[long], points[long]
    shorter: list[bytes] = []
    if every and len(start):
        ends = np.cumsum([len(t) + 1 for t in texts])
        prefix = np.array([zlib.crc32(n + b":") for n in names], dtype=np.uint32)
        hashes = _crcs(data, start, end - start, prefix[np.searchsorted(ends, start, side="right")], table)
        hit = hashes % every == 0
        for k in np.flatnonzero(hit).tolist():
            word, place = data[start[k] : end[k]].tobytes().decode(), int(hashes[k]) % int(points[k])
            shorter.append((word[:place] + word[place + 1 :]).encode())
        start, end = start[~hit], end[~hit]
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    values = data[np.cumsum(inside[:-1]) > 0]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(values)]), shorter


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 6, least: int = 5, every: int | None = None) -> DataFrame:
    """(word, n) of the words of whole texts with at least so many code points and occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. With ``every``, an occurrence loses a letter if that number divides the
    CRC-32 of ``<id>:<word>``; the letter's place is the CRC-32 modulo the length. Null texts have no words, a null id counts as empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        table = _crc_table()

        def counted(texts: list[bytes], names: list[bytes]) -> list:
            found, shorter = words_of(texts, names, letters, every, table)
            short = [w.decode() for w in shorter if len(w.decode()) >= letters]
            tally = pa.chunked_array([found, arrow_column(short, pa.string())]).value_counts()
            return [tally.field("values"), tally.field("counts")]

        for batch in batches:
            texts: list[bytes] = []
            names: list[bytes] = []
            held = 0
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in pieces(text):
                    texts.append(piece)
                    names.append(name)
                    held += len(piece)
                    if held > PIECE:
                        yield counted(texts, names)
                        texts, names, held = [], [], 0
            if texts:
                yield counted(texts, names)

    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")
    found = map_arrow(docs.select(name, text_bytes(f"`{text_col}`")), schema, rows)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _partitions(ordered: Column) -> list[Column]:
    """The sorted letters of a word that belong to each partition. Letters are dealt in turn, so neighbours in the alphabet are apart."""
    inside = ["".join(chr(c) for c in range(0x61, 0x7B) if c % PARTS == k) for k in range(PARTS - 1)]
    return [*(F.regexp_replace(ordered, f"[^{x}]", "") for x in inside), F.regexp_replace(ordered, f"[{''.join(inside)}]", "")]  # all others are in the last


def _signatures(words: DataFrame) -> DataFrame:
    """(word, n, kind, key): kind 0 for replacements, 1 and 2 for the shorter and the longer word of an insertion."""
    ordered = F.array_join(F.array_sort(F.split("word", "")), "")
    parts = [f"p{k}" for k in range(PARTS)]
    cut = words.withColumn("letters", ordered).select("word", "n", *(c.alias(p) for c, p in zip(_partitions(F.col("letters")), parts, strict=True)))
    # an entry: kind, partitions that may differ as bits, and the side that is equal
    entries = [(0, 1 << i | 1 << k) for i, k in combinations(range(PARTS), 2)] + [(kind, 1 << k) for kind in (1, 2) for k in range(PARTS)]
    listed = F.array(*(F.lit((kind << PARTS | gone) * 2 + side) for kind, gone in entries for side in (0, 1)))
    each = cut.withColumn("entry", F.explode(listed)).withColumns({
        "kind": F.shiftright("entry", PARTS + 1), "side": F.col("entry").bitwiseAND(1), "gone": F.shiftright("entry", 1).bitwiseAND((1 << PARTS) - 1),
    })
    longer = F.when(F.col("kind") == 2, 1).otherwise(0)
    size = F.length("word") - longer
    half = F.shiftright(size, 1)
    text = F.when(F.col("side") == 0, F.substring("word", F.lit(1), half)).otherwise(F.substring("word", half + 1 + longer, size))
    kept = [F.when(F.col("gone").bitwiseAND(1 << k) == 0, F.col(p)) for k, p in enumerate(parts)]
    return each.select("word", "n", "kind", F.xxhash64("gone", "side", size, text, *kept).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words one inserted, deleted or replaced code point apart, each once. ``words``: distinct words and n, written.

    Spark sizes the signatures like the words they are made of, as if each had one instead of 42; the hint keeps them from being broadcast."""
    signs = _signatures(words)
    first = signs.where("kind < 2").select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("kind").alias("a_kind"), "key")
    second = signs.where("kind != 1").select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("kind").alias("b_kind"), "key")
    fits = ((F.col("a_kind") == 1) & (F.col("b_kind") == 2)) | ((F.col("a_kind") == 0) & (F.col("b_kind") == 0) & (F.col("a") < F.col("b")))
    met = first.hint("merge").join(second, "key").where(fits).where(F.levenshtein("a", "b", 1) == 1)
    return met.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n")).select("a", "a_n", "b", "b_n")


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """One row per word: word, n, n_near (words one edit apart), form, form_n, root.

    ``words``: distinct word and n. A word's form is its near word of largest n, the least in code-point order of several, if that n is at least
    ``ratio`` (over 1) times the word's; else null. The root is where following forms ends: the word itself without a form. Counts rise
    along forms, so the way to a root is as long as the logarithm of the largest count at most, and is halved by each join. Rows without a word
    are left out; an empty table gives no rows; other columns are ignored.
    """
    words = stage(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    pairs = stage(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = stage(both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("name"))).alias("best")))
    near = join_checked(words, best, ["word"], "left")
    led = F.col("best").isNotNull() & (-F.col("best.less") >= ratio * F.col("n"))
    judged = stage(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("best.name")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n")))
    ways = stage(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    more = not ways.isEmpty()
    while more:
        steps = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stage(join_checked(ways, steps, ["root"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        more, ways = not moved.where("moved").isEmpty(), moved.select("word", "root")
    return join_checked(judged, ways, ["word"], "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 6, least: int = 5, ratio: int = 5, every: int | None = None) -> DataFrame:
    """``group_variants`` over the words of whole texts with at least ``letters`` code points and ``least`` occurrences.

    With ``every`` some occurrences lose a letter first (``count_words``). Null and empty texts have no words; a null id counts as empty text;
    repeated rows count again; very long texts are looked at in pieces; other columns are ignored, whatever their names.
    """
    return group_variants(count_words(docs, id_col, text_col, letters, least, every), ratio)
