"""Packing documents into training sequences: repeat counts of length combinations by non-negative least squares."""

from __future__ import annotations

import codecs
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tablework.llm.common import arrow_column, field, map_arrow, row_key, stage, text_bytes

SEQUENCE = 4096
END_ID = 2
#: Words of late that a task remembers, as many before them at most, and the longest word that it remembers.
CACHED = 100_000
CACHED_BYTES = 64
#: What stands for each byte in the vocabulary: itself if it can be seen, else the next character from 256 on.
SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in SEEN)}
SIGN_TABLE = "".join(chr(BYTE_SIGNS.get(b, b)) for b in range(256))
#: ASCII signs, and the first and last of the two-byte characters that may be Latin letters (U+00C0 to U+024F).
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
LATIN = "\u00c0".encode(), "\u024f".encode()
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: ASCII signs at the end of a word, after a lower-case letter, a digit or a two-byte Latin letter (U+0130 is none: in lower case it ends in a mark).
AFTER = rb"(?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].)|(?<=\xc4[\x80-\xaf\xb1-\xbf].)|(?<=[\xc5-\xc8][\x80-\xbf].)|(?<=\xc9[\x80-\x8f].))"
LAST_SIGNS = re.compile(rb"[" + re.escape(SIGNS) + rb"]" + AFTER + rb"[" + re.escape(SIGNS) + rb"]*(?=[\x20\x09-\x0D]|\Z)")
#: Rows of one length are numbered in so many parts.
PARTS = 64
#: Bound on the combinations that the solver sees, and its steps.
MAX_COMBINATIONS = 40_000
STEPS = 400


class WordIds(dict[bytes, bytes]):
    """Token ids of words and texts as little-endian 32-bit numbers; ids of words without the signs at their end, and of these signs, are remembered.

    Right for byte-level BPE that lower-cases, whose pieces never cross ASCII white space or go from a letter or digit to an ASCII sign, that takes
    digits one by one, and whose normalisation does not look beyond these.

    As a dict it holds the words of late. When it is full, they take the place of those remembered before, which come back when they are met again:
    frequent words stay and rare ones go."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.before: dict[bytes, bytes] = {}

    def _letters(self, word: bytes) -> str | None:
        """The word as the model's merges see it, if it is Latin letters only: one piece then, without the steps before the merges."""
        if word.isalpha():
            return word.lower().decode()
        text = unicodedata.normalize("NFC", word.decode("utf-8", "replace")).lower()
        return codecs.charmap_decode(text.encode(), "strict", SIGN_TABLE)[0] if text.isalpha() and max(text) < "\u0250" else None

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self._learn(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _learn(self, word: bytes) -> bytes:
        signs = self._letters(word)
        if signs is not None:
            return array("I", [t.id for t in self.tokenize(signs)]).tobytes()
        core = word.rstrip(SIGNS)
        if 0 < len(core) < len(word) and b"<|" not in word:
            if core[-1:].isalnum() or (LATIN[0] <= core[-2:] <= LATIN[1] and core[-2:].decode("utf-8", "replace").lower().isalpha()):
                return self[core] + self[word[len(core) :]]
        if word.isdigit() and len(word) > 1:
            return b"".join([self[word[k : k + 1]] for k in range(len(word))])
        return array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        find = self.__getitem__
        for t in texts:
            # special tokens are told by their case
            yield b"".join(map(find, t.split() if b"<|" in t else LAST_SIGNS.sub(rb" \g<0>", t.translate(LOWER)).split()))


def document_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, END_ID added, at multiples of SEQUENCE: id, _key, start, length, ids_crc32, doc_tokens (and ids, bytes).

    Null text is the end id alone."""
    names = ["start", "length", "ids_crc32", "doc_tokens"]
    fields = [field(docs, id_col, "_id"), StructField("_key", BinaryType()), *(StructField(n, LongType()) for n in names)]
    schema = StructType(fields + [StructField("ids", BinaryType())] * with_ids)
    end_id = np.array([END_ID], dtype="<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        words = WordIds(tokenizer_path)
        for batch in batches:
            index, out = [], [[] for _ in range(4 + with_ids)]
            for i, ids in enumerate(words.encode(batch.column(2).to_pylist())):
                ids += end_id
                n = len(ids) // 4
                for start in range(0, n, SEQUENCE):
                    piece = ids[4 * start : 4 * (start + SEQUENCE)]
                    index.append(i)
                    for c, x in zip(out, (start, len(piece) // 4, zlib.crc32(piece), n, piece), strict=False):
                        c.append(x)
            if index:
                at = arrow_column(index, pa.int64())
                yield [batch.column(0).take(at), batch.column(1).take(at), *out]

    return map_arrow(docs.select(id_col, row_key(id_col, text_col), text_bytes(text_col)), schema, rows)


def _combinations(counts: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Length tuples of two to four present lengths that fill the window, or nearly where no other is found."""
    lengths = sorted(counts)
    present = set(lengths)
    found = {(window,)} if window in present else set()
    each = max(2, min(24, MAX_COMBINATIONS // (2 * max(1, len(lengths)))))
    for a in lengths[::-1]:
        rest = window - a
        if rest <= 0:
            continue
        if rest in present:
            found.add(tuple(sorted((a, rest))))
        fitting = lengths[: bisect_right(lengths, rest)]
        if not fitting:
            continue
        step = max(1, len(fitting) // each)
        for b in fitting[::step]:
            left = rest - b
            if left in present:
                found.add(tuple(sorted((a, b, left))))
            near = bisect_right(lengths, left // 2)
            for c in lengths[max(0, near - 2) : near]:
                if left - c in present:
                    found.add(tuple(sorted((a, b, c, left - c))))
        if rest not in present and rest - fitting[-1] <= window // 64:
            found.add(tuple(sorted((a, fitting[-1]))))
    return sorted(found)


def solve_counts(counts: dict[int, int], combinations: list[tuple[int, ...]]) -> np.ndarray:
    """How often to use each combination: least squares against the histogram with counts of at least 0, by accelerated projected gradients."""
    if not combinations:
        return np.zeros(0)
    place = {n: i for i, n in enumerate(sorted(counts))}
    target = np.array([counts[n] for n in sorted(counts)], dtype=float)
    row = np.array([place[n] for c in combinations for n in c])
    column = np.repeat(np.arange(len(combinations)), [len(c) for c in combinations])
    scale = 1 / np.sqrt(np.maximum(target, 1))  # relative errors, so rare lengths are met as well

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=x[column], minlength=len(target)) * scale

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(column, weights=(r * scale)[row], minlength=len(combinations))

    v = np.ones(len(combinations))
    for _ in range(20):
        v = back(apply(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (1.05 * (np.linalg.norm(back(apply(v))) or 1))
    x = y = np.zeros(len(combinations))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0, y - step * back(apply(y) - target * scale))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def plan_sequences(counts: dict[int, int], window: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths) that use up the histogram: the rounded solution, then largest-first packing of what is left.

    Works on counts, so its size depends on the number of lengths, at most ``window``."""
    left = dict(counts)
    plan = []
    combinations = _combinations(left, window)
    solved = solve_counts(left, combinations)
    for i in np.argsort(-solved, kind="stable"):
        lengths = combinations[i]
        n = min([round(float(solved[i])), *(left[x] // lengths.count(x) for x in set(lengths))])
        if n > 0:
            plan.append((n, lengths))
            for x in lengths:
                left[x] -= n
    rest = sorted(n for n, c in left.items() if c)
    while rest:
        lengths, room, used = [], window, {}
        while (k := bisect_right(rest, room)) and room:
            while k and left[rest[k - 1]] <= used.get(rest[k - 1], 0):
                k -= 1
            if not k:
                break
            x = rest[k - 1]
            n = min(room // x, left[x] - used.get(x, 0))
            lengths += [x] * n
            used[x] = used.get(x, 0) + n
            room -= n * x
        n = min(left[x] // k for x, k in used.items())
        plan.append((n, tuple(lengths)))
        for x, k in used.items():
            left[x] -= n * k
        rest = [x for x in rest if left[x]]
    return plan


def _slots(plan: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) of the runs of its slots."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for n, lengths in plan:
        offset = 0
        for x in lengths:
            out.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    return {x: np.array(v, dtype=np.int64) for x, v in out.items()}


def assign(pieces: DataFrame, window: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (at least _key, start, length <= window), which must be a written table.

    Only the histogram of lengths (at most ``window`` rows) and the plan made of it pass through the driver. The pieces of one length are
    numbered in PARTS parts by hash, so a length that a third of the pieces have is dealt to many tasks."""
    spark = pieces.sparkSession
    part = F.pmod(F.xxhash64("_key", "start"), F.lit(PARTS)).cast("int")
    parted = pieces.withColumn("_part", part)
    counts = parted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")).collect()
    total: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r["length"], r["_part"])):
        before[r["length"], r["_part"]] = total.get(r["length"], 0)
        total[r["length"]] = total.get(r["length"], 0) + r["n"]
    shared = spark.sparkContext.broadcast((before, _slots(plan_sequences(total, window))))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_key", "start"))
    names = pieces.columns
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    where = names.index("length")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        before, slots = shared.value
        for batch in batches:
            length, part, rank = (np.from_dlpack(batch.column(k)) for k in (where, len(names), len(names) + 1))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            order = np.lexsort((part, length))
            edges = np.flatnonzero(np.diff(length[order]) | np.diff(part[order])) + 1
            for group in np.split(order, edges) if len(order) else []:
                x = int(length[group[0]])
                at = rank[group] - 1 + before[x, int(part[group[0]])]
                run = slots[x][np.searchsorted(slots[x][:, 0], at, side="right") - 1]
                sequence[group], offset[group] = run[:, 1] + at - run[:, 0], run[:, 2]
            yield [*batch.columns[: len(names)], sequence, offset]

    return map_arrow(parted.withColumn("_rank", rank), schema, rows)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack documents into sequences of at most SEQUENCE tokens: one row per piece with id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset (and the ids themselves).

    Null and empty texts are one end id each; longer documents are cut at multiples of SEQUENCE; repeated rows are packed as often as they
    stand; an empty table gives no rows; other columns are ignored.
    """
    placed = assign(stage(document_pieces(docs, tokenizer_path, id_col, text_col, with_ids)))
    return placed.select(F.col("_id").alias(id_col), *(c for c in placed.columns if c not in ("_id", "_key")))
