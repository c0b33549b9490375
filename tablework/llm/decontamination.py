"""Benchmark decontamination: one Aho-Corasick automaton over the windows of test items, each text scanned once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from tablework.llm.common import field, free_names, per_row, row_key, stage, text_bytes

#: Words of an item that count when they stand together.
WINDOW = 10
#: UTF-8 bytes of test items in one automaton; more items take more scans.
BLOCK_BYTES = 8_000_000
#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space; other bytes belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: bytes) -> bytes:
    """The words of a text, each between single spaces."""
    words = text.translate(FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


class Scanner:
    """Finds the windows of items in texts."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        import ahocorasick

        patterns: dict[str, list] = {}
        for name, text in items:
            words = normal(text).decode("latin-1").split(" ")[1:-1]
            for k in range(max(1, len(words) - window + 1) if words else 0):
                part = words[k : k + window]
                entry = patterns.setdefault(f" {' '.join(part)} ", [len(part), set()])
                entry[1].add(name)
        self.automaton = ahocorasick.Automaton()
        for pattern, (n, names) in patterns.items():
            self.automaton.add_word(pattern, (n, tuple(names)))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, the word ranges of all occurrences, the names of the items."""
        folded = normal(text)
        n_words = folded.count(b" ") - 1 if folded else 0
        if self.empty or not n_words:
            return n_words, [], set()
        found = list(self.automaton.iter(folded.decode("latin-1")))
        if not found:
            return n_words, [], set()
        spaces = np.flatnonzero(np.frombuffer(folded, dtype=np.uint8) == 32)
        last = np.searchsorted(spaces, [end for end, _ in found])  # the space after the last word, so the number of words before it
        return n_words, [(int(e) - n, int(e)) for e, (_, (n, _)) in zip(last, found, strict=True)], set().union(*(names for _, (_, names) in found))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of word ranges in the original text."""
    if not ranges:
        return []
    word = np.concatenate([[False], np.frombuffer(text.translate(FOLD), dtype=np.uint8) != 32, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return [(int(edges[2 * a]), int(edges[2 * b - 1])) for a, b in ranges]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """Distinct items, in blocks of about so many bytes; only one block is on the driver at a time."""
    named = stage(items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), text_bytes(text_col).alias("text")).where(F.length("text") > 0).distinct())
    size = named.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for k in range(blocks):
        part = named if blocks == 1 else named.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k)
        yield [(r["name"], bytes(r["text"])) for r in part.collect()]


def scan_documents(docs: DataFrame, items: DataFrame, columns: dict[str, str], text_col: str, item_id: str, item_text: str, window: int) -> DataFrame:
    """``columns`` (source name -> result name), n_words, ranges (merged word ranges that are hit), spans (their bytes in the text) and names (of the
    items) of every document."""
    spark = docs.sparkSession
    hits = ArrayType(ArrayType(LongType()))
    results = [StructField("n_words", LongType()), StructField("ranges", hits), StructField("spans", hits), StructField("names", ArrayType(StringType()))]

    def scanned(block: list[tuple[str, bytes]], kept: dict[str, str], keyed: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def make() -> Callable[[bytes], tuple]:
            scanner = Scanner(shared.value, window)

            def one(text: bytes) -> tuple:
                n, ranges, names = scanner.scan(text)
                found = merged(ranges)
                return n, found, word_spans(text, found), sorted(names)

            return one

        source = docs.select(*kept, *([row_key(next(iter(columns)), text_col).alias("_key")] if keyed else []), text_bytes(text_col))
        fields = [field(docs, c, name) for c, name in kept.items()] + ([source.schema["_key"]] if keyed else [])
        return per_row(source, StructType(fields + results), len(fields), make)

    blocks = item_blocks(items, item_id, item_text)
    first = next(blocks, [])
    more = next(blocks, None)
    if more is None:
        return scanned(first, columns, False)
    base = stage(scanned(first, columns, True))
    found = ("_key", "ranges", "spans", "names")
    parts = [base.select(*found).dropDuplicates(["_key"])]
    while more is not None:
        parts.append(stage(scanned(more, {}, True).where(F.size("names") > 0).select(*found).dropDuplicates(["_key"])))
        more = next(blocks, None)
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("ranges", "spans")]
    together = union.groupBy("_key").agg(*lists, F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    joined = base.drop("ranges", "spans", "names").join(together, "_key")
    fields = [*(base.schema[n] for n in columns.values()), results[0], results[3], results[1], results[2]]
    ready = joined.select(*(f.name for f in fields))
    return per_row(ready, StructType(fields), len(fields) - 2, lambda: lambda *both: tuple(merged([tuple(x) for x in r]) for r in both))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside occurrences), item_ids (sorted), contaminated, spans (bytes of the text that are hit).

    A window is ``window`` consecutive words of an item; a shorter item is one window, an item without words has none. Null text has no
    words, a null item id counts as the empty string; repeated rows are judged alike; an empty table gives no rows; without items nothing
    is hit. Item texts beyond BLOCK_BYTES are scanned for block by block.
    """
    found = scan_documents(docs, items, {id_col: "_id"}, text_col, item_id, item_text, window)
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return found.select(F.col("_id").alias(id_col), "n_words", hit.alias("n_hit"), F.col("names").alias("item_ids"), (hit > 0).alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with all their columns.

    Null and empty texts have no hit; repeated rows are judged alike; without items all stay; an empty table gives no rows; other columns pass
    through, whatever their names."""
    spark = docs.sparkSession
    (clean,) = free_names(docs, 1)
    kept = docs
    for block in item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def make(shared=shared) -> Callable[[bytes], tuple]:
            scanner = Scanner(shared.value, window)
            return lambda text: (not scanner.scan(text)[1],)

        schema = StructType([*docs.schema.fields, StructField(clean, BooleanType())])
        kept = per_row(kept.select(*(F.col(f"`{c}`") for c in docs.columns), text_bytes(f"`{text_col}`")), schema, len(docs.columns), make).where(clean).drop(clean)
    return kept
