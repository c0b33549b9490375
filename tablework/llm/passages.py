"""Substring dedup of passages: paragraph MinHash banding, exact Jaccard similarity, removals by components.

Two kinds of passages are units: lines of at least MIN_WORDS words, and, as a passage may stand inside a longer paragraph or be wrapped into short
lines, runs of words that stand elsewhere too. Windows of MIN_WORDS words whose hash is the least among REACH neighbouring windows are the anchors
of such runs: a shared passage of MIN_WORDS + REACH - 1 words has one wherever it stands, and another within REACH - 1 places as long as it goes
on. From the ends of a chain of shared anchors the words of both texts are aligned outwards: the run goes on over equal words, and over up to GAP
changed, missing or added words if BRIDGE equal ones follow. Lines are linked by similarity, anchors by equality. Of every component the first unit stays.

Whole texts meet lists of places by a shuffle at every size, as they have to at scale, so what is moved grows as the input does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tablework.llm.common import BROADCAST_ROWS, field, free_names, join_checked, map_arrow, passing, per_row, row_key, rows_at, stage, text_bytes
from tablework.llm.hashing import LOWER, Rolling, mix, word_bounds
from tablework.llm.minhash import WORD_SEED, Circulant, band_keys, link_sets, set_id

MIN_WORDS = 20
REACH = 24
SHINGLE = 5
PERCENT = 80
#: A pair of similarity 0.8 meets in none of the bands with probability 3e-4, one of 0.9 with 2e-6.
ROWS, BANDS = 2, 8
#: Words that are aligned beyond an anchor, words that may differ at one place, and equal words that must follow.
OUTWARD, GAP, BRIDGE = 80, 3, 5
EDITS = sorted(((a, b) for a in range(GAP + 1) for b in range(GAP + 1) if a or b), key=lambda e: (max(e), sum(e), e))
#: Units that a task hands on at once.
FLUSH = 20_000
U64 = np.uint64

UNIT = StructType([
    StructField("key", BinaryType()), StructField("lo", IntegerType()), StructField("hi", IntegerType()),
    StructField("n", LongType()), StructField("id", BinaryType()), StructField("bands", ArrayType(LongType())),
    StructField("h1", LongType()), StructField("h2", LongType()),
])


class Grams:
    """Hashes of the runs of so many words, as polynomials in a factor, from one running sum."""

    def __init__(self, factor: int) -> None:
        self.factor, self.inverse = factor, pow(factor, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def __call__(self, words: np.ndarray, width: int, first: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of all runs, or of those at some places; ``first`` is the coefficient of the highest power."""
        if len(self.up) < len(words) + 1:
            powers = np.full((2, max(len(words) + 1, 1 << 14)), [[self.factor], [self.inverse]], dtype=U64)
            powers[:, 0] = 1
            self.up, self.down = np.multiply.accumulate(powers, axis=1)
        sums = np.zeros(len(words) + 1, dtype=U64)
        np.cumsum(words * self.down[: len(words)], out=sums[1:])
        n = len(words) - width + 1
        lead, last = U64(first * pow(self.factor, width, 1 << 64) & (1 << 64) - 1), U64(pow(self.factor, width - 1, 1 << 64))
        if at is None:
            return mix((sums[width:] - sums[:n]) * self.up[:n] * last + lead)
        return mix((sums[at + width] - sums[at]) * self.up[at] * last + lead)


class Cutter:
    """Finds the units of a text."""

    def __init__(self) -> None:
        self.rolling, self.circulant = Rolling(WORD_SEED), Circulant(ROWS * BANDS)
        self.grams, self.others = Grams(0xD6E8FEB86659FD93), Grams(0xA24BAED4963EE407)

    def units(self, text: bytes) -> tuple[list[tuple], list[np.ndarray]]:
        """Lines (lo, hi, n, id, bands) and anchors (lo, hi, number of the first word, h1, h2); lo and hi are bytes."""
        data = np.frombuffer(text.translate(LOWER), dtype=np.uint8)
        start, end = word_bounds(data)
        if len(start) < MIN_WORDS:
            return [], [np.empty(0, dtype=np.int64)] * 5
        words = self.rolling.ranges(self.rolling.sums(data), start, end)
        return self._lines(data, start, end, words), self._anchors(start, end, words)

    def _lines(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> list[tuple]:
        line = np.searchsorted(np.flatnonzero(data == 10), start)
        first = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1])
        size = np.diff(np.concatenate([first, [len(line)]]))
        first, size = first[size >= MIN_WORDS], size[size >= MIN_WORDS]
        if not len(first):
            return []
        n = size - SHINGLE + 1
        at = np.concatenate([[0], np.cumsum(n)])
        taken = self.grams(words, SHINGLE, SHINGLE)[np.repeat(first - at[:-1], n) + np.arange(at[-1])]
        # the value in the permutation, then the shingle itself, so that a coordinate names the shingle it comes from
        pairs = self.circulant.rows[self.circulant.places(taken)].T.astype(U64)
        pairs <<= U64(32)
        pairs |= taken & U64(0xFFFFFFFF)
        bands = band_keys(np.minimum.reduceat(pairs, at[:-1], axis=1).T, ROWS)
        for lo, hi in zip(at.tolist(), at[1:].tolist(), strict=False):
            taken[lo:hi].sort()
        new = np.concatenate([[True], taken[1:] != taken[:-1]])
        new[at[:-1]] = True
        found, edges = taken[new], np.concatenate([[0], np.cumsum(new)])[at].tolist()
        bounds = zip(start[first].tolist(), end[first + size - 1].tolist(), edges, edges[1:], bands, strict=False)
        return [(lo, hi, b - a, set_id(found[a:b]), keys) for lo, hi, a, b, keys in bounds]

    def _anchors(self, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
        one = self.grams(words, MIN_WORDS, MIN_WORDS)
        reach = min(REACH, len(one))
        view = np.lib.stride_tricks.as_strided(one, (len(one) - reach + 1, reach), (8, 8), writeable=False)
        least = view.argmin(axis=1) + np.arange(len(view))  # never goes back
        at = least[np.concatenate([[True], least[1:] != least[:-1]])]
        return [start[at], end[at + MIN_WORDS - 1], at, one[at].view(np.int64), self.others(words, MIN_WORDS, 7, at).view(np.int64)]


def context(rolling: Rolling, text: bytes, places: list[tuple[int, int]]) -> Iterator[bytes]:
    """For each window (its first byte, and 0 for what stands before it or 1 for what follows) 32-bit hashes of up to OUTWARD words from it on outwards."""
    data = np.frombuffer(text.translate(LOWER), dtype=np.uint8)
    start, end = word_bounds(data)
    words = (rolling.ranges(rolling.sums(data), start, end) >> U64(32)).astype(np.uint32)
    for at, (_, after) in zip(np.searchsorted(start, [lo for lo, _ in places]).tolist(), places, strict=True):
        yield (words[at + MIN_WORDS : at + MIN_WORDS + OUTWARD] if after else words[max(0, at - OUTWARD) : at][::-1]).tobytes()


def stretched(text: bytes, units: list[dict]) -> None:
    """Puts the bytes of extensions in the place of their anchor (lo), side and number of words (hi)."""
    start, end = word_bounds(np.frombuffer(text, dtype=np.uint8))
    for u in units:
        if u["side"] is not None:
            at = int(np.searchsorted(start, u["lo"]))
            u["lo"], u["hi"] = (u["lo"], int(end[at + MIN_WORDS + u["hi"] - 1])) if u["side"] else (int(start[at - u["hi"]]), u["lo"])


def aligned(x: list[int], y: list[int]) -> tuple[int, int]:
    """How many words of each go on alike from their starts: equal ones, and others between them if few and followed by BRIDGE equal ones."""
    i = j = 0
    while True:
        while i < len(x) and j < len(y) and x[i] == y[j]:
            i, j = i + 1, j + 1
        for a, b in EDITS:
            if len(x) >= i + a + BRIDGE and x[i + a : i + a + BRIDGE] == y[j + b : j + b + BRIDGE]:
                i, j = i + a, j + b
                break
        else:
            return i, j


def unit_tables(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines and anchors: key (of the row), lo, hi, n (of an anchor the number of its first word), for lines id and bands, for anchors h1 and h2."""

    arrow = to_arrow_schema(UNIT)

    def anchors_of(keys: pa.Array, index: list[int], parts: list[list[np.ndarray]]) -> list:
        lo, hi, n, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        where = np.repeat(index, [len(p[0]) for p in parts])
        none = [pa.nulls(len(lo), arrow.field(c).type) for c in ("id", "bands")]
        return [rows_at(keys, where), lo.astype(np.int32), hi.astype(np.int32), n, *none, h1, h2]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        cutter = Cutter()
        for batch in batches:
            keys, held = batch.column(0), 0
            index: list[int] = []
            found: list[list[np.ndarray]] = []
            at: list[int] = []
            out: list[list] = [[] for _ in range(5)]
            for i in range(batch.num_rows):
                lines, anchors = cutter.units(batch.column(1)[i].as_py())
                if len(anchors[0]):
                    index.append(i)
                    found.append(anchors)
                    held += len(anchors[0])
                for x in lines:
                    at.append(i)
                    for c, v in zip(out, x, strict=True):
                        c.append(v)
                if held > FLUSH:
                    yield anchors_of(keys, index, found)
                    index, found, held = [], [], 0
            if found:
                yield anchors_of(keys, index, found)
            if at:
                none = pa.nulls(len(at), pa.int64())
                yield [rows_at(keys, at), *out, none, none]

    return map_arrow(docs.select(row_key(id_col, text_col), text_bytes(text_col)), UNIT, rows)


def with_first(units: DataFrame, *on: str) -> DataFrame:
    """The units that are alike in some columns, with the place of the first of them."""
    place = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "key", "lo")
    firsts = stage(units.groupBy(*on).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    return join_checked(units, firsts, list(on))


def shared_runs(found: DataFrame) -> DataFrame:
    """The runs that are covered by shared anchors, of those that have their first copies in one document: columns as of linked_units."""
    marked = found.select(
        "key", "lo", "hi", ((F.col("key") == F.col("first.key")) & (F.col("lo") == F.col("first.lo"))).alias("kept"), F.col("first._id").alias("first_id"), F.col("first.key").alias("first_key")
    )
    order = Window.partitionBy("key", "kept", "first_key").orderBy("lo")
    begins = F.coalesce(F.col("lo") > F.lag("hi").over(order), F.lit(True)).cast("int")
    runs = marked.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order)).groupBy("key", "kept", "first_key", "run")
    return runs.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("first_id").alias("first_id")).select(
        "key", "lo", "hi", F.lit(None).cast("int").alias("side"), F.lit(True).alias("window"), "kept", (F.col("key") == F.col("first_key")).alias("own"), "first_id"
    )


def extensions(source: DataFrame, found: DataFrame) -> DataFrame:
    """How runs go on beyond their anchors: columns as of linked_units. In a text that repeats itself, what the first copy has there is kept.

    ``source``: key, text; ``found``: shared anchors with their first copies. Only the ends of chains of anchors travel, with OUTWARD words each."""
    own = F.col("key") == F.col("first.key")
    going = found.where(~own | (F.col("lo") != F.col("first.lo"))).select("key", "lo", "n", F.col("first.key").alias("f_key"), F.col("first.lo").alias("f_lo"), F.col("first._id").alias("f_id"))
    order = Window.partitionBy("key", "f_key").orderBy("n")
    begins = F.coalesce(F.col("n") > F.lag("n").over(order) + MIN_WORDS, F.lit(True))
    ends = F.coalesce(F.lead("n").over(order) > F.col("n") + MIN_WORDS, F.lit(True))
    sides = F.filter(F.array(F.when(begins, 0), F.when(ends, 1)), lambda x: x.isNotNull())
    asked = stage(going.withColumn("sides", sides).where(F.size("sides") > 0).select("key", "lo", "f_key", "f_lo", "f_id", F.explode("sides").alias("side")))
    firsts = asked.select(F.col("f_key").alias("key"), F.col("f_lo").alias("lo"), "side").distinct()
    same = F.struct("lo", "side", "f_key", "f_lo", "f_id")
    none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("f_key", "f_lo", "f_id")]
    lists = stage(asked.select("key", same.alias("e")).unionByName(firsts.select("key", F.struct("lo", "side", *none).alias("e"))).groupBy("key").agg(F.collect_set("e").alias("asked")))
    held = source.join(lists, "key").select("key", "text", "asked").dropDuplicates(["key"])
    entry = lists.schema["asked"].dataType.elementType
    schema = StructType([StructField("key", BinaryType()), *entry.fields, StructField("words", BinaryType())])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        rolling = Rolling(WORD_SEED)
        for batch in batches:
            for i in range(batch.num_rows):
                entries = batch.column(2)[i].values
                columns = entries.flatten()
                places = list(zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True))
                yield [[batch.column(0)[i].as_py()] * len(places), *columns, list(context(rolling, batch.column(1)[i].as_py(), places))]

    cut_out = stage(map_arrow(held, schema, contexts))
    first = cut_out.where("f_key IS NULL").select(F.col("key").alias("f_key"), F.col("lo").alias("f_lo"), "side", F.col("words").alias("f_words"))
    both = join_checked(cut_out.where("f_key IS NOT NULL"), first, ["f_key", "f_lo", "side"], rows=BROADCAST_ROWS // 100)  # a row holds OUTWARD words
    out = StructType([
        StructField("key", BinaryType()), StructField("lo", IntegerType()), StructField("hi", IntegerType()), StructField("side", IntegerType()),
        StructField("kept", BooleanType()), StructField("own", BooleanType()), field(asked, "f_id", "first_id"),
    ])

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            made: list[list] = [[] for _ in range(7)]
            for key, lo, side, f_key, f_lo, f_id, words, f_words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, j = (len(words) // 4,) * 2 if words == f_words else aligned(memoryview(f_words).cast("I").tolist(), memoryview(words).cast("I").tolist())
                for n, at, kept in ((j, lo, False), (i if key == f_key else 0, f_lo, True)):
                    if n:
                        for c, x in zip(made, (key, at, n, side, kept, key == f_key, f_id), strict=True):
                            c.append(x)
            yield made

    found_more = map_arrow(both.select("key", "lo", "side", "f_key", "f_lo", "f_id", "words", "f_words"), out, longer)
    return found_more.select("key", "lo", "hi", "side", F.lit(True).alias("window"), "kept", "own", "first_id")


def linked_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, lo, hi, side (null, or where an extension lies of the anchor at lo; hi is its number of words then), window (a run of anchors, else a line), kept (the first of its component), own (the first is in the same row) and first_id
    (the id of the document that has that one) of every unit that has a copy."""
    source = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("key"), text_bytes(text_col).alias("text"))
    ids = stage(source.select("_id", "key").distinct())
    with passing() as kept:
        units = stage(unit_tables(docs, id_col, text_col))
        lines = kept(linked_lines(units.where("id IS NOT NULL"), source, ids))
        windows = units.where("h1 IS NOT NULL").select("key", "lo", "hi", "n", "h1", "h2")
        often = stage(windows.groupBy("h1").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("h1"))
        repeated = stage(join_checked(windows, often, ["h1"], rows=4 * BROADCAST_ROWS).join(ids, "key"))  # a row is one number
        found = kept(with_first(repeated, "h1", "h2"))
    return lines.unionByName(shared_runs(found)).unionByName(extensions(source.select("key", "text"), found))


def linked_lines(lines: DataFrame, source: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines that have a copy: columns as of linked_units. ``source``: key, text; ``ids``: _id, key."""
    with passing() as kept:
        classes = stage(lines.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(F.struct("key", "lo", "hi")).alias("one")))

        def texts_of(wanted: DataFrame) -> DataFrame:
            parts = stage(classes.select("id", "one").join(wanted, "id").groupBy("one.key").agg(F.collect_list(F.struct("id", "one.lo", "one.hi")).alias("parts")))
            total = parts.agg(F.sum(F.size("parts"))).first()[0] or 0
            held = join_checked(source.select("key", "text"), parts, ["key"], counted=total).select("text", F.explode("parts").alias("p"))
            return held.select("p.id", F.substring("text", F.col("p.lo") + 1, F.col("p.hi") - F.col("p.lo")).alias("text")).dropDuplicates(["id"])

        roots = link_sets(classes.select("id", "n", "copies", "bands"), texts_of, SHINGLE, PERCENT)
        groups = kept(classes.where("copies > 1").select("id").join(roots, "id", "full").select("id", F.coalesce("root", "id").alias("root")))
    similar = join_checked(lines.select("key", "lo", "hi", "id"), groups, ["id"]).select("key", "lo", "hi", "root")
    own = F.col("key") == F.col("first.key")
    return with_first(stage(similar.join(ids, "key")), "root").select("key", "lo", "hi", F.lit(None).cast("int").alias("side"), F.lit(False).alias("window"), (own & (F.col("lo") == F.col("first.lo"))).alias("kept"), own.alias("own"), F.col("first._id").alias("first_id"))


def cut(text: bytes, units: list[dict] | None) -> tuple[bytes, int]:
    """The text without repeated units, and the number of bytes that went. A run that stays protects its words from copies in the same text
    (they may overlap), not from those that an earlier document has."""
    if not units:
        return text, 0
    stretched(text, units)
    gone = np.zeros(len(text), dtype=bool)
    for u in units:
        if u["window"] and u["own"] and not u["kept"]:
            gone[u["lo"] : u["hi"]] = True
    for u in units:
        if u["window"] and u["kept"]:
            gone[u["lo"] : u["hi"]] = False
    for u in units:
        if not u["kept"] and not (u["window"] and u["own"]):
            gone[u["lo"] : u["hi"]] = True
    return np.frombuffer(text, dtype=np.uint8)[~gone].tobytes(), int(gone.sum())


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_repeated (units that have a copy anywhere), n_removed (bytes), copied_from (ids of the other
    documents that keep what was removed, ascending), kept_text (bytes), kept_sha256, and _key.

    The first unit of a component by (id, row key, place) stays, others are removed. Null text is empty; texts without passages of MIN_WORDS
    words stay as they are; rows that repeat are the same document and judged alike; a null id comes last; an empty table gives no rows;
    other columns are ignored.
    """
    with passing() as kept:
        units = kept(linked_units(docs, id_col, text_col))
    listed = F.collect_set(F.struct("lo", "hi", "side", "window", "kept", "own"))
    sources = F.collect_set(F.when(~F.col("kept"), F.col("first_id")))
    lists = stage(units.groupBy("key").agg(listed.alias("units"), F.array_sort(sources).alias("first_ids")))
    source = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("key"), text_bytes(text_col).alias("_text"))
    joined = source.join(lists, "key", "left")
    copied = F.coalesce(F.filter("first_ids", lambda x: ~x.eqNullSafe(F.col("_id"))), F.array().cast(ArrayType(docs.schema[id_col].dataType)))
    ready = joined.select("_id", "key", copied.alias("copied_from"), "_text", "units")
    schema = StructType([
        field(ready, "_id", id_col), StructField("_key", BinaryType()), field(ready, "copied_from"), StructField("n_bytes", LongType()), StructField("n_repeated", LongType()),
        StructField("n_removed", LongType()), StructField("kept_text", BinaryType()), StructField("kept_sha256", StringType()),
    ])

    def one(text: bytes, units: list[dict] | None) -> tuple:
        kept, gone = cut(text, units)
        return len(text), len(units or ()), gone, kept, hashlib.sha256(kept).hexdigest()

    return per_row(ready, schema, 3, lambda: one)


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents with their columns, texts (and their sizes in characters) without repeated passages; those left without a word go.

    A text without repeated passages stays as it is, a null one too; rows that repeat are judged alike; an empty table gives no rows; other columns
    pass through, whatever their names."""
    with passing() as kept:
        units = kept(linked_units(docs, id_col, text_col))
    listed = F.collect_set(F.struct("lo", "hi", "side", "window", "kept", "own"))
    key, spans, new, gone = free_names(docs, 4)
    lists = stage(units.where("NOT kept OR window").groupBy("key").agg(listed.alias(spans)).withColumnRenamed("key", key))
    hit = docs.withColumn(key, row_key(id_col, text_col)).join(lists, key, "left")
    place = docs.columns.index(text_col)
    others = [c for c in docs.columns if c != text_col]
    ready = hit.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text_col}`").cast("string"), spans)
    schema = StructType([*(docs.schema[c] for c in others), StructField(new, StringType()), StructField(gone, LongType())])

    def one(text: str | None, units: list[dict] | None) -> tuple:
        if not units or text is None:
            return text, 0
        kept, lost = cut(text.encode("utf-8", "surrogatepass"), units)
        return kept.decode("utf-8", "replace"), lost

    made = per_row(ready, schema, len(others), lambda: one)
    left = made.where((F.col(gone) == 0) | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    if size_col in others:
        left = left.withColumn(size_col, F.when(F.col(gone) > 0, F.length(new).cast(docs.schema[size_col].dataType)).otherwise(F.col(f"`{size_col}`")))
    named = [F.col(f"`{c}`") for c in others]
    return left.select(*named[:place], F.col(new).alias(text_col), *named[place:])
