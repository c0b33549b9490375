"""CSV files with line breaks inside quotes, read by as many tasks as the files have splits.

Whether a split begins inside a quoted cell depends on all text before it.  So every split first says where it ends for
both beginnings, which is one small row; a running composition of those rows gives every split its true beginning.  Then
the splits cut their lines into records.  Pieces of records that cross a border (at most two a split) are joined by the
split they began in, and the parser sees whole records only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablework import scale
from tablework.session import checkpointed

SPLIT = ["file", "at"]


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted cell is open after the line.  A quote opens a cell only as its first character; a doubled quote is text;
    what follows a closing quote belongs to the cell up to the separator."""
    at = 0
    while True:
        if inside:
            end = line.find(b'"', at)
            while end >= 0 and line[end + 1 : end + 2] == b'"':
                end = line.find(b'"', end + 2)
            if end < 0:
                return True
            inside, at = False, end + 1
        elif at == 0 and line[:1] == b'"':
            inside, at = True, 1
        else:
            opening = line.find(sep + b'"', at)
            if opening < 0:
                return False
            inside, at = True, opening + len(sep) + 1


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Lines as bytes, with file and first byte of their split, in the order of the file inside a split."""
    read = spark.read.option("lineSep", "\n").text(list(files))
    raw = F.col("value").cast("binary")
    start = (F.col("_metadata.file_block_start") == 0) & F.startswith(raw, F.lit(b"\xef\xbb\xbf"))
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.when(start, F.substring(raw, 4, 1 << 30)).otherwise(raw).alias("raw")
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Neighbouring rows of one split."""
    at, n = 0, batch.num_rows
    files, starts = batch.column(0), batch.column(1)
    while at < n:
        key = (files[at].as_py(), starts[at].as_py())
        same = pc.and_(pc.equal(files, key[0]), pc.equal(starts, key[1])).slice(at)
        end = pc.index(same, False).as_py()
        end = n if end < 0 else at + end
        yield key, batch.slice(at, end - at)
        at = end


def split_ends(lines: DataFrame, sep: str) -> DataFrame:
    """Per split ``(file, at, outside, inside)``: whether it ends inside a cell, having begun outside or inside of one."""
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: tuple, ends: list[bool]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [key[0]], "at": pa.array([key[1]], pa.int64()), "outside": [ends[0]], "inside": [ends[1]]})

        now, ends = None, [False, True]
        for batch in batches:
            for key, part in _runs(batch):
                if key != now:
                    if now is not None:
                        yield row(now, ends)
                    now, ends = key, [False, True]
                quoted = part.column(2).filter(pc.match_substring(part.column(2), '"'))
                for line in quoted:
                    ends = [ends_inside(line.as_py(), e, mark) for e in ends]
        if now is not None:
            yield row(now, ends)

    return lines.mapInArrow(run, "file string, at long, outside boolean, inside boolean")


def split_starts(ends: DataFrame) -> DataFrame:
    """Per split whether it begins inside a cell: the last split whose end does not depend on its beginning, turned round by those after it that swap."""
    order = Window.partitionBy("file").orderBy("at")
    swaps = F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(order)
    known = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").cast("int").alias("open"), F.col("swaps")))
    last = F.last(known, ignorenulls=True).over(order)
    after = ends.withColumn("swaps", swaps).withColumn("last", last)
    open_now = (F.coalesce(F.col("last.open"), F.lit(0)) + F.col("swaps") - F.coalesce(F.col("last.swaps"), F.lit(0))) % 2 == 1
    return after.select(*SPLIT, F.coalesce(F.lag(open_now).over(order), F.lit(False)).alias("open"))


def _pieces(lines: DataFrame, starts: DataFrame, sep: str) -> DataFrame:
    """Records and pieces of records: ``(file, at, first, begins, ends, raw)``; first marks the file's first record."""
    opened = starts.filter("open")
    if scale.fits_broadcast(opened):
        told = lines.join(F.broadcast(opened), SPLIT, "left")
    else:
        told = lines.withColumn("n", F.monotonically_increasing_id()).join(opened, SPLIT, "left").repartition(*SPLIT).sortWithinPartitions(*SPLIT, "n")
    told = told.select(*SPLIT, "raw", F.coalesce("open", F.lit(False)).alias("open"))
    mark = sep.encode()
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("first", pa.bool_()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, begins, inside, fresh = None, [], True, False, False
        out: list[tuple] = []

        def put(ends: bool) -> None:
            nonlocal held, begins, fresh
            out.append((*now, fresh, begins, ends, b"\n".join(held)))
            held, begins, fresh = [], True, False

        for batch in batches:
            for key, part in _runs(batch):
                if key != now:
                    if held:
                        put(False)
                    inside = part.column(3)[0].as_py()
                    now, begins, fresh = key, not inside, key[1] == 0
                for line in part.column(2).to_pylist():
                    if b'"' in line:
                        inside = ends_inside(line, inside, mark)
                    held.append(line)
                    if not inside:
                        put(True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if held:
            put(False)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return told.mapInArrow(run, "file string, at long, first boolean, begins boolean, ends boolean, raw binary")


def records(spark: SparkSession, files: Sequence[str], sep: str = ",") -> DataFrame:
    """``(file, first, raw)``: the bytes of every record of the files.  A cell that is never closed takes the rest of its file, as in Spark's own reader.

    Lines end in a line feed, with or without a carriage return; empty lines are no records."""
    lines = _lines(spark, files)
    starts = checkpointed(split_starts(split_ends(lines, sep)))
    pieces = checkpointed(_pieces(lines, starts, sep))
    whole = pieces.filter("begins and ends").select("file", "first", "raw")
    order = Window.partitionBy("file").orderBy("at", F.col("begins").cast("int"))
    torn = pieces.filter("not (begins and ends)").withColumn("from", F.last(F.when(F.col("begins"), F.col("at")), ignorenulls=True).over(order))
    parts = F.array_sort(F.collect_list(F.struct("at", F.col("begins").cast("int").alias("late"), F.col("raw"))))
    joined = torn.groupBy("file", "from").agg(F.bool_or("first").alias("first"), parts.alias("p"))
    glued = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.get("p", F.lit(0))["raw"], lambda a, x: F.concat(a, F.lit(b"\n"), x["raw"]))
    return whole.unionByName(joined.select("file", "first", glued.alias("raw")))


def read_quoted(spark: SparkSession, files: Sequence[str], charset: str, sep: str = ",") -> DataFrame:
    """Files with one header as text columns, the rows that Spark's ``multiLine`` reader gives."""
    columns = spark.read.options(header=True, encoding=charset, multiLine=True, escape='"', sep=sep).csv(files[0]).columns
    text: Column = F.col("raw").cast("string") if charset == "UTF-8" else F.decode("raw", charset)
    text = F.regexp_replace(F.regexp_replace(text, "\r$", ""), "\r\n", "\n")
    rows = records(spark, files, sep).filter("not first").select(text.alias("text")).filter("text <> ''")
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    return rows.select(F.from_csv("text", ddl, {"escape": '"', "sep": sep, "multiLine": "true"}).alias("r")).select("r.*")
