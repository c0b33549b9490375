"""Quality rules by host: rule failures per host, shrunk with an empirical beta prior, joined back to the documents."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tablework.llm.common import field, free_names, join_checked, per_row, stage, text_bytes
from tablework.llm.hashing import mix

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: Words in a window whose repetition counts.
WINDOW = 8
MIN_WORDS = 20
#: Percent of the words that may stand in repeated windows.
MAX_REPEAT = 30
#: A host is rejected if its failure rate is above this even ``HOST_Z`` deviations lower.
HOST_RATE = 0.5
HOST_Z = 2.0


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of so many words found twice or more in the list, all of its places included.

    Windows are first told apart by hashes; only a list with equal hashes is gone through exactly."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=len(words))
    rolled = np.zeros(n, dtype=np.uint64)
    spread = mix(ids + np.uint64(1))
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + spread[k : k + n]
    if len(np.unique(rolled)) == n:
        return 0
    pair, width = ids, 1
    while width < window:  # exact numbers of windows of 2, 4, 8 ... words from numbers of their halves
        step = min(width, window - width)
        left, right = pair[: len(pair) - step], pair[step:]
        _, inverse = np.unique(left * np.uint64(len(ids) + 1) + right, return_inverse=True)
        pair, width = inverse.astype(np.uint64), width + step
    counts = np.bincount(pair.astype(np.int64))
    again = np.flatnonzero(counts[pair.astype(np.int64)] > 1)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + window, -1)
    return int(np.count_nonzero(np.cumsum(change[:-1])))


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    words = text.split()
    chars = len(text.translate(None, WHITE).decode("utf-8", "replace"))
    lines = Counter(x for x in text.split(b"\n") if x.strip(WHITE))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), sum(lines.values()) - len(lines), repeated_words(words)


def document_stats(docs: DataFrame, columns: dict[str, str], text_col: str = "text") -> DataFrame:
    """``columns`` (source name -> result name) and the statistics of every whole text; null text has no words."""
    schema = StructType(
        [field(docs, c, name) for c, name in columns.items()]
        + [StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    )
    return per_row(docs.select(*columns, text_bytes(text_col)), schema, len(columns), lambda: text_stats)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def host_verdicts(stats: DataFrame, host_col: str, failed: Column) -> DataFrame:
    """Hosts with their shrunk failure rate: ``host_col``, n, failures, rate, rejected.

    The beta prior has the mean and the variance of the hosts' rates (method of moments, hosts weighted alike; where the rates do
    not vary beyond what counts of this size explain, the prior weighs as much as the mean host). Rows without a host have no verdict.
    """
    hosts = stage(stats.where(F.col(host_col).isNotNull()).groupBy(host_col).agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("failures")))
    rate = F.col("failures") / F.col("n")
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n")).alias("inverse"), F.avg("n").alias("size")).first()
    mean = min(max(m["mean"] if m["mean"] is not None else 0.0, 1e-3), 1 - 1e-3)
    noise = mean * (1 - mean)
    between = (m["var"] or 0.0) - noise * (m["inverse"] or 0.0)
    weight = max(1.0, noise / between - 1) if between > 1e-9 else max(1.0, m["size"] or 1.0)
    alpha, beta = mean * weight, (1 - mean) * weight
    total = F.col("n") + alpha + beta
    shrunk = (F.col("failures") + alpha) / total
    spread = F.sqrt(shrunk * (1 - shrunk) / (total + 1))
    return hosts.withColumn("rate", shrunk).withColumn("rejected", shrunk - HOST_Z * spread > HOST_RATE)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: the id, its statistics, ``base_failed`` and ``kept``.

    A document is kept if it meets the base rules and its host is not rejected. Null text has no words and fails; a null host has no
    verdict; an empty table gives no rows; repeated rows count as often as they stand. Other columns are ignored.
    """
    stats = stage(document_stats(docs, {id_col: "_id", host_col: "_host"}, text_col).withColumn("base_failed", base_failed()))
    rejected = stage(host_verdicts(stats, "_host", F.col("base_failed")).where("rejected").select("_host", F.lit(False).alias("_good")))
    judged = join_checked(stats, rejected, ["_host"], "left")
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("_good", F.lit(True))).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that ``quality_rules`` keeps, with all their columns.

    Null and empty texts fail; a null host has no verdict; repeated rows are judged alike and count as often as they stand; an empty table gives
    no rows; other columns pass through, whatever their names."""
    failing, host = free_names(docs, 2)
    schema = StructType([*docs.schema.fields, StructField(failing, BooleanType())])

    def failed(text: bytes) -> tuple[bool]:
        words = text.split()
        return (len(words) < MIN_WORDS or 100 * repeated_words(words) > MAX_REPEAT * len(words),)

    flagged = per_row(docs.select(*(F.col(f"`{c}`") for c in docs.columns), text_bytes(f"`{text_col}`")), schema, len(docs.columns), lambda: failed)
    hosts = flagged.select(F.col(f"`{host_col}`").alias("_host"), F.col(failing).alias("_failed"))
    rejected = stage(host_verdicts(hosts, "_host", F.col("_failed")).where("rejected").select(F.col("_host").alias(host)))
    good = flagged.where(~F.col(failing)).drop(failing)
    return join_checked(good, rejected, good[host_col] == rejected[host], "left_anti")
