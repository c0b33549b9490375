"""URL lists in a cascade of Bloom filters, native functions only.

The first filter encodes the listed keys, the second those keys of the corpus that pass the first without being listed, the third
the listed keys that pass the second, and so on until nothing passes wrongly. As the levels are built over every key that the corpus
has, the answer is exact for every page, and no page is joined with the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import free_names, stage

#: Bits for each key, hash functions, and the largest filter: longer lists are worked off in blocks by hash of the key.
BITS = 16
HASHES = 4
MAX_BITS = 1 << 26


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_keys(host: Column, path: Column, labels: int, segments: int) -> Column:
    """Keys ``suffix of the host + start of the path up to a /``, longest first: all that a rule of at most so many labels and slashes can fit."""
    names = F.split(host, r"\.", -1)
    pieces = F.split(path, "/", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), F.size(names))), lambda n: F.array_join(F.slice(names, F.size(names) - n + 1, n), "."))
    depth = F.least(F.lit(segments), F.size(pieces) - 1)
    starts = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: F.concat(F.array_join(F.slice(pieces, 1, n), "/"), F.lit("/"))))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    ordered = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"))))
    return F.coalesce(F.transform(ordered, lambda s: s["key"]), F.array().cast("array<string>"))


class Level:
    """One Bloom filter: 64-bit words in an array that every task gets as a constant."""

    def __init__(self, keys: DataFrame, n: int, seed: int) -> None:
        bits = 64
        while bits < BITS * n and bits < MAX_BITS:
            bits *= 2
        self.bits, self.seed = bits, seed
        places = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("at"))
        words = places.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("w"))
        full = words.unionByName(keys.sparkSession.range(bits // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w")))
        summed = full.groupBy("i").agg(F.bit_or("w").alias("w"))
        self.words = F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"])
        self.words = stage(summed.agg(self.words.alias("words"))).scalar()

    def _places(self, key: Column) -> list[Column]:
        return [F.xxhash64(F.concat(F.lit(f"{self.seed}.{k}."), key)).bitwiseAND(F.lit(self.bits - 1)) for k in range(HASHES)]

    def passes(self, key: Column) -> Column:
        found = F.lit(True)
        for at in self._places(key):
            word = F.element_at(self.words, (F.shiftright(at, 6) + 1).cast("int"))
            found = found & (F.call_function("bit_get", word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return found


class Cascade:
    """Exact membership of a listed set, for every key of a universe that contains it or not.

    ``listed`` and ``universe`` have a column ``key``; both should be written tables."""

    def __init__(self, listed: DataFrame, universe: DataFrame) -> None:
        marked = universe.select("key", F.lit(0).alias("in")).unionByName(listed.select("key", F.lit(1).alias("in")))
        known = stage(marked.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("in").alias("in")))
        self.levels: list[Level] = []
        inside, outside = known.where("in = 1"), known.where("in = 0")
        n = inside.count()
        while n:
            level = Level(inside, n, len(self.levels))
            self.levels.append(level)
            passed = stage(outside.where(level.passes(F.col("key"))).select("key"))
            inside, outside, n = passed, inside, passed.count()

    def has(self, key: Column) -> Column:
        """Passing an odd number of levels in a row means listed; a null key is not."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(level.passes(key), answer).otherwise(F.lit(i % 2 == 1))
        return key.isNotNull() & answer


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (the longest rule that fits, else null) and ``verdict`` (``allow`` or ``block``) to the page's columns.

    ``rules`` has ``action`` and ``key``, a host and the start of a path that ends in ``/``; it fits the host and its subdomains. A key
    listed for both actions blocks. Pages that no rule fits are allowed. A null url or one without ``://`` has an empty host and path and
    fits no rule; repeated rows are judged alike; empty tables give no rows. Input columns named like results are replaced.
    """
    rules = stage(rules.where(F.col("key").isNotNull()).select("action", "key").distinct())
    size = rules.agg(
        F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\.", -1))).alias("labels"),
        F.max(F.length("key") - F.length(F.regexp_replace("key", "/", ""))).alias("segments"),
    ).first()
    parsed = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    keys = url_keys(F.col("host"), F.col("path"), size["labels"] or 1, size["segments"] or 1)
    universe = stage(parsed.select("host", "path").select(F.explode(keys).alias("key")).distinct())
    listed, fit, new = free_names(parsed, 3)
    places = [F.get(listed, F.lit(i)) for i in range((size["labels"] or 1) * (size["segments"] or 1))]
    blocks = max(1, -(-rules.count() * BITS // MAX_BITS))
    judged = parsed.withColumn(listed, keys).withColumn(fit, F.lit(None).cast("struct<n: int, rule: string, verdict: string>"))
    for b in range(blocks):
        mine = lambda k, b=b: F.pmod(F.xxhash64(k), F.lit(blocks)) == b
        part = universe.where(mine(F.col("key")))
        cascades = [(a, Cascade(rules.where((F.col("action") == a) & mine(F.col("key"))).select("key"), part)) for a in ("block", "allow")]
        fits = [F.when(mine(k) & cascade.has(k), F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit(a).alias("verdict"))) for k in places for a, cascade in cascades]
        found = judged.withColumn(new, F.coalesce(*fits))
        longer = F.col(fit).isNull() | (F.col(new)["n"] > F.col(fit)["n"])
        judged = found.withColumn(fit, F.when(F.col(new).isNotNull() & longer, F.col(new)).otherwise(F.col(fit))).drop(new)
        if blocks > 1:
            judged = stage(judged)
    return judged.withColumn("rule", F.col(fit)["rule"]).withColumn("verdict", F.coalesce(F.col(fit)["verdict"], F.lit("allow"))).drop(listed, fit)
