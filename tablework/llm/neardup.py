"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard similarity, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tablework.llm.common import field, free_names, join_checked, passing, per_row, row_key, stage, text_bytes
from tablework.llm.hashing import Rolling, shingles, word_hashes
from tablework.llm.minhash import WORD_SEED, Circulant, band_keys, link_sets, set_id

#: Coordinates of a band and number of bands: a pair of similarity 0.85 meets in none of them with probability 1e-9, one of 0.8 with 5e-7.
ROWS, BANDS = 5, 36


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """_id, _key (of the row), id (of the set of shingles), n (its size) and bands of every whole text."""
    schema = StructType([field(docs, id_col, "_id"), StructField("_key", BinaryType()), StructField("id", BinaryType()), StructField("n", LongType()), StructField("bands", ArrayType(LongType()))])

    def make() -> Callable[[bytes], tuple]:
        rolling, circulant = Rolling(WORD_SEED), Circulant(ROWS * BANDS)

        def one(text: bytes) -> tuple:
            found = shingles(word_hashes(rolling, text), width)
            return set_id(found), len(found), band_keys(circulant.signature(found), ROWS) if len(found) else []

        return one

    return per_row(docs.select(id_col, row_key(id_col, text_col), text_bytes(text_col)), schema, 2, make)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id reachable over links), kept (the id is that one), _key,
    and _chosen (of the rows with the least id, those with the least key).

    Sets are the distinct shingles of ``width`` lower-cased words; a shorter text is one shingle. Texts without words (null, empty) have an
    empty set, no links, and are kept. Equal sets are one class and compared once. Repeated rows are linked and judged alike; a null id is
    never the least unless all are null; an empty table gives no rows; other columns are ignored.
    """
    found = stage(signatures(docs, id_col, text_col, width))
    classes = stage(found.where("n > 0").groupBy("id").agg(F.min("_key").alias("_key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")))

    def texts_of(ids: DataFrame) -> DataFrame:
        keys = stage(classes.select("id", "_key").join(ids, "id"))
        texts = docs.select(row_key(id_col, text_col).alias("_key"), text_bytes(text_col).alias("text"))
        return join_checked(texts, keys, ["_key"]).select("id", "text").dropDuplicates(["id"])

    roots = stage(link_sets(classes, texts_of, width, percent))
    narrow = found.select("_id", "_key", "id", "n")
    placed = stage(join_checked(narrow, roots, ["id"], "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "id"))).drop("id"))
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_key"))
    firsts = stage(placed.where(F.col("root").isNotNull()).groupBy("root").agg(first.alias("_first")))
    joined = join_checked(placed, firsts, ["root"], "left")
    alone = F.col("root").isNull()
    component = F.when(alone, F.col("_id")).otherwise(F.col("_first._id"))
    return joined.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"),
        "_key", (alone | (F.col("_key") == F.col("_first._key"))).alias("_chosen"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, one of each group of near duplicates: the one with the least id, of repeated rows one.

    Texts without words (null, empty) are no duplicates of each other, only of rows with the same id; ties go to the least id, a null id comes last; an
    empty table gives no rows; other columns pass through, whatever their names."""
    with passing() as kept:
        judged = kept(near_duplicates(docs, id_col, text_col, width, percent))
    (key,) = free_names(docs, 1)
    gone = stage(judged.where(~F.col("_chosen")).select(F.col("_key").alias(key)).distinct())
    again = stage(judged.where("_chosen").groupBy("_key").count().where("count > 1").select(F.col("_key").alias(key)))
    left = join_checked(docs.withColumn(key, row_key(id_col, text_col)), gone, [key], "left_anti")
    single = join_checked(left, again, [key], "left_anti")
    return single.unionByName(join_checked(left, again, [key], "left_semi").dropDuplicates([key])).drop(key)
