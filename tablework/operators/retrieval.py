"""Chunked documents and hybrid (vector and lexical) search."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tablework import scale
from tablework.functions.columns import trim_ws
from tablework.functions.text import DIM, EMBED_VERSION, clean, embed_batch, embed_counted, hash_embed, packed_grams
from tablework.session import batches_within, give_back

CHUNK_SIZE = 900
CHUNK_OVERLAP = 120
#: Chunks and queries of a packed row, and buckets of the upper bound on shared grams.
BLOCK, QUERY_BLOCK, BUCKETS = 128, 256, 1024
#: Chunks that a task packs at once, and documents that it cuts at once.
PACKED, CUT = 2048, 500
#: Rows of an index (about 0.6 MB each) in a row group, and bytes of an Arrow batch: what a task holds of an index at once.
INDEX_ROWS, BATCH_BYTES = 16, 16 << 20
VECTOR_WEIGHT = 0.6
LEXICAL_WEIGHT = 0.4


def chunks_of(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Paragraphs packed up to ``size``; a longer paragraph is cut into overlapping windows."""
    body = str(text or "").replace("\r\n", "\n").strip()
    out: list[str] = []
    packed: list[str] = []
    length = 0

    def flush():
        nonlocal length
        if packed:
            out.append("\n\n".join(packed))
        packed.clear()
        length = 0

    for para in filter(None, (p.strip() for p in re.split(r"\n\s*\n", body))):
        if len(para) > size:
            flush()
            out.extend(para[at : at + size] for at in range(0, len(para), max(1, size - overlap)))
            continue
        if packed and length + 2 + len(para) > size:
            flush()
        length += len(para) + (2 if packed else 0)
        packed.append(para)
    flush()
    return out


def chunk_text(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``(doc_id, chunk_index, text)``.  Packing is sequential inside a document only."""

    docs = scale.spread(docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text")))
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("chunk_index", IntegerType(), False), StructField("text", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, CUT) for b in batches for k in range(0, b.num_rows, CUT)):
            cut = [chunks_of(t.as_py(), size, overlap) for t in batch.column(1)]
            owner = pa.array([i for i, c in enumerate(cut) for _ in c], type=pa.int64())
            columns = [batch.column(0).take(owner), pa.array([i for c in cut for i in range(len(c))], type=pa.int32()), pa.array([t for c in cut for t in c], type=pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)
        give_back()

    return docs.mapInArrow(run, schema)


def embed_chunks(chunks: DataFrame, version: int = EMBED_VERSION) -> DataFrame:
    return scale.spread(chunks).withColumn("embedding", hash_embed("text")).withColumn("embed_version", F.lit(version))


def reembed_on_version(chunks: DataFrame, version: int = EMBED_VERSION) -> DataFrame:
    """Vectors of another version are rebuilt; current ones pass through untouched."""
    current = F.coalesce(F.col("embed_version") == version, F.lit(False))
    stale = embed_chunks(chunks.filter(~current).drop("embedding", "embed_version"), version)
    return chunks.filter(current).unionByName(stale.select(*chunks.columns))


def upsert_documents(current: DataFrame, incoming: DataFrame, name: str = "name", order: str = "saved_at", text: str = "text") -> DataFrame:
    """A document of the same name replaces the old one; of several new ones the latest counts.
    Empty documents are refused (left out of the result's changes)."""
    good = incoming.filter(F.coalesce(trim_ws(text), F.lit("")) != "")
    latest = scale.first_per_group(good, [name], [F.col(order).desc()])
    kept = current.join(scale.small_side(latest.select(name)), name, "left_anti")
    return kept.unionByName(latest.select(*current.columns), allowMissingColumns=True)


# ------------------------------------------------------------------ search
def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    sizes, values = np.diff(column.offsets.to_numpy()), column.flatten()
    if pa.types.is_float64(values.type) and not column.null_count and not values.null_count and (sizes == sizes[:1]).all():
        return values.to_numpy().reshape(len(column), -1)  # without an object for every number
    return np.array(column.to_pylist(), dtype=float).reshape(len(column), -1)


def search_index(chunks: DataFrame, with_text: bool = True) -> DataFrame:
    """Chunks packed for search: one row per block of at most BLOCK chunks of like vectors.

    A block has its chunks' places (``doc_ids``, ``indexes``, ordered), vectors, its distinct grams, a bit for each chunk and gram, and the largest
    value of every slot, from which no chunk of the block can escape. Vectors stored with the chunks (``embed_chunks``, kept current by
    ``reembed_on_version``) are used as they are; chunks without the column are embedded. Write it once (``checkpointed`` with INDEX_ROWS, or a
    table of your own with row groups as small) to search it again and again. Nothing is shuffled: every task packs the chunks that it reads."""
    batches_within(chunks.sparkSession, BATCH_BYTES)
    stored = "embedding" in chunks.columns
    kind = chunks.schema["doc_id"].dataType.simpleString()
    schema = f"doc_ids array<{kind}>, indexes array<int>, texts array<string>, vectors binary, grams binary, bits binary, peak binary"
    arrow = to_arrow_schema(chunks.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[int, int] = {}
        turn = np.random.default_rng(11).normal(size=(DIM, 8))
        for batch in (b.slice(k, PACKED) for b in batches for k in range(0, b.num_rows, PACKED)):
            ids, indexes, raw = (batch.column(c).to_pylist() for c in range(3))
            owners, grams = packed_grams([clean(t) for t in raw])
            distinct, where = np.unique(grams, return_inverse=True)
            if len(slots) > 1_000_000:
                slots.clear()
            given = _matrix(batch.column(3)) if stored else embed_counted(owners, distinct, where, len(raw), slots)
            # chunks whose vectors lie on the same sides of eight planes come together; inside of a block the order is that of the places
            side = ((given @ turn[: given.shape[1]]) > 0) @ (1 << np.arange(8)) if given.shape[1] <= DIM else np.zeros(len(raw))
            order = np.argsort(side, kind="stable")
            first = np.searchsorted(owners, np.arange(len(raw) + 1))
            for at in range(0, len(order), BLOCK):
                rows = sorted(order[at : at + BLOCK].tolist(), key=lambda i: (ids[i] is not None, ids[i], indexes[i]))
                parts = [where[first[i] : first[i + 1]] for i in rows]
                found = np.zeros(len(distinct), dtype=bool)
                for part in parts:
                    found[part] = True
                number = np.cumsum(found) - 1
                there = np.zeros((len(rows), int(found.sum())), dtype=bool)
                for line, part in zip(there, parts, strict=True):
                    line[number[part]] = True
                vectors = given[rows]
                row = [
                    [ids[i] for i in rows], [indexes[i] for i in rows], [raw[i] for i in rows] if with_text else None,
                    vectors.tobytes(), distinct[found].tobytes(), np.packbits(there, axis=1).tobytes(), vectors.max(axis=0).tobytes(),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, arrow.types, strict=True)], schema=arrow)
        give_back()

    columns = ["doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "text", *(["embedding"] if stored else [])]
    return chunks.select(*columns).mapInArrow(run, schema)


def _query_blocks(queries: DataFrame) -> DataFrame:
    """Queries packed in rows of at most QUERY_BLOCK: ids, vectors, all their grams, and which query has which of these grams."""
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_ids array<{kind}>, q_vectors binary, wanted binary, q_owners binary, q_places binary"
    arrow = to_arrow_schema(queries.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                texts = [clean(t) for t in part.column(1).to_pylist()]
                owners, grams = packed_grams(texts)
                wanted, where = np.unique(grams, return_inverse=True)
                pairs = np.unique(owners * max(1, len(wanted)) + where)
                row = [part.column(0).to_pylist(), embed_batch(owners, grams, len(texts)).tobytes(), wanted.tobytes(), (pairs // max(1, len(wanted))).tobytes(), (pairs % max(1, len(wanted))).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, arrow.types, strict=True)], schema=arrow)

    asked = queries.where(trim_ws("query") != "").select("query_id", "query")
    return asked.coalesce(max(1, -(-asked.count() // (64 * QUERY_BLOCK)))).mapInArrow(run, schema)


def hybrid_search(chunks: DataFrame, queries: Sequence[str] | str | DataFrame, k: int = 5, doc_ids: Sequence | None = None, with_text: bool = True) -> DataFrame:
    """Top ``k`` chunks per query by 0.6 x cosine + 0.4 x share of query n-grams found; equal scores (to nine digits) by document and chunk.

    ``chunks``: chunk rows, or a ``search_index`` of them. Queries come as a list, or as a DataFrame ``(query_id, query)``, blank ones are left out;
    no queries give no rows. It is one plan however many queries there are: packed queries meet packed chunks, and every task passes on only what can
    be among the k best of what it has seen.

    What a task leaves out is proven: the block's largest slot values bound the cosine and its grams the share, so whole blocks go; then the
    exact cosine and the number of the query's grams whose bucket the chunk has bound each single score from above. Grams are compared one by one
    for the few chunks whose bound reaches the k-th best score so far."""
    k = int(k)
    if k < 1:
        raise ValueError("k must be at least 1")
    batches_within(chunks.sparkSession, BATCH_BYTES)
    if not isinstance(queries, DataFrame):
        given = [queries] if isinstance(queries, str) else list(queries)
        if not given or any(not str(q or "").strip() for q in given):
            raise ValueError("query required")
        queries = chunks.sparkSession.createDataFrame([(i, str(q)) for i, q in enumerate(given)], "query_id long, query string")
    if "peak" not in chunks.columns:
        if doc_ids is not None:
            chunks = chunks.filter(F.col("doc_id").isin(*doc_ids))
        chunks = search_index(chunks, with_text)
    elif doc_ids is not None:
        wanted = F.array(*[F.lit(x) for x in doc_ids])
        chunks = chunks.where(F.arrays_overlap("doc_ids", wanted))
    best = _search(chunks, _query_blocks(queries), k, with_text, doc_ids)
    order = [F.col("raw_score").desc(), F.col("doc_id"), F.col("chunk_index")]
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    out = best.withColumn("position", position).filter(F.col("position") <= k)
    return out.withColumn("score", F.round("raw_score", 4)).drop("raw_score")


def _search(index: DataFrame, asked: DataFrame, k: int, with_text: bool, doc_ids: Sequence | None) -> DataFrame:
    id_type = asked.schema["query_ids"].dataType.elementType.simpleString()
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"query_id {id_type}, doc_id {kind}, chunk_index int, raw_score double" + (", text string" if with_text else "")
    arrow = to_arrow_schema(index.sparkSession.createDataFrame([], schema).schema)
    inside = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(12)[i].as_py()
                block = [batch.column(c)[i] for c in range(12)]
                chunk, query, score = _block_best([x.as_py() for x in block[3:7]], [x.as_py() for x in block[8:12]], k, best, number, None if inside is None else [x in inside for x in block[0].as_py()])
                if len(chunk):
                    take = pa.array(chunk)
                    columns = [block[7].values.take(pa.array(query)), block[0].values.take(take), block[1].values.take(take), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(columns + ([block[2].values.take(take)] if with_text else []), schema=arrow)
        give_back()

    # packed queries against packed chunks: the stated query set, in blocks, against all rows
    met = index.crossJoin(asked.withColumn("number", F.monotonically_increasing_id()))
    return met.mapInArrow(run, schema)


def _block_best(block: list[bytes], asked: list[bytes], k: int, best: dict[int, np.ndarray], number: int, able: list[bool] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, query, score) of what may be among the k best; ``best`` has the k best scores of each query of a block so far."""
    peak = np.frombuffer(block[3])
    vectors, grams = np.frombuffer(block[0]).reshape(-1, len(peak)), np.frombuffer(block[1], dtype=np.int64)
    asked_for = np.frombuffer(asked[1], dtype=np.int64)
    owners, places = (np.frombuffer(x, dtype=np.int64) for x in asked[2:4])
    q_vectors = np.frombuffer(asked[0]).reshape(-1, DIM)
    if len(peak) != DIM:  # vectors of another length count as unlike
        vectors, peak = np.zeros((len(vectors), DIM)), np.zeros(DIM)
    width = len(q_vectors)
    sizes = np.maximum(np.bincount(owners, minlength=width), 1)
    top = best.setdefault(number, np.full((width, k), -np.inf))
    # grams of the block that a query has
    at = np.minimum(np.searchsorted(grams, asked_for), max(0, len(grams) - 1))
    here = grams[at] == asked_for if len(grams) else np.zeros(len(asked_for), dtype=bool)
    held = here[places]
    edge = VECTOR_WEIGHT * (q_vectors @ peak) + LEXICAL_WEIGHT * (np.bincount(owners[held], minlength=width) / sizes)
    live = np.flatnonzero(edge + 1e-9 >= top[:, 0])
    nothing = np.empty(0, dtype=np.int64)
    if not len(live):
        return nothing, nothing, np.empty(0)
    there = np.unpackbits(np.frombuffer(block[2], dtype=np.uint8).reshape(len(vectors), -1), axis=1, count=len(grams))[:, at].astype(bool) & here if len(grams) else np.zeros((len(vectors), len(asked_for)), dtype=bool)
    cosine = VECTOR_WEIGHT * (vectors @ q_vectors.T)
    # upper bounds: grams are dealt to buckets, and a query's gram may be there if its bucket is
    buckets = np.zeros((len(vectors), BUCKETS), dtype=np.float32)
    row, column = np.nonzero(there)
    buckets[row, column % BUCKETS] = 1
    weights = np.bincount((places % BUCKETS) * width + owners, minlength=BUCKETS * width).reshape(BUCKETS, width).astype(np.float32)
    bound = cosine + LEXICAL_WEIGHT * ((buckets @ weights) / sizes) + 1e-9
    if able is not None:
        bound[~np.array(able)] = -np.inf
    first = np.searchsorted(owners, np.arange(width + 1))
    flat = there.ravel()

    def exact(rows: np.ndarray, q: int) -> np.ndarray:
        shared = flat.take(rows[:, None] * len(asked_for) + places[first[q] : first[q + 1]]).sum(axis=1)
        return np.round(cosine[rows, q] + LEXICAL_WEIGHT * (shared / sizes[q]), 9)

    out: list[list[np.ndarray]] = [[], [], []]
    for q in live.tolist():
        least = max(top[q, 0], -1e300)
        rows = np.flatnonzero(bound[:, q] >= least)
        if len(rows) > 4 * k:  # the most promising first: what they score rules out others
            some = rows[np.argpartition(-bound[rows, q], 2 * k)[: 2 * k]]
            least = np.sort(np.concatenate([top[q], exact(some, q)]))[-k]
            rows = rows[bound[rows, q] >= least]
        score = exact(rows, q)
        chosen = np.argsort(-score, kind="stable")[:k]
        chosen = chosen[score[chosen] >= top[q, 0]]
        top[q] = np.sort(np.concatenate([top[q], score[chosen]]))[-k:]
        for c, x in zip(out, (rows[chosen], np.full(len(chosen), q), score[chosen]), strict=True):
            c.append(x)
    return tuple(np.concatenate(x) if x else nothing for x in out)
