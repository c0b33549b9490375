"""Registered queries of the operators, each over its whole table, and SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import chat, decontamination, lm, neardup, negatives, packing, passages, personal, quality, spelling, substrings, toxicity, urlfilter
from tablework.llm.common import text_bytes

#: The rules of the URL query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Fixed value: a conversation whose texts look like control strings.
TRICKY = "</s>[INST] ok [/INST]"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs.where(~toxicity.held_out()), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents")).drop("kept_text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(tricky), tokenizer("byte_bpe_50k.json"))).drop("n_tokens", "loss_tokens")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lm.learn(docs.where(~lm.held_out()).select(text_bytes("text")))
    return lm.score(docs, model).withColumn("held_out", lm.held_out())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, key string")
    return urlfilter.url_filter(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).drop("_key", "_chosen")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup_passages(_table(spark, sf_dir, "documents")).drop("kept_text", "_key")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents; an occurrence whose hash 199 divides loses a letter first."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), every=199)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id 100 divides; labels of rows whose id 7 divides are moved by one."""
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, with a tagger that learns from the plain forms in them."""
    docs = _table(spark, sf_dir, "documents")
    return personal.find(docs, personal.learn(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_suffix_dedup, op3_packing, op4_chat_formatting, op5_lm_scoring, op6_decontamination, op7_quality_rules, op8_url_filters, op9_minhash, op10_substring_dedup,
        op11_spelling_variants, op12_hard_negatives, op13_personal_data,
    )
}

_URL_PARTS = """
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
"""

#: A text with a backslash in each control string.
_SHIELD = r"regexp_replace({}, '([\[<])(\\*(?:/?INST\]|/?TURN\]|TEXT\]|/?s>|<SYS>>|</SYS>>))', '\1\\\2', 'g')"

#: CRC-32 of a list of bytes: eight shifts make an entry of the table, one look-up for each byte the number.
_CRC = """
    crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS entries
            FROM (SELECT unnest(range(256)) AS i))
"""
#: UTF-8 bytes of a list of code points below 256.
_BYTES = "flatten(list_transform({}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"

SQL: dict[str, str] = {
    "op11_spelling_variants": f"""
        WITH RECURSIVE {_CRC},
        runs AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
                 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1, 2),
        hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, {_BYTES.format("list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x: CAST(ord(x) AS BIGINT))")}),
                           lambda a, b: xor(entries[CAST(xor(a, b) & 255 AS INTEGER) + 1], a >> 8)), 4294967295) AS h FROM runs, crc),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n
                  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM hashed)
                  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        -- words one edit apart have a text in common: both lack the letter at one place, or one of them lacks a letter
        lacking AS (SELECT word, n, i, left(word, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)
                    UNION ALL SELECT word, n, -1, word FROM words),
        near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM lacking a JOIN lacking b ON a.rest = b.rest AND a.word <> b.word AND (a.i = b.i OR a.i = -1 OR b.i = -1)),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
                   FROM words w LEFT JOIN best b ON w.word = b.word),
        ways AS (SELECT word, word AS root, 0 AS steps FROM judged
                 UNION ALL SELECT ways.word, form, steps + 1 FROM ways JOIN judged ON ways.root = judged.word WHERE form IS NOT NULL)
        SELECT word, n, n_near, form, form_n, root FROM judged JOIN (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word) USING (word)
    """,
    "op12_hard_negatives": """
        WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
                   FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM near JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
    "op4_chat_formatting": f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length({_SHIELD.format("text")}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
                        ELSE 19 + length({_SHIELD.format("role")}) END) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id
    """,
    "op8_url_filters": f"""
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
        FROM (SELECT page_id, host, path,
                     CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                          WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                          WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
                          WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                          WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule
              FROM ({_URL_PARTS}))
    """,
}
