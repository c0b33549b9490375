"""The pipeline stage by stage, and the registered queries against their SQL."""

import random
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import corpus_pipeline  # noqa: E402
from check import table  # noqa: E402
from tablework.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("pages", "conversations", "documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = db.execute(queries.SQL[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cur.description], cur.fetchall())


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}w{rng.randrange(10**6)}" for _ in range(n))
    item, passage = prose(15), prose(60)
    clean = [prose(80) for _ in range(30)]
    texts = [*clean, "too short", None, "again " * 100, clean[0], clean[1] + " more", prose(50) + " " + passage, prose(50) + " " + passage + " " + prose(30), prose(30) + " " + item + " " + prose(30)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, now = [], docs
    for _, function in corpus_pipeline.STAGES:
        now = function(spark, now, str(tmp_path)).cache()
        seen.append(now)
    ids = [sorted(r["doc_id"] for r in x.select("doc_id").distinct().collect()) for x in seen]
    assert all(x.columns == docs.columns for x in seen[:4])
    assert ids[0] == [*range(30), *range(33, 38)]
    assert ids[1] == [*range(30), *range(35, 38)]
    assert ids[2] == ids[1]
    cut = {r["doc_id"]: r for r in seen[2].collect()}
    assert all(cut[d]["text"] == texts[d] for d in [*range(30), 35, 37]) and len(cut[36]["text"].split()) == len(texts[36].split()) - 60
    assert cut[36]["n_chars"] == len(cut[36]["text"])
    assert ids[3] == [*range(30), 35, 36] == ids[4]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen[4].collect()))


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "sequence_packing"]
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))
