"""Stages and queries over a small folder of tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tabloom.llm import registry

from .test_near_copies import slow_keep
from .test_learned import BAD, labelled


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    data, labels = labelled(spark)
    data = data.drop("truth").withColumn("doc_id", data.doc_id + 10000)
    labels = labels.withColumn("doc_id", labels.doc_id + 10000)
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(data.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars"))
    leak = both.filter("doc_id = 706").first().text.split()[100:140]
    both.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(leak)), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, [float(i % 7), float(i % 3)], 0) for i in range(50)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
    texts = {n: [r.text for r in rows] for n, rows in seen.items()}
    assert not any(b in (t or "") for t in texts["toxicity"] for b in BAD)
    assert {r.doc_id for r in before.collect() if not any(b in (r.text or "") for b in BAD)} <= {r.doc_id for r in seen["toxicity"]} | {None}
    assert sorted(((r.doc_id, r.text) for r in seen["near_dedup"]), key=repr) == slow_keep([(r.doc_id, r.text) for r in seen["toxicity"]])
    assert 706 in {r.doc_id for r in seen["near_dedup"]} and 706 not in {r.doc_id for r in seen["decontamination"]}
    assert len(seen["decontamination"]) == len(seen["near_dedup"]) - 1
    assert {r.doc_id for r in seen["mixing"]} <= {r.doc_id for r in seen["decontamination"]}
    assert all(0 <= r.shard < 64 for r in seen["sharding"]) and len(seen["sharding"]) == len(seen["mixing"])


def test_run_of_nothing(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_queries_run(spark, folder, name):
    out = registry.QUERIES[name](spark, folder)
    got = out.toPandas()
    if name not in ("op5_topk", "op11_spelling"):  # a row for each query and neighbour, and for each word
        assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert name in entry.queries()


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES[name](spark, sf).toPandas()
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(registry.ORACLES[name]()).df()
    # a column of whole numbers with nulls is one of fractions in the one and not in the other
    plain = lambda v: "null" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    key = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)
