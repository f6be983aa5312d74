"""The registered queries on the driver's tables: against SQL where there is some, else against brute force; and the pipeline's stages."""

import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanweave.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(queries.ORACLE_SQL[name]).df()
        cols = sorted(got.columns)
        a, b = (df[cols].sort_values(cols).reset_index(drop=True) for df in (got, want))
        assert (a == b).all().all()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    scored = {r.doc_id: r.predicted for r in queries.QUERIES["op4_quality"](spark, SF).collect()}
    out, kept = docs, ids(docs)
    out = stages["quality"](spark, out, SF).cache()
    kept = {d for d in kept if scored[d]}
    assert ids(out) == kept and out.columns == docs.columns
    near = stages["near_duplicates"](spark, out, SF).cache()
    assert ids(near) < kept and near.columns == docs.columns
    clean = stages["decontamination"](spark, near, SF).cache()
    leaks = {r.doc_id for r in queries.QUERIES["op3_decontaminate"](spark, SF).collect()}
    assert ids(clean) == ids(near) - leaks and clean.columns == docs.columns
    mix = stages["mixing"](spark, clean, SF).cache()
    assert ids(mix) <= ids(clean) and mix.columns == docs.columns
    assert max(r["count"] for r in mix.groupBy("doc_id").count().collect()) <= 3
    last = stages["sharding"](spark, mix, SF)
    assert last.count() == mix.count()
    whole = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.size, r.shard) for r in df.collect())
    assert key(whole) == key(last)


def test_stages_on_odd_rows(spark, docs, empty):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for df in (plain, plain.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF).cache()
            df.collect()


def test_pipeline_on_repeated_and_null_ids(spark):
    from collections import Counter

    text = lambda k: " ".join(f"w{k}_{i}" for i in range(40))
    rows = [(None, text(0))] * 5 + [(None, text(1))] * 3 + [(7, text(2))] * 4 + [(7, text(3)), (3, text(3)), (9, text(1)), (None, None), (None, ""), (8, text(4))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    once = stages["near_duplicates"](spark, df, SF)
    assert once.columns == df.columns
    want = [(None, text(0)), (9, text(1)), (7, text(2)), (3, text(3)), (8, text(4)), (None, None), (None, "")]
    assert Counter((r.doc_id, r.text) for r in once.collect()) == Counter(want)
    # one source: its target is its size, so each row is taken once
    mix = stages["mixing"](spark, df, SF)
    assert mix.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in mix.collect()) == Counter(rows)


def test_pipeline_has_crc(spark):
    one = spark.range(1).select(F.crc32(F.lit("5").cast("binary"))).first()[0]
    assert one == zlib.crc32(b"5")
