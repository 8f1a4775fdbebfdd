"""The stages on the smallest tables: each works on what the one before kept, and nothing clean is lost."""

import duckdb

import corpus_pipeline
from windrow.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SMALL)
        assert out.columns == columns, name
        assert 0.7 * n < out.count() <= n
        docs = out
    last = corpus_pipeline.run(spark, SMALL)
    assert last.where("not round_trip").count() == 0 and last.count() > 0


def test_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, SMALL)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())
