"""The registered queries against their SQL or brute force, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from levelgrid.llm import decontaminate, jaccard_join, langid, queries, toxicity
from levelgrid.session import settle

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(df):
    return sorted("|".join("" if v is None or v != v else str(v) for v in (r[c] for c in sorted(df.columns))) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "" if v is None else str(v)
    assert rows(df) == sorted("|".join(text(r[i]) for i in order) for r in want.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    """Every stage takes what its operator says on its own input, and nothing else."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = settle(stage(spark, before, SF))
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.collect()}
        gone = {r.doc_id for r in before.collect()} - ids
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.score(before, queries.toxicity_model(spark, SF, before)).filter("predicted = 1").collect()}
        elif name == "language_id":
            want = {r.doc_id for r in langid.predict(before, queries.language_model(before)).filter("rejected").collect()}
        elif name == "jaccard_join":
            want = {r.doc_id for r in jaccard_join.classes(before).filter("doc_id <> class_id").collect()}
        else:
            want = {r.doc_id for r in decontaminate.report(before, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").collect()}
        assert gone == want, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
