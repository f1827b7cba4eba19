"""Every round of training reads all training documents."""

from pyspark.sql import functions as F

from levelgrid.llm import hidden_markov as H


def test_all_rounds_read_all_documents(spark, monkeypatch):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id") % 7).alias("text"))
    read, real = [], H.improved

    def seen(table, model):
        sums = table.select(F.sum(F.size(F.filter("held", lambda h: ~h))).alias("n"), F.sum("size").alias("tokens")).first()
        read.append(tuple(sums))
        return real(table, model)

    monkeypatch.setattr(H, "improved", seen)
    sequences = H.blocks(docs, F.lit(False))
    words = H.counts(sequences)
    H.train(H.coded(sequences, words), words, states=2)
    assert read == [(5000, 15_000)] * (H.FIRST_ROUNDS + H.ROUNDS)
