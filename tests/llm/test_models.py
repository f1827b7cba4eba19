"""Held-out accuracy and defined cases of the classifiers."""

import zlib

import numpy as np
import pytest

from levelgrid.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op2(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01
    # Calibrated: the mean score of held-out rows is near their accuracy.
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == r.lang for r in held])) < 0.05


def test_language_cases(spark, edge_docs, no_docs):
    model = langid.train([("the cat sat on the mat", "en"), ("der hund und die katze", "de")] * 20)
    found = {(r.doc_id, r.lang_pred): r for r in langid.predict(edge_docs, model).collect()}
    assert all(found[(i, "und")].score == 0 and found[(i, "und")].rejected for i in (1, 2, 4))
    assert langid.predict(edge_docs, model).count() == 7
    kept = langid.keep_known(edge_docs, model)
    assert kept.columns == edge_docs.columns and not {1, 2, 4} & {r.doc_id for r in kept.collect()}
    assert langid.predict(no_docs, model).collect() == []
    assert langid.sample(no_docs) == []
    blank = langid.train([])
    assert blank.predict("any text") == ("und", 0.0, True)


def test_rejection(spark):
    rows = [("the cat and the dog are on that mat with this one", "en"), ("der hund und die katze sind auf der matte mit dem", "de")] * 60
    model = langid.train(rows, reject=0.0)
    assert not model.predict("the dog and the cat")[2]
    assert model.predict("1234 %%%")[2]


FOREIGN = [
    "La mattina il mercato si riempie di gente che compra frutta fresca e parla del tempo e delle notizie della città.",
    "De manhã o mercado enche-se de pessoas que compram fruta fresca e falam do tempo e das notícias da cidade.",
    "'s Ochtends loopt de markt vol met mensen die vers fruit kopen en over het weer en het nieuws van de stad praten.",
    "Rano targ zapełnia się ludźmi, którzy kupują świeże owoce i rozmawiają o pogodzie oraz o wiadomościach z miasta.",
    "Утром рынок наполняется людьми, которые покупают свежие фрукты и говорят о погоде и новостях города.",
    "早上市场里挤满了买新鲜水果的人，他们谈论天气和城市里的新闻。",
    "Aamulla tori täyttyy ihmisistä, jotka ostavat tuoreita hedelmiä ja puhuvat säästä ja kaupungin uutisista.",
    "Sabahları pazar, taze meyve alan ve havadan, şehrin haberlerinden konuşan insanlarla dolup taşar.",
    "Reggel a piac megtelik emberekkel, akik friss gyümölcsöt vesznek, és az időjárásról meg a város híreiről beszélgetnek.",
]


def test_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.language_model(docs)
    assert all(model.predict(t)[2] for t in FOREIGN)
    held = docs.filter("text is not null and length(text) > 200 and crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").select("text", "lang").collect()
    assert np.mean([model.predict(r.text)[2] for r in held]) < 0.01
    # Half of one language, half of another: no language is unlearned.
    mixed = [a.text[:600] + " " + b.text[:600] for a, b in zip(held, held[1:]) if a.lang != b.lang]
    assert len(mixed) > 50 and np.mean([model.predict(t)[2] for t in mixed]) < 0.01


def test_left_out_language_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.sample(docs)
    for lang in ("de", "fr", "es"):
        model = langid.train([r for r in rows if r[1] != lang])
        assert np.mean([model.predict(t)[2] for t, other in rows if other == lang]) > 0.9


def test_rejected_share_is_a_quantile():
    # 200 rows of three grams each; 5 of them hold grams of their own.
    docs = [(np.array([1, 2, 3 if i >= 5 else 100 + i]), np.ones(3), i % 2) for i in range(200)]
    for reject, bound in ((0.0, 2 / 3), (0.03, 1.0)):
        seen, threshold = langid.knowledge(docs, reject)
        assert np.isclose(threshold, bound) and seen.sum() > 0


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op4(spark, SF).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_cases(spark, frame, edge_docs, no_docs):
    model = toxicity.train([("you are a nasty fool", 1), ("you are a fine friend", 0)] * 20, least=2)
    assert model.score("what a nasty fool") > 0.5 > model.score("what a fine friend")
    found = toxicity.score(edge_docs, model).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.keep_clean(edge_docs, model).columns == edge_docs.columns
    assert toxicity.score(no_docs, model).collect() == []
    none = toxicity.train([])
    assert none.score(None) < 0.5
    assert toxicity.train([("a b c", 0)]).score("a b c") < 0.5
    labels = frame("doc_id long, toxic int, quality int, text string", [{"doc_id": 3, "toxic": 1}, {"doc_id": 3, "toxic": None}, {"doc_id": None, "toxic": 0}])
    rows, share = toxicity.sample(edge_docs, labels)
    assert share == 1.0 and {t for t, _ in rows} == {"one two three"}
    assert toxicity.sample(no_docs, labels)[0] == [] and toxicity.sample(edge_docs, labels.limit(0)) == ([], None)


def test_stages_raise_where_nothing_was_learned(edge_docs, no_docs):
    blank = langid.train([])
    with pytest.raises(ValueError, match="no language"):
        langid.keep_known(edge_docs, blank)
    assert langid.keep_known(no_docs, blank).collect() == []
    one_kind = toxicity.train([("a b c", 1)])
    with pytest.raises(ValueError, match="both kinds"):
        toxicity.keep_clean(edge_docs, one_kind)
    assert toxicity.keep_clean(no_docs, one_kind).collect() == []
    assert toxicity.keep_clean(edge_docs, toxicity.train([])).count() == 7
