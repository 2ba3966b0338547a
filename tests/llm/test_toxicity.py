from pyspark.sql import functions as F

from airmon.llm import toxicity
from airmon.llm.queries import op10_toxicity
from cases import clashing, documents, hard

SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = op10_toxicity(spark, SF).join(labels, "doc_id", "left").toPandas()
    assert len(out) == 10_000 and out.score.between(0, 1).all()
    assert ((out.score >= 0.3) == (out.predicted == 1)).all()
    held = out[out.held_out & out.toxic.notna()]
    found, said = held[held.toxic == 1], held[held.predicted == 1]
    assert said.toxic.mean() > 0.9
    # some labels are noise: four in ten toxic texts have no word that sets them apart
    assert found.predicted.mean() > 0.5
    clear = held[held.doc_id.isin([r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()
                                   if set(toxicity.words_of(r.text)) & toxicity.INSULTS])]
    assert clear.predicted.mean() > 0.97


def test_features():
    f = dict(zip(toxicity.FEATURES, toxicity.features("You are an IDIOT! 1d10t m.o.r.o.n soooo bad", frozenset({"bad"}))))
    assert f["hits"] == 1 and f["learned"] == 1 and f["near_you"] == 3 and f["masked_hits"] == 2 and f["repeats"] > 0 and f["shouted"] > 0
    zero = dict(zip(toxicity.FEATURES, toxicity.features(None, frozenset())))
    assert zero.pop("near_you") == 50 and set(zero.values()) == {0.0}


def test_held_out_labels_lang_and_source_play_no_part(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    blind = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string"))
    key = lambda d, y: sorted(map(tuple, toxicity.score(d, y).collect()))
    assert key(docs, labels) == key(clashing(blind), clashing(turned.union(turned)))


def test_hard_rows(spark):
    docs = clashing(hard(spark))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (5, 0), (6, 1), (7, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        out = toxicity.score(docs, labels).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs.limit(0), odd).count() == 0
    assert {r.score for r in toxicity.score(documents(spark, ["a", None]), none).collect()} == {0.0}
