import numpy as np
import pytest

from airmon.llm import langid
from airmon.llm.queries import op5_language_id
from cases import clashing, documents, hard

SF = "/root/testdata/sf0.01"


def phrases(text, training):
    """Greedy longest matches by substring search."""
    count, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in training:
            j += 1
        count, i = count + 1, j
    return count


def test_cross_parse_matches_substring_search(monkeypatch):
    rng = np.random.default_rng(2)
    texts = (("a", "".join(rng.choice(list("abc "), 400))), ("b", "".join(rng.choice(list("abde "), 300))))
    docs = ["".join(rng.choice(list("abcdefg "), n)) for n in (1, 2, 7, 60, 63, 400)]
    for cells in (langid.CELLS, 10):
        monkeypatch.setattr(langid, "CELLS", cells)
        p = langid.Parser(texts)
        plain = lambda s: "".join(map(chr, langid.normal(s)))
        want = [[phrases(plain(d), plain(t)) for _, t in texts] for d in docs]
        assert p.phrases([langid.normal(d) for d in docs]).tolist() == want


def test_blocks_are_parsed_alone_and_add_up(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 50)
    p = langid.Parser((("a", "abcabcab"),))
    assert p.phrases([langid.normal("ab" * 60)])[0, 0] == sum(phrases("ab" * n, "abcabcab") for n in (25, 25, 10))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = op5_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all()
    held = out[out.held_out]
    assert 100 < len(held) < 300
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_lang_of_the_held_out_and_source_play_no_part(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    blind = docs.withColumn("source", F.lit(None).cast("string")).withColumn(
        "lang", F.when(langid.fold("doc_id", 5) != 0, F.col("lang")))
    key = lambda df: sorted(map(tuple, langid.identify(df).collect()))
    assert key(docs) == key(clashing(blind)) == key(docs.repartition(5))


def test_hard_rows(spark):
    out = langid.identify(clashing(hard(spark))).collect()
    assert len(out) == hard(spark).count()
    und = sorted(r.doc_id or -1 for r in out if r.lang_pred == "und")
    assert und == [-1, 2, 3, 4, 9] and all(r.score == 0 for r in out if r.lang_pred == "und")
    assert langid.identify(hard(spark).limit(0)).count() == 0
    untaught = documents(spark, ["some text"], langs=[None])
    assert langid.identify(untaught).first().lang_pred == "und"


def test_filter_keeps_clean_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = langid.keep_identified(docs)
    letters = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(letters)


@pytest.mark.parametrize("text", ["", None, "123 !!", "\n"])
def test_no_letters_is_und(text):
    assert langid.judge([text], (("en", "the and of"),))[0][0] == "und"


def test_training_reads_beyond_a_shared_header(spark):
    header = "Permission is hereby granted to any person obtaining a copy of this text. " * 10
    body = "zwölf boxkämpfer jagen viktor quer über den großen sylter deich " * 60
    docs = documents(spark, [header + body] * 20, langs=["de"] * 20)
    text = langid.training_text(docs)["de"]
    assert len(text) <= 20 * (langid.SAMPLE_CHARS + langid.PIECES) and text.count("sylter") > text.count("Permission")


def test_usual_bits_are_the_median_of_whole_held_out_texts(spark):
    # more held-out documents than any sample of 64 would take, each with a body unlike its first part
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdef"), rng.integers(2, 6)))
    ids, texts, langs = [], [], []
    for i in range(900):
        known, new = " ".join(["der die das"] * int(rng.integers(1, 60))), " ".join(word() for _ in range(int(rng.integers(1, 200))))
        ids, texts, langs = [*ids, i], [*texts, f"{known} {new}"], [*langs, ["de", "en"][i % 2]]
    docs = documents(spark, texts + ["123", None], langs=langs + ["de", "de"], ids=ids + [901, 902])
    learned = tuple(langid.training_text(docs).items())
    p = langid.parser(learned)
    held = {r.doc_id for r in docs.where(langid.fold("doc_id", 5) == 0).collect()}
    want = {}
    for lang in ("de", "en"):
        codes = [langid.normal(t) for i, t, x in zip(ids, texts, langs) if i in held and x == lang]
        assert len(codes) > 64
        cost = p.phrases(codes)[:, p.langs.index(lang)] * p.bits.max()
        want[lang] = float(np.median(cost / [len(c) for c in codes]))
    assert langid.usual_bits(docs, learned) == pytest.approx(want, rel=1e-12)


FINNISH = ("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, "
           "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin.")
RUSSIAN = ("Все люди рождаются свободными и равными в своем достоинстве и правах", "Каждый человек имеет право на жизнь, на труд и отдых")


def test_filter_rejects_what_was_not_learned(spark):
    rng = np.random.default_rng(8)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    noise = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 900))
    # 1000004 is no id of the held-out fold, so its label has a training text, a tiny one
    ids = [1000001, 1000002, 1000003, 1000004]
    more = documents(spark, [FINNISH, noise, RUSSIAN[1], RUSSIAN[0]], langs=[None, None, None, "ru"], ids=ids)
    learned = langid.training_text(docs.unionByName(more.select(docs.columns)))
    assert "ru" in learned and len(learned["ru"]) < 100
    got = {r.doc_id for r in langid.keep_identified(docs.unionByName(more.select(docs.columns))).collect()}
    assert got & set(ids) == {1000004} and len(got) > 190
