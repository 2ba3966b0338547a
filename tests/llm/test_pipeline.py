import corpus_pipeline
from airmon.llm import decontam, mixing
from airmon.llm.queries import QUERIES
from cases import clashing, hard
from test_pii import brute as base_spans
from test_simhash import brute as components_of

SF = "/root/testdata/sf0.001"


def stages(spark, docs, sf_dir):
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf_dir).cache())
    return out


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw, langs, deduped, clean, redacted, mixed = stages(spark, docs, SF)
    assert all(x.columns == docs.columns for x in (langs, deduped, clean, redacted))
    assert langs.count() == sum(any(c.isalpha() for c in r.text or "") for r in raw.collect())

    # of each component of the operator's links the smallest id stays
    rows = {r.doc_id: r.text for r in langs.collect()}
    kept = {r.doc_id for r in deduped.collect()}
    assert kept == {c for _, _, c in components_of(sorted(rows.items()))} < rows.keys()

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [decontam.shingles(decontam.words_of(t)) for _, t in bench]
    held = {d for d in kept if any(len(s & decontam.shingles(decontam.words_of(rows[d]))) >= 0.8 * len(s) for s in items)}
    assert held and {r.doc_id for r in clean.collect()} == kept - held

    before = {r.doc_id: r.text for r in clean.collect()}
    after = {r.doc_id: r.text for r in redacted.collect()}
    assert before.keys() == after.keys() and any(base_spans(t) for t in before.values())
    assert not any(base_spans(t) for t in after.values())
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(redacted).collect()))


def test_run_matches_the_stages(spark):
    want = stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)[-1]
    assert sorted(map(tuple, QUERIES["pipeline"](spark, SF).collect())) == sorted(map(tuple, want.collect()))


def test_hard_rows(spark):
    out = stages(spark, clashing(hard(spark)), SF)
    assert all(x.columns == out[0].columns for x in out[:-1])
    assert sorted(r.doc_id or -1 for r in out[1].collect()) == [-1, 1, 1, 1, 5, 6, 7, 8]
    assert sorted(r.doc_id or -1 for r in out[-1].collect()) == [1, 1, 5, 6, 7, 8]
    assert all(x.count() == 0 for x in stages(spark, hard(spark).limit(0), SF))
