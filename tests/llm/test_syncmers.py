import hashlib
import random
import re

from pyspark.sql import functions as F

from airmon.llm import syncmers
from airmon.llm.queries import op2_syncmer_fingerprints
from cases import clashing, documents, hard

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def edits(pairs):
    """(doc_id, n_chars, edited_sha256) with the next text found by sorting everything."""
    order = sorted(pairs, key=lambda p: -p[0])
    out = []
    for i, (d, t) in enumerate(order):
        k = len(t) // 3
        edited = t[: len(t) - k] + order[(i + 1) % len(order)][1][:k]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out)


def test_edits_match_brute_force_and_likeness_tells_them(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = op2_syncmer_fingerprints(spark, SF).toPandas().sort_values("doc_id")
    assert list(out[["doc_id", "n_chars", "edited_sha256"]].itertuples(index=False, name=None)) == edits(docs)
    long = out[out.n_chars > 600]
    assert long.near_edited.quantile(0.05) > 0.3 and 0.4 < long.near_edited.median() < 0.65
    assert (long.near_next < 0.1).mean() > 0.95
    text = dict(docs)
    same = {}
    for d, fp in zip(out.doc_id, out.fingerprint):
        assert same.setdefault(text[d], fp) == fp


def test_ranges_of_any_number_find_the_next(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10**9), 90)
    pairs = [(i, f"text {i}") for i in ids]
    df = spark.createDataFrame(pairs, "id long, text string").withColumn("fp", F.array().cast("array<int>"))
    order = sorted(pairs, reverse=True)
    want = sorted((d, order[(k + 1) % len(order)][1]) for k, (d, _) in enumerate(order))
    for k in (1, 2, 7, 64):
        assert sorted((r.id, r.next_text) for r in syncmers.with_next(df, k).collect()) == want


def test_kept_runs_are_closed_syncmers(spark):
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(300)]
    pair = {(a, b): h for a, b, h in spark.createDataFrame(list({*zip(words, words[1:])}), "a string, b string").select(
        "a", "b", F.xxhash64("a", "b")).collect()}
    keep = [i for i in range(len(words) - 6)
            if min(range(6), key=lambda k: (pair[words[i + k], words[i + k + 1]], k not in (0, 5))) in (0, 5)]
    passage = " ".join(words[50:120])
    framed = "other words " * 9 + passage + " more" * 9
    texts = [" ".join(words), passage, framed] + [" ".join(words[i : i + 7]) for i in keep]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", syncmers.anchors(F.col("t")).alias("x"))
    got = [x for _, x in sorted(map(tuple, rows.collect()))]
    assert 60 < len(keep) < 140 and got[0] == [x[0] for x in got[3:]]
    # a passage keeps its runs, in order, in any surroundings
    at = got[2].index(got[1][0])
    assert got[2][at : at + len(got[1])] == got[1]


def test_hard_rows(spark):
    docs = clashing(hard(spark, 300))
    out = syncmers.compare_with_edits(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert {r.fingerprint for r in out if r.doc_id in (2, 3, 4)} == {""}
    assert all(re.fullmatch("([0-9a-f]{8})*", r.fingerprint + r.edited_fingerprint) for r in out)
    twice = [r for r in out if r.doc_id == 1]
    assert len({r.fingerprint for r in twice}) == 2
    one = syncmers.compare_with_edits(documents(spark, ["a b c d e f g h i j"])).first()
    assert one.near_next == 1
    assert syncmers.compare_with_edits(docs.limit(0)).count() == 0
    ids = documents(spark, ["x", "y"], ids=[None, None])
    assert sorted(r.near_next for r in syncmers.compare_with_edits(ids).collect()) == [0, 0]


def test_no_python_in_the_plan(spark):
    plan = op2_syncmer_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


def test_short_and_unbroken_texts_have_anchors(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    short = [[word() for _ in range(n)] for n in range(1, 11) for _ in range(30)]
    cjk = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(300))
    texts = [" ".join(w) for w in short] + [cjk, "\u4e00" + cjk, "one two three four five six", "one two three four five changed", "", " "]
    a = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", syncmers.anchors(F.col("t")).alias("x"))
    got = [x for _, x in sorted(map(tuple, a.collect()))]
    assert all(got[:-2]) and got[-2:] == [[], []]
    pairs = [(got[i], got[i + 1]) for i in (*range(180, 299), 300, 302, 304)]
    near = [r.n for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<int>, b array<int>").select(
        "i", syncmers.likeness(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()]
    assert max(near[:119]) < 1 and near[119] > 0.9 and 0 < near[120] < 1 and near[121] == 1
