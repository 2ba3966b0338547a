import math

import oracle
from airmon.llm import decontam
from airmon.llm.queries import ORACLES, op9_benchmark_decontamination
from cases import clashing, documents, hard

SF = "/root/testdata/sf0.001"


def brute(docs, items, share=0.8):
    out = []
    for d, text in docs:
        have = decontam.shingles(decontam.words_of(text))
        for i, item in items:
            want = decontam.shingles(decontam.words_of(item))
            shared = len(want & have)
            if want and shared >= math.ceil(share * len(want) - 1e-9):
                out.append((d, i, len(want), shared, shared / len(want)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_matches_sql(spark):
    con = oracle.connect(SF)
    assert oracle.compare(op9_benchmark_decontamination(spark, SF), con, ORACLES["op9_benchmark_decontamination"]) == []


def test_edited_and_nested_items_match_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    items = [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(40)]
    items += [items[0] + " " + items[1], items[2], "", None, "same same " * 30]
    texts = [None, "", "same same " * 100]
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 400))]
        part = items[rng.randrange(40)].split()
        for _ in range(rng.randint(0, len(part) // 12)):
            part[rng.randrange(len(part))] = word()
        at = rng.randint(0, len(body))
        texts.append(" ".join(body[:at] + part + body[at:]).upper())
    docs = documents(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute(list(enumerate(texts)), list(enumerate(items)))
    assert len(want) > 20
    assert rows(decontam.contained_items(docs, clashing(bench))) == want
    monkeypatch.setattr(decontam, "MOST_SHINGLES", 500)
    assert len(decontam.slices(bench)) > 3
    assert rows(decontam.contained_items(clashing(docs), bench)) == want
    clean = sorted(set(range(len(texts))) - {r[0] for r in want})
    assert sorted(r.doc_id for r in decontam.remove_contaminated(docs, bench).collect()) == clean


def test_hard_rows(spark):
    docs = hard(spark)
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (1, "one"), (None, "ONE!"), (4, None)],
                                  "item_id long, text string")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(decontam.contained_items(docs, bench)) == brute(pairs, [(r.item_id, r.text) for r in bench.collect()])
    assert decontam.contained_items(docs.limit(0), bench).count() == 0
    assert decontam.contained_items(docs, bench.limit(0)).count() == 0
    assert decontam.remove_contaminated(docs, bench.limit(0)).count() == docs.count()
