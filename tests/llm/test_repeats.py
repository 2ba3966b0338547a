import hashlib
import random
from collections import Counter

from airmon.llm import repeats
from airmon.llm.queries import op3_repeat_removal
from cases import clashing, documents, hard

SF = "/root/testdata/sf0.001"


def brute(rows):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(hash(r[i : i + 200]) for _, r in raws for i in range(len(r) - 199))
    out = []
    for d, r in raws:
        gone, end = [False] * len(r), 0
        for i in range(len(r) - 199):
            if seen[hash(r[i : i + 200])] > 1:
                for k in range(max(i, end), i + 200):
                    gone[k] = True
                end = i + 200
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((d, len(r), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows(op3_repeat_removal(spark, SF)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def texts():
    rng = random.Random(9)
    fresh = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [fresh(n) for n in (150, 185, 199, 201, 230, 300, 700)] + ["ab" * 150, "x" * 260]
    out = [fresh(199), fresh(2000), "y" * 5000, None, ""]
    for i in range(70):
        body = fresh(rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "Q"
            body += "".join(p) + fresh(rng.randint(0, 260))
        out.append(body)
    return out + [out[8], out[8]]


def test_planted_passages_match_brute_force(spark):
    t = texts()
    want = brute(list(enumerate(t)))
    assert sum(r[2] > 0 for r in want) > 20
    assert rows(repeats.remove_repeats(documents(spark, t).repartition(7))) == want


def test_hot_anchors_are_counted_string_by_string(spark, monkeypatch):
    t = texts()
    monkeypatch.setattr(repeats, "HOT", 3)
    assert rows(repeats.remove_repeats(documents(spark, t).repartition(7))) == brute(list(enumerate(t)))


def test_hard_rows(spark):
    docs = clashing(hard(spark, 400))
    assert rows(repeats.remove_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))),) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        coded = [list(repeats.front_coded(r)) for r in runs]
        got = list(repeats.LoserTree([repeats.decoded(c) for c in coded]))
        assert [s for s, _, _ in got] == sorted(s for r in runs for s, in r)
        for (a, _, _), (b, n, _) in zip(got, got[1:]):
            assert n == repeats.common(a, b, 0)
