import numpy as np
import xxhash
from pyspark.sql import functions as F

from airmon.llm import simhash
from airmon.llm.components import components
from airmon.llm.queries import op4_simhash_components
from cases import clashing, documents, hard

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Fingerprint and smallest reachable id of each (doc_id, text), straight from the definition."""
    fps = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
            {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
        words = [w for w in words if w]
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    part = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and part[j] < part[i]:
                    part[i], changed = part[j], True
    smallest = {p: min((rows[i][0] for i in range(len(rows)) if part[i] == p and rows[i][0] is not None), default=None) for p in part}
    return [(d, f"{f:016x}", smallest[p]) for (d, _), f, p in zip(rows, fps, part)]


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]))
    got = sorted(tuple(r) for r in op4_simhash_components(spark, SF).select("doc_id", "fingerprint", "component_id").collect())
    assert got == want


def test_hard_rows(spark):
    for docs in (hard(spark, 300), clashing(hard(spark, 300))):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = [(r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()]
        assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert simhash.near_duplicates(hard(spark).limit(0)).count() == 0


def test_forest_is_the_brute_force_partition():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = base[rng.integers(0, 40, 700)]
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    group = np.sort(rng.integers(0, 9, 700))
    sig = fp.byteswap().view(np.uint8).reshape(-1, 8)
    for radius in (0, 3, 4, 7):
        i, j = simhash.forest(group, sig, radius)
        assert all((int(fp[a]) ^ int(fp[b])).bit_count() <= radius and group[a] == group[b] for a, b in zip(i, j))
        near = (np.bitwise_count(fp[:, None] ^ fp) <= radius) & (group[:, None] == group)
        parts = lambda pairs: frozenset(map(frozenset, _parts(700, pairs)))
        assert parts(zip(i.tolist(), j.tolist())) == parts(np.argwhere(near).tolist())


def _parts(n, pairs):
    part = {i: {i} for i in range(n)}
    for a, b in pairs:
        if part[a] is not part[b]:
            part[a] |= part[b]
            for x in part[b]:
                part[x] = part[a]
    return {id(p): p for p in part.values()}.values()


def test_hot_bucket_is_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    nodes = spark.range(60).select(
        F.col("id").alias("node"), F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("sig"),
        F.array(F.struct(F.lit(0).alias("band"), F.lit(7).cast("long").alias("key"))).alias("bands"))
    got = {(r.a, r.b) for r in simhash.links(nodes, 1).collect()}
    assert all((a ^ b).bit_count() == 1 for a, b in got)
    assert len(_parts(60, got)) == 1


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (7, 8), (5, 5)] + [(100 + i, 101 + i) for i in range(60)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7} | {100 + i: 100 for i in range(61)}
    assert components(edges.limit(0)).count() == 0


def test_deduplicate_keeps_the_first_of_each_component(spark):
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in brute(rows)}) != sorted(d for d, _ in rows)


def test_deduplicate_hard_rows(spark):
    rng = np.random.default_rng(1)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(n))
    a = fresh(3000)
    near = a.split()
    near[400] = "changed"
    docs = documents(spark, [fresh(200), a, " ".join(near), a.upper(), fresh(250), fresh(7), "", None, " "])
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [0, 1, 4, 5, 6]
    kept = simhash.deduplicate(hard(spark).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))).select("doc_id", "text").collect()
    assert sorted((r.doc_id or -1, (r.text or "")[:3]) for r in kept) == [
        (1, "ano"), (1, "the"), (2, ""), (5, "wor"), (6, "xxx"), (7, "¿Qu"), (8, "one"), (9, "!!!")]
    assert simhash.deduplicate(hard(spark).limit(0)).count() == 0
