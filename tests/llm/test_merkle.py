import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import oracle
from airmon.llm import merkle
from airmon.llm.queries import ORACLES, op12_merkle_manifest
from cases import clashing, documents, hard

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    fields = (r.doc_id, r.source, r.lang, r.n_chars, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes):
    """The root and, for each node, the (left, right) siblings on its way."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            path.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        at = [i // 3 for i in at]
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
    subs = {s: tree([leaf_of(r, r.text) for r in by[s]]) for s in order}
    root, tops = tree([subs[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(by[s], subs[s][1]):
            hit = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 2 == 0
            text = r.text.replace("\n", "") if hit and r.text is not None else r.text
            now = leaf_of(r, text)
            for left, right in path + top:
                now = h(left, now, right)
            out.append((r.doc_id, leaf_of(r, r.text), subs[s][0], root, h(*(a + b for a, b in path + top)), now, now == root))
    return out


def query(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return op12_merkle_manifest(spark, str(path))


@pytest.mark.parametrize("steps", [1, 2, 6])
def test_trees_of_every_size(spark, tmp_path, monkeypatch, steps):
    # sources of 1, 2, 3, 4, 9, 10, 27 and 28 documents; small blocks give several tiers
    monkeypatch.setattr(merkle, "STEPS", steps)
    monkeypatch.setattr(merkle, "SPAN", 3**steps)
    sources = [f"s{n}" for n in (1, 2, 3, 4, 9, 10, 27, 28) for _ in range(n)]
    texts = [f"line {i}\nnext {i}" if i % 3 else f"one line {i}" for i in range(len(sources))]
    docs = documents(spark, texts, sources=sources)
    out = query(spark, docs, tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted(brute(docs.collect()))
    assert {r.verified for r in out.collect()} == {True, False}


def test_hard_rows(spark, tmp_path):
    docs = clashing(hard(spark))
    assert sorted(map(str, map(tuple, query(spark, docs, tmp_path).collect()))) == sorted(map(str, brute(docs.collect())))
    assert merkle.check(docs.limit(0)).count() == 0


def test_query_matches_sql_and_brute_force(spark):
    out = op12_merkle_manifest(spark, SF)
    assert oracle.compare(out, oracle.connect(SF), ORACLES["op12_merkle_manifest"]) == []
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows))


def test_manifest_blocks_keep_every_level(spark):
    docs = documents(spark, [str(i) for i in range(10)])
    (block,) = merkle.manifest(docs)[0].tiers[0].collect()
    assert [len(x) // 64 for x in block.levels] == [10, 4, 2, 1] and block.total == 10


def test_a_source_is_not_held_by_one_task(spark):
    docs = documents(spark, [str(i) for i in range(2000)])
    counts = merkle.manifest(docs)[0].tiers[0].select(F.size("kept")).collect()
    assert sorted(r[0] for r in counts) == [2000 - 2 * 729, 729, 729]
