import pytest
from pyspark.sql import functions as F

import oracle
from airmon.llm import mixing
from airmon.llm.queries import ORACLES, op7_source_mixing
from cases import clashing, documents, hard

SF = "/root/testdata/sf0.001"


def refill(sizes):
    """Targets by sharing the excess again and again."""
    total, weight = sum(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    rest = total
    while free:
        w = sum(weight[i] for i in free)
        over = [i for i in free if rest * weight[i] / w > 3 * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weight[i] / w
            break
        for i in over:
            out[i] = 3 * sizes[i]
            free.discard(i)
        rest = total - sum(3 * sizes[i] for i in range(len(sizes)) if i not in free)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert oracle.compare(op7_source_mixing(spark, path), oracle.connect(path), ORACLES["op7_source_mixing"]) == []


def test_targets_are_met_and_no_document_is_overdrawn(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert len(out) == docs.count() and (out.taken <= 3 * out["size"]).all()
    per = out.groupby("source").agg(size=("size", "sum"), full=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.full).all()
    assert ((per.taken - per.target).abs() <= 2 * mixing.BLOCK).all()
    want = refill(per.sort_index()["size"].tolist())
    assert per.sort_index().target.tolist() == pytest.approx(want)
    assert per.target.sum() == pytest.approx(per.full.sum())


def test_targets_stop_at_three_times_the_source(spark):
    for sizes in ([5, 1000, 3000, 10, 2], [7], [0, 0], [1, 1, 1, 1, 1, 900], [0, 50, 3]):
        rows = spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate(sizes)], "doc_id long, source string, size long")
        got = [r.target for r in mixing.targets(rows).orderBy("rank").collect()]
        assert got == pytest.approx(refill(sizes))


def test_rounds_permute(spark):
    for n in (1, 2, 3, 17, 100):
        x = mixing.permuted(F.col("id"), F.lit(n), F.lit("salt"))
        got = [r.x for r in spark.range(n).select(x.alias("x")).collect()]
        assert sorted(got) == list(range(n))
        assert n < 10 or got != sorted(got)


def test_shards_draw_all_sources(spark):
    plan = spark.createDataFrame([("a", 0, 1, 1.0, 4000, 9000), ("b", 1, 1, 1.0, 900, 3000)],
                                 "source string, rank int, source_size long, target double, blocks long, slots long")
    out = mixing.slot_table(plan)
    per = out.groupBy("rank", "block").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(per) == (2, 4) and out.count() == 12000
    shards = {(r.shard, r.rank): r["count"] for r in out.groupBy("shard", "rank").count().collect()}
    assert len(shards) == 24 and all(abs(shards[s, 0] - 750) < 150 for s in range(12))


def test_hard_rows(spark):
    con = oracle.connect(SF)
    for docs in (hard(spark), clashing(hard(spark)), hard(spark).repartition(3)):
        con.register("odd", hard(spark).toPandas().astype({"doc_id": "Int64"}))
        sql = mixing.ORACLE.replace("{docs}", "odd")
        assert oracle.compare(mixing.mix(docs), con, sql) == []
    assert mixing.mix(hard(spark).limit(0)).count() == 0
    nothing = mixing.mix(documents(spark, [None, ""], sources=[None, "a"])).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_no_python_in_the_plan(spark):
    plan = op7_source_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
