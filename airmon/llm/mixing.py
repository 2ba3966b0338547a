"""Mixing sources to target weights: fixed-length blocks drawn through pseudorandom permutations.

The words of a source, documents in a fixed order, are one stream cut into blocks of equal length.  A
source gets so many output slots as its target asks for; a slot's number is its draw, and a permutation
of the block numbers, another one in every pass over the source, says which block it takes.  Each slot
falls on an output shard by a hash, which makes a shard's counts of the sources a multinomial draw whose
totals are the targets.  Slots and documents meet by block number.

Only DataFrame functions.  Nothing is ordered over a whole source: positions in a stream are running
sums inside buckets of about BUCKET documents plus the sums of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airmon.llm.base import WORD, let, written

#: Words of a block, documents of a bucket, slots of an output shard (on average).
BLOCK, BUCKET, SHARD = 128, 20_000, 1024
#: Sources by code point take these weights in turn; no source is repeated more often than MOST.
WEIGHTS, MOST = (5, 2, 1), 3
ROUNDS = 8
#: Slots listed by one row before they are dealt over the tasks.
RUN = 1 << 14


def drawn(salt: Column, x: Column) -> Column:
    """A pseudorandom number below 2^48 for ``x``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", salt, x).cast("binary")), 1, 12), 16, 10).cast("long")


def permuted(x: Column, n: Column, salt: Column) -> Column:
    """Where a pseudorandom permutation of 0 .. n - 1, chosen by ``salt``, sends ``x`` (swap-or-not rounds)."""
    for r in range(ROUNDS):
        x = _swap_or_not(x, n, F.concat_ws(":", salt, F.lit(r)))
    return x


def _swap_or_not(x: Column, n: Column, key: Column) -> Column:
    """One round: x and its partner change places or not, by a hash of the larger of the two."""
    def turned(a: Column, b: Column) -> Column:
        bit = F.substring(F.md5(F.concat_ws(":", key, F.greatest(a, b)).cast("binary")), 1, 1) >= "8"
        return F.when(bit, b).otherwise(a)
    return let(x, lambda a: let(F.pmod(drawn(key, F.lit("k")) - a, n), lambda b: turned(a, b)))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row; a null text has no words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, rank, source_size, target, blocks, slots.

    Weighted shares of all words, none above MOST times its source: what is cut off goes to the others by
    weight, again and again.  That ends where every source has the smaller of its bound and level * weight,
    and the level follows from the sources ordered by bound / weight.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("rank", F.lit(len(WEIGHTS))) + 1)
    one = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    every = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(one) - 1).withColumn("weight", weight)
    s = s.withColumn("bound", MOST * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    before = F.sum("bound").over(by_ratio) - F.col("bound")
    left = F.sum("weight").over(every) - F.sum("weight").over(by_ratio) + F.col("weight")
    s = s.withColumn("at", (F.sum("source_size").over(every) - before) / left)
    s = s.withColumn("level", F.min(F.when(F.col("at") <= F.col("ratio"), F.struct("ratio", "rank", "at"))).over(every)["at"])
    s = s.withColumn("target", F.least(F.col("bound").cast("double"), F.col("level") * F.col("weight")))
    passes = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - passes * F.col("source_size")
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    slots = passes * F.col("blocks") + F.least("blocks", F.floor(rest / BLOCK + 0.5))
    return s.select("source", "rank", "source_size", "target", "blocks",
                    F.when(F.col("source_size") > 0, slots).otherwise(0).cast("long").alias("slots"))


def slot_table(plan: DataFrame) -> DataFrame:
    """(rank, slot, block, shard): each output slot, the block it takes and the shard it is written to."""
    runs = plan.where("slots > 0").select("rank", "blocks", "slots", F.explode(
        F.expr(f"sequence(0L, (slots - 1) div {RUN})")).alias("run"))
    # runs of a large source are dealt over the tasks before they are unrolled
    runs = runs.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "run")
    slots = runs.select("rank", "blocks", F.explode(
        F.expr(f"sequence(run * {RUN}, least(slots, (run + 1) * {RUN}) - 1)")).alias("slot"))
    shards = plan.agg(F.greatest(F.lit(1), F.ceil(F.sum("slots") / SHARD)).alias("shards"))
    again = F.expr("slot div blocks")
    block = permuted(F.expr("slot % blocks"), F.col("blocks"), F.concat_ws(":", F.lit("mix"), "rank", again))
    out = slots.select("rank", "slot", block.alias("block"))
    shard = F.pmod(drawn(F.lit("shard"), F.concat_ws(":", "rank", "slot")), F.lit(shards.first()[0] or 1))
    return out.withColumn("shard", shard)


def placed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Sizes with their source's rank, source_size and target and the start of each document in its stream."""
    n = sizes.count()
    bucket = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(max(1, -(-n // BUCKET))))
    rows = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"]).withColumn("bucket", bucket)
    order = Window.partitionBy("rank", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    base = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    base = base.withColumn("base", F.sum("words").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("words"))
    return rows.join(base.select("rank", "bucket", "base"), ["rank", "bucket"]).withColumn("start", F.col("start") + F.col("base"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    taken counts the words that the mix takes from the document, repeats included: at most MOST times its
    size, and over a source within half a block of words for every pass of its target.  Null text: size 0,
    nothing taken.  A null source is a source of its own, the last.  A null doc_id is ordered last in its bucket;
    repeated rows keep their own places in the stream, so they may differ in what is taken, but as a set the rows
    do not depend on the order of the input.  Other columns are not read.  An empty table gives no rows.
    """
    sizes = written(sized(docs), "sizes")
    plan = written(targets(sizes), "targets")
    rows = written(placed(sizes, plan), "placed")
    # written, so that the join knows its size: the plan's few rows unroll into one for every block
    draws = written(slot_table(plan).groupBy("rank", "block").agg(F.count("*").alias("times")), "draws")
    pieces = rows.where("size > 0").select("*", F.explode(
        F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest("start", F.col("block") * BLOCK)
    met = pieces.join(draws, ["rank", "block"], "left").withColumn("taken", words * F.coalesce("times", F.lit(0)))
    out = met.groupBy("rank", "start", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return out.select(columns).union(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


#: The same rows in SQL.
ORACLE = r"""
WITH RECURSIVE
sizes AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}),
per AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sizes GROUP BY source),
weighted AS (
    SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS bound FROM per),
levels AS (
    SELECT *, bound / weight AS ratio,
        (sum(source_size) OVER () - (sum(bound) OVER o - bound))::DOUBLE
            / (sum(weight) OVER () - sum(weight) OVER o + weight)::DOUBLE AS lvl
    FROM weighted WINDOW o AS (ORDER BY bound / weight, rank)),
plan AS (
    SELECT source, rank, source_size,
        least(bound::DOUBLE, (SELECT arg_min(lvl, (ratio, rank)) FROM levels WHERE lvl <= ratio) * weight) AS target,
        CAST(ceil(source_size / 128) AS BIGINT) AS blocks FROM levels),
counted AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) * blocks
        + least(blocks, floor((target - floor(target / source_size) * source_size) / 128 + 0.5)) AS BIGINT) ELSE 0 END AS slots FROM plan),
steps AS (
    SELECT rank, blocks, 0 AS round, 'mix:' || rank || ':' || (slot // blocks) AS salt, slot % blocks AS x
    FROM (SELECT rank, blocks, unnest(range(slots)) AS slot FROM counted)
    UNION ALL
    SELECT rank, blocks, round + 1, salt,
        CASE WHEN substr(md5(salt || ':' || round || ':' || greatest(x, y)), 1, 1) >= '8' THEN y ELSE x END
    FROM (SELECT *, (((('0x' || substr(md5(salt || ':' || round || ':k'), 1, 12))::BIGINT - x) % blocks) + blocks) % blocks AS y
          FROM steps WHERE round < 8)),
draws AS (SELECT rank, x AS block, count(*) AS times FROM steps WHERE round = 8 GROUP BY rank, x),
placed AS (
    SELECT doc_id, size, source_size, target, rank, CAST(sum(size) OVER (PARTITION BY rank
        ORDER BY coalesce(doc_id, 0) % greatest(1, ceil((SELECT count(*) FROM sizes) / 20000)), doc_id ASC NULLS LAST, size
        ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
    FROM sizes JOIN counted ON sizes.source IS NOT DISTINCT FROM counted.source),
pieces AS (
    SELECT *, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM placed WHERE size > 0)
SELECT doc_id, size, source_size, target,
    CAST(sum((least(start + size, (p.block + 1) * 128) - greatest(start, p.block * 128)) * coalesce(times, 0)) AS BIGINT) AS taken
FROM pieces p LEFT JOIN draws d ON p.rank = d.rank AND p.block = d.block
GROUP BY p.rank, start, doc_id, size, source_size, target
UNION ALL
SELECT doc_id, size, source_size, target, 0 FROM placed WHERE size = 0
"""
