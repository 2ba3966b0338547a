"""Document fingerprints from closed syncmers, in DataFrame expressions only.

The letters are words (those over LONGEST characters, as in unspaced scripts, are read character by character).  A run of seven words is kept if, of the six
pairs of neighbours inside it, a pair at either edge has the smallest hash.  Whether a run is kept
depends on nothing outside it, so equal passages keep the same runs, in the same order, wherever they
stand; about one run in three is kept, and any two that follow each other overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airmon.llm.base import let

#: Words of a run, and the most characters of a word; longer unbroken text is read as single characters.
RUN, LONGEST = 7, 16
_LETTER = rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{1,{LONGEST}}}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"
#: Ranges of ids at most; each is one window of neighbours.
RANGES = 1 << 16


def anchors(text: Column) -> Column:
    """The hashes (32 bits) of the kept runs in text order, at least one where there are words.

    Where no run is closed (texts of up to about ten words) the run around the smallest pair is kept; of fewer than
    RUN words all pairs are, of one word that word.
    """
    def kept(t: Column) -> Column:
        pairs = F.transform(t, lambda w, i: F.xxhash64(w, F.get(t, i + 1)))
        return let(pairs, lambda h: let(F.filter(
            F.sequence(F.lit(0), F.size(t) - RUN),
            lambda i: F.least(F.get(h, i), F.get(h, i + 5)) <= F.least(*(F.get(h, i + k) for k in range(1, 5)))),
            lambda runs: F.transform(
                F.when(F.size(runs) > 0, runs).otherwise(F.array(smallest(t, h))),
                lambda i: small(F.xxhash64(F.get(h, i), F.get(h, i + 2), F.get(h, i + 4), F.get(t, i + 6))))))

    def smallest(t: Column, h: Column) -> Column:
        at = F.array_position(h, F.array_min(F.slice(h, F.lit(1), F.size(t) - 1))).cast("int") - 1
        return F.least(at, F.size(t) - RUN)

    small = lambda x: F.shiftright(x, 32).cast("int")
    return let(F.regexp_extract_all(text, F.lit(_LETTER), F.lit(0)), lambda t: F.when(F.size(t) >= RUN, kept(t)).when(
        F.size(t) > 1, F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: small(F.xxhash64(F.get(t, i), F.get(t, i + 1))))).when(
        F.size(t) > 0, F.transform(t, lambda w: small(F.xxhash64(w)))).otherwise(F.array().cast("array<int>")))


def written_out(fp: Column) -> Column:
    """Eight hexadecimal digits for each anchor."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard measure of the different anchors of two fingerprints; 1 where both have none."""
    def of(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(x) + F.size(y) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(F.array_distinct(a), lambda x: of(x, F.array_distinct(b))))


def with_next(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """``docs`` (id, text, fp) with next_text and next_fp: those of the next row by descending id, after the last the first.

    Ids are cut into ranges at quantiles.  A quantile is itself an id, so the row that follows a range
    is known to be the one at its lower end: that row enters both ranges, and no window spans the table.
    """
    spark = docs.sparkSession
    k = n_ranges or min(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = F.percentile_approx("id", [i / k for i in range(1, k)] or [0.5], F.lit(100 * k))
    found = docs.agg(cuts.alias("cuts"), F.max("id").alias("top")).first()
    ends = sorted(set(found.cuts or []))
    steps = [1 << i for i in reversed(range(len(ends).bit_length()))]
    if ends:
        at = F.array(*map(F.lit, ends))
        # how many range ends are below the id, by halving
        own = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: F.when(
            (p + s <= len(ends)) & (F.get(at, p + s - 1) < F.col("id")), p + s).otherwise(p))
    else:
        own = F.lit(0)
    rows = docs.withColumn("own", F.coalesce(own, F.lit(0)))
    last = F.get(F.array(*map(F.lit, ends)), F.col("own")) == F.col("id") if ends else F.lit(False)
    place = lambda r, part: F.array(F.struct(r.cast("int").alias("range"), F.lit(part).alias("part")))
    none = F.array().cast("array<struct<range:int,part:int>>")
    places = F.concat(
        place(F.col("own"), 0), F.when(last, place(F.col("own") + 1, 1)).otherwise(none),
        F.when(F.col("id").eqNullSafe(F.lit(found.top).cast("long")), place(F.lit(0), 2)).otherwise(none))
    rows = rows.withColumn("p", F.explode(places)).select("id", "text", "fp", "p.range", "p.part")
    order = Window.partitionBy("range").orderBy(F.col("part") == 2, F.col("id").desc_nulls_last(), F.xxhash64("text"))
    rows = rows.withColumn("next", F.lead(F.struct("text", "fp")).over(order)).where("part = 0")
    return rows.select("id", "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the beginning of the next document's text.  Null texts are
    empty, with an empty fingerprint.  Null ids come last; equal ids are ordered by a hash of the text.  A table of
    one row is its own next.  An empty table gives no rows; only doc_id and text are read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text")).withColumn("fp", anchors(F.col("text")))
    rows = with_next(rows).withColumn("n_chars", F.char_length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - tail), F.substring("next_text", F.lit(1), tail))
    rows = rows.withColumn("edited", edited).withColumn("edited_fp", anchors(F.col("edited")))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written_out(F.col("fp")).alias("fingerprint"),
        written_out(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
