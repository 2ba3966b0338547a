"""Benchmark decontamination: which documents contain which test items.

Items are short and documents long, so the question is containment: the share of an item's five-word
shingles that a document has.  Items are partitioned by size.  Each partition has one MinHash sketch
depth, deep enough that a document holding the asked share of an item must hold a known number of the
item's smallest hashes.  Documents look up all their shingles in these sketches, so none is missed,
and every candidate is verified on the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airmon.llm.simhash import shingle_hashes

SHINGLE, CONTAINMENT = 5, 0.8
#: Shingles of items held by a task at a time (about 100 MB); a larger benchmark is searched in several passes.
MOST_SHINGLES = 1_000_000
_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, a-z and all characters beyond ASCII."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def shingles(words: list[bytes]) -> set[bytes]:
    """The different runs of five words; fewer words are one run, no words none."""
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def allowed_misses(n: int, share: float) -> int:
    """The most shingles out of n that may lack when ``share`` of them is present."""
    return n - math.ceil(share * n - 1e-9)


class Index:
    """Sketches of the items: sorted hash keys, and for each key the items it belongs to."""

    def __init__(self, items: tuple[tuple[int | None, str], ...], share: float):
        self.ids = [i for i, _ in items]
        self.sets = [shingles(words_of(t)) for _, t in items]
        keys, owner, need = [], [], []
        for k, (_, text) in enumerate(items):
            h = np.unique(shingle_hashes(words_of(text), SHINGLE))
            # the partition: sizes from 2^(c-1) to 2^c - 1; twice the depth that the largest of them needs
            depth = 2 * (allowed_misses(2 ** len(h).bit_length() - 1, share) + 1)
            sketch = h[:depth]
            keys.append(sketch), owner.append(np.full(len(sketch), k))
            need.append(max(1, len(sketch) - allowed_misses(len(h), share)))
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.need = np.array(need, np.int64)
        self.keys, first = np.unique(key[order], return_index=True)
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int64))[order]
        self.bound = np.r_[first, len(key)]
        self.share = share

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Items of which enough sketch values are among the hashes."""
        if not len(self.keys) or not len(hashes):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.unique(at[self.keys[at] == hashes])
        if not len(hit):
            return hit
        met = np.concatenate([self.owner[self.bound[k] : self.bound[k + 1]] for k in hit.tolist()])
        item, hits = np.unique(met, return_counts=True)
        return item[hits >= self.need[item]]

    def matches(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, shingles of the item, those in the text) of each item contained in the text."""
        words = words_of(text)
        found = self.candidates(shingle_hashes(words, SHINGLE))
        if not len(found):
            return []
        have, out = shingles(words), []
        for k in found.tolist():
            n, shared = len(self.sets[k]), len(self.sets[k] & have)
            if n - shared <= allowed_misses(n, self.share):
                out.append((self.ids[k], n, shared))
        return out


@lru_cache(maxsize=1)
def index(items: tuple[tuple[int | None, str], ...], share: float) -> Index:
    return Index(items, share)


def slices(benchmark: DataFrame) -> list[tuple[tuple[int | None, str], ...]]:
    """The items in parts of at most about MOST_SHINGLES shingles, judged by the length of their texts."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    # a shingle starts at every word, and a word and its separator take two characters at least
    total = items.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    n = math.ceil(total / MOST_SHINGLES)
    parts = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n))
    return [tuple((r.item_id, r.text) for r in sorted(p.collect(), key=str)) for p in parts]


def contained_items(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) wherever a document has ``share`` of an item.

    Null, empty or wordless texts have no shingles: such items are found nowhere, such documents contain
    nothing.  Items of fewer than five words are one shingle, found only in a text that is those words and no
    more.  Repeated rows of either table give repeated rows; null ids stay null.  Other columns are not read.
    """
    parts = slices(benchmark)

    def search(items: tuple[tuple[int | None, str], ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = index(items, share)
            for b in batches:
                row, item, size, shared = [], [], [], []
                for k, text in enumerate(b.column("text").to_pylist()):
                    for i, n, s in look.matches(text):
                        row.append(k), item.append(i), size.append(n), shared.append(s)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(shared, pa.int64())], ["doc_id", "item_id", "item_shingles", "shared"])
        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, item_shingles long, shared long"
    found = [rows.mapInArrow(search(p), schema) for p in parts] or [docs.sparkSession.createDataFrame([], schema)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns are kept and nothing is shuffled."""
    def keep(items: tuple[tuple[int | None, str], ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = index(items, share)
            for b in batches:
                yield b.filter(pa.array([not look.matches(t) for t in b.column("text").to_pylist()], pa.bool_()))
        return run

    for part in slices(benchmark):
        docs = docs.mapInArrow(keep(part), docs.schema)
    return docs
