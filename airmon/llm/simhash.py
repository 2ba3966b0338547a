"""SimHash near-duplicates: bit-sliced comparison inside candidate buckets, then components.

Signatures that are close agree on some band of their bits.  Rows of a band value meet in one bucket;
there the signatures are stored as vertical bit planes, one machine word holding one bit of 64 of them,
and the list is compared with itself shifted by 1, 2, 3, ... places.  Differing bits of 64 lanes at a
time run into carry-save counters, and words whose lanes all exceed the radius are abandoned.
Buckets give a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from airmon.llm.base import written
from airmon.llm.components import components

#: A bucket beyond this many rows is dealt over pairs of chunks of about this size, so no task holds a hot bucket.
CHUNK = 2048
#: Rows compared in one go by a task; buckets are not cut by it.
SLAB = 16384
#: Most differing bits of a link, and the blocks that a fingerprint is cut into to find them.
RADIUS, BLOCKS = 4, 6


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII blanks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of ``k`` words joined by spaces; fewer words give one run."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(k, len(words))
    starts, ends = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        block = hashes[i : i + 8192].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, columns to keep, fp long) of every row: SimHash of four-word shingles, repeats included; no words give 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([majority(shingle_hashes(words_of(t), 4)) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(fp.view(np.int64))], [*kept, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1]) + ", fp long")


def planes_of(sig: np.ndarray) -> np.ndarray:
    """Rows of bytes turned into bit planes: plane b holds bit b of all rows, 64 rows to a word, one spare word."""
    bits = np.unpackbits(sig, axis=1).T
    packed = np.packbits(bits, axis=1, bitorder="little")
    words = -(-len(sig) // 64) + 1
    out = np.zeros((len(bits), words * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def within(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes i (bits of ``valid``) whose row differs from row i + shift in at most ``radius`` bits."""
    skip, r = divmod(shift, 64)
    live = np.flatnonzero(valid)
    counters = [np.zeros(len(live), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = ~valid[live]
    last, up, down = planes.shape[1] - 1, np.uint64(r), np.uint64(64 - r)
    for at in range(0, len(planes), 8):
        block = planes[at : at + 8]
        other = block[:, np.minimum(live + skip, last)]
        if r:
            other = (other >> up) | (block[:, np.minimum(live + skip + 1, last)] << down)
        diff = block[:, live] ^ other
        for i in range(0, len(diff) - 1, 2):
            # a full adder takes two planes and the lowest counter bit; its carry ripples upwards
            x, y, c = diff[i], diff[i + 1], counters[0]
            part = c ^ x
            counters[0], carry = part ^ y, (c & x) | (y & part)
            for k in range(1, len(counters)):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
        beyond = over | _above(counters, radius)
        keep = np.flatnonzero(~beyond)
        if not len(keep):
            return live[:0]
        if 4 * len(keep) < 3 * len(live):
            live, over, counters = live[keep], over[keep], [c[keep] for c in counters]
    good = ~(over | _above(counters, radius))
    bits = np.unpackbits(good.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return live[word] * 64 + bit


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is greater than ``radius``, by comparing bits from the top."""
    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def forest(group: np.ndarray, sig: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of a spanning forest of the links inside each run of equal ``group``.

    Rows of a group must be adjacent.  Every pair of a group is compared; of the links only those are
    given that join two parts of a group not yet joined.
    """
    n = len(group)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.repeat(np.diff(np.r_[start, n]), np.diff(np.r_[start, n]))
    label, left, right = np.arange(n), [], []
    first = np.repeat(start, np.diff(np.r_[start, n]))
    rows = np.flatnonzero(size > 1)
    shift, most, built = 1, int(size.max(initial=0)), -1
    while shift < most:
        if 2 * np.count_nonzero(size[rows] > shift) < len(rows) or built < 0:
            rows = rows[size[rows] > shift]
            planes, g, built = planes_of(sig[rows]), group[rows], shift
        lanes = np.zeros(planes.shape[1] * 64, bool)
        lanes[: len(rows) - shift] = g[shift:] == g[:-shift]
        valid = np.packbits(lanes, bitorder="little").view("<u8")
        i = within(planes, shift, valid, radius)
        a, b = rows[i], rows[i + shift]
        for p, q in zip(*(x[label[a] != label[b]].tolist() for x in (a, b))):
            if label[p] != label[q]:
                left.append(p), right.append(q)
                part = label[first[p] : first[p] + size[p]]
                part[part == label[q]] = label[p]
        shift += 1
    return np.array(left, np.int64), np.array(right, np.int64)


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect whatever lies within ``radius`` bits and shares a band.

    ``nodes`` has one row per different signature: node long, sig binary, bands array<struct<band int, key long>>.
    A bucket over CHUNK rows is dealt over all pairs of its chunks, each pair its own group of rows.
    """
    keyed = nodes.select("node", F.explode("bands").alias("k")).select("node", "k.band", "k.key")
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["band", "key"]).withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("node", "band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    met = met.join(nodes.select("node", "sig"), "node")
    key = ["band", "key", "lo", "hi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= SLAB:
                both = pd.concat(held, ignore_index=True)
                last = (both[key] == both[key].iloc[-1]).all(axis=1).to_numpy()
                if not last.all():
                    yield compared(both[~last])
                held = [both[last]]
        if held:
            yield compared(pd.concat(held, ignore_index=True))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        same = (pdf[key].to_numpy()[1:] == pdf[key].to_numpy()[:-1]).all(axis=1)
        group = np.r_[0, np.cumsum(~same)][: len(pdf)]
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1) if len(pdf) else np.zeros((0, 8), np.uint8)
        i, j = forest(group, sig, radius)
        node = pdf["node"].to_numpy(np.int64)
        return pd.DataFrame({"a": node[i], "b": node[j]}).drop_duplicates()

    met = met.repartition(*key).sortWithinPartitions(*key)
    return met.mapInPandas(run, "a long, b long").distinct()


def rooted(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(fp, root) of every different fingerprint of ``fps``; root is the same for all that are linked.

    Of ``blocks`` blocks of a fingerprint at least blocks - radius are equal in a link, so every link shares one of
    the chosen sets of blocks.
    """
    cut = [64 * i // blocks for i in range(blocks + 1)]
    block = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cut, cut[1:])]
    bands = [
        F.struct(F.lit(i).alias("band"), F.xxhash64(*(block[b] for b in chosen)).alias("key"))
        for i, chosen in enumerate(combinations(range(blocks), blocks - radius))
    ]
    different = fps.select("fp").distinct()
    nodes = different.select(F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("sig"), F.array(*bands).alias("bands"))
    root = components(links(nodes, radius))
    return written(different.join(root, different["fp"] == root["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (the smallest doc_id reachable over links).

    Fingerprints link at ``radius`` or fewer differing bits.

    Null or empty text: fingerprint 0, which links like any other.  A null doc_id is kept and cannot
    name a component; a component of null ids only has a null id.  Repeated rows give repeated rows.
    An empty table gives no rows.  Columns other than doc_id and text are not read.
    """
    fps = written(fingerprints(docs), "fingerprints")
    per_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(rooted(fps, radius, blocks), "fp")
    per_fp = written(per_fp, "rooted")
    named = per_fp.groupBy("root").agg(F.min("first").alias("component_id"))
    label = per_fp.join(named, "root").select("fp", "component_id")
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` without near copies: of each component of linked fingerprints the document of the smallest doc_id stays.

    Links are those of :func:`near_duplicates`: fingerprints of four-word shingles at ``radius`` or fewer differing
    bits.  Texts without words are copies of each other.  Rows with a null doc_id lose to any other of their component;
    of rows with one id, and of repeated rows, one stays.  An empty table stays empty.  All columns are kept, whatever
    their names; a row is told from others by two hashes of its values (columns with maps aside).
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"))
    values = [F.col(f"r.`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"]
    packed = packed.withColumns({"one": F.xxhash64(*values), "two": F.xxhash64(F.lit("row"), *values)})
    fps = written(fingerprints(packed.select("r.doc_id", "one", "two", "r.text"), "one", "two"), "fingerprints")
    best = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "one", "two")
    per_fp = fps.groupBy("fp").agg(F.min(best).alias("best")).join(rooted(fps, radius, blocks), "fp")
    kept = per_fp.groupBy("root").agg(F.min("best").alias("best")).select("best.one", "best.two")
    return packed.join(written(kept, "kept"), ["one", "two"], "left_semi").dropDuplicates(["one", "two"]).select("r.*")
