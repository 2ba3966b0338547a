"""Exact removal of long repeats by a distributed merge sort of front-coded suffixes.

A string of LENGTH bytes has an anchor: the place inside it where the hash of the next GRAM bytes is smallest.
Equal strings have equal anchors, so only the suffixes at anchors are compared, about one in seventy.  The
strings that share an anchor place form a segment, a run of start positions with the text they span.

1. Anchors are counted by hash.  Those met once are done.
2. Segments of the others go back to their texts.  Where all occurrences span the same text, every start repeats.
3. The rest, a few in a hundred, are sorted: every task sorts the suffixes that it has, writes each as the length
   of the prefix it shares with the one before and the bytes after that, and sends them to the bucket of their
   anchor.  There a loser tree merges the runs; it compares two strings only beyond the prefix that both are
   known to share with the last one put out, and hands the common prefixes on.  From these follows which starts
   repeat.  Anchors with very many different contexts are not gathered: their strings are counted by hash.
4. Texts and their ranges meet, and the covered bytes go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from airmon.llm.base import splitmix, written

LENGTH, GRAM = 200, 48
#: Different contexts of an anchor from which its strings are counted one by one instead of gathered.
HOT = 4096
#: Segments sorted by one task of the merge, about.
BUCKET = 20_000
_BASE = 0xD6E8FEB86659FD93


def gram_hashes(b: bytes) -> np.ndarray:
    """Mixed polynomial hash of the GRAM bytes at each place, by doubling."""
    cur = splitmix(np.frombuffer(b, np.uint8).astype(np.uint64), 1)
    acc, have, size, power, k = None, 0, 1, _BASE, GRAM
    while k:
        if k & 1:
            if acc is None:
                acc, have = cur, size
            else:
                n = len(b) - (have + size) + 1
                acc, have = acc[:n] * np.uint64(power) + cur[have : have + n], have + size
        k >>= 1
        if k:
            n = len(cur) - size
            cur = cur[:n] * np.uint64(power) + cur[size : size + n]
            size, power = 2 * size, power * power % 2**64
    return splitmix(acc, 2)


def segments(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first start, last start, anchor) of each run of starts with one anchor."""
    v = gram_hashes(b)
    span = LENGTH - GRAM + 1
    at, best, size = np.arange(len(v)), v, 1
    while size < span:
        # the smallest of two overlapping stretches, the left one on ties
        d = min(size, span - size)
        left = best[:-d] <= best[d:]
        at, best, size = np.where(left, at[:-d], at[d:]), np.where(left, best[:-d], best[d:]), size + d
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return v[at[first]].view(np.int64), first, last, at[first]


def digest(b: bytes) -> int:
    return xxhash.xxh64_intdigest(b, 1) - 2**63


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, the text and two keys of it; rows with equal texts have equal keys."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def cut(rows: DataFrame) -> DataFrame:
    """(h, u, k1, k2, pos, m): the segments of each text, once for equal texts of a batch; m counts those.

    u is a hash of the text that a segment spans; pos packs first start, number of starts less 1, and the anchor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, int] = {}
            keys: dict[str, tuple[int, int]] = {}
            for t, k1, k2 in zip(*(b.column(c).to_pylist() for c in ("text", "k1", "k2"))):
                seen[t] = seen.get(t, 0) + 1
                keys[t] = k1, k2
            out, held = [], 0
            for t, m in seen.items():
                raw = t.encode("utf-8", "surrogatepass")
                if len(raw) < LENGTH:
                    continue
                h, first, last, anchor = segments(raw)
                u = np.fromiter((digest(raw[x : y + LENGTH]) for x, y in zip(first.tolist(), last.tolist())), np.int64, len(h))
                pos = first << 20 | (last - first) << 10 | anchor - first
                out.append((h, u, np.full(len(h), keys[t][0]), np.full(len(h), keys[t][1]), pos, np.full(len(h), m)))
                held += len(h)
                if held > 200_000:
                    yield batch(out)
                    out, held = [], 0
            if out:
                yield batch(out)

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["h", "u", "k1", "k2", "pos", "m"])

    return rows.select("text", "k1", "k2").mapInArrow(run, "h long, u long, k1 long, k2 long, pos long, m long")


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n, i = min(len(a), len(b)), start
    step = 32
    while i < n and a[i : i + step] == b[i : i + step]:
        i += step
    i = min(i, n)
    while i < n and a[i] == b[i]:
        i += 1
    return i


class LoserTree:
    """Merge sorted runs of (string, prefix shared with the one before in its run, what belongs to it).

    Each run's head carries the length of the prefix that it shares with the last string put out.  The head
    that shares more is smaller; only heads that share equally much are compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int, object]]]):
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.runs = runs
        self.head: list = [None] * self.size
        self.shared = [-1] * self.size
        for i in range(len(runs)):
            self._advance(i)
            self.shared[i] = min(self.shared[i], 0)
        self.loser = [-1] * self.size
        self.winner = self._play(1)

    def _advance(self, i: int) -> None:
        self.head[i] = next(self.runs[i], None)
        self.shared[i] = -1 if self.head[i] is None else self.head[i][1]

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._match(node, self._play(2 * node), self._play(2 * node + 1))

    def _match(self, node: int, a: int, b: int) -> int:
        """Leave the loser at the node with the prefix it shares with the winner; give the winner."""
        if self.shared[a] == self.shared[b] and self.shared[a] >= 0:
            x, y = self.head[a][0], self.head[b][0]
            n = common(x, y, self.shared[a])
            if y[n : n + 1] < x[n : n + 1]:
                a, b = b, a
            self.shared[b] = n
        elif self.shared[a] < self.shared[b]:
            a, b = b, a
        self.loser[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        while self.head[self.winner] is not None:
            i = self.winner
            string, _, own = self.head[i]
            yield string, self.shared[i], own
            self._advance(i)
            node = (i + self.size) // 2
            while node:
                i = self._match(node, i, self.loser[node])
                node //= 2
            self.winner = i


def front_coded(members: list[tuple]) -> Iterator[tuple]:
    """Sorted members (suffix, ...) with the suffix replaced by (shared prefix, rest)."""
    before = b""
    for suffix, *rest in members:
        n = common(before, suffix, 0)
        yield n, suffix[n:], *rest
        before = suffix


def decoded(rows: list[tuple]) -> Iterator[tuple[bytes, int, tuple]]:
    before = b""
    for n, tail, *rest in rows:
        before = before[:n] + tail
        yield before, n, tuple(rest)


def repeated_starts(group: list[tuple[bytes, int, tuple]]) -> Iterator[tuple[int, int, int, int]]:
    """(h, u, from, to): which starts of each member, counted from its first, begin a string that another has too.

    A group is sorted by suffix and shares an anchor; a member is (suffix, shared prefix with the one before,
    (left context, number of starts, h, u, m)).
    """
    total: dict[tuple, int] = {}
    keys: list[list[tuple]] = []
    part = [0] * (LENGTH + 1)
    for suffix, shared, (left, starts, h, u, m) in group:
        # starts with more than ``shared`` bytes to the right of the anchor part from the members before
        for right in range(shared + 1, LENGTH + 1):
            part[right] += 1
        mine = []
        for s in range(starts):
            back = len(left) - s
            right = LENGTH - back
            key = (right, part[right], left[s:])
            total[key] = total.get(key, 0) + m
            mine.append(key)
        keys.append(mine)
    for (_, _, (_, starts, h, u, _)), mine in zip(group, keys):
        at = 0
        while at < starts:
            if total[mine[at]] < 2:
                at += 1
                continue
            end = at
            while end + 1 < starts and total[mine[end + 1]] > 1:
                end += 1
            yield h, u, at, end
            at = end + 1


def sorted_runs(met: DataFrame, buckets: int) -> DataFrame:
    """Each task's suffixes, sorted and front-coded, by bucket of their anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            found: dict[tuple, int] = {}
            for blob, marks in zip(b.column("blob").to_pylist(), b.column("marks").to_pylist()):
                raw = unpack(blob)
                for x in marks:
                    first, more, anchor = x["pos"] >> 20, x["pos"] >> 10 & 1023, x["pos"] & 1023
                    key = x["h"] % buckets, raw[first + anchor : first + more + LENGTH], raw[first : first + anchor], more + 1, x["h"], x["u"]
                    found[key] = found.get(key, 0) + 1
            rows, made = [], made + 1
            members = sorted((*k, m) for k, m in found.items())
            i = 0
            while i < len(members):
                j = i
                while j < len(members) and members[j][0] == members[i][0]:
                    j += 1
                rows += [(members[i][0], task << 32 | made, seq, *r) for seq, r in enumerate(front_coded([m[1:] for m in members[i:j]]))]
                i = j
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "run", "seq", "shared", "tail", "left", "starts", "h", "u", "m"])

    return met.select("blob", "marks").mapInArrow(
        run, "bucket long, run long, seq long, shared long, tail binary, left binary, starts long, h long, u long, m long")


def merge(key: tuple, t: pa.Table) -> pa.Table:
    """Merge the runs of a bucket and resolve each group of suffixes that begin with one anchor."""
    t = t.sort_by([("run", "ascending"), ("seq", "ascending")])
    runs: dict[int, list[tuple]] = {}
    for row in zip(*(t[c].to_pylist() for c in ("run", "shared", "tail", "left", "starts", "h", "u", "m"))):
        runs.setdefault(row[0], []).append(row[1:])
    out, group = [], []
    for string, shared, own in LoserTree([decoded(r) for r in runs.values()]):
        if shared < GRAM and group:
            out += repeated_starts(group)
            group = []
        group.append((string, shared, own))
    if group:
        out += repeated_starts(group)
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("h", "u", "from", "to"), zip(*out) if out else ((),) * 4)})


def strings_of(met: DataFrame) -> DataFrame:
    """(w1, w2, k1, k2, start): every string of the marked segments by a hash of 128 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for blob, marks, k1, k2 in zip(*(b.column(c).to_pylist() for c in ("blob", "marks", "k1", "k2"))):
                raw = unpack(blob)
                at = [s for x in marks for s in range(x["pos"] >> 20, (x["pos"] >> 20) + (x["pos"] >> 10 & 1023) + 1)]
                w = np.array([divmod(xxhash.xxh3_128_intdigest(raw[s : s + LENGTH]), 2**64) for s in at], np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(w[:, 0])), pa.array(np.ascontiguousarray(w[:, 1])), pa.array([k1] * len(at), pa.int64()),
                     pa.array([k2] * len(at), pa.int64()), pa.array(at, pa.int64())], ["w1", "w2", "k1", "k2", "start"])

    return met.select("blob", "marks", "k1", "k2").mapInArrow(run, "w1 long, w2 long, k1 long, k2 long, start long")


def packed(rows: DataFrame) -> DataFrame:
    """Texts compressed, for the shuffles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            blob = pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "k1", "k2")), blob], ["doc_id", "k1", "k2", "blob"])

    return rows.select("doc_id", "k1", "k2", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, blob binary")


def ranges(rows: DataFrame) -> DataFrame:
    """(k1, k2, first, last): starts of strings that also start elsewhere, for each different text."""
    # first by anchor and context, then by anchor: copies are combined before they meet
    contexts = cut(rows).groupBy("h", "u").agg(F.sum("m").alias("n"))
    anchors = contexts.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("contexts")).where("n > 1")
    anchors = written(anchors.select("h", F.when(F.col("contexts") == 1, "whole").when(
        F.col("contexts") > HOT, "hot").otherwise("part").alias("kind")), "anchors")
    met = written(cut(rows).join(anchors, "h").select("kind", "h", "u", "k1", "k2", "pos"), "segments")
    first, more = F.shiftright("pos", 20), F.shiftright("pos", 10).bitwiseAND(F.lit(1023))
    whole = met.where("kind = 'whole'").select("k1", "k2", first.alias("first"), (first + more).alias("last"))
    part, hot = (met.where(F.col("kind") == k) for k in ("part", "hot"))
    n = part.count()
    out = whole
    blobs = packed(rows)
    if n:
        # a segment counts once for each row that has its text, so copies of a text are repeats of each other
        marks = part.groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "u", "pos")).alias("marks"))
        runs = sorted_runs(blobs.join(marks, ["k1", "k2"]), -(-n // BUCKET))
        found = written(runs.groupBy("bucket").applyInArrow(merge, "h long, u long, from long, to long"), "repeats").distinct()
        here = part.join(found, ["h", "u"]).select("k1", "k2", (first + F.col("from")).alias("first"), (first + F.col("to")).alias("last"))
        out = out.union(here)
    if hot.limit(1).count():
        marks = hot.groupBy("k1", "k2").agg(F.collect_set(F.struct("pos")).alias("marks"))
        strings = written(strings_of(blobs.join(marks, ["k1", "k2"])), "strings")
        again = strings.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
        out = out.union(strings.join(again, ["w1", "w2"]).select("k1", "k2", F.col("start").alias("first"), F.col("start").alias("last")))
    return out


def covered(raw: bytes, found: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, bytes kept) of a text with ranges of repeated starts."""
    edge = np.zeros(len(raw) + 1, np.int32)
    for first, last in found:
        edge[first] += 1
        edge[last + LENGTH] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), kept


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Texts are taken as UTF-8; null texts are empty, texts under LENGTH bytes stay whole.  Repeated rows are
    copies of each other, so all their strings repeat.  A null doc_id stays null, an empty table gives no rows;
    only doc_id and text are read.
    """
    rows = texts(docs)
    by_text = ranges(rows).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for blob, found in zip(b.column("blob").to_pylist(), b.column("found").to_pylist()):
                raw = unpack(blob)
                n, spans, kept = covered(raw, [(x["first"], x["last"]) for x in found]) if found else (0, 0, raw)
                out.append((len(raw), n, spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = zip(*out) if out else ((),) * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = packed(rows).join(written(by_text, "ranges"), ["k1", "k2"], "left").select("doc_id", "blob", "found")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
