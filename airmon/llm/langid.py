"""Language identification by cross-parsing: the language whose text explains a document in fewest phrases.

For each language a suffix automaton of labelled text accepts every substring of that text.  A document
is parsed greedily: a phrase goes on while the automaton can follow it and a new one starts where it
cannot.  The number of phrases times log2 of the training length is a code length; per character it is
comparable between languages, and the smallest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from airmon.llm.base import fold, ranked, written

#: The training sample: for each language at most this many documents, spread by a hash of the id, and this many
#: characters of each (32,768 in all), in pieces spread over the whole text.  It bounds the automata; predictions
#: read whole texts.
SAMPLE_DOCS, SAMPLE_CHARS, PIECES = 64, 512, 4
#: Characters parsed side by side are taken from blocks of this length; every language gets the same cuts.
BLOCK = 2048
#: Blocks parsed at a time by a task.
LANES = 2048
#: Transitions kept as a full table up to this many cells for each language, as a sorted list beyond.
CELLS = 8_000_000


def pieces(text: str, seed: str) -> Column:
    """SAMPLE_CHARS characters of a text: one piece from each of PIECES equal stretches, its place chosen by hash; short texts whole."""
    n, piece = F.char_length(text), SAMPLE_CHARS // PIECES
    at = [F.floor(n * k / PIECES) for k in range(PIECES + 1)]
    cut = [F.substring(text, (at[k] + F.pmod(F.xxhash64(seed, F.lit(k)), F.greatest(at[k + 1] - at[k] - piece + 1, F.lit(1))) + 1).cast("int"), F.lit(piece))
           for k in range(PIECES)]
    return F.when(n <= SAMPLE_CHARS, F.col(text)).otherwise(F.concat_ws(" ", *cut))


def labelled(docs: DataFrame, held_out: bool) -> DataFrame:
    """The rows with text and language of the held-out fold or of the others."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ((fold("doc_id", 5) == 0) == held_out))


def sampled(docs: DataFrame) -> DataFrame:
    """(lang, slot, part): the training sample of each language."""
    return (
        labelled(docs, False).select("lang", "doc_id", pieces("text", "doc_id").alias("part"))
        .withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_DOCS)))
        .groupBy("lang", "slot").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(1)).alias("o"), "doc_id", "part")).alias("m"))
        .select("lang", "slot", "m.part")
    )


def training_text(docs: DataFrame) -> dict[str, str]:
    """Language to its sample; rows of the held-out fold and rows without text or language teach nothing."""
    out: dict[str, str] = {}
    for r in sorted(sampled(docs).collect()):
        out[r.lang] = out.get(r.lang, "") + " " + r.part
    return dict(sorted(out.items()))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normal(text: str | None) -> np.ndarray:
    """Code points, lower-cased, each run of other characters than letters turned into one blank."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, np.uint32(32))
    blank = code == 32
    return code[~(blank & np.r_[False, blank[:-1]])] if len(code) else code


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Parser:
    """The automata of all languages over one alphabet, stepped for many blocks at a time."""

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        code = [normal(t) for _, t in texts]
        self.langs = [lang for lang, _ in texts]
        self.alphabet = np.unique(np.concatenate(code)) if code else np.empty(0, np.uint32)
        self.width = len(self.alphabet) + 1  # the last symbol stands for all characters not learned
        self.bits = np.array([np.log2(max(2, len(c))) for c in code])
        self.tables = [self._table(suffix_automaton(np.searchsorted(self.alphabet, c).tolist())) for c in code]

    def _table(self, step: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray | None]:
        cells = [(s * self.width + c, t) for s, d in enumerate(step) for c, t in d.items()]
        at, to = (np.array(x, np.int64) for x in zip(*cells)) if cells else (np.empty(0, np.int64),) * 2
        if len(step) * self.width <= CELLS:
            full = np.zeros(len(step) * self.width, np.int32)
            full[at] = to
            return full, None
        order = np.argsort(at)
        return to[order].astype(np.int32), at[order]

    @staticmethod
    def _next(table: tuple[np.ndarray, np.ndarray | None], at: np.ndarray) -> np.ndarray:
        to, keys = table
        if keys is None:
            return to[at]
        i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        return np.where(keys[i] == at, to[i], 0)

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        out = np.zeros((len(codes), len(self.langs)), np.int64)
        blocks = [(d, c[i : i + BLOCK]) for d, c in enumerate(codes) for i in range(0, len(c), BLOCK)]
        blocks.sort(key=lambda b: -len(b[1]))
        for i in range(0, len(blocks), LANES):
            part = blocks[i : i + LANES]
            size = np.array([len(c) for _, c in part])
            flat = np.concatenate([c for _, c in part])
            symbol = np.minimum(np.searchsorted(self.alphabet, flat), max(0, self.width - 2))
            symbol = np.where(self.alphabet[symbol] == flat, symbol, self.width - 1)
            grid = np.zeros((size[0], len(part)), np.int32)
            step = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            grid[step, np.repeat(np.arange(len(part)), size)] = symbol
            active = np.searchsorted(-size, -np.arange(size[0]), side="left")
            count = np.stack([self._parse(t, grid, active) for t in self.tables], axis=1)
            np.add.at(out, [d for d, _ in part], count)
        return out

    def _parse(self, table: tuple[np.ndarray, np.ndarray | None], grid: np.ndarray, active: np.ndarray) -> np.ndarray:
        first = self._next(table, np.arange(self.width, dtype=np.int64)).astype(np.int32)
        state, count = np.zeros(grid.shape[1], np.int32), np.zeros(grid.shape[1], np.int64)
        for t, k in enumerate(active.tolist()):
            s, c = state[:k], grid[t, :k]
            to = self._next(table, s * np.int64(self.width) + c)
            fresh = (s == 0) | (to == 0)
            count[:k] += fresh
            state[:k] = np.where(to == 0, first[c], to)
        return count


@lru_cache(maxsize=1)
def parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    """Built once in each worker from the sample, which is what travels."""
    return Parser(texts)


def judge(texts: list[str | None], learned: tuple[tuple[str, str], ...]) -> list[tuple[str, float, float]]:
    """(language, score, bits a character) of each text; ``und`` where it has no letters or nothing was learned."""
    if not learned:
        return [("und", 0.0, 0.0)] * len(texts)
    p = parser(learned)
    codes = [normal(t) for t in texts]
    cost = p.phrases(codes) * p.bits
    out = []
    for c, bits in zip(codes, cost):
        if not (c != 32).any():
            out.append(("und", 0.0, 0.0))
            continue
        best = int(bits.argmin())
        share = np.exp(-8 * (bits / bits[best] - 1)).sum()
        out.append((p.langs[best], float(1 / share), float(bits[best] / len(c))))
    return out


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, bits (code length of a character).

    Learned from the text and language of rows with crc32(doc_id) mod 5 <> 0; a null id counts as the empty
    text.  ``und`` with score 0: null or empty text, text without letters, or nothing to learn from.  Ties go to
    the first language in code point order.  Whole texts are read, in blocks.  Repeated rows give repeated rows,
    an empty table none; only doc_id, text and lang are read, so other columns cannot clash.
    """
    learned = tuple(training_text(docs).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = judge(b.column("text").to_pylist(), learned)
            lang, score, bits = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(bits, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits double")


def usual_bits(docs: DataFrame, learned: tuple[tuple[str, str], ...]) -> dict[str, float]:
    """Language to the median bits a character of all its held-out documents, whole texts, at the phrase cost of the longest
    training text.

    Languages without any held-out document have the median over those that have some.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(learned)
        for b in batches:
            codes = [normal(t) for t in b.column("text").to_pylist()]
            cost = p.phrases(codes) * p.bits.max()
            bits = [float(c[p.langs.index(lang)] / len(x)) if lang in p.langs and (x != 32).any() else None
                    for lang, c, x in zip(b.column("lang").to_pylist(), cost, codes)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(bits, pa.float64())], ["lang", "bits"])

    if not learned:
        return {}
    rows = labelled(docs, True).select("lang", "text").mapInArrow(run, "lang string, bits double").where("bits IS NOT NULL")
    # the one or two in the middle of the order; no task holds a language
    placed = ranked(written(rows, "bits"), ["lang"], ["bits"], "bits_in_order")
    found = placed.where((F.col("rank") * 2).between(F.col("total") - 2, F.col("total"))).groupBy("lang").agg(F.avg("bits").alias("bits"))
    own = {r.lang: r.bits for r in found.collect()}
    return {lang: own.get(lang, float(np.median(list(own.values())))) for lang, _ in learned} if own else {}


def keep_identified(docs: DataFrame, slack: float = 2.0) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, and explained about as well as held-out text of the language.

    A text may cost ``slack`` times the usual bits a character of its language, and two phrases more, which matters
    for short ones; never as much as phrases of 1.2 characters, unless the middle one of the languages is allowed that:
    then the table teaches too little to tell by phrases.  Phrases cost the same in all languages here, those
    of the longest training text, so that one with little training text is not cheaper.  A language without held-out
    documents has the limit of the others; where no language has any, only that of the phrases holds.  Repeated rows all
    stay or all go, an empty table stays empty, all columns are kept.
    """
    learned = tuple(training_text(docs).items())
    usual = usual_bits(docs, learned)
    middle = slack * float(np.median(list(usual.values()))) if usual else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrase = dict(zip(parser(learned).langs, parser(learned).bits.tolist())) if learned else {}
        most = max(phrase.values(), default=0.0)
        for b in batches:
            texts = b.column("text").to_pylist()
            keep = []
            for t, (lang, _, bits) in zip(texts, judge(texts, learned)):
                good = lang != "und"
                if good:
                    limit = min(slack * usual.get(lang, most), max(most / 1.2, middle))
                    cost = bits * most / phrase[lang]
                    good = cost <= limit or (cost - limit) * len(normal(t)) <= 2 * most
                keep.append(good)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
