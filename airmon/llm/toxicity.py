"""Toxicity: gradient-boosted trees over a few dense features, calibrated by isotonic regression.

The features are rates that do not grow with the text beside the plain counts: density and number of lexicon
words, their distance to words of the second person, capitals, punctuation, repeated characters, and lexicon
words that only appear when look-alike characters are undone.  The lexicon is a short list of insults joined
with the words that the training rows show to be far more frequent in toxic texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from airmon.llm.base import fold, written

#: Labelled rows for the models, about (a hash of the id decides); two thirds fit the trees, one third the calibration.
SAMPLE = 20_000
#: Words learned from the labels at most, and the texts that must have one.
LEARNED, SUPPORT = 60, 4
TREES, DEPTH = 20, 3

# Insults, words of the second person, look-alike characters.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash garbage disgusting clown clowns fool fools imbecile "
    "imbeciles jerk jerks creep creeps liar ugly vermin filth pig pigs bastard bastards bitch shit fuck fucking asshole cunt retard freak "
    "idioten dummkopf trottel arschloch abschaum idiota idiotas estupido imbecil basura escoria connard salaud abruti ordure".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su".split())
LOOKALIKE = str.maketrans("013457@$!|+€", "oieastasiite")
_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else 32 for c in range(256))
_EDGES = ".,;:!?\"'()[]{}<>#*%&"
_CAPITAL, _MARK, _LETTER = (np.array([chr(c) in x for c in range(256)]) for x in (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?.,;:*#$%&", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))

FEATURES = ("hits", "density", "learned", "learned_density", "kinds", "near_you", "you_density", "capitals", "shouted", "marks", "repeats",
            "masked", "masked_hits", "words")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of digits, a-z and all characters beyond ASCII."""
    return (text or "").lower().encode("utf-8", "replace").translate(_WORD_BYTES).decode().split()


def unmasked(token: str, lexicon: frozenset[str]) -> bool:
    """Whether a token is a lexicon word behind look-alike or separating characters, as in ``1d10t`` or ``i.d.i.o.t``."""
    token = token.strip(_EDGES).lower()
    return not token.isalpha() and any(t in lexicon for t in (
        token.translate(LOOKALIKE), "".join(filter(str.isalpha, token)), "".join(filter(str.isalpha, token.translate(LOOKALIKE)))))


def features(text: str | None, learned: frozenset[str]) -> list[float]:
    """One value for each of FEATURES; zeros (and the greatest distance) for a null or empty text."""
    text = text or ""
    words, tokens = words_of(text), text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    hit = [i for i, w in enumerate(words) if w in INSULTS]
    known = sum(w in learned for w in words)
    you = [i for i, w in enumerate(words) if w in SECOND]
    gap = 50
    if hit and you:
        at = np.searchsorted(you, hit)
        gap = min(gap, *(abs(h - you[k]) for h, j in zip(hit, at.tolist()) for k in (max(0, j - 1), min(j, len(you) - 1))))
    odd = [t for t in tokens if not t.isalpha()]
    inner = [t for t in odd if not t.strip(_EDGES).isalpha() and any(map(str.isalpha, t))]
    lexicon = INSULTS | learned
    # a token with marks inside counts only where it is no plain hit already
    undone = sum(unmasked(t, lexicon) and not any(w in lexicon for w in words_of(t)) for t in inner)
    shouted = sum(len(t) > 2 and t.isupper() for t in tokens)
    a = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    triple = int(((a[2:] == a[1:-1]) & (a[1:-1] == a[:-2]) & _LETTER[a[2:]]).sum()) if len(a) > 2 else 0
    return [float(min(len(hit), 50)), len(hit) / n, float(min(known, 50)), known / n, float(len({words[i] for i in hit})), float(gap),
            len(you) / n, int(_CAPITAL[a].sum()) / chars, shouted / n, int(_MARK[a].sum()) / chars, triple / n, len(inner) / n,
            float(min(undone, 50)), math.log1p(len(words))]


def learned_words(rows: DataFrame) -> frozenset[str]:
    """The words of the sample whose share of toxic texts is far above the rest, by smoothed log-odds of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for text, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                n.update((w, y > 0) for w in set(words_of(text)))
            words = list({w for w, _ in n})
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([n[w, True] for w in words], pa.int64()), pa.array([n[w, False] for w in words], pa.int64())],
                ["word", "toxic", "other"])

    total = rows.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    p, q = float(total.p or 0), float(total.n - (total.p or 0))
    words = rows.select("text", "label").mapInArrow(run, "word string, toxic long, other long")
    words = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (p + 1)) - F.log((F.col("other") + 0.5) / (q + 1))
    best = words.where((F.col("toxic") >= SUPPORT) & (F.col("toxic") > 20 * F.col("other") * p / max(q, 1.0)))
    return frozenset(r.word for r in best.orderBy((odds * F.sqrt("toxic")).desc(), "word").limit(LEARNED).collect())


def with_features(rows: DataFrame, learned: frozenset[str]) -> DataFrame:
    """``rows`` (with a text column) with the features in place of the text."""
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t, learned) for t in b.column("text").to_pylist()], np.float64).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c) for c in x.T)], [*keep, *FEATURES])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{f} double" for f in FEATURES)]))


class Model:
    """Lexicon, trees and calibration; or a constant where the labels have one class only."""

    def __init__(self, learned: frozenset[str], rate: float, trees: PipelineModel | None = None, calibration: IsotonicRegressionModel | None = None):
        self.learned, self.rate, self.trees, self.calibration = learned, rate, trees, calibration


def margin(trees: PipelineModel, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("margin", vector_to_array("probability")[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows outside fold 2 of crc32(doc_id) mod 4; several labels of an id count as their mean, rounded."""
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    y = y.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("toxic")).cast("double").alias("label"))
    # the sample is drawn from the labels, so only its texts are looked up; SAMPLE bounds what is broadcast
    known = y.where(fold("doc_id", 4) != 2)
    n = known.count()
    part = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(1, n))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the third that calibrates teaches neither words nor trees, or the margins it sees would be too good
    third = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))
    rows = written(texts.join(F.broadcast(part), "doc_id").withColumn("part", third), "labelled")
    learned = learned_words(rows.where("part > 0"))
    rate = float(rows.agg(F.avg("label")).first()[0] or 0.0)
    if rate in (0.0, 1.0):
        return Model(learned, rate)
    data = written(with_features(rows, learned), "features")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = assembler.transform(data.where("part > 0")).select("features", "label")
    if train.agg(F.countDistinct("label")).first()[0] < 2:
        return Model(learned, rate)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=42, minInstancesPerNode=5).fit(train)
    model = PipelineModel([assembler, trees])
    held = margin(model, data.where("part = 0")).select("margin", "label")
    if held.isEmpty():
        return Model(learned, rate, model)
    return Model(learned, rate, model, IsotonicRegression(featuresCol="margin", labelCol="label").fit(held))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from a score of 0.3).

    A null, empty or blank text is scored by its features, which are zeros.  Labels with a null id or value teach
    nothing; without both classes the score is the share of toxic labels, 0 without labels.  Repeated rows give
    repeated rows, an empty table none.  Of ``docs`` only doc_id and text are read.
    """
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 4) == 2).alias("held_out"), "text")
    if model.trees is None:
        out = rows.withColumn("score", F.lit(model.rate))
    else:
        out = margin(model.trees, with_features(rows, model.learned))
        if model.calibration is None:
            out = out.withColumn("score", F.col("margin"))
        else:
            out = model.calibration.setPredictionCol("score").transform(out)
    value = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return out.select("doc_id", "held_out", value.alias("score"), (value >= 0.3).cast("int").alias("predicted"))
