"""Small tables that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None, sources=None, ids=None):
    n = len(texts)
    rows = [((ids or list(range(n)))[i], t, (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], None if t is None else len(t))
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def hard(spark, words: int = 4000):
    """Null ids, texts, languages and sources, an empty and a blank text, a long text, repeated rows and ids."""
    long = " ".join(f"word{i * 7919 % 997} and" for i in range(words))
    base = "the quick brown fox jumps over the lazy dog near the river bank while birds sing in the old tree " * 3
    rows = [
        (1, base, "en", "a", len(base)), (1, base, "en", "a", len(base)), (1, "another text with the same id", "en", "b", 29),
        (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "de", "a", 4), (None, base + "x", "en", None, None),
        (None, None, None, None, None), (5, long, "en", "a", len(long)), (6, "x" * 3000, None, "b", 3000),
        (7, "¿Qué? 日本語 ñandú ß \U0001F600 " * 20, "es", "b", None), (8, "one", "en", "c", 3), (9, "!!! ??? 123", None, "c", 11),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """Extra columns named like things an operator may use inside."""
    from pyspark.sql import functions as F

    for c in ("h", "n", "key", "node", "row", "r", "fp", "size", "root", "hit", "block", "score", "a", "b", "spans", "word"):
        docs = docs.withColumn(c, F.lit("x"))
    return docs
