"""Secret scanning: patterns propose, a random forest removes false findings; DataFrame functions only.

Candidates are the values of names that speak of secrets (``API_KEY=...``, ``password: ...``, ``?token=...``), the
passwords of addresses (``scheme://user:...@host``) and long unbroken tokens with a digit.  Of a pair NAME=value the value
is the candidate and the name its context.  The forest sees the value's length, its character transitions, how much of it
a dictionary of the corpus covers, the path it comes from and the words next to it.

It is trained on labelled findings.  Where none are given, rules label the clear cases by what the forest does not see:
the formats of known services and of digests, words of placeholders, and whether the whole value is a word of the
corpus.  So it has to learn to tell by shape and surroundings what the rules tell by lists, and then judges values that
no list knows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from airmon.llm.base import let, written
from airmon.llm.pii import blocks_of, cut, matches, untouched

#: The size of the forest.
TREES, DEPTH = 30, 6
#: A word of the corpus has at least so many letters and is in at least this share of all documents, and in two.
WORD_LETTERS, WORD_SHARE = 4, 1e-3
# Naming words, formats of well-known keys and digests, words of placeholders and of paths.
NAMES = (r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|auth(?:orization)?|bearer|credentials?"
         r"|contraseña|passwort|motdepasse)")
FORMATS = (
    r"^(?:AKIA|ASIA)[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36}$", r"^xox[abprs]-[A-Za-z0-9-]{10,}$", r"^AIza[0-9A-Za-z_-]{35}$",
    r"^sk[_-](?:live|test|proj)?[_-]?[A-Za-z0-9]{20,}$", r"^eyJ[A-Za-z0-9_-]{20,}", r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$",
    r"^[A-Za-z0-9+/]{40,}={0,2}$",
)
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|change_me|your[_-]|xxxx|redacted|\*\*\*|<.*>|\$\{|%\(|0000000|1234567"
RISKY_PATH, SAFE_PATH = r"(?i)\.env|config|secret|credential|deploy|\.pem|\.key|settings", r"(?i)test|example|sample|doc|mock|fixture|readme"

#: A name, a sign or ``is`` that assigns, and the value; a bearer's scheme is no value.
_NAMED = (rf"(?i){NAMES}[A-Za-z0-9_.-]{{0,40}}[\"']?(?:\s{{0,3}}(?:=>|:=|==|[:=])\s{{0,3}}|\sis\s)(?:bearer\s{{1,3}}|basic\s{{1,3}})?[\"'`]?[^\s\"'`,;&<>(){{}}\[\]]{{6,}}+")
_VALUE = r"(?is)(?:=>|:=|==|[:=]|\sis\s)\s*(?:bearer\s+|basic\s+)?[\"'`]?([^\s\"'`,;&<>(){}\[\]]+)$"
_IN_ADDRESS = r"://[^/\s:@]{1,64}:[^@\s/]{4,}+@"
#: A long token; ``=`` belongs to it at its end only, as padding.
_TOKEN = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}"
TOKEN, IN_ADDRESS, NAMED = range(3)

FEATURES = ("length", "digits", "uppers", "lowers", "signs", "changes", "turns", "kinds", "coverage", "vowels", "hexadecimal",
            "named", "in_address", "quoted", "assigned", "sentence", "before_words", "risky_path", "safe_path")


def _values(text: Column) -> Column:
    """Spans of the values of names: a match without what comes before its value."""
    found = matches(text, _NAMED, NAMED)
    # the value follows the last quote, blank or sign that assigns inside the match
    own = F.transform(found, lambda s: let(F.regexp_extract(s["value"], _VALUE, 1), lambda v: F.struct(
        (s["end"] - F.char_length(v)).alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), v.alias("value"))))
    # a full stop or an exclamation mark at the end closes the sentence
    trimmed = F.transform(own, lambda s: let(F.regexp_replace(s["value"], r"[.!?]+$", ""), lambda v: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), (s["start"] + F.char_length(v)).alias("end"), v.alias("value"))))
    return F.filter(trimmed, lambda s: F.char_length(s["value"]) >= 6)


def _passwords(text: Column) -> Column:
    """Spans of the passwords of addresses: what lies between the second colon and the ``@`` of a match."""
    return F.transform(matches(text, _IN_ADDRESS, IN_ADDRESS), lambda s: let(F.regexp_extract(s["value"], r"(?s)\A://[^:]*:(.*)@\z", 1), lambda v: F.struct(
        (s["end"] - 1 - F.char_length(v)).alias("start"), s["kind"].alias("kind"), (s["end"] - 1).alias("end"), v.alias("value"))))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, start, end, value, before, after, path, kind) of every value of a naming word, password of an address and long token with a digit.

    Values come first: a password or a token that touches one is left to it.
    """
    text = F.coalesce("text", F.lit(""))
    place = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(place, F.lit("")).alias("path"))
    # step by step: one deep expression would take the analyzer too many rounds
    rows = rows.withColumn("named", _values(F.col("text"))).withColumn("secrets", _passwords(F.col("text")))
    rows = rows.withColumn("base", F.array_sort(F.concat("named", untouched(F.col("secrets"), F.col("named")))))
    rows = rows.withColumn("tokens", F.filter(matches(F.col("text"), _TOKEN, TOKEN), lambda s: s["value"].rlike("[0-9]")))
    found = F.array_sort(F.concat("base", untouched(F.col("tokens"), F.col("base"))))
    rows = rows.withColumn("found", found).withColumn("blocks", F.when(F.size("found") > 0, blocks_of(F.col("text"))))
    near = F.transform("found", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        F.lower(cut(F.col("blocks"), F.greatest(s["start"] - 48, F.lit(0)), s["start"])).alias("before"),
        F.coalesce(cut(F.col("blocks"), s["end"], F.least(s["end"] + 8, F.char_length("text"))), F.lit("")).alias("after"), s["kind"].alias("kind")))
    # an outer explode, then a filter: a filter on the array would be pushed down and search the text again
    return rows.select("doc_id", "path", F.explode_outer(near).alias("c")).where("c.start IS NOT NULL").select("doc_id", "c.*", "path")


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{WORD_LETTERS},}}"), F.lit(0))


def dictionary(docs: DataFrame) -> DataFrame:
    """(w): the longer words of the corpus, those in at least WORD_SHARE of all documents and in two; all texts are counted."""
    least = max(2.0, WORD_SHARE * docs.count())
    words = docs.select(F.explode(F.array_distinct(letter_runs(F.col("text")))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("w")


def in_dictionary(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with ``known``, the letters of a value that words of the dictionary cover, and ``word``, whether it is one as a whole.

    Different values are looked up once each, so copies of a value do not meet the dictionary.
    """
    runs = rows.select("value").distinct().select("value", F.explode(letter_runs(F.col("value"))).alias("w"))
    found = runs.join(words, "w").groupBy("value").agg(
        F.sum(F.char_length("w")).alias("known"), F.max(F.col("w") == F.lower("value")).alias("word"))
    return rows.join(found, "value", "left").select(*rows.columns, F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("word", F.lit(False)).alias("word"))


def with_features(rows: DataFrame, words: DataFrame | Sequence[str]) -> DataFrame:
    """``rows`` with the forest's features and ``a_word``; ``words`` is a dictionary, or empty."""
    given = rows.columns
    if isinstance(words, DataFrame):
        rows = in_dictionary(rows, words)
    else:
        rows = rows.withColumns({"known": F.lit(0), "word": F.lit(False)})
    v, before = F.col("value"), F.col("before")
    n = F.greatest(F.char_length(v), F.lit(1))
    left = lambda pattern: F.char_length(F.regexp_replace(v, pattern, ""))
    share = lambda pattern: (F.char_length(v) - left(pattern)) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        F.regexp_replace(v, "[^A-Za-z0-9]", "#"), "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a"), "#+", "#")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    values = {
        "length": F.least(n, F.lit(200)).cast("double"), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"), "changes": F.char_length(kinds) / n, "turns": (F.char_length(v) - left("[a-zA-Z][0-9]|[0-9][a-zA-Z]")) / n,
        "kinds": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64)), "coverage": F.col("known") / n, "vowels": share("(?i)[aeiou]"),
        "hexadecimal": flag(v.rlike("^[0-9a-f]+$")), "named": flag(F.col("kind") == NAMED), "in_address": flag(F.col("kind") == IN_ADDRESS),
        "quoted": flag(before.rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")), "assigned": flag(before.rlike(r"[:=]\s*[\"'`]?$")),
        "sentence": flag(before.rlike(r"\sis\s$")), "before_words": F.size(F.split(F.trim(before), r"\s+")).cast("double"),
        "risky_path": flag(F.col("path").rlike(RISKY_PATH)), "safe_path": flag(F.col("path").rlike(SAFE_PATH)),
    }
    return rows.select(*given, *(values[f].alias(f) for f in FEATURES), flag(F.col("word")).alias("a_word"))


def rule_labels(rows: DataFrame) -> DataFrame:
    """Candidates that lists can label: 1 for a known format that is named or of a service's own prefix and for an address's
    password, 0 for placeholders, words of the corpus, and tokens that are neither named nor of any format."""
    v = F.col("value")
    known = reduce(lambda a, p: a | v.rlike(p), FORMATS[1:], v.rlike(FORMATS[0]))
    own_prefix = reduce(lambda a, p: a | v.rlike(p), FORMATS[1:6], v.rlike(FORMATS[0]))
    placeholder = v.rlike(PLACEHOLDER)
    y = F.when(placeholder | (F.col("a_word") == 1), 0.0).when(
        own_prefix | (known & (F.col("kind") != TOKEN)) | (F.col("kind") == IN_ADDRESS), 1.0).when(
        ~known & (F.col("kind") == TOKEN), 0.0)
    return rows.withColumn("label", y).where("label IS NOT NULL")


def fit(rows: DataFrame) -> PipelineModel | float:
    """A forest from all labelled candidates; or the share of secrets where the labels have one class only."""
    train = written(rows.select("label", *FEATURES), "findings")
    rate = float(train.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0])
    if rate in (0.0, 1.0):
        return rate
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=42, featureSubsetStrategy="sqrt")
    return PipelineModel([assembler, forest.fit(assembler.transform(train))])


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points, end exclusive), value_sha256, score, is_secret.

    ``findings`` (doc_id, start, label 0 or 1) are labelled findings to train on; without them rules label.  Null and
    empty texts have no candidates, a null path is the empty path, a null doc_id stays.  Repeated rows give repeated
    rows; an empty table none.  Besides doc_id and text only source is read, as the path.  Texts are searched once for
    candidates and once for words: candidates with their features, far smaller, are written and read again for training
    and scoring.
    """
    found = written(candidates(docs), "candidates")
    rows = written(with_features(found, dictionary(docs)), "features")
    if findings is None:
        labelled = rule_labels(rows)
    else:
        known = findings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("int").alias("start"),
                                F.col("label").cast("double").alias("label")).where("label IS NOT NULL").dropDuplicates(["doc_id", "start"])
        labelled = rows.join(known, ["doc_id", "start"])
    model = fit(labelled)
    if isinstance(model, float):
        out = rows.withColumn("score", F.lit(model))
    else:
        out = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return out.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("is_secret"))
