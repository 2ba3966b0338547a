"""Personal data by weak supervision, in DataFrame expressions only.

Base patterns find e-mail addresses, IP addresses, card and telephone numbers.  Wider patterns propose more
candidates (spelled-out addresses, IPv6, cards with other separators, telephone numbers without a plus).
Labelers, by pattern, gazetteer and context, vote on every candidate; expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is, and its posteriors train the final span
classifier, a naive Bayes model over the shape and surroundings of a span.  Candidates that it accepts are
added to the base spans, which always stay.

Every array function here works inside one row, so nothing is shuffled but the counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from airmon.llm.base import let

KINDS = ("email", "ip", "card", "phone")
_MAIL = r"A-Za-z0-9._%+-"
#: The base patterns.  A match can only begin where a run of its first characters begins, or where the match
#: before ended; saying so, and giving nothing back inside, keeps the search linear on any text.
BASE = (
    rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Candidates beyond the base patterns, one pattern for each kind.
WIDER = (
    rf"(?<![{_MAIL}])[{_MAIL}]++\s?(?:@|\[at\]|\(at\)|\{{at\}}|\sat\s)\s?[A-Za-z0-9-]++(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9]){12,18}(?![0-9])",
    r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
)
# Gazetteers and context words of the labelers.
TOP_LEVEL = "com|org|net|edu|gov|mil|int|info|biz|io|co|uk|de|fr|es|it|nl|eu|ch|at|be|pl|se|no|dk|fi|pt|br|mx|ar|cl|us|ca|au|nz|in|jp|cn|kr|ru|za"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|4[013456789]|5[12345678]|6[0123456]|8[1246]|9[0123458]"
ISSUERS = "3[47068]|4|5[1-5]|2[2-7]|6[0245]"
RESERVED = r"(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|2[2-5][0-9])\."
CUES = (
    "mail|contact|write|correo|courriel|kontakt|schreib", "ip|host|server|address|login|from",
    "card|visa|master|amex|pay|credit|tarjeta|carte|karte", "phone|call|tel|mobile|fax|sms|llame|appel|ruf",
)
AGAINST = "version|order|invoice|isbn|issn|chapter|page|section|total|sum|ref|token|secret|sha|hash"

VOTES = 6
ROUNDS = 60


def running(values: Column, start: Column, op) -> Column:
    """Inclusive running totals of an array under an associative ``op``, in blocks of about the square root of its length."""
    def blocks(a: Column) -> Column:
        total = lambda x: F.aggregate(x, start, op)
        return let(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda w: let(
            F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / w).cast("int") - 1), lambda b: total(F.slice(a, b * w + 1, w))),
            lambda sums: let(
                F.transform(sums, lambda _, b: total(F.slice(sums, 1, b))),
                lambda base: F.transform(a, lambda _, i: op(
                    F.get(base, (i / w).cast("int")), total(F.slice(a, (i / w).cast("int") * w + 1, i % w + 1)))))))

    return F.when(F.size(values) > 0, let(values, blocks)).otherwise(values)


def running_sum(lengths: Column) -> Column:
    """Inclusive running sums of an array."""
    return running(lengths, F.lit(0), lambda s, x: s + x)


#: Code points in a block of a text.
BLOCK = 4096


def blocks_of(text: Column) -> Column:
    """A text in blocks of BLOCK code points, so that a part of it is found without reading from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` up to ``end`` of a text in blocks."""
    a, b = (start / BLOCK).cast("int"), ((end - 1) / BLOCK).cast("int")
    one = F.substring(F.get(blocks, a), start % BLOCK + 1, end - start)
    more = F.concat(F.substring(F.get(blocks, a), start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, a + 2, b - a - 1), ""),
                    F.substring(F.get(blocks, b), F.lit(1), end - b * BLOCK))
    return F.when(end <= start, "").when(a == b, one).otherwise(more)


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches as array<struct<start, kind, end, value>>, positions in code points, end exclusive."""
    def located(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = let(gaps, lambda g: F.transform(found, lambda m, i: F.char_length(F.get(g, i)) + F.char_length(m)))
        return let(running_sum(lengths), lambda ends: F.transform(found, lambda m, i: F.struct(
            (F.get(ends, i) - F.char_length(m)).alias("start"), F.lit(kind).alias("kind"),
            F.get(ends, i).alias("end"), m.alias("value"))))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda m: F.when(F.size(m) > 0, located(m)).otherwise(empty))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check of card numbers on a string of digits."""
    def part(i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), lambda s, i: s + part(i)) % 10 == 0


def accepted(kind: int, value: Column) -> Column:
    """The checks that the base patterns leave open."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        short = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda s: F.when(
            F.char_length(s) < 4, F.coalesce(F.when(s == "", 0).otherwise(s.try_cast("int")), F.lit(0)) <= 255).otherwise(False))
        return F.forall(F.split(value, r"\."), short)
    least, most = ((14, 19), (10, 15))[kind - 2]
    number = digits(value)
    return let(number, lambda d: F.when(F.char_length(d).between(least, most), luhn(d) if kind == 2 else F.lit(True)).otherwise(False))


def base_spans(text: Column) -> Column:
    """The base spans of a text, sorted by start and kind."""
    def valid(kind: int, pattern: str) -> Column:
        return F.filter(matches(text, pattern, kind), lambda s: accepted(kind, s["value"]))

    found = [valid(k, p) for k, p in enumerate(BASE)]
    return F.array_sort(F.concat(*found))


def before_end(ends: Column, sorted_starts: Column) -> Column:
    """How many of some sorted numbers lie below ``ends``, by halving."""
    def halve(r: Column, _: Column) -> Column:
        mid = ((r["lo"] + r["hi"]) / 2).cast("int")
        low = F.get(sorted_starts, mid) < ends
        return F.when(r["lo"] >= r["hi"], r).otherwise(F.struct(
            F.when(low, mid + 1).otherwise(r["lo"]).alias("lo"), F.when(low, r["hi"]).otherwise(mid).alias("hi")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_starts) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(sorted_starts).alias("hi")), halve)["lo"]


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def untouched(spans: Column, base: Column) -> Column:
    """The ``spans`` that overlap none of ``base``, which is sorted by start and of each kind disjoint."""
    def ends(sorted_base: Column) -> Column:
        own = [F.filter(sorted_base, _of_kind(k)) for k in range(len(KINDS))]
        return F.array(*(let(x, lambda o: F.struct(
            F.transform(o, lambda b: b["start"]).alias("starts"), F.transform(o, lambda b: b["end"]).alias("ends"))) for x in own))

    def free(s: Column, kind: Column) -> Column:
        return F.coalesce(F.get(kind["ends"], before_end(s["end"], kind["starts"]) - 1) <= s["start"], F.lit(True))

    return let(let(base, ends), lambda kinds: F.filter(spans, lambda s: F.forall(kinds, lambda k: free(s, k))))


def candidates(text: Column, blocks: Column, base: Column) -> Column:
    """Base spans, marked so, and the wider matches that touch none of them."""
    mark = lambda s, is_base: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.lit(is_base).alias("base"),
        F.lower(cut(blocks, F.greatest(s["start"] - 24, F.lit(0)), s["start"])).alias("before"),
        F.coalesce(cut(blocks, s["end"], s["end"] + 1), F.lit("")).alias("after"))
    wide = F.concat(*(let(matches(text, p, k), lambda m: untouched(m, base)) for k, p in enumerate(WIDER)))
    return F.concat(F.transform(base, lambda s: mark(s, True)), F.transform(wide, lambda s: mark(s, False)))


def by_kind(c: Column, *options: Column) -> Column:
    """One of four expressions by the kind of a candidate."""
    return reduce(lambda e, k: F.when(c["kind"] == k, options[k]).otherwise(e), range(len(options)), F.lit(None))


def votes(c: Column) -> Column:
    """One character for each labeler: 1 personal data, 0 not, 2 no opinion."""
    say = lambda cond: F.when(cond, "1").otherwise("0")
    v, d = c["value"], digits(c["value"])
    size = F.char_length(d)
    # by pattern: signs that only the real thing has; base membership itself is no vote, it would decide alone
    check = by_kind(c, F.when(v.rlike(r"@|[\[({]at"), "1").otherwise("2"), say(c["base"] | v.contains(":")),
                    F.when(size.between(13, 19), say(luhn(d))).otherwise("0"),
                    F.when(~size.between(10, 15), "0").when(v.rlike(r"^\+|^\("), "1").otherwise("2"))
    gazetteer = by_kind(
        c, say(F.lower(v).rlike(rf"(?:\.|dot[\])\s]*)(?:{TOP_LEVEL})$")), say(~v.rlike(rf"^{RESERVED}")),
        say(d.rlike(rf"^(?:{ISSUERS})")), F.when(v.startswith("+"), say(d.rlike(rf"^(?:{CALLING})"))).otherwise("2"))
    cue = by_kind(c, *(F.when(c["before"].rlike(rf"\b(?:{w})"), "1") for w in CUES))
    against = F.when(c["before"].rlike(rf"\b(?:{AGAINST})"), "0").otherwise("2")
    glued = F.substring(c["before"], -1, 1).rlike(r"[\p{L}\p{N}_\"'=]") | c["after"].rlike(r"[\p{L}\p{N}_\"']")
    shape = F.when((size > 3) & d.rlike(r"^([0-9])\1*$"), "0").otherwise("2")
    return F.concat(check, gazetteer, F.coalesce(cue, F.lit("2")), against, F.when(glued, "0").otherwise("2"), shape)


def features(c: Column) -> Column:
    """Shape and surroundings of a candidate for the final classifier, each with few values."""
    v = c["value"]
    char = lambda x: F.when(x == "", "-").when(x.rlike(r"\s"), "s").when(x.rlike(r"\p{L}"), "a").when(
        x.rlike(r"\p{N}"), "n").otherwise("p")
    signs = F.concat(*(F.when(v.contains(s), s).otherwise("") for s in ("@", " ", "-", ".", "(", ":", "[", "/")))
    cue = F.concat(*(F.when(c["before"].rlike(rf"\b(?:{w})"), str(k)).otherwise("") for k, w in enumerate((*CUES, AGAINST))))
    return F.array(F.least(F.char_length(v), F.lit(40)).cast("string"), signs, char(F.substring(c["before"], -1, 1)), char(c["after"]), cue)


@dataclass
class Classifier:
    """Log-odds of each feature value, by kind, and the labelers' estimated reliabilities."""

    weights: dict[str, float] = field(default_factory=dict)
    reliability: dict[tuple[int, int], list[dict[str, float]]] = field(default_factory=dict)

    def accepts(self, c: Column) -> Column:
        if not self.weights:
            return F.lit(False)
        table = F.create_map(*(F.lit(x) for kv in sorted(self.weights.items()) for x in kv))
        score = lambda key: F.coalesce(F.element_at(table, key), F.lit(0.0))
        named = F.transform(features(c), lambda x, i: F.concat_ws(":", c["kind"], i, x))
        return F.aggregate(named, score(F.concat_ws(":", c["kind"], F.lit("prior"))), lambda s, k: s + score(k)) > 0


def expectation_maximisation(counts: dict[str, int], labelers: int = VOTES) -> tuple[dict[str, float], list[list[dict[str, float]]]]:
    """Posterior of each vote pattern, and for each labeler the chances of its votes under class 0 and class 1.

    The two-class model in which labelers err independently.  No opinion is a vote like the others: a labeler
    that only ever speaks against a candidate says something by its silence too.
    """
    post = {p: (1 + p.count("1")) / (2 + p.count("1") + p.count("0")) for p in counts}
    chance: list[list[dict[str, float]]] = []
    for _ in range(ROUNDS):
        weight = [sum(n * (1 - post[p]) for p, n in counts.items()), sum(n * post[p] for p, n in counts.items())]
        chance = [[{v: (1 + sum(n * abs(1 - y - post[p]) for p, n in counts.items() if p[k] == v)) / (3 + weight[y]) for v in "012"}
                   for y in (0, 1)] for k in range(labelers)]
        for p in counts:
            odds = math.log((1 + weight[1]) / (1 + weight[0]))
            odds += sum(math.log(chance[k][1][v] / chance[k][0][v]) for k, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, chance


def learn(docs: DataFrame) -> Classifier:
    """Vote counts over all rows, reliabilities by EM, then the classifier from the posteriors.

    What comes back to the driver is a table of counts: kinds x vote patterns x feature values, a few
    thousand rows however many documents there are.
    """
    text = F.coalesce("text", F.lit(""))
    c = docs.select(text.alias("text")).withColumns({"base": base_spans(F.col("text")), "blocks": blocks_of(F.col("text"))})
    c = c.select(F.explode(candidates(F.col("text"), F.col("blocks"), F.col("base"))).alias("c"))
    c = c.select(F.col("c.kind").alias("kind"), votes(F.col("c")).alias("votes"), features(F.col("c")).alias("f"))
    c = c.select("kind", "votes", F.posexplode("f").alias("i", "value"))
    rows = c.groupBy("kind", "votes", "i", "value").agg(F.count("*").alias("n")).collect()
    out = Classifier()
    for kind in sorted({r.kind for r in rows}):
        mine = sorted((r.votes, r.i, r.value, r.n) for r in rows if r.kind == kind)
        counts: dict[str, int] = {}
        for v, i, _, n in mine:
            if i == 0:
                counts[v] = counts.get(v, 0) + n
        post, chance = expectation_maximisation(counts)
        out.reliability |= {(kind, k): c for k, c in enumerate(chance)}
        yes, no = (sum(n * w for n, w in ((counts[p], abs(bad - post[p])) for p in counts)) for bad in (0, 1))
        out.weights[f"{kind}:prior"] = math.log((yes + 1) / (no + 1))
        soft: dict[tuple[int, str], list[float]] = {}
        for v, i, value, n in mine:
            s = soft.setdefault((i, value), [0.0, 0.0])
            s[0] += n * post[v]
            s[1] += n * (1 - post[v])
        for (i, value), (a, b) in soft.items():
            out.weights[f"{kind}:{i}:{value}"] = math.log((a + 0.5) / (yes + 1)) - math.log((b + 0.5) / (no + 1))
    return out


def with_spans(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` packed as r, with _text, _blocks, _base and _all (sorted spans of array<struct<start, kind, end, value>>)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"))
    rows = rows.withColumn("_text", F.coalesce("r.text", F.lit("")))
    rows = rows.withColumns({"_base": base_spans(F.col("_text")), "_blocks": blocks_of(F.col("_text"))})
    added = F.filter(candidates(F.col("_text"), F.col("_blocks"), F.col("_base")), lambda c: ~c["base"] & model.accepts(c))
    plain = F.transform(added, lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["value"].alias("value")))
    return rows.withColumn("_all", F.array_sort(F.concat("_base", plain)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest cover the base spans, ``spans`` also the added ones.  Null and empty texts have no
    spans and the digest of the empty text.  Spans of different kinds may overlap; added ones touch no base span.
    Repeated rows give repeated rows, a null doc_id stays, an empty table gives none; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = with_spans(docs, learn(docs))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        F.col("r.doc_id").alias("doc_id"), *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; n_chars follows the text.

    Overlapping spans are replaced as one, named after the first.  Null texts stay null, all columns and rows stay.
    """
    rows = with_spans(docs, learn(docs))
    names = F.array(*map(F.lit, KINDS))

    def pieces(reach: Column) -> Column:
        """The text between runs of overlapping spans, and the name of each run's first span."""
        each = F.sequence(F.lit(0), F.size("_all") - 1)
        opens = F.filter(each, lambda i: (i == 0) | (F.get(F.col("_all"), i)["start"] >= F.get(reach, i - 1)))
        return let(opens, lambda o: F.concat(F.array_join(F.transform(o, lambda i, k: F.concat(
            cut(F.col("_blocks"), F.when(k > 0, F.get(reach, i - 1)).otherwise(0), F.get(F.col("_all"), i)["start"]),
            F.lit("<"), F.upper(F.get(names, F.get(F.col("_all"), i)["kind"])), F.lit(">"))), ""),
            cut(F.col("_blocks"), F.element_at(reach, -1), F.char_length("_text"))))

    ends = F.transform("_all", lambda s: s["end"])
    clean = let(running(ends, F.lit(0), lambda a, b: F.greatest(a, b)), pieces)
    text = F.when(F.size("_all") > 0, clean).otherwise(F.col("r.text"))
    out = rows.select("r", text.alias("_clean"), (F.size("_all") > 0).alias("_changed"))
    value = {"text": F.col("_clean"), "n_chars": F.when(F.col("_changed"), F.char_length("_clean").cast("long")).otherwise(F.col("r.n_chars"))} \
        if "n_chars" in docs.columns else {"text": F.col("_clean")}
    return out.select(*(value.get(c, F.col("r")[c]).alias(c) for c in docs.columns))
