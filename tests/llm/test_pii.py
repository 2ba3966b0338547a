import hashlib
import random
import re

from pyspark.sql import functions as F

from airmon.llm import pii
from airmon.llm.queries import op1_pii_spans
from cases import clashing, documents, hard

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(s)) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def check(out, rows):
    rows = sorted(rows, key=str)
    out = sorted(((r, ) for r in out), key=lambda r: str((r[0].doc_id,)))
    got, want = [], []
    for (r,) in out:
        got.append((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
    for d, text in rows:
        b = brute(text)
        n = [sum(s.startswith(k) for s in b) for k in PLAIN]
        want.append((d, *n, hashlib.sha256(",".join(b).encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = op1_pii_spans(spark, SF).collect()
    check(out, [(r.doc_id, r.text) for r in docs.collect()])
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        assert set(brute(texts[r.doc_id])) <= set(filter(None, r.spans.split(",")))


def test_random_texts_match_brute_force(spark):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "1", "23", "456", ".", ".", "-", " ", " ", "+", "(", ")", "é", "\U0001F600", "%", "_", "\n",
             "x.y@mail.com", "1.2.3.4", "300.1.1.1", "0001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (555) 010-9999", "@@", "..", "99999999999999999999"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 50000, "1" * 50000, "a@" * 20000, "a@b" + ".c" * 20000, "+1" + "(" * 50000, "1.2.3.4 " * 3000, "é" * 70 + "a@b.c"]
    docs = documents(spark, texts).repartition(8)
    check(pii.find(docs).collect(), list(enumerate(texts)))


def test_hard_rows(spark):
    docs = clashing(hard(spark))
    out = pii.find(docs)
    check(out.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert pii.find(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()
    same = sorted(map(tuple, pii.redact(docs).collect()), key=str)
    assert same == sorted(map(tuple, docs.collect()), key=str)


def test_votes_add_spans_beyond_the_base(spark):
    rng = random.Random(7)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    texts = [f"please call me at +1 (555) {n(3)}-{n(4)} or mail joe{n(3)}@firm.com today" for _ in range(300)]
    texts += [f"order {n(2)}-{n(4)}-{n(3)} shipped under invoice {n(3)}.{n(3)}.{n(4)} again" for _ in range(100)]
    texts += [f"you can call me at (555) {n(3)} {n(4)} or mail joe{n(2)} [at] firm [dot] com today" for _ in range(40)]
    out = {r.doc_id: r.spans for r in pii.find(documents(spark, texts)).collect()}
    assert all("email:" in out[i] and "phone:" in out[i] for i in range(400, 440))
    assert not any("phone" in out[i] for i in range(300, 400))


def test_em_finds_the_reliable_labelers():
    rng = random.Random(11)
    counts: dict[str, int] = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        v = "".join("2" if rng.random() < 0.2 else str(int(y == (rng.random() < r))) for r in (0.95, 0.9, 0.85, 0.6))
        counts[v] = counts.get(v, 0) + 1
    post, chance = pii.expectation_maximisation(counts, 4)
    right = [c[1]["1"] / (1 - c[1]["2"]) for c in chance]
    assert abs(right[0] - 0.95) < 0.03 and abs(right[3] - 0.6) < 0.05 and post["1111"] > 0.95 and post["0000"] < 0.05


def test_redaction(spark):
    text = "é mail a.b@c.com, card 4111 1111 1111 1111 at 10.20.30.40 or +1 (555) 010-9999 end"
    got = pii.redact(documents(spark, [text])).first()
    assert got.text == "é mail <EMAIL>, card <CARD> at <IP> or <PHONE> end" and got.n_chars == len(got.text)


def test_one_text_with_very_many_addresses(spark):
    n = 50_000
    text = " ".join(f"mail{i}@host{i % 97}.com" for i in range(n))
    docs = documents(spark, [text, "a (at) b.com"])
    out = {r.doc_id: r for r in pii.find(docs).collect()}
    assert out[0].n_email == n and out[0].spans.count("email:") == n
    got = pii.redact(docs).where("doc_id = 0").first()
    assert got.text == " ".join(["<EMAIL>"] * n) and got.n_chars == len(got.text)


def test_parts_of_a_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 5)
    text = "aé\U0001F600\nbcdefghijklmnopqrstuv"
    df = spark.createDataFrame([(text,)], "text string").withColumn("b", pii.blocks_of(F.col("text")))
    for a in range(len(text) + 1):
        ends = range(a, len(text) + 1)
        got = df.select(*(pii.cut(F.col("b"), F.lit(a), F.lit(e)).alias(f"e{e}") for e in ends)).first()
        assert list(got) == [text[a:e] for e in ends]


def test_untouched_by_brute_force(spark):
    rng = random.Random(4)
    span = "array<struct<start:int,kind:int,end:int,value:string>>"
    rows, want = [], []
    for _ in range(60):
        base = []
        for kind in range(4):
            at = 0
            while (at := at + rng.randint(1, 30)) < 200:
                base.append((at, kind, at := at + rng.randint(1, 20), ""))
        base = sorted(base[: rng.choice([0, 3, 99])])
        wide = [(a, 0, a + rng.randint(1, 9), "") for a in sorted(rng.sample(range(220), 20))]
        rows.append((base, wide))
        want.append([w for w in wide if not any(b[0] < w[2] and w[0] < b[2] for b in base)])
    df = spark.createDataFrame(rows, f"base {span}, wide {span}").coalesce(1)
    got = [[tuple(s) for s in r.x] for r in df.select(pii.untouched(F.col("wide"), F.col("base")).alias("x")).collect()]
    assert got == want


def test_running_sum(spark):
    for n in (0, 1, 2, 5, 16, 101):
        a = F.array(*(F.lit(i % 7) for i in range(n))).cast("array<int>")
        want = [sum(i % 7 for i in range(k + 1)) for k in range(n)]
        assert spark.range(1).select(pii.running_sum(a).alias("x")).first().x == want


def test_plan_has_no_python(spark):
    plan = op1_pii_spans(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
