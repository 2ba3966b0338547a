import hashlib
import itertools
import random
import re
import zlib

from airmon.llm import conversations as conv
from airmon.llm.queries import op13_conversation_repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, turns) by trying every edit at every place; rows are (role, text, fault)."""
    best = None

    def grammar(s):
        return re.fullmatch("(s?(ua)+)?", s)

    # (cost, audit, roles, turns) after i rows, cheapest and ASCII-least by the initials so far
    now = {"": (0, "", ())}
    limit = 2 * len(rows) + 6
    def inserted(states):  # noqa: E306
        out = dict(states)
        for initials, (cost, audit, turns) in sorted(states.items(), key=lambda x: len(x[0])):
            for role in ("user", "assistant"):
                more = (initials + role[0], (cost + 2, audit + "I", turns + ((role, ""),)))
                if len(more[0]) <= limit and prefix(more[0]) and (more[0] not in out or more[1] < out[more[0]]):
                    out[more[0]] = more[1]
        return out

    def prefix(s):
        return re.fullmatch("(s?(ua)*u?)?", s)

    for role, text, fault in rows:
        for _ in range(2):
            now = inserted(now)
        then = {}
        for initials, (cost, audit, turns) in now.items():
            options = [(initials, (cost + 3, audit + "D", turns))]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                options.append((initials + (role[:1] or "?"), (cost + extra, audit + "K", turns + ((role, text),))))
                options += [(initials + r[0], (cost + 2 + extra, audit + "R", turns + ((r, text),))) for r in ("user", "assistant")]
            for key, value in options:
                if prefix(key) and (key not in then or value < then[key]):
                    then[key] = value
        now = then
    for _ in range(2):
        now = inserted(now)
    for initials, value in now.items():
        if grammar(initials) and (best is None or value[:2] < best[:2]):
            best = value
    return best


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        role, text, hit = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        out += [(conv_id, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def brute(rows):
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    out = []
    for conv_id, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marked, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            kept = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated"
            seen.add((role, text))
            n[fault] = n.get(fault, 0) + 1
            marked.append((role, text, fault))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, said = cheapest(marked)
        text = "\n".join(f"{r}:{t}" for r, t in said)
        out.append((conv_id, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def query(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/conversations.parquet")
    return sorted((tuple(r) for r in op13_conversation_repair(spark, str(path)).collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = op13_conversation_repair(spark, SF)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_random_conversations(spark, tmp_path):
    rng = random.Random(4)
    rows = [
        (c, rng.choice([t, t, t, 0, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]),
         rng.choice(["Well.", "And so", "Why? ", "", " \t", "Well.", None, f"No {t}!"]))
        for c in range(250) for t in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    assert query(spark, rows, tmp_path) == brute(rows)


def test_every_short_word_against_all_edits():
    graph = conv.Endings()
    fault = {"d": "blank"}
    signs = "suaxSUAXd"
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}
    for n in range(4):
        for word in map("".join, itertools.product(signs, repeat=n)):
            rows = [(role[c.lower()], "t", fault.get(c, "truncated" if c.isupper() else "")) for c in word]
            assert graph.solve(word[::-1]) == cheapest(rows)[:2], word


def test_common_endings_are_one_node():
    graph = conv.Endings()
    endings = sorted(("su" + "ua" * 50)[::-1] + tail for tail in ("s", "u", "a", "ss", "ua"))
    for word in endings:
        graph.solve(word)
    assert graph.made == 102 + 5  # the shared ending once, then one node for each ending's own signs


def test_hard_rows(spark, tmp_path):
    rows = [(None, 1, "user", "No id."), (None, None, None, None), (1, 5, "user", "x " * 50_000 + "."), (1, 6, "user", "x " * 50_000 + "."),
            (2, None, "assistant", "a"), (2, None, "assistant", "a"), (3, 9, "", ""), (4, -3, "System", "日本語 \U0001F600!"), (4, 10**12, "user", "q?")]
    rows += [(7, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(3000)]
    clashing = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as word", "2 as cost", "3 as audit", "4 as blank", "5 as dropped", "6 as hit")
    clashing.write.parquet(f"{tmp_path}/conversations.parquet")
    out = sorted((tuple(r) for r in op13_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    few = [r for r in rows if r[0] != 7]
    assert [r for r in out if r[0] != 7] == brute(few)
    (long,) = [r for r in out if r[0] == 7]
    own = damage([r for r in rows if r[0] == 7])
    assert long[2] == sum(t == "" for *_, t in own) and long[7].count("D") + long[7].count("K") + long[7].count("R") == len(own)
    assert op13_conversation_repair(spark, _empty(spark, tmp_path)).count() == 0


def _empty(spark, path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none/conversations.parquet")
    return f"{path}/none"


def test_all_rows_dropped(spark, tmp_path):
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert query(spark, [(gone, 0, "user", "Hi.")], tmp_path) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_are_a_dialogue(spark):
    rows = conv.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))
    by = {}
    for r in conv.repair(rows)[1].collect():
        by.setdefault(r.conv_id, []).append(r)
    for turns in by.values():
        turns.sort(key=lambda r: r.seq)
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns if r.seq >= 0))
