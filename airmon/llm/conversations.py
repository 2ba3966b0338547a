"""Repair of conversations: the cheapest edits that make the roles a dialogue, from one automaton for all of them.

Every row of a conversation has a sign: its role's initial and its fault.  A conversation is the word of its signs.
Words are put in order of their *reversed* text, by range over all tasks, so that those with a common ending are
neighbours: walking along them is walking down a graph in which each common ending is one node.  A node knows, for each
state of the role grammar, what the cheapest edits from here to the end cost and the first of them; it is worked out from
the node after it, once, for all conversations that end so.  Only the nodes of the present word are held.

The grammar is ``(s?(ua)+)?`` on role initials.  Its states are :data:`START`, after the system turn, after a user turn
(an assistant is due) and after an assistant turn (complete).  In a state each kind of edit leads to one state only, so
the ASCII-least of the cheapest audits is the one that takes the least of the cheapest first edits at every node.

A conversation may be of any length: texts are never gathered, they pass by in turn order; a word has one byte a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airmon.llm.base import written

START, AFTER_SYSTEM, AFTER_USER, COMPLETE = range(4)
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 2, 3, 2, 1
#: Where a turn of that role leads from each state; -1: not allowed.
USER, ASSISTANT, SYSTEM = (AFTER_USER, AFTER_USER, -1, AFTER_USER), (-1, -1, COMPLETE, -1), (AFTER_SYSTEM, -1, -1, -1)
TURN = {"u": USER, "a": ASSISTANT, "s": SYSTEM}
#: The user or assistant turn that a state is waiting for, and where it leads.
DUE = tuple(max(u, a) for u, a in zip(USER, ASSISTANT))
#: Signs: the initial of a row to be deleted, of a whole row and, in capitals, of a truncated row; x: any other role.
GONE = "d"
BLANK = r"[^\x20\x09-\x0D]"
#: Rows handed on at a time.
BATCH = 4096

Node = tuple[tuple[int, ...], str]
#: After the last row: nothing more costs nothing where the grammar may end, else the assistant or the pair that is due.
END: Node = ((0, 2 * INSERT, INSERT, 0), ".II.")


def node(sign: str, after: Node) -> Node:
    """Costs and first edits, by state, before a row of this sign, given those after it."""
    costs, firsts = [], []
    truncated = LEFT_TRUNCATED if sign.isupper() else 0
    keeps = TURN.get(sign.lower(), (-1,) * 4)
    for state in range(4):
        options = [(DELETE + after[0][state], "D")]
        if sign != GONE:
            options.append((REROLE + truncated + after[0][DUE[state]], "R"))
            if keeps[state] >= 0:
                options.append((KEEP + truncated + after[0][keeps[state]], "K"))
        cost, first = min(options)
        costs.append(cost), firsts.append(first)
    # a turn inserted before this row: never two, which would lead back to the state for more
    plain = list(costs)
    for state in range(4):
        costs[state], firsts[state] = min((costs[state], firsts[state]), (INSERT + plain[DUE[state]], "I"))
    return tuple(costs), "".join(firsts)


class Endings:
    """The nodes along the ending of the present word; a common ending with the next word is kept."""

    def __init__(self) -> None:
        self.word, self.nodes, self.made = "", [END], 0

    def solve(self, word: str) -> tuple[int, str]:
        """The cost and the audit of a word; ``word`` is reversed, so its first sign is the last row's."""
        common = _common(self.word, word)
        del self.nodes[common + 1 :]
        for sign in word[common:]:
            self.nodes.append(node(sign, self.nodes[-1]))
            self.made += 1
        self.word, state, audit = word, START, []
        for i in range(len(word), -1, -1):
            edit = self.nodes[i][1][state]
            while edit == "I":
                audit.append(edit)
                state = DUE[state]
                # what follows an inserted turn is the row itself, or at the end perhaps one more turn
                edit = self.nodes[i][1][state]
            if i:
                audit.append(edit)
                state = _next(state, word[i - 1], edit)
        return self.nodes[len(word)][0][START], "".join(audit)


def _next(state: int, sign: str, edit: str) -> int:
    if edit == "D":
        return state
    return DUE[state] if edit == "R" else TURN[sign.lower()][state]


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def damaged(rows: DataFrame) -> DataFrame:
    """The trial damage by crc32 of ``conv_id:turn`` modulo 20, a null there being one space, as are null roles and texts.

    0 drops the row (it stays as a row with ``dropped`` true), 1 empties its text, 2 removes its ``.``, ``!`` and
    ``?``, 3 repeats it, 4 makes its role user.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")),
                       (F.crc32(name.cast("binary")) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("hit") == 0).alias("dropped"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blank``, ``again`` (role and text are also at an earlier turn) and ``cut`` (no end of a sentence).

    Rows of one turn that are equal altogether are neighbours in turn order, so copies within a turn are seen there.
    """
    blank = ~F.col("text").rlike(BLANK)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = rows.withColumns({"blank": blank, "cut": cut, "one": F.xxhash64("role", "text"), "two": F.xxhash64("text", F.lit(1), "role")})
    live = rows.where("not dropped and not blank")
    first = live.groupBy("conv_id", "one", "two").agg(
        F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("unknown"), F.min("turn").alias("from_turn"))
    first = first.where("n > 1").select(F.col("conv_id").alias("of"), F.col("one").alias("a"), F.col("two").alias("b"), "unknown", "from_turn")
    met = rows.join(first, rows["conv_id"].eqNullSafe(first["of"]) & (rows["one"] == first["a"]) & (rows["two"] == first["b"]), "left")
    later = F.coalesce(F.when(F.col("unknown"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("from_turn")), F.lit(False))
    return met.select("conv_id", "turn", "role", "text", "dropped", "blank", "cut", later.alias("again"))


ORDER = ("conv_id", "turn", "role", "text")
WORDS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, word string"
LEGAL = frozenset(("su", "ua", "au"))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= BATCH or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in b.slice(i, 256).columns))


class _Conversation:
    """What is known of the conversation that passes by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.count, self.illegal = conv_id, dict.fromkeys("bdt", 0), 0
        self.word, self.last, self.turns, self.low, self.high, self.initial = bytearray(), None, 0, None, None, None

    def add(self, turn: int | None, role: str, text: str, blank: bool, cut: bool, again: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        again = again or (turn, role, text) == self.last
        self.last = (turn, role, text)
        fault = "b" if blank else "d" if again else "t" if cut else ""
        if fault:
            self.count[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        sign = initial if initial in TURN else "x"
        self.word += (GONE if fault in ("b", "d") else sign.upper() if fault else sign).encode()

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *(self.count[x] for x in "bdt"), self.illegal, self.word[::-1].decode())


def words(rows: DataFrame) -> DataFrame:
    """One row per conversation: its gaps, faults by kind, illegal neighbours, and its reversed word of signs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now = None
            for conv_id, turn, role, text, dropped, blank, cut, again in _rows(batches):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        yield now.row()
                    now = _Conversation(conv_id)
                if not dropped:
                    now.add(turn, role, text, blank, cut, again)
            if now is not None:
                yield now.row()

        types = [pa.int64()] * 6 + [pa.string()]
        yield from _batches(out(), pa.schema(list(zip(("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "word"), types))))

    return rows.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(run, WORDS)


def solved(table: DataFrame) -> DataFrame:
    """The words' table with ``cost`` and ``audit``, by walking along the words in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, last = Endings(), None
        for b in batches:
            results = []
            for word in b.column("word").to_pylist():
                if last is None or word != last[0]:
                    last = (word, graph.solve(word))
                results.append(last[1])
            cost, audit = zip(*results) if results else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(cost, pa.int64()), pa.array(audit, pa.string())],
                                             ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    # equal words are dealt over several tasks as well: the id is part of the order
    return table.repartitionByRange("word", "conv_id").sortWithinPartitions("word").mapInArrow(
        run, WORDS.replace("word string", "cost long, audit string"))


TURNS = "conv_id long, seq long, edit string, role string, text string"


def edited(audit: Iterator[str], turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every turn that stays, in order."""
    state = START
    for edit in audit:
        if edit == "I":
            role, text = ("assistant" if state == AFTER_USER else "user"), ""
        else:
            role, text = next(turns)
            if edit == "D":
                continue
        if edit == "R":
            role = "assistant" if state == AFTER_USER else "user"
        state = TURN[role[0]][state]
        yield edit, role, text


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, seq, edit, role, text): the turns of every conversation after its edits, in order within a task.

    A conversation without turns has one row, of seq -1 and nulls.
    """
    heads = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), "audit", F.lit("").alias("text"), F.lit(0).alias("kind"))
    turns = rows.where("not dropped").select("conv_id", "turn", "role", "text", F.lit(1).alias("kind"))
    both = heads.withColumnRenamed("audit", "role").unionByName(turns)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").select("conv_id", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            rows = _rows(batches)
            head = next(rows, None)
            while head is not None:
                conv_id, following, seq = head[0], None, -1

                def own() -> Iterator[tuple[str, str]]:
                    nonlocal following
                    for c, kind, role, text in rows:
                        if not kind:
                            following = (c, kind, role, text)
                            return
                        yield role, text

                turns = own()
                for seq, (edit, role, text) in enumerate(edited(iter(head[2]), turns)):
                    yield conv_id, seq, edit, role, text
                if seq < 0:
                    yield conv_id, -1, None, None, None
                for _ in turns:  # to the next head
                    pass
                head = following

        schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        yield from _batches(out(), schema)

    return both.mapInArrow(run, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of turns as :func:`repaired` gives them: ``role:text`` joined by line feeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            at, now = None, None
            for conv_id, seq, _, role, text in _rows(batches):
                if seq <= 0:
                    if now is not None:
                        yield at, now.hexdigest()
                    at, now = conv_id, hashlib.sha256()
                if seq >= 0:
                    now.update((f"\n{role}:{text}" if seq else f"{role}:{text}").encode("utf-8", "surrogatepass"))
            if now is not None:
                yield at, now.hexdigest()

        yield from _batches(out(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, turns) of conversations given as rows (conv_id, turn, role, text, dropped).

    ``audits`` has one row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit.  ``turns`` are those
    of :func:`repaired`.  Rows are taken by turn, null first, then by role and text.  A null conv_id is a conversation of
    its own.  Repeated rows are duplicates; a text of blanks is blank; roles of other initials than s, u and a must be
    changed or deleted.  A row that is dropped only tells that its conversation exists; one without other rows has
    zeros and no edits.  An empty table gives empty tables; other columns are not read.
    """
    rows = written(faults(rows), "turns")
    audits = written(solved(written(words(rows), "words")), "audits")
    return audits, repaired(rows, audits)
