"""Merkle manifest of a table: leaves by group, blocks that keep whole levels as strings, proofs and their check.

Nodes of a level are numbered 0, 1, 2, ... and every FAN of them become one node of the next level, the hash of their
digests written one after the other; a level ends the tree when it has one node.  SPAN = FAN^STEPS consecutive nodes
form an aligned block: one row that keeps each of its levels as one string of hex digests.  A parent is the hash of a
fixed-width substring of the level below, the siblings of a node are the substrings on either side of it, and the last
digests of the blocks are the nodes of the next tier of blocks.  A tree of n nodes has about log(n) / log(SPAN) tiers.

Positions come from one exchange by range: no task holds a group, so a group may have any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from airmon.llm.base import fold, ranked, written

FAN, STEPS = 3, 6
SPAN = FAN**STEPS
#: Characters of a digest.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values written one after the other."""
    return F.sha2(F.concat(*values).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes in front, so that no two rows are written alike; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def _steps(total: Column) -> Column:
    """How many levels a block rises: to the next tier, or to the root where the group has one block."""
    return sum(((total > FAN**k).cast("int") for k in range(1, STEPS)), (total > 1).cast("int"))


def _levels(leaves: Column, steps: Column) -> Column:
    """All levels of a block, from its own digests up, each one string."""
    def parents(level: Column) -> Column:
        run = FAN * WIDTH
        each = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int"))
        return F.array_join(F.transform(each, lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), "").cast("binary")

    each = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    start = F.array(F.array_join(leaves, "").cast("binary"))
    return F.aggregate(each, start, lambda acc, _: F.concat(acc, F.array(parents(F.element_at(acc, -1)))))


def _beside(levels: Column, at: Column) -> Column:
    """For each level below the last the digests left and right of the ancestor of node ``at`` in its run."""
    def sides(level: Column, k: Column) -> Column:
        own = F.floor(at / F.pow(F.lit(FAN), k)).cast("int")
        first = own - own % FAN
        return F.struct(
            F.substring(level, first * WIDTH + 1, (own - first) * WIDTH).cast("string").alias("left"),
            F.substring(level, (own + 1) * WIDTH + 1, (first + FAN - 1 - own) * WIDTH).cast("string").alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), sides)


class Tree:
    """The blocks of all groups' trees: ``tiers[t]`` has (group columns, block, total, levels, kept) of tier t.

    ``kept`` holds, in order, a struct of the columns that were to be kept of each node (tier 0 only).
    """

    def __init__(self, nodes: DataFrame, group: Sequence[str], order: Sequence[str], value: str, keep: Sequence[str] = ()):
        self.group, self.tiers = list(group), []
        now = ranked(nodes.select(*group, *(c for c in dict.fromkeys([*order, value, *keep]) if c not in group)), group, order, "merkle")
        now = now.select(*group, "rank", "total", F.col(value).alias("value"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"))
        while True:
            blocks = now.groupBy(*self.group, F.floor(F.col("rank") / SPAN).alias("block")).agg(
                F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", "value", "kept"))).alias("nodes"))
            levels = _levels(F.col("nodes.value"), _steps(F.col("total")))
            blocks = written(blocks.select(*group, "block", "total", levels.alias("levels"), F.col("nodes.kept").alias("kept")), "blocks")
            self.tiers.append(blocks)
            if (blocks.agg(F.max("total")).first()[0] or 0) <= SPAN:
                break
            now = blocks.select(
                *group, F.col("block").alias("rank"), F.ceil(F.col("total") / SPAN).alias("total"),
                F.element_at("levels", -1).cast("string").alias("value"), F.struct(F.lit(0).alias("_")).alias("kept"))

    def roots(self) -> DataFrame:
        """(group columns, root) of every group."""
        return self.tiers[-1].select(*self.group, F.element_at("levels", -1).cast("string").alias("root"))

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """(group columns, above's columns, kept, value, path) for every node.

        ``path`` has the digests left and right of the node and of each of its ancestors; where ``above`` (group
        columns, path and others) is given, its path follows and its other columns are taken over.
        """
        group, out = self.group, above
        extra = [c for c in above.columns if c not in (*group, "path")] if above is not None else []
        for tier in range(len(self.tiers) - 1, -1, -1):
            blocks = self.tiers[tier]
            if out is None:
                met = blocks.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
            else:
                keys = [c for c in (*group, "block") if c in out.columns]
                met = blocks.join(out, _same(blocks, out, keys)).select(*(blocks[c] for c in blocks.columns), *(out[c] for c in extra), out["path"])
            each = met.select("*", F.posexplode("kept").alias("at", "one"))
            path = F.concat(_beside(F.col("levels"), F.col("at")), F.col("path"))
            own = F.substring(F.element_at("levels", 1), F.col("at") * WIDTH + 1, F.lit(WIDTH)).cast("string")
            out = each.select(
                *group, *extra, (F.col("block") * SPAN + F.col("at")).alias("block"), F.col("one").alias("kept"), own.alias("value"), path.alias("path"))
        return out.drop("block")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof(path: Column) -> Column:
    """The siblings along a path, as text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame) -> tuple[Tree, Tree]:
    """The trees of every source over its documents, and the tree over the sources' roots.

    A leaf is the hash of the row's FIELDS; leaves of a source ascend by doc_id, null first, and rows of one id by their
    leaf.  ``text_now``, if ``docs`` has it, is the text of a later copy whose leaf (``now``) is to be checked.
    """
    leaf = digest(*(field(F.col(c)) for c in FIELDS))
    now = leaf
    if "text_now" in docs.columns:
        other = digest(*(field(F.col("text_now" if c == "text" else c)) for c in FIELDS))
        now = F.when(F.col("text").eqNullSafe(F.col("text_now")), F.col("leaf")).otherwise(other)
    rows = docs.withColumn("leaf", leaf).select("doc_id", "source", "leaf", now.alias("now"))
    leaves = Tree(written(rows, "leaves"), ["source"], ["doc_id", "leaf"], "leaf", ["doc_id", "now"])
    return leaves, Tree(leaves.roots(), [], ["source"], "root", ["source"])


def check(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, subroot, root, path, and what the row's present copy folds to.

    Null values are hashed as ``-``, empty texts as an empty value; a null source is a source of its own and comes
    first.  Repeated rows are leaves of their own, next to each other.  An empty table has no rows and no root; other
    columns than FIELDS (and ``text_now``, see :func:`manifest`) are not read.
    """
    leaves, sources = manifest(docs)
    root = sources.roots().first()
    above = sources.paths().select(F.col("kept.source").alias("source"), F.col("value").alias("subroot"),
                       F.lit(root.root if root else None).cast("string").alias("root"), "path")
    out = leaves.paths(above)
    return out.select(
        F.col("kept.doc_id").alias("doc_id"), "source", F.col("value").alias("leaf"), "subroot", "root", "path",
        folded(F.col("kept.now"), F.col("path")).alias("folded_root"))


def tampered_text(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The trial damage: rows with an even crc32 of their id lose the line feeds of their text; a null id counts as the empty text."""
    return F.when(fold(doc_id, 2) == 0, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))


ORACLE = r"""
WITH RECURSIVE
bits(b, k, c) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
docs AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''),
        lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0 AS hit
    FROM documents, crc),
leaf AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(new) || ':' || new, '-')) AS now
    FROM (SELECT *, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS new,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM docs)),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS n FROM leaf),
tree(source, lvl, pos, n, h) AS (
    SELECT source, 0, pos, n, leaf FROM ordered
    UNION ALL SELECT source, any_value(lvl) + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
    FROM tree WHERE n > 1 GROUP BY source, pos // 3),
subs AS (
    SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top(lvl, pos, n, h) AS (
    SELECT 0, pos, n, subroot FROM subs
    UNION ALL SELECT any_value(lvl) + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
    FROM top WHERE n > 1 GROUP BY pos // 3),
low AS (
    SELECT o.source, o.pos AS leaf_pos, t.lvl,
        string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < t.pos) AS l, string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > t.pos) AS r
    FROM ordered o JOIN tree t ON t.source IS NOT DISTINCT FROM o.source AND t.n > 1 AND t.pos = o.pos // (3 ** t.lvl)::BIGINT
    JOIN tree s ON s.source IS NOT DISTINCT FROM o.source AND s.lvl = t.lvl AND s.pos // 3 = t.pos // 3
    GROUP BY ALL),
high AS (
    SELECT b.source, t.lvl,
        string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < t.pos) AS l, string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > t.pos) AS r
    FROM subs b JOIN top t ON t.n > 1 AND t.pos = b.pos // (3 ** t.lvl)::BIGINT
    JOIN top s ON s.lvl = t.lvl AND s.pos // 3 = t.pos // 3
    GROUP BY ALL),
lows AS (SELECT source, leaf_pos, list(coalesce(l, '') || '|' || coalesce(r, '') ORDER BY lvl) AS p FROM low GROUP BY ALL),
highs AS (SELECT source, list(coalesce(l, '') || '|' || coalesce(r, '') ORDER BY lvl) AS p FROM high GROUP BY ALL),
paths AS (
    SELECT o.doc_id, o.leaf, o.now, b.subroot, (SELECT h FROM top WHERE n = 1) AS root,
        list_concat(coalesce(x.p, []), coalesce(y.p, [])) AS p
    FROM ordered o JOIN subs b ON b.source IS NOT DISTINCT FROM o.source
    LEFT JOIN lows x ON x.source IS NOT DISTINCT FROM o.source AND x.leaf_pos = o.pos
    LEFT JOIN highs y ON y.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(p, ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(now, p), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root,
    list_reduce(list_prepend(now, p), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) = root AS verified
FROM paths
"""
