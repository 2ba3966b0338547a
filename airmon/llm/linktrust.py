"""URL filter: path rules where they fit, and for other urls the trust and distrust that links carry to their host.

A host's own part of trust (distrust) is the share of its pages that an allow (block) rule fits.  Trust goes on along
the links between hosts, as personalised PageRank from the trusted hosts: DAMPING of what a host has is dealt over the
hosts it links to, by the number of its pages that do.  Distrust goes the other way, from blocked hosts to those that
link to them.  Scores are sums over the number of links passed, so a host of blocked pages alone that nothing reaches
has a distrust of 1.

Scores are whole numbers of 1/UNIT and each share is rounded down, so neither the order of a sum nor a task that is run
again changes them, and what is passed on dies out by itself; after ROUNDS links at the latest, when less than
DAMPING^ROUNDS of a seed is left.  A round is one join of the hosts that still pass something on with the edges and one
grouped sum, written to the shared folder.  Everything is expressed in columns; no link, host or page comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from airmon.llm.base import LOWER, UPPER, written

UNIT, DAMPING_PERCENT, ROUNDS = 10**9, 85, 64
#: A host is blocked where its distrust is at least this and more than its trust.
THRESHOLD = 0.5
BLANKS = r"\x20\x09-\x0D"
#: The host of an absolute link of an anchor; relative links stay on their host.
LINK = (rf"(?i)<a[{BLANKS}](?:[^<>]*[{BLANKS}])?href[{BLANKS}]*=[{BLANKS}]*[\"']?[{BLANKS}]*"
        rf"(?:https?:)?//([^/?#\"'{BLANKS}<>]+)")

Rule = tuple[str, str]
#: (action, host/path) of the trial.
RULES: Sequence[Rule] = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """(rule_host, rules: array of (length, blocks, path, rule)) of rules given as action and host/path."""
    rows = [(rule.split("/", 1)[0], "/" + rule.split("/", 1)[1], rule, action == "block") for action, rule in rules]
    rows = spark.createDataFrame(rows, "rule_host string, path string, rule string, blocks boolean")
    one = F.struct(F.char_length("rule").alias("length"), "blocks", "path", "rule")
    return rows.groupBy("rule_host").agg(F.collect_set(one).alias("rules"))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) of the ``hosts`` that are, or are below, the host of a rule."""
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = hosts.where("host <> ''").select("host", F.explode(ends).alias("rule_host")).join(rules, "rule_host")
    return met.groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))


def judged_by_rule(urls: DataFrame, own: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``hit``, the longest rule whose path theirs starts with; of two as long the blocking one."""
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    return urls.join(own, "host", "left").withColumn("hit", F.array_max(fits)).drop("rules")


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, n): how many pages of a host have a link to another; copies of a link on a page count once."""
    found = F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    links = pages.select(host_of(F.col("url")).alias("source"), F.explode(found).alias("target"))
    links = links.select("source", F.translate("target", UPPER, LOWER).alias("target"))
    return links.where("source <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def arcs(links: DataFrame) -> DataFrame:
    """(kind, source, target, n, total): trust along the links, distrust against them; total is the sum of n of a source."""
    both = links.select(F.lit("trust").alias("kind"), "source", "target", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n"))
    return both.join(both.groupBy("kind", "source").agg(F.sum("n").alias("total")), ["kind", "source"])


def passed_on(now: DataFrame, arcs: DataFrame) -> DataFrame:
    """(kind, host, score) of what ``now`` hands to the next hosts."""
    met = now.withColumnRenamed("host", "source").join(arcs, ["kind", "source"])
    share = F.expr(f"(CAST(score AS DECIMAL(19, 0)) * CAST({DAMPING_PERCENT} * n AS DECIMAL(19, 0))) div CAST(100 * total AS DECIMAL(19, 0))")
    return met.groupBy("kind", F.col("target").alias("host")).agg(F.sum(share).alias("score")).where("score > 0")


def propagate(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, host, score): personalised PageRank of trust and, on reversed links, of distrust from ``seeds`` (kind, host, score)."""
    edges = written(arcs(links), "arcs")
    rounds = [written(seeds.where("score > 0"), "seeds")]
    for _ in range(ROUNDS):
        now = written(passed_on(rounds[-1], edges), "passed")
        if now.isEmpty():
            break
        rounds.append(now)
    return reduce(DataFrame.unionByName, rounds).groupBy("kind", "host").agg(F.sum("score").alias("score"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A url that no rule fits is blocked where its host's distrust is at least THRESHOLD and more than its trust.  A null
    url, and one without ``://`` or without a host, is no part of the graph and is allowed; a null html has no links.
    Repeated rows are judged each and count each; an empty table gives no rows; other columns are not read.
    """
    pages = pages.select("page_id", "url", "html")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = written(rules_by_host(urls.select("host").distinct(), rule_table(pages.sparkSession, rules)), "host_rules")
    ruled = judged_by_rule(urls, own)

    def share(blocks: bool) -> Column:
        return F.expr(f"(CAST(count_if(hit.blocks = {blocks}) AS DECIMAL(19, 0)) * {UNIT}) div CAST(count(*) AS DECIMAL(19, 0))")

    shares = ruled.where("host <> ''").groupBy("host").agg(share(False).alias("trust"), share(True).alias("distrust"))
    seeds = shares.unpivot("host", ["trust", "distrust"], "kind", "score").select("kind", "host", "score")
    scores = propagate(seeds, written(host_links(pages), "links"))
    by_host = scores.groupBy("host").agg(*(
        F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0)).alias(k) for k in ("trust", "distrust")))
    out = ruled.join(written(by_host, "host_scores"), "host", "left")
    trust, distrust = (F.coalesce(F.col(k), F.lit(0)) for k in ("trust", "distrust"))
    blocked = F.coalesce(F.col("hit.blocks"), (distrust > trust) & (distrust >= int(THRESHOLD * UNIT)))
    return out.select(
        F.col("page_id").cast("long").alias("page_id"), "host", "path", F.col("hit.rule").alias("rule"),
        F.when(blocked, "block").otherwise("allow").alias("verdict"),
        (trust / UNIT).alias("trust"), (distrust / UNIT).alias("distrust"))


ORACLE = rf"""
WITH RECURSIVE
urls AS (
    SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(action, rule, rule_host, rule_path) AS (VALUES
    {", ".join(f"('{a}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for a, r in RULES)}),
ruled AS (
    SELECT u.page_id, u.host, u.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
    FROM (SELECT row_number() OVER () AS row_no, page_id, host, path FROM urls) u
    LEFT JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path)
    GROUP BY u.row_no, u.page_id, u.host, u.path),
targets AS (
    SELECT host AS source, unnest(list_distinct(regexp_extract_all(html,
        '{LINK.replace("'", "''")}', 1))) AS target
    FROM urls),
links AS (
    SELECT source, translate(target, '{UPPER}', '{LOWER}') AS target, count(*) AS n FROM targets
    WHERE source <> '' AND source <> translate(target, '{UPPER}', '{LOWER}') GROUP BY 1, 2),
arcs AS (
    SELECT kind, source, target, n, sum(n) OVER (PARTITION BY kind, source)::HUGEINT AS total
    FROM (SELECT 'trust' AS kind, source, target, n FROM links UNION ALL SELECT 'distrust', target, source, n FROM links)),
seeds AS (
    SELECT host, count(*) FILTER (WHERE action = 'allow') * {UNIT} // count(*) AS trust,
        count(*) FILTER (WHERE action = 'block') * {UNIT} // count(*) AS distrust
    FROM ruled WHERE host <> '' GROUP BY host),
flow(k, kind, host, score) AS (
    SELECT 0, 'trust', host, trust::HUGEINT FROM seeds WHERE trust > 0
    UNION ALL SELECT 0, 'distrust', host, distrust::HUGEINT FROM seeds WHERE distrust > 0
    UNION ALL
    SELECT any_value(k) + 1, f.kind, target, sum(score * {DAMPING_PERCENT} * n // (100 * total))::HUGEINT FROM flow f
    JOIN arcs a ON a.kind = f.kind AND a.source = f.host WHERE k < {ROUNDS}
    GROUP BY f.kind, target HAVING sum(score * {DAMPING_PERCENT} * n // (100 * total)) > 0),
scores AS (
    SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0)::BIGINT AS trust,
        coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0)::BIGINT AS distrust FROM flow GROUP BY host)
SELECT page_id, host, path, rule,
    coalesce(action, CASE WHEN distrust > trust AND distrust >= {int(THRESHOLD * UNIT)} THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(trust, 0) / {UNIT}.0::DOUBLE AS trust, coalesce(distrust, 0) / {UNIT}.0::DOUBLE AS distrust
FROM ruled LEFT JOIN scores USING (host)
"""
