"""URL filters: rules by host and path, and trust and distrust that spread over the graph of hosts, in DataFrame expressions.

Hosts of which rules allow a page are trusted seeds (where there are none, those of which rules block no page), hosts of which rules
block more than half are blocked seeds.
Personalised PageRank carries trust along links and distrust against them; a host with more distrust than trust is blocked.
Links are the hosts that pages name in href and src, and those of each host with the host one label above it, if it has pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: (verdict, host, path); a rule fits its host and all subdomains, where the url's path starts with its path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: ROUNDS is what op10's SQL fixes; elsewhere ranks are settled to TOLERANCE, or refused after MOST_ROUNDS.
ROUNDS, WRITE_EACH, DAMPING, MOST_DISTRUST = 8, 4, 0.85, 0.5
TOLERANCE, MOST_ROUNDS = 1e-4, 1000
#: A host with over this share of all pages is common (so there are 1 / HOT_SHARE such hosts at most); its pages are dealt to
#: SALTS tasks in joins by host.
HOT_SHARE, SALTS = 1 / 1000, 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


_FITTING = "array<struct<size:int,path:string,rule:string,verdict:string>>"


def _rules_of(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules array<struct<size, path, rule, verdict>>) of the hosts that a rule's host or a subdomain of it is."""
    labels = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1
    depths = sorted(r[0] for r in rules.select(labels(F.col("host"))).distinct().collect())  # numbers of labels
    if not depths:
        return hosts.where("false").select("host", F.lit(None).cast(_FITTING).alias("rules"))
    # Of a host's suffixes only those as long as some rule's host are made, however many labels it has.
    suffixes = F.array_compact(F.array(*(F.when(labels(F.col("host")) >= k, F.substring_index("host", ".", -k)) for k in depths)))
    ends = hosts.select("host", F.explode(suffixes).alias("suffix"))
    named = rules.select(F.col("host").alias("suffix"), F.struct(F.length(F.concat("host", "path")).alias("size"), F.col("path"), F.concat("host", "path").alias("rule"), F.col("verdict")).alias("r"))
    return ends.join(named, "suffix").groupBy("host").agg(F.collect_list("r").alias("rules"))


def common_hosts(pages: DataFrame) -> DataFrame:
    """The hosts with over HOT_SHARE of pages: a thousand at most."""
    counts = pages.groupBy("host").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > HOT_SHARE * pages.count()).select("host", F.lit(True).alias("common"))


def joined_by_host(pages: DataFrame, hosts: DataFrame, common: DataFrame) -> DataFrame:
    """pages left joined with hosts (a row per host) on host: rows of common hosts meet a copy of their host's row in SALTS
    places."""
    few = F.broadcast(common)  # bounded by 1 / HOT_SHARE rows
    dealt = pages.join(few, "host", "left").withColumn("salt", F.when(F.col("common"), F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS))).otherwise(0)).drop("common")
    copies = F.when(F.col("common"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(hosts.join(few, "host", "left").withColumn("salt", F.explode(copies)).drop("common"), ["host", "salt"], "left").drop("salt")


def judged_by_rules(pages: DataFrame, rules: DataFrame, common: DataFrame) -> DataFrame:
    """pages (with host, path) with rule and its verdict, null where none fits; of those that fit, the longest."""
    known = _rules_of(pages.select("host").distinct(), rules)
    best = F.array_max(F.filter(F.coalesce("rules", F.array().cast(_FITTING)), lambda r: F.startswith(F.col("path"), r["path"])))
    return joined_by_host(pages, known, common).withColumn("best", best).select(*pages.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, n): links of pages (with host, html) to other hosts, summed before they are shuffled; and one both ways
    between a host and the host one label above it, if both are in hosts."""
    named = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"), F.lit(1))).alias("dst"))
    links = named.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    parent = F.regexp_extract("host", r"^[^.]*\.(.+)$", 1)
    up = hosts.select(F.col("host").alias("src"), parent.alias("dst")).join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst")
    return links.unionByName(up.withColumn("n", F.lit(1.0))).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("n"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def _settled(before: DataFrame, rank: DataFrame) -> bool:
    """No host is new and no rank has changed by over TOLERANCE of itself."""
    old = before.withColumnRenamed("r", "old")
    moved = rank.join(old, ["kind", "host"], "left").where(F.col("old").isNull() | (F.abs(F.col("r") - F.col("old")) > TOLERANCE * F.col("r")))
    return moved.isEmpty()


def spread(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of seeds (host, trust, distrust; each summing up to 1 or 0): PageRank with the seeds as
    teleport, trust along edges and distrust against them. A round is a join and an aggregation of hosts' edges. Without rounds
    it goes on until the ranks are settled, and fails if MOST_ROUNDS don't settle them."""
    one_way = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = one_way.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    weighted = written(one_way.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("w")), "host-edges")
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "s")).where("s > 0")
    start = written(start, "host-seeds")
    rank = before = start.withColumnRenamed("s", "r")
    for k in range(MOST_ROUNDS if rounds is None else rounds):
        sent = rank.withColumnRenamed("host", "src").join(weighted, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("r") * F.col("w")).alias("r"))
        rank = sent.unionByName(start.select("kind", "host", ((1 - damping) * F.col("s")).alias("r"))).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if k % WRITE_EACH == WRITE_EACH - 1:
            rank = written(rank, "host-ranks")
            if rounds is None and _settled(before, rank):
                break
            before = rank
    else:
        if rounds is None:
            raise RuntimeError(f"ranks did not settle in {MOST_ROUNDS} rounds")
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(part("trust"), part("distrust"))


def judged(pages: DataFrame, rules: DataFrame, rounds: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), a row for each of pages (page_id, url, html). A null url has
    an empty host and path. A page under no rule is blocked if its host has more distrust than trust (their share over
    MOST_DISTRUST), else allowed, also where nothing reaches its host."""
    cut = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    common = written(common_hosts(cut), "common-hosts")
    ruled = written(judged_by_rules(cut, rules, common), "ruled-pages")
    hosts = ruled.groupBy("host").agg(F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("allowed"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("blocked"), F.count("*").alias("n"))
    hosts = written(hosts.where("host != ''"), "hosts")
    any_allowed = not hosts.where("allowed > 0").isEmpty()
    trusted = F.col("allowed") > 0 if any_allowed else F.col("blocked") == 0
    share = hosts.select("host", trusted.cast("double").alias("a"), (2 * F.col("blocked") > F.col("n")).cast("double").alias("b"))
    all_a, all_b = (x or 0.0 for x in share.agg(F.sum("a"), F.sum("b")).first())
    seeds = share.select("host", (F.col("a") / max(all_a, 1.0)).alias("trust"), (F.col("b") / max(all_b, 1.0)).alias("distrust"))
    edges = host_edges(pages.select(host(F.col("url")).alias("host"), "html"), hosts)
    scores = spread(edges, seeds, rounds)
    bad = F.col("distrust") > F.lit(MOST_DISTRUST) * (F.col("trust") + F.col("distrust"))
    verdict = F.coalesce("ruled", F.when(bad, "block").otherwise("allow"))
    joined = joined_by_host(ruled, scores, common).withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    lines = [f"select '{v}' as verdict, '{h}' as host, '{p}' as path" for v, h, p in rules]
    return reduce(DataFrame.unionByName, map(spark.sql, lines))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of pages its host, path, rule and verdict, with the host's trust and distrust after ROUNDS rounds. Null urls have
    an empty host and path and are allowed; repeated and null ids have a row each; an empty table gives none."""
    out = judged(table(spark, sf_dir, "pages"), rules_table(spark), ROUNDS)  # its SQL fixes the rounds
    return out.withColumns({k: F.round(k, 9) for k in ("trust", "distrust")})


def _sql(rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """The same for DuckDB, each round a table of its own."""
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    steps, last = [], "start"
    for k in range(rounds):
        steps.append(f"""r{k} AS (SELECT kind, host, sum(r) AS r FROM (SELECT kind, w.dst AS host, {damping} * r * w AS r FROM {last} JOIN w ON w.kind = {last}.kind AND w.src = {last}.host
            UNION ALL SELECT kind, host, {1 - damping} * s FROM seeds) GROUP BY kind, host)""".replace("SELECT kind, w.dst", "SELECT w.kind, w.dst"))
        last = f"r{k}"
    return f"""WITH rules(verdict, host, path) AS (VALUES {rows}),
    p AS (SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    fits AS (SELECT page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC) AS k FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
    ruled AS (SELECT p.page_id, p.host, p.path, rule, verdict FROM p LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (page_id)),
    v AS (SELECT host, count(*) FILTER (verdict = 'allow') AS n_allow, count(*) FILTER (verdict = 'block') AS n_block, count(*) AS n FROM ruled WHERE host <> '' GROUP BY host),
    h AS (SELECT host, CASE WHEN max(n_allow) OVER () > 0 THEN n_allow > 0 ELSE n_block = 0 END AS a, 2 * n_block > n AS b FROM v),
    links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s>]+)', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM p),
    up AS (SELECT h.host AS src, q.host AS dst FROM h JOIN h q ON q.host = regexp_extract(h.host, '^[^.]*\\.(.+)$', 1)),
    e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS n FROM (SELECT src, dst FROM links WHERE src <> dst AND src <> '' AND dst <> '' UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up) GROUP BY src, dst),
    both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
    w AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS w FROM both_ways),
    seeds AS (SELECT 'trust' AS kind, host, CAST(1 AS DOUBLE) / (SELECT count(*) FROM h WHERE a) AS s FROM h WHERE a UNION ALL SELECT 'distrust', host, CAST(1 AS DOUBLE) / (SELECT count(*) FROM h WHERE b) FROM h WHERE b),
    start AS (SELECT kind, host, s AS r FROM seeds), {", ".join(steps)},
    sc AS (SELECT host, coalesce(sum(r) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(r) FILTER (kind = 'distrust'), 0) AS distrust FROM {last} GROUP BY host)
    SELECT page_id, ruled.host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > {MOST_DISTRUST} * (coalesce(trust, 0) + coalesce(distrust, 0)) THEN 'block' ELSE 'allow' END) AS verdict,
        round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust FROM ruled LEFT JOIN sc ON sc.host = ruled.host"""


OP10_SQL = _sql()
