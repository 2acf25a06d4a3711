"""URL filters: rules first, then trust and distrust spread over the link graph of hosts (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_stage, meet, stage

#: (rule, verdict): host and path in one text.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Part of a host's rank that its links hand on, change of every host's rank below which the rounds end, and how far
#: distrust must exceed trust before a host is blocked, in units of a host whose pages are all seeds.
DAMPING, SETTLED, MARGIN = 0.85, 1e-6, 0.5
#: Links of one host that meet its score in one task; those of a host with more are dealt over several.
LINKS = 65_536
#: The value of a link, and of the base that relative links are resolved against.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*([^"'\s<>]+)"""
BASE = r"""(?i)<base\b[^<>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
#: The host of a link that names one; any other link with a scheme (mail, script, data) leads to no host.
NAMED, SCHEME = "^(?i)(?:[a-z][a-z0-9+.-]*:)?//([^/?#]+)", "^(?i)[a-z][a-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a domain above it and whose path begins the url's."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule)).otherwise(out)
    return out


def link_hosts(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts of ``pages(host, html)``; relative links lead to the page's
    base, or without one to its own host."""
    base = ascii_lower(F.regexp_extract("html", BASE, 1))
    rows = pages.where("host <> ''").select(F.col("host").alias("src"), F.when(base == "", F.col("host")).otherwise(base).alias("base"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    named = ascii_lower(F.regexp_extract("link", NAMED, 1))
    dst = F.when(named != "", named).when(~F.col("link").rlike(SCHEME), F.col("base"))
    return rows.select("src", dst.alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED, most: int = LINKS) -> DataFrame:
    """Personalised PageRank of each kind: ``host, kind, score``.

    ``links(src, dst, kind, n)``; ``seeds(host, kind, seed)``.  In each round a host keeps nothing: it hands ``damping`` of its
    score on along its links by their number, and the rest, like all of a host without links, teleports to the
    seeds by their size.  So a kind's scores always add up to its seeds, and without links they are the seeds.
    Rounds end when no score changes by ``settled`` or more; the change shrinks by ``damping`` or more in each.
    A round is a join and a grouped sum, written out so that lineage stays short.  The links of a host that has more than
    ``most`` lie in as many parts as they fill, each of which meets a copy of its score; what a host gets is summed before it moves.
    """
    out = stage(links.groupBy("src", "kind").agg(F.sum("n").alias("out"), F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / most).cast("int")), "out")
    shared = meet(links.withColumnRenamed("n", "times"), out, ["src", "kind"], ["dst"])
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")
    edges = stage(shared.select("src", "dst", "kind", part.alias("part"), (F.col("times") / F.col("out")).alias("w")), "edges")
    begin = seeds.select("host", "kind", F.col("seed").alias("score"))
    if not edges.take(1):
        return begin
    ends = out.select(F.col("src").alias("host"), "kind", F.lit(0.0).alias("seed"), "parts").unionByName(edges.select(F.col("dst").alias("host"), "kind", F.lit(0.0).alias("seed"), F.lit(0).alias("parts")))
    nodes = seeds.select("host", "kind", "seed", F.lit(0).alias("parts")).unionByName(ends)
    nodes = stage(nodes.groupBy("host", "kind").agg(F.sum("seed").alias("seed"), F.max("parts").alias("parts")), "nodes")
    rank = nodes.withColumn("score", F.col("seed"))

    def sums(df: DataFrame) -> dict:
        return {r["kind"]: (r["idle"], r["seed"]) for r in df.groupBy("kind").agg(F.sum(F.when(F.col("parts") == 0, F.col("score")).otherwise(0.0)).alias("idle"), F.sum("seed").alias("seed")).collect()}

    now = sums(rank)
    while True:
        copies = rank.where("parts > 0").select(F.col("host").alias("src"), "kind", "score", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        moved = edges.join(copies, ["src", "kind", "part"]).groupBy(F.col("dst").alias("host"), "kind").agg(F.sum(F.col("w") * F.col("score")).alias("got"))
        back = F.lit(0.0)
        for kind, (idle, seed) in now.items():  # the two kinds
            back = F.when(F.col("kind") == kind, F.col("seed") * (idle / seed if seed else 0.0)).otherwise(back)
        score = (1 - damping) * F.col("seed") + damping * (F.coalesce("got", F.lit(0.0)) + back)
        new = stage(rank.withColumnRenamed("score", "was").join(moved, ["host", "kind"], "left").select("host", "kind", "seed", "parts", "was", score.alias("score")), "rank")
        change = new.agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0]
        drop_stage(rank)
        rank, now = new.drop("was"), sums(new)
        if change < settled:
            return rank.select("host", "kind", "score")


def judge_urls(pages: DataFrame, rules=RULES, settled: float = SETTLED, most: int = LINKS) -> DataFrame:
    """The verdict on every row of ``pages(page_id, url, html)``.

    A rule decides where one fits.  Otherwise the host does: its trust starts from the part of its pages that rules
    allow and flows along links to other hosts; its distrust starts from the part that rules block and
    flows backwards, to the hosts that link there, as ``spread`` says.  It is blocked if distrust exceeds trust by MARGIN.

    Returns ``page_id, host, path, rule, verdict, trust, distrust``.  Null urls and those without
    ``://`` have empty host and path, no rule, and are allowed; null html has no links; repeated
    rows get equal results and each counts; extra columns are not read; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    judged = rows.withColumn("verdict", verdict)

    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    hosts = stage(hosts, "hosts")
    kinds = F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("seed")))
    seeds = hosts.where("host <> ''").select("host", F.explode(kinds).alias("s")).select("host", "s.kind", "s.seed")
    links = stage(link_hosts(rows), "links")
    ways = links.select(F.explode(F.array(F.struct("src", "dst", F.lit("trust").alias("kind"), "n"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("distrust").alias("kind"), F.col("n")))).alias("e")).select("e.*")

    rank = spread(ways, seeds, settled=settled, most=most)
    scores = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))
    # every host that has pages, once, with their number, so that the pages of a large one can be dealt
    scores = stage(hosts.select("host", "n").join(scores, "host", "left"), "scores")
    out = meet(judged.drop("html"), scores, ["host"], ["page_id", "path"])
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust - trust >= MARGIN, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
