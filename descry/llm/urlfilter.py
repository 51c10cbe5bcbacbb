"""URL filters: host and path rules, and link-graph propagation for the hosts that no rule decides.

The longest rule that fits a url decides. For the rest, hosts are ranked twice over the link graph between hosts: by
personalised PageRank from trusted seeds along links, and by the same walk against the links from blocked seeds, so that
who links to blocked hosts is distrusted. A host's seed weights are the shares of its urls that the rules allow and block.
A host is blocked if its distrust is above `balance` times its trust; a host that neither walk reaches is allowed. Walks go on until they
settle within a tolerance, and hosts whose two ranks are closer than that are allowed.

A null url, or one without `://`, has an empty host and path, fits no rule and is allowed unless its (empty) host is
distrusted. Null pages have no links. Repeated rows are judged alike; each counts as one url of its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copies of each host's row, so that a host with a third of all urls is joined in as many tasks.
SALT = 8
#: The share of a host's rank that follows its links, and the move of a rank (a seed with only ruled urls weighs 1) at which a walk has settled.
DAMPING, TOLERANCE = 0.85, 1e-7


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host + path) that fits, or null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones, the longer, are asked first
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: list[tuple[str, str]]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for verdict, name in rules for x in (name, verdict)]), rule) if rules else F.lit(None).cast("string")


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n): links from host to host; relative links stay on their host and are no edge."""
    href = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    full = F.transform(href, lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u)))
    out = pages.select(F.col("host").alias("src"), F.explode(F.filter(full, lambda h: h != "")).alias("dst"))
    return out.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def walk(edges: DataFrame, seeds: DataFrame, src: str, dst: str, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank) of personalised PageRank from `seeds` (host, weight) along src -> dst; a dead end's rank starts again from the seeds.

    Rounds go on until no host's rank moves by more than `tolerance`, so that what is left is below tolerance x damping / (1 - damping) for each
    host, then ranks are scaled to the seeds' sum. A round moves the ranks by one join and one aggregation, which also finds the largest move.
    """
    out = edges.groupBy(src).agg(F.sum("n").alias("total"))
    share = cut(edges.join(out, src).select(F.col(src).alias("a"), F.col(dst).alias("b"), (F.col("n") / F.col("total")).alias("p")))
    start = cut(seeds.select("host", ((1 - damping) * F.col("weight")).alias("rank")))
    rank = start.select("host", "rank", F.col("rank").alias("move"))
    nothing = F.lit(0.0)
    while True:
        moved = share.join(rank, share["a"] == rank["host"]).groupBy("b").agg((damping * F.sum(F.col("p") * F.col("rank"))).alias("rank")).select(F.col("b").alias("host"), "rank", nothing.alias("was"))
        rows = moved.unionByName(start.select("host", "rank", nothing.alias("was"))).unionByName(
            rank.select("host", nothing.alias("rank"), F.col("rank").alias("was"))
        )
        rank = cut(
            rows.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")).select(
                "host", "rank", F.abs(F.col("rank") - F.col("was")).alias("move"),
            )
        )
        if (rank.agg(F.max("move")).first()[0] or 0.0) <= tolerance:
            break
    both = rank.agg(F.sum("rank")).first()[0], seeds.agg(F.sum("weight")).first()[0]
    return rank.select("host", (F.col("rank") * F.lit((both[1] or 0.0) / (both[0] or 1.0))).alias("rank"))


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], damping: float = DAMPING, balance: float = 1.0, tolerance: float = TOLERANCE,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for every row."""
    url = F.col(url_col)
    seen = pages.select(
        F.col(id_col).alias("_id"), F.col(html_col).alias("_html"), host_of(url).alias("host"), path_of(url).alias("path"),
    ).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    urls = seen.drop("_html").withColumn("ruled", verdict_of(F.col("rule"), rules))
    n = F.count("*")
    hosts = cut(urls.groupBy("host").agg((F.count_if(F.col("ruled") == "allow") / n).alias("good"), (F.count_if(F.col("ruled") == "block") / n).alias("bad")))
    edges = cut(host_edges(seen, "_html"))
    linked = not edges.isEmpty()
    scored = hosts.select("host")
    for column, name, src, dst in (("good", "trust", "src", "dst"), ("bad", "distrust", "dst", "src")):
        seeds = hosts.where(F.col(column) > 0).select("host", F.col(column).alias("weight"))
        found = walk(edges, seeds, src, dst, damping, tolerance) if linked and not seeds.isEmpty() else seeds.withColumnRenamed("weight", "rank")
        scored = scored.join(found.withColumnRenamed("rank", name), "host", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    salted = scored.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    salt = F.pmod(F.xxhash64("_id", "path"), F.lit(SALT)).cast("int")
    # what the walks leave undecided counts as equal
    by_host = F.when(F.col("distrust") - balance * F.col("trust") > tolerance / (1 - damping) ** 2, "block").otherwise("allow")
    return urls.withColumn("_salt", salt).join(salted, ["host", "_salt"]).select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust",
    )
