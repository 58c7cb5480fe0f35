"""URL filter: rules by host and path, then link-graph propagation for urls without a rule.

Host edges are the links from a page's host to the hosts of the absolute links in its HTML, counted once for each pair. Trust is personalised PageRank
from trusted seeds along the edges; distrust is personalised PageRank from blocked seeds against the edges (who links to blocked hosts is suspect).
Both are compared on each host: it is blocked if its distrust exceeds ``THRESHOLD`` times its trust plus a small share of an average host's
score. Seeds are the hosts most of whose pages an allow or a block rule decides, or those given.

Everything runs as DataFrame joins over host edges: edges are made distinct with map-side aggregation, and contributions are summed
before the shuffle, so a host with a third of all pages or links is an ordinary row. The loop ends once scores are settled to a thousandth of the share
that blocks a host, however long the ways from the seeds are; every round is a table in the shared checkpoint folder.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and verdict ``allow``, as no score speaks against it. Null html has
no links. Columns to keep that are named like the operator's own are an error. Repeated rows get equal results. With no seeds of a kind all its scores are 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.batches import checkpointed, refuse_names, remove_folder, shared_folder

#: (verdict, host, path) of the query's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
#: Scores are iterated until all of them together are within SETTLED of their limits (``host_scores``: within this part of the share that blocks a
#: host). Every round shrinks the distance by DAMPING, so ROUNDS is never reached but by a fault, and is an error.
ROUNDS, SETTLED, PRECISION = 400, 1e-6, 1e-3
THRESHOLD, FLOOR = 1.0, 0.05
#: Links of a source that are one part of its links.
SALT_LINKS = 100_000
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?is)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path as text) and its verdict; null without one."""
    rule = verdict = None
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between different hosts."""
    linked = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))
    links = pages.select(F.col("host").alias("src"), F.explode(linked).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").distinct()


def rank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, settled: float = SETTLED, folder: str | None = None) -> DataFrame:
    """Personalised PageRank: (host, score) from ``seeds`` (host, weight; weights sum to 1) along ``edges`` (src, dst).
    What hosts without links hold goes back to the seeds. The sum of all errors is at most ``settled``; scores that don't get there in
    ``rounds`` are an error.

    Edges are written once, in buckets by source and salt, a source having a salt for every ``SALT_LINKS`` links. A round shuffles the scores to them, one row for each source and salt,
    and the parts that are added up for each target; it writes one small table, reads one row of sums from it, and the table before the last is deleted."""
    spark = edges.sparkSession
    folder = folder or shared_folder(spark, "ranks")
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("links")).withColumn("salts", F.ceil(F.col("links") / F.lit(SALT_LINKS)).cast("int"))
    degrees.write.parquet(f"{folder}/degrees")
    degrees = spark.read.schema("src string, links bigint, salts int").parquet(f"{folder}/degrees")
    names = degrees.select(F.col("src").alias("s"), "links", "salts")
    weighed = edges.join(names, F.col("src") == F.col("s")).select("src", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"), "dst", (1.0 / F.col("links")).alias("part"))
    table = f"tarn_links_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    weighed.write.option("path", f"{folder}/links").bucketBy(buckets, "src", "salt").sortBy("src", "salt").saveAsTable(table)
    try:
        seeds.select("host", F.col("weight").alias("score")).write.parquet(f"{folder}/round-0")
        now = scores_at(spark, folder, 0)
        moved = passed_on(now, names)
        for i in range(1, rounds + 1):
            sends = now.join(names, F.col("host") == F.col("s")).select(F.col("s"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("t"), "score")
            met = spark.table(table).join(sends, (F.col("src") == F.col("s")) & (F.col("salt") == F.col("t")))
            sent = met.groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("score") * F.col("part")).alias("got"))
            back = 1 - damping * moved  # restarts, and the mass of hosts without links
            fresh = sent.join(seeds, F.col("to") == F.col("host"), "full").select(
                F.coalesce("to", "host").alias("host"), (damping * F.coalesce("got", F.lit(0.0)) + back * F.coalesce("weight", F.lit(0.0))).alias("score")
            )
            fresh.write.parquet(f"{folder}/round-{i}")
            fresh = scores_at(spark, folder, i)
            both = fresh.join(now.withColumnsRenamed({"host": "h", "score": "was"}), F.col("host") == F.col("h"), "full").join(names, F.col("host") == F.col("s"), "left")
            change = F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))
            change, moved = both.agg(change, F.coalesce(F.sum(F.when(F.col("s").isNotNull(), F.col("score"))), F.lit(0.0))).first()
            now = fresh
            if i > 1:
                remove_folder(spark, f"{folder}/round-{i - 2}")
            if not change or change * damping <= settled * (1 - damping):  # what all later rounds can still change
                return now
        raise RuntimeError(f"scores did not settle in {rounds} rounds")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove_folder(spark, f"{folder}/links")


def scores_at(spark: SparkSession, folder: str, i: int) -> DataFrame:
    return spark.read.schema("host string, score double").parquet(f"{folder}/round-{i}")


def passed_on(scores: DataFrame, names: DataFrame) -> float:
    """The score that hosts with links hold, all of which they pass on."""
    return scores.join(names, F.col("host") == F.col("s")).agg(F.sum("score")).first()[0] or 0.0


def host_scores(pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(host, pages, trust, distrust, host_verdict) for the hosts of ``pages`` (host, html, verdict of the rules)."""
    hosts = checkpointed(pages.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")))
    edges = checkpointed(host_edges(pages) if edges is None else edges)
    scores = hosts
    average = 1.0 / max(1, hosts.count())
    for name, count, direction in (("trust", "allowed", edges), ("distrust", "blocked", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))):
        chosen = hosts.where(F.col(count) * 2 > F.col("pages")).select("host")
        n = chosen.count()
        seeds = chosen.withColumn("weight", F.lit(1.0 / max(1, n)))
        score = rank(direction, seeds, settled=PRECISION * FLOOR * average).select(F.col("host").alias("h"), F.col("score").alias(name))
        scores = scores.join(score, F.col("host") == F.col("h"), "left").drop("h").withColumn(name, F.coalesce(name, F.lit(0.0)))
    bad = F.col("distrust") > THRESHOLD * F.col("trust") + FLOOR * average
    return scores.select("host", "pages", "trust", "distrust", F.when(bad, F.lit("block")).otherwise(F.lit("allow")).alias("host_verdict"))


def judge(df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, keep: tuple[str, ...] = ("page_id",), url: str = "url", html: str = "html") -> DataFrame:
    """The ``keep`` columns with host, path, rule, verdict, trust and distrust."""
    refuse_names(keep, {"host", "path", "html", "rule", "ruled", "verdict", "trust", "distrust", "host_verdict", "h", "pages"})
    parsed = df.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("ruled", ruled)
    joined = with_scores(parsed.drop("html"), host_scores(parsed))
    verdict = F.coalesce("ruled", "host_verdict", F.lit("allow"))
    return joined.select(*keep, "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def with_scores(pages: DataFrame, scores: DataFrame) -> DataFrame:
    """Pages with the scores of their host. Hosts with more than a hundredth of all pages are fewer than a hundred, so they are broadcast and their pages stay
    where they are; the pages of all other hosts meet their scores by host. Pages without a host meet nothing."""
    scores = checkpointed(scores.withColumnRenamed("host", "h"))
    total = scores.agg(F.sum("pages")).first()[0] or 0
    hot = F.broadcast(scores.where(F.col("pages") * 100 > total))
    none = [F.lit(None).cast("double").alias("trust"), F.lit(None).cast("double").alias("distrust"), F.lit(None).cast("string").alias("host_verdict")]
    same = F.col("host") == F.col("h")
    large = pages.join(hot, same).drop("h", "pages")
    small = pages.where("host <> ''").join(hot.select("h"), same, "left_anti").join(scores.where(F.col("pages") * 100 <= total), same, "left").drop("h", "pages")
    return large.unionByName(small).unionByName(pages.where("host = ''").select("*", *none))
