"""URL filter: rules first, then trust and distrust spread over the links between hosts.

Trust starts at hosts with allowed pages and follows links (personalised PageRank); distrust starts
at hosts with blocked pages and follows links backwards.  A page that no rule fits is blocked if
distrust holds more than `share` of what its host has of both.  All work is DataFrame
expressions; both walks go in one table, stored after each round.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and is
allowed; null html has no links; links within a host carry nothing, nor do those in comments and
scripts; of equally long rules that fit a blocking one counts; rows with null or repeated page_id
are judged like others; urls and pages may be of any length; an empty table gives no rows; further
columns are ignored.  The walks go on until their tolerance is met."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower, stored, table

SALTS = 16
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea)\b.*?(?:</\1\s*>|\z)"
ANCHOR = r"(?i)<a(?=\s)[^>]*?[\s\"'/]href\s*=\s*[\"']?([^\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def url_part(url: Column, group: int) -> Column:
    """1: host, 2: path; empty without `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", group)
    return ascii_lower(found) if group == 1 else found


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host and path.  Adds rule and ruling, of the longest rule that fits (of equally
    long ones a blocking one), or null."""
    rule = ruling = F.lit(None).cast("string")
    # the last to be wrapped around is asked first
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block")):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, ruling = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(ruling)
    return pages.withColumns({"rule": rule, "ruling": ruling})


def host_links(pages: DataFrame) -> DataFrame:
    """pages: host, html.  Rows (src, dst, n): links from pages of one host to another."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    # what a comment or a script holds is no link
    html = F.when(html.rlike(r"(?i)<!--|<script|<style|<textarea"), F.regexp_replace(html, HIDDEN, " ")).otherwise(html)
    refs = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    # most links stay within their site: only those with a host of their own leave the array
    away = F.filter(refs, lambda x: x.contains("//"))
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(away).alias("ref"))
    full = F.when(F.col("ref").startswith("//"), F.concat(F.lit("x:"), "ref")).otherwise(F.col("ref"))
    hosts = links.select("src", url_part(F.when(full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), full), 1).alias("dst"))
    return hosts.filter("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """links: src, dst, n; seeds: kind (trust or distrust), host, mass, of sum 1 for each kind.
    Rows (kind, host, score).  Ends at the tolerance, unless rounds are given and over first; each
    round moves 0.85 of the one before at most, so that 1e-4 takes no more than 66."""
    both = links.withColumn("kind", F.lit("trust")).unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("kind")))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    edges = stored(both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("part")), "host-edges")
    scores = seeds.select("kind", "host", F.col("mass").alias("score"))
    for _ in itertools.count() if rounds is None else range(rounds):
        moved = scores.join(edges, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("part")).alias("got"))
        # two rows: what each kind has left at hosts without links goes back to its seeds
        left = scores.groupBy("kind").agg(F.sum("score").alias("has")).join(moved.groupBy("kind").agg(F.sum("got").alias("went")), "kind", "left")
        left = left.select("kind", (F.col("has") - F.coalesce("went", F.lit(0.0))).alias("lost"))
        all_ = seeds.join(moved, ["kind", "host"], "full").join(F.broadcast(left), "kind").join(scores, ["kind", "host"], "left")
        mass = F.coalesce("mass", F.lit(0.0))
        new = F.lit(1 - damping) * mass + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * mass)
        step = stored(all_.select("kind", "host", new.alias("score"), F.abs(new - F.coalesce("score", F.lit(0.0))).alias("moved")), "host-scores")
        scores = step.select("kind", "host", "score")
        if (step.agg(F.sum("moved")).first()[0] or 0.0) < tolerance:
            break
    return scores


def judge_urls(pages: DataFrame, rules=RULES, share: float = 0.5) -> DataFrame:
    """pages: page_id, url, html.  Rows (page_id, host, path, rule, verdict)."""
    url = F.col("url").cast("string")
    parts = pages.select("page_id", url_part(url, 1).alias("host"), url_part(url, 2).alias("path"), "html")
    rows = ruled(parts.drop("html"), rules)
    counts = rows.filter("ruling IS NOT NULL").groupBy(F.when(F.col("ruling") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    total = counts.groupBy("kind").agg(F.sum("n").alias("total"))  # two rows
    seeds = stored(counts.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("mass")), "seeds")
    scores = spread(stored(host_links(parts), "host-links"), seeds)
    held = scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("bad"), F.sum("score").alias("both"))
    blocked = stored(held.filter(F.col("bad") > share * F.col("both")).select("host"), "blocked-hosts")
    # a host may have most pages: its rows meet the verdict over salted keys
    salted = blocked.select(F.col("host").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    asked = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    met = asked.join(salted, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")), "left")
    verdict = F.coalesce("ruling", F.when(F.col("h").isNotNull(), "block").otherwise("allow"))
    return met.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
