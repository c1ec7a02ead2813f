"""Operator 5: URL filters by a path-template tree.

Rules decide first: the longest rule whose host and path fit. What no rule
covers is judged by templates learned from the urls that rules do cover. Each
host has a tree of path segments; digits become a mark, and a place with many
different children holds a wildcard instead. Level by level, sibling branches
whose labelled purities don't differ significantly are merged. The purity of a
template is smoothed: a branch draws on the place above it as if that had ``PRIOR``
urls, this on the one above, the host on all labelled urls. So a branch without
labels has the purity of what it hangs on. Templates under ``REJECT_BELOW`` are
rejected.

Everything is aggregated: a url is reduced to (host, segments) and counted before
any shuffle of its host, parents are counted per level and joined back, and no
host's urls are gathered in one task. A place under which one path is left needs no
further level, so there are as many levels as the longest beginning that different
paths share.

Defined cases: null urls and urls without :// have an empty host and path and are
judged as any other; without labelled urls all are allowed; a purity at the limit
is allowed; of rules of equal length the first by host and path counts; very long
urls are followed to their last segment; empty tables give empty results; equal
rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A place is variable from this many children on, if they have fewer than two urls each.
VARIABLE_CHILDREN = 10
#: Branches merge unless they differ by this many standard errors.
DIFFER = 1.96
#: Urls' worth of belief in what a branch hangs on, and the purity under which a template is rejected.
PRIOR, REJECT_BELOW = 4.0, 0.25

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD = "*"


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null and where :// is missing."""
    host, path = (F.coalesce(F.regexp_extract(url, _URL, i), F.lit("")) for i in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text of the longest rule that fits, and its verdict; null without one."""
    text = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if text is None else (text, verdict)


def segments(path: Column) -> Column:
    """The segments of a path with digits generalised."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("#")).otherwise(F.regexp_replace(s, "[0-9]+", "#")))


_SUMS = ("n", "labelled", "good")


def _smoothed(above: Column | float) -> Column:
    return (F.col("good") + F.lit(PRIOR) * above) / (F.col("labelled") + F.lit(PRIOR))


def templates(urls: DataFrame) -> DataFrame:
    """(host, segments, template, purity) of distinct urls (host, segments, n, labelled, good).

    A template ends in an empty segment where a path ends at a place that has
    others below it.
    """
    urls = materialize(urls, "urls")
    total = urls.agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good")).first()
    pool = total["good"] / total["labelled"] if total["labelled"] else 1.0
    hosts = urls.groupBy("host").agg(*[F.sum(c).alias(c) for c in _SUMS]).select("host", _smoothed(F.lit(pool)).alias("purity"))
    open_, done = urls.withColumn("template", F.array().cast("array<string>")).join(hosts, "host"), []
    place = ["host", "template"]
    while True:
        level = len(done)
        open_ = materialize(open_, f"urls{level}")
        s = F.coalesce(F.try_element_at("segments", F.lit(level + 1)), F.lit(""))
        leaves = open_.withColumn("s", s)
        children = leaves.groupBy(*place, "s").agg(F.count("n").alias("paths"), *[F.sum(c).alias(c) for c in _SUMS])
        whole = children.groupBy(*place).agg(F.sum("paths").alias("paths"), F.count_if(F.col("s") != "").alias("kinds"), *[F.sum(c).alias(f"all_{c}") for c in _SUMS])
        # A branch joins the wildcard if the place is variable, or if it is labelled and doesn't stand out from its siblings.
        near = children.drop("paths").join(whole, place)
        rest_n, rest_good = F.col("all_labelled") - F.col("labelled"), F.col("all_good") - F.col("good")
        pooled = F.col("all_good") / F.greatest(F.col("all_labelled"), F.lit(1))
        gap = F.col("good") / F.greatest(F.col("labelled"), F.lit(1)) - rest_good / F.greatest(rest_n, F.lit(1))
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(F.col("labelled"), F.lit(1)) + 1 / F.greatest(rest_n, F.lit(1))))
        alike = (F.col("labelled") > 0) & (rest_n > 0) & (F.abs(gap) <= F.lit(DIFFER) * error)
        variable = (F.col("kinds") >= VARIABLE_CHILDREN) & (F.col("kinds") * 2 > F.col("all_n"))
        named = near.select(*place, "s", "paths", *_SUMS, F.when(F.col("s") == "", "").when(variable | alike, WILD).otherwise(F.col("s")).alias("t"))
        sums = named.groupBy(*place, "t").agg(F.sum("labelled").alias("t_labelled"), F.sum("good").alias("t_good"))
        named = named.drop(*_SUMS).join(sums, [*place, "t"])
        down = leaves.join(named, [*place, "s"])
        purity = (F.col("t_good") + F.lit(PRIOR) * F.col("purity")) / (F.col("t_labelled") + F.lit(PRIOR))
        last = (F.col("paths") == 1) | (F.col("s") == "")
        rest = F.when(F.col("paths") == 1, F.slice("segments", F.lit(level + 1), F.greatest(F.size("segments"), F.lit(1)))).otherwise(F.array("t"))
        down = materialize(down.select("host", "segments", *_SUMS, F.concat("template", rest).alias("template"), purity.alias("purity"), last.alias("last")), f"down{level}")
        done.append(down.filter("last").select("host", "segments", "template", "purity"))
        open_ = down.filter("NOT last").drop("last")
        if open_.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and its template's purity where no rule decides."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), said.alias("said"), segments(F.col("path")).alias("segments"))
    counted = parsed.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "allow").alias("good"))
    known = templates(counted).select("host", "segments", "purity")
    ruled = parsed.filter("said IS NOT NULL").select("page_id", "host", "path", "rule", F.col("said").alias("verdict"), F.lit(None).cast("double").alias("purity"))
    others = parsed.filter("said IS NULL").join(known, ["host", "segments"])
    verdict = F.when(F.col("purity") < REJECT_BELOW, "block").otherwise("allow")
    return ruled.unionByName(others.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "purity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
