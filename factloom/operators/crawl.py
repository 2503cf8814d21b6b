"""Crawl bookkeeping over stored captures: links, their scores, the frontier, duplicate captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.dom import tagged
from factloom.functions.urls import absolute_url, canonical_url, tracking_key, url_host
from factloom.sources.captures import BLOCKING
from factloom.sources.tables import materialize

#: Words and path endings that count for links.
HINT_WORDS = ("pricing", "about", "plans", "faq")
NO_PAGES = r"(?i)\.(pdf|jpg|png|css|js|zip)$"


def link_score(url: Column, hints: Sequence[str] = ()) -> Column:
    """Ten for each hint in the URL, two for each word that promises facts."""
    low, score = F.lower(url), F.lit(0)
    for points, words in ((10, [h.lower() for h in hints]), (2, HINT_WORDS)):
        for w in words:
            score = score + F.when(low.contains(w), points).otherwise(0)
    return score


def links(pages: DataFrame, allowed: Sequence[str] | None = None, hints: Sequence[str] = ()) -> DataFrame:
    """(page_key, url, pos, score, rank): canonical links of each page to allowed hosts (its own, if none are named),
    each once, in the order of rank: score descending, then the first place."""
    anchors = tagged(F.col("nodes"), ("a",), lambda n: n["attrs"]["href"].isNotNull())
    rows = pages.select("page_key", F.col("url").alias("page_url"), F.inline(F.transform(anchors, lambda n: F.struct(n["node_id"].alias("node_id"), n["attrs"]["href"].alias("href")))))
    rows = rows.withColumn("url", absolute_url("page_url", "href")).where("url is not null")
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    host = url_host("url")
    inside = host.isin(*allowed) if allowed is not None else host == url_host(canonical_url("page_url"))
    found = rows.where(inside & ~path.rlike(NO_PAGES)).groupBy("page_key", "url").agg(F.min("node_id").alias("pos")).withColumn("score", link_score(F.col("url"), hints))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("page_key").orderBy(F.desc("score"), "pos")))


def duplicate_captures(fetched: DataFrame) -> DataFrame:
    """fetched (job_id, fetch_seq, url, snapshot_hash) with status: a later fetch of the same bytes under the same
    tracking-insensitive URL in a job is a duplicate; it gives evidence but no links."""
    key = fetched.withColumn("tracking_key", tracking_key("url"))
    again = F.row_number().over(Window.partitionBy("job_id", "tracking_key", "snapshot_hash").orderBy("fetch_seq")) > 1
    return key.withColumn("status", F.when(again, "duplicate").otherwise("fetched"))


def frontier(seeds: DataFrame, edges: DataFrame, outcomes: DataFrame, max_depth: int = 1, max_pages: int = 3) -> DataFrame:
    """(job_id, url, depth, visit_seq, error): the pages a breadth-first crawl attempts, replayed on stored links.

    seeds (job_id, url); edges (url, target, rank); outcomes (url, error; null if fetched). Depth is small, so the
    loop runs max_depth joins; each level is written before the next. Attempts count against max_pages whether
    they succeed or not; the first access-denying outcome ends a job.
    """
    visit = Window.partitionBy("job_id").orderBy("depth", "parent_seq", "rank", "url")
    level = seeds.select("job_id", canonical_url("url").alias("url"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("parent_seq"), F.lit(0).alias("rank")).where("url is not null")
    done: DataFrame | None = None
    for depth in range(max_depth + 1):
        level = level.groupBy("job_id", "url").agg(F.min(F.struct("depth", "parent_seq", "rank")).alias("s")).select("job_id", "url", "s.*")
        if done is not None:
            level = level.join(done.select("job_id", "url"), ["job_id", "url"], "left_anti")
        before = done.groupBy("job_id").agg(F.max("visit_seq").alias("base"), F.bool_or(F.coalesce(F.col("error").isin(*BLOCKING), F.lit(False))).alias("ended")) if done is not None else None
        if before is not None:
            level = level.join(before, "job_id").where("not ended")
        else:
            level = level.withColumn("base", F.lit(0).cast("bigint"))
        level = level.withColumn("visit_seq", F.col("base") + F.row_number().over(visit)).where(F.col("visit_seq") <= max_pages).drop("base", "ended")
        level = level.join(outcomes, "url", "left")
        stop = F.max(F.when(F.col("error").isin(*BLOCKING), 1).otherwise(0)).over(Window.partitionBy("job_id").orderBy("visit_seq").rowsBetween(Window.unboundedPreceding, -1))
        level = materialize(level.withColumn("stop", F.coalesce(stop, F.lit(0))).where("stop = 0").select("job_id", "url", "depth", "visit_seq", "error"), "frontier")
        done = level if done is None else done.unionByName(level)
        if depth == max_depth:
            break
        grown = level.where("error is null").join(edges, "url")
        level = grown.select("job_id", F.col("target").alias("url"), F.lit(depth + 1).alias("depth"), F.col("visit_seq").alias("parent_seq"), "rank")
    return done
