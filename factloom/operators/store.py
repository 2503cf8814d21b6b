"""The job store as tables: jobs, snapshots, metrics, retention, reviews. Tables are append-only logs; reads derive
the present state, and every read and delete is within a tenant."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.dom import source_nodes

#: States that are counted, days kept, and the bounds of a list of recent jobs.
STATES = ("verified", "conflicting", "missing", "blocked", "unverified")
DAYS_KEPT, DEFAULT_RECENT, MOST_RECENT = 7, 12, 50


@F.pandas_udf(T.StringType())
def request_hash(request_json: pd.Series) -> pd.Series:
    """SHA-256 of a request's JSON with sorted keys and the usual separators."""
    return request_json.map(lambda r: None if r is None else hashlib.sha256(json.dumps(json.loads(r), sort_keys=True).encode()).hexdigest())


def write_jobs(results: DataFrame, path: str) -> None:
    """Append job results, partitioned by tenant, so that a tenant's reads prune the rest."""
    results.write.mode("append").partitionBy("tenant").parquet(path)


def accepted_puts(puts: DataFrame, claims: DataFrame) -> DataFrame:
    """puts with accepted: whether the writer still holds the pending claim of that request; others have lost it."""
    held = claims.where("state = 'pending'").select("tenant", "idem", "request_hash", "owner", F.lit(True).alias("accepted"))
    out = puts.join(held, ["tenant", "idem", "request_hash", "owner"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    return out.withColumn("error", F.when(~F.col("accepted"), "CLAIM_LOST"))


def tenant_metrics(log: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
    """Cumulative counters for each tenant from the log of finished fields (tenant, job_id, pages_fetched, state).
    Deleting jobs does not lower them, so they come from the log and not from the jobs that are left."""
    jobs = log.groupBy("tenant", "job_id").agg(F.max("pages_fetched").alias("pages"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    out = jobs.groupBy("tenant").agg(F.count(F.lit(1)).alias("jobs"), F.sum("pages").alias("pages_fetched"), *[F.sum(s).alias(f"{s}_fields") for s in STATES])
    if tenants is None:
        return out
    names = [c for c in out.columns if c != "tenant"]
    return tenants.join(out, "tenant", "left").select("tenant", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def recent_jobs(jobs: DataFrame, limit: int = DEFAULT_RECENT) -> DataFrame:
    """The newest jobs of each tenant, 1 to 50 of them, ties by job_id."""
    k = min(max(limit, 1), MOST_RECENT)
    newest = Window.partitionBy("tenant").orderBy(F.desc("created_at"), "job_id")
    return jobs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k)


def kept(rows: DataFrame, now: Column, created: str = "created_at", days: int = DAYS_KEPT) -> DataFrame:
    """Rows not older than the retention."""
    return rows.where(F.col(created) >= now - F.make_dt_interval(F.lit(days)))


def purge(tables: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """What a purge leaves of jobs, claims and the tables that hang on jobs (tenant, job_id)."""
    jobs = kept(tables["jobs"], now)
    left = {"jobs": jobs}
    gone = tables["jobs"].join(jobs.select("tenant", "job_id"), ["tenant", "job_id"], "left_anti").select("tenant", "job_id")
    for name, rows in tables.items():
        if name == "claims":
            left[name] = kept(rows, now)
        elif name != "jobs":
            left[name] = rows.join(gone, ["tenant", "job_id"], "left_anti")
    return left


def deleted(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Tables without the jobs in doomed (tenant, job_id): claims go by their jobs' keys; metrics stay."""
    keys = tables["jobs"].join(doomed, ["tenant", "job_id"], "left_semi").select("tenant", "idem")
    return {name: rows if name == "metrics" else rows.join(keys, ["tenant", "idem"], "left_anti") if name == "claims" else rows.join(doomed, ["tenant", "job_id"], "left_anti") for name, rows in tables.items()}


def job(jobs: DataFrame, tenant: str, job_id: str) -> DataFrame:
    return jobs.where((F.col("tenant") == tenant) & (F.col("job_id") == job_id))


def job_by_key(jobs: DataFrame, tenant: str, idem: str) -> DataFrame:
    """The job that a tenant's request key led to."""
    return jobs.where((F.col("tenant") == tenant) & (F.col("idem") == idem))


def job_request(jobs: DataFrame, tenant: str, job_id: str) -> DataFrame:
    """The stored request of a job; none for jobs that kept none."""
    return job(jobs, tenant, job_id).where("request_json is not null").select("request_json")


def snapshot_record(snapshots: DataFrame, tenant: str, job_id: str, digest: str) -> DataFrame:
    """A capture's bytes and how they were read, within its tenant and job."""
    return snapshots.where((F.col("tenant") == tenant) & (F.col("job_id") == job_id) & (F.col("snapshot_hash") == digest))


def answered(asked: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Many point reads at once: asked with the struct `found`, the row of that key (tenant, job_id, ...), null without one.
    Keys compare as they are, so nothing of another tenant is ever found; of repeated rows the least counts."""
    own = rows.groupBy(*key).agg(F.min(F.struct(*[c for c in rows.columns if c not in key])).alias("found"))
    return asked.join(own, key, "left")


def evidence_nodes(evidence: DataFrame, captures: DataFrame) -> DataFrame:
    """evidence (job_id, snapshot_hash, locator, ...) with node_html: the source of the node that the locator names in the
    capture (job_id, snapshot_hash, html), 4,000 characters at most, null without one. A capture is parsed once for all
    locators that are cited of it."""
    key = ["job_id", "snapshot_hash"]
    cited = evidence.where("locator is not null").groupBy(*key).agg(F.collect_set("locator").alias("locators"))
    pages = captures.select(*key, "html").dropDuplicates(key).join(cited, key)
    read = pages.select(*key, "locators", source_nodes("html", "locators").alias("sources")).select(*key, F.inline(F.arrays_zip(F.col("locators").alias("locator"), F.col("sources").alias("node_html"))))
    return evidence.join(read, [*key, "locator"], "left")


def review_evidence(evidence: DataFrame, pages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Evidence of fields and candidates (job_id, source_url, fetched_at, snapshot_hash, ...) with source_bound: whether
    a page row of the job has this url, time and hash, and its bytes are stored. A null equals nothing. The three sides are
    sorted together by job and hash, so each moves once, and not at all where all of them are partitioned by job_id."""
    key = ["job_id", "snapshot_hash", "source_url", "fetched_at"]
    typed = lambda rows, names: rows.select(*[F.col(c).cast(evidence.schema[c].dataType).alias(c) for c in names])
    sides = [evidence, typed(pages.select("job_id", "snapshot_hash", F.col("url").alias("source_url"), "fetched_at"), key), typed(snapshots, key[:2])]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [side.withColumn("__side", F.lit(n)) for n, side in enumerate(sides)])
    content = Window.partitionBy(*key[:2]).orderBy(*key[2:])
    on_page = F.bool_or(F.col("__side") == 1).over(content.rangeBetween(Window.currentRow, Window.currentRow))
    stored = F.bool_or(F.col("__side") == 2).over(content.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return rows.withColumn("source_bound", whole & on_page & stored).where("__side = 0").select(*evidence.columns, "source_bound")


def session_seconds(sessions: DataFrame) -> DataFrame:
    """Stopped time of each reviewer on each field, in seconds rounded to three places, and the number of sessions."""
    own = ["tenant", "job_id", "field_name", "reviewer_id"]
    return sessions.where("stopped_at is not null").groupBy(*own).agg(F.bround(F.sum("elapsed_seconds"), 3).alias("time_spent_seconds"), F.count(F.lit(1)).alias("sessions"))


def label_totals(fields: DataFrame, reviews: DataFrame, sessions: DataFrame) -> DataFrame:
    """(tenant, job_id, reviewed_fields, accepted, minutes, minutes_per_accepted): fields (tenant, job_id, field_name,
    state), the latest review of each field, and all stopped sessions; null without an accepted field."""
    latest = reviews.groupBy("tenant", "job_id", "field_name").agg(F.max_by("verdict", F.struct("updated_at", "review_id")).alias("verdict"))
    both = fields.join(latest, ["tenant", "job_id", "field_name"]).groupBy("tenant", "job_id").agg(
        F.count(F.lit(1)).alias("reviewed_fields"), F.count_if((F.col("state") == "verified") & (F.col("verdict") == "correct")).alias("accepted")
    )
    spent = sessions.where("stopped_at is not null").groupBy("tenant", "job_id").agg((F.sum(F.coalesce("elapsed_seconds", F.lit(0.0))) / 60).alias("m"))
    out = fields.select("tenant", "job_id").distinct().join(both, ["tenant", "job_id"], "left").join(spent, ["tenant", "job_id"], "left")
    minutes, accepted = F.coalesce("m", F.lit(0.0)), F.coalesce("accepted", F.lit(0))
    return out.select("tenant", "job_id", F.coalesce("reviewed_fields", F.lit(0)).alias("reviewed_fields"), accepted.alias("accepted"), F.bround(minutes, 4).alias("minutes"), F.bround(minutes / F.nullif(accepted, F.lit(0)), 4).alias("minutes_per_accepted"))


def label_export(fields: DataFrame, reviews: DataFrame, sessions: DataFrame, pages: DataFrame) -> DataFrame:
    """One JSON envelope for each job: its totals, reviews in order, sessions in order and capture hashes."""
    own = ["tenant", "job_id"]
    past = reviews.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("review_id", "field_name", "verdict", "updated_at"))).alias("review_history"))
    timed = sessions.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("started_at", "field_name", "reviewer_id", "stopped_at", "elapsed_seconds"))).alias("review_sessions"))
    hashes = pages.where("snapshot_hash is not null").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("fetch_seq", "snapshot_hash"))).alias("h"))
    out = label_totals(fields, reviews, sessions).join(past, own, "left").join(timed, own, "left").join(hashes, own, "left")
    body = F.struct("job_id", "reviewed_fields", F.col("minutes").alias("review_minutes_total"), F.col("minutes_per_accepted").alias("review_minutes_per_accepted_field"), "review_sessions", "review_history", F.col("h.snapshot_hash").alias("capture_hashes"))
    return out.select(*own, F.to_json(body).alias("envelope"))
