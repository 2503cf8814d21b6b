"""Queries over records: scoring, percentiles, the job store, state machines and inventories, on the input tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evaluate, inventory, store
from factloom.sources import captures
from factloom.sources.tables import shared_dir, table
from factloom.streaming import sink, state

STATES = ("verified", "conflicting", "missing", "blocked", "unverified")


def _state(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATES)), (number % 5 + 1).cast("int"))


def scored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as scored fields: quality says what was expected, toxicity what was found, lang is the category."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    found = F.when(F.col("toxic") == 1, _state(F.col("doc_id"))).otherwise("verified")
    wanted = F.when(F.col("quality") == 1, "verified").otherwise(_state(F.col("doc_id") + F.floor(F.col("doc_id") / 7)))
    text = lambda c: F.col(c).cast("string")
    fields = rows.select(
        "doc_id", "category", found.alias("state"), wanted.alias("expected_state"), (F.col("doc_id") % 10).cast("string").alias("value"), F.when(F.col("doc_id") % 13 == 0, "x").otherwise((F.col("doc_id") % 10).cast("string")).alias("expected_value"),
        *[F.lit(None).cast("string").alias(c) for c in ("unit", "expected_unit", "currency", "expected_currency", "billing_period", "expected_billing_period")],
        F.when(found.isin("verified", "conflicting"), F.col("doc_id") % 11 != 0).alias("evidence_valid"), F.lit(None).cast("boolean").alias("evidence_matches"), F.when(found == "conflicting", F.col("doc_id") % 3 != 0).alias("bag_matches"), text("doc_id").alias("case_id"),
    )
    return evaluate.field_correctness(fields)


SUMMARY = ["fields", "expected_values", "accepted", "correct_accepted", "incorrect_accepted", "missed_values", "abstentions", "expected_conflicts", "detected_conflicts", "evidence_checked", "evidence_valid",
           "field_precision", "field_recall", "abstention_rate", "conflict_detection", "evidence_validity"]


def field_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_fields(spark, sf_dir).select("doc_id", "state", "expected_state", "correct")


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.field_summary(scored_fields(spark, sf_dir)).select(SUMMARY)


def score_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.field_summary_with_total(scored_fields(spark, sf_dir), "category").select("category", "is_total", *SUMMARY)


def rows_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of twenty documents whose every field was expected, verified and correct."""
    fields = scored_fields(spark, sf_dir).withColumn("case_id", F.floor(F.col("doc_id") / 20).cast("bigint"))
    return evaluate.row_correct(fields)


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals over sites, a site being the documents of one source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("site"))
    sites = evaluate.field_summary(scored_fields(spark, sf_dir).join(docs, "doc_id"), "site")
    return evaluate.bootstrap(sites.select("site", "correct_accepted", "accepted", "expected_values"))


def wrong_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.wrong_accepted(scored_fields(spark, sf_dir)).select("doc_id", "value", "expected_value")


def conflict_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the quantities of an order's lines are, as bags, those of its returned and its other lines shifted by
    the order's parity: expected and actual claims of a conflicting field."""
    lines = table(spark, sf_dir, "lineitem")
    actual = lines.select("l_orderkey", F.col("l_returnflag").alias("value"), F.col("l_linestatus").alias("unit"))
    expected = lines.select("l_orderkey", F.when(F.col("l_orderkey") % 20 == 0, F.col("l_returnflag")).otherwise(F.lit("N")).alias("value"), F.col("l_linestatus").alias("unit"))
    return evaluate.bag_matches(actual, expected, ["l_orderkey"], ["value", "unit"])


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency_percentiles(table(spark, sf_dir, "events"), "value", "event_type")


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two reviewers on each label: the second differs on every ninth document and lacks every eleventh."""
    first = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("site_id"), F.lit("f").alias("field"), F.col("toxic").cast("string").alias("state"), F.col("quality").cast("string").alias("value"))
    second = first.where("site_id % 11 <> 0").withColumn("value", F.when(F.col("site_id") % 9 == 0, None).otherwise(F.col("value")))
    return evaluate.agreement(first, second, ["state", "value"]).select("site_id", "agrees")


def human_row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    base = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("site"), F.lit("f").alias("field"), F.lit("p").alias("plan_name"), _state(F.col("p_partkey")).alias("state"), F.col("p_brand").alias("value"), none.alias("unit"), none.alias("currency"), none.alias("billing_period"), none.alias("conditions")
    )
    proposed = base.where("site % 17 <> 0").withColumn("state", F.when(F.col("site") % 7 == 0, "missing").otherwise(F.col("state"))).withColumn("value", F.when(F.col("site") % 4 == 0, None).otherwise(F.col("value")))
    return evaluate.human_row_errors(proposed, base).select("site", "error")


def supported_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether "Total: x" supports an order's price, x being wrong for every third order."""
    cents = F.col("o_totalprice").cast("decimal(18,2)")
    shown = F.when(F.col("o_orderkey") % 3 == 0, cents + 1).otherwise(cents)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Total: "), F.format_number(shown, 2)).alias("raw"), cents.cast("string").alias("value"))
    return rows.select("o_orderkey", evaluate.value_supported(F.col("raw"), F.col("value"), F.lit("number")).alias("supported"))


def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        "doc_id", _state(k).alias("state"), F.when(k % 6 == 0, None).otherwise(F.col("quality").cast("double")).alias("reviewer_time_seconds"), F.lit("p").alias("plan_name"), F.when(k % 8 == 0, "q").otherwise("p").alias("manifest_plan_name"),
        F.lit("blind").alias("labeling_mode"), (k % 3).cast("int").alias("n_evidence"), F.when(k % 4 == 0, "interpreted").otherwise("explicit").alias("judgment"), F.lit(None).cast("string").alias("rationale"), (k % 2 + 1).cast("int").alias("n_candidates"),
        F.lit(None).cast("string").alias("ambiguity"), F.when(k % 2 == 0, "v").alias("value"),
    )
    return evaluate.label_violations(rows).select("doc_id", F.array_join("violations", "|").alias("violations"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as measured cases; some measurements are missing by rule."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("case_id"), F.when(k % 2 == 0, "held_out").otherwise("development").alias("split"), F.col("s_name").alias("site"), (k % 8 * 0.5).alias("latency_seconds"), F.when(k % 5 == 0, "TimeoutError").alias("failure"),
        F.when(k % 4 == 0, F.array(F.lit("ACCESS_DENIED"))).otherwise(F.array().cast("array<string>")).alias("access_failure_codes"), (k % 3 == 0).alias("reviewed_row_correct"), F.when(k % 3 != 1, k % 40 + 20.0).alias("review_seconds"),
        F.when(k % 7 != 0, F.lit(96.0)).alias("manual_baseline_seconds"), F.when(k % 7 != 0, F.lit(1)).alias("manual_baseline_errors"), F.when(k % 7 != 0, F.lit(6)).alias("manual_baseline_fields"), (k % 2).cast("int").alias("corrected_row_errors"), F.lit(6).alias("corrected_row_fields"),
        F.lit(4.0).alias("live_elapsed_seconds"), (k % 5).cast("int").alias("http_requests_started"), F.lit(3).alias("preflight_http_requests_started"), F.lit(0).alias("reviewer_verdict_errors"), F.lit(6).alias("reviewer_verdict_fields"), F.lit(30.0).alias("blind_label_seconds"),
        F.when(k % 6 != 0, "rev").alias("code_revision"), (k % 4 == 0).alias("has_two_reviewers"), F.lit(1).alias("confirmed_at"), (k % 3).cast("int").alias("captured_at"),
    )


def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["cases", "failures", "access_failures", "reviewed_rows_correct", "reviewed_cases", "paired_cases", "mean_latency_seconds", "failure_rate", "manual_baseline_error_rate", "corrected_row_error_rate", "paired_assisted_time_reduction", "total_http_requests_started"]
    return evaluate.case_summary(_cases(spark, sf_dir)).select(cols)


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that finalising would refuse, with the reasons."""
    return evaluate.refusals(_cases(spark, sf_dir)).select("case_id", F.array_join("reasons", "|").alias("reasons"))


def failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir).withColumn("case_id", F.col("case_id").cast("string"))
    fields = scored_fields(spark, sf_dir).select(F.lit("f").alias("field"), "correct", (F.col("doc_id") % 50 + 1).cast("string").alias("case_id")).groupBy("case_id", "field").agg(F.bool_and("correct").alias("correct"))
    return evaluate.failure_examples(cases, fields).select("case_id", "failure", F.size("wrong_fields").alias("wrong"))


def label_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label envelopes of the review sessions as JSON."""
    sessions = _sessions(spark, sf_dir)
    fields = sessions.select("tenant", "job_id", "field_name").distinct().withColumn("state", F.lit("verified"))
    reviews = sessions.select("tenant", "job_id", "field_name", F.col("event_id").alias("review_id"), F.col("event_id").alias("updated_at"), F.lit("correct").alias("verdict"))
    pages = sessions.select("tenant", "job_id", F.col("event_id").alias("fetch_seq"), F.sha2(F.col("event_id").cast("string").cast("binary"), 256).alias("snapshot_hash"))
    out = store.label_export(fields, reviews, sessions, pages)
    return out.select("job_id", F.get_json_object("envelope", "$.reviewed_fields").cast("bigint").alias("reviewed_fields"), F.coalesce(F.json_array_length(F.get_json_object("envelope", "$.review_sessions")), F.lit(0)).cast("bigint").alias("sessions"))


def label_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What label envelopes hold: totals, the review history and sessions in their order, and capture hashes."""
    sessions = _sessions(spark, sf_dir)
    own = sessions.select("tenant", "job_id", "field_name", "event_id")
    fields = own.select("tenant", "job_id", "field_name").distinct().withColumn("state", F.when(F.col("job_id") % 3 == 0, "missing").otherwise("verified"))
    reviews = own.select("tenant", "job_id", "field_name", F.col("event_id").alias("review_id"), F.col("event_id").alias("updated_at"), F.when(F.col("event_id") % 4 == 0, "wrong").otherwise("correct").alias("verdict")).where("review_id % 2 = 0")
    pages = own.select("tenant", "job_id", F.col("event_id").alias("fetch_seq"), F.when(F.col("event_id") % 3 > 0, F.md5(F.col("event_id").cast("string"))).alias("snapshot_hash"))
    body = F.from_json("envelope", "job_id bigint, reviewed_fields bigint, review_minutes_total double, review_minutes_per_accepted_field double, review_sessions array<struct<field_name:string,stopped_at:double>>, review_history array<struct<review_id:bigint,verdict:string>>, capture_hashes array<string>")
    out = store.label_export(fields, reviews, sessions, pages).select(body.alias("b"))
    told = lambda array, one: F.coalesce(F.array_join(F.transform(array, one), "|"), F.lit(""))
    return out.select(
        "b.job_id", "b.reviewed_fields", "b.review_minutes_total", F.floor(F.col("b.review_minutes_per_accepted_field") * 10).cast("bigint").alias("tenths_per_accepted"), told(F.col("b.review_history"), lambda x: F.concat(x["review_id"].cast("string"), x["verdict"])).alias("history"),
        told(F.col("b.review_sessions"), lambda x: F.concat(x["field_name"], F.when(x["stopped_at"].isNull(), "?").otherwise(""))).alias("sessions"), told(F.col("b.capture_hashes"), lambda x: x).alias("hashes"),
    )


def replay_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a replay over all sites (sources of documents) and over each split, as their JSON says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("site"))
    number = F.regexp_extract("site", r"(\d+)$", 1).cast("int")
    fields = evaluate.field_correctness(scored_fields(spark, sf_dir)).join(docs, "doc_id")
    cases = docs.select("site").distinct().withColumn("split", F.when(number % 2 == 0, "held_out").otherwise("development"))
    found = [evaluate.replay_report(fields, cases, split) for split in (None, "development", "held_out")]
    counts = "fields:bigint,expected_values:bigint,accepted:bigint,correct_accepted:bigint,field_precision:double,field_recall:double"
    read = found[0].union(found[1]).union(found[2]).select("split", F.from_json("report", f"split string, sites bigint, offline_replay boolean, summary struct<{counts}>, by_category array<struct<category:string,correct_accepted:bigint>>").alias("r"))
    named = F.array_join(F.transform("r.by_category", lambda c: F.concat(c["category"], F.lit("="), c["correct_accepted"].cast("string"))), "|")
    return read.select("split", F.col("r.split").alias("told_split"), "r.sites", "r.offline_replay", "r.summary.*", named.alias("categories"))


def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The release gate over suppliers as sites and their parts' lines as fields."""
    split = F.when(F.col("s_suppkey") % 2 == 0, "held_out").otherwise("development").alias("split")
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), split)
    k = F.col("site")
    cases = sites.select(
        "site", "split", (k % 40 + 20.0).alias("review_seconds"), F.lit(30.0).alias("blind_label_seconds"), F.lit(90.0).alias("manual_baseline_seconds"), (k % 5).cast("int").alias("http_requests_started"), F.lit(3).alias("preflight_http_requests_started"),
        F.lit(20).alias("max_http_requests"), (k % 2).cast("int").alias("corrected_row_errors"), F.lit(1).alias("manual_baseline_errors"), F.array().cast("array<string>").alias("access_failure_codes"), F.array().cast("array<string>").alias("access_policy_violations"), (k % 4 != 0).alias("row_done"),
    )
    lines = table(spark, sf_dir, "lineitem").join(sites, F.col("l_suppkey") == F.col("site"))
    ok = F.col("l_linenumber") != 7
    fields = lines.select("site", "split", F.lit("listed_price").alias("field"), F.when(F.col("l_returnflag") == "R", "missing").otherwise("verified").alias("state"), F.lit("verified").alias("expected_state"), ok.alias("correct"), F.when(F.col("l_returnflag") != "R", F.lit(True)).alias("evidence_valid"))
    costs = sites.select("site", F.lit(0.25).alias("compute_usd"), F.lit(0.0).alias("provider_usd"))
    return evaluate.gate(cases, fields, costs, 36.0)


# the job store -----------------------------------------------------------------------------------------


def _job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of finished fields: a user is a tenant, four event ids a job."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), F.floor(F.col("event_id") / 4).cast("bigint").alias("job_id"), (F.col("event_id") % 3).alias("pages_fetched"), _state(F.col("event_id")).alias("state"))


def tenant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant"))
    log = _job_log(spark, sf_dir)
    return store.tenant_metrics(log, tenants.union(log.select("tenant")).distinct())


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 97).alias("idem"))


def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent_jobs(_jobs(spark, sf_dir)).select("tenant", "job_id", "status", F.col("rank").cast("bigint").alias("rank"))


NOW = "1995-06-17 12:00:00"


def retention_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (snapshots) of orders (jobs) that a purge at NOW leaves, with a long retention."""
    jobs = _jobs(spark, sf_dir)
    kept = store.purge({"jobs": jobs, "snapshots": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber").join(jobs.select("tenant", "job_id"), "job_id")}, F.to_timestamp_ntz(F.lit(NOW)))
    return kept["snapshots"].groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


def deleted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs left in each tenant after every seventh was deleted."""
    jobs = _jobs(spark, sf_dir)
    left = store.deleted({"jobs": jobs}, jobs.where("job_id % 7 = 0").select("tenant", "job_id"))["jobs"]
    return left.groupBy("tenant").agg(F.count(F.lit(1)).alias("jobs"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as review sessions: an event's value is its length in seconds."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    seconds = F.bround(F.abs(F.col("value")), 3)
    return e.select(F.lit("t").alias("tenant"), F.col("user_id").alias("job_id"), F.col("event_type").alias("field_name"), F.lit("r").alias("reviewer_id"), "event_id", start.alias("started_at"),
                    F.when(F.col("event_id") % 10 != 0, start + seconds).alias("stopped_at"), F.when(F.col("event_id") % 10 != 0, seconds.cast("decimal(18,3)")).alias("elapsed_seconds"))


def review_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _sessions(spark, sf_dir)
    return store.session_seconds(sessions).select("job_id", "field_name", F.col("time_spent_seconds").cast("double").alias("time_spent_seconds"), "sessions")


def label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _sessions(spark, sf_dir)
    fields = sessions.select("tenant", "job_id", "field_name").distinct().withColumn("state", F.when(F.col("job_id") % 2 == 0, "verified").otherwise("missing"))
    reviews = sessions.select("tenant", "job_id", "field_name", F.col("event_id").alias("review_id"), F.col("event_id").alias("updated_at"), F.when(F.col("event_id") % 3 == 0, "wrong").otherwise("correct").alias("verdict"))
    out = store.label_totals(fields, reviews, sessions)
    return out.select("job_id", "reviewed_fields", "accepted", F.col("minutes").cast("double").alias("minutes"))


# state machines ----------------------------------------------------------------------------------------


def host_start_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as starts on a host: gap to the one before, overlap with it, and whether the pace was kept."""
    e = table(spark, sf_dir, "events")
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double")
    rows = e.select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), at.alias("start"), (at + 2.0).alias("finish"), F.lit(1.0).alias("delay"))
    return state.host_gaps(rows).select("seq", F.bround("gap", 3).alias("gap"), F.bround(F.coalesce("overlap", F.lit(0.0)), 3).alias("overlap"), "kept")


def session_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sessions(spark, sf_dir).where("stopped_at is not null").withColumn("stopped_at", F.col("started_at") + 3600.0)
    return state.session_overlaps(rows).groupBy("job_id").agg(F.count(F.lit(1)).alias("overlaps"))


def claim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claim commands: a user is a tenant, the event type its key; time passes in whole seconds."""
    k = F.col("event_id")
    command = F.element_at(F.array(*map(F.lit, ("claim", "renew", "put", "claim", "release", "cancel"))), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        k.alias("seq"), (k * 1.0).alias("at"), F.col("user_id").cast("string").alias("tenant"), F.col("event_type").alias("idem"), F.when(k % 10 == 0, "h2").otherwise("h1").alias("request_hash"), F.concat(F.lit("w"), (k % 2).cast("string")).alias("owner"), command.alias("command"),
    )


def claim_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each command, and the leases that end before their key's next command."""
    return state.replay_claims(claim_events(spark, sf_dir))


def claim_first_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First claim of each key: it always becomes its owner."""
    found = state.replay_claims(claim_events(spark, sf_dir).where("command = 'claim'")).where("seq is not null")
    first = found.groupBy("tenant", "idem").agg(F.min_by("outcome", "seq").alias("outcome"), F.min("seq").alias("seq"))
    return first


def paced_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the events of a user could start on a host that takes two seconds for each."""
    e = table(spark, sf_dir, "events")
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double")
    rows = e.select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), at.alias("at"), F.lit(0.0).alias("delay"), F.lit(2.0).alias("seconds"))
    return state.paced_starts(rows).select("seq", F.bround(F.col("start") - F.col("at"), 2).alias("waited"))


def review_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each review command: a user is a tenant with a job for each type of its events, two fields and three
    reviewers; a command follows from the key's hash."""
    return state.replay_reviews(review_events(spark, sf_dir))


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    command = F.element_at(F.array(*map(F.lit, ("start", "start", "stop", "save"))), (F.conv(F.substring(F.md5(k.cast("string")), 1, 4), 16, 10).cast("int") % 4 + 1))
    return table(spark, sf_dir, "events").select(
        k.alias("seq"), (k * 1.0).alias("at"), F.col("user_id").cast("string").alias("tenant"), F.col("event_type").alias("job_id"), F.concat(F.lit("f"), (k % 2).cast("string")).alias("field_name"),
        F.concat(F.lit("r"), (k % 3).cast("string")).alias("reviewer_id"), command.alias("command"),
    )


def job_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as puts in four batches, one of which comes twice: what the committed tables hold of each tenant (of ten)
    afterwards. Every fifth order has another owner than its claim, and one order of three writes to the claim of
    the order before it, which is complete by then."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    key = F.when(k % 3 == 2, k - 1).otherwise(k).cast("string")
    states = F.array(*[F.struct(F.lit(f"f{i}").alias("field_name"), F.element_at(F.array(*map(F.lit, store.STATES)), ((k + i) % 5 + 1).cast("int")).alias("state")) for i in range(3)])
    snapshot = F.struct(F.sha2(F.col("o_orderpriority"), 256).alias("snapshot_hash"), F.col("o_orderpriority").cast("binary").alias("raw"), F.lit("utf-8").alias("encoding"), F.lit("text/html").alias("content_type"))
    puts = orders.select(
        k.alias("seq"), (F.col("o_custkey") % 10).cast("string").alias("tenant"), k.cast("string").alias("job_id"), key.alias("idem"), F.lit("h").alias("request_hash"), F.when(k % 5 == 0, "b").otherwise("a").alias("owner"), F.col("o_orderdate").cast("string").alias("created_at"),
        F.lit("{}").alias("result"), (k % 4).alias("pages_fetched"), states.alias("fields"), F.array(snapshot, snapshot).alias("snapshots"),
    )
    claims = puts.where(F.col("idem") == F.col("job_id")).select("tenant", "idem", "request_hash", F.lit("a").alias("owner"), F.lit("pending").alias("state"))
    root = f"{shared_dir(spark)}/factloom/sink-{uuid.uuid4().hex}"
    sink.create(spark, root)
    for number in (0, 1, 2, 1, 3):
        sink.commit(puts.where(F.floor(k / 7) % 4 == number), number, root, lambda _: claims)
    jobs = sink.committed(spark, root, "jobs").groupBy("tenant").agg(F.count(F.lit(1)).alias("stored"))
    kept = sink.committed(spark, root, "snapshots").groupBy("tenant").agg(F.count(F.lit(1)).alias("snapshots"))
    lost = sink.committed(spark, root, "outcomes").groupBy("tenant").agg(F.count_if(F.col("error") == "CLAIM_LOST").alias("lost"))
    return lost.join(jobs, "tenant", "left").join(kept, "tenant", "left").join(sink.metrics(spark, root), "tenant", "left").na.fill(0)


# inventories -------------------------------------------------------------------------------------------


def inventory_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages of four kinds in two splits."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.when(k % 2 == 0, "held_out").otherwise("development").alias("split"), F.element_at(F.array(*map(F.lit, inventory.KINDS)), (F.floor(k / 2) % 4 + 1).cast("int")).alias("page_type"))
    return inventory.balance(rows)


def request_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request schemas made of parts, with faults that follow from their keys."""
    k = F.col("p_partkey")
    names = F.when(k % 5 == 0, '"a":{"type":"string"}').otherwise('"a":{"type":"string"},"b":{"type":"number","x-unit":"month"},"c":{"type":"boolean"}')
    more = F.when(k % 7 == 0, ',"1d":{"type":"string"}').when(k % 11 == 0, ',"d":{"type":"string","x-currency":"USD"}').otherwise("")
    head = F.concat(F.when(k % 3 == 0, '"title":" ",').otherwise('"title":"t",'), F.when(k % 13 == 0, '"required":["a","a"],').otherwise('"required":["a"],'), F.when(k % 4 == 0, '"extra":1,').otherwise(""))
    text = F.when(k % 17 == 0, "no json").otherwise(F.concat(F.lit('{"type":"object",'), head, F.lit('"properties":{'), names, more, F.lit("}}")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(inventory.request_violations(text), "|").alias("violations"))


def fetch_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a fetch log: what each fetch fails by."""
    k, host = F.col("event_id"), F.concat(F.lit("h"), (F.col("user_id") % 50).cast("string"), F.lit(".example"))
    status = F.element_at(F.array(*map(F.lit, (200, 200, 403, 500, 200, 451, 404))), (k % 7 + 1).cast("int"))
    hops = F.when(k % 9 == 0, F.array(host, F.lit("elsewhere.example"))).otherwise(F.array(host))
    log = table(spark, sf_dir, "events").select("event_id", host.alias("url"), host.alias("origin"), status.alias("status"), F.when(k % 8 == 0, "image/png").otherwise("text/html").alias("content_type"), F.repeat(F.lit("x"), F.when(k % 10 == 0, 1_000_001).otherwise(1)).cast("binary").alias("raw"),
                                                hops.alias("hops"), F.when(k % 11 == 0, F.array_repeat(host, 5)).otherwise(F.array()).cast("array<string>").alias("redirects"))
    n = F.col("id")
    robots = spark.range(50).where("id % 6 <> 5").select(F.concat(F.lit("h"), n.cast("string"), F.lit(".example")).alias("origin"), F.when(n % 6 == 4, 503).when(n % 6 == 3, 404).otherwise(200).alias("robots_status"))
    return captures.page_source(log, robots, [f"h{i}.example" for i in range(50)]).select("event_id", "code")


def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetches of one to six requests over 60 hosts, of which 56 are in scope; customers as what robots of a host
    said at a time. What each fetch fails by, and where."""
    k, u = F.col("event_id"), F.col("user_id")
    host = lambda n: F.concat(F.lit("h"), (n % 60).cast("string"), F.lit(".example"))

    def hop(i: Column) -> Column:
        more = i < k % 6
        status = F.when(more, 302).otherwise(F.element_at(F.array(*map(F.lit, (200, 200, 200, 403, 200, 500, 301))), (u % 7 + 1).cast("int")))
        return F.struct(host(u + i * (k % 4)).alias("origin"), host(u + i * (k % 4)).alias("host"), (k * 2.0 + i).alias("at"), status.alias("status"), (more & ((k + i) % 17 != 0)).alias("location"))

    log = table(spark, sf_dir, "events").select("event_id", F.transform(F.sequence(F.lit(0).cast("bigint"), k % 6), hop).alias("hops"), F.when(k % 8 == 0, "image/png").otherwise("text/html").alias("content_type"), F.when(k % 10 == 0, 1_000_001).otherwise(1).alias("n_bytes"))
    c = F.col("c_custkey")
    robots = table(spark, sf_dir, "customer").select(host(c).alias("origin"), (c * 5.0).alias("at"), F.element_at(F.array(*map(F.lit, (200, 200, 404, 200, 503))), (c % 5 + 1).cast("int")).alias("robots_status"), (F.floor(c / 60) % 3 == 0).alias("denied"))
    return captures.redirect_chains(log, robots, [f"h{i}.example" for i in range(56)], "event_id", 1000.0)


def target_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of an inventory with faults that follow from their keys."""
    k = F.col("c_custkey")
    host = F.concat(F.lit("s"), F.when(k % 20 == 0, k - 1).otherwise(k).cast("string"), F.lit(".example"))
    text = {
        "site_id": F.concat(F.lit("s"), k.cast("string")), "vendor_name": F.col("c_name"), "category": F.col("c_mktsegment"), "seed_url": F.when(k % 9 == 0, "ftp://x").otherwise(F.concat(F.lit("https://"), host, F.lit("/"))), "plan_name": F.when(k % 7 == 0, "PENDING").otherwise("Pro"),
        "allowed_hostnames": host, "max_pages": F.when(k % 8 == 0, "9").otherwise("3"), "max_depth": F.lit("1"), "deadline_seconds": F.lit("20"), "max_http_requests": F.lit("20"), "date_window_start": F.lit("2026-10-15"), "date_window_end": F.lit("2026-10-16"), "retention_days": F.lit("7"),
        "provider_accounts": F.lit("NONE"), "data_destinations": F.lit("local"), "max_provider_spend_usd": F.when(k % 11 == 0, "1").otherwise("0"), "expected_impact": F.lit("low"), "selection_status": F.lit("CANDIDATE"), "split": F.when(k % 2 == 0, "held_out").otherwise("development"),
        "access_basis": F.lit("public"), "robots_status": F.lit("ALLOWED"), "robots_checked_at": F.lit("2026-10-01"), "approval_record": F.lit("r"),
    }
    rows = table(spark, sf_dir, "customer").select("c_custkey", *[v.alias(n) for n, v in text.items()])
    return inventory.target_violations(rows).select("c_custkey", F.array_join("violations", "|").alias("violations"), F.array_join("pending", "|").alias("pending"))
