"""Verification and reconciliation: candidates to field states, field states to job states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.dom import nodes
from factloom.operators import candidates
from factloom.sources.captures import decode_html

#: What a candidate must share with one regenerated from the retained bytes.
BOUND = ["field", "value", "unit", "currency", "billing_period", "value_type", "encoding", "locator", "excerpt", "label", "raw_value"]
PLACE = ["page_seq", "src_rank", "node_id", "item_idx"]


def verified(claimed: DataFrame, regenerated: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Claimed candidates that come up again, null-safe in every compared column. regenerated must come from the
    captures and not from what claimed was made of; keys name the page (and capture) on both sides."""
    keys = keys or ["page_key"]
    again = regenerated.select(*keys, *BOUND).distinct().alias("b")
    mine = claimed.alias("a")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]  # the equi-join; the rest is null-safe
    for c in BOUND:
        same.append(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")))
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return mine.join(again, condition, "left_semi")


def fitting(found: DataFrame, spec: DataFrame) -> DataFrame:
    """found (job_id, field, unit, currency, ...) whose unit and currency are those that spec (job_id, field, x_unit,
    x_currency) asks for; where it asks for none, any fits."""
    asked = "(nullif(x_unit, '') is null or unit <=> x_unit) and (nullif(x_currency, '') is null or currency <=> x_currency)"
    return found.join(spec, ["job_id", "field"]).where(asked)


def field_states(found: DataFrame, raw: DataFrame, hits: DataFrame, jobs: DataFrame, fields: DataFrame) -> DataFrame:
    """One row for each (job_id, field): state, value, unit, currency, billing_period, encoding, evidence, candidates.

    found: verified candidates with job_id and page_seq; raw: all candidates; hits (job_id, field): labels seen;
    jobs (job_id, blocked); fields (job_id, name, x_unit, x_currency). One distinct claim is verified, with all
    its evidence; several conflict, each by its first candidate; none leaves unverified (something was there),
    blocked or missing, in that order. Claims are grouped null-safe; order is by place and never by arrival.
    """
    spec = fields.select("job_id", F.col("name").alias("field"), "x_unit", "x_currency")
    kept = fitting(found, spec)
    place, evidence = F.struct(*PLACE), F.struct(*PLACE, "page_key", "locator", "excerpt", "raw_value")
    claims = kept.groupBy("job_id", "field", "value", "unit", "currency", "billing_period").agg(
        F.min(place).alias("place"), F.min_by("encoding", place).alias("encoding"), F.sort_array(F.collect_list(evidence)).alias("evidence")
    )
    per_field = claims.groupBy("job_id", "field").agg(
        F.count(F.lit(1)).alias("claims"),
        F.min_by(F.struct("value", "unit", "currency", "billing_period", "encoding", "evidence"), "place").alias("first"),
        F.sort_array(F.collect_list(F.struct("place", "value", "unit", "currency", "billing_period", F.col("evidence")[0].alias("evidence")))).alias("all"),
    )
    seen = raw.select("job_id", "field").union(hits.select("job_id", "field")).distinct().withColumn("seen", F.lit(True))
    rows = spec.select("job_id", "field").join(jobs, "job_id").join(per_field, ["job_id", "field"], "left").join(seen, ["job_id", "field"], "left")
    one = F.col("claims") == 1
    state = F.when(one, "verified").when(F.col("claims") > 1, "conflicting").when(F.col("seen"), "unverified").when(F.col("blocked"), "blocked").otherwise("missing")
    first = {c: F.when(one, F.col(f"first.{c}")) for c in ("value", "unit", "currency", "billing_period", "encoding", "evidence")}
    return rows.select("job_id", "field", state.alias("state"), *[v.alias(k) for k, v in first.items()], F.when(F.col("claims") > 1, F.col("all")).alias("candidates"))


def page_states(captures: DataFrame, fields: candidates.Schema) -> DataFrame:
    """field_states for jobs of one captured page each, in one pass: captures (page_key, url, html, raw, content_type) are
    read as they are and once more from what their bytes decode to; both sides move once, by page, and what the bytes do
    not tell again is no claim. The columns are those of field_states, with page_key for job_id."""
    sides = F.array(F.struct(F.col("html").alias("html"), F.lit(True).alias("claimed")), F.struct(F.col("again").alias("html"), F.lit(False).alias("claimed")))
    rows = captures.select("page_key", "url", "html", decode_html("raw", "content_type")["text"].alias("again")).select("page_key", "url", F.inline(sides))
    told = candidates.read_fields(nodes(rows, also=["claimed"]), fields, ["claimed"]).withColumn("page_seq", F.lit(0)).repartition("page_key")
    same = Window.partitionBy("page_key", *BOUND, "candidate")
    fits = F.expr("(nullif(x_unit, '') is null or unit <=> x_unit) and (nullif(x_currency, '') is null or currency <=> x_currency)")
    kept = told.withColumn("again", F.bool_or(~F.col("claimed")).over(same)).where("claimed").withColumn("good", F.col("candidate") & F.col("again") & fits)
    place, evidence = F.struct(*PLACE), F.struct(*PLACE, "page_key", "locator", "excerpt", "raw_value")
    what = ("value", "unit", "currency", "billing_period")
    own = [F.when(F.col("good"), F.col(c)).alias(c) for c in what]
    claims = kept.select("page_key", "field", "good", "candidate", "hit", *own, "encoding", place.alias("place"), evidence.alias("e")).groupBy("page_key", "field", "good", *what).agg(
        F.min("place").alias("place"), F.min_by("encoding", "place").alias("encoding"), F.sort_array(F.collect_list(F.when(F.col("good"), F.col("e")))).alias("evidence"), F.bool_or(F.col("candidate") | F.col("hit")).alias("seen"),
    )
    good = F.col("good")
    each = claims.groupBy("page_key", "field").agg(
        F.count_if(good).alias("claims"), F.min_by(F.struct(*what, "encoding", "evidence"), F.when(good, F.col("place"))).alias("first"),
        F.sort_array(F.collect_list(F.when(good, F.struct("place", *what, F.col("evidence")[0].alias("evidence"))))).alias("all"), F.bool_or("seen").alias("seen"),
    )
    one = F.col("claims") == 1
    state = F.when(one, "verified").when(F.col("claims") > 1, "conflicting").when(F.col("seen"), "unverified").otherwise("missing")
    return each.select("page_key", "field", state.alias("state"), *[F.when(one, F.col(f"first.{c}")).alias(c) for c in (*what, "encoding", "evidence")], F.when(F.col("claims") > 1, F.col("all")).alias("candidates"))


def job_status(states: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, status): complete if every field is verified and there was no error, failed without a page, else
    partial. jobs: job_id, n_pages, n_errors."""
    every = states.groupBy("job_id").agg(F.every(F.col("state") == "verified").alias("all_verified"))
    status = F.when(F.col("n_pages") == 0, "failed").when(F.coalesce("all_verified", F.lit(False)) & (F.col("n_errors") == 0), "complete").otherwise("partial")
    return jobs.join(every, "job_id", "left").select("job_id", status.alias("status"))
