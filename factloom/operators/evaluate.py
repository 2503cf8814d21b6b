"""Scoring against labelled truth: correctness, summaries, bootstrap intervals, label checks and the release gate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.dom import let, node_path
from factloom.sources.captures import BLOCKING

#: Bootstrap draws, sites of a block (a choice of ours), and the thresholds of the gate.
SEED, DRAWS = 13, 500
BLOCK_SITES = 1024
GATE = {"min_precision": 0.95, "min_recall": 0.5, "min_accepted": 24, "min_time_reduction": 0.25, "max_cost_per_row_usd": 5.0, "max_access_failures": 2}
CRITICAL = ("named_plan", "listed_price", "currency", "billing_period")
POLICY_STOPS = ("ROBOTS_DENIED", "ROBOTS_UNAVAILABLE", "OUT_OF_SCOPE")


def ratio(n: Column, d: Column, places: int = 4) -> Column:
    """n / d rounded half to even, null without a denominator."""
    return F.bround(n / F.nullif(d, F.lit(0)), places)


def evidence_bound(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """evidence with bound: whether the first page row of its url, time and hash exists in its case and has those bytes."""
    key = ["case_id", "source_url", "fetched_at", "snapshot_hash"]
    first = pages.select("case_id", F.col("url").alias("source_url"), "fetched_at", "snapshot_hash", "raw", "page_seq")
    first = first.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("page_seq"))).where("n = 1")
    first = first.select(*key, (F.sha2("raw", 256) == F.col("snapshot_hash")).alias("bound"))
    return evidence.join(first, key, "left").withColumn("bound", F.coalesce("bound", F.lit(False)))


def field_correctness(fields: DataFrame) -> DataFrame:
    """fields with correct. Columns: state and expected_state; value, unit, currency, billing_period and the expected
    ones (a null expected unit, currency or period is not compared); evidence_valid; evidence_matches (whether the
    expected excerpt or scope was cited; null if none was named); bag_matches (whether conflicting candidates are
    the expected ones; null likewise)."""
    same_state = F.col("state").eqNullSafe(F.col("expected_state"))
    agrees = F.col("value").eqNullSafe(F.col("expected_value")) & F.coalesce("evidence_valid", F.lit(False))
    for c in ("unit", "currency", "billing_period"):
        agrees = agrees & (F.col(f"expected_{c}").isNull() | F.col(c).eqNullSafe(F.col(f"expected_{c}")))
    agrees = agrees & F.coalesce("evidence_matches", F.lit(True))
    conflict = same_state & F.coalesce(F.col("bag_matches") & F.coalesce("evidence_valid", F.lit(False)), F.col("bag_matches").isNull())
    return fields.withColumn("correct", F.when(F.col("state") == "verified", same_state & agrees).when(F.col("state") == "conflicting", conflict).otherwise(same_state))


def bag_matches(actual: DataFrame, expected: DataFrame, by: list[str], compared: list[str]) -> DataFrame:
    """by..., bag_matches: whether both sides have the same claims equally often. With equalities alone, consuming one
    actual claim for each expected one is equality of bags."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by, *compared).agg(F.count(F.lit(1)).alias(name))

    a, e = counted(actual, "n_actual").alias("a"), counted(expected, "n_expected").alias("e")
    on = F.lit(True)
    for c in [*by, *compared]:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"e.{c}"))
    both = a.join(e, on, "full_outer").select(*[F.coalesce(f"a.{c}", f"e.{c}").alias(c) for c in by], (F.coalesce("n_actual", F.lit(0)) == F.coalesce("n_expected", F.lit(0))).alias("same"))
    return both.groupBy(*by).agg(F.bool_and("same").alias("bag_matches"))


_SCOPE_OUT = T.StructType([T.StructField("matched", T.BooleanType())])


def scoped_bag_matches(actual: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Greedy matching where an expected claim names a scope instead of a locator: in their order (pos), each expected
    claim takes the first actual one left with its value, unit and currency whose locator is the scope or lies
    below it. A group holds one field's candidates: a handful."""
    a = actual.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "value", "unit", "currency", "locator"))).alias("actual"))
    e = expected.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "value", "unit", "currency", F.col("scope_locator").alias("locator")))).alias("expected"))

    @F.pandas_udf(T.BooleanType())
    def greedy(have: pd.Series, want: pd.Series) -> pd.Series:
        def one(left, claims) -> bool:
            left = list(left) if left is not None else []
            for c in claims if claims is not None else []:
                hit = next((x for x in left if all(x[k] == c[k] for k in ("value", "unit", "currency")) and (x["locator"] == c["locator"] or x["locator"].startswith(c["locator"] + " > "))), None)
                if hit is None:
                    return False
                left.remove(hit)
            return not left

        return pd.Series([one(h, w) for h, w in zip(have, want, strict=True)])

    return a.join(e, by, "full_outer").select(*by, greedy("actual", "expected").alias("bag_matches"))


def in_scope(evidence: DataFrame, scopes: DataFrame, by: list[str]) -> DataFrame:
    """by..., evidence_matches: whether some evidence lies in some cited scope of the same url, hash and time."""
    key = [*by, "source_url", "snapshot_hash", "fetched_at"]
    hit = evidence.alias("m").join(scopes.alias("s"), key).where("m.locator = s.scope_locator or startswith(m.locator, concat(s.scope_locator, ' > '))").select(*by).distinct().withColumn("hit", F.lit(True))
    return evidence.select(*by).union(scopes.select(*by)).distinct().join(hit, by, "left").select(*by, F.coalesce("hit", F.lit(False)).alias("evidence_matches"))


def row_correct(fields: DataFrame) -> DataFrame:
    """(case_id, reviewed_row_correct): whether every field was expected and is verified and correct."""
    return fields.groupBy("case_id").agg(F.bool_and((F.col("expected_state") == "verified") & (F.col("state") == "verified") & F.col("correct")).alias("reviewed_row_correct"))


def _counters() -> dict[str, Column]:
    expected, accepted, conflict = F.col("expected_state") == "verified", F.col("state") == "verified", F.col("expected_state") == "conflicting"
    right = F.coalesce("correct", F.lit(False))
    return {
        "fields": F.count(F.lit(1)),
        "expected_values": F.count_if(expected),
        "accepted": F.count_if(accepted),
        "correct_accepted": F.count_if(accepted & right),
        "incorrect_accepted": F.count_if(accepted & ~right),
        "missed_values": F.count_if(expected & ~(accepted & right)),
        "abstentions": F.count_if(~accepted),
        "expected_conflicts": F.count_if(conflict),
        "detected_conflicts": F.count_if(conflict & right),
        "evidence_checked": F.count_if(F.col("evidence_valid").isNotNull()),
        "evidence_valid": F.count_if(F.col("evidence_valid")),
    }


def _ratios(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "field_precision": ratio(c("correct_accepted"), c("accepted")), "field_recall": ratio(c("correct_accepted"), c("expected_values")), "abstention_rate": ratio(c("abstentions"), c("fields")),
        "conflict_detection": ratio(c("detected_conflicts"), c("expected_conflicts")), "evidence_validity": ratio(c("evidence_valid"), c("evidence_checked")),
    })


def field_summary(fields: DataFrame, *by: str) -> DataFrame:
    """The field counters and their ratios, for all fields or by columns."""
    return _ratios(fields.groupBy(*by).agg(*[v.alias(k) for k, v in _counters().items()]))


def field_summary_with_total(fields: DataFrame, by: str) -> DataFrame:
    """The summary for each value of `by` and, where is_total, for all: one pass over grouping sets."""
    sets = fields.groupingSets([[F.col(by)], []], F.col(by)).agg((F.grouping(by) == 1).alias("is_total"), *[v.alias(k) for k, v in _counters().items()])
    return _ratios(sets)


def replay_report(fields: DataFrame, cases: DataFrame, split: str | None = None) -> DataFrame:
    """One row with the report of an offline replay as JSON: what was scored, its summary, and one for each category.
    fields (site, category, ... as field_correctness gives them), cases (site, split) of frozen bundles, all or of one
    split. A site that stands twice among the cases fails the report; an evaluation without cases reports none."""
    once = cases.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("split"))
    once = once.withColumn("site", F.when(F.col("n") == 1, F.col("site")).otherwise(F.raise_error(F.lit("duplicate site in frozen bundles")).cast("string")))
    chosen = once if split is None else once.where(F.col("split") == split)
    scored = fields.join(chosen.select("site"), "site", "left_semi")
    sums = field_summary_with_total(scored, "category")
    names = [c for c in sums.columns if c not in ("category", "is_total")]
    summary = F.max(F.when(F.col("is_total"), F.struct(*names))).alias("summary")
    parts = F.array_sort(F.collect_list(F.when(~F.col("is_total"), F.struct("category", *names)))).alias("by_category")
    sites = chosen.agg(F.count("site")).first()[0]
    fixed = {"evaluation_schema_version": "1.0", "adapter": "local", "split": split or "all", "evaluation_status": "incomplete"}
    body = F.struct(*[F.lit(v).alias(n) for n, v in fixed.items()], F.lit(True).alias("offline_replay"), F.lit(sites).alias("sites"), "summary", "by_category")
    return sums.agg(summary, parts).select(F.lit(split or "all").alias("split"), F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def case_summary(cases: DataFrame) -> DataFrame:
    """Rates, times and errors over cases (one row each; measurements that were not made are null)."""
    c = F.col
    none = F.coalesce(F.size("access_failure_codes"), F.lit(0)) == 0
    paired = c("manual_baseline_seconds").isNotNull() & c("review_seconds").isNotNull()
    out = cases.agg(
        F.count(F.lit(1)).alias("cases"), F.sum("latency_seconds").alias("latency"), F.count("failure").alias("failures"), F.count_if(~none).alias("access_failures"), F.count_if("reviewed_row_correct").alias("reviewed_rows_correct"),
        F.count("review_seconds").alias("reviewed_cases"), F.sum("review_seconds").alias("review_seconds"), F.count("manual_baseline_seconds").alias("baseline_cases"), F.sum("manual_baseline_seconds").alias("baseline_seconds"),
        F.sum("manual_baseline_errors").alias("baseline_errors"), F.sum("manual_baseline_fields").alias("baseline_fields"), F.sum("corrected_row_errors").alias("corrected_errors"), F.sum("corrected_row_fields").alias("corrected_fields"),
        F.sum(F.when(paired, c("manual_baseline_seconds"))).alias("paired_baseline"), F.sum(F.when(paired, c("review_seconds"))).alias("paired_assisted"), F.count_if(paired).alias("paired_cases"),
        F.sum("live_elapsed_seconds").alias("live_seconds"), F.count("live_elapsed_seconds").alias("live_cases"), F.sum("http_requests_started").alias("requests"), F.sum("preflight_http_requests_started").alias("preflight"),
        F.sum("reviewer_verdict_errors").alias("verdict_errors"), F.sum("reviewer_verdict_fields").alias("verdict_fields"),
    )
    return out.withColumns({
        "mean_latency_seconds": ratio(c("latency"), c("cases")), "failure_rate": ratio(c("failures"), c("cases")), "access_failure_rate": ratio(c("access_failures"), c("cases")),
        "manual_baseline_minutes_per_site": ratio(c("baseline_seconds") / 60, c("baseline_cases")), "manual_baseline_error_rate": ratio(c("baseline_errors"), c("baseline_fields")),
        "corrected_row_error_rate": ratio(c("corrected_errors"), c("corrected_fields")), "reviewer_verdict_error_rate": ratio(c("verdict_errors"), c("verdict_fields")),
        "paired_assisted_time_reduction": ratio(c("paired_baseline") - c("paired_assisted"), c("paired_baseline")), "mean_live_latency_seconds": ratio(c("live_seconds"), c("live_cases")),
        "total_http_requests_started": F.when(c("live_cases") > 0, F.coalesce(c("requests"), F.lit(0)) + F.coalesce(c("preflight"), F.lit(0))),
    })


def resampled(block_sizes: list[int], block: int, draws: int, seed: int) -> np.ndarray:
    """How many of each draw's picks (as many as there are sites) fall into a block of sites: the multinomial law, by
    halving the blocks again and again. A half's share is one binomial number for each draw, seeded by its range, so every
    task finds its own block in log(blocks) steps and none holds the picks."""
    ends = np.concatenate(([0], np.cumsum(block_sizes)))
    lo, hi, picks = 0, len(block_sizes), np.full(draws, int(ends[-1]), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, 0, lo, hi]).binomial(picks, (ends[mid] - ends[lo]) / max(1, ends[hi] - ends[lo]))
        lo, hi, picks = (lo, mid, left) if block < mid else (mid, hi, picks - left)
    return picks


def bootstrap_sums(sites: DataFrame, seed: int = SEED, draws: int = DRAWS, block_sites: int = BLOCK_SITES) -> DataFrame:
    """(draw, picks and the sums of the three columns) of resamples of sites (site, correct_accepted, accepted,
    expected_values). Sites are dealt to blocks by a hash of their name; the driver knows the blocks' sizes, one number
    for block_sites sites or so; a block's task draws how often each of its sites is picked and gives a sum for each draw."""
    columns = ["correct_accepted", "accepted", "expected_values"]
    n = sites.count()
    blocks = max(1, -(-n // block_sites))
    dealt = sites.select(F.pmod(F.xxhash64("site"), F.lit(blocks)).cast("int").alias("block"), "site", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in columns])
    sizes = [0] * blocks
    for r in dealt.groupBy("block").count().collect():
        sizes[r["block"]] = r["count"]

    def pick(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        values = own.sort_values(["site", *columns], kind="stable")[columns].to_numpy()
        picks = resampled(sizes, int(key[0]), draws, seed)
        times = np.random.default_rng([seed, 1, int(key[0])]).multinomial(picks, np.full(len(values), 1 / len(values)))
        return pd.DataFrame({"draw": np.arange(draws), "picks": picks, **dict(zip(columns, (times @ values).T, strict=True))})

    each = dealt.groupBy("block").applyInPandas(pick, "draw int, picks bigint, correct_accepted double, accepted double, expected_values double")
    return each.groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("picks", *columns)])


def bootstrap(sites: DataFrame, seed: int = SEED, draws: int = DRAWS) -> DataFrame:
    """95 % intervals of precision and recall by resampling sites (site, correct_accepted, accepted, expected_values): null
    below two sites. A null count is none; a site that stands twice is two sites. What a draw picks depends on the sites and
    the seed alone, not on how the table is cut."""
    spark = sites.sparkSession
    if sites.limit(2).count() < 2:
        return spark.createDataFrame([("field_precision", None, None), ("field_recall", None, None)], "metric string, low double, high double")
    values = bootstrap_sums(sites, seed, draws).select(F.explode(F.array(
        F.struct(F.lit("field_precision").alias("metric"), ratio(F.col("correct_accepted"), F.col("accepted")).alias("value")),
        F.struct(F.lit("field_recall").alias("metric"), ratio(F.col("correct_accepted"), F.col("expected_values")).alias("value")),
    )).alias("m")).select("m.*")
    lists = values.groupBy("metric").agg(F.sort_array(F.collect_list("value")).alias("v"))  # a number for each draw
    at = lambda q: F.get("v", F.floor(F.lit(q) * (F.size("v") - 1)).cast("int"))
    return lists.select("metric", at(0.025).alias("low"), at(0.975).alias("high"))


def latency_percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Median, and the value at the upper 95th place."""
    return rows.groupBy(*by).agg(F.expr(f"percentile(`{value}`, 0.5)").alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by `{value}`)").alias("p95"))


def wrong_accepted(fields: DataFrame) -> DataFrame:
    return fields.where("state = 'verified' and not coalesce(correct, false)")


def failure_examples(cases: DataFrame, fields: DataFrame) -> DataFrame:
    """Cases that failed or have wrong fields, with the names of those."""
    wrong = fields.where("not coalesce(correct, false)").groupBy("case_id").agg(F.array_sort(F.collect_list("field")).alias("wrong_fields"))
    return cases.join(wrong, "case_id", "left").where("failure is not null or wrong_fields is not null").select("case_id", "site", "failure", F.coalesce("wrong_fields", F.array().cast("array<string>")).alias("wrong_fields"))


def value_supported(raw: Column, value: Column, kind: Column) -> Column:
    """Whether a cited raw text supports a value: one number in it, of the same amount; the same truth word; or the
    text, or another name of a month or year."""
    numbers = F.regexp_extract_all(raw, F.lit(r"(?<![\d.])-?\d+(?:,\d{3})*(?:\.\d+)?(?![\d.])"), 0)
    amount = F.replace(F.get(numbers, F.lit(0)), F.lit(","), F.lit(""))
    same = F.expr("true") & (_plain_decimal(amount) == _plain_decimal(value))
    low, text = F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " "))), F.lower(F.trim(F.regexp_replace(raw, r"(?U)\s+", " ")))
    other = F.when(low == "month", F.array(*map(F.lit, ("monthly", "/month", "per month")))).when(low == "year", F.array(*map(F.lit, ("yearly", "annual", "annually", "/year", "per year")))).otherwise(F.array().cast("array<string>"))
    words = (low != "") & (text.contains(low) | F.exists(other, lambda w: text.contains(w)))
    whole = (kind != "integer") | ~_plain_decimal(amount).contains(".")
    out = F.when(kind.isin("number", "integer"), (F.size(numbers) == 1) & same & whole).when(kind == "boolean", value.isin("true", "false") & text.contains(low)).otherwise(words)
    return F.coalesce(out & raw.isNotNull() & value.isNotNull() & (F.trim(raw) != ""), F.lit(False))


def _plain_decimal(text: Column) -> Column:
    """Digits in one spelling: no leading zeros, no trailing fraction zeros, no minus before zero; exact at any length."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(F.regexp_replace(text, r"^-", ""), r"^0+(?=\d)", "")
    body = F.when(body.contains("."), F.regexp_replace(F.regexp_replace(body, r"0+$", ""), r"\.$", "")).otherwise(body)
    return F.when(body == "0", "0").otherwise(F.concat(sign, body))


def label_violations(labels: DataFrame) -> DataFrame:
    """Rules that blind labels break, an array for each (site_id, field): state, reviewer_time_seconds, plan_name with
    manifest_plan_name, judgment, rationale, value, n_evidence, n_candidates, ambiguity, labeling_mode."""
    c = F.col
    rules = {
        "invalid state": ~c("state").isin("verified", "missing", "conflicting", "blocked", "unverified") | c("state").isNull(),
        "no measured reviewer time": c("reviewer_time_seconds").isNull() | (c("reviewer_time_seconds") < 0),
        "wrong plan": ~c("plan_name").eqNullSafe(c("manifest_plan_name")),
        "not blind": ~c("labeling_mode").eqNullSafe(F.lit("blind")),
        "no evidence": (c("state") == "verified") & (F.coalesce("n_evidence", F.lit(0)) == 0),
        "no judgment": (c("state") == "verified") & ~F.coalesce(c("judgment").isin("explicit", "interpreted"), F.lit(False)),
        "no rationale": (c("state") == "verified") & (c("judgment") == "interpreted") & (F.coalesce("rationale", F.lit("")) == ""),
        "ambiguous but verified": (c("state") == "verified") & F.coalesce(c("ambiguity") != "", F.lit(False)),
        "too few candidates": (c("state") == "conflicting") & (F.coalesce("n_candidates", F.lit(0)) < 2),
        "unsupported value": c("state").isin("missing", "blocked", "unverified") & (c("value").isNotNull() | (F.coalesce("n_evidence", F.lit(0)) > 0)),
    }
    return labels.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()])))


def common_scopes(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """pairs (page_key, claim_id, plan_id, value_id) with the lowest node that contains both."""

    def holds(n: Column, c: str) -> Column:
        return (n["node_id"] <= F.col(c)) & (F.col(c) <= n["last_id"])

    around = F.filter("nodes", lambda n: holds(n, "plan_id") & holds(n, "value_id"))
    lowest = F.element_at(F.transform(around, lambda n: F.struct(n["node_id"].alias("node_id"), n["tag"].alias("tag"))), -1)
    own = let(lowest, lambda n: F.struct(n["node_id"].alias("node_id"), node_path(F.col("nodes"), n["node_id"]).alias("path"), n["tag"].alias("tag")))
    return pairs.join(pages.select("page_key", "nodes"), "page_key").where(F.size(around) > 0).select("page_key", "claim_id", own.alias("common"))


def agreement(first: DataFrame, second: DataFrame, compared: list[str]) -> DataFrame:
    """(site_id, field, agrees): two reviewers' labels, null-safe in every compared column."""
    a, b = first.alias("a"), second.alias("b")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, ["site_id", "field"], "full_outer").select("site_id", "field", F.coalesce(same, F.lit(False)).alias("agrees"))


def human_row_errors(proposed: DataFrame, truth: DataFrame) -> DataFrame:
    """(site, field, error) where a reviewer's row differs from the truth; error null where it is right."""
    context = F.lit(False)
    for c in ("value", "unit", "currency", "billing_period", "conditions"):
        context = context | ~F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}"))
    error = (
        F.when(F.col("p.field").isNull(), "field is not labelled").when(F.col("t.field").isNull(), "field is not expected").when(~F.col("p.plan_name").eqNullSafe(F.col("t.plan_name")), "wrong named plan")
        .when(~F.col("p.state").eqNullSafe(F.col("t.state")), "wrong state").when((F.col("p.state") == "verified") & context, "wrong value or plan context")
        .when(~F.col("p.state").isin("verified", "conflicting") & F.col("p.value").isNotNull(), "unsupported value or evidence for nonverified state")
    )
    return proposed.alias("p").join(truth.alias("t"), ["site", "field"], "full_outer").select("site", "field", error.alias("error"))


def gate(cases: DataFrame, fields: DataFrame, costs: DataFrame, hourly_rate_usd: float) -> DataFrame:
    """One row of eleven checks and the decision, over held-out cases for quality and all cases for cost and requests.

    cases: site, split, review/blind/baseline seconds, request counts with max_http_requests, corrected and baseline
    errors, access_failure_codes, access_policy_violations, row_done (no corrected error, every field verified);
    fields: site, split, field, states, correct, evidence_valid; costs: site, compute_usd, provider_usd.
    """
    held = field_summary(fields.where("split = 'held_out'"))
    critical = fields.where("split = 'held_out'").agg(F.count_if(F.col("field").isin(*CRITICAL) & (F.col("state") == "verified") & ~F.coalesce("correct", F.lit(False))).alias("critical_wrong"))
    own = F.col("split") == "held_out"
    codes = F.coalesce("access_failure_codes", F.array().cast("array<string>"))
    all_cases = cases.join(costs, "site", "left").agg(
        F.sum(F.when(own, F.col("manual_baseline_seconds"))).alias("base_s"), F.sum(F.when(own, F.col("review_seconds"))).alias("review_s"), F.sum(F.when(own, F.col("corrected_row_errors"))).alias("corrected"),
        F.sum(F.when(own, F.col("manual_baseline_errors"))).alias("baseline"), F.count_if(own & (F.size(codes) > 0)).alias("access_failures"), F.count_if(F.arrays_overlap(codes, F.array(*map(F.lit, POLICY_STOPS)))).alias("stops"),
        F.count_if(F.size("access_policy_violations") > 0).alias("violations"), F.bool_and(F.col("http_requests_started") + F.col("preflight_http_requests_started") <= F.col("max_http_requests")).alias("request_bounds"),
        F.count_if("row_done").alias("rows_done"), F.sum(F.col("review_seconds") + F.col("blind_label_seconds") + F.col("manual_baseline_seconds")).alias("labor_s"), F.sum(F.col("compute_usd") + F.col("provider_usd")).alias("charges"),
    )
    one = held.select("*", F.lit(1).alias("k")).join(critical.withColumn("k", F.lit(1)), "k").join(all_cases.withColumn("k", F.lit(1)), "k")
    cost = F.bround((F.col("labor_s") / 3600 * hourly_rate_usd + F.col("charges")) / F.nullif("rows_done", F.lit(0)), 4)
    yes = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "critical_claims": F.col("critical_wrong") == 0,
        "evidence_valid_check": F.col("evidence_checked") == F.col("evidence_valid"),
        "precision": yes(F.col("field_precision") >= GATE["min_precision"]),
        "accepted_count": F.col("accepted") >= GATE["min_accepted"],
        "recall": yes(F.col("field_recall") >= GATE["min_recall"]),
        "review_time": yes(ratio(F.col("base_s") - F.col("review_s"), F.col("base_s")) >= GATE["min_time_reduction"]),
        "review_error": yes(F.col("corrected") <= F.col("baseline")),
        "robots_scope_policy": (F.col("stops") == 0) & (F.col("violations") == 0),
        "access_failure_count": F.col("access_failures") <= GATE["max_access_failures"],
        "request_bounds": yes(F.col("request_bounds")),
        "cost_ceiling": yes(cost <= GATE["max_cost_per_row_usd"]),
    }
    out = one.select(*[v.alias(k) for k, v in checks.items()], cost.alias("usd_per_row"))
    every = F.lit(True)
    for k in checks:
        every = every & F.col(k)
    return out.withColumn("decision", F.when(every, "go").otherwise("no-go"))


def refusals(cases: DataFrame) -> DataFrame:
    """Cases that lack what finalising needs, with the reasons; finalising needs an empty result."""
    c = F.col
    reasons = {
        "no live measurement": c("live_elapsed_seconds").isNull(), "no request count": c("http_requests_started").isNull() | (c("http_requests_started") < 0), "no baseline": c("manual_baseline_seconds").isNull() | c("manual_baseline_errors").isNull(),
        "no review": c("review_seconds").isNull(), "no corrected row": c("corrected_row_errors").isNull(), "no blind labels": c("blind_label_seconds").isNull(), "no code revision": F.coalesce("code_revision", F.lit("")) == "",
        "one reviewer": (c("split") == "held_out") & ~F.coalesce("has_two_reviewers", F.lit(False)), "agreement after capture": (c("split") == "held_out") & ~F.coalesce(c("confirmed_at") <= c("captured_at"), F.lit(False)),
    }
    return cases.withColumn("reasons", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in reasons.items()]))).where("size(reasons) > 0")


def blocked(codes: Column) -> Column:
    return F.arrays_overlap(codes, F.array(*map(F.lit, BLOCKING)))
