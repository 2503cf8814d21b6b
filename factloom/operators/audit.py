"""Audits of an evaluation: coverage of sites and fields, checks of a page corpus, ledgers, agreements and counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import scalar
from factloom.operators.evaluate import GATE

#: States that are counted, and judgments of a literal label.
STATES = ("verified", "conflicting", "missing", "blocked", "unverified")
LITERAL, INTERPRETATION = "literal", "interpretation"


def _named(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in their order; a rule that cannot be told does not hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()]))


def coverage(by: list[str], **sides: DataFrame) -> DataFrame:
    """A row for each key of any side: how many rows each side has for it, and complete, if that is one for all. Rows
    are counted where they are, so one exchange of partial counts serves all sides. Null keys are one key."""
    tagged = [df.select(*by, *[F.lit(int(n == name)).cast("bigint").alias(n) for n in sides]) for name, df in sides.items()]
    counts = reduce(DataFrame.unionByName, tagged).groupBy(*by).agg(*[F.sum(n).alias(n) for n in sides])
    return counts.withColumn("complete", reduce(lambda a, b: a & b, [F.col(n) == 1 for n in sides]))


def set_differences(wanted: DataFrame, found: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, missing, extra, same): values of wanted that found lacks, the other way about, and whether the sets are
    equal. Repeats do not count; a null value is a value, which same counts and the lists do not show."""
    sides = [df.select(*by, value, F.lit(w).alias("__wanted"), F.lit(not w).alias("__found")) for df, w in ((wanted, True), (found, False))]
    each = sides[0].unionByName(sides[1]).groupBy(*by, value).agg(F.bool_or("__wanted").alias("__wanted"), F.bool_or("__found").alias("__found"))
    only = lambda c: F.array_sort(F.collect_list(F.when(~F.col(c), F.col(value))))
    return each.groupBy(*by).agg(only("__found").alias("missing"), only("__wanted").alias("extra"), F.bool_and(F.col("__wanted") & F.col("__found")).alias("same"))


def last_facts(facts: DataFrame) -> DataFrame:
    """The last fact (by fact_idx) of each case_id, grp and key: (case_id, grp, key, state, value)."""
    return facts.groupBy("case_id", "grp", "key").agg(F.max_by(F.struct("state", "value"), "fact_idx").alias("f")).select("case_id", "grp", "key", "f.state", "f.value")


def corpus_checks(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, checks, failed, found, passed) of each case (case_id, expected_type, page_type, expected and
    expected_states: arrays of [grp, key, what], forbidden_values): its type, each wanted value and state of the last
    fact of its name, and that no fact has a forbidden value. Null lists are empty; a fact that is not there has
    neither value nor state."""
    listed = lambda c, kind: F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.struct(F.lit(kind).alias("kind"), x[0].alias("grp"), x[1].alias("key"), x[2].alias("want")))
    rows = cases.select("case_id", F.inline(F.concat(listed("expected", "value"), listed("expected_states", "state"))))
    had = F.when(F.col("kind") == "value", F.col("value")).otherwise(F.col("state"))
    named = rows.join(last_facts(facts), ["case_id", "grp", "key"], "left").select("case_id", had.eqNullSafe(F.col("want")).alias("ok"))
    shown = facts.where("value is not null").select("case_id", "value", F.lit(False).alias("absent")).distinct()
    barred = cases.select("case_id", F.explode("forbidden_values").alias("value")).join(shown, ["case_id", "value"], "left").select("case_id", F.coalesce("absent", F.lit(True)).alias("ok"))
    typed = cases.select("case_id", F.col("page_type").eqNullSafe(F.col("expected_type")).alias("ok"))
    every = typed.union(named).union(barred).groupBy("case_id").agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("ok")).alias("failed"))
    found = facts.groupBy("case_id").agg(F.count_if(F.col("state") == "found_in_source").alias("found"))
    return every.join(found, "case_id", "left").select("case_id", "checks", "failed", F.coalesce("found", F.lit(0)).alias("found"), (F.col("failed") == 0).alias("passed"))


def corpus_totals(checked: DataFrame) -> DataFrame:
    """One row: cases, passed, checks, found."""
    return checked.agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.coalesce(F.sum("checks"), F.lit(0)).alias("checks"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))


def process_counters(fetches: DataFrame, fields: DataFrame, jobs: DataFrame) -> DataFrame:
    """(counter, value) over a process's fetches (error, html), fields (state) and jobs (elapsed_seconds): one pass over
    each; an unverified field is one whose evidence failed its check."""
    empty = F.col("error").isNull() & (F.trim(F.regexp_replace("html", r"(?U)\s+", " ")) == "")
    parts = [
        fetches.agg(F.count("error").alias("fetch_failures"), F.count_if(empty).alias("empty_pages")),
        fields.agg(*[F.count_if(F.col("state") == s).alias(f"{s}_fields") for s in STATES], F.count_if(F.col("state") == "unverified").alias("evidence_check_failures")),
        jobs.agg(F.count(F.lit(1)).alias("jobs"), F.sum("elapsed_seconds").alias("elapsed_seconds_total")),
    ]
    long = [p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in p.columns]))) for p in parts]
    return reduce(DataFrame.union, long)


def ledger_violations(ledger: DataFrame, inventory: DataFrame) -> DataFrame:
    """(site, violations) of a cost ledger (site, compute_usd, provider_usd, compute_basis, provider_basis) against an
    inventory (site, max_provider_spend_usd); sites that either side lacks are violations, too."""
    c = F.col
    both = ledger.withColumn("booked", F.lit(True)).join(inventory.select("site", "max_provider_spend_usd", F.lit(True).alias("approved")), "site", "full_outer")
    booked = c("booked").isNotNull()
    rules = {
        "not in the ledger": ~booked, "not approved": c("approved").isNull(),
        "charges": booked & (c("compute_usd").isNull() | (c("compute_usd") < 0) | c("provider_usd").isNull() | (c("provider_usd") < 0)),
        "basis": booked & ((F.coalesce("compute_basis", F.lit("")) == "") | (F.coalesce("provider_basis", F.lit("")) == "")),
        "above the ceiling": c("provider_usd") > c("max_provider_spend_usd"),
    }
    return both.select("site", _named(rules).alias("violations"))


def agreement_violations(agreements: DataFrame) -> DataFrame:
    """agreements (confirmed_by, confirmed_at: ISO 8601 text, analyst_hourly_rate_usd: text, thresholds: map) with
    violations: who and when, a positive rate, a time with its zone, and exactly the thresholds of the gate."""
    c = F.col
    at, rate = F.coalesce("confirmed_at", F.lit("")), c("analyst_hourly_rate_usd").try_cast("double")
    gate = F.array_sort(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(float(v)).alias("value")) for k, v in GATE.items()]))
    signed = (F.coalesce("confirmed_by", F.lit("")) != "") & (at != "")
    rules = {
        "not confirmed": ~signed, "no time": (at != "") & F.try_to_timestamp(at).isNull(), "no zone": F.try_to_timestamp(at).isNotNull() & ~at.rlike(r"T.*(Z|[+-]\d\d:\d\d)$"),
        "rate": rate.isNull() | ~(rate > 0), "thresholds": ~F.array_sort(F.map_entries("thresholds")).eqNullSafe(gate),
    }
    return agreements.withColumn("violations", _named(rules))


def literal_label_violations(labels: DataFrame) -> DataFrame:
    """labels of the first label format with violations: state, reviewer_time_seconds, judgment, interpretation_note,
    n_candidates, and for a verified one value, unit, currency, raw_value, excerpt, title and kind of the field, and
    on_page (the excerpt is a visible block of the capture it cites). The excerpt must be the title, a mark and the
    raw value, and the raw value must parse to value, unit and currency. A minus after the title is a mark, so negative
    amounts are never tied."""
    c = F.col
    verified, note = c("state") == "verified", F.coalesce("interpretation_note", F.lit(""))
    backed = c("value").isNotNull() & (F.coalesce("excerpt", F.lit("")) != "") & (F.coalesce("raw_value", F.lit("")) != "") & F.coalesce("on_page", F.lit(False))
    at = F.position(F.lower("title"), F.lower("excerpt"))
    after = F.regexp_replace(F.substring(c("excerpt"), at + F.length("title"), F.length("excerpt")), r"(?U)^[\s:\-–]+|\s+$", "")
    tied = (at > 0) & (after == c("raw_value"))
    parsed = scalar(c("raw_value"), c("kind"))
    rules = {
        "invalid state": ~F.coalesce(c("state").isin(*STATES), F.lit(False)),
        "no measured reviewer time": c("reviewer_time_seconds").isNull() | (c("reviewer_time_seconds") < 0),
        "no judgment": ~F.coalesce(c("judgment").isin(LITERAL, INTERPRETATION), F.lit(False)),
        "interpretation": (c("judgment") == INTERPRETATION) & (verified | (note == "")),
        "no source": verified & ~backed,
        "not tied to its label": verified & backed & ~tied,
        "disagrees with its claim": verified & backed & tied & ~(c("p.value").eqNullSafe(c("value")) & c("p.unit").eqNullSafe(c("unit")) & c("p.currency").eqNullSafe(c("currency"))),
        "too few candidates": (c("state") == "conflicting") & (F.coalesce("n_candidates", F.lit(0)) < 2),
    }
    return labels.withColumn("p", parsed).withColumn("violations", _named(rules)).drop("p")


def all_evidence(fields: DataFrame, *own: str) -> DataFrame:
    """A row for each piece of evidence of fields: their own, and their candidates' (candidates: array of structs that
    hold an array evidence), with the columns own."""
    told = F.flatten(F.transform(F.col("candidates"), lambda x: x["evidence"]))
    return fields.select(*own, F.inline(F.flatten(F.array_compact(F.array(F.col("evidence"), told)))))
