"""Independent check of cited claims: that a page, as it was captured, ties a value to a plan as a reviewer says.

A claim cites evidence, and evidence cites nodes of one capture by locator, in roles (plan, value, qualifier), within a
scope. A page is parsed once for all that is cited of it; what follows is arithmetic over intervals of node numbers, steps
of locators and cells of tables, and rules over the nodes' texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.dom import cited_nodes, let
from factloom.functions.scalars import squeezed
from factloom.operators.asof import first_failure
from factloom.operators.evaluate import value_supported

#: Roles, relations, kinds of judgment, signs of currencies, words for periods, tags of headings.
ROLES, JUDGMENTS = ("plan", "value", "qualifier"), ("explicit", "interpreted")
SIGN_OF = {"EUR": "€", "GBP": "£", "INR": "₹"}
WORD_OF = {"month": "monthly", "year": "annual"}
ALL_PLANS = r"(?U)\b(all|every) plans\b"

#: What a claim has: its field and what was asked for, what it says, and what it cites.
CLAIM = (
    "claim_id string, field_name string, kind string, asked_plan string, plan_name string, state string, value string, unit string, billing_period string, currency string, judgment string, rationale string, ambiguity string, "
    "evidence array<struct<source_url:string,snapshot_hash:string,fetched_at:string,scope_locator:string,relation:string,raw_value:string,nodes:array<struct<role:string,locator:string,excerpt:string>>>>"
)


def _word(text: Column, before: str, word: Column, after: str) -> Column:
    """Whether the word stands in the text, literally, between what the patterns before and after it ask."""
    literal = F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.rlike(text, F.concat(F.lit(before), literal, F.lit(after)))


def _no(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def _common_steps(a: Column, b: Column) -> Column:
    """How many steps two locators share from the top: the depth of the lowest node that contains both."""
    x, y = F.split(a, " > "), F.split(b, " > ")
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda i: F.element_at(x, i) == F.element_at(y, i))
    return let(same, lambda s: F.when(F.array_position(s, False) > 0, F.array_position(s, False) - 1).otherwise(F.size(s).cast("bigint")))


def _of_role(role: str) -> Column:
    return F.filter("nodes", lambda n: n["role"] == role)


def _evidence_code() -> Column:
    """The first rule that one piece of evidence breaks; scope and nodes as the page has them."""
    scope, plan, value = F.col("scope"), F.get(_of_role("plan"), F.lit(0)), F.get(_of_role("value"), F.lit(0))
    inside = lambda n: (n["at"]["node_id"] >= scope["node_id"]) & (n["at"]["node_id"] <= scope["last_id"])
    depth = F.size(F.split("scope_locator", " > "))
    local = (_common_steps(plan["locator"], value["locator"]) == depth) & ~scope["tag"].isin("html", "body")
    plan_holds = (value["at"]["node_id"] > plan["at"]["node_id"]) & (value["at"]["node_id"] <= plan["at"]["last_id"])
    within = lambda n: (n["at"]["cell_id"] > scope["node_id"]) & (n["at"]["cell_id"] <= scope["last_id"])
    same_column = (scope["tag"] == "table") & within(plan) & within(value) & (plan["at"]["cell"] == value["at"]["cell"])
    said = F.lower(F.array_join(F.transform(_of_role("qualifier"), lambda n: n["at"]["text"]), " "))
    context = F.array_join(F.flatten(F.array(*[F.transform(_of_role(r), lambda n: n["at"]["text"]) for r in ROLES])), " ")
    relation = F.coalesce("relation", F.lit("same_scope"))

    def told(c: str) -> Column:
        words = F.create_map(*[F.lit(x) for pair in WORD_OF.items() for x in pair])[F.col(c)]
        return F.col(c).isNull() | (F.col(c) == "") | F.lower(context).contains(F.lower(c)) | F.coalesce(F.lower(context).contains(words), F.lit(False))

    signs = F.create_map(*[F.lit(x) for pair in SIGN_OF.items() for x in pair])[F.col("currency")]
    money = F.col("currency").isNull() | (F.col("currency") == "") | F.lower(context).contains(F.lower("currency")) | F.coalesce(context.contains(signs), F.lit(False))
    return first_failure([
        (F.col("html").isNull(), "unbound capture"),
        (_no(scope["shown"]), "scope not found"),
        (F.coalesce(F.size("nodes"), F.lit(0)) == 0, "no nodes"),
        (F.exists("nodes", lambda n: _no(n["role"].isin(*ROLES))), "invalid role"),
        (F.exists("nodes", lambda n: _no(n["at"]["shown"])), "node not found"),
        (F.exists("nodes", lambda n: _no(inside(n))), "outside scope"),
        (F.exists("nodes", lambda n: _no(squeezed(F.coalesce(n["excerpt"], F.lit(""))) == n["at"]["text"])), "excerpt changed"),
        (plan.isNull() | value.isNull(), "no plan or value node"),
        (_no(_word(plan["at"]["text"], r"(?iU)(?<!\w)", F.col("asked_plan"), r"(?!\w)")), "different plan"),
        (_no(_word(value["at"]["text"], r"(?<!\d)", F.col("raw_value"), r"(?!\d)")), "raw value absent"),
        ((relation == "same_scope") & _no(local), "no shared scope"),
        ((relation == "same_scope") & (scope["headings"] > 1) & _no(plan_holds), "several plan headings"),
        ((relation == "table_column") & _no(same_column), "not one column"),
        ((relation == "shared_all_plans") & _no(said.rlike(ALL_PLANS)), "no all-plans statement"),
        (~relation.isin("same_scope", "table_column", "shared_all_plans"), "unknown relation"),
        (_no(value_supported(F.col("raw_value"), F.col("value"), F.col("kind"))), "unsupported value"),
        (_no(told("unit")), "unit absent"),
        (_no(told("billing_period")), "billing period absent"),
        (_no(money), "currency absent"),
        ((F.col("state") == "verified") & F.coalesce(F.col("ambiguity") != "", F.lit(False)), "ambiguous"),
    ])


def check_claims(claims: DataFrame, captures: DataFrame) -> DataFrame:
    """(claim_id, code, value_locators): the first rule that a claim (CLAIM) breaks, null for a sound one, and the
    locators of its values. captures (url, snapshot_hash, fetched_at, html) are bound by all three; of repeats one counts.

    Evidence moves once, to its capture, and evidence of one capture is read together, so that a page is parsed once
    for what stands there in a row. A claim without evidence, and null parts, break the rule that needs them.
    """
    key = ["source_url", "snapshot_hash", "fetched_at"]
    cited = claims.select("claim_id", "kind", "asked_plan", "state", "value", "unit", "billing_period", "currency", "ambiguity", F.posexplode("evidence").alias("seq", "e")).select("*", "e.*").drop("e")
    pages = captures.select(F.col("url").alias("source_url"), "snapshot_hash", "fetched_at", "html").dropDuplicates(key)
    bound = cited.join(pages, key, "left").repartition(*key).sortWithinPartitions(*key)
    asked = F.concat(F.array("scope_locator"), F.transform(F.coalesce("nodes", F.array().cast("array<struct<role:string,locator:string,excerpt:string>>")), lambda n: n["locator"]))
    found = bound.withColumn("found", cited_nodes("html", asked)).withColumn("scope", F.get("found", F.lit(0)))
    found = found.withColumn("nodes", F.transform("nodes", lambda n, i: F.struct(n["role"].alias("role"), n["locator"].alias("locator"), n["excerpt"].alias("excerpt"), F.get("found", i + 1).alias("at"))))
    checked = found.withColumn("code", _evidence_code()).withColumn("values", F.transform(_of_role("value"), lambda n: n["locator"]))
    each = checked.groupBy("claim_id").agg(
        F.min(F.when(F.col("code").isNotNull(), F.struct("seq", "code"))).alias("failed"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("values", F.array().cast("array<string>")).alias("v")))), lambda s: s["v"])).alias("value_locators"),
    )
    own = first_failure([
        (_no((F.col("asked_plan") != "") & (F.col("plan_name") == F.col("asked_plan"))), "plan not named"), (F.col("kind").isNull(), "unknown field"), (F.coalesce(F.size("evidence"), F.lit(0)) == 0, "no evidence"),
        (_no(F.col("judgment").isin(*JUDGMENTS)), "no judgment"), ((F.col("judgment") == "interpreted") & (F.coalesce("rationale", F.lit("")) == ""), "no rationale"),
    ])
    return claims.withColumn("own", own).join(each, "claim_id", "left").select("claim_id", F.coalesce("own", "failed.code").alias("code"), F.coalesce("value_locators", F.array().cast("array<string>")).alias("value_locators"))
