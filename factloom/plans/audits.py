"""Queries of audits, addresses and evidence, and of pages whose outcome varies with their rows, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.addresses import chosen_address, resolution_code
from factloom.functions.dom import nodes, tagged
from factloom.operators import audit, automatic, candidates, claims, crawl, evaluate, inventory, plans, store
from factloom.plans.web import built
from factloom.sources.captures import decode_html, from_wire, plain_base64, read_pages, to_wire
from factloom.sources.tables import spread, table


def _pick(k: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _joined(violations: str = "violations") -> Column:
    return F.array_join(violations, "|").alias(violations)


def public_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hosts with two addresses, whose numbers are spread over all of IPv4."""
    k = F.col("event_id")
    number = lambda by, add: F.pmod(k * by + add, F.lit(1 << 32))
    dotted = lambda n: F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    both = F.when(k % 50 == 0, None).when(k % 50 == 1, F.array().cast("array<string>")).otherwise(F.array(dotted(number(2654435761, 7)), dotted(number(40503001, 99))))
    rows = table(spark, sf_dir, "events").select("event_id", both.alias("addresses"))
    return rows.select("event_id", resolution_code(F.col("addresses")).alias("code"), chosen_address(F.col("addresses")).alias("address"))


def wire_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to their wire form and back; every seventh is cut on the way."""
    captures = read_pages(spark, sf_dir)
    sent = to_wire(captures).withColumn("wire", F.when(F.col("page_key").cast("bigint") % 7 == 0, F.left("wire", F.lit(40))).otherwise(F.col("wire")))
    return from_wire(sent).select(F.col("page_key").cast("bigint").alias("page_id"), "sound", plain_base64(F.col("raw")).alias("raw_base64"), F.when(F.col("sound"), F.col("html")).alias("html"), "snapshot_hash", "content_type")


def evidence_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of every shown list item of each page, found again by locator from one parse of the page."""
    captures = read_pages(spark, sf_dir).withColumn("job_id", F.col("page_key"))
    blocks = candidates.visible_blocks(nodes(captures)).where("tag = 'li'").select(F.col("page_key").alias("job_id"), "node_id", "locator")
    evidence = blocks.join(captures.select("job_id", "snapshot_hash"), "job_id")
    found = store.evidence_nodes(evidence, captures)
    return found.groupBy(F.col("job_id").cast("bigint").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "node_html"))), lambda x: x["node_html"]), "|").alias("sources"))


def snapshot_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as reads of their order's snapshot; some ask as another tenant or for another hash."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("tenant"), F.col("o_orderkey").cast("string").alias("job_id"), F.md5(F.col("o_orderkey").cast("string")).alias("snapshot_hash"), F.col("o_orderstatus").alias("encoding"))
    own = orders.select(F.col("tenant").alias("owner"), "job_id")
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    asked = table(spark, sf_dir, "lineitem").withColumn("job_id", k.cast("string")).join(own, "job_id").select(
        "l_orderkey", "l_linenumber", "job_id", F.when(line % 3 == 0, F.concat("owner", F.lit("x"))).otherwise(F.col("owner")).alias("tenant"), F.md5((k + F.when(line % 5 == 0, 1).otherwise(0)).cast("string")).alias("snapshot_hash"))
    return store.answered(asked, orders, ["tenant", "job_id", "snapshot_hash"]).select("l_orderkey", "l_linenumber", F.col("found.encoding").alias("encoding"))


def rt_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of suppliers with 40, 100 or 300 pairs of label and value in falling order of their labels: the first 250 claims
    count, and of their facts the first 60 are shown."""
    k = F.col("s_suppkey")
    m = F.element_at(F.array(*map(F.lit, (40, 100, 300))), (k % 3 + 1).cast("int"))
    items = F.array_join(F.transform(F.sequence(F.lit(1), m), lambda i: F.concat(F.lit("<li>L"), F.lpad((m - i + 1).cast("string"), 3, "0"), F.lit(": v"), i.cast("string"), F.lit("</li>"))), "")
    html = F.concat(F.lit("<html><body><ul>"), items, F.lit("</ul></body></html>"))
    pages = spread(table(spark, sf_dir, "supplier")).select(k.cast("string").alias("page_key"), F.lit("https://rt.example/").alias("url"), html.alias("html"), F.encode(html, "UTF-8").alias("raw"), F.lit("text/html; charset=utf-8").alias("content_type"))
    facts = automatic.automatic_facts(pages)
    return facts.select(F.col("page_key").cast("bigint").alias("s_suppkey"), F.col("fact_idx").cast("int").alias("fact_idx"), "label", "state", "value")


def page_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of a page inventory before its execution: what each breaks."""
    k = F.col("c_custkey")
    host = F.concat(F.lit("s"), F.when(k % 15 == 0, k - 1).otherwise(k).cast("string"), F.lit(".example"))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.when(k % 7 == 0, "http://").otherwise("https://"), host, F.lit("/p")).alias("seed_url"), host.alias("allowed_host"), F.when(k % 4 == 0, "11").otherwise(inventory.GETS).alias("max_gets"),
        F.when(k % 5 == 0, "PENDING").otherwise("r1").alias("approval_record"), F.when(k % 6 == 1, "DENIED").otherwise("ALLOWED").alias("robots_status"), F.lit("public").alias("access_basis"),
    )
    return inventory.page_target_violations(rows, execution=True).select("c_custkey", _joined())


def inventory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as checked sites of an inventory: its totals, and whether it may be run."""
    k = F.col("s_suppkey")
    faults = lambda by, name: F.when(k % by == 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "supplier").select(F.when(k % 3 == 0, "held_out").otherwise("development").alias("split"), (k % 50).cast("string").alias("max_http_requests"), (k % 4 * 0.25).cast("string").alias("max_provider_spend_usd"), faults(5, "x").alias("pending"), faults(7, "y").alias("violations"))
    return inventory.target_totals(rows)


def evidence_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as page rows of twenty cases, some with other bytes than their hash says, and lines as evidence, some of another
    case or hash: whether the first page row of an evidence's key has its bytes."""
    o, text = F.col("o_orderkey"), F.col("o_orderpriority")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("case_id"), F.concat(F.lit("u"), (o % 5).cast("string")).alias("url"), F.lit("t").alias("fetched_at"), F.sha2(text, 256).alias("snapshot_hash"),
                                                    F.encode(F.when(o % 40 == 0, "other").otherwise(text), "UTF-8").alias("raw"), o.alias("page_seq"))
    line = F.col("l_linenumber")
    evidence = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == o).select(
        "l_orderkey", "l_linenumber", (F.col("case_id") + F.when(line == 5, 1).otherwise(0)).alias("case_id"), F.col("url").alias("source_url"), "fetched_at", F.when(line == 3, F.sha2(F.lit("other"), 256)).otherwise(F.col("snapshot_hash")).alias("snapshot_hash"))
    return evaluate.evidence_bound(evidence, orders.drop("o_orderkey")).select("l_orderkey", "l_linenumber", "bound")


def scope_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as evidence of a case, and its even lines as scopes: whether any evidence lies in any scope."""
    k, line = F.col("l_partkey"), F.col("l_linenumber")
    bound = {"source_url": F.concat(F.lit("u"), (k % 2).cast("string")), "snapshot_hash": F.lit("h"), "fetched_at": F.lit("t")}
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), *[v.alias(n) for n, v in bound.items()], line.alias("line"), k.alias("k"))
    place = lambda n, deep: F.concat(F.lit("html > body > div:nth-of-type("), (n % 12).cast("string"), F.lit(")"), deep)
    evidence = rows.where("line % 2 = 1").withColumn("locator", place(F.col("k"), F.when(F.col("k") % 3 == 0, "").otherwise(" > p:nth-of-type(1)")))
    scopes = rows.where("line % 2 = 0").withColumn("scope_locator", place(F.col("k") + 2, F.when(F.col("k") % 5 == 0, " > p").otherwise("")))
    return evaluate.in_scope(evidence.drop("line", "k"), scopes.drop("line", "k"), ["case_id"]).select(F.col("case_id").alias("l_orderkey"), "evidence_matches")


def rt_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls from each customer over a graph of 1,000 pages with up to four links each: some pages fail, some end a crawl;
    two levels, six attempts at most."""
    k = F.col("c_custkey")
    address = lambda n: F.concat(F.lit("https://f.example/"), n.cast("string"))
    numbers = table(spark, sf_dir, "customer").select((k % 1000).alias("n")).distinct()
    pages = numbers.union(numbers.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: i.cast("bigint"))).alias("n"))).distinct()
    edges = pages.select(F.col("n"), F.posexplode(F.transform(F.sequence(F.lit(0), (F.col("n") % 4).cast("int")), lambda j: (F.col("n") * 7 + j * 13) % 1000)).alias("rank", "m")).select(address(F.col("n")).alias("url"), address(F.col("m")).alias("target"), "rank")
    n = F.col("n")
    outcomes = pages.select(address(n).alias("url"), F.when(n % 11 == 3, "ACCESS_DENIED").when(n % 7 == 2, "HTTP_ERROR").alias("error"))
    seeds = table(spark, sf_dir, "customer").select(k.cast("string").alias("job_id"), address(k % 1000).alias("url"))
    found = crawl.frontier(seeds, edges, outcomes, max_depth=2, max_pages=6)
    return found.select(F.col("job_id").cast("bigint").alias("c_custkey"), "url", "depth", F.col("visit_seq").cast("bigint").alias("visit_seq"), "error")


def rt_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of customers with an entity of three kinds (with the page's own address or another), offers, an overview
    paragraph, pairs of labels and values, a plan's card, and repeats: all their facts, in display order."""
    k = F.col("c_custkey")
    n, kind = k.cast("string"), k % 3
    name = F.concat(F.lit("Acme "), n)
    url = F.concat(F.lit('"url":"https://rt.example/'), F.when(k % 5 == 0, "elsewhere").otherwise(n), F.lit('"'))
    offers = F.concat(F.lit('[{"price":'), n, F.lit(',"priceCurrency":"USD"},{"name":"Big","price":"2.50","priceCurrency":"EUR"},{"price":"1","priceCurrency":"XXX"}]'))
    entity = F.when(kind == 0, F.concat(F.lit('{"@type":"Article","headline":"'), name, F.lit('","description":"An article on '), n, F.lit('","datePublished":"2026-01-02",'), url, F.lit("}")))
    entity = entity.when(kind == 1, F.concat(F.lit('{"@type":"https://schema.org/Product","name":"'), name, F.lit('","offers":'), offers, F.lit(","), url, F.lit("}"))).otherwise(F.concat(F.lit('{"@type":"Organization","name":"Other '), n, F.lit('"}')))
    html = F.concat(
        F.lit("<html><head><title>"), name, F.lit("</title>"), F.when(k % 2 == 0, F.concat(F.lit('<meta name="description" content="About item '), n, F.lit('">'))).otherwise(""), F.lit('<script type="application/ld+json">'), entity,
        F.lit("</script></head><body><h1>"), name, F.lit("</h1><aside><p>A paragraph in an aside, long enough, but it is no overview at all.</p></aside><p>This paragraph tells what item "), n, F.lit(" is good for in general.</p><ul><li>Color: red"), (k % 3).cast("string"), F.lit("</li>"),
        F.when(k % 4 == 0, "<li>Color: blue</li>").otherwise(""), F.lit("<li>Headline: "), name, F.lit("</li></ul><dl><dt>Size</dt><dt>Other</dt><dd>"), n, F.lit(" cm</dd></dl><section><h3>Tier A"), n, F.lit("</h3><p>USD "), n, F.lit(".50 per seat billed monthly</p></section></body></html>"),
    )
    pages = spread(table(spark, sf_dir, "customer")).select(n.alias("page_key"), F.concat(F.lit("https://rt.example/"), n).alias("url"), html.alias("html"), F.encode(html, "UTF-8").alias("raw"), F.lit("text/html; charset=utf-8").alias("content_type"))
    facts = automatic.automatic_facts(pages)
    return facts.select(F.col("page_key").cast("bigint").alias("c_custkey"), F.col("fact_idx").cast("int").alias("fact_idx"), "grp", "key", "label", "state", "value", "currency", "billing_period", F.size("alternatives").cast("int").alias("alternatives"), "overview_text")


def claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about the plan of a part's page, tied to it by a scope, a table column or words on all plans, with faults that
    follow from the key; what each breaks."""
    k = F.col("p_partkey")
    num, plan = k.cast("string"), F.concat(F.lit("Plan "), k.cast("string"))
    html = F.concat(
        F.lit("<html><body><section><h3>"), plan, F.lit("</h3><p>USD "), num, F.lit(".50 per month</p></section><table><tr><th>Feature</th><th>"), plan, F.lit("</th><th>Other</th></tr><tr><td>Price</td><td>USD "), num,
        F.lit("</td><td>USD 9</td></tr></table><p>All plans include <i hidden>no</i> support</p><div><h3>"), plan, F.lit("</h3><h4>Other</h4><p>USD "), num, F.lit("</p></div></body></html>"),
    )
    by, fault = k % 3, F.floor(k / 3) % 5
    body = "html:nth-of-type(1) > body:nth-of-type(1)"
    at = {n: F.lit(f"{body} > {p}") for n, p in {
        "section": "section:nth-of-type(1)", "named": "section:nth-of-type(1) > h3:nth-of-type(1)", "price": "section:nth-of-type(1) > p:nth-of-type(1)", "table": "table:nth-of-type(1)",
        "head": "table:nth-of-type(1) > tr:nth-of-type(1) > th:nth-of-type(2)", "own": "table:nth-of-type(1) > tr:nth-of-type(2) > td:nth-of-type(2)", "other": "table:nth-of-type(1) > tr:nth-of-type(2) > td:nth-of-type(3)",
        "all": "p:nth-of-type(1)", "div": "div:nth-of-type(1)", "title": "div:nth-of-type(1) > h3:nth-of-type(1)", "cost": "div:nth-of-type(1) > p:nth-of-type(1)", "gone": "p:nth-of-type(7)",
    }.items()}
    node = lambda role, locator, excerpt: F.struct(F.lit(role).alias("role"), locator.alias("locator"), excerpt.alias("excerpt"))
    usd = F.concat(F.lit("USD "), num)
    local = F.when(fault == 1, F.array(node("plan", at["title"], plan), node("value", at["cost"], usd))).otherwise(
        F.array(node("plan", at["named"], plan), node("value", at["price"], F.concat(usd, F.when(fault == 4, ".51 per month").otherwise(".50  per\nmonth")))))
    column = F.array(node("plan", at["head"], plan), F.when(fault == 1, node("value", at["other"], F.lit("USD 9"))).otherwise(node("value", at["own"], usd)))
    shared = F.array(node("plan", at["named"], plan), F.when(fault == 4, node("value", at["gone"], usd)).otherwise(node("value", at["own"], usd)))
    shared = F.when(fault == 1, shared).otherwise(F.concat(shared, F.array(node("qualifier", at["all"], F.lit("All plans include support")))))
    raw = F.when((by == 0) & (fault == 3), "no such value").when((by == 0) & (fault != 1), F.concat(num, F.lit(".50"))).when((by == 1) & (fault == 1), "9").otherwise(num)
    value = F.when((by == 2) & (fault == 2), (k + 1).cast("string")).when((by == 0) & (fault != 1), F.concat(num, F.lit(".5"))).otherwise(raw)
    evidence = F.struct(
        F.col("url").alias("source_url"), F.when((by == 2) & (fault == 3), "x").otherwise(F.col("snapshot_hash")).alias("snapshot_hash"), F.lit("2026-01-01").alias("fetched_at"),
        F.when((by == 0) & (fault == 1), at["div"]).when((by == 0) & (fault != 2), at["section"]).when(by == 1, at["table"]).otherwise(F.lit(body)).alias("scope_locator"),
        F.element_at(F.array(F.lit(None).cast("string"), F.lit("table_column"), F.lit("shared_all_plans")), (by + 1).cast("int")).alias("relation"), raw.alias("raw_value"), F.when(by == 0, local).when(by == 1, column).otherwise(shared).alias("nodes"),
    )
    pages = table(spark, sf_dir, "part").select("p_partkey", html.alias("html"), F.concat(F.lit("https://rt.example/"), num).alias("url"), F.sha2(html, 256).alias("snapshot_hash"), F.lit("2026-01-01").alias("fetched_at"))
    rows = pages.select(
        num.alias("claim_id"), F.lit("listed_price").alias("field_name"), F.lit("number").alias("kind"), plan.alias("asked_plan"), F.when((by == 1) & (fault == 2), "Other").otherwise(plan).alias("plan_name"), F.lit("verified").alias("state"), value.alias("value"),
        F.when((by == 1) & (fault == 3), "seat").alias("unit"), F.when((by == 0) & (fault != 1), "month").alias("billing_period"), F.when((by == 1) & (fault == 4), "EUR").otherwise("USD").alias("currency"), F.lit("explicit").alias("judgment"), F.lit(None).cast("string").alias("rationale"),
        F.lit("").alias("ambiguity"), F.array(evidence).alias("evidence"),
    )
    return claims.check_claims(rows, pages).select(F.col("claim_id").cast("bigint").alias("p_partkey"), "code")


def site_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an inventory, their orders as outcomes, and those of finished orders as a ledger."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "site")
    return audit.coverage(["site"], approved=table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site")), outcomes=orders, costs=orders.where("o_orderstatus = 'F'"))


def reviewed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's fields (event types) are exactly those that even events review."""
    e = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "job_id", "event_type": "field"})
    out = audit.set_differences(e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0"), ["job_id"], "field")
    return out.select("job_id", _joined("missing"), _joined("extra"), "same")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cases and their events as facts: the first event is expected to be told, the second is expected to be
    found in the source, and one value is forbidden."""
    k = F.col("event_id")
    name = F.concat(F.lit("k"), (k % 3).cast("string"))
    facts = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("grp"), name.alias("key"), (k % 7).cast("string").alias("value"), _pick(k, "found_in_source", "ambiguous", "missing").alias("state"), k.alias("fact_idx"))
    first = facts.groupBy("case_id").agg(F.min_by(F.array("grp", "key", "value"), "fact_idx").alias("one"), F.max("fact_idx").alias("n"))
    cases = first.select(
        "case_id", F.array("one").alias("expected"), F.array(F.array(F.col("one")[0], F.col("one")[1], F.lit("found_in_source"))).alias("expected_states"),
        F.array((F.col("case_id") % 9).cast("string")).alias("forbidden_values"), F.lit("article").alias("expected_type"), F.when(F.col("n") % 4 > 0, "article").otherwise("product").alias("page_type"),
    )
    return audit.corpus_checks(cases, facts)


def corpus_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir)


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.corpus_totals(_corpus(spark, sf_dir))


def process_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetches, lines as fields, orders as jobs."""
    fetches = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "HTTP_ERROR").alias("error"), F.when(F.col("value") < 1, " \n").otherwise("x").alias("html"))
    fields = table(spark, sf_dir, "lineitem").select(_pick(F.col("l_partkey"), *audit.STATES).alias("state"))
    jobs = table(spark, sf_dir, "orders").select(F.floor("o_totalprice").alias("elapsed_seconds"))
    return audit.process_counters(fetches, fields, jobs)


def ledger_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' balances as charges against a ceiling; some are not booked, others not approved."""
    k, s = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    ledger = s.where(k % 10 != 3).select(k.alias("site"), F.col("s_acctbal").alias("compute_usd"), (k % 50 * 1.0).alias("provider_usd"), F.when(k % 8 > 0, "meter").alias("compute_basis"), F.lit("invoice").alias("provider_basis"))
    return audit.ledger_violations(ledger, s.where(k % 10 != 4).select(k.alias("site"), F.lit(40.0).alias("max_provider_spend_usd"))).select("site", _joined())


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' agreements with faults in name, time, rate or thresholds."""
    k = F.col("c_custkey")
    gate = lambda least: F.create_map(*[x for n, v in evaluate.GATE.items() for x in (F.lit(n), F.lit(float(v)) if n != "min_recall" else least)])
    at = F.when(k % 6 == 1, "2026-10-01T09:00:00").when(k % 6 == 2, "soon").when(k % 6 == 3, "").otherwise("2026-10-01T09:00:00+05:30")
    rows = table(spark, sf_dir, "customer").select(k, F.when(k % 7 > 0, F.col("c_name")).alias("confirmed_by"), at.alias("confirmed_at"), F.col("c_acctbal").cast("string").alias("analyst_hourly_rate_usd"), gate(F.when(k % 5 == 0, 0.4).otherwise(0.5)).alias("thresholds"))
    return audit.agreement_violations(rows).select("c_custkey", _joined())


def literal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances as literal labels, with faults that follow from their keys."""
    k = F.col("c_custkey")
    raw = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    value = F.regexp_replace(F.regexp_replace(raw, r"(\.\d*[1-9])0+$", "$1"), r"\.0+$", "")
    rows = table(spark, sf_dir, "customer").select(
        k, F.when(k % 9 == 0, "conflicting").otherwise("verified").alias("state"), F.when(k % 8 > 0, 3.0).alias("reviewer_time_seconds"), _pick(k, *["literal"] * 6, "interpretation").alias("judgment"), F.lit("as read").alias("interpretation_note"),
        (k % 4).cast("int").alias("n_candidates"), F.when(k % 5 == 0, F.concat(value, F.lit("1"))).otherwise(value).alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("currency"), raw.alias("raw_value"),
        F.concat(F.lit("BALANCE due – "), raw, F.when(k % 4 == 0, " or so").otherwise("")).alias("excerpt"), F.lit("Balance due").alias("title"), F.lit("number").alias("kind"), (k % 11 > 0).alias("on_page"),
    )
    return audit.literal_label_violations(spread(rows)).select("c_custkey", _joined())


def evidence_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs whose lines are evidence of a field or of its candidates: how much there is, and how much of it is
    bound to a page row and to stored bytes."""
    moved = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_returnflag", F.col("l_shipdate").alias("fetched_at"), "l_suppkey", "l_partkey").repartition("job_id")  # keys move; urls and hashes are made of them where they arrive
    lines = moved.withColumns({"source_url": F.col("l_partkey").cast("string"), "snapshot_hash": F.sha2(F.col("l_partkey").cast("string"), 256)})
    one = F.struct("source_url", "fetched_at", "snapshot_hash")
    own = lambda flag: F.collect_list(F.when(F.col("l_returnflag") == flag, one))
    fields = lines.groupBy("job_id").agg(own("N").alias("evidence"), F.array(F.struct(own("R").alias("evidence")), F.struct(own("A").alias("evidence"))).alias("candidates"))
    pages = lines.where("l_suppkey % 5 <> 0").withColumnRenamed("source_url", "url")
    found = store.review_evidence(audit.all_evidence(fields, "job_id"), pages, lines.where("l_partkey % 3 <> 0"))
    return found.groupBy("job_id").agg(F.count(F.lit(1)).alias("evidence"), F.count_if("source_bound").alias("bound"))


# pages whose outcome varies ----------------------------------------------------------------------------


def rt_page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of every type, of two at once, and of none."""
    k, name = F.col("p_partkey"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string"))
    thing = lambda t: F.concat(F.lit('<script type="application/ld+json">{"@type":"' + t + '","name":"'), name, F.lit('"}</script>'))
    og = F.lit('<meta property="og:type" content="article">')
    body = (
        F.when(k % 7 == 0, og).when(k % 7 == 1, thing("Product")).when(k % 7 == 2, thing("Organization")).when(k % 7 == 3, F.lit("<article><time>2026-01-01</time></article>"))
        .when(k % 7 == 4, F.lit("<article><h2>Team</h2><p>USD 20 per user/month billed annually</p></article>")).when(k % 7 == 5, F.concat(og, thing("Product"))).otherwise(F.lit("<article>no time</article>"))
    )
    rows = spread(table(spark, sf_dir, "part"))
    _, n = built(rows, k, F.concat(F.lit("<html><head><title>"), name, F.lit("</title></head><body><h1>"), name, F.lit("</h1>"), body, F.lit("</body></html>")))
    found = automatic.page_types(n, automatic.all_claims(n))
    return found.select(F.col("page_key").cast("bigint").alias("p_partkey"), F.col("value").alias("page_type"), F.array_join("alternatives", "|").alias("alternatives"))


def rt_nearest_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as plans in three nested blocks, with one price in the inner, middle or outer one."""
    k, price = F.col("s_suppkey"), F.lit("<p>USD 5 per seat billed yearly</p>")
    at = lambda level: F.when(k % 3 == level, price).otherwise("")
    deep = F.concat(F.lit("<section><div><div><h3>Plan "), k.cast("string"), F.lit("</h3>"), at(0), F.lit("</div>"), at(1), F.lit("</div>"), at(2), F.lit("</section>"))
    rows = spread(table(spark, sf_dir, "supplier"))
    _, n = built(rows, k, F.concat(F.lit("<html><body>"), deep, F.lit("</body></html>")))
    found = plans.nearest_cards(n, rows.select(k.cast("string").alias("page_key"), F.concat(F.lit("Plan "), k.cast("string")).alias("plan_name")))
    return found.select(F.col("page_key").cast("bigint").alias("s_suppkey"), F.regexp_replace("scope_path", r":nth-of-type\(1\)", "").alias("scope_path"))


def rt_common_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages whose heading and paragraph meet in a div, a section or the body."""
    k = F.col("s_suppkey")
    html = F.when(k % 3 == 0, "<section><div><h1>a</h1><p>b</p></div></section>").when(k % 3 == 1, "<section><div><h1>a</h1></div><p>b</p></section>").otherwise("<section><div><h1>a</h1></div></section><p>b</p>")
    _, n = built(spread(table(spark, sf_dir, "supplier")), k, F.concat(F.lit("<html><body>"), html, F.lit("</body></html>")))
    first = lambda tag: F.array_min(F.transform(tagged(F.col("nodes"), (tag,)), lambda x: x["node_id"]))
    pair = n.select("page_key", first("h1").alias("plan_id"), first("p").alias("value_id"), F.lit(0).alias("claim_id"))
    return evaluate.common_scopes(pair, n).select(F.col("page_key").cast("bigint").alias("s_suppkey"), F.col("common.tag").alias("tag"))


def rt_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names as bytes of four charsets, named by a header, a meta element, a byte-order mark or wrongly."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("<meta charset='iso-8859-1'>é "), F.col("c_name"))
    plain = F.concat(F.lit("é "), F.col("c_name"))
    raw = F.when(k % 4 == 0, F.encode(text, "ISO-8859-1")).when(k % 4 == 1, F.encode(plain, "UTF-16")).when(k % 4 == 2, F.encode(plain, "UTF-8")).otherwise(F.encode(plain, "ISO-8859-1"))
    kind = F.when(k % 4 == 2, "text/html; charset=no-such").when(k % 4 == 3, "text/html; charset=utf-8").otherwise("text/html")
    rows = table(spark, sf_dir, "customer").select(k, "c_name", decode_html(raw, kind).alias("d"))
    return rows.select("c_custkey", F.col("d.encoding").alias("encoding"), F.col("d.errors").cast("int").alias("errors"), F.col("d.text").endswith(F.concat(F.lit("é "), F.col("c_name"))).alias("same"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (public_targets, wire_pages, evidence_nodes, snapshot_reads, rt_caps, page_inventories, inventory_totals, evidence_binding, scope_prefixes, rt_frontier, rt_facts, claim_checks, site_coverage, reviewed_fields, corpus_checks, corpus_totals, process_counters, ledger_refusals, agreements, literal_labels, evidence_views, rt_page_types, rt_nearest_card, rt_common_scopes, rt_charsets)
}

#: First and last numbers of the IPv4 blocks that are not of the public internet (the special-purpose registry).
_BLOCKS = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4"
).split()


def _inside(number: str) -> str:
    """SQL: number lies in one of the blocks."""
    parts = []
    for block in _BLOCKS:
        address, _, bits = block.partition("/")
        low = sum(int(b) << s for b, s in zip(address.split("."), (24, 16, 8, 0), strict=True))
        parts.append(f"{number} BETWEEN {low} AND {low + (1 << 32 - int(bits)) - 1}")
    return "(" + " OR ".join(parts) + ")"


def _dotted(number: str) -> str:
    return " || '.' || ".join(f"(({number}) >> {s}) % 256" for s in (24, 16, 8, 0))


_CORPUS = """f AS (SELECT user_id AS c, event_type AS g, event_id % 3 AS k, event_id AS i, CAST(event_id % 7 AS VARCHAR) AS v, event_id % 3 = 0 AS told FROM events),
 x AS (SELECT c, arg_min(g, i) AS g, arg_min(k, i) AS k, arg_min(v, i) AS v, max(i) AS n, count(*) FILTER (told) AS found, bool_or(v = CAST(c % 9 AS VARCHAR)) AS barred FROM f GROUP BY c),
 y AS (SELECT x.*, l.v AS lv, l.told AS lt FROM x JOIN (SELECT c, g, k, arg_max(v, i) AS v, arg_max(told, i) AS told FROM f GROUP BY 1, 2, 3) l USING (c, g, k)),
 z AS (SELECT c AS case_id, CAST(4 AS BIGINT) AS checks, CAST(CAST(n % 4 = 0 AS INT) + CAST(lv <> v AS INT) + CAST(NOT lt AS INT) + CAST(barred AS INT) AS BIGINT) AS failed, found FROM y)"""

ORACLE_SQL: dict[str, str] = {
    "public_targets": f"""WITH n AS (SELECT event_id, (event_id * 2654435761 + 7) % 4294967296 AS a, (event_id * 40503001 + 99) % 4294967296 AS b FROM events),
        c AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 'DNS_FAILED' WHEN event_id % 50 = 1 OR {_inside('a')} OR {_inside('b')} THEN 'PRIVATE_TARGET' END AS code FROM n)
        SELECT event_id, code, CASE WHEN code IS NULL THEN least({_dotted('a')}, {_dotted('b')}) END AS address FROM c""",
    "wire_pages": """SELECT page_id, page_id % 7 <> 0 AS sound, CASE WHEN page_id % 7 <> 0 THEN base64(encode(html)) END AS raw_base64, CASE WHEN page_id % 7 <> 0 THEN html END AS html, CASE WHEN page_id % 7 <> 0 THEN sha256(html) END AS snapshot_hash,
        'text/html; charset=utf-8' AS content_type FROM pages""",
    "evidence_nodes": """WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, '<li>.*?</li>', 0, 's'), lambda x: {'h': x, 't': trim(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))}) AS b FROM pages),
        k AS (SELECT page_id, list_filter(b, lambda x: length(x.t) BETWEEN 1 AND 400) AS b FROM l) SELECT page_id, array_to_string(list_transform(b, lambda x: x.h[1:4000]), '|') AS sources FROM k WHERE len(b) > 0""",
    "snapshot_reads": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 AND l_linenumber % 5 <> 0 THEN o_orderstatus END AS encoding FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "rt_caps": """WITH s AS (SELECT s_suppkey, ([40, 100, 300])[CAST(s_suppkey % 3 AS INT) + 1] AS m FROM supplier), i AS (SELECT s_suppkey, m, unnest(range(1, least(m, 250) + 1)) AS i FROM s),
        f AS (SELECT s_suppkey, 1 AS r, 'L' || lpad(CAST(m - i + 1 AS VARCHAR), 3, '0') AS label, 'v' || i AS value FROM i UNION ALL SELECT s_suppkey, -n, label, NULL FROM supplier, (VALUES (4, 'Title'), (3, 'Main heading'), (2, 'Description'), (1, 'Site name')) v(n, label)),
        n AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY r, label) - 1 AS idx FROM f) SELECT s_suppkey, CAST(idx AS INT) AS fact_idx, label, CASE WHEN value IS NULL THEN 'missing' ELSE 'found_in_source' END AS state, value FROM n WHERE idx < 60""",
    "page_inventories": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 15 = 0 THEN c_custkey - 1 ELSE c_custkey END AS h FROM customer)
        SELECT k AS c_custkey, concat_ws('|', CASE WHEN k % 7 = 0 THEN 'seed URL' END, CASE WHEN count(*) OVER (PARTITION BY h) > 1 THEN 'repeated host' END, CASE WHEN k % 4 = 0 THEN 'request ceiling' END, CASE WHEN k % 5 = 0 OR k % 6 = 1 THEN 'not approved' END) AS violations FROM c""",
    "inventory_totals": """SELECT count(*) AS sites, count(*) FILTER (s_suppkey % 3 <> 0) AS development, count(*) FILTER (s_suppkey % 3 = 0) AS held_out, CAST(sum(s_suppkey % 50) AS BIGINT) AS maximum_http_requests, CAST(sum(s_suppkey % 4 * 0.25) AS DOUBLE) AS maximum_provider_spend_usd,
        count(*) FILTER (s_suppkey % 5 = 0) AS pending_sites, false AS valid, false AS execution_ready FROM supplier""",
    "evidence_binding": """WITH p AS (SELECT o_custkey % 20 AS c, o_orderkey % 5 AS u, sha256(o_orderpriority) AS h, arg_min(CASE WHEN o_orderkey % 40 = 0 THEN sha256('other') ELSE sha256(o_orderpriority) END, o_orderkey) AS own FROM orders GROUP BY ALL)
        SELECT l_orderkey, l_linenumber, coalesce(own = h, false) AS bound FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        LEFT JOIN p ON p.c = o_custkey % 20 + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END AND p.u = o_orderkey % 5 AND p.h = CASE WHEN l_linenumber = 3 THEN sha256('other') ELSE sha256(o_orderpriority) END""",
    "scope_prefixes": """WITH e AS (SELECT l_orderkey, l_partkey % 2 AS u, 'div' || (l_partkey % 12) || CASE WHEN l_partkey % 3 = 0 THEN ' > ' ELSE ' > p > ' END AS l FROM lineitem WHERE l_linenumber % 2 = 1),
        s AS (SELECT l_orderkey, l_partkey % 2 AS u, 'div' || ((l_partkey + 2) % 12) || CASE WHEN l_partkey % 5 = 0 THEN ' > q > ' ELSE ' > ' END AS l FROM lineitem WHERE l_linenumber % 2 = 0)
        SELECT a.l_orderkey, bool_or(coalesce(starts_with(e.l, s.l), false)) AS evidence_matches FROM (SELECT DISTINCT l_orderkey FROM lineitem) a LEFT JOIN e ON e.l_orderkey = a.l_orderkey LEFT JOIN s ON s.l_orderkey = a.l_orderkey AND e.u = s.u GROUP BY 1""",
    "rt_frontier": """WITH RECURSIVE r AS (SELECT c_custkey AS k, 0::BIGINT AS n, [{'u': c_custkey % 1000, 'd': 0}] AS q, [c_custkey % 1000] AS seen, NULL::BIGINT AS u, NULL::INT AS d, NULL::VARCHAR AS error FROM customer
            UNION ALL SELECT k, n + 1, list_concat(rest, list_transform(fresh, lambda x: {'u': x, 'd': h.d + 1})), list_concat(seen, fresh), h.u, h.d, e FROM (SELECT *, CASE WHEN e IS NULL AND h.d < 2 THEN list_filter(list_transform(range(h.u % 4 + 1), lambda j: (h.u * 7 + j * 13) % 1000), lambda x: NOT list_contains(seen, x)) ELSE [] END AS fresh
                FROM (SELECT k, n, q[1] AS h, q[2:] AS rest, seen, CASE WHEN q[1].u % 11 = 3 THEN 'ACCESS_DENIED' WHEN q[1].u % 7 = 2 THEN 'HTTP_ERROR' END AS e FROM r WHERE len(q) > 0 AND n < 6 AND coalesce(error, '') <> 'ACCESS_DENIED')))
        SELECT k AS c_custkey, 'https://f.example/' || u AS url, d AS depth, n AS visit_seq, error FROM r WHERE n > 0""",
    "rt_facts": """WITH c AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AS article, c_custkey % 3 = 1 AND c_custkey % 5 <> 0 AS product, c_custkey % 4 = 0 AS twice, c_custkey % 2 = 0 AS told, 'Acme ' || c_custkey AS name, 'This paragraph tells what item ' || c_custkey || ' is good for in general.' AS said FROM customer),
        f AS (SELECT k, 0 AS r, 0 AS kr, 'Title' AS label, 0 AS tie, 'Page' AS grp, 'page_title' AS key, name AS value, NULL AS currency, NULL AS period FROM c UNION ALL SELECT k, 0, 1, 'Main heading', 0, 'Page', 'main_heading', name, NULL, NULL FROM c
            UNION ALL SELECT k, 0, 2, 'Description', 0, 'Page', 'page_description', CASE WHEN told THEN 'About item ' || k END, NULL, NULL FROM c UNION ALL SELECT k, 0, 3, 'On-page summary', 0, 'Page', 'overview_text', said, NULL, NULL FROM c UNION ALL SELECT k, 0, 4, 'Site name', 0, 'Page', 'site_name', NULL, NULL, NULL FROM c
            UNION ALL SELECT k, 1, 5, 'Plan', 0, 'Plan: Tier A' || k, 'named_plan', 'Tier A' || k, NULL, NULL FROM c UNION ALL SELECT k, 1, 6, 'Price', 0, 'Plan: Tier A' || k, 'listed_price', k || '.5', 'USD', 'month' FROM c UNION ALL SELECT k, 1, 20, 'Billing period', 0, 'Plan: Tier A' || k, 'billing_period', 'month', NULL, NULL FROM c
            UNION ALL SELECT k, 1, 20, 'Currency', 0, 'Plan: Tier A' || k, 'currency', 'USD', NULL, NULL FROM c UNION ALL SELECT k, 2, 20, 'Description', 0, 'Article', 'description', 'An article on ' || k, NULL, NULL FROM c WHERE article UNION ALL SELECT k, 2, 20, 'Published', 0, 'Article', 'datePublished', '2026-01-02', NULL, NULL FROM c WHERE article
            UNION ALL SELECT k, 2, 20, 'Headline', 0, CASE WHEN article THEN 'Article' ELSE 'Details' END, CASE WHEN article THEN 'headline' ELSE 'detail:headline' END, name, NULL, NULL FROM c UNION ALL SELECT k, 2, 20, 'Name', 0, 'Product', 'name', name, NULL, NULL FROM c WHERE product
            UNION ALL SELECT k, 2, 20, 'Listed price', 0, 'Offer: Offer 1', 'price', CAST(k AS VARCHAR), 'USD', NULL FROM c WHERE product UNION ALL SELECT k, 2, 20, 'Listed price', 1, 'Offer: Big', 'price', '2.50', 'EUR', NULL FROM c WHERE product
            UNION ALL SELECT k, 2, 20, 'Color', 0, 'Details', 'detail:color', CASE WHEN NOT twice THEN 'red' || (k % 3) END, NULL, NULL FROM c UNION ALL SELECT k, 2, 20, 'Size', 0, 'Details', 'detail:size', k || ' cm', NULL, NULL FROM c UNION ALL SELECT k, 2, 20, 'Other', 0, 'Details', 'detail:other', k || ' cm', NULL, NULL FROM c)
        SELECT k AS c_custkey, CAST(row_number() OVER (PARTITION BY k ORDER BY r, kr, label, tie) - 1 AS INT) AS fact_idx, grp, key, label, CASE WHEN value IS NOT NULL THEN 'found_in_source' WHEN key = 'detail:color' THEN 'ambiguous' ELSE 'missing' END AS state, value, currency, period AS billing_period,
            CAST(CASE WHEN key = 'detail:color' AND value IS NULL THEN 2 ELSE 0 END AS INT) AS alternatives, CASE WHEN told THEN 'About item ' || k ELSE said END AS overview_text FROM f JOIN c USING (k)""",
    "claim_checks": """SELECT p_partkey, ([[NULL, 'several plan headings', 'no shared scope', 'raw value absent', 'excerpt changed'], [NULL, 'not one column', 'plan not named', 'unit absent', 'currency absent'],
        [NULL, 'no all-plans statement', 'unsupported value', 'unbound capture', 'node not found']])[CAST(p_partkey % 3 AS INT) + 1][CAST(p_partkey // 3 % 5 AS INT) + 1] AS code FROM part""",
    "site_coverage": """WITH o AS (SELECT o_custkey AS site, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1), c AS (SELECT c_custkey AS site, count(*) AS n FROM customer GROUP BY 1)
        SELECT site, CAST(coalesce(c.n, 0) AS BIGINT) AS approved, CAST(coalesce(o.n, 0) AS BIGINT) AS outcomes, CAST(coalesce(f, 0) AS BIGINT) AS costs, coalesce(c.n, 0) = 1 AND coalesce(o.n, 0) = 1 AND coalesce(f, 0) = 1 AS complete
        FROM c FULL JOIN o USING (site)""",
    "reviewed_fields": """WITH s AS (SELECT user_id AS job_id, coalesce(list(DISTINCT event_type) FILTER (event_id % 3 <> 0), []) AS w, coalesce(list(DISTINCT event_type) FILTER (event_id % 2 = 0), []) AS f FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0 GROUP BY 1)
        SELECT job_id, array_to_string(list_sort(list_filter(w, lambda x: NOT list_contains(f, x))), '|') AS missing, array_to_string(list_sort(list_filter(f, lambda x: NOT list_contains(w, x))), '|') AS extra, list_sort(w) = list_sort(f) AS same FROM s""",
    "corpus_checks": f"WITH {_CORPUS} SELECT *, failed = 0 AS passed FROM z",
    "corpus_totals": f"WITH {_CORPUS} SELECT count(*) AS cases, count(*) FILTER (failed = 0) AS passed, CAST(sum(checks) AS BIGINT) AS checks, CAST(sum(found) AS BIGINT) AS found FROM z",
    "process_counters": """SELECT 'fetch_failures' AS counter, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS value FROM events UNION ALL SELECT 'empty_pages', count(*) FILTER (event_type <> 'click' AND value < 1) FROM events
        UNION ALL SELECT s.c, count(*) FILTER (l_partkey % 5 = s.m) FROM lineitem, (VALUES ('verified_fields', 0), ('conflicting_fields', 1), ('missing_fields', 2), ('blocked_fields', 3), ('unverified_fields', 4), ('evidence_check_failures', 4)) s(c, m) GROUP BY 1
        UNION ALL SELECT 'jobs', count(*) FROM orders UNION ALL SELECT 'elapsed_seconds_total', sum(floor(o_totalprice)) FROM orders""",
    "ledger_refusals": """SELECT s_suppkey AS site, concat_ws('|', CASE WHEN s_suppkey % 10 = 3 THEN 'not in the ledger' END, CASE WHEN s_suppkey % 10 = 4 THEN 'not approved' END, CASE WHEN s_suppkey % 10 <> 3 AND s_acctbal < 0 THEN 'charges' END,
        CASE WHEN s_suppkey % 10 <> 3 AND s_suppkey % 8 = 0 THEN 'basis' END, CASE WHEN s_suppkey % 10 NOT IN (3, 4) AND s_suppkey % 50 > 40 THEN 'above the ceiling' END) AS violations FROM supplier""",
    "agreements": """SELECT c_custkey, concat_ws('|', CASE WHEN c_custkey % 7 = 0 OR c_custkey % 6 = 3 THEN 'not confirmed' END, CASE WHEN c_custkey % 6 = 2 THEN 'no time' END, CASE WHEN c_custkey % 6 = 1 THEN 'no zone' END,
        CASE WHEN c_acctbal IS NULL OR c_acctbal <= 0 THEN 'rate' END, CASE WHEN c_custkey % 5 = 0 THEN 'thresholds' END) AS violations FROM customer""",
    "literal_labels": """WITH l AS (SELECT c_custkey AS k, c_custkey % 9 <> 0 AS sure, c_custkey % 11 > 0 AS backed, c_custkey % 4 > 0 AND c_acctbal >= 0 AS tied FROM customer)
        SELECT k AS c_custkey, concat_ws('|', CASE WHEN k % 8 = 0 THEN 'no measured reviewer time' END, CASE WHEN k % 7 = 6 AND sure THEN 'interpretation' END, CASE WHEN sure AND NOT backed THEN 'no source' END,
        CASE WHEN sure AND backed AND NOT tied THEN 'not tied to its label' END, CASE WHEN sure AND backed AND tied AND k % 5 = 0 THEN 'disagrees with its claim' END, CASE WHEN NOT sure AND k % 4 < 2 THEN 'too few candidates' END) AS violations FROM l""",
    "evidence_views": """WITH b AS (SELECT l_orderkey, l_partkey % 3 <> 0 AND bool_or(l_suppkey % 5 <> 0) OVER (PARTITION BY l_orderkey, l_partkey, l_shipdate) AS bound FROM lineitem WHERE l_returnflag IN ('N', 'R', 'A'))
        SELECT l_orderkey AS job_id, count(*) AS evidence, count(*) FILTER (bound) AS bound FROM b GROUP BY 1""",
    "rt_page_types": """SELECT p_partkey, (['article', 'product', 'organization/service', 'article', 'saas_pricing', 'general', 'general'])[CAST(p_partkey % 7 AS INT) + 1] AS page_type, CASE WHEN p_partkey % 7 = 5 THEN 'article|product' ELSE '' END AS alternatives FROM part""",
    "rt_nearest_card": "SELECT s_suppkey, 'html > body > section' || repeat(' > div', CAST(2 - s_suppkey % 3 AS INT)) AS scope_path FROM supplier",
    "rt_common_scopes": "SELECT s_suppkey, (['div', 'section', 'body'])[CAST(s_suppkey % 3 AS INT) + 1] AS tag FROM supplier",
    "rt_charsets": """SELECT c_custkey, (['iso8859-1', 'utf-16', 'utf-8', 'utf-8'])[CAST(c_custkey % 4 AS INT) + 1] AS encoding, CAST(c_custkey % 4 = 3 AS INT) AS errors, c_custkey % 4 <> 3 AS same FROM customer""",
}
