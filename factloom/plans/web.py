"""Queries over the pages table, and over pages built from relational rows and read back (round trips)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.dom import elements, nodes, source_node, tagged
from factloom.functions.urls import canonical_url, tracking_key
from factloom.operators import automatic, candidates, crawl, plans, reconcile
from factloom.operators.candidates import Field
from factloom.sources.captures import decode_html, read_pages
from factloom.sources.tables import materialize, spread, table

QUICK = [Field("page_title"), Field("main_heading"), Field("page_description"), Field("site_name")]


def page_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures of the pages table, and the same pages parsed."""
    captures = read_pages(spark, sf_dir)
    return captures, nodes(captures)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def built(rows: DataFrame, key: Column, html: Column, also: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Captures made of rows, and the same pages parsed."""
    captures = rows.select(key.cast("string").alias("page_key"), F.concat(F.lit("https://rt.example/"), key.cast("string")).alias("url"), html.alias("html"), *also)
    return captures, nodes(captures, also=also)


def _number(key: str = "page_key") -> Column:
    return F.col(key).cast("bigint")


# pages -------------------------------------------------------------------------------------------------


def snapshot_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, sf_dir).select("page_id", "snapshot_hash")


def decode_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page's bytes decode to its text."""
    rows = read_pages(spark, sf_dir).withColumn("d", decode_html("raw", "content_type"))
    return rows.select("page_id", F.col("d.encoding").alias("encoding"), F.col("d.errors").cast("int").alias("errors"), (F.col("d.text") == F.col("html")).alias("same"))


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n = page_nodes(spark, sf_dir)
    return candidates.page_facts(n).where("field = 'page_title'").select(_number().alias("page_id"), F.col("value").alias("title"))


def main_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n = page_nodes(spark, sf_dir)
    return candidates.page_facts(n).where("field = 'main_heading'").select(_number().alias("page_id"), F.col("value").alias("heading"))


def page_fact_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four page facts of every page: extracted, verified against a second parse of the retained bytes, and
    reconciled to a state and value."""
    states = reconcile.page_states(read_pages(spark, sf_dir), QUICK)
    return states.select(_number().alias("page_id"), "field", "state", "value", F.coalesce(F.size("evidence"), F.lit(0)).alias("n_evidence"))


def job_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs and their orders as fields: finished ones are verified, urgent ones bring an error along, and a
    customer without orders has no page."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "job_id")
    states = orders.select("job_id", F.when(F.col("o_orderstatus") == "F", "verified").otherwise("missing").alias("state"))
    counts = orders.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_errors"))
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")).join(counts, "job_id", "left").fillna(0)
    return reconcile.job_status(states, jobs).select(F.col("job_id").alias("c_custkey"), "status")


def visible_li_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n = page_nodes(spark, sf_dir)
    own = candidates.visible_blocks(n).where("tag = 'li'").groupBy("page_key").agg(F.sort_array(F.collect_list(F.struct("node_id", "text"))).alias("b"))
    return own.select(_number().alias("page_id"), F.size("b").alias("n_blocks"), F.array_join(F.transform("b", lambda b: b["text"]), "|").alias("texts"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n = page_nodes(spark, sf_dir)
    found = crawl.links(n, hints=["page"])
    return found.select(_number().alias("page_id"), "url", "score", F.col("rank").cast("bigint").alias("rank"))


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, sf_dir).select("page_id", canonical_url("url").alias("canonical"), tracking_key("url").alias("tracking_key"))


def duplicate_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page fetched again with a tracking parameter: the second fetch is a duplicate."""
    first = read_pages(spark, sf_dir).select(F.lit("job").alias("job_id"), (F.col("page_id") * 2).alias("fetch_seq"), "page_id", canonical_url("url").alias("url"), "snapshot_hash")
    tracked = F.concat("url", F.when(F.col("url").contains("?"), "&utm_medium=again").otherwise("?utm_medium=again"))
    again = first.select("job_id", (F.col("fetch_seq") + 1).alias("fetch_seq"), "page_id", tracked.alias("url"), "snapshot_hash")
    return crawl.duplicate_captures(first.union(again)).select("page_id", "fetch_seq", "status")


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n = page_nodes(spark, sf_dir)
    found = automatic.page_types(n, automatic.all_claims(n))
    return found.select(_number().alias("page_id"), F.col("value").alias("page_type"), F.array_join("alternatives", "|").alias("alternatives"))


def automatic_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found and missing facts of every page, with the overview's state. Claims are made of the html, made again of
    the retained bytes, and kept where both agree; a page whose bytes decode to something else has no facts."""
    facts = automatic.automatic_facts(read_pages(spark, sf_dir))
    return facts.select(_number().alias("page_id"), F.col("fact_idx").cast("int").alias("fact_idx"), "grp", "key", "label", "state", "value", "overview_state", "overview_text")


def decode_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts found on each page when the html of every third one was changed after its bytes were kept."""
    captures = read_pages(spark, sf_dir)
    forged = captures.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<p>more</p>"))).otherwise(F.col("html")))
    facts = automatic.automatic_facts(forged)
    return facts.groupBy(_number().alias("page_id"), "code").agg(F.count_if(F.col("state") == "missing").alias("missing"), F.max(F.when(F.col("key") == "page_title", F.col("value"))).alias("title"))


def confirmed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title claims that come up again from the kept bytes, when values or locators of some were altered."""
    n = nodes(read_pages(spark, sf_dir))
    claims = automatic.every_claim(n).where("key in ('page_title', 'main_heading')")
    k = _number() % 5
    forged = claims.withColumn("value", F.when(k == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value"))).withColumn("locator", F.when(k == 1, F.lit("p")).otherwise(F.col("locator")))
    good = automatic.confirmed(automatic.both_sides(forged, claims)).where("pos[0] < 9")
    return good.select(_number().alias("page_id"), "key", "value")


def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a crawl from each page attempts: two levels, eight pages at most."""
    captures, n = page_nodes(spark, sf_dir)
    pages = captures.select("page_key", canonical_url("url").alias("url")).where("url is not null")
    edges = materialize(crawl.links(n).join(pages.withColumnRenamed("url", "source"), "page_key").select(F.col("source").alias("url"), F.col("url").alias("target"), "rank"), "edges")
    seeds = captures.select(F.col("page_key").alias("job_id"), "url")
    known = pages.select("url").distinct().withColumn("known", F.lit(True))
    targets = edges.select(F.col("target").alias("url")).union(pages.select("url")).distinct()
    outcomes = targets.join(known, "url", "left").select("url", F.when(F.col("known").isNull(), "HTTP_ERROR").alias("error"))
    found = crawl.frontier(seeds, edges.groupBy("url", "target").agg(F.min("rank").alias("rank")), outcomes, max_depth=2, max_pages=8)
    return found.select(_number("job_id").alias("page_id"), "url", "depth", F.col("visit_seq").cast("bigint").alias("visit_seq"), "error")


# round trips -------------------------------------------------------------------------------------------


def rt_label_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer balances as "Balance: x", read back as exact numbers."""
    rows = spread(table(spark, sf_dir, "customer"))
    amount = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    captures, n = built(rows, F.col("c_custkey"), F.concat(F.lit("<html><body><h1>Account</h1><p>Balance: "), amount, F.lit("</p></body></html>")))
    found = candidates.candidates(n, [Field("balance", "number")])
    return found.select(_number().alias("c_custkey"), "value", "encoding", "raw_value")


def rt_units_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part prices with a currency and unit that follow from the key; a schema that wants EUR keeps those alone."""
    rows = spread(table(spark, sf_dir, "part"))
    key = F.col("p_partkey")
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    sign = F.when(key % 3 == 0, "USD ").when(key % 3 == 1, "€").otherwise("£")
    unit = F.when(key % 2 == 0, " per month").otherwise("/year")
    captures, n = built(rows, key, F.concat(F.lit("<p>Rate - "), sign, price, unit, F.lit("</p>")))
    found = candidates.candidates(n, [Field("rate", "number")]).withColumn("job_id", F.lit("j"))
    spec = spark.range(1).select(F.lit("j").alias("job_id"), F.lit("rate").alias("field"), F.lit(None).cast("string").alias("x_unit"), F.lit("EUR").alias("x_currency"))
    kept = reconcile.fitting(found, spec).select("page_key", F.lit(True).alias("fits"))
    return found.join(kept, "page_key", "left").select(_number().alias("p_partkey"), "value", "unit", "currency", F.coalesce("fits", F.lit(False)).alias("kept"))


def rt_reconcile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer with a status line for each order: one status is verified, several conflict, and
    customers without orders are missing."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    lines = F.array_join(F.transform(F.coalesce("o", F.array().cast("array<struct<o_orderkey:bigint,o_orderstatus:string>>")), lambda x: F.concat(F.lit("<li>Status: "), x["o_orderstatus"], F.lit("</li>"))), "")
    captures, n = built(rows, F.col("c_custkey"), F.concat(F.lit("<html><body><ul>"), lines, F.lit("</ul></body></html>")))
    n = materialize(n, "nodes")  # candidates and label hits read it, and orders are not grouped again
    schema = [Field("status")]
    place = {"job_id": F.col("page_key"), "page_seq": F.lit(0)}
    raw = candidates.candidates(n, schema).withColumns(place)
    jobs = captures.select(F.col("page_key").alias("job_id"), F.lit(False).alias("blocked"))
    hits = candidates.label_hits(n, schema).withColumnRenamed("page_key", "job_id")
    states = reconcile.field_states(raw, raw, hits, jobs, candidates.per_field(jobs, schema))
    return states.select(_number("job_id").alias("c_custkey"), "state", "value", F.coalesce(F.size("evidence"), F.lit(0)).alias("n_evidence"), F.coalesce(F.size("candidates"), F.lit(0)).alias("n_candidates"))


def rt_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as JSON-LD objects; numbers stay as they are written."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat(F.lit('<script type="application/ld+json">[{"@type":"Country","country_name":"'), F.col("n_name"), F.lit('","region":"'), F.col("r_name"), F.lit('","weight":'), F.col("n_nationkey").cast("string"), F.lit('.50},{"rank":'), F.col("n_nationkey").cast("string"), F.lit("}]</script>"))
    captures, n = built(rows, F.col("n_nationkey"), F.concat(F.lit("<html><head>"), body, F.lit("</head><body></body></html>")))
    found = candidates.candidates(n, [Field("country_name"), Field("region"), Field("weight", "number"), Field("rank", "integer")])
    return found.select(_number().alias("n_nationkey"), "field", "value", "raw_value", "item_idx", "encoding")


def _priced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    period = F.when(F.col("p_partkey") % 2 == 0, "monthly").otherwise("annually")
    code = F.when(F.col("p_partkey") % 3 == 0, "USD").when(F.col("p_partkey") % 3 == 1, "EUR").otherwise("GBP")
    return spread(table(spark, sf_dir, "part")).select("p_partkey", "p_brand", price.alias("price"), period.alias("period"), code.alias("code"), F.concat(F.lit("Plan "), F.col("p_partkey").cast("string")).alias("plan_name"))


def _plan_rows(n: DataFrame) -> DataFrame:
    found = plans.plan_candidates(n).where("field = 'listed_price'").select("page_key", "plan_name", "value", "unit", "currency", "billing_period").distinct()
    return found.select(F.regexp_replace("plan_name", "^Plan ", "").cast("bigint").alias("p_partkey"), "value", "unit", "currency", "billing_period")


def rt_plan_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a plan's card with its price, beside a card of another plan."""
    rows = _priced_parts(spark, sf_dir)
    card = F.concat(F.lit("<article><h2>"), F.col("plan_name"), F.lit("</h2><p>"), F.col("code"), F.lit(" "), F.col("price"), F.lit(" per user/month billed "), F.col("period"), F.lit("</p></article><article><h2>Other</h2><p>USD 1 per user/month billed monthly</p></article>"))
    captures, n = built(rows, F.col("p_partkey"), F.concat(F.lit("<html><body><main>"), card, F.lit("</main></body></html>")), ["plan_name"])
    return _plan_rows(n)


def rt_plan_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One comparison table for each part with its plan in the second column and a cheaper one in the first."""
    rows = _priced_parts(spark, sf_dir)
    cell = F.concat(F.col("code"), F.lit(" "), F.col("price"), F.lit(" /year billed "), F.col("period"))
    body = F.concat(F.lit("<table><tr><th>Feature</th><th>Base</th><th>"), F.col("plan_name"), F.lit("</th></tr><tr><td>Price</td><td>USD 1 billed monthly</td><td>"), cell, F.lit("</td></tr></table>"))
    captures, n = built(rows, F.col("p_partkey"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")), ["plan_name"])
    return _plan_rows(n)


def rt_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as offers of one product: the first twelve count."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("price"))
    # a page is bounded by its parser, so a page for each brand and thousand of keys
    parts = parts.withColumn("page_key", F.concat_ws("-", F.replace("p_brand", F.lit("#"), F.lit("")), F.floor(F.col("p_partkey") / 1000).cast("string")))
    one = F.concat(F.lit('{"name":"Part '), F.col("p_partkey").cast("string"), F.lit('","price":'), F.col("price"), F.lit(',"priceCurrency":"USD"}'))
    pages = parts.withColumn("offer", one).groupBy("page_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "offer"))), lambda x: x["offer"]), ",").alias("offers"))
    html = F.concat(F.lit('<html><head><title>Brand</title><script type="application/ld+json">{"@type":"Product","name":"Brand","offers":['), F.col("offers"), F.lit("]}</script></head><body><h1>Brand</h1></body></html>"))
    captures, n = built(pages, F.col("page_key"), html)
    found = automatic.all_claims(n).where("key = 'price'")
    return found.select("page_key", F.col("grp").alias("offer"), "value", "currency", "encoding")


def rt_details_dl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat(F.lit("<dl><dt>Nation</dt><dd>"), F.col("n_name"), F.lit("</dd><dt>Region</dt><dt>Part of</dt><dd>"), F.col("r_name"), F.lit("</dd></dl><nav><dl><dt>Menu</dt><dd>x</dd></dl></nav>"))
    captures, n = built(rows, F.col("n_nationkey"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")))
    return automatic.all_claims(n).where("grp = 'Details'").select(_number().alias("n_nationkey"), "key", "label", "value")


def rt_details_tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat(F.lit("<table><tr><th>Nation</th><td>"), F.col("n_name"), F.lit('</td></tr><tr><th>Region</th><td>'), F.col("r_name"), F.lit('</td></tr><tr><th colspan="2">Span</th><td>x</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>'))
    captures, n = built(rows, F.col("n_nationkey"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")))
    return automatic.all_claims(n).where("grp = 'Details'").select(_number().alias("n_nationkey"), "key", "label", "value")


def rt_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labelled items, some hidden in one of five ways."""
    rows = spread(table(spark, sf_dir, "events"))
    k = F.col("event_id") % 6
    attrs = F.when(k == 0, " hidden").when(k == 1, ' aria-hidden="true"').when(k == 2, ' style="color:red; display : none"').when(k == 3, ' style="visibility:hidden!important"').when(k == 4, ' style="opacity:0.0"').otherwise(' style="opacity:0.5"')
    captures, n = built(rows, F.col("event_id"), F.concat(F.lit("<div"), attrs, F.lit("><p>Kind: "), F.col("event_type"), F.lit("</p></div>")))
    return candidates.candidates(n, [Field("kind")]).select(_number().alias("event_id"), "value")


def rt_verify_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer segments claimed from pages; claims that were altered do not come up again and fall away."""
    rows = spread(table(spark, sf_dir, "customer"))
    captures, n = built(rows, F.col("c_custkey"), F.concat(F.lit("<p>Segment: "), F.col("c_mktsegment"), F.lit("</p>")))
    honest = candidates.candidates(n, [Field("segment")])
    k = _number() % 5
    forged = honest.withColumn("value", F.when(k == 0, F.lit("FORGED")).otherwise(F.col("value"))).withColumn("locator", F.when(k == 1, F.lit("p:nth-of-type(9)")).otherwise(F.col("locator")))
    good = reconcile.verified(forged, candidates.candidates(nodes(captures), [Field("segment")]))
    return good.select(_number().alias("c_custkey"), "value")


def snapshot_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct stored contents of the pages, and how many pages have each."""
    return read_pages(spark, sf_dir).groupBy("snapshot_hash").agg(F.count(F.lit(1)).alias("sources"), F.min("page_id").alias("first_page"))


def bound_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence bound to page rows on url, time and hash, after hashes of every fifth page were changed."""
    from factloom.operators import evaluate

    pages = read_pages(spark, sf_dir).select(F.lit("c").alias("case_id"), "url", "fetched_at", "snapshot_hash", "raw", F.col("page_id").alias("page_seq"))
    claimed = F.when(F.col("page_seq") % 5 == 0, F.concat(F.lit("x"), "snapshot_hash")).otherwise(F.col("snapshot_hash"))
    evidence = pages.select("case_id", F.col("page_seq").alias("page_id"), F.col("url").alias("source_url"), "fetched_at", claimed.alias("snapshot_hash"))
    return evaluate.evidence_bound(evidence, pages).select("page_id", "bound")


def nearest_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes found for suppliers as cards nested three deep: the nearest block with a price wins."""
    rows = spread(table(spark, sf_dir, "supplier"))
    deep = F.concat(F.lit("<section><div><div><h3>Plan "), F.col("s_suppkey").cast("string"), F.lit("</h3></div><p>USD "), F.col("s_suppkey").cast("string"), F.lit(" per seat billed yearly</p></div><p>USD 999 per seat billed yearly</p></section>"))
    captures, n = built(rows, F.col("s_suppkey"), F.concat(F.lit("<html><body>"), deep, F.lit("</body></html>")))
    names = rows.select(F.col("s_suppkey").cast("string").alias("page_key"), F.concat(F.lit("Plan "), F.col("s_suppkey").cast("string")).alias("plan_name"))
    found = plans.nearest_cards(n, names)
    return found.select(_number().alias("s_suppkey"), F.col("scope_path"))




def source_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML of each page's main heading, found again by its locator."""
    captures, n = page_nodes(spark, sf_dir)
    heads = candidates.page_facts(n).where("field = 'main_heading'").select("page_key", "locator")
    return heads.join(captures.select("page_key", "html"), "page_key").select(_number().alias("page_id"), source_node("html", "locator").alias("source"))


def scoped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's list items, as evidence, lie in a cited scope: the nav on even pages, the article on odd ones."""
    from factloom.operators import evaluate

    captures, n = page_nodes(spark, sf_dir)
    key = captures.select("page_key", F.col("page_id").alias("case_id"), F.col("url").alias("source_url"), "snapshot_hash", "fetched_at")
    every = elements(n, ("li", "nav", "article"))
    items = every.where("tag = 'li'").select("page_key", F.col("path").alias("locator")).join(key, "page_key")
    scopes = every.where("tag in ('nav', 'article')").select("page_key", "tag", F.col("path").alias("scope_locator")).join(key, "page_key").where("(case_id % 2 = 0) = (tag = 'nav')")
    cols = ["case_id", "source_url", "snapshot_hash", "fetched_at"]
    found = evaluate.in_scope(items.select(*cols, "locator"), scopes.select(*cols, "scope_locator"), ["case_id"])
    return found.select(F.col("case_id").alias("page_id"), "evidence_matches")


def common_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest node that contains both a page's main heading and its first paragraph."""
    from factloom.operators import evaluate

    _, n = page_nodes(spark, sf_dir)
    first = lambda tag: F.array_min(F.transform(tagged(F.col("nodes"), (tag,)), lambda x: x["node_id"]))
    pair = n.select("page_key", first("h1").alias("plan_id"), first("p").alias("value_id"))
    found = evaluate.common_scopes(pair.withColumn("claim_id", F.lit(0)), n)
    return found.select(_number().alias("page_id"), F.col("common.tag").alias("tag"))
