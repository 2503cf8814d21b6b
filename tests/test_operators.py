import pytest
from pyspark.sql import functions as F

from factloom.functions.dom import nodes
from factloom.operators import automatic, candidates, crawl, evaluate, inventory, plans, reconcile, store
from factloom.operators.candidates import Field
from factloom.plans import records, web
from factloom.sources import captures as cap
from factloom.sources.tables import materialize

SCHEMA = [Field("plan_price", "number", None, "month", "USD"), Field("usage_limit", "integer"), Field("support")]


def pages(spark, *htmls):
    rows = spark.createDataFrame([(str(i), f"https://x.example/p{i}", h) for i, h in enumerate(htmls)], "page_key string, url string, html string")
    return rows, materialize(nodes(rows), "test")


def states(spark, htmls, schema=SCHEMA, blocked=False, forge=None):
    """Field states of one job whose pages are htmls."""
    rows, n = pages(spark, *htmls)
    place = {"job_id": F.lit("j"), "page_seq": F.col("page_key").cast("int")}
    raw = candidates.candidates(n, schema)
    good = reconcile.verified(forge(raw) if forge else raw, candidates.candidates(nodes(rows), schema))
    jobs = spark.createDataFrame([("j", blocked)], "job_id string, blocked boolean")
    hits = candidates.label_hits(n, schema).withColumn("job_id", F.lit("j"))
    out = reconcile.field_states(good.withColumns(place), raw.withColumns(place), hits, jobs, candidates.per_field(jobs, schema))
    return {r.field: r for r in out.collect()}


def test_verified_conflicting_unverified_blocked_missing(spark):
    got = states(spark, ["<p>Plan price: $20 per month</p><ul><li>Usage limit: 5</li></ul>", "<p>Usage limit - 6</p><p>Support: soon</p>"])
    assert (got["plan_price"].state, got["plan_price"].value, got["plan_price"].unit, got["plan_price"].currency) == ("verified", "20", "month", "USD")
    assert got["usage_limit"].state == "conflicting" and [c.value for c in got["usage_limit"].candidates] == ["5", "6"]
    assert got["support"].state == "verified" and len(got["support"].evidence) == 1
    got = states(spark, ["<p>Plan price: €20 per year</p><p>Usage limit: many</p>"], blocked=True)
    assert {f: r.state for f, r in got.items()} == {"plan_price": "unverified", "usage_limit": "unverified", "support": "blocked"}
    assert {r.state for r in states(spark, ["<p>nothing</p>"]).values()} == {"missing"}


def test_equal_claims_keep_all_evidence_in_order(spark):
    got = states(spark, ["<p>Support: mail</p><dl><dt>x</dt><dd>Support: mail</dd></dl>", '<script type="application/ld+json">{"support":"mail"}</script>'])["support"]
    assert got.state == "verified" and [e.locator for e in got.evidence] == ["p:nth-of-type(1)", "dl:nth-of-type(1) > dd:nth-of-type(1)", "script:nth-of-type(1)::item(0)::support"]


def test_hidden_values_and_numbers_as_written(spark):
    got = states(spark, ['<div hidden><p>Support: mail</p></div><script type="application/ld+json">[1,{"usage_limit":9007199254740993,"plan_price":1.50}]</script>'], [Field("usage_limit", "integer"), Field("plan_price", "number"), Field("support")])
    assert got["support"].state == "missing" and got["usage_limit"].value == "9007199254740993" and got["plan_price"].value == "1.5" and got["plan_price"].evidence[0].raw_value == "1.50"


@pytest.mark.parametrize("column", ["value", "locator", "excerpt", "raw_value"])
def test_forged_claims_fall_away(spark, column):
    forged = states(spark, ["<p>Support: mail</p>"], forge=lambda raw: raw.withColumn(column, F.concat(column, F.lit("x"))))
    assert forged["support"].state == "unverified"


def test_page_facts_fall_back_by_page(spark):
    _, n = pages(spark, "<title> A &amp; B </title><meta property='OG:Title' content='no'><h1 hidden>no</h1><h1>H</h1>", "<meta property='og:title' content='C'><meta name='Description' content=' d  e '><meta property='og:site_name' content='S'>", f"<title>{'x' * 201}</title>")
    got = {(r.page_key, r.field): r.value for r in candidates.page_facts(n).collect()}
    assert got == {("0", "page_title"): "A & B", ("0", "main_heading"): "H", ("1", "page_title"): "C", ("1", "page_description"): "d e", ("1", "site_name"): "S"}


CARDS = """<main><section><h2>Team</h2><p>USD 29.50 per user/month billed annually</p><p>Usage limit: 10 seats</p><p>Support: Email</p></section>
<section><h2>Solo</h2><p>$9 per user/month billed monthly</p></section></main>"""


def plan_values(spark, html, name):
    _, n = pages(spark, html)
    names = spark.createDataFrame([("0", name)], "page_key string, plan_name string")
    return {(r.field, r.value, r.unit, r.currency, r.billing_period) for r in plans.plan_candidates(n, names).collect()}


def test_plan_cards(spark):
    got = plan_values(spark, CARDS, "team")
    assert ("named_plan", "team", None, None, None) in got and ("listed_price", "29.5", "month", "USD", "year") in got and ("currency", "USD", None, None, None) in got
    assert ("billing_period", "year", None, None, None) in got and ("support_channel", "Email", None, None, None) in got and ("usage_or_seat_limit", "10 seats", None, None, None) in got
    dollar = plan_values(spark, CARDS, "Solo")
    assert not any(f in ("listed_price", "currency") for f, *_ in dollar) and ("billing_period", "month", None, None, None) in dollar
    assert plan_values(spark, CARDS, "Enterprise") == set()


def test_plan_columns_and_spans(spark):
    table = "<table><tr><th>x</th><th>Basic</th><th>Gold</th></tr><tr><td>Price</td><td>USD 10 billed monthly</td><td>£20 billed yearly</td></tr><tr><td>Support</td><td>Support: Chat</td><td>Email</td></tr></table>"
    assert ("listed_price", "20", None, "GBP", "year") in plan_values(spark, table, "Gold")
    assert not any(f == "support_channel" for f, *_ in plan_values(spark, table, "Gold"))
    assert ("support_channel", "Chat", None, None, None) in plan_values(spark, table, "Basic")
    assert plan_values(spark, table.replace("<th>Gold", '<th colspan="2">Gold'), "Gold") == set()
    assert plan_values(spark, table.replace("<th>Basic", "<th>Gold"), "Gold") == set()


def test_periods_that_disagree_make_no_price(spark):
    html = "<div><h3>Pro</h3><p>EUR 5 price billed monthly or yearly</p></div>"
    assert {f for f, *_ in plan_values(spark, html, "Pro")} == {"named_plan"}


def facts_of(spark, html):
    rows, n = pages(spark, html)
    claims = materialize(automatic.all_claims(n), "test-claims")
    out = materialize(automatic.with_overview(automatic.facts(claims)), "test-facts")
    facts = {(r.grp, r.key): r for r in out.collect()}
    return facts, automatic.page_types(n, claims).first(), next(iter(facts.values()))


def test_automatic_facts_of_a_product(spark):
    html = """<html><head><title>Acme</title><script type="application/ld+json">{"@graph":[{"@type":"https://schema.org/Product","name":"Acme","url":"https://x.example/p0/","description":"Tools","offers":[{"price":49.50,"priceCurrency":"USD","name":"One"},{"price":5,"priceCurrency":"XYZ"}]},
    {"@type":"Article","headline":"Somebody else"}]}</script></head><body><h1>Acme</h1><dl><dt>Founded</dt><dd>1999</dd><dt>Cookie</dt><dd>y</dd></dl><p>Colour: red</p><footer><p>Colour: blue</p></footer></body></html>"""
    facts, kind, shown = facts_of(spark, html)
    assert facts["Product", "name"].value == "Acme" and (facts["Offer: One", "price"].value, facts["Offer: One", "price"].variant) == ("49.50", "One")
    assert facts["Details", "detail:founded"].value == "1999" and facts["Details", "detail:colour"].value == "red" and ("Details", "detail:cookie") not in facts
    assert facts["Page", "site_name"].state == "missing" and ("Article", "headline") not in facts
    assert kind.value == "product" and shown.overview_text == "Tools"


def test_ambiguous_details_and_foreign_entities(spark):
    facts, kind, shown = facts_of(spark, '<title>T</title><script type="application/ld+json">{"@type":"Organization","name":"T","url":"https://other.example/"}</script><p>Size: 1</p><p>Size: 2</p>')
    assert facts["Details", "detail:size"].state == "ambiguous" and [a.value for a in facts["Details", "detail:size"].alternatives] == ["1", "2"]
    assert ("Organization", "name") not in facts and (kind.value, list(kind.alternatives)) == ("general", []) and shown.overview_state == "missing"


def test_links_and_scores(spark):
    rows, n = pages(spark, '<a href="/a.PDF">x</a><a href="/faq#x">f</a><a href="/b">b</a><a href="/faq">again</a><a href="https://y.example/">y</a><a href="/pricing/hint">p</a><a>none</a><a href="http://[">bad</a>')
    got = [(r.url, r.score) for r in crawl.links(n, hints=["Hint"]).orderBy("rank").collect()]
    assert got == [("https://x.example/pricing/hint", 12), ("https://x.example/faq", 2), ("https://x.example/b", 0)]


def test_frontier_counts_attempts_and_stops_at_denial(spark):
    seeds = spark.createDataFrame([("j", "https://x.example/")], "job_id string, url string")
    edges = spark.createDataFrame([("https://x.example/", f"https://x.example/{i}", i) for i in range(5)] + [("https://x.example/0", "https://x.example/deep", 1)], "url string, target string, rank int")
    outcomes = spark.createDataFrame([("https://x.example/1", "HTTP_ERROR"), ("https://x.example/2", "ACCESS_DENIED")], "url string, error string")
    got = {r.url[18:]: (r.depth, r.visit_seq) for r in crawl.frontier(seeds, edges, outcomes, 2, 8).collect()}
    assert got == {"": (0, 1), "0": (1, 2), "1": (1, 3), "2": (1, 4)}
    got = {r.url[18:] for r in crawl.frontier(seeds, edges, outcomes.where("error = 'HTTP_ERROR'"), 2, 3).collect()}
    assert got == {"", "0", "1"}


def test_label_totals(spark):
    fields = spark.createDataFrame([("t", "j", f, "verified") for f in "abc"], "tenant string, job_id string, field_name string, state string")
    reviews = spark.createDataFrame([("t", "j", f, i, i, "correct") for i, f in enumerate("abc")], "tenant string, job_id string, field_name string, review_id int, updated_at int, verdict string")
    sessions = [("t", "j", "a", "r", 0.0, 45.0, 45.0), ("t", "j", "b", "r", 50.0, 70.0, 20.0), ("t", "j", "c", "r", 80.0, 90.0, 10.0), ("t", "j", "c", "r", 95.0, None, None)]
    kinds = "tenant string, job_id string, field_name string, reviewer_id string, started_at double, stopped_at double, elapsed_seconds double"
    row = store.label_totals(fields, reviews, spark.createDataFrame(sessions, kinds)).first()
    assert (row.minutes, row.minutes_per_accepted) == (1.25, 0.4167)
    row = store.label_totals(fields, reviews, spark.createDataFrame([*sessions, ("t", "j", "a", "r", 100.0, 105.0, 5.0)], kinds)).first()
    assert row.minutes == 1.3333
    assert store.session_seconds(spark.createDataFrame([*sessions, ("t", "j", "a", "r", 100.0, 105.0, 5.0)], kinds)).where("field_name = 'a'").first().time_spent_seconds == 50


def test_lost_claims_and_review_evidence(spark):
    puts = spark.createDataFrame([("t", "i", "h", "new"), ("t", "i", "h", "old")], "tenant string, idem string, request_hash string, owner string")
    claims = spark.createDataFrame([("t", "i", "h", "new", "pending")], "tenant string, idem string, request_hash string, owner string, state string")
    assert {r.owner: r.error for r in store.accepted_puts(puts, claims).collect()} == {"new": None, "old": "CLAIM_LOST"}
    evidence = spark.createDataFrame([("j", "u", "1", "h"), ("j", "u", "2", "h")], "job_id string, source_url string, fetched_at string, snapshot_hash string")
    page = spark.createDataFrame([("j", "u", "1", "h")], "job_id string, url string, fetched_at string, snapshot_hash string")
    kept = spark.createDataFrame([("j", "h")], "job_id string, snapshot_hash string")
    assert {r.fetched_at: r.source_bound for r in store.review_evidence(evidence, page, kept).collect()} == {"1": True, "2": False}


def test_greedy_scopes(spark):
    kinds = "case_id string, pos int, value string, unit string, currency string, locator string"
    actual = spark.createDataFrame([("c", 0, "1", None, None, "a > b"), ("c", 1, "1", None, None, "a > c"), ("d", 0, "1", None, None, "ab")], kinds)
    expected = spark.createDataFrame([("c", 0, "1", None, None, "a"), ("c", 1, "1", None, None, "a > c"), ("d", 0, "1", None, None, "a")], kinds).withColumnRenamed("locator", "scope_locator")
    assert {r.case_id: r.bag_matches for r in evaluate.scoped_bag_matches(actual, expected, ["case_id"]).collect()} == {"c": True, "d": False}


def test_supported_values(spark):
    rows = [("USD 1,000.50", "1000.5", "number", True), ("1 or 2", "1", "number", False), ("007", "7", "integer", True), ("7.5", "7.5", "integer", False), ("billed annually", "year", "string", True), ("Email only", "EMAIL", "string", True), ("", "x", "string", False), (None, "x", "string", False), ("-0", "0", "number", True), ("is TRUE", "true", "boolean", True)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, value string, kind string, want boolean")
    got = {r.i: r.got for r in frame.select("i", evaluate.value_supported(F.col("raw"), F.col("value"), F.col("kind")).alias("got")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[3] for r in rows]


def test_bootstrap(spark):
    sites = spark.createDataFrame([(f"s{i}", 3 if i % 2 else 1, 3, 4) for i in range(12)], "site string, correct_accepted int, accepted int, expected_values int")
    got = {r.metric: (r.low, r.high) for r in evaluate.bootstrap(sites).collect()}
    assert got == {r.metric: (r.low, r.high) for r in evaluate.bootstrap(sites.repartition(3)).collect()}
    assert got["field_precision"][0] < 2 / 3 < got["field_precision"][1]
    assert {r.low for r in evaluate.bootstrap(sites.limit(1)).collect()} == {None}


def test_case_sources_and_csv(spark, tmp_path):
    (tmp_path / "cases.json").write_text('[{"id":"a","site":"x.example","split":"held_out","category":"encoding","pages":{"https://x.example/":{"raw_base64":"6Q==","content_type":"text/html; charset=cp1252","final_url":"https://x.example/f"},"https://x.example/e":{"error":"HTTP_ERROR"}}},{"id":"b","site":"x.example","split":"development","category":"static","pages":{}}]')
    cases = cap.read_cases(spark, str(tmp_path / "cases.json"))
    row = cap.case_captures(cases).first()
    assert (row.html, row.url, row.encoding, cap.case_captures(cases).count()) == ("é", "https://x.example/f", "cp1252", 1)
    assert cap.split_violations(cases).first().site == "x.example"
    (tmp_path / "i.csv").write_bytes(b"\xef\xbb\xbfsite_id,split\ns1,held_out\n")
    assert cap.read_csv(spark, str(tmp_path / "i.csv"), "site_id string, split string").first().site_id == "s1"
    exported = cap.export_bundles(cap.case_captures(cases), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == exported.count() == 1


def test_approval_is_bound_to_bytes_and_time(spark):
    files = spark.createDataFrame([("f", bytearray(b"abc"))], "path string, content binary")
    record = {"scope_sha256": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", "approver": "a", "approved_at": "b", "authorization_text": "c"}
    got = inventory.approval_covers(files, record, F.to_timestamp(F.lit("2026-10-15 04:00:00"))).first()
    assert (got.same_bytes, got.in_window, got.signed) == (True, True, True)
    assert not inventory.approval_covers(files, record, F.to_timestamp(F.lit("2026-10-15 06:00:00"))).first().in_window


def test_fetch_outcomes(spark):
    rows = spark.createDataFrame([(403, "text/html", bytearray(b"x")), (500, "text/html", bytearray(b"x")), (200, "text/html", bytearray(1_000_001)), (200, "image/png", bytearray(b"x")), (200, "text/plain; charset=x", bytearray(b"x"))], "status int, kind string, raw binary")
    assert [r.c for r in rows.select(cap.fetch_code(F.col("status"), F.col("kind"), F.col("raw")).alias("c")).collect()] == ["ACCESS_DENIED", "HTTP_ERROR", "TOO_LARGE", "UNSUPPORTED_CONTENT", None]


def test_queries_take_whole_tables(spark, sf_dir, monkeypatch):
    found = web.crawl_frontier(spark, sf_dir).where("depth = 0").select("page_id").distinct().count()
    assert found == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    captured = []
    export = records.store.label_export
    monkeypatch.setattr(records.store, "label_export", lambda fields, reviews, sessions, pages: captured.append(pages.count()) or export(fields, reviews, sessions, pages))
    records.label_exports(spark, sf_dir)
    assert captured == [spark.read.parquet(f"{sf_dir}/events.parquet").count()]


def test_page_states_are_field_states(spark):
    """One pass over pages gives what candidates, verification and reconciliation give apart: also conflicts, labels without
    a value, units asked for, bytes that say something else, and pages that tell nothing."""
    from factloom.operators import candidates, reconcile
    from factloom.functions.dom import nodes
    from factloom.operators.candidates import Field
    from factloom.sources.captures import decode_html

    bodies = {
        "a": "<title>T</title><p>Price: USD 5</p>", "b": "<p>Price: USD 5</p><p>Price: USD 6</p>", "c": "<p>Price: none</p>", "d": "<p>Price: EUR 5</p>", "e": "", "f": "<p>Price: USD 5</p><li>price - USD 5.00</li>",
        "g": '<script type="application/ld+json">{"price": "7", "page_title": "x"}</script><p>Page title: y</p>', "h": "<p>Price: USD 5</p>", "i": None,
    }
    rows = [(k, f"https://x/{k}", v, (b"<p>Price: USD 8</p>" if k == "h" else (v or "").encode()), "text/html") for k, v in bodies.items()]
    captures = spark.createDataFrame(rows, "page_key string, url string, html string, raw binary, content_type string").repartition(3)
    fields = [Field("price", "number", None, None, "USD"), Field("page_title", "string")]
    n = nodes(captures)
    raw = candidates.candidates(n, fields)
    again = captures.select("page_key", decode_html("raw", "content_type")["text"].alias("html"))
    good = reconcile.verified(raw, candidates.candidates(nodes(again), fields))
    place = {"job_id": F.col("page_key"), "page_seq": F.lit(0)}
    jobs = captures.select(F.col("page_key").alias("job_id"), F.lit(False).alias("blocked"))
    want = reconcile.field_states(good.withColumns(place), raw.withColumns(place), candidates.label_hits(n, fields).withColumnRenamed("page_key", "job_id"), jobs, candidates.per_field(jobs, fields))
    got = reconcile.page_states(captures, fields).withColumnRenamed("page_key", "job_id")
    key = lambda df: sorted((str(r.asDict(recursive=True)) for r in df.select(*want.columns).collect()))
    assert key(got) == key(want)
    assert {r.state for r in got.collect()} == {"verified", "conflicting", "unverified", "missing"}
