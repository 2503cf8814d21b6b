"""The as-of join, redirect chains, bootstrap draws, deep pages, amounts and charsets against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import dom
from factloom.functions.scalars import money
from factloom.operators import evaluate, store
from factloom.operators.asof import asof_join
from factloom.plans import audits, records
from factloom.sources import captures


@pytest.mark.parametrize("width", [1.0, 7.5, 1000.0])
def test_asof_join(spark, width):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *(x / 2 for x in range(-20, 60))])) for i in range(300)]
    records = [(rng.choice(["a", "b", None]), float(rng.randrange(-10, 30)), rng.randrange(5)) for _ in range(40)] + [("a", None, 1)]
    got = asof_join(spark.createDataFrame(rows, "i int, k string, at double"), spark.createDataFrame(records, "k string, at double, v int"), "k", "at", "r", width)
    found = {r.i: (r.r.at, r.r.v) if r.r else None for r in got.collect()}
    want = {i: max(((a, v) for key, a, v in records if key == k and a is not None and a <= at), default=None) if k is not None and at is not None else None for i, k, at in rows}
    assert found == want and len(found) == 300


def test_fetch_codes_measures_the_bodies_of_all_events(spark, sf_dir, monkeypatch):
    """Every tenth fetch has a body over the limit, and the outcome comes from its bytes, not from a number beside it."""
    logs = []
    page_source = captures.page_source
    monkeypatch.setattr(captures, "page_source", lambda log, *more: logs.append(log) or page_source(log, *more))
    events = records.fetch_codes(spark, sf_dir).count()
    sizes = dict(logs[0].groupBy(F.octet_length("raw"), F.col("event_id") % 10 == 0).count().select(F.struct("octet_length(raw)", "((event_id % 10) = 0)"), "count").collect())
    assert set(sizes) == {(captures.MOST_BYTES + 1, True), (1, False)} and sum(sizes.values()) == events


def test_redirect_chains_end_where_they_fail(spark):
    hop = lambda host, at, status, location=False: (f"https://{host}", host, float(at), status, location)
    log = [
        ("fine", [hop("a", 1, 302, True), hop("b", 2, 200)]), ("second host denies", [hop("a", 1, 302, True), hop("d", 2, 200)]), ("denied later only", [hop("d", 0, 200)]), ("out", [hop("a", 1, 302, True), hop("z", 2, 200)]),
        ("no robots yet", [hop("b", -5, 200)]), ("nowhere", [hop("a", 1, 302)]), ("many", [hop("a", i, 302, True) for i in range(1, 7)]), ("none", []),
    ]
    robots = [("https://a", 0.0, 200, False), ("https://b", 0.0, 404, None), ("https://d", -1.0, 200, False), ("https://d", 1.0, 200, True)]
    frame = spark.createDataFrame([(k, h, "text/html", 10) for k, h in log], "k string, hops array<struct<origin:string,host:string,at:double,status:int,location:boolean>>, content_type string, n_bytes int")
    rules = spark.createDataFrame(robots, "origin string, at double, robots_status int, denied boolean")
    got = {r.k: (r.code, r.hop) for r in captures.redirect_chains(frame, rules, ["a", "b", "d"], "k", 2.0).collect()}
    assert got == {
        "fine": (None, None), "second host denies": ("ROBOTS_DENIED", 1), "denied later only": (None, None), "out": ("OUT_OF_SCOPE", 1), "no robots yet": ("ROBOTS_UNAVAILABLE", 0), "nowhere": ("BAD_REDIRECT", 0), "many": ("REDIRECT_LIMIT", 4),
        "none": ("HTTP_ERROR", 0),
    }


def test_bootstrap_draws_have_the_law_of_resampling(spark):
    sizes = [300, 0, 500, 224]
    picks = np.stack([evaluate.resampled(sizes, b, 4000, 7) for b in range(4)])
    assert (picks.sum(0) == 1024).all() and (picks[1] == 0).all()
    for size, own in zip(sizes, picks, strict=True):
        p = size / 1024
        assert abs(own.mean() - 1024 * p) < 1.5 and abs(own.var() - 1024 * p * (1 - p)) < 0.1 * 1024 * p * (1 - p) + 1e-9
    sites = spark.createDataFrame([(f"s{i}", i % 4, 3 + i % 2, 5) for i in range(700)], "site string, correct_accepted int, accepted int, expected_values int")
    sums = evaluate.bootstrap_sums(sites, draws=50, block_sites=64).toPandas()
    assert len(sums) == 50 and (sums["picks"] == 700).all() and (sums["expected_values"] == 3500).all() and sums["accepted"].nunique() > 10
    again = evaluate.bootstrap_sums(sites.repartition(7), draws=50, block_sites=64).toPandas()
    assert sums.sort_values("draw").values.tolist() == again.sort_values("draw").values.tolist()


def test_intervals_are_places_in_the_sorted_draws(spark):
    sites = spark.createDataFrame([(f"s{i}", i % 4, 3 + i % 2, 5) for i in range(40)], "site string, correct_accepted int, accepted int, expected_values int")
    sums = evaluate.bootstrap_sums(sites).toPandas()
    recall = sorted(round(c / e, 4) for c, e in zip(sums["correct_accepted"], sums["expected_values"], strict=True))
    got = {r.metric: (r.low, r.high) for r in evaluate.bootstrap(sites).collect()}
    assert got["field_recall"] == (recall[int(0.025 * 499)], recall[int(0.975 * 499)])


def test_deep_pages_take_room_in_proportion():
    import tracemalloc

    def peak(depth):
        tracemalloc.start()
        tree = dom._tree("<div>" * depth + "<p>x</p>")
        rows = [dom._kept(tree.pieces, n) for n in tree.nodes]
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(rows) == depth + 1
        return size

    assert peak(40_000) < 12 * peak(4_000)


def test_locators_of_a_page_are_found_in_one_walk(spark):
    html = "<html><body>" + "<div>" * 300 + "<p>a</p><p>b <b>c</b></p>" + "</div>" * 300 + "<p>d</p></body></html>"
    pages = dom.nodes(spark.createDataFrame([("k", html)], "page_key string, html string"))
    rows = dom.elements(pages, ("p", "b")).select("path", "tag").collect()
    assert len(rows) == 4 and rows[0].path.count(" > ") == 302
    got = dom.sources_of(html, [*(r.path for r in rows), "html:nth-of-type(2)", None, ""])
    assert got == ["<p>a</p>", "<p>b <b>c</b></p>", "<b>c</b>", "<p>d</p>", None, None, None]


def test_amounts_are_read_outward_from_their_number(spark):
    cases = {
        "USD 1,299.50 per seat": ("1,299.50", None, True, "USD 1,299.50"), "from $ 5 monthly": ("5", "$", True, "$ 5"), "eur€7": ("7", "€", True, "eur€7"), "US$29": ("29", None, False, "29"), "US $29": ("29", "$", True, "$29"),
        "5 USD 29": ("5", None, True, "5 USD"), "v2.50 GBP": ("50", None, True, "50 GBP"), "AUSD 29": ("29", None, False, "29"), "USD29": ("29", None, True, "USD29"), "INR ₹ 3": ("3", "₹", True, "INR ₹ 3"), "x9": None, "": None, "no amount": None, "10": ("10", None, False, "10"),
    }
    rows = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string").select("t", money(F.col("t")).alias("m")).collect()
    got = {r.t: r.m and (r.m.number, r.m.sign, r.m.marked, r.m.whole.strip()) for r in rows}
    assert got == cases | {None: None}


def test_charsets_by_their_parameters():
    names = lambda kind, head="": list(captures.charset_names(kind, head))
    assert names("text/html; Charset = 'latin1'; x=1") == ["latin1"] and names('text/html;charset="utf-16"') == ["utf-16"] and names("text/html") == []
    assert names("text/html; charset=", '<META http-equiv=x content="text/html; charset=koi8-r"><meta charset=utf-8>') == ["koi8-r"]
    assert names("", "<meta name=a><meta charset = 'cp1252'") == ["cp1252"] and names("x; charset=a", "<meta charset=b>") == ["a", "b"]
    assert Counter(captures.decode(b, k)[1] for b, k in ((b"\xef\xbb\xbfx", "text/html; charset=latin1"), (b"x", "text/html; charset=latin1"), (b"x", "charset=nonsense"))) == Counter({"utf-8-sig": 1, "iso8859-1": 1, "utf-8": 1})


def test_review_evidence_moves_each_side_once(spark, sf_dir):
    """Evidence, page rows and stored hashes with nulls, repeats and further columns against plain Python; sides that lie by
    job stay where they are, and the query moves three narrow sides of its lines and neither urls nor hashes."""
    rng = random.Random(5)
    some = lambda *values: rng.choice([*values, None])
    evidence = [(i, some("j", "k"), some("u", "v"), some(1, 2), some("g", "h"), {"x": i}) for i in range(400)]
    pages = [(some("j", "k"), some("u", "v"), some(1, 2), some("g", "h")) for _ in range(14)]
    kept = [("j", "g"), ("j", "g"), ("k", "h"), (None, "h"), ("k", None)]
    sides = [spark.createDataFrame(evidence, "i int, job_id string, source_url string, fetched_at int, snapshot_hash string, more map<string,int>"), spark.createDataFrame(pages, "job_id string, url string, fetched_at int, snapshot_hash string"), spark.createDataFrame(kept, "job_id string, snapshot_hash string")]
    found = store.review_evidence(*[side.repartition("job_id") for side in sides])
    want = {i: None not in key and tuple(key) in pages and (key[0], key[3]) in kept for i, *key, _ in evidence}
    assert {r.i: r.source_bound for r in found.collect()} == want and set(want.values()) == {True, False}
    assert {*found.columns} == {*sides[0].columns, "source_bound"} and all(r.more == {"x": r.i} for r in found.collect()) and found.count() == 400
    moves = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert len(moves(store.review_evidence(*[side.repartition("job_id") for side in sides]))) == 3
    assert len(moves(audits.evidence_views(spark, sf_dir))) == 3
