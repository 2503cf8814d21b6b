"""Audit operators on small rows: nulls, repeats, empty sides."""

import json

from factloom.functions.addresses import chosen_address, resolution_code
from factloom.operators import audit
from factloom.sources import captures


def test_addresses_of_both_families(spark):
    rows = spark.createDataFrame([(["8.8.8.8", "2001:4860:4860::8888"],), (["fe80::1"],), (["8.8.8.8", "::1"],), (["no address"],), ([],), (None,)], "a array<string>")
    got = rows.select(resolution_code(rows.a), chosen_address(rows.a)).collect()
    assert [tuple(r) for r in got] == [(None, "2001:4860:4860::8888"), *[("PRIVATE_TARGET", None)] * 4, ("DNS_FAILED", None)]


def test_coverage_counts_repeats_nulls_and_missing_rows(spark):
    side = lambda *keys: spark.createDataFrame([(k,) for k in keys], "site string")
    got = {r.site: (r.a, r.b, r.complete) for r in audit.coverage(["site"], a=side("x", "y", "y", None), b=side("x", "z", None)).collect()}
    assert got == {"x": (1, 1, True), "y": (2, 0, False), "z": (0, 1, False), None: (1, 1, True)}
    assert audit.coverage(["site"], a=side(), b=side()).count() == 0


def test_sets_ignore_repeats_and_count_nulls(spark):
    rows = lambda *r: spark.createDataFrame(r, "j int, f string")
    got = {r.j: (r.missing, r.extra, r.same) for r in audit.set_differences(rows((1, "a"), (1, "a"), (2, "b"), (3, None)), rows((1, "a"), (2, "c"), (4, "d")), ["j"], "f").collect()}
    assert got == {1: ([], [], True), 2: (["b"], ["c"], False), 3: ([], [], False), 4: ([], ["d"], False)}


def test_page_cases_are_read_and_checked(spark, tmp_path):
    case = {"id": "p", "expected_type": "article", "html": "<h1>A</h1>", "expected": [["G", "n", 20], ["G", "none", None]], "expected_states": [["G", "n", "found_in_source"]], "forbidden_values": ["21", "22"]}
    (tmp_path / "cases.json").write_text(json.dumps({"fixture_version": "1", "cases": [case, {"id": "q", "expected_type": "general", "html": ""}]}))
    cases = captures.read_page_cases(spark, str(tmp_path / "cases.json"))
    assert [(r.case_id, bytes(r.raw)) for r in cases.orderBy("case_id").collect()] == [("p", b"<h1>A</h1>"), ("q", b"")]
    facts = spark.createDataFrame([("p", "G", "n", "22", "ambiguous", 0), ("p", "G", "n", "20", "found_in_source", 1)], "case_id string, grp string, key string, value string, state string, fact_idx int")
    checked = audit.corpus_checks(cases.selectExpr("*", "'article' AS page_type"), facts)
    assert {r.case_id: (r.checks, r.failed, r.found, r.passed) for r in checked.collect()} == {"p": (6, 1, 1, False), "q": (1, 1, 0, False)}
    assert tuple(audit.corpus_totals(checked).first()) == (2, 0, 7, 1)


def test_evidence_of_fields_and_candidates(spark):
    fields = spark.createDataFrame([("a", [("u1",)], [([("u2",)],), ([("u3",)],)]), ("b", None, [([("u4",)],)]), ("c", [("u5",)], None), ("d", None, None)], "job_id string, evidence array<struct<u:string>>, candidates array<struct<evidence:array<struct<u:string>>>>")
    assert sorted(map(tuple, audit.all_evidence(fields, "job_id").collect())) == [("a", "u1"), ("a", "u2"), ("a", "u3"), ("b", "u4"), ("c", "u5")]


def test_ledger_and_agreement_with_nothing_in_them(spark):
    ledger = spark.createDataFrame([("s", None, None, None, None)], "site string, compute_usd double, provider_usd double, compute_basis string, provider_basis string")
    inventory = spark.createDataFrame([("t", 1.0)], "site string, max_provider_spend_usd double")
    assert {r.site: r.violations for r in audit.ledger_violations(ledger, inventory).collect()} == {"s": ["not approved", "charges", "basis"], "t": ["not in the ledger"]}
    nothing = spark.createDataFrame([(None, None, None, None)], "confirmed_by string, confirmed_at string, analyst_hourly_rate_usd string, thresholds map<string,double>")
    assert audit.agreement_violations(nothing).first().violations == ["not confirmed", "rate", "thresholds"]


def test_addresses_as_the_standard_library_reads_them(spark):
    """Borders of all blocks, random addresses of both families in several spellings, and what is none."""
    import ipaddress
    import random

    from factloom.functions.addresses import NOT_PUBLIC, PUBLIC_INSIDE, is_public

    rng = random.Random(4)
    texts = ["", "1.2.3", "1.2.3.4.5", "01.2.3.4", "1.2.3.256", "1.2.3.4 ", "::", "::1", ":::", "1::2::3", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "fe80::1%eth0", "2600::1%", "2600::1%a%b", "::ffff:8.8.8.8", "::ffff:10.0.0.1",
             "64:ff9b::8.8.8.8", "::8.8.8.256", "2600::g", "2600:12345::", "1:", ":1", "::ffff:0:0", "2600::1.2.3", "2600:1.2.3.4", "٣.1.1.1", "8.8.8.8", "2A00:1450::8A", "1.2.3.4:5"]
    for block in NOT_PUBLIC + PUBLIC_INSIDE:
        net = ipaddress.ip_network(block)
        for n in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= n < 2**net.max_prefixlen:
                texts.append(str(type(net[0])(n)))
    for _ in range(500):
        six = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([2**128 - 1, 2**64 - 1, (2**128 - 1) << 96 & (2**128 - 1)]) | rng.choice([0, 0x2001 << 112, 0xFE80 << 112]) % 2**128)
        texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))), str(six), six.exploded.upper()]

    def want(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return False
        mapped = getattr(address, "ipv4_mapped", None)
        return (mapped or address).is_global

    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "a string")
    got = {r.a: r.p for r in rows.select("a", is_public(rows.a).alias("p")).collect()}
    assert got.pop(None) is False
    assert {t: p for t, p in got.items() if p != want(t)} == {} and 100 < sum(got.values()) < len(got)
