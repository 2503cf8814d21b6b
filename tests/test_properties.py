"""Invariants: states do not depend on row order or partitions, accepted values have evidence, numbers stay exact."""

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions.dom import parse
from factloom.functions.scalars import parse_scalar
from factloom.operators import reconcile

CLAIM = st.tuples(st.sampled_from("fgh"), st.sampled_from(["1", "2", None]), st.sampled_from(["month", None]), st.integers(0, 2), st.integers(0, 5))
KINDS = "field string, value string, unit string, page_seq int, node_id int, currency string, billing_period string, encoding string, src_rank int, item_idx int, page_key string, locator string, excerpt string, raw_value string, job_id string"


@settings(max_examples=4, deadline=None)
@given(claims=st.lists(CLAIM, max_size=12), blocked=st.booleans())
def test_states_do_not_depend_on_order(spark, claims, blocked):
    rows = [(f, v, u, p, n, None, None, None, 0, k, str(p), f"l{k}", "e", "r", "j") for k, (f, v, u, p, n) in enumerate(claims)]
    jobs = spark.createDataFrame([("j", blocked)], "job_id string, blocked boolean")
    fields = spark.createDataFrame([("j", f, None, None) for f in "fghi"], "job_id string, name string, x_unit string, x_currency string")

    def run(ordered, parts):
        found = spark.createDataFrame(ordered, KINDS).repartition(parts)
        return sorted(map(str, reconcile.field_states(found, found, found, jobs, fields).collect()))

    first = run(rows, 1)
    assert first == run(rows[::-1], 3)
    for r in reconcile.field_states(*[spark.createDataFrame(rows, KINDS)] * 3, jobs, fields).collect():
        own = {(v, u) for f, v, u, _, _ in claims if f == r.field}
        assert r.state == ("verified" if len(own) == 1 else "conflicting" if own else "blocked" if blocked else "missing")
        assert r.state != "verified" or len(r.evidence) > 0
        assert r.state != "conflicting" or len(r.candidates) == len(own)


@settings(max_examples=200, deadline=None)
@given(digits=st.from_regex(r"-?[0-9]{1,40}(\.[0-9]{1,20})?", fullmatch=True))
def test_numbers_stay_exact(digits):
    value, _, _, encoding = parse_scalar(digits, "number")
    whole = Decimal(digits) == Decimal(digits).to_integral_value()
    if whole or len(digits.strip("-0").replace(".", "")) <= 28:  # fractions are rounded beyond 28 digits
        assert Decimal(value) == Decimal(digits)
    assert encoding == ("decimal-string" if "." in value else "integer" if whole and abs(int(value)) <= 2**53 - 1 else "integer-string")


@settings(max_examples=200, deadline=None)
@given(html=st.text(alphabet="<>/pdiv hr!-=\"'&;a", max_size=60))
def test_any_text_gives_a_tree(html):
    rows = parse("k", html)
    for k, r in enumerate(rows, 1):
        assert r[1] == k and r[1] <= r[2] <= len(rows) and 0 <= r[3] < k
        if r[3]:
            assert rows[r[3] - 1][2] >= r[2] and r[4] == rows[r[3] - 1][4] + 1
    assert len({r[6] for r in rows}) == len(rows)


def test_null_values_group_together(spark):
    rows = [("f", None, None, 0, k, None, None, None, 0, k, "0", f"l{k}", "e", "r", "j") for k in range(3)]
    found = spark.createDataFrame(rows, KINDS)
    jobs = spark.createDataFrame([("j", False)], "job_id string, blocked boolean")
    fields = spark.createDataFrame([("j", "f", "", "")], "job_id string, name string, x_unit string, x_currency string")
    row = reconcile.field_states(found, found, found, jobs, fields).select("state", F.size("evidence").alias("n")).first()
    assert (row.state, row.n) == ("verified", 3)
