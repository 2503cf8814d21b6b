import hashlib

import pytest

from factloom.functions.dom import parse
from factloom.functions.scalars import parse_scalar
from factloom.functions.urls import absolute, canonical, without_tracking
from factloom.operators.inventory import schema_violations
from factloom.sources.captures import decode


def tree(html):
    names = ["page_key", "node_id", "last_id", "parent_id", "depth", "tag", "path", "hidden", "attrs", "block_text", "shown_text", "plain_text", "only_string"]
    return [dict(zip(names, r, strict=True)) for r in parse("k", html)]


def test_unclosed_paragraphs_nest_and_stray_ends_are_ignored():
    rows = tree("<div><p>one<p>two</b></div>three<br>four</section>")
    assert [(r["tag"], r["parent_id"], r["last_id"]) for r in rows] == [("div", 0, 3), ("p", 1, 3), ("p", 2, 3), ("br", 0, 4)]
    assert rows[1]["shown_text"] == "one two" and rows[2]["path"] == "div:nth-of-type(1) > p:nth-of-type(1) > p:nth-of-type(1)"


def test_ordinals_count_siblings_of_the_same_name():
    rows = tree("<ul><li>a</li><b>x</b><li>b</li></ul>")
    assert [r["path"].split(" > ")[-1] for r in rows] == ["ul:nth-of-type(1)", "li:nth-of-type(1)", "b:nth-of-type(1)", "li:nth-of-type(2)"]


def test_texts_differ_in_comments_space_and_unshown_elements():
    row = tree("<p> a\n b <!-- note --><script>x</script><i hidden>h</i> &amp; c</p>")[0]
    assert row["shown_text"] == "a b & c" and row["block_text"] == "a\n b note & c" and row["plain_text"] == "a\n b x h & c"
    inner = tree("<template><p>inside</p></template>")
    assert inner[0]["shown_text"] == "" and inner[1]["shown_text"] == "inside"


@pytest.mark.parametrize("attrs", ["hidden", 'aria-hidden="TRUE"', 'style="display : none"', 'style="color:red;visibility:hidden!important"', 'style="opacity:0.00;"'])
def test_hiding(attrs):
    assert all(r["hidden"] for r in tree(f"<div {attrs}><p>x</p></div>"))


@pytest.mark.parametrize("attrs", ['style="opacity:0.5"', 'style="backdisplay:none"', 'aria-hidden="false"'])
def test_not_hiding(attrs):
    assert not any(r["hidden"] for r in tree(f"<div {attrs}><p>x</p></div>"))


def test_no_page_has_no_nodes():
    assert parse("k", None) == [] and parse("k", "plain") == []


@pytest.mark.parametrize(("raw", "kind", "want"), [
    (" $29.50 per month ", "number", ("29.5", "month", "USD", "decimal-string")),
    ("9007199254740993", "integer", ("9007199254740993", None, None, "integer-string")),
    ("9007199254740991", "integer", ("9007199254740991", None, None, "integer")),
    ("-5 GB", "number", ("-5", "GB", None, "integer")),
    ("20 dollars", "number", ("20", None, "USD", "integer")),
    ("12.000/user", "number", ("12", "user", None, "integer")),
    ("€ 5 USD", "number", (None,) * 4),
    ("1,000", "number", (None,) * 4),
    ("2.5", "integer", (None,) * 4),
    ("0.1234567890123456789012345678901", "number", ("0.1234567890123456789012345679", None, None, "decimal-string")),
    ("9" * 101, "number", (None,) * 4),
    ("YES", "boolean", ("true", None, None, None)),
    ("maybe", "boolean", (None,) * 4),
    ("x" * 201, "string", (None,) * 4),
    ("  text ", "string", ("text", None, None, None)),
    (None, "string", (None,) * 4),
])
def test_scalars(raw, kind, want):
    assert parse_scalar(raw, kind) == want


@pytest.mark.parametrize(("url", "want"), [
    ("HTTP://Example.COM./a?b=1#c", "http://example.com/a?b=1"), ("https://bücher.example", "https://xn--bcher-kva.example/"), ("https://x.example:8443/p", "https://x.example:8443/p"),
    ("ftp://x.example/", None), (" https://x.example/", None), ("https://u:p@x.example/", None), ("https://printer.local/", None), ("https://x.example:99999/", None), ("https:///p", None), (None, None), ("https://a\x01b.example/", None),
])
def test_canonical_urls(url, want):
    assert canonical(url) == want


def test_tracking_and_joining():
    assert without_tracking("https://x.example/p?UTM_Source=a&b=2&fbclid=3&c=") == "https://x.example/p?b=2&c="
    assert absolute("https://x.example/a/b", "../c#d") == "https://x.example/c"
    assert absolute("https://x.example/", "mailto:a@b.example") is None


@pytest.mark.parametrize(("raw", "kind", "want"), [
    ("é".encode("cp1252"), 'text/html; charset="windows-1252"', ("é", "cp1252", 0)),
    (b"\xef\xbb\xbf\xc3\xa9", "text/html; charset=latin-1", ("é", "utf-8-sig", 0)),
    (b"<meta charset=cp1252>\xe9", "text/html", ("<meta charset=cp1252>é", "cp1252", 0)),
    (b"\xe9\xe9", "text/html; charset=nonsense", ("��", "utf-8", 2)),
    (b"abc", "text/html; charset=base64", ("abc", "utf-8", 0)),
    (None, None, (None, None, None)),
])
def test_decoding(raw, kind, want):
    assert decode(raw, kind) == want


def test_request_schemas():
    good = {"type": "object", "properties": {n: {"type": "string"} for n in ("a", "b", "c")}, "required": ["a"]}
    assert schema_violations(good) == []
    assert schema_violations({**good, "properties": {"a": {"type": "string"}}}) == ["3 to 10 properties"]
    assert "required" in schema_violations({**good, "required": ["a", "a"]})
    assert "x-unit" in schema_violations({**good, "properties": {**good["properties"], "d": {"type": "string", "x-unit": "GB"}}})
    assert "property name" in schema_violations({**good, "properties": {**good["properties"], "1d": {"type": "string"}}})
    assert schema_violations(None) == ["not an object"]


def test_hash_is_of_bytes():
    assert hashlib.sha256("é".encode("cp1252")).hexdigest() != hashlib.sha256("é".encode()).hexdigest()
