"""Operators 11 to 13 against SQL on whole tables, and against plain Python on odd and random ones."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.llm import divergence, queries, ranking, suffixes

DOCS = "doc_id bigint, text string, lang string, source string, `a.b` string, row string, term string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, "x", "y", "z") for i, t, lang, src in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_tput_search", "op12_suffix_dedup", "op13_source_divergence"])
def test_whole_tables_against_sql(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(rows.columns)
    got = sorted((tuple(r[c] for c in columns) for r in rows.collect()), key=repr)
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = db.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in found.fetchall()), key=repr)
    assert got == want and got


# 11 ----------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def scored(docs, items, k):
    """Every score by the formula, in plain Python."""
    words = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, length = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for row, (doc, w) in enumerate(words):
            tf, m = Counter(w), 50 + (50 * len(w) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if tf[t])
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, row, doc))
        out += [(item, rank, s[4], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("k", "head"), [(3, 1), (50, 200)])
def test_search_is_exact(spark, monkeypatch, k, head):
    """Many ties, one word in most documents, null and repeated ids, empty texts; short heads and small blocks."""
    monkeypatch.setattr(ranking, "HEAD", head)
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "a1", "ÀB"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 30))) + rng.choice(["", " the", " The;the"]) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[7]), (None, texts[8]), (7, ""), (8, None), (9, "!!! ?"), (1000, "the " * 4000)]
    items = [(1, "the w1 W2 w3"), (1, "w5 w5 w6"), (None, "ÜnÏ ünï Ünï"), (3, ""), (4, None), (5, "nowhere"), (6, " ".join(vocabulary))]
    frame = docs_of(spark, [(i, t, "en", "s") for i, t in docs])
    found = ranking.search(frame.repartition(5), spark.createDataFrame(items, "item_id bigint, text string"), k).collect()
    want = scored(docs, items, k)
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in found) == want


def test_search_in_blocks_of_queries_and_of_nothing(spark, monkeypatch):
    docs = docs_of(spark, [(i, f"one w{i % 7} w{i % 5}", "en", "s") for i in range(60)])
    items = spark.createDataFrame([(i, f"w{i} w{i + 1} one") for i in range(6)], "item_id bigint, text string")
    whole = {tuple(r) for r in ranking.search(docs, items, 4).collect()}
    monkeypatch.setattr(ranking, "TERMS", 8)
    monkeypatch.setattr(ranking, "BROADCAST", 0)
    assert {tuple(r) for r in ranking.search(docs, items, 4).collect()} == whole and len(whole) == 24
    for d, q in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("doc_id < 0"), items.where("false"))):
        empty = ranking.search(d, q, 4)
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


# 12 ----------------------------------------------------------------------------------------------------


def without_repeats(docs, length):
    """Kept bytes of each row by a table of every string."""
    strings, least = defaultdict(list), {}
    for row, (doc, text) in enumerate(docs):
        body, doc = (text or "").encode(), -math.inf if doc is None else doc
        for at in range(len(body) - length + 1):
            s = body[at : at + length]
            strings[s].append((doc, row, at))
            least[s] = min(least.get(s, math.inf), doc)
    gone = [bytearray(len((t or "").encode())) for _, t in docs]
    for s, places in strings.items():
        for doc, row, at in places:
            if doc > least[s]:
                gone[row][at : at + length] = b"\1" * length
    out = []
    for (doc, text), mask in zip(docs, gone, strict=True):
        body = (text or "").encode()
        runs = sum(1 for i, g in enumerate(mask) if g and (i == 0 or not mask[i - 1]))
        out.append((doc, len(body), sum(mask), runs, hashlib.sha256(bytes(b for b, g in zip(body, mask, strict=True) if not g)).hexdigest()))
    return Counter(out)


def planted(rng, n):
    letters = "abcdefgh  é"
    noise = lambda k: "".join(rng.choices(letters, k=k))
    passages = [noise(k) for k in (49, 50, 51, 80, 300)] + ["ab" * 60, "x" * 200]
    texts = []
    for _ in range(n):
        parts = [noise(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 20)
            parts += [p[cut:], noise(rng.randrange(0, 40))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("sizes", [None, (600, 40, 64, 8)])
def test_repeats_are_removed_exactly(spark, monkeypatch, sizes):
    """Also with small chunks, buckets and units, so that one string fills several buckets."""
    if sizes:
        for name, value in zip(("BUCKET", "UNIT", "MOST_BUCKETS"), sizes[1:], strict=True):
            monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(12)
    texts = planted(rng, 120)
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[4]), (3, texts[3]), (3, texts[3]), (None, texts[9]), (None, None), (500, ""), (501, "y" * 49), (502, texts[2] * 30), (503, "é" * 400)]
    frame = docs_of(spark, [(i, t, "en", "s") for i, t in docs]).repartition(4)
    found = suffixes.remove_repeats(frame, chunk_bytes=sizes[0] if sizes else suffixes.CHUNK).select("row.*", "kept", "kept_sha256", "n_bytes", "n_removed", "n_spans").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == without_repeats(docs, suffixes.MATCH)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and r["a.b"] == "x" and r.term == "z" for r in found)


def test_long_texts_are_read_in_parts():
    """Parts overlap, so that they have every run of starts that the whole has."""
    import zstandard

    rng = random.Random(1)
    texts = [t.encode() for t in planted(rng, 20)]
    ends, whole = [], b""
    for t in texts:
        whole += t
        ends.append(len(whole))
    chunk = suffixes._Chunk(0, list(range(20)), ends, zstandard.ZstdCompressor().compress(whole))
    starts = lambda step: {at + s for _, _, first, last, at in chunk.parts(step) for a, b in zip(first.tolist(), last.tolist(), strict=True) for s in range(a, b + 1)}
    assert starts(97) == starts(len(whole) + 1) == {s for b, e in zip([0, *ends], ends, strict=False) for s in range(b, e - suffixes.MATCH + 1)}


def test_split_strings_are_compared_across_buckets():
    """Rows of one frequent string in two buckets: each settles its own, and what is left has every open match."""
    import numpy as np

    text = ("frequent passage that stands in every document " * 3).encode()
    body = np.frombuffer(text * 4, np.uint8)
    chunk = suffixes._Chunk(0, [5, 6, 7, 8], [len(text) * i for i in (1, 2, 3, 4)], __import__("zstandard").ZstdCompressor().compress(body.tobytes()))
    rows = np.concatenate([chunk.rows(*p) for p in chunk.parts()])
    rows["split"] = True
    half = rows["nth"] % 2 == 0
    (rest_a, marks_a), (rest_b, marks_b) = suffixes.settle(rows[half]), suffixes.settle(rows[~half])
    assert set(rest_a["doc"]) >= {5} and set(rest_b["doc"]) >= {6}
    assert set(marks_a["nth"]) == {2} and set(marks_b["nth"]) == {3}


def test_repeats_of_nothing(spark):
    empty = docs_of(spark, []).where("false")
    assert suffixes.remove_repeats(empty).count() == 0
    short = docs_of(spark, [(1, "short", "en", "s"), (2, "short", "en", "s")])
    assert [(r.n_removed, bytes(r.kept)) for r in suffixes.remove_repeats(short).collect()] == [(0, b"short")] * 2


# 13 ----------------------------------------------------------------------------------------------------


def diverging(docs):
    terms = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    rows = [(lang or "", src or "", terms.findall((t or "").translate(LOWER))) for _, t, lang, src in docs]
    held, counts, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, src, w in rows:
        held[lang].update(set(w))
        counts[lang, src].update(w)
        whole[lang].update(w)
    kept = {lang: {t for t, n in c.items() if n >= 10} for lang, c in held.items()}
    out = set()
    p = lambda c, total, v: 1 + (10**9 * (c + 2)) // (total + 2 * v)
    freq = {}
    for key in [*counts, *[(lang,) for lang in {r[0] for r in rows}]]:
        c = counts[key] if len(key) == 2 else whole[key[0]]
        own = kept.get(key[0], set())
        total = sum(c[t] for t in own)
        freq[key] = {t: p(c[t], total, len(own)) for t in own}
    gap = lambda a, b: (a - b) ** 2 // (a + b)
    for lang, src in counts:
        pairs = sorted(((-sum(gap(freq[lang, src][t], freq[lang, o][t]) for t in kept.get(lang, set())), o.encode(), o) for la, o in counts if la == lang and o != src))
        out |= {(lang, src, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)}
        own = sorted((-gap(freq[lang, src][t], freq[lang,][t]), t.encode(), t) for t in kept.get(lang, set()) if counts[lang, src][t] and freq[lang, src][t] > freq[lang,][t])
        out |= {(lang, src, "term", t, -v, i) for i, (v, _, t) in enumerate(own[:10], 1)}
    return out


def test_divergence_of_odd_rows(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["É", "é", "naïve", "Z9z"]
    docs = [(i % 50, " ".join(rng.choices(words, k=rng.randrange(0, 15))) if i % 9 else (None if i % 2 else "  12 "), rng.choice(["en", "de", None, "xx", ""]) if i % 30 else "rare", rng.choice(["s1", "s2", "é", None, "z"])) for i in range(400)]
    found = divergence.divergence(docs_of(spark, docs).repartition(3)).collect()
    got = {(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in found}
    assert got == diverging(docs) and len(found) == len(got)


def test_divergence_without_terms_or_rows(spark):
    bare = docs_of(spark, [(1, "a b c", "en", "s"), (2, None, "en", "t"), (3, "", None, None)])
    assert {tuple(r) for r in divergence.divergence(bare).collect()} == {("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)}
    assert divergence.divergence(bare.where("false")).count() == 0
    assert divergence.divergence(bare).schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"


def test_large_counts_stay_exact(spark):
    row = spark.range(1).select(divergence.frequency(F.lit(10**15).cast("bigint"), F.lit(3 * 10**15).cast("bigint"), F.lit(10**9).cast("bigint")).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**15 + 2) // (3 * 10**15 + 2 * 10**9)
