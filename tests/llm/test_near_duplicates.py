import numpy as np
import pytest
import xxhash

from factloom.llm import components, embeddings, golay, simhash


def brute_components(ids, linked):
    least = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            m = min(least[i], least[j])
            if least[i] != m or least[j] != m:
                least[i] = least[j] = m
                changed = True
    return least


def test_golay_code_is_perfect():
    words = np.unique(np.arange(1 << 12, dtype=np.uint32) << 11 | golay.PARITY)
    assert len(words) == 1 << 12 and np.array_equal(golay.index(words), words >> 11)
    some = np.random.default_rng(1).integers(0, 1 << 23, 2000).astype(np.uint32)
    distance = np.bitwise_count(some[:, None] ^ words[None, :])
    assert (distance.min(1) <= 3).all() and np.array_equal(distance.argmin(1), golay.index(some))
    near = golay.nearby(some)
    for bit in range(23):
        assert (near == golay.index(some ^ np.uint32(1 << bit))[:, None]).any(1).all()


def plain_fingerprint(text):
    words = text.lower().split() if text.isascii() else text.encode().lower().decode().split(" ")
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words and words != [""] else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", ["", "one", "one two", "One two THREE four", "É a é b", "a b c a b c a b c", "x  y\t\nz w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text.replace("\t", " ").replace("\n", " ") if text.isascii() else text)
    assert simhash.fingerprint(None) == 0


def test_links_join_all_within_three_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEY", 200)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    near = [int(b) ^ sum(1 << int(q) for q in rng.choice(64, 3, replace=False)) for b in base]
    crowd = [int(base[0]) ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)]  # a very large group
    every = np.unique(np.array([*base.tolist(), *near, *crowd], np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp bigint")
    links = [tuple(r) for r in simhash.links(frame).collect()]
    values = np.array(links, np.int64).view(np.uint64)
    assert (np.bitwise_count(values[:, 0] ^ values[:, 1]) <= 3).all()
    i, j = np.nonzero(np.bitwise_count(every[:, None] ^ every[None, :]) <= 3)
    ids = every.view(np.int64).tolist()
    assert brute_components(ids, links) == brute_components(ids, [(ids[a], ids[b]) for a, b in zip(i, j, strict=True)])


def test_near_duplicates_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = simhash.near_duplicates(docs).toPandas()
    prints = got.fp.to_numpy().view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    ids = got.id.tolist()
    want = brute_components(ids, [(ids[a], ids[b]) for a, b in zip(i, j, strict=True)])
    assert dict(zip(ids, got.component, strict=True)) == want
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(want.values())


def test_odd_documents(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, " \n", "z"), (4, "a b c d", "w"), (4, "a b c d", "w"), (None, "a b c d", "v")], "doc_id bigint, text string, fp string")
    got = sorted((r.id if r.id is not None else -1, r.component) for r in simhash.near_duplicates(rows).collect())
    assert got == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    assert simhash.near_duplicates(rows.where("false")).count() == 0


def test_one_row_of_each_group(spark):
    """Copies that share an id, groups that share an id, and rows without one: a row is kept or goes by itself."""
    a, b = "red fish blue fish one fish two", "something else entirely that shares no words at all with it"
    rows = [(1, a, "p"), (1, a, "p"), (2, a, "q"), (3, b, "r"), (3, a, "s"), (None, b, "t"), (None, a, "u"), (4, None, "v"), (5, "", "w"), (None, "lone text of a row that has no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, [rows[0], rows[3], rows[7], rows[9]]))
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (5, 4), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(60)}}
    assert components.connected_components(edges.where("false")).count() == 0


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    near = np.concatenate([c + 0.12 * rng.standard_normal((40, 16)) for c in centres])
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate([*near, *rng.standard_normal((150, 16))])]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [1.0, 2.0]), (906, rows[0][1]), (907, [1e-200] * 16), (908, [1e200] * 16), (0, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, node string")
    valid = [k for k, (_, v) in enumerate(rows) if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([rows[k][1] for k in valid])
    m = m / np.abs(m).max(1, keepdims=True)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.9
    np.fill_diagonal(linked, False)
    for hot in (4096, 20):
        monkeypatch.setattr(embeddings, "HOT_BUCKET", hot)
        monkeypatch.setattr(embeddings, "CHUNK", max(8, hot // 2))
        got = embeddings.near_duplicates(frame).collect()
        assert len(got) == len(rows)
        found = sum(r.n_links for r in got)
        assert 0.97 * linked.sum() <= found <= linked.sum()
        assert all(r.n_links == 0 and r.component == r.id for r in got if 900 <= r.id <= 905)
    ids = [rows[k][0] for k in valid]
    want = brute_components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked), strict=True)])
    assert {r.id: r.component for r in got if r.id in want} == want
    assert embeddings.near_duplicates(frame.where("false")).count() == 0
