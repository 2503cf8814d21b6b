import pandas as pd
from pyspark.sql import functions as F

from factloom.plans import records
from factloom.streaming import sink, state

EVENT = "seq bigint, at double, tenant string, idem string, request_hash string, owner string, command string"


def outcomes(spark, events):
    frame = spark.createDataFrame([(i, float(at), "t", "k", h, o, c) for i, (at, h, o, c) in enumerate(events)], EVENT)
    return [r.outcome for r in state.replay_claims(frame.repartition(3)).where("seq is not null").orderBy("seq").collect()]


def test_takeover_conflict_and_lost_claim(spark):
    assert outcomes(spark, [(0, "h", "a", "claim"), (1, "h", "b", "claim"), (2, "x", "b", "claim"), (5, "h", "b", "claim"), (5, "h", "a", "put"), (6, "h", "b", "put"), (7, "h", "c", "claim")]) == ["owner", "pending", "conflict", "owner", "CLAIM_LOST", "stored", "complete"]


def test_renewal_release_and_cancel(spark):
    assert outcomes(spark, [(0, "h", "a", "claim"), (3, "h", "a", "renew"), (6, "h", "b", "claim"), (6.5, "h", "a", "release"), (7, "h", "b", "claim"), (8, "h", "z", "cancel"), (20, "h", "b", "put"), (21, "h", "c", "claim")]) == ["owner", "renewed", "pending", "released", "owner", "cancelled", "CLAIM_LOST", "cancelled"]


def streamed(spark, tmp_path, events, cut, through, name):
    """Rows of a stream over two files of events, before and after a restart between them."""
    rows = []
    for part, own in (("a", events.where(f"seq < {cut}")), ("b", events.where(f"seq >= {cut}"))):
        own.coalesce(1).write.parquet(str(tmp_path / "in" / part))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "*"))
        query = through(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    return {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_stream_gives_what_the_batch_gives(spark, sf_dir, tmp_path):
    events = records.claim_events(spark, sf_dir).where("seq < 200").withColumn("at", F.col("at") + 1000)  # a stream's watermark begins at 0
    got = streamed(spark, tmp_path, events, 100, state.stream_claims, "claims")
    want = {tuple(r) for r in state.replay_claims(events, until=1199.0).collect()}
    assert got == want and any(r[2] is None for r in got)


def test_lease_ends_without_a_further_event(spark, tmp_path):
    """The claim of key k is never renewed; events of another key let its lease pass."""
    rows = [(0, 100.0, "t", "k", "h", "a", "claim"), (1, 103.0, "t", "m", "h", "a", "claim"), (2, 106.0, "t", "m", "h", "a", "renew"), (3, 109.0, "t", "m", "h", "a", "put"), (4, 120.0, "t", "m", "h", "a", "claim")]
    events = spark.createDataFrame(rows, EVENT)
    got = streamed(spark, tmp_path, events, 3, state.stream_claims, "leases")
    assert ("t", "k", None, 104.0, "expire", "expired", "a", 1) in got
    assert got == {tuple(r) for r in state.replay_claims(events, until=120.0).collect()}


def test_review_stream_gives_what_the_batch_gives(spark, sf_dir, tmp_path):
    events = records.review_events(spark, sf_dir)
    got = streamed(spark, tmp_path, events, 500, state.stream_reviews, "reviews")
    want = {tuple(r) for r in state.replay_reviews(events).collect()}
    assert got == want and {"started", "stopped", "saved", "refused"} == {r[6] for r in got}


def test_review_groups_part_a_tenant(spark):
    rows = [("t", "j", "r"), ("t", "k", "r"), ("t", "m", "s"), ("u", "j", "r"), ("t", "n", None)]
    found = state.review_groups(spark.createDataFrame(rows, "tenant string, job_id string, reviewer_id string")).collect()
    groups = {(r.tenant, r.job_id): r.grp for r in found}
    assert len(groups) == 5 and groups["t", "j"] == groups["t", "k"] and len(set(groups.values())) == 4


def puts_of(spark, n):
    rows = [(i, f"t{i % 3}", f"j{i}", f"k{i // 2}", "h", "a", "2026-01-01", "{}", i % 4, [("f", "verified" if i % 2 else "missing")], [(f"s{i}", b"x", "utf-8", "text/html")] * 2) for i in range(n)]
    return spark.createDataFrame([(*r[:9], r[9], r[10]) for r in rows], sink.PUT)


def contents(spark, root):
    tables = {n: sorted(map(repr, sink.committed(spark, root, n).drop("batch").collect())) for n in sink.TABLES}
    return tables | {"sums": sorted(map(repr, sink.metrics(spark, root).collect()))}


def test_interrupted_sink_ends_like_an_undisturbed_one(spark, tmp_path):
    """A stream that stops between any two tables shows nothing of its batch, and after a restart gives the same tables."""
    puts = puts_of(spark, 12)
    claims = lambda s: s.createDataFrame([(f"t{t}", f"k{k}", "h", "a", "pending") for t in range(3) for k in range(5)], "tenant string, idem string, request_hash string, owner string, state string")
    for part, cond in (("a", "seq < 6"), ("b", "seq >= 6")):
        puts.where(cond).coalesce(1).write.parquet(str(tmp_path / "in" / part))
    results = []
    for stop in (None, "outcomes", "snapshots", "metrics"):
        root, stopped = str(tmp_path / f"sink-{stop}"), []

        def written(name, stop=stop, stopped=stopped):
            if name == stop and not stopped:
                stopped.append(name)
                raise RuntimeError("stopped between two tables")

        sink.create(spark, root)
        for _ in range(2 if stop else 1):
            stream = spark.readStream.schema(puts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
            query = sink.start(stream, root, str(tmp_path / f"c-{stop}"), claims, written)
            try:
                query.awaitTermination()
            except Exception:  # noqa: BLE001
                assert stopped and not any(contents(spark, root).values())
        results.append(contents(spark, root))
    assert all(r == results[0] for r in results) and len(results[0]["jobs"]) == 10 and len(results[0]["snapshots"]) == 10
    # a committed batch that comes again changes nothing, and a claim completes once
    assert not sink.commit(puts, 0, str(tmp_path / "sink-None"), claims)
    assert contents(spark, str(tmp_path / "sink-None")) == results[0]
    lost = sink.committed(spark, str(tmp_path / "sink-None"), "outcomes").where("error is not null").select("job_id").collect()
    assert {r.job_id for r in lost} == {"j10", "j11"}


def test_reviews_exclude_each_other(spark):
    rows = [(0, "j", "f", "r", "start"), (1, "k", "f", "r", "start"), (2, "j", "g", "s", "start"), (3, "j", "f", "r", "save"), (45, "j", "f", "r", "stop"), (46, "j", "f", "s", "save"), (47, "j", "f", "r", "save"), (48, "j", "f", "r", "stop")]
    frame = spark.createDataFrame([(i, float(at), "t", j, f, r, c) for i, (at, j, f, r, c) in enumerate(rows)], "seq bigint, at double, tenant string, job_id string, field_name string, reviewer_id string, command string")
    got = state.replay_reviews(frame).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["started", "refused", "refused", "refused", "stopped", "refused", "saved", "refused"] and got[6].seconds == 45


def test_paced_starts_are_a_loop(spark):
    rows = [(i, float(i % 7) * 1.5, [0.0, 2.0, 0.1][i % 3], 0.3 * (i % 4)) for i in range(30)]
    frame = spark.createDataFrame([("h", *r) for r in rows], "host string, seq int, at double, delay double, seconds double")
    got = {r.seq: r.start for r in state.paced_starts(frame).collect()}
    free, want = float("-inf"), {}
    for seq, at, delay, seconds in sorted(rows, key=lambda r: (r[1], r[0])):
        want[seq] = max(at, free)
        free = want[seq] + max(seconds, 0.5, delay)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_gaps_and_overlaps(spark):
    frame = spark.createDataFrame([("h", 1, 0.0, 0.4, 0.8), ("h", 2, 0.8, 1.5, 0.0), ("h", 3, 1.2, 1.3, 0.0)], "host string, seq int, start double, finish double, delay double")
    got = state.host_gaps(frame).orderBy("seq").collect()
    assert [r.kept for r in got] == [True, True, False] and round(got[2].overlap, 6) == 0.3
    sessions = spark.createDataFrame([("j", 0.0, 5.0), ("j", 4.0, 6.0), ("j", 6.0, 7.0)], "job_id string, started_at double, stopped_at double")
    assert state.session_overlaps(sessions).count() == 1


def test_live_duplicates(spark, tmp_path):
    rows = pd.DataFrame({"fetched_ts": pd.to_datetime(["2026-01-01 00:00:00", "2026-01-01 00:01:00", "2026-01-01 00:02:00"]), "tracking_key": ["a", "a", "b"], "snapshot_hash": ["h", "h", "h"]})
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("fetched_ts timestamp, tracking_key string, snapshot_hash string").parquet(str(tmp_path / "in"))
    query = state.live_duplicates(stream).writeStream.format("memory").queryName("live_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("live_out").agg(F.count("*")).first()[0] == 2
