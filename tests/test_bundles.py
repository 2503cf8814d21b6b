import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factloom.sources import bundles

HTML = b"<article><h3>Test Plan</h3><p>Support: Email</p></article>"
DIGEST = hashlib.sha256(HTML).hexdigest()
PAGES = "array<struct<requested_url:string,url:string,fetched_at:string,snapshot_hash:string,error_code:string,content_type:string,encoding:string,redirects:array<string>>>"
JOBS = f"site_id string, split string, category string, seed string, plan_name string, permission_note string, job_id string, observed_at string, kinds map<string,string>, pages {PAGES}"


def jobs_of(spark, sites, digest=DIGEST):
    page = ("https://f.example/", "https://f.example/", "2026-01-01T00:00:00+00:00", digest, None, "text/html", "utf-8", [])
    lost = ("https://f.example/x", None, None, None, "HTTP_ERROR", None, None, None)
    rows = [(s, split, "static", "https://f.example/", "Test Plan", "made here", f"job-{s}", "2026-01-01", {"support": "string", "limit": "integer"}, [page, lost]) for s, split in sites]
    return spark.createDataFrame(rows, JOBS), spark.createDataFrame([(f"job-{s}", digest, HTML) for s, _ in sites], "job_id string, snapshot_hash string, raw binary")


def label(reviewer, site, split, value="Email", state="verified", seconds=4, **more):
    path = "article:nth-of-type(1)"
    nodes = [{"role": "plan", "locator": f"{path} > h3:nth-of-type(1)", "excerpt": "Test Plan"}, {"role": "value", "locator": f"{path} > p:nth-of-type(1)", "excerpt": "Support: Email"}]
    source = {"source_url": "https://f.example/", "snapshot_hash": DIGEST, "fetched_at": "2026-01-01T00:00:00+00:00", "scope_locator": path, "relation": "same_scope", "raw_value": "Email", "nodes": nodes}
    support = {"state": state, "value": value if state == "verified" else None, "plan_name": "Test Plan", "judgment": "explicit", "evidence": [source] if state == "verified" else [], "reviewer_time_seconds": seconds}
    limit = {"state": "missing", "value": None, "plan_name": "Test Plan", "judgment": "explicit", "evidence": [], "reviewer_time_seconds": 1}
    return {"label_schema_version": "2.0", "site_id": site, "split": split, "labeling_mode": "blind", "reviewer_id": reviewer, "plan_name": "Test Plan", "fields": {"support": support, "limit": limit}} | more


def write(folder, **files):
    for name, content in files.items():
        (folder / (name.replace("__", ".").replace("reviewer_", "reviewer-") + ".json")).write_text(json.dumps(content))


def fields_of(spark, root):
    return {(r.site_id, r.field): r for r in bundles.labelled_fields(spark, str(root)).collect()}


def test_export_reads_back_and_a_failed_write_leaves_nothing(spark, tmp_path):
    jobs, snapshots = jobs_of(spark, [("one", "development"), ("two", "held_out")])
    bundles.write_files(bundles.export_files(jobs, snapshots).repartition(3), str(tmp_path / "out"))
    names = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file())
    own = [f"captures/{DIGEST}.bin", f"captures/{DIGEST}.txt", "corrected_row.template.json", "labels.template.json", "manifest.json", "manual_baseline.template.json"]
    assert names == sorted([f"{s}/{n}" for s in ("one", "two") for n in own] + ["two/adjudication.template.json"])
    assert (tmp_path / "out/one/captures" / f"{DIGEST}.bin").read_bytes() == HTML
    manifest = json.loads((tmp_path / "out/one/manifest.json").read_text())
    assert manifest["pages"]["https://f.example/x"]["error"] == "HTTP_ERROR" and set(manifest["schema"]["properties"]) == {"support", "limit"}
    read = bundles.bundle_captures(bundles._parsed(bundles.read_files(spark, str(tmp_path / "out")), F.col("name") == "manifest.json", bundles.MANIFEST)).collect()
    assert len(read) == 2 and all(r.sound and r.html == HTML.decode() for r in read)
    # a task that fails after others have written, and two rows for one place
    files = spark.range(20).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 19, F.raise_error(F.lit("bad")).cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    for bad in (files.repartition(4), spark.range(2).select(F.lit("same").alias("path"), F.lit(b"x").alias("content")), spark.range(1).select(F.lit("../up").alias("path"), F.lit(b"x").alias("content"))):
        with pytest.raises(Exception):  # noqa: B017
            bundles.write_files(bad, str(tmp_path / "bad"))
        assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]


def test_export_refuses_bytes_without_their_hash(spark, tmp_path):
    jobs, snapshots = jobs_of(spark, [("one", "development")], digest="0" * 64)
    with pytest.raises(Exception, match="do not have their hash"):
        bundles.write_files(bundles.export_files(jobs, snapshots), str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_development_labels(spark, tmp_path):
    jobs, snapshots = jobs_of(spark, [(s, "development") for s in ("sound", "anonymous", "unsupported", "unlabelled", "tampered")])
    root = tmp_path / "out"
    bundles.write_files(bundles.export_files(jobs, snapshots), str(root))
    write(root / "sound", labels=label("r", "sound", "development"))
    write(root / "anonymous", labels=label(None, "anonymous", "development"))
    write(root / "unsupported", labels=label("r", "unsupported", "development", value="Phone"))
    write(root / "tampered", labels=label("r", "tampered", "development"))
    manifest = json.loads((root / "tampered/manifest.json").read_text())
    manifest["pages"]["https://f.example/"]["snapshot_hash"] = "0" * 64
    write(root / "tampered", manifest=manifest)
    got = fields_of(spark, root)
    assert {k: r.code for k, r in got.items() if k[1] == "support"} == {("sound", "support"): None, ("anonymous", "support"): "not blind", ("unsupported", "support"): "unsupported value", ("unlabelled", "support"): "no labels", ("tampered", "support"): "capture hash mismatch"}
    assert got["sound", "support"].value == "Email" and got["sound", "limit"].state == "missing" and got["sound", "support"].seconds + got["sound", "limit"].seconds == 5


def test_held_out_sites_need_two_reviewers_and_a_third(spark, tmp_path):
    choices = {"agreed": "agree", "wrongly": "agree", "first": "select_a", "second": "select_b", "settled": "resolved", "silent": "select_a", "alone": "select_a"}
    jobs, snapshots = jobs_of(spark, [(s, "held_out") for s in choices])
    root = tmp_path / "out"
    bundles.write_files(bundles.export_files(jobs, snapshots), str(root))
    for site, choice in choices.items():
        first = label("a", site, "held_out")
        second = label("b", site, "held_out", **({} if site == "agreed" else {"state": "missing"}), seconds=5)
        final = label("c", site, "held_out")["fields"]["support"]
        decision = {"decision": choice, "reason": "" if site in ("agreed", "wrongly", "silent") else "the page says so", "final": final if choice == "resolved" else None, "time_spent_seconds": 3}
        record = {"adjudication_schema_version": "1.0", "site_id": site, "reviewer_id": "a" if site == "alone" else "c", "fields": {"support": decision, "limit": {"decision": "agree", "reason": "", "time_spent_seconds": 1}}}
        write(root / site, labels__reviewer_a=first, labels__reviewer_b=second, adjudication=record)
    got = {k[0]: r for k, r in fields_of(spark, root).items() if k[1] == "support"}
    assert {s: r.code for s, r in got.items()} == {"agreed": None, "wrongly": "disagrees", "first": None, "second": None, "settled": None, "silent": "no reason", "alone": "no separate adjudicator"}
    assert [got[s].value for s in ("agreed", "first", "second", "settled")] == ["Email", "Email", None, "Email"] and got["first"].seconds == 12
