"""Frozen bundles: a folder of raw files for each site, written in two phases, and read back with their labels.

A bundle holds a manifest with the site's captures, the captures' bytes, and labels by people: one blind label set for
development sites, two and an adjudication for held-out ones. Reading hashes the bytes again and checks labels as rules
over columns; nothing of a bundle that breaks one is taken for truth, and what it breaks is named.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from factloom.operators.asof import first_failure
from factloom.operators.claims import check_claims
from factloom.sources.captures import decode_html, plain_base64, snapshot_hash

STATES = ("verified", "missing", "conflicting", "blocked", "unverified")
CHOICES = ("agree", "select_a", "select_b", "resolved")
MANIFEST_FILE, ADJUDICATION_FILE = "manifest.json", "adjudication.json"
LABEL_FILES = {"labels.json": "one", "labels.reviewer-a.json": "a", "labels.reviewer-b.json": "b"}

_PAGE = "error:string,raw_base64:string,content_type:string,encoding:string,fetched_at:string,final_url:string,redirects:array<string>,snapshot_hash:string"
_EVIDENCE = "struct<source_url:string,snapshot_hash:string,fetched_at:string,scope_locator:string,relation:string,raw_value:string,nodes:array<struct<role:string,locator:string,excerpt:string>>>"
_LABEL = f"struct<state:string,value:string,plan_name:string,unit:string,currency:string,billing_period:string,conditions:string,ambiguity:string,judgment:string,rationale:string,evidence:array<{_EVIDENCE}>,reviewer_time_seconds:double>"
MANIFEST = f"fixture_version string, site_id string, split string, category string, seed string, plan_name string, permission_note string, source_job_id string, capture_date string, schema struct<properties:map<string,struct<type:string>>>, pages map<string,struct<{_PAGE}>>"
LABELS = f"label_schema_version string, site_id string, split string, labeling_mode string, reviewer_id string, plan_name string, fields map<string,{_LABEL}>"
ADJUDICATION = f"adjudication_schema_version string, site_id string, reviewer_id string, fields map<string,struct<decision:string,reason:string,final:{_LABEL},time_spent_seconds:double>>"
#: What two labels must share to agree, and what a label gives out.
CLAIM_PARTS = ("state", "value", "plan_name", "unit", "currency", "billing_period", "conditions", "ambiguity", "judgment", "rationale", "evidence")


# writing -----------------------------------------------------------------------------------------------


@dataclass
class Staged(WriterCommitMessage):
    """What one task has staged: (staged file, its place in the end)."""

    files: list[tuple[str, str]]


class RawFileWriter(DataSourceWriter):
    """Rows (path, content) to files below a folder. Tasks write into a staging folder of this write alone; only when all
    have ended are the files moved to their places, a bundle's manifest after its other files. A task that fails, or
    runs twice, leaves nothing behind; a path that leads out of the folder or occurs twice fails the write."""

    def __init__(self, root: str):
        self.root, self.staging = root.rstrip("/"), f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def _folder(self, where: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(where) if "://" in where else (pafs.LocalFileSystem(), where)

    def write(self, iterator: Iterator[T.Row]) -> Staged:
        fs, staging = self._folder(self.staging)
        own = f"{staging}/{uuid.uuid4().hex}"
        fs.create_dir(own, recursive=True)
        files = []
        for n, row in enumerate(iterator):
            place = posixpath.normpath(row.path)
            if place.startswith(("/", "..")) or place == ".":
                raise ValueError(f"a path leads out of the folder: {row.path}")
            with fs.open_output_stream(f"{own}/{n}") as out:
                out.write(bytes(row.content or b""))
            files.append((f"{own}/{n}", place))
        return Staged(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = self._folder(self.root)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: (posixpath.basename(f[1]) == MANIFEST_FILE, f[1]))
        places = [place for _, place in files]
        if len(set(places)) < len(places):
            self.abort(messages)
            raise ValueError("several rows have the same path")
        for staged, place in files:
            fs.create_dir(posixpath.dirname(f"{root}/{place}"), recursive=True)
            fs.move(staged, f"{root}/{place}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, staging = self._folder(self.staging)
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


class RawFiles(DataSource):
    """The format raw_files: `path` names the folder."""

    @classmethod
    def name(cls) -> str:
        return "raw_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return RawFileWriter(self.options["path"])


def write_files(files: DataFrame, root: str) -> None:
    """Write rows (path, content) as files below root, all or none."""
    files.sparkSession.dataSource.register(RawFiles)
    files.select("path", "content").write.format("raw_files").mode("append").save(root)


def _json(value: Column) -> Column:
    return F.encode(F.to_json(value, {"ignoreNullFields": "false", "pretty": "true"}), "UTF-8")


def export_files(jobs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files (path, content) of a bundle for each job (site_id, split, category, seed, plan_name, permission_note, job_id,
    observed_at, kinds: map from field to type, pages: array of requested_url, url, fetched_at, snapshot_hash, error_code,
    content_type, encoding, redirects): a manifest, the bytes and the text of each capture, and templates for people
    to fill in. snapshots has job_id, snapshot_hash, raw. Bytes that are missing or do not have their hash fail the export,
    and so does a job without split, plan or permission."""
    checked = F.when(F.col("split").isin("development", "held_out") & (F.trim("plan_name") != "") & (F.trim("permission_note") != ""), F.col("site_id")).otherwise(F.raise_error(F.lit("split, named plan and permission note are required")))
    jobs = jobs.withColumn("site_id", checked.cast("string"))
    page = jobs.select("job_id", "site_id", F.explode("pages").alias("p")).select("job_id", "site_id", "p.*")
    stored = snapshots.select("job_id", "snapshot_hash", "raw").dropDuplicates(["job_id", "snapshot_hash"])
    page = page.join(stored, ["job_id", "snapshot_hash"], "left")
    sound = F.coalesce(snapshot_hash(F.col("raw")) == F.col("snapshot_hash"), F.lit(False))
    page = page.withColumn("raw", F.when(F.col("error_code").isNotNull(), None).when(sound, F.col("raw")).otherwise(F.raise_error(F.lit("capture bytes are unavailable or do not have their hash")).cast("binary")))
    capture = page.where("error_code is null").dropDuplicates(["site_id", "snapshot_hash"])
    place = F.concat("site_id", F.lit("/captures/"), "snapshot_hash")
    bodies = capture.select(F.concat(place, F.lit(".bin")).alias("path"), F.col("raw").alias("content"))
    texts = capture.select(F.concat(place, F.lit(".txt")).alias("path"), F.encode(decode_html("raw", "content_type")["text"], "UTF-8").alias("content"))

    entry = F.struct(F.col("error_code").alias("error"), plain_base64(F.col("raw")).alias("raw_base64"), "content_type", "encoding", "fetched_at", F.col("url").alias("final_url"), "redirects", "snapshot_hash")
    pages = page.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("requested_url", entry)))).alias("entries"))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    blank = F.struct(*none("state", "value"), F.col("plan_name"), *none("unit", "currency", "billing_period", "conditions", "ambiguity"), F.lit("explicit").alias("judgment"), *none("rationale"), F.array().cast("array<string>").alias("evidence"), *none("reviewer_time_seconds"))
    each = lambda value: F.map_from_entries(F.transform(F.map_keys("kinds"), lambda k: F.struct(k, value)))
    schema = F.struct(F.lit("object").alias("type"), F.transform_values("kinds", lambda _, kind: F.struct(kind.alias("type"))).alias("properties"))
    version = lambda name, v: F.lit(v).alias(name)
    documents = {
        MANIFEST_FILE: F.struct(version("fixture_version", "real-2.0"), "site_id", "split", "category", "seed", schema.alias("schema"), "plan_name", "permission_note", F.col("job_id").alias("source_job_id"), F.col("observed_at").alias("capture_date"), F.col("entries").alias("pages")),
        "labels.template.json": F.struct(version("label_schema_version", "2.0"), "site_id", "split", F.lit("blind").alias("labeling_mode"), *none("reviewer_id"), "plan_name", each(blank).alias("fields")),
        "manual_baseline.template.json": F.struct(version("baseline_schema_version", "2.0"), "site_id", *none("analyst_id", "elapsed_seconds"), each(blank).alias("fields")),
        "corrected_row.template.json": F.struct(version("corrected_row_schema_version", "1.0"), "site_id", F.col("job_id").alias("source_job_id"), *none("reviewer_id"), each(blank).alias("fields")),
        "adjudication.template.json": F.when(F.col("split") == "held_out", F.struct(version("adjudication_schema_version", "1.0"), "site_id", *none("reviewer_id"), each(F.struct(*none("decision", "reason", "final", "time_spent_seconds"))).alias("fields"))),
    }
    files = F.array(*[F.struct(F.concat("site_id", F.lit(f"/{n}")).alias("path"), _json(d).alias("content")) for n, d in documents.items()])
    written = jobs.join(pages, "job_id", "left").select(F.inline(files)).where("content is not null")
    return written.unionByName(bodies).unionByName(texts)


# reading -----------------------------------------------------------------------------------------------


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, content) of all JSON files of bundles below root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("content"))


def _parsed(files: DataFrame, names: Column, schema: str) -> DataFrame:
    return files.where(names).select("folder", "name", F.from_json("content", schema).alias("j"))


def bundle_captures(manifests: DataFrame) -> DataFrame:
    """(folder, url, snapshot_hash, fetched_at, html, sound) of a bundle's captures, hashed and decoded again."""
    page = manifests.select("folder", F.explode("j.pages").alias("requested", "p")).select("folder", "p.*").where("error is null")
    raw = page.withColumn("raw", F.try_to_binary("raw_base64", F.lit("base64")))
    sound = F.coalesce(snapshot_hash(F.col("raw")) == F.col("snapshot_hash"), F.lit(False))
    return raw.select("folder", F.col("final_url").alias("url"), "snapshot_hash", "fetched_at", decode_html("raw", "content_type")["text"].alias("html"), sound.alias("sound"))


def _label_rows(labels: DataFrame, sites: DataFrame) -> DataFrame:
    """A row for each field that the site's schema or a label set has, with its set's code."""
    c = lambda name: F.col(f"j.{name}")
    blind = (c("labeling_mode") == "blind") & (F.coalesce(c("reviewer_id"), F.lit("")) != "") & c("site_id").eqNullSafe(F.col("site_id")) & c("split").eqNullSafe(F.col("split")) & c("plan_name").eqNullSafe(F.col("asked_plan"))
    whole = F.size(F.array_except(F.map_keys("kinds"), F.map_keys(c("fields")))) + F.size(F.array_except(F.map_keys(c("fields")), F.map_keys("kinds"))) == 0
    code = first_failure([(~F.coalesce(blind, F.lit(False)), "not blind"), (~F.coalesce(whole, F.lit(False)), "incomplete labels")])
    rows = labels.join(sites, "folder").withColumn("set_code", code)
    return rows.select("folder", "slot", "asked_plan", "kinds", "set_code", c("reviewer_id").alias("reviewer_id"), F.explode(c("fields")).alias("field", "label"))


def _checked(rows: DataFrame, captures: DataFrame) -> DataFrame:
    """Label rows (folder, slot, field, label, ...) with code: the first rule that each breaks."""
    said = F.col("label")
    key = F.concat_ws("\u0001", "folder", "slot", "field")
    # a capture is bound within its own bundle: the folder goes into the key of both sides
    bound = F.transform(said["evidence"], lambda e: e.withField("snapshot_hash", F.concat_ws("\u0001", F.col("folder"), e["snapshot_hash"])))
    claims = rows.where("label.state = 'verified'").select(
        key.alias("claim_id"), F.col("field").alias("field_name"), F.col("kinds")[F.col("field")]["type"].alias("kind"), "asked_plan", *[said[n].alias(n) for n in ("plan_name", "state", "value", "unit", "billing_period", "currency", "judgment", "rationale", "ambiguity")], bound.alias("evidence"),
    )
    own = captures.withColumn("snapshot_hash", F.concat_ws("\u0001", "folder", "snapshot_hash"))
    found = check_claims(claims, own).select("claim_id", F.col("code").alias("claim_code"))
    code = first_failure([
        (F.col("set_code").isNotNull(), "set"), (~F.coalesce(said["state"].isin(*STATES) & (said["reviewer_time_seconds"] >= 0), F.lit(False)), "no state or time"), (~said["plan_name"].eqNullSafe(F.col("asked_plan")), "wrong plan"),
        ((said["state"] == "verified") & F.col("claim_code").isNotNull(), "claim"), (~said["state"].isin("verified", "conflicting") & (said["value"].isNotNull() | (F.coalesce(F.size(said["evidence"]), F.lit(0)) > 0)), "unsupported value"),
    ])
    out = rows.withColumn("claim_id", key).join(found, "claim_id", "left").withColumn("rule", code)
    return out.withColumn("code", F.when(F.col("rule") == "set", F.col("set_code")).when(F.col("rule") == "claim", F.col("claim_code")).otherwise(F.col("rule"))).drop("claim_id", "claim_code", "rule", "set_code")


def adjudicate(both: DataFrame) -> DataFrame:
    """Three-way decisions: both has the structs a and b (label, code, reviewer_id of two reviewers), and decision (decision,
    reason, final, time_spent_seconds, code of final, reviewer_id). Adds code, and expected: the label that counts.

    What two reviewers say alike may be agreed on; otherwise one of them is chosen, or a third label resolves it, each
    with a reason and a measured time. The three people are different."""
    a, b, d = F.col("a"), F.col("b"), F.col("decision")
    same = F.struct(*[a["label"][p].alias(p) for p in CLAIM_PARTS]).eqNullSafe(F.struct(*[b["label"][p].alias(p) for p in CLAIM_PARTS]))
    apart = (a["reviewer_id"] != b["reviewer_id"])
    third = d["reviewer_id"].isNotNull() & (d["reviewer_id"] != a["reviewer_id"]) & (d["reviewer_id"] != b["reviewer_id"])
    code = first_failure([
        (a.isNull() | b.isNull() | d.isNull(), "incomplete adjudication"),
        (a["code"].isNotNull(), "a"), (b["code"].isNotNull(), "b"),
        (~F.coalesce(apart, F.lit(False)), "one reviewer"), (~F.coalesce(third, F.lit(False)), "no separate adjudicator"),
        (~F.coalesce(d["decision"].isin(*CHOICES), F.lit(False)), "no decision"),
        ((d["decision"] == "agree") & ~same, "disagrees"),
        ((d["decision"] != "agree") & (F.coalesce(d["reason"], F.lit("")) == ""), "no reason"),
        ((d["decision"] == "resolved") & (d["final"].isNull() | d["code"].isNotNull()), "final"),
        (~F.coalesce(d["time_spent_seconds"] >= 0, F.lit(False)), "no adjudication time"),
    ])
    out = both.withColumn("rule", code)
    told = F.when(F.col("rule") == "a", a["code"]).when(F.col("rule") == "b", b["code"]).when(F.col("rule") == "final", F.coalesce(d["code"], F.lit("no final label"))).otherwise(F.col("rule"))
    label = F.when(d["decision"] == "select_b", b["label"]).when(d["decision"] == "resolved", d["final"]).otherwise(a["label"])
    return out.withColumn("code", told).withColumn("expected", F.when(F.col("code").isNull(), label)).drop("rule")


def labelled_fields(spark: SparkSession, root: str) -> DataFrame:
    """(folder, site_id, split, field, code, state, value, unit, currency, billing_period, seconds) of all bundles below root:
    what people say of each field after adjudication, or the rule that keeps it from counting; seconds are all that
    reviewers and adjudicator spent on it. A site of which any capture has lost its hash has no truth at all. A bundle
    without manifest is none; one without labels has a row for each field of its schema, with that code."""
    files = read_files(spark, root)
    manifests = _parsed(files, F.col("name") == MANIFEST_FILE, MANIFEST)
    captures = bundle_captures(manifests)
    unsound = captures.where("not sound").select("folder").distinct().withColumn("broken", F.lit(True))
    sites = manifests.select("folder", F.col("j.site_id").alias("site_id"), F.col("j.split").alias("split"), F.col("j.plan_name").alias("asked_plan"), F.col("j.schema.properties").alias("kinds"))
    slots = F.create_map(*[F.lit(x) for pair in LABEL_FILES.items() for x in pair])
    labels = _parsed(files, F.col("name").isin(*LABEL_FILES), LABELS).withColumn("slot", slots[F.col("name")])
    decisions = _parsed(files, F.col("name") == ADJUDICATION_FILE, ADJUDICATION).join(sites.select("folder", "kinds", "asked_plan", "site_id"), "folder")
    decided = decisions.where(F.col("j.site_id").eqNullSafe(F.col("site_id"))).select("folder", "kinds", "asked_plan", F.col("j.reviewer_id").alias("reviewer_id"), F.explode("j.fields").alias("field", "d"))
    finals = decided.where("d.final is not null").select("folder", F.lit("final").alias("slot"), "asked_plan", "kinds", F.lit(None).cast("string").alias("set_code"), "reviewer_id", "field", F.col("d.final").withField("reviewer_time_seconds", F.coalesce("d.final.reviewer_time_seconds", F.lit(0.0))).alias("label"))
    checked = _checked(_label_rows(labels, sites).unionByName(finals), captures.where("sound"))

    judged = F.struct("label", "code", "reviewer_id")
    of = lambda slot: F.first(F.when(F.col("slot") == slot, judged), ignorenulls=True).alias(slot)
    wide = checked.groupBy("folder", "field").agg(*[of(s) for s in (*LABEL_FILES.values(), "final")])
    asked = sites.select("folder", "site_id", "split", F.explode(F.map_keys("kinds")).alias("field")).join(wide, ["folder", "field"], "left").join(unsound, "folder", "left")
    ruled = asked.join(decided.select("folder", "field", "d", F.col("reviewer_id").alias("third")), ["folder", "field"], "left")
    decision = F.when(F.col("d").isNotNull(), F.struct(F.col("d.decision").alias("decision"), F.col("d.reason").alias("reason"), F.col("final.label").alias("final"), F.col("d.time_spent_seconds").alias("time_spent_seconds"), F.col("final.code").alias("code"), F.col("third").alias("reviewer_id")))
    out = adjudicate(ruled.withColumn("decision", decision))
    held = F.col("split") == "held_out"
    code = F.when(F.col("broken"), "capture hash mismatch").when(held, F.col("code")).when(F.col("one").isNull(), "no labels").otherwise(F.col("one.code"))
    truth = F.when(code.isNull(), F.when(held, F.col("expected")).otherwise(F.col("one.label")))
    spent = F.when(held, F.col("a.label.reviewer_time_seconds") + F.col("b.label.reviewer_time_seconds") + F.col("decision.time_spent_seconds")).otherwise(F.col("one.label.reviewer_time_seconds"))
    return out.withColumns({"final_code": code, "truth": truth, "seconds": F.when(code.isNull(), spent)}).select(
        "folder", "site_id", "split", "field", F.col("final_code").alias("code"), *[F.col(f"truth.{n}").alias(n) for n in ("state", "value", "unit", "currency", "billing_period")], "seconds")
