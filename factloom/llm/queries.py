"""The queries of this subpackage, and their SQL where SQL can express them.

Each query gives a row for each row of its table (but op2: for each piece; op11: for each hit; op13: for each comparison),
also for rows that repeat each other or share an id, and for null ids and texts; a null text counts as empty. Ties are
broken by ids, null first, and then by content or the input's order. Further columns of a table change nothing, whatever
their names, and an empty table gives an empty result of the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, embeddings, fingerprints, packing, ranking, repair, secrets, sentencepiece_fst, sharding, simhash, suffixes, token_counts, toxicity
from .common import table


def op2_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of all documents and its place in a sequence of 1024 tokens at most."""
    packed = packing.pack(table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number and digest of its ids, digest of the decoded text."""
    found = sentencepiece_fst.round_trip(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_ids", "ids_crc32", "decoded_sha256", "restored")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the fixed patterns' spans, and all spans."""
    found = secrets.scan_documents(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("base_spans").cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), "spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a classifier that never saw the held-out fold; a null id is in no fold."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(toxicity.held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op1_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    found = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.encoded(F.col("sketch")).alias("fingerprint"),
        fingerprints.encoded(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.jaccard(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.jaccard(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
        fingerprints.containment(F.col("sketch"), F.col("next_sketch")).alias("contained_in_next"),
    )


def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.9 or more."""
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op8_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to grammar-compressed files in ascending doc_id order and read back."""
    found = repair.encode_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and pre-tokens of every document under the byte-level vocabulary."""
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "n_pretokens")


def op10_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose counts are at most one apart, uniformly shuffled."""
    dealt = sharding.shards(table(spark, sf_dir, "documents"), 24)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return dealt.select(
        "doc_id",
        (F.octet_length(body) + 8).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        F.col("__slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of the highest scores for each benchmark item."""
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 50 bytes that an earlier one holds."""
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is from the others of its language, and the terms that set it apart from the language."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_threshold_sketch": op1_threshold_sketch,
    "op2_linear_grouping_packing": op2_linear_grouping_packing,
    "op3_sentencepiece_fst": op3_sentencepiece_fst,
    "op4_secret_scan": op4_secret_scan,
    "op6_embedding_neardup": op6_embedding_neardup,
    "op7_toxicity": op7_toxicity,
    "op8_repair_token_files": op8_repair_token_files,
    "op9_trie_token_counts": op9_trie_token_counts,
    "op10_hypergeometric_shards": op10_hypergeometric_shards,
    "op5_simhash_neardup": op5_simhash_neardup,
    "op11_tput_search": op11_tput_search,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {"op11_tput_search": ranking.SQL, "op12_suffix_dedup": suffixes.SQL, "op13_source_divergence": divergence.SQL}
