"""Document fingerprints: threshold-scaled sketches, with JVM expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_KEY, bucket_of, let, range_bounds

WORDS = 5
#: One in so many hash values is kept.
SCALE = 8


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_sketch(df: DataFrame, text_col: str, out: str, scale: int = SCALE) -> DataFrame:
    """Add array<bigint> column `out`: the sorted hashes of the text's five-word shingles that lie in the lowest
    1/scale of the hash space; where none does, the smallest alone, so that only a text without words has an
    empty sketch. A text of one to four words is one shingle; null counts as empty. Case is ignored."""
    limit = -(2**63) + 2**64 // scale

    def shingles(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
        one = F.array(F.xxhash64(F.concat_ws(" ", F.transform(w, lambda x: x.cast("string")))))
        return F.when(F.size(w) >= WORDS, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>"))

    def kept(h: Column, low: Column) -> Column:
        return F.when((F.size(low) > 0) | (F.size(h) == 0), F.sort_array(F.array_distinct(low))).otherwise(F.array(F.array_min(h)))

    def sketch(h: Column) -> Column:
        return let(F.filter(h, lambda x: x < limit), lambda low: kept(h, low))

    words = F.transform(_words(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.xxhash64(w))
    return df.withColumn(out, let(words, lambda w: let(shingles(w), lambda h: sketch(h))))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of the union of two sketched shingle sets."""
    both = F.sort_array(F.array_union(a, b))
    low = F.filter(both, lambda h: h < -(2**63) + 2**64 // scale)
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def jaccard(a: Column, b: Column) -> Column:
    """Estimated likeness of two shingle sets, 0 to 1; two empty sketches are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated part of a's shingles that b has too; an empty a is contained in all."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def encoded(sketch: Column) -> Column:
    """A sketch as one string: 16 lowercase hex digits for each kept hash, ascending."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def with_successor(docs: DataFrame, id_col: str, carried: list[str], rows_per_bucket: int = 1024) -> DataFrame:
    """Add next_<c> for each carried column: its value in the next row by descending id, ties by content; the
    last row's next is the first.

    Rows go once to range buckets of the id; the first row of each bucket is a guest, too, in the bucket
    before it, where it ends the order. No window spans more than a bucket.
    """
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_KEY))
    bounds = range_bounds(docs, key, rows_per_bucket)
    if not bounds:
        return docs.withColumns({f"next_{c}": F.col(c) for c in carried})
    own = bucket_of(key, bounds)
    guest_of = F.when(own + 1 < len(bounds), own + 1).otherwise(F.lit(0))
    # bounds are keys of rows, so the first row of a bucket, by descending id, is one whose key is its bound
    first = key == F.get(F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), own)
    none = F.lit(None).cast("int")
    dealt = docs.withColumn("__key", key).withColumn("__b", F.explode(F.filter(F.array(own, F.when(first, -guest_of - 1).otherwise(none)), lambda x: x.isNotNull())))
    dealt = dealt.withColumn("__guest", F.col("__b") < 0).withColumn("__b", F.when(F.col("__b") < 0, -F.col("__b") - 1).otherwise(F.col("__b")))
    order = Window.partitionBy("__b").orderBy("__guest", F.desc("__key"), F.xxhash64(*carried), *carried)
    for c in carried:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(order))
    return dealt.where(~F.col("__guest")).drop("__key", "__b", "__guest")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the next document's beginning.

    Columns: id, text, n_chars, sketch, next_sketch, edited, edited_sketch. A null text is empty; a null id
    comes last in descending order; repeated ids stand in order of content; a single row is its own next; other
    columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = with_successor(with_sketch(base, "text", "sketch", scale), "id", ["text", "sketch"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    base = base.withColumn("edited", edited).withColumn("n_chars", n.cast("bigint")).drop("next_text")
    return with_sketch(base, "edited", "edited_sketch", scale)
