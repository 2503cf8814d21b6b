"""SimHash near-duplicates: 64-bit fingerprints, Golay-code keys, verified links, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import golay
from .common import materialize, partitions_for, row_struct
from .components import connected_components

WORDS, SEED, MAX_BITS = 3, 42, 3
#: Segments of the fingerprint: place of the lowest bit, and bits. The third is padded to a Golay word by zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Members of a key that one task may compare; keys with more are dealt to cells of two chunks each.
HOT_KEY = 4096
CHUNK = 1024
#: Pairs that a task compares at once.
MOST_PAIRS = 1 << 19


def fingerprint(text: bytes | None) -> int:
    """SimHash of a UTF-8 text's shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()  # bytes: A-Z alone change, and exactly x20 and x09-x0D part words
    if not words:
        return 0
    plain, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(WORDS, len(words)) - 1 :]
    first = np.concatenate(([0], ends + 1))[: len(last)]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(last), 1 << 16):
        hashes = [digest(plain[i:j], SEED) for i, j in zip(first[at : at + (1 << 16)].tolist(), last[at : at + (1 << 16)].tolist(), strict=True)]
        octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(last), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("__text").cast(pa.binary())
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        keep = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(prints)], [*keep, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint): a fingerprint for each row; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(_fingerprints, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, side): fingerprints within 3 bits share a key, one as a left and one as a right member.

    Pigeonhole: either every segment has one error at most (table 0: three codeword indices), or two segments
    have one error between them (six tables: one segment as it is, and the other's codeword index). Where an
    index must bear an error, one side gives the indices of all vectors within one bit, the other its own.
    """
    u = prints.view(np.uint64)
    raw = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [golay.index(x).astype(np.int64) for x in raw]
    near = [golay.nearby(x, n) for x, (_, n) in zip(raw, SEGMENTS, strict=True)]
    rows = np.arange(len(u))
    out: list[tuple[np.ndarray, np.ndarray, int]] = []

    def add(tag: int, key: np.ndarray, fits: np.ndarray, side: int) -> None:
        at = np.broadcast_to(rows.reshape(-1, *[1] * (key.ndim - 1)), key.shape)[fits]
        out.append((key[fits] | tag << 48, at, side))

    add(0, near[0] << 24 | (own[1] << 12 | own[2])[:, None], near[0] >= 0, 0)
    pair = near[1][:, :, None] << 12 | near[2][:, None, :]
    add(0, own[0][:, None, None] << 24 | pair, (near[1] >= 0)[:, :, None] & (near[2] >= 0)[:, None, :], 1)
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                tag += 1
                add(tag, raw[i][:, None] << 12 | near[j], near[j] >= 0, 0)
                add(tag, (raw[i] << 12 | own[j])[:, None], np.ones((len(u), 1), bool), 1)
    return np.concatenate([k for k, _, _ in out]), np.concatenate([r for _, r, _ in out]), np.concatenate([np.full(len(k), s, np.int8) for k, _, s in out])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            key, row, side = _keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row]), pa.array(side)], ["cell", "fp", "side"])


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the verified pairs between left and right join: no more of them than members."""
    label, found = np.arange(len(right)), []
    for x in left.tolist():
        hit = np.bitwise_count(np.uint64(x) ^ right) <= MAX_BITS
        if hit.any():
            groups, first = np.unique(label[hit], return_index=True)
            found += [(x, y) for y in right[hit][first].tolist()]
            if len(groups) > 1:
                label[np.isin(label, groups)] = groups[0]
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links between left and right members of each cell; a partition holds whole cells."""
    parts = [(b.column("cell").to_numpy(), b.column("fp").to_numpy(), b.column("side").to_numpy()) for b in batches]
    if not parts:
        return
    cell, fp, side = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.lexsort((side, cell))
    cell, fp, side = cell[order], fp[order].view(np.uint64), side[order]
    start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.concatenate((start, [len(cell)])))
    n_right = np.add.reduceat(side.astype(np.int64), start)
    n_left = size - n_right
    pairs = n_left * n_right
    few = (pairs > 0) & (pairs <= 256)
    found = []
    picked = np.flatnonzero(few)
    steps = np.searchsorted(np.cumsum(pairs[picked]), np.arange(1, pairs[picked].sum() // MOST_PAIRS + 2) * MOST_PAIRS) if len(picked) else []
    for own in np.split(picked, steps):
        count = pairs[own]
        run = np.repeat(own, count)
        k = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        a, b = fp[start[run] + k // n_right[run]], fp[start[run] + n_left[run] + k % n_right[run]]
        hit = (a != b) & (np.bitwise_count(a ^ b) <= MAX_BITS)
        found.append(np.unique(np.sort(np.stack((a[hit], b[hit]), 1), axis=1), axis=0))
    for r in np.flatnonzero(pairs > 256).tolist():
        middle = start[r] + n_left[r]
        found.append(np.array(_forest(fp[start[r] : middle], fp[middle : start[r] + size[r]]), np.uint64).reshape(-1, 2))
    links = np.sort(np.concatenate(found).view(np.int64), axis=1) if found else np.zeros((0, 2), np.int64)
    links = np.unique(links[links[:, 0] != links[:, 1]], axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all that are within 3 bits, directly or
    over others. In crowded keys a spanning forest stands for all pairs, so no group is squared into rows."""
    spark = prints.sparkSession
    key_rows = prints.mapInArrow(_key_rows, "cell bigint, fp bigint, side tinyint")
    n = prints.count()
    slots = 1 << max(10, (n * 70 // 256).bit_length())
    slot = F.pmod(F.xxhash64("cell"), F.lit(slots))
    crowded = [r[0] for r in key_rows.groupBy(slot.alias("slot")).count().where(F.col("count") > HOT_KEY).select("slot").take(1)]
    deal = partitions_for(spark, n * 70, 2_000_000)
    if not crowded:  # no slot has so many rows, hence no key
        return key_rows.repartition(deal, "cell").mapInArrow(_links, "a bigint, b bigint")
    slot_rows = key_rows.groupBy(slot.alias("slot")).count().where(F.col("count") > HOT_KEY).select("slot")
    hot = (
        key_rows.withColumn("slot", slot).join(slot_rows, "slot").groupBy("cell").count().where(F.col("count") > HOT_KEY)
        .select("cell", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    )
    # a crowded key's rows go to a cell for each chunk of the other side: they count as often
    deal = partitions_for(spark, n * 70 + (hot.agg(F.sum(F.col("chunks").cast("long") * F.col("chunks") * CHUNK)).first()[0] or 0), 2_000_000)
    dealt = key_rows.join(hot, "cell", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    others = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = dealt.select("cell", "fp", "side", mine.alias("own"), others.alias("other"), "chunks").select(
        F.when(F.col("chunks").isNull(), F.col("cell")).otherwise(
            F.xxhash64("cell", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
        ).alias("cell"), "fp", "side",
    )
    return cells.repartition(deal, "cell").mapInArrow(_links, "a bigint, b bigint")


def _grouped(prints: DataFrame) -> DataFrame:
    """prints (id, fp and more) with component, the smallest id that links reach, and root, which names the group."""
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    parts = connected_components(links(classes.select("fp")), tag="simhash-components")
    joined = classes.join(parts.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left")
    joined = joined.withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(joined.join(least, "root").select("fp", "root", "component"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): one row for each row of docs; component is the smallest id that links reach.

    Fingerprints link at 3 differing bits or fewer. Rows with equal fingerprints (copies above all) are one
    class, joined by nothing but their fingerprint. Null and empty texts have fingerprint zero and link as any
    other; repeated rows stay repeated; a null id is kept and is nobody's smallest id unless its class has no
    other; an empty table gives an empty one; other columns are ignored.
    """
    return _grouped(materialize(fingerprints(docs, id_col, text_col), "simhash")).select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates, columns and their names as they were: the row of the smallest
    id, of several the first written. Rows with null ids stand behind all others; rows that share an id are rows of
    their own, and equal rows are copies, so one of them stays. Null and empty texts are one group, and stay as one
    row. An empty table gives an empty one.

    The rows are written once with their fingerprints and a number of their own, by which the kept ones are found
    again; what moves by group are numbers, combined before they move.
    """
    text_at = docs.columns.index(text_col)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("doc").field(text_at).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], [*batch.schema.names, "fp"])

    rows = docs.select(row_struct(docs).alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"))
    written = materialize(rows.mapInArrow(printed, T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())])), "simhash-rows")
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    kept = _grouped(written.select("id", "fp", "row")).groupBy("root").agg(first).select(F.col("first.row").alias("row"))
    return written.join(kept, "row", "left_semi").select("doc.*")
