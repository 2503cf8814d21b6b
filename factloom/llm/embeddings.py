"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine verification, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions_for
from .components import connected_components

COSINE = 0.9
#: Probability with which a pair just at the threshold must share a bucket in some table.
RECALL = 0.985
#: Members of a bucket that one task may compare; larger ones are dealt to cells of two chunks each.
HOT_BUCKET = 2048
CHUNK = 1024
#: What names a bucket: the signs, and the table and length of vectors that they are of.
KEY = ("code", "table", "dim")


def shape(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits): bits follow log2 n, so that a bucket of unlike vectors stays small; tables follow from recall."""
    bits = int(min(60, max(10, round(math.log2(max(n, 1))) - 4)))
    alike = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - alike)), bits


def hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length, in the type in which they came."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that very large or small components neither overflow nor vanish."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _join_rows(unit_a: np.ndarray, unit_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with that cosine or more; the product proposes, a sum in double precision decides."""
    i, j = np.nonzero(unit_a @ unit_b.T >= cosine - 1e-9)
    exact = np.einsum("ij,ij->i", unit_a[i], unit_b[j]) >= cosine
    return i[exact], j[exact]


def links(classes: DataFrame, n: int, cosine: float = COSINE, seed: int = 11) -> DataFrame:
    """From (node, weight, vector) with distinct valid vectors: rows (a, b, found), either a link (found null)
    of a spanning forest, or `found`, the weights of a's links first seen in one bucket (b null).

    A pair counts in the first table that brings it together, so the sums of `found` are exact counts of the
    links found, without a row for each pair. Vectors move once for each table, in the width in which they came
    (what came as float moves as float and is compared in double precision), with their bucket in each table.
    """
    spark = classes.sparkSession
    tables, bits = shape(n, cosine)
    wire = np.float32 if classes.schema["vector"].dataType.elementType.simpleString() == "float" else np.float64
    narrow = np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64

    def buckets(batches: Iterator[pa.RecordBatch], whole: bool = True) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for every in batches:
            for at in range(0, every.num_rows, 2048):
                batch = every.slice(at, 2048)
                vectors = batch.column("vector")
                node, weight = batch.column("node").to_numpy(), batch.column("weight").to_numpy()
                dims = pc.list_value_length(vectors).to_numpy()
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    m = _matrix(vectors.take(pa.array(own)), dim)
                    h = planes.setdefault(dim, hyperplanes(dim, tables, bits, seed))
                    signs = (_unit(m.astype(np.float64)) @ h > 0).reshape(len(own), tables, bits)
                    codes = (signs * (1 << np.arange(bits))).sum(2).astype(np.int64)
                    keys = [pa.array(codes.T.ravel()), pa.array(np.repeat(np.arange(tables, dtype=np.int32), len(own))), pa.array(np.full(tables * len(own), dim, np.int32))]
                    if not whole:
                        yield pa.RecordBatch.from_arrays(keys, KEY)
                        continue
                    at_row = np.tile(np.arange(len(own)), tables)
                    body, code = (pa.array([x.tobytes() for x in y], pa.binary()) for y in (m.astype(wire), codes.astype(narrow)))
                    take = pa.array(at_row)
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(node[own][at_row]), pa.array(weight[own][at_row]), body.take(take), code.take(take)], [*KEY, "node", "weight", "vector", "codes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        keys = [t.column(c).to_numpy() for c in (*KEY, "low", "high")]
        side, of = t.column("side").to_numpy(), keys[1]
        node, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
        body, code = t.column("vector").combine_chunks(), t.column("codes").combine_chunks()
        order = np.lexsort((side, *keys))
        start = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys]))))
        stop = np.append(start[1:], len(order))
        a_out, b_out, n_out = [], [], []
        for lo, hi in zip(start.tolist(), stop.tolist(), strict=True):
            if hi - lo < 2:
                continue
            rows = order[lo:hi]
            unit = _unit(np.stack([np.frombuffer(body[i].as_buffer(), wire) for i in rows.tolist()]).astype(np.float64))
            codes = np.stack([np.frombuffer(code[i].as_buffer(), narrow) for i in rows.tolist()])
            split = int((side[rows] < 2).sum()) if side[rows][-1] == 2 else 0  # sides 1 and 2: two chunks; 0: one
            left = np.arange(split) if split else np.arange(len(rows))
            right = np.arange(split, len(rows)) if split else left
            table = int(of[rows[0]])
            found = np.zeros(len(rows), np.int64)
            label = np.arange(len(rows))
            for at in range(0, len(left), 512):
                i, j = _join_rows(unit[left[at : at + 512]], unit[right], cosine)
                i, j = left[at + i], right[j]
                new = (i < j) & ~(codes[i, :table] == codes[j, :table]).any(1)
                i, j = i[new], j[new]
                np.add.at(found, i, weight[rows[j]])
                np.add.at(found, j, weight[rows[i]])
                for x in np.unique(i):  # a spanning forest: one link to each group not yet joined
                    mine = j[i == x]
                    groups, first = np.unique(label[mine], return_index=True)
                    for g, k in zip(groups.tolist(), first.tolist(), strict=True):
                        if label[x] != g and (label[x] != label[mine[k]]):
                            a_out.append(node[rows[x]])
                            b_out.append(node[rows[mine[k]]])
                            n_out.append(None)
                            label[label == g] = label[x]
            for k in np.flatnonzero(found).tolist():
                a_out.append(node[rows[k]])
                b_out.append(None)
                n_out.append(int(found[k]))
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), pa.array(n_out, pa.int64())], ["a", "b", "found"])

    kinds = "code bigint, table int, dim int"
    dealt = classes.mapInArrow(buckets, f"{kinds}, node bigint, weight bigint, vector binary, codes binary")
    # bucket sizes are counted on the keys alone: signs are cheap to take twice, vectors are not cheap to write
    crowd = classes.mapInArrow(lambda batches: buckets(batches, whole=False), kinds).groupBy(*KEY).count().where(F.col("count") > HOT_BUCKET)
    crowd = materialize(crowd.select(*KEY, F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "crowded-buckets")
    copies = crowd.agg(F.sum(F.col("chunks").cast("bigint") * F.col("chunks") * CHUNK)).first()[0]
    named = [*KEY, "low", "high", "side", "node", "weight", "vector", "codes"]
    if not copies:
        cells = dealt.withColumns({"side": F.lit(0), "low": F.lit(0), "high": F.lit(0)}).select(named)
    else:
        joined = dealt.join(crowd, [*KEY], "left")
        plain = joined.where("chunks is null").withColumns({"side": F.lit(0), "low": F.lit(0), "high": F.lit(0)}).select(named)
        own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        hot = joined.where("chunks is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        hot = hot.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        hot = hot.withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2))
        cells = plain.union(hot.select(named))
    deal = partitions_for(spark, n * tables + (copies or 0), 50_000)
    return cells.repartition(deal, *KEY, "low", "high").mapInArrow(compare, "a bigint, b bigint, found bigint")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component): for each row, how many others it links with, and the smallest id that it reaches.

    Equal vectors are one class, compared once and weighted by its rows. A vector that is null, empty or zero,
    or holds a null or non-finite component, links with nothing, nor do vectors of unlike lengths. Ties and
    repeated rows are rows of their own; a null id stays and is nobody's component unless its class has no
    other id; an empty table gives an empty one; other columns are ignored.
    """
    kind = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    base = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    base = base.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = base.where("sound").groupBy("vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = materialize(links(classes.select("node", "weight", "vector"), classes.count(), cosine), "cosine-links")
    parts = connected_components(found.where("b is not null").select("a", "b"), tag="cosine-components")
    sums = found.where("found is not null").groupBy(F.col("a").alias("node")).agg(F.sum("found").alias("found"))
    slim = classes.select("node", "least", "weight").join(parts, "node", "left").join(sums, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = slim.groupBy("root").agg(F.min("least").alias("smallest"))
    slim = slim.join(least, "root").select("node", "smallest", (F.col("weight") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"))
    known = classes.select("node", "vector").join(slim, "node").select("vector", "smallest", "n_links")
    linked = base.where("sound").join(known, "vector").select("id", "n_links", F.col("smallest").alias("component"))
    alone = base.where("not sound").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone)
