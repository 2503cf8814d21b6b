"""Best-fit packing of token sequences by linear grouping and few-size configurations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import exclusive_sums, materialize

CAPACITY = 1024
#: Pieces longer than the first number are grouped into as many sizes as the second says and configured; shorter
#: ones are best-fitted after. Each choice is planned, and the plan with the fewest sequences is taken.
SCHEMES = ((64, 48), (200, 100), (480, 100), (512, 64))


@dataclass
class Run:
    """`count` sequences of the same layout: items are (length, copies) in order."""

    count: int
    free: int
    items: list[tuple[int, int]] = field(default_factory=list)


def linear_groups(sizes: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Descending lengths in groups of equal cardinality (but the last): lists of [length, count]."""
    per = -(-sum(sizes.values()) // groups) if sizes else 1
    out: list[list[list[int]]] = []
    room = 0
    for length in sorted(sizes, reverse=True):
        left = sizes[length]
        while left:
            if not room:
                out.append([])
                room = per
            n = min(left, room)
            out[-1].append([length, n])
            left, room = left - n, room - n
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[int, list[int]]]:
    """Rounded-down optimum of the configuration program: (times, copies of each size). Column generation with
    a dense basis; a new column is the best knapsack filling under the current prices."""
    k = len(sizes)
    columns = [[capacity // s if j == i else 0 for j in range(k)] for i, s in enumerate(sizes)]
    inverse = np.diag([1 / c[i] for i, c in enumerate(columns)])
    need = np.array(demand, float)
    size = np.array(sizes)
    for _ in range(rounds):
        price = inverse.sum(0)
        worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            fits = np.flatnonzero(size <= c)
            best = worth[c - 1]
            if len(fits):
                values = worth[c - size[fits]] + price[fits]
                at = int(values.argmax())
                if values[at] > best + 1e-12:
                    best, pick[c] = values[at], fits[at]
            worth[c] = best
        if worth[capacity] <= 1 + 1e-7:
            break
        column, c = [0] * k, capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= size[pick[c]]
        into, level = inverse @ np.array(column, float), inverse @ need
        ratio = np.where(into > 1e-9, level / np.where(into > 1e-9, into, 1), np.inf)
        out = int(ratio.argmin())
        columns[out] = column
        row = inverse[out] / into[out]
        inverse = inverse - np.outer(into, row)
        inverse[out] = row
    times = np.floor(inverse @ need + 1e-6).astype(int)
    return [(int(t), c) for t, c in zip(times, columns, strict=True) if t > 0]


def _best_fit(runs: list[Run], length: int, count: int, capacity: int) -> None:
    """Put `count` pieces into the runs with the least room that fits, then into new sequences."""
    by_free: dict[int, list[Run]] = {}
    for r in runs:
        if r.free >= length:
            by_free.setdefault(r.free, []).append(r)
    for free in sorted(by_free):
        for r in by_free[free]:
            if not count:
                return
            each = free // length
            whole = min(r.count, count // each)
            if whole < r.count:  # the rest of the run stays apart; its first sequence may take what is left over
                rest = Run(r.count - whole, r.free, list(r.items))
                r.count = whole
                runs.append(rest)
                over = count - whole * each
                if over:
                    one = Run(1, rest.free - over * length, [*rest.items, (length, over)])
                    rest.count -= 1
                    runs.append(one)
                    count -= over
            if whole:
                r.items.append((length, each))
                r.free -= each * length
                count -= whole * each
    each = capacity // length
    if count >= each:
        runs.append(Run(count // each, capacity - each * length, [(length, each)]))
    if count % each:
        runs.append(Run(1, capacity - count % each * length, [(length, count % each)]))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, schemes: tuple[tuple[int, int], ...] = SCHEMES) -> list[Run]:
    """The layout with the fewest sequences among those of the schemes, from the counts of the lengths alone."""
    return min((grouped_plan(histogram, capacity, large * capacity // CAPACITY, groups) for large, groups in schemes), key=lambda runs: sum(r.count for r in runs))


def grouped_plan(histogram: dict[int, int], capacity: int, large: int, groups: int) -> list[Run]:
    """Layouts for all pieces by linear grouping; the work doesn't grow with the counts.

    Large lengths are rounded up within groups of equal cardinality, the few rounded sizes get optimal
    configurations, actual lengths take the rounded ones' places, what rounding down left over and then the
    small lengths are best-fitted in descending order.
    """
    runs: list[Run] = []
    if histogram.get(capacity):
        runs.append(Run(histogram[capacity], 0, [(capacity, 1)]))
    grouped = linear_groups({k: n for k, n in histogram.items() if large < k < capacity and n}, groups)
    merged: dict[int, list[list[int]]] = {}
    for g in grouped:  # groups whose rounded size is the same are one size
        merged.setdefault(g[0][0], []).extend(g)
    sizes = sorted(merged, reverse=True)
    if sizes:
        for times, column in configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity):
            now = [Run(times, capacity)]
            for s, copies in zip(sizes, column, strict=True):
                for _ in range(copies):
                    filled: list[Run] = []
                    for r in now:
                        left = r.count
                        while left and merged[s]:
                            length, n = merged[s][0]
                            t = min(left, n)
                            filled.append(Run(t, r.free - length, [*r.items, (length, 1)]))
                            merged[s][0][1] -= t
                            left -= t
                            if not merged[s][0][1]:
                                merged[s].pop(0)
                        if left:
                            filled.append(Run(left, r.free, list(r.items)))
                    now = filled
            runs += [r for r in now if r.items]
    rest: dict[int, int] = {k: n for k, n in histogram.items() if 0 < k <= large and n}
    for s in sizes:
        for length, n in merged[s]:
            rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        _best_fit(runs, length, rest[length], capacity)
    return [r for r in runs if r.count]


def places(runs: list[Run]) -> dict[str, np.ndarray]:
    """For each length, which ranks of its pieces go where: key (length << 44 | first rank), first sequence, offset."""
    given: dict[int, int] = {}
    rows: list[tuple[int, int, int]] = []
    base = 0
    for r in runs:
        offset = 0
        for length, copies in r.items:
            for _ in range(copies):
                rank = given.get(length, 0)
                rows.append((length << 44 | rank, base, offset))
                given[length] = rank + r.count
                offset += length
        base += r.count
    out = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return {"key": out[:, 0], "sequence": out[:, 1], "offset": out[:, 2]}


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, end_id: int = tokens.END_ID, path: str | None = None) -> DataFrame:
    """Pieces of each document's ids and end id: id, piece, start, length, ids_crc32, ids (little-endian 16 or 32
    bits), part and rank (a number among the pieces of this length that its task wrote)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    path = path or tokens.default_path()
    names = ["id", "piece", "start", "length", "ids_crc32", "ids", "part", "rank"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        seen = [0] * (capacity + 1)
        encoder = tokens.column_encoder(path)
        narrow = np.uint16 if tokens.tokenizer(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.uint32
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out: list[list] = [[] for _ in names]
                for doc_id, ids in zip(batch.column("id").to_pylist(), encoder.encode(batch.column("__text")), strict=True):
                    whole_ids = np.append(ids, np.uint32(end_id))
                    wide, slim = memoryview(whole_ids).cast("B"), memoryview(whole_ids.astype(narrow)).cast("B")
                    n, size = len(whole_ids), slim.itemsize * len(slim) // len(whole_ids)
                    start, k = 0, 0
                    while start < n:
                        stop = start + ((n - start - 1) % capacity + 1)  # the first takes what is over whole pieces
                        row = (doc_id, k, start, stop - start, zlib.crc32(wide[4 * start : 4 * stop]), bytes(slim[size * start : size * stop]), part, seen[stop - start])
                        seen[stop - start] += 1
                        for values, v in zip(out, row, strict=True):
                            values.append(v)
                        start, k = stop, k + 1
                kinds = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, part int, rank bigint")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """token_pieces with sequence_id and offset: every piece's place in as few sequences of `capacity` as found.

    Ids are written once to the shared folder. The driver gets the counts of the piece lengths (capacity
    numbers at most) and plans layouts for them; a piece's rank among the pieces of its length, whichever
    document it is of, then says its place. Equal documents need no common task. What moves to meet the counts
    are a task's pieces, by that task's number; without ids, only their lengths and ranks. A null or empty text is one
    piece, the end id; repeated rows are packed each; other columns are ignored; no rows give none.
    """
    pieces = materialize(token_pieces(docs, id_col, text_col, capacity, path=path), "packing")
    counts = pieces.groupBy("part", "length").count()
    histogram = {r["length"]: r["sum(count)"] for r in counts.groupBy("length").sum("count").collect()}
    found = places(plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            at = np.searchsorted(found["key"], length << 44 | rank, side="right") - 1
            sequence = found["sequence"][at] + rank - (found["key"][at] & ((1 << 44) - 1))
            keep = [n for n in batch.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(found["offset"][at])], [*keep, "sequence_id", "offset"])

    before = exclusive_sums(counts, "part", "count", "__before", by="length")
    before = before.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "__before"))).alias("__before"))  # a row of capacity numbers at most for each task
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = pieces.join(before, "part").select(*names, (F.col("__before")[F.col("length")] + F.col("rank")).alias("__rank"))
    kinds = [ranked.schema[n] for n in names]
    return ranked.mapInArrow(place, T.StructType([*kinds, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
