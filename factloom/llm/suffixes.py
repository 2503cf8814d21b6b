"""Removal of byte strings that an earlier document holds too, by range-partitioned sorting of sampled suffixes.

A match has MATCH bytes. Sorting every suffix would move each byte MATCH times, so suffixes are sampled by content: of
the windows of W neighbouring starts inside a match, the one whose next GRAM bytes have the least hash is its anchor.
Equal strings have equal anchors at equal places, so two documents that share a match share an anchor suffix, and what
else a match needs lies within REACH bytes before the anchor and MATCH bytes behind it. One anchor stands for all
matches (a run of starts) that chose it.

Texts are first written as compressed chunks. Most anchors stand alone: chunks exchange 32 bits of each distinct anchor
gram, and only anchors whose gram seems to occur again go on with their bytes. These suffixes are dealt to buckets by sampled splitters of their leading bytes. A bucket sorts what may repeat by
multikey quicksort, and each string of MATCH bytes that occurs in several documents is marked in all but the first of
them. A leading string that is too frequent for one bucket is dealt to several; what each of them still holds for its
first document is compared across them in a second, smaller exchange. Repeats within one task are settled there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_KEY, materialize, own_columns, partitions_for

MATCH, GRAM = 50, 16
W = MATCH - GRAM + 1  # starts of a match's grams
REACH = W - 1  # bytes of a match before its anchor, at most
WIDTH = REACH + MATCH
#: Bytes of text that a chunk has and that a task works on at once, anchors of a bucket, and grams that are compared at once.
CHUNK, BUCKET, UNIT = 4 << 20, 100_000, 1 << 21
#: Buckets that splitters tell apart (larger inputs cut each by a hash of the anchor), and bytes of text sampled for splitters.
MOST_BUCKETS, SAMPLE = 1 << 15, 64 << 20

_PART = T.StructType([T.StructField(n, T.LongType()) for n in ("bucket", "sub", "chunk")] + [T.StructField("body", T.BinaryType())])
_BITS = T.StructType([T.StructField(n, T.LongType()) for n in ("unit", "chunk", "n")] + [T.StructField("body", T.BinaryType())])
_ANCHOR = np.dtype([("bytes", np.uint8, (WIDTH,)), ("left", np.uint8), ("right", np.uint8), ("split", np.bool_), ("doc", "<i8"), ("chunk", "<i8"), ("nth", "<i4"), ("at", "<i8")])
_MARK = np.dtype([("chunk", "<i8"), ("nth", "<i4"), ("start", "<i8"), ("end", "<i8")])


def _words(flat: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The eight bytes from each place (or from `at` alone) as one number, the first byte highest, so numbers order as bytes do."""
    view = np.ndarray((len(flat) - 7,), dtype=">u8", buffer=flat, strides=(1,))
    return (view if at is None else view[at]).astype(np.uint64)


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def anchors(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts that stand one after another in flat and end at `ends`: each run of match starts with one anchor, as its
    anchor, its first and its last start."""
    n = len(flat)
    if n < MATCH:
        return (np.empty(0, np.int64),) * 3
    words = _words(flat)
    hashes = _mixed(_mixed(np.full(n - GRAM + 1, 0x2545F4914F6CDD1D, np.uint64), words[: n - GRAM + 1]), words[8 : n - GRAM + 9])
    least = (_mixed(hashes, hashes >> np.uint64(32)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - GRAM + 1, dtype=np.uint64)  # ties go to the left
    span = 1
    while span * 2 <= W:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < W:
        least = np.minimum(least[: n - MATCH + 1], least[W - span : W - span + n - MATCH + 1])
    sizes = np.diff(ends, prepend=0)
    last = np.repeat(ends - MATCH, sizes)[: n - MATCH + 1]  # the last start of each place's text
    start = np.flatnonzero(np.arange(n - MATCH + 1) <= last)
    if not len(start):
        return (np.empty(0, np.int64),) * 3
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
    first = np.concatenate(([0], new))
    return anchor[first], start[first], start[np.concatenate((new, [len(start)])) - 1]


def cut_out(flat: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An _ANCHOR row for each run of starts: the bytes that its matches cover, the anchor at REACH, zeros elsewhere."""
    rows = np.zeros(len(anchor), _ANCHOR)
    padded = np.concatenate((np.zeros(REACH, np.uint8), flat, np.zeros(MATCH, np.uint8)))
    place = np.arange(WIDTH)
    rows["left"], rows["right"] = anchor - first, last + MATCH - anchor
    held = (place >= REACH - rows["left"].astype(np.int64)[:, None]) & (place < REACH + rows["right"].astype(np.int64)[:, None])
    rows["bytes"] = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[anchor] * held
    return rows


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run of equal neighbours that each row belongs to, and where runs begin."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def multikey_groups(flat: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """Strings of `length` bytes from the places `at`, sorted by multikey quicksort with eight bytes for a key: strings
    are parted by their first key, and those of equal keys go on with the next. Parts within one document are left as
    soon as they are that. Gives the indexes that share their string with another document, and for each its group."""
    index = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    for offset in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        if not len(index):
            break
        word = _words(flat, at[index] + offset)
        order = np.lexsort((word, group))
        index, word, group = index[order], word[order], group[order]
        group, begins = _runs(group, word)
        least, most = np.minimum.reduceat(doc[index], begins), np.maximum.reduceat(doc[index], begins)
        keep = (least < most)[group]
        index, group = index[keep], group[keep]
    return index, group


def _same_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order in which equal anchor rows (bytes and lengths) stand together, and the group of each in that order."""
    flat = np.ascontiguousarray(rows["bytes"]).reshape(-1)
    base = np.arange(len(rows)) * WIDTH
    h = rows["left"].astype(np.uint64) << np.uint64(8) | rows["right"].astype(np.uint64)
    for offset in [*range(0, WIDTH - 7, 8), WIDTH - 8]:
        h = _mixed(h, _words(flat, base + offset))
    order = np.argsort(h, kind="stable")
    h = h[order]
    maybe = np.flatnonzero(h[1:] == h[:-1]) + 1
    new = np.ones(len(rows), bool)
    a, b = order[maybe - 1], order[maybe]
    new[maybe] = (rows["bytes"][a] != rows["bytes"][b]).any(axis=1) | (rows["left"][a] != rows["left"][b]) | (rows["right"][a] != rows["right"][b])
    return order, np.cumsum(new) - 1


def _whole(rows: np.ndarray) -> np.ndarray:
    """Marks for all that anchor rows cover."""
    marks = np.zeros(len(rows), _MARK)
    marks["chunk"], marks["nth"], marks["start"] = rows["chunk"], rows["nth"], rows["at"] - rows["left"]
    marks["end"] = rows["at"] + rows["right"]
    return marks


def settle_equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor rows that are still open, and marks of the others: a row equal to one of an earlier document is all covered."""
    if not len(rows):
        return rows, np.empty(0, _MARK)
    order, group = _same_rows(rows)
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    doc = rows["doc"][order]
    later = doc > np.minimum.reduceat(doc, begins)[group]
    return rows[order[~later]], _whole(rows[order[later]])


def _shared(rows: np.ndarray, offset: int) -> np.ndarray:
    """Whether another document's row agrees in the 32 bytes from `offset` (by a hash: it may say yes too often)."""
    flat, base = np.ascontiguousarray(rows["bytes"]).reshape(-1), np.arange(len(rows)) * WIDTH + offset
    h = np.zeros(len(rows), np.uint64)
    for k in range(0, 32, 8):
        h = _mixed(h, _words(flat, base + k))
    order = np.argsort(h)
    group, begins = _runs(h[order])
    doc = rows["doc"][order]
    out = np.empty(len(rows), bool)
    out[order] = (np.minimum.reduceat(doc, begins) < np.maximum.reduceat(doc, begins))[group]
    return out


def _windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and start column of each match of the rows."""
    n = rows["left"].astype(np.int64) + rows["right"] - MATCH + 1
    row = np.repeat(np.arange(len(rows)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, REACH - rows["left"].astype(np.int64)[row] + nth


def _covered(rows: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Marks for matches of rows, those with neighbouring starts as one."""
    order = np.lexsort((column, row))
    row, column = row[order], column[order]
    if not len(row):
        return np.empty(0, _MARK)
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(column) > 1))))
    ends = np.concatenate((begins[1:], [len(row)])) - 1
    marks = np.zeros(len(begins), _MARK)
    own = rows[row[begins]]
    marks["chunk"], marks["nth"] = own["chunk"], own["nth"]
    marks["start"], marks["end"] = own["at"] - REACH + column[begins], own["at"] - REACH + column[ends] + MATCH
    return marks


def settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks within one bucket, and its rows of split leading strings that other buckets may still cover."""
    rows, marks = settle_equal(rows)
    if not len(rows):
        return rows, marks
    # a match with REACH // 2 bytes or fewer before its anchor holds 32 bytes from it on; any other, the 16 before it and its gram
    ahead = (rows["right"] >= MATCH - REACH // 2) & _shared(rows, REACH)
    around = (rows["left"] >= 32 - GRAM) & _shared(rows, REACH - (32 - GRAM))
    some = rows[ahead | around]
    row, column = _windows(some)
    flat = np.concatenate((np.ascontiguousarray(some["bytes"]).reshape(-1), np.zeros(8, np.uint8)))
    index, group = multikey_groups(flat, row * WIDTH + column, some["doc"][row])
    if len(index):
        doc = some["doc"][row[index]]
        begins = np.flatnonzero(np.diff(group, prepend=-1))
        least = np.minimum.reduceat(doc, begins)
        later = doc > least[np.cumsum(np.diff(group, prepend=group[0]) != 0)]
        marks = np.concatenate((marks, _covered(some, row[index[later]], column[index[later]])))
    return rows[rows["split"]], marks


def _packed(rows: np.ndarray) -> bytes:
    """Rows column by column, as neighbours in a column are alike, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join(rows[name].tobytes() for name in rows.dtype.names))


def _unpacked(body: bytes, kind: np.dtype) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(body)
    rows, at = np.empty(len(data) // kind.itemsize, kind), 0
    for name in kind.names:
        column = kind[name]
        rows[name] = np.frombuffer(data, column.base, len(rows) * column.itemsize // column.base.itemsize, at).reshape(rows[name].shape)
        at += len(rows) * column.itemsize
    return rows


def _batch(bucket: list, sub: list, chunk: list, body: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(sub, pa.int64()), pa.array(chunk, pa.int64()), pa.array(body, pa.binary())], _PART.fieldNames())


def _by_chunk(marks: np.ndarray) -> pa.RecordBatch:
    """Marks as one body for each chunk, tagged by bucket -1."""
    marks = marks[np.argsort(marks["chunk"], kind="stable")]
    _, begins = _runs(marks["chunk"])
    bodies = [_packed(m) for m in np.split(marks, begins[1:])] if len(marks) else []
    return _batch([-1] * len(bodies), [0] * len(bodies), marks["chunk"][begins].tolist(), bodies)


def _chunker(chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _chunked(batches, chunk_bytes)


def _chunked(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Documents to chunks of chunk_bytes of text at most (a longer text is one by itself): ids, byte ends, all texts in one
    compressed body, and the documents' other columns."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    texts: list[bytes] = []
    docs: list[int] = []
    rows: list[pa.Array] = []
    size = 0

    def done() -> pa.RecordBatch:
        ends, body = np.cumsum([len(t) for t in texts]), zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        own = pa.concat_arrays(rows)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), x) for x in (pa.array(docs, pa.int64()), pa.array(ends, pa.int64()), own)]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(ends[-1])]), *lists, pa.array([body], pa.binary())], ["chunk", "size", "docs", "ends", "rows", "body"])

    for batch in batches:
        for i, (doc, text) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("body"), strict=True)):
            body = text.as_py() or b""
            if texts and size + len(body) > chunk_bytes:
                yield done()
                number, texts, docs, rows, size = number + 1, [], [], [], 0
            texts.append(body)
            docs.append(doc)
            rows.append(batch.column("row").slice(i, 1))
            size += len(body)
    if texts:
        yield done()


class _Chunk:
    """One chunk's texts, and its anchors in parts of `step` bytes that overlap by MATCH - 1, so that each match is in one."""

    def __init__(self, chunk: int, docs: list[int], ends: list[int], body: bytes):
        self.chunk, self.docs, self.ends = chunk, np.array(docs, np.int64), np.array(ends, np.int64)
        self.text = zstandard.ZstdDecompressor().decompress(body) if ends and ends[-1] else b""

    def parts(self, step: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """(bytes, anchors, first and last starts, place of the first byte in the chunk)."""
        flat = np.frombuffer(self.text, np.uint8)
        for at in range(0, max(len(flat) - MATCH + 1, 0), step):
            own = flat[at : at + step + MATCH - 1]
            ends = np.append(self.ends[(self.ends > at) & (self.ends < at + len(own))] - at, len(own))
            yield own, *anchors(own, ends), at

    def rows(self, flat: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, at: int) -> np.ndarray:
        rows = cut_out(flat, anchor, first, last)
        nth = np.searchsorted(self.ends, anchor + at, side="right")
        rows["doc"], rows["chunk"], rows["nth"] = self.docs[nth], self.chunk, nth
        rows["at"] = anchor + at - np.concatenate(([0], self.ends))[nth]
        return rows


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    for batch in batches:
        for row in batch.select(["chunk", "docs", "ends", "body"]).to_pylist():
            yield _Chunk(**row)


def _gram_hashes(flat: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(np.full(len(anchor), 0x51ED270B27B4A3E5, np.uint64), _words(flat, anchor)), _words(flat, anchor + 8))


def _distinct(chunk: _Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The distinct gram hashes of a chunk's anchors in order, and whether each occurs there more than once."""
    found = [_gram_hashes(flat, anchor) for flat, anchor, _, _, _ in chunk.parts()]
    hashes, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
    return hashes, counts > 1


def _unit(hashes: np.ndarray, units: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(units) >> np.uint64(32)).astype(np.int64)


def _announcer(units: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks to 32 bits of each distinct gram, by unit."""

    def announced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            hashes, _ = _distinct(chunk)
            unit = _unit(hashes, units)
            _, begins = _runs(unit)
            if len(hashes):
                parts = np.split((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), begins[1:])
                yield pa.RecordBatch.from_arrays([pa.array(unit[begins]), pa.array([chunk.chunk] * len(parts)), pa.array([len(x) for x in parts], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], _BITS.fieldNames())

    return announced


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of a unit to a bit for each: whether another chunk has it (other grams of the same 32 bits count, too)."""

    def unit_done(unit: int, chunks: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        grams = np.frombuffer(b"".join(bodies), np.uint32)
        order = np.argsort(grams, kind="stable")
        group, begins = _runs(grams[order])
        again = np.empty(len(grams), bool)
        again[order] = (np.diff(np.append(begins, len(grams))) > 1)[group]
        parts = np.split(again, np.cumsum([len(b) // 4 for b in bodies])[:-1])
        return pa.RecordBatch.from_arrays([pa.array([unit] * len(parts)), pa.array(chunks), pa.array([int(x.sum()) for x in parts], pa.int64()), pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())], _BITS.fieldNames())

    now, chunks, bodies = None, [], []
    for batch in batches:
        for unit, chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if unit != now and bodies:
                yield unit_done(now, chunks, bodies)
                chunks, bodies = [], []
            now = unit
            chunks.append(chunk)
            bodies.append(body)
    if bodies:
        yield unit_done(now, chunks, bodies)


def _leading(rows: np.ndarray) -> np.ndarray:
    """The gram of each anchor row as a string of GRAM bytes."""
    return np.ascontiguousarray(rows["bytes"][:, REACH : REACH + GRAM]).view(f"S{GRAM}").reshape(-1)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in _chunks(batches):
        for part in chunk.parts():
            yield pa.RecordBatch.from_arrays([pa.array(_leading(chunk.rows(*part))[::16].tolist(), pa.binary())], ["leading"])


def splitters(chunks: DataFrame, size: int, buckets: int) -> np.ndarray:
    """Leading strings that part all anchors into buckets of about the same number, from a sample of chunks of SAMPLE bytes
    (expected); a string that fills several buckets occurs as often."""
    if buckets <= 1:
        return np.empty(0, f"S{GRAM}")
    found = chunks.sample(False, min(1.0, SAMPLE / size), 12).mapInArrow(_sampled, "leading binary").toArrow()
    sample = np.sort(np.array(found.column(0).to_pylist(), f"S{GRAM}"))
    return sample[(np.arange(1, buckets) * len(sample)) // buckets] if len(sample) else np.empty(0, f"S{GRAM}")


def _dealer(cuts: np.ndarray, subs: int, units: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A chunk and the bits of its grams to bodies of anchor rows by bucket, and to marks of what is settled in the chunk."""

    def dealt(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        lead = _leading(rows)
        low, high = np.searchsorted(cuts, lead, side="left"), np.searchsorted(cuts, lead, side="right")
        own = high - low - 1  # a frequent string has the buckets between its own splitters to itself
        bucket = np.where(own > 0, low + 1 + (rows["chunk"] ^ rows["chunk"] >> 32) % np.maximum(own, 1), high)
        rows["split"] = own > 1
        words = np.ascontiguousarray(rows["bytes"][:, REACH : REACH + GRAM]).view("<u8")
        sub = (_mixed(_mixed(np.zeros(len(rows), np.uint64), words[:, 0]), words[:, 1]) % np.uint64(subs)).astype(np.int64)
        order = np.lexsort((lead, sub, bucket))
        rows, bucket, sub = rows[order], bucket[order], sub[order]
        _, begins = _runs(bucket, sub)
        if len(rows):
            yield _batch(bucket[begins].tolist(), sub[begins].tolist(), [0] * len(begins), [_packed(r) for r in np.split(rows, begins[1:])])

    def deal(chunks: pa.Table, bits: pa.Table) -> pa.Table:
        out = [_by_chunk(np.empty(0, _MARK))]
        for chunk in _chunks(chunks.to_batches()):
            hashes, again = _distinct(chunk)
            unit_of = _unit(hashes, units)
            _, begins = _runs(unit_of)
            ends = {int(unit_of[b]): (int(b), int(e)) for b, e in zip(begins, [*begins[1:], len(hashes)], strict=False)}
            for unit, body in zip(bits.column("unit").to_pylist(), bits.column("body").to_pylist(), strict=True):
                b, e = ends[unit]
                again[b:e] |= np.unpackbits(np.frombuffer(body, np.uint8), count=e - b).astype(bool)
            for flat, anchor, first, last, at in chunk.parts():
                kept = again[np.searchsorted(hashes, _gram_hashes(flat, anchor))]
                rows, marks = settle_equal(chunk.rows(flat, anchor[kept], first[kept], last[kept], at))
                out += [_by_chunk(marks), *dealt(rows)]
        return pa.Table.from_batches(out)

    return deal


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies in the order of their buckets to marks (marks that come along go through); rows of split strings that are open
    go on, tagged by bucket -2."""

    def bucket_done(bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        rest, marks = settle(np.concatenate([_unpacked(b, _ANCHOR) for b in bodies]))
        yield _by_chunk(marks)
        for part in np.array_split(rest, len(rest) // 100_000 + 1):
            if len(part):
                yield _batch([-2], [0], [0], [_packed(part)])

    now, bodies = None, []
    for batch in batches:
        ready = pc.less(batch.column(0), 0)
        yield batch.filter(ready)
        batch = batch.filter(pc.invert(ready))
        for bucket, sub, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (bucket, sub) != now and bodies:
                yield from bucket_done(bodies)
                bodies = []
            now = bucket, sub
            bodies.append(body)
    if bodies:
        yield from bucket_done(bodies)


def _open_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each match of the rows that are left of split strings, once for each document and place."""
    for batch in batches:
        for body in batch.column(0).to_pylist():
            rows = _unpacked(body, _ANCHOR)
            row, column = _windows(rows)
            strings = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(rows["bytes"]), MATCH, axis=1)[row, column]
            found = [pa.array(x) for x in (rows["doc"][row], rows["chunk"][row], rows["nth"][row], rows["at"][row] - REACH + column)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(strings).view(f"V{MATCH}").reshape(-1).tolist(), pa.binary()), *found], ["match", "doc", "chunk", "nth", "start"])


def _regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.zeros(batch.num_rows, _MARK)
        for i, name in enumerate(("chunk", "nth", "start")):
            marks[name] = batch.column(i).to_numpy(zero_copy_only=False)
        marks["end"] = marks["start"] + MATCH
        yield _by_chunk(marks)


def _kept(body: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text without the spans, its bytes removed, and the runs that they form."""
    if not len(starts):
        return body, 0, 0
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    begins, stops = starts[new], reach[np.concatenate((np.flatnonzero(new)[1:], [len(starts)])) - 1]
    cuts = [0, *np.stack((begins, stops), axis=1).reshape(-1).tolist(), len(body)]
    left = b"".join(body[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2))
    return left, len(body) - len(left), len(begins)


def _cutter(with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A chunk and its marks to a row for each document with what is left of its text."""

    def cut(chunks: pa.Table, marks: pa.Table) -> pa.Table:
        found = np.concatenate([np.empty(0, _MARK), *(_unpacked(b, _MARK) for b in marks.column("body").to_pylist())])
        found = found[np.argsort(found["nth"], kind="stable")]
        out: dict[str, list] = {"kept": [], "kept_sha256": [], "n_bytes": [], "n_removed": [], "n_spans": []}
        for chunk in _chunks(chunks.to_batches()):
            places = np.searchsorted(found["nth"], np.arange(len(chunk.docs) + 1)).tolist()
            begins = [0, *chunk.ends.tolist()]
            for nth in range(len(chunk.docs)):
                body, own = chunk.text[begins[nth] : begins[nth + 1]], found[places[nth] : places[nth + 1]]
                left, removed, spans = _kept(body, own["start"], own["end"])
                for name, value in zip(out, (left if with_text else None, hashlib.sha256(left).hexdigest(), len(body), removed, spans), strict=True):
                    out[name].append(value)
        kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        new = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
        return pa.Table.from_arrays([pc.list_flatten(chunks.column("rows")), *new], names=["row", *out])

    return cut


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", with_text: bool = True, chunk_bytes: int = CHUNK) -> DataFrame:
    """docs' columns without the text, as a struct `row`, with kept (the bytes that stay; null unless with_text),
    kept_sha256, n_bytes, n_removed and n_spans (runs of removed bytes).

    A byte is removed if a string of MATCH bytes around it also starts in a document of a smaller id; strings are those
    of the input, whatever is removed elsewhere, and none crosses documents. Rows that share an id are not compared
    with each other, and are each compared with all others; a null id is smaller than any. A null or empty text, or
    one shorter than MATCH bytes, stays as it is. Texts of any length are read whole. No rows give none. Columns keep
    their names inside `row`, so none clashes.
    """
    spark = docs.sparkSession
    others = F.struct(*[c for c, n in zip(own_columns(docs), docs.columns, strict=True) if n != text]).alias("row")
    texts = docs.select(others, F.coalesce(F.col(id).cast("bigint"), F.lit(NULL_KEY)).alias("doc"), F.col(text).cast("binary").alias("body"))
    kinds = [("chunk", T.LongType()), ("size", T.LongType()), ("docs", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.LongType())), ("rows", T.ArrayType(texts.schema["row"].dataType)), ("body", T.BinaryType())]
    chunks = materialize(texts.mapInArrow(_chunker(chunk_bytes), T.StructType([T.StructField(n, k) for n, k in kinds])), "suffix-chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    bodies = chunks.select("chunk", "docs", "ends", "body")

    units = max(1, -(-size // (W // 2 * UNIT)))  # an anchor stands for about half as many starts as choose one
    grams = bodies.mapInArrow(_announcer(units), _BITS).repartition(partitions_for(spark, units, 1), "unit").sortWithinPartitions("unit")
    bits = materialize(grams.mapInArrow(_compared, _BITS).where("n > 0"), "suffix-bits")
    again = bits.agg(F.sum("n")).first()[0] or 0
    buckets = -(-again // BUCKET)
    cuts = splitters(bodies, size, min(MOST_BUCKETS, buckets))
    dealt = bodies.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(_dealer(cuts, -(-buckets // MOST_BUCKETS) or 1, units), _PART)
    dealt = dealt.repartition(partitions_for(spark, buckets, 4), "bucket", "sub", "chunk").sortWithinPartitions("bucket", "sub")
    settled = materialize(dealt.mapInArrow(_settled, _PART), "suffix-marks")
    rest = settled.where("bucket = -2").select("body").mapInArrow(_open_matches, "match binary, doc bigint, chunk bigint, nth int, start bigint")
    across = rest.withColumn("first", F.min("doc").over(Window.partitionBy("match"))).where("doc > first").select("chunk", "nth", "start")
    marks = settled.where("bucket = -1").select("chunk", "body").union(across.mapInArrow(_regrouped, _PART).select("chunk", "body"))
    schema = T.StructType([texts.schema["row"], T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans"))])
    return chunks.drop("size").groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_cutter(with_text), schema)


#: What the query returns, by DuckDB, over a table named documents: each string with its place, two hex digits a byte.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT row, doc_id, place, substring(h, 2 * place + 1, {2 * MATCH}) AS s FROM docs, unnest(range(greatest(len(h) // 2 - {MATCH - 1}, 0))) AS u(place)),
marked AS (SELECT row, place FROM (SELECT row, place, doc_id > min(doc_id) OVER (PARTITION BY s) AS later FROM strings) WHERE later),
runs AS (SELECT row, place, sum((place > before + {MATCH})::INT) OVER (PARTITION BY row ORDER BY place) AS run FROM (SELECT row, place, lag(place, 1, place) OVER (PARTITION BY row ORDER BY place) AS before FROM marked)),
spans AS (SELECT row, run, min(place) AS b, max(place) + {MATCH} AS e FROM runs GROUP BY row, run),
gaps AS (SELECT row, b, e, lag(e, 1, 0) OVER (PARTITION BY row ORDER BY b) AS last FROM spans),
cut AS (SELECT row, sum(e - b) AS removed, count(*) AS spans, max(e) AS tail, string_agg(substring(h, 2 * last + 1, 2 * (b - last)), '' ORDER BY b) AS head FROM gaps JOIN docs USING (row) GROUP BY row)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN cut.row IS NULL THEN h ELSE head || substring(h, 2 * tail + 1) END)) AS kept_sha256
FROM docs LEFT JOIN cut USING (row)
"""
