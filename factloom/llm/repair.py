"""Token-id files with Re-Pair grammar compression and random-access decoding."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import NULL_KEY, bucket_of, exclusive_sums, materialize, partitions_for, range_bounds

MAGIC = b"RPG2"
#: Tokens after which a file is closed.
FILE_TOKENS = 3 << 19
#: Pairs that one round replaces at most; rounds go on until no pair is left with LEAST_USES.
RULES_A_ROUND = 16384
LEAST_USES = 2
_HEAD = "<4sQQQQIII"


def _pairs(seq: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places) of the pairs that begin at `places` (ascending), by code and then by place. Both are sorted as one
    number where they fit in it, which takes a fraction of the time that sorting places by their codes does."""
    symbol_bits, place_bits = max(1, int(seq.max()).bit_length()), max(1, int(places[-1]).bit_length())
    codes = seq[places].astype(np.uint64)
    codes <<= np.uint64(symbol_bits)
    codes |= seq[places + 1]
    if 2 * symbol_bits + place_bits > 64:
        order = np.argsort(codes, kind="stable")
        return codes[order], places[order]
    codes <<= np.uint64(place_bits)
    codes |= places.view(np.uint64)
    codes.sort()
    at = (codes & np.uint64((1 << place_bits) - 1)).view(np.int64)
    codes >>= np.uint64(place_bits)
    return codes, at


def grammar(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(symbols, ends, rules, first rule of each round): the most frequent adjacent pairs, RULES_A_ROUND at most, become
    nonterminals from `base` on, round after round until no pair has LEAST_USES; no pair spans the end of a document
    (`ends`: places of their last symbols, ascending).

    Counts are exact. A round reads the pairs at `live` places alone: one that was too rare stays so, since uses of a pair
    only go away, and a new pair has a symbol of the round before it.
    """
    seq, ends = ids.astype(np.uint32), ends.copy()
    rules: list[np.ndarray] = []
    starts: list[int] = []
    free = base
    live = np.ones(len(seq), bool)
    live[ends] = live[-1:] = False
    while len(places := np.flatnonzero(live)) >= LEAST_USES:
        codes, at = _pairs(seq, places)
        first = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1))
        uses = np.diff(np.append(first, len(codes)))
        often = uses >= LEAST_USES
        live[at[np.repeat(~often, uses)]] = False
        chosen = np.flatnonzero(often)
        chosen = chosen[np.argsort(-uses[chosen], kind="stable")[:RULES_A_ROUND]]
        if not len(chosen):
            break
        first, uses = first[chosen], uses[chosen]
        name = np.full(len(seq), -1, np.int32)  # which pair begins here
        name[at[np.arange(uses.sum()) + np.repeat(first - np.cumsum(uses) + uses, uses)]] = np.repeat(np.arange(len(chosen), dtype=np.int32), uses)
        hits = np.flatnonzero(name >= 0)
        opens = np.concatenate(([0], np.flatnonzero(np.diff(hits) > 1) + 1))
        every = (hits - np.repeat(hits[opens], np.diff(np.append(opens, len(hits))))) & 1 == 0  # neighbours overlap: every second one of a row
        hits = hits[every]
        own = name[hits]
        used = np.flatnonzero(np.bincount(own, minlength=len(chosen)))
        symbol = np.zeros(len(chosen), np.uint32)
        symbol[used] = np.arange(free, free + len(used), dtype=np.uint32)
        one = at[first[used]]
        rules.append(np.stack((seq[one], seq[one + 1]), 1))
        starts.append(free)
        seq[hits] = symbol[own]
        free += len(used)
        keep = np.ones(len(seq), bool)
        keep[hits + 1] = False
        kept = np.flatnonzero(keep)
        seq, live = seq[kept], live[kept]
        ends = ends - np.searchsorted(hits, ends)  # each pair before an end, or at it, took a symbol away
        hits -= np.arange(len(hits))
        live[hits] = live[hits - 1] = True
        live[ends] = live[-1:] = False
    return seq, ends, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), starts


def _expansions(rules: np.ndarray, base: int, starts: list[int]) -> np.ndarray:
    lengths = np.ones(len(rules), np.uint32)
    for lo, hi in zip(starts, [*starts[1:], base + len(rules)], strict=True):
        own = rules[lo - base : hi - base].astype(np.int64)
        lengths[lo - base : hi - base] = np.where(own >= base, lengths[np.maximum(own - base, 0)], 1).sum(1)
    return lengths


def _narrow(symbols: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(symbols, "<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _wide(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view(np.uint32).ravel()


def write_file(doc_ids: list[int | None], ids: list[np.ndarray], base: int) -> bytes:
    """One file: counts; the documents' ids, null flags, tokens and first symbols; rules and symbols, of three or four
    bytes each; expansion lengths, of two or four."""
    n_tokens = np.array([len(x) for x in ids], np.uint64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    last = np.cumsum(n_tokens.astype(np.int64))[n_tokens > 0] - 1
    symbols, ends, rules, starts = grammar(flat, last, base)
    stops = np.zeros(len(ids), np.int64)
    stops[n_tokens > 0] = ends + 1
    first = np.concatenate(([0], np.maximum.accumulate(stops) if len(stops) else stops)).astype(np.uint64)
    width = 3 if base + len(rules) < 1 << 24 else 4
    lengths = _expansions(rules, base, starts)
    long = 2 if not len(lengths) or lengths.max() < 1 << 16 else 4
    head = struct.pack(_HEAD, MAGIC, len(ids), len(rules), len(symbols), base, width, long, len(starts))
    keys = np.array([NULL_KEY if d is None else d for d in doc_ids], np.int64)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([head, np.array(starts, np.uint64).tobytes(), keys.tobytes(), nulls.tobytes(), n_tokens.tobytes(), first.tobytes(), _narrow(rules, width), lengths.astype(f"<u{long}").tobytes(), _narrow(symbols, width)])


@dataclass
class Reader:
    """A file in memory: whole decoding, or any range of a document without decoding the rest."""

    blob: bytes

    def __post_init__(self) -> None:
        magic, docs, rules, symbols, self.base, width, long, rounds = struct.unpack_from(_HEAD, self.blob)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = struct.calcsize(_HEAD)

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.blob, kind, n, at)
            at += out.nbytes
            return out

        self.starts = take(np.uint64, rounds).astype(np.int64).tolist()
        keys, nulls = take(np.int64, docs), take(np.uint8, docs)
        self.doc_ids = [None if z else k for k, z in zip(keys.tolist(), nulls.tolist(), strict=True)]
        self.n_tokens, self.first = take(np.uint64, docs).astype(np.int64), take(np.uint64, docs + 1).astype(np.int64)
        self.rules = _wide(take(np.uint8, 2 * rules * width), width).reshape(-1, 2)
        self.lengths = take(np.dtype(f"<u{long}"), rules).astype(np.uint32)
        self.symbols = _wide(take(np.uint8, symbols * width), width)

    def tokens(self) -> np.ndarray:
        """All ids: each rule is written out once, a round after the other, and symbols are put together from that."""
        size = np.concatenate((np.ones(self.base, np.int64), self.lengths))
        at = np.cumsum(size) - size
        flat = np.empty(size.sum(), np.uint32)
        flat[: self.base] = np.arange(self.base)

        def unfold(symbols: np.ndarray) -> np.ndarray:
            own = size[symbols]
            place = np.repeat(at[symbols] - np.cumsum(own) + own, own)
            place += np.arange(len(place))
            return flat[place]

        for lo, hi in zip(self.starts, [*self.starts[1:], len(size)], strict=True):
            flat[at[lo] : at[hi - 1] + size[hi - 1]] = unfold(self.rules[lo - self.base : hi - self.base].ravel())
        return unfold(self.symbols)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the file's k-th document; subtrees outside are skipped by their lengths."""
        stop = int(self.n_tokens[k]) if stop is None else min(stop, int(self.n_tokens[k]))
        symbols = self.symbols[self.first[k] : self.first[k + 1]].astype(np.int64)
        size = np.where(symbols >= self.base, self.lengths[np.maximum(symbols - self.base, 0)] if len(self.lengths) else 1, 1)
        ends = np.cumsum(size)
        out: list[int] = []
        at = int(np.searchsorted(ends, start, side="right"))
        stack = [(int(s), int(e - n)) for s, e, n in zip(symbols[at:], ends[at:], size[at:], strict=True) if e - n < stop][::-1]
        while stack:
            s, place = stack.pop()
            if s < self.base:
                if start <= place < stop:
                    out.append(s)
                continue
            left, right = (int(x) for x in self.rules[s - self.base])
            width = int(self.lengths[left - self.base]) if left >= self.base else 1
            if place + width < stop:
                stack.append((right, place + width))
            if place + width > start:
                stack.append((left, place))
        return np.array(out, np.uint32)


def files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID, path: str | None = None, rows_per_bucket: int = 1024) -> DataFrame:
    """A written table with a file in each row (file: its place in order, n_docs, n_tokens, blob): all documents'
    ids and end ids in ascending id order, null ids first and ties by text.

    Rows go once to range buckets; a task encodes its buckets in order and closes a file at FILE_TOKENS tokens
    or at a bucket's end, so neither memory nor a file grows with the corpus. The rows are files in a Parquet
    table because executors share no other folder that every cluster can write.
    """
    path = path or tokens.default_path()
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_KEY))
    bounds = range_bounds(docs, key, rows_per_bucket)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), key.alias("key"))
    rows = rows.withColumn("bucket", bucket_of(F.col("key"), bounds)).repartition(partitions_for(docs.sparkSession, len(bounds), 4), "bucket")
    rows = rows.sortWithinPartitions("bucket", "key", F.xxhash64("text"), "text").select("bucket", "id", "text")
    names = ["file", "n_docs", "n_tokens", "blob"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = max(tokens.tokenizer(path).get_vocab_size(), end_id + 1)
        encoder = tokens.column_encoder(path)
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        n, number, open_bucket = 0, 0, None

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, ids, n, number
            blob = write_file(doc_ids, ids, base)
            out = pa.RecordBatch.from_arrays([pa.array([open_bucket << 24 | number]), pa.array([len(ids)]), pa.array([n]), pa.array([blob], pa.binary())], names)
            doc_ids, ids, n, number = [], [], 0, number + 1
            return out

        for batch in batches:
            encoded = encoder.encode(batch.column("text"))
            for bucket, doc_id, got in zip(batch.column("bucket").to_pylist(), batch.column("id").to_pylist(), encoded, strict=True):
                if bucket != open_bucket:
                    if ids:
                        yield close()
                    open_bucket, number = bucket, 0
                doc_ids.append(doc_id)
                ids.append(np.append(got, np.uint32(end_id)))
                n += len(got) + 1
                if n >= FILE_TOKENS:
                    yield close()
        if ids:
            yield close()

    return materialize(rows.mapInArrow(write, "file bigint, n_docs bigint, n_tokens bigint, blob binary"), "token-files")


def read_back(written: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, decoded from the files alone."""
    names = ["file", "id", "place", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, blob in zip(batch.column("file").to_pylist(), batch.column("blob"), strict=True):
                r = Reader(blob.as_buffer().to_pybytes())
                flat = memoryview(np.ascontiguousarray(r.tokens(), "<u4")).cast("B")
                stops = np.cumsum(r.n_tokens)
                starts = stops - r.n_tokens
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(crc), pa.int64()), pa.array(r.doc_ids, pa.int64()), pa.array(starts), pa.array(r.n_tokens), pa.array(crc, pa.int64())], names)

    found = written.select("file", "blob").mapInArrow(read, "file bigint, id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    bases = exclusive_sums(written.select("file", F.col("n_tokens").alias("total")), "file", "total", "base", block=1 << 34).select("file", "base")
    return found.join(bases, "file").select("id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write all documents as files and return what the files say of each. A null or empty text is its end id
    alone; repeated rows are written each; other columns are ignored; an empty table gives an empty one."""
    return read_back(files(docs, id_col, text_col, path=path))
