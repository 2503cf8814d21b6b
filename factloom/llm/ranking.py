"""Ranked lexical search of queries over all documents: TPUT over term-partitioned postings.

A list is a term's postings; its entry for a document is the part of a score that the term brings. Three phases read the
lists: their heads give each query a lower bound of its K-th score; every list is read down to one threshold, that bound
over the number of the query's lists, which leaves out no document that can reach the bound; and the documents whose
upper bound still reaches the K-th partial score are looked up in all their lists. What the second phase reads of the
lists moves once, as blocks, to the task that sums a block's documents; no entry moves by itself.

All numbers of a score are 64-bit integers but the logarithm in a term's weight.
"""

from __future__ import annotations

import math
import string
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Fixed values of the score: its scale, the scale of weights, saturation and length parts.
SCALE, WEIGHT, K1, B, WHOLE = 1_000_000_000, 1000, 20, 50, 100
TOP = 50
#: Entries of a list's head; documents of a block; input partitions whose part of a list stays together; terms of
#: queries that are searched at once; candidates that are broadcast to the lists (more are joined by a shuffle).
HEAD, BLOCK, STRETCH, TERMS, BROADCAST = 200, 2048, 256, 1 << 20, 1 << 20

#: ASCII digits and letters, lower-cased, and every byte beyond ASCII belong to a term; all else is white space.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_POSTINGS = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("block", T.LongType()), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("place", "tf", "size")), T.StructField("ids", T.ArrayType(T.LongType()))])
_ENTRY = "item int, row bigint, part bigint"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in order, as UTF-8, only A-Z lower-cased."""
    return text.translate(_FOLD).split()


def weight(n: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n + 2) / (2 * df + 1)))


def parts_of(w: int | np.ndarray, tf: np.ndarray, size: np.ndarray, n: int, length: int) -> np.ndarray:
    """What a term of weight w brings to the scores of documents of `size` terms that hold it tf times."""
    tf, m = tf.astype(np.int64), WHOLE - B + (B * n * size.astype(np.int64)) // length
    return w * ((SCALE * tf) // (WEIGHT * tf + K1 * m))


class _Queries:
    """What tasks know of the queries: terms by number, the queries of each term, and what the phases have found so far."""

    def __init__(self, items: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        pairs = sorted((self.number.setdefault(t, len(self.number)), i) for i, terms in enumerate(items) for t in terms)
        terms, self.item = np.array(pairs, np.int64).reshape(-1, 2).T
        self.begins = np.searchsorted(terms, np.arange(len(self.number) + 1))
        self.terms = [[self.number[t] for t in own] for own in items]
        self.lists = np.bincount(self.item, minlength=len(items))
        self.n = self.length = 0
        self.weights, self.most = np.zeros(len(self.number), np.int64), np.zeros(len(self.number), np.int64)
        self.least = np.ones(len(items), np.int64)

    def of(self, term: int) -> np.ndarray:
        return self.item[self.begins[term] : self.begins[term + 1]]


class _Blocks:
    """A batch of postings with the parts of all entries, computed at once."""

    def __init__(self, batch: pa.RecordBatch, q: _Queries):
        self.terms, self.blocks = batch.column("term").to_pylist(), batch.column("block").to_pylist()
        self.ends = batch.column("place").offsets.to_numpy()
        first, last = int(self.ends[0]), int(self.ends[-1])
        place, tf, size = (self._values(batch.column(n)) for n in ("place", "tf", "size"))
        self.ends = self.ends - first
        counts = np.diff(self.ends)
        self.place, self.tf = place, tf
        self.row = np.repeat(batch.column("block").to_numpy(), counts) + place
        self.part = parts_of(np.repeat(q.weights[batch.column("term").to_numpy()], counts), tf, size, q.n, q.length)
        assert len(self.part) == last - first

    @staticmethod
    def _values(column: pa.ListArray) -> np.ndarray:
        ends = column.offsets
        return column.values.slice(ends[0].as_py(), ends[-1].as_py() - ends[0].as_py()).to_numpy(zero_copy_only=False)

    def __iter__(self) -> Iterator[tuple[int, int, int, slice]]:
        for i, (term, block) in enumerate(zip(self.terms, self.blocks, strict=True)):
            yield i, term, block, slice(self.ends[i], self.ends[i + 1])


class _Rows:
    """Arrays for output columns, given out as batches of LARGEST rows or more."""

    LARGEST = 1 << 18

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.names, self.kinds, self.parts, self.size = names, kinds, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size >= self.LARGEST:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*self.parts, strict=True), self.kinds, strict=True)], self.names)
        self.parts, self.size = [], 0


def _entries() -> _Rows:
    return _Rows(["item", "row", "part"], [pa.int32(), pa.int64(), pa.int64()])


def _indexer(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to blocks of postings: a row for each term that a query has and a block has, and one of term -1 with the
    documents' ids and sizes."""

    def written(block: int, term: array, place: array, tf: array, sizes: list[int], ids: list[int | None]) -> pa.RecordBatch:
        terms, places, tfs = (np.frombuffer(x, np.int32) if x else np.empty(0, np.int32) for x in (term, place, tf))
        order = np.argsort(terms, kind="stable")
        terms, places, tfs = terms[order], places[order], tfs[order]
        begins = np.flatnonzero(np.diff(terms, prepend=-1))
        offsets = np.concatenate(([0, 0], begins[1:], [len(terms)])) if len(begins) else np.array([0, 0])
        lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (places, tfs)]
        all_sizes = np.array(sizes, np.int32)
        spans = np.concatenate(([0, len(sizes)], begins[1:] + len(sizes), [len(terms) + len(sizes)])) if len(begins) else np.array([0, len(sizes)])
        size = pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), pa.array(np.concatenate((all_sizes, all_sizes[places]))))
        own = pa.ListArray.from_arrays(pa.array(np.array([0] + [len(ids)] * (len(begins) + 1), np.int32)), pa.array(ids, pa.int64()))
        number = pa.array(np.concatenate(([-1], terms[begins])).astype(np.int32))
        return pa.RecordBatch.from_arrays([number, pa.array([block] * (len(begins) + 1), pa.int64()), *lists, size, own], _POSTINGS.fieldNames())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = known.value.number, TaskContext.get()
        block = (task.partitionId() if task else 0) << 33
        term, place, tf, sizes, ids = array("i"), array("i"), array("i"), [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counted = Counter(terms_of(text.as_py()))
                if not counted:
                    continue
                for word in counted.keys() & number.keys():
                    term.append(number[word])
                    place.append(len(ids))
                    tf.append(counted[word])
                ids.append(doc)
                sizes.append(counted.total())
                if len(ids) == BLOCK:
                    yield written(block, term, place, tf, sizes, ids)
                    term, place, tf, sizes, ids, block = array("i"), array("i"), array("i"), [], [], block + BLOCK
        if ids:
            yield written(block, term, place, tf, sizes, ids)

    return index


def _heads(known: Broadcast, head: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The greatest parts of each list in a task, `head` at most for each stretch of the list's blocks."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, row, out = -1, np.empty(0, np.int64), np.empty(0, np.int64), _Rows(["term", "row", "part"], [pa.int32(), pa.int64(), pa.int64()])
        for batch in batches:
            blocks = _Blocks(batch, known.value)
            for _, term, _, own in blocks:
                if term != now:
                    yield from out.add(np.full(len(part), now), row, part)
                    now, part, row = term, np.empty(0, np.int64), np.empty(0, np.int64)
                part, row = np.concatenate((part, blocks.part[own])), np.concatenate((row, blocks.row[own]))
                if len(part) > head:
                    top = np.lexsort((row, -part))[:head]
                    part, row = part[top], row[top]
        yield from out.add(np.full(len(part), now), row, part)
        yield from out.rest()

    return heads


def _spread(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries of heads for each query that has the list."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, out = known.value, _entries()
        for batch in batches:
            term, row, part = (batch.column(n).to_numpy() for n in ("term", "row", "part"))
            counts = (q.begins[1:] - q.begins[:-1])[term]
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield from out.add(q.item[np.repeat(q.begins[term], counts) + nth], np.repeat(row, counts), np.repeat(part, counts))
        yield from out.rest()

    return spread


def _thresholded(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every list down to the least threshold of the queries that have it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = known.value
        least = np.minimum.reduceat(q.least[q.item], q.begins[:-1])
        for batch in batches:
            blocks = _Blocks(batch, q)
            counts = np.diff(blocks.ends)
            kept = blocks.part >= np.repeat(least[batch.column("term").to_numpy()], counts)
            ends = np.concatenate(([0], np.cumsum(kept)))[blocks.ends].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[kept])) for x in (blocks.place, blocks.tf)]
            out = pa.RecordBatch.from_arrays([batch.column("term"), batch.column("block"), *lists], ["term", "block", "place", "tf"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    return read


def _summed(known: Broadcast, bound: np.ndarray, reach: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial sums of each query over blocks that come as their lists, the sizes of their documents first, with upper
    bounds; only what reaches the query's lower bound, which is raised to the k-th partial sum of the task so far."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, out = known.value, _Rows(["item", "row", "part", "upper"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()])
        best = np.zeros((len(bound), k), np.int64)  # the k greatest partial sums of each query in this task
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = np.empty(0, np.int64)

        def block_done(block: int) -> Iterator[pa.RecordBatch]:
            for item, terms in enumerate(q.terms):
                least, own = int(q.least[item]), [t for t in terms if t in lists]
                if not own:
                    continue
                place, part = (np.concatenate([lists[t][i] for t in own]) for i in (0, 1))
                most = np.repeat([min(least - 1, int(q.most[t])) for t in own], [len(lists[t][0]) for t in own])
                over = part >= least
                total, unseen = np.zeros(len(size), np.int64), np.full(len(size), reach[item])
                np.add.at(total, place[over], part[over])
                np.subtract.at(unseen, place[over], most[over])
                best[item] = np.partition(np.concatenate((best[item], total)), -k)[-k:]
                found = np.flatnonzero((total > 0) & (total + unseen >= max(bound[item], best[item].min())))
                yield from out.add(np.full(len(found), item), block + found, total[found], (total + unseen)[found])

        now = -1
        for batch in batches:
            place, tf = (_Blocks._values(batch.column(n)) for n in ("place", "tf"))
            at, ends = (c.offsets.to_numpy() - c.offsets[0].as_py() for c in (batch.column("place"), batch.column("tf")))
            for i, (term, block) in enumerate(zip(batch.column("term").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                if term < 0:
                    if now >= 0:
                        yield from block_done(now)
                    now, size = block, tf[ends[i] : ends[i + 1]].astype(np.int64)
                    lists.clear()
                else:
                    own = place[at[i] : at[i + 1]].copy()
                    lists[term] = own, parts_of(int(q.weights[term]), tf[ends[i] : ends[i + 1]], size[own], q.n, q.length)
        if now >= 0:
            yield from block_done(now)
        yield from out.rest()

    return sums


def _looked_up(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parts of candidates: each row has a list's block and the block's candidates (query, place)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, out = known.value, _entries()
        for batch in batches:
            blocks = _Blocks(batch, q)
            all_items, all_places = (_Blocks._values(batch.column(n)) for n in ("items", "places"))
            ends = batch.column("items").offsets.to_numpy()
            ends = ends - ends[0]
            for i, term, block, own in blocks:
                wanted, place = all_items[ends[i] : ends[i + 1]], all_places[ends[i] : ends[i + 1]]
                holds = np.isin(wanted, q.of(term))
                wanted, place = wanted[holds], place[holds]
                there = blocks.place[own]
                at = np.minimum(np.searchsorted(there, place), len(there) - 1)
                hit = there[at] == place
                part = blocks.part[own][at[hit]]
                yield from out.add(wanted[hit], block + place[hit].astype(np.int64), part)
        yield from out.rest()

    return look


def _best(sums: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of each item with the greatest `by`; each task keeps its own k before rows move."""
    return sums.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc(by)))).where(F.col("nth") <= k)


def _kth(sums: DataFrame, by: str, k: int) -> list[tuple[int, int]]:
    """The k-th greatest `by` of each item that has so many: one number for each query that is searched."""
    return [(r["item"], r[by]) for r in _best(sums, by, k).where(F.col("nth") == k).select("item", by).collect()]


def _search(docs: DataFrame, items: list[list[bytes]], k: int) -> DataFrame | None:
    """(item, rank, doc_id, score) for queries whose terms, TERMS or so in all, the driver holds; item is a query's index."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    q, most = _Queries(items), max(k, HEAD)
    blocks = docs.mapInArrow(_indexer(context.broadcast(q)), _POSTINGS)
    # a list is partitioned by its term, and a long one by stretches of the input, so that no term is one task
    stretch = F.when(F.col("term") < 0, F.col("block")).otherwise(F.floor(F.shiftright("block", 33) / STRETCH))
    blocks = materialize(blocks.withColumn("stretch", stretch).repartition("term", "stretch").sortWithinPartitions("term", "block").drop("stretch"), "postings")
    postings, documents = blocks.where("term >= 0").select("term", "block", "place", "tf", "size"), blocks.where("term < 0").select("block", "size", "ids")
    about = documents.select(F.size("size").alias("n"), F.aggregate("size", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("length")).agg(F.sum("n"), F.sum("length")).first()
    if not about[0] or not q.number:
        return None
    q.n, q.length = int(about[0]), int(about[1])
    for r in postings.groupBy("term").agg(F.sum(F.size("place")).alias("df")).collect():  # a number for each term
        q.weights[r["term"]] = weight(q.n, r["df"])
    known = context.broadcast(q)

    # phase 1: the heads of all lists
    heads = postings.mapInArrow(_heads(known, most), "term int, row bigint, part bigint")
    heads = heads.withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("part"), "row"))).where(F.col("nth") <= most)
    heads = materialize(heads, "heads")
    for r in heads.where("nth = 1").select("term", "part").collect():
        q.most[r["term"]] = r["part"]
    sums = heads.select("term", "row", "part").mapInArrow(_spread(known), _ENTRY).groupBy("item", "row").agg(F.sum("part").alias("part"))
    bound = np.zeros(len(items), np.int64)
    for item, value in _kth(sums, "part", k):
        bound[item] = value
    # a document whose parts are all under the bound divided by the number of lists is under the bound
    q.least = np.maximum(1, -(-bound // np.maximum(q.lists, 1)))
    known = context.broadcast(q)

    # phase 2: every list down to the query's threshold; an unseen part is under it, and never more than the list's most
    reach = np.zeros(len(items), np.int64)
    list_of = np.repeat(np.arange(len(q.number)), np.diff(q.begins))
    np.add.at(reach, q.item, np.minimum(q.least[q.item] - 1, q.most[list_of]))
    cut = postings.mapInArrow(_thresholded(known), "term int, block bigint, place array<int>, tf array<int>")
    sized = documents.select(F.lit(-1).alias("term"), "block", F.array().cast("array<int>").alias("place"), F.col("size").alias("tf"))
    by_block = cut.union(sized).repartition("block").sortWithinPartitions("block", "term")  # all lists of a document meet
    seen = materialize(by_block.mapInArrow(_summed(known, bound, reach, k), "item int, row bigint, part bigint, upper bigint"), "seen")
    kth = spark.createDataFrame(_kth(seen, "part", k), "item int, kth bigint")
    candidates = seen.join(kth, "item", "left").where("kth is null or upper >= kth")
    candidates = materialize(candidates.select("item", (F.col("row") - F.col("row") % BLOCK).alias("block"), (F.col("row") % BLOCK).cast("int").alias("place")), "candidates")

    # phase 3: the candidates' scores from all their lists
    wanted = candidates.groupBy("block").agg(F.collect_list(F.struct("item", "place")).alias("c")).select("block", F.col("c.item").alias("items"), F.col("c.place").alias("places"))
    wanted = F.broadcast(wanted) if candidates.count() <= BROADCAST else wanted
    scores = postings.join(wanted, "block").mapInArrow(_looked_up(known), _ENTRY).groupBy("item", "row").agg(F.sum("part").alias("score")).where("score > 0")
    scores = scores.withColumn("block", F.col("row") - F.col("row") % BLOCK)
    found = scores.join(documents.select("block", "ids"), "block").select("item", "row", "score", F.get("ids", (F.col("row") % BLOCK).cast("int")).alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents of the highest scores above 0 for each row of queries, all if fewer.

    Equal scores rank by doc_id, null first, and then in the order of the input. Rows count for themselves: documents or
    queries that share an id, or have none, are several. A null or empty text has no terms: such a document is no part
    of the statistics, such a query finds nothing; without documents or queries the result is empty. Other columns are
    left behind. Queries are searched in blocks of about TERMS terms, each against all documents.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("body")).where("body is not null")
    asked = queries.select(F.col(query_id).alias("query"), F.col(query_text).cast("binary").alias("body")).withColumn("nth", F.monotonically_increasing_id())
    asked = materialize(asked, "queries")
    total = asked.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_blocks = -(-total // (2 * TERMS)) or 1  # a term and what parts it from the next are two bytes at least
    out = spark.createDataFrame([], T.StructType([T.StructField(query_id, asked.schema["query"].dataType), *(T.StructField(n, t) for n, t in (("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType())))]))
    for b in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("nth"), F.lit(n_blocks)) == b).select("nth", "body").collect()
        found = _search(body, [sorted(set(terms_of(r["body"] or b""))) for r in own], k)
        if found is not None:
            names = spark.createDataFrame([(i, r["nth"]) for i, r in enumerate(own)], "item int, nth bigint").join(asked.select("nth", "query"), "nth")
            out = out.union(found.join(names, "item").select("query", "rank", "doc_id", "score"))
    return out


#: What the query returns, by DuckDB, over tables named documents and benchmark.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = f"unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_TERM}')) AS term"
SQL = f"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents), each AS (SELECT row, doc_id, {_WORDS} FROM words),
sizes AS (SELECT row, doc_id, count(*) AS n FROM each GROUP BY ALL), about AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
tfs AS (SELECT row, term, count(*) AS tf FROM each GROUP BY ALL),
weights AS (SELECT term, floor({WEIGHT} * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, about GROUP BY term, docs),
items AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark), asked AS (SELECT DISTINCT item, item_id, {_WORDS} FROM items),
parts AS (SELECT item, item_id, row, doc_id, w * (({SCALE} * tf) // ({WEIGHT} * tf + {K1} * ({WHOLE - B} + ({B} * n * docs) // length))) AS part
    FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (row), about),
scores AS (SELECT item, item_id, row, doc_id, sum(part)::BIGINT AS score FROM parts GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST, row))::INT AS rank, doc_id, score FROM scores QUALIFY rank <= {TOP}
"""
