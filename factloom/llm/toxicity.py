"""Toxicity: a logistic classifier on words and word beginnings, regularised by counterfactual identity swaps."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize

#: Labelled rows that training uses at most: those of the smallest hashes.
MAX_LABELLED = 16_000
FEATURES = 4096
PREFIXES = (4, 5, 6)
LEAST_ROWS = 4
THRESHOLD = 0.3
HELD_OUT_FOLD = 2

#: Terms for groups of people; a swap replaces a term by the others of its row.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "arab", "european"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)
_SWAPS = {term: [t for t in row if t != term] for row in IDENTITY for term in row}
_WORD = re.compile(r"[^\W\d_]+")


def raw_words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def word_features(raw: str) -> list[str]:
    """Features of what stands between spaces: its words, and their beginnings."""
    out = []
    for w in _WORD.findall(raw):
        out.append(w)
        out += [f"{w[:n]}*" for n in PREFIXES if len(w) > n]
    return out


@dataclass
class Model:
    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: Iterable[str | None]) -> Iterator[float]:
        known: dict[str, tuple[str, ...]] = {}
        weights = self.weights
        for text in texts:
            hits: set[str] = set()
            for raw in raw_words(text):
                got = known.get(raw)
                if got is None:
                    if len(known) > 200_000:
                        known.clear()
                    got = known[raw] = tuple(f for f in word_features(raw) if f in weights)
                if got:
                    hits.update(got)
            z = self.bias + math.fsum(weights[f] for f in hits)  # exact, whatever the order of the set
            yield 1 / (1 + np.exp(-min(max(z, -40.0), 40.0)))


def _features(words: Iterable[str]) -> set[str]:
    return {f for raw in words for f in word_features(raw)}


def _swapped(words: set[str], rng: np.random.Generator) -> set[str] | None:
    """The words with each identity term replaced by another of its row; None without such terms."""
    present = [w for w in words if (core := _WORD.findall(w)) and len(core) == 1 and core[0] in _SWAPS]
    if not present:
        return None
    out = words - set(present)
    for w in sorted(present):
        core = _WORD.findall(w)[0]
        out.add(str(rng.choice(_SWAPS[core])))
    return out


class _Rows:
    """Binary rows over the chosen features, from lists of their numbers."""

    def __init__(self, lists: list[list[int]], m: int):
        self.n, self.m = len(lists), m
        self.at = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.col = np.array([c for x in lists for c in x], np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, w[self.col], self.n) if self.n else np.zeros(0)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.at], self.m) if self.n else np.zeros(self.m)


def optimise(rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], m: int, fairness: float = 1.0, ridge: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic loss plus `fairness` times the mean squared change of the linear score over
    pairs (a row, the row with its identity terms swapped); fairness 0 leaves the plain classifier."""
    x, before, after = _Rows(rows, m), _Rows([a for a, _ in pairs], m), _Rows([b for _, b in pairs], m)
    w, bias = np.zeros(m), float(np.log(y.sum() / (len(y) - y.sum())))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        error = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -40, 40))) - y
        grad = x.back(error) / len(y) + ridge * w
        if before.n and fairness:
            gap = before.dot(w) - after.dot(w)
            grad += 2 * fairness * (before.back(gap) - after.back(gap)) / before.n
        g = np.append(grad, error.mean())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def fold(id_value: object) -> int:
    return zlib.crc32(str(id_value).encode()) % 4


def held_out(id_col: str) -> Column:
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4) == HELD_OUT_FOLD


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, features: int = FEATURES, fairness: float = 1.0, all_folds: bool = False
) -> Model:
    """Fit on labelled rows outside the held-out fold (of all folds, if told so), max_labelled at most: those whose
    ids have the smallest hashes. Whole texts count, and nothing but texts.

    Executors count features by label and number each row's features; the driver gets the `features` that part
    the labels best, and short lists of numbers. Rows whose id or label is null are not used; a document that is
    labelled twice counts once, as toxic if any label says so. Without labelled rows, or with one label only, the
    score is next to 0 (or 1, if all labels are 1).
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col("toxic").alias("__y")).where("__id is not null and __y is not null")
    known = known.groupBy("__id").agg((F.max("__y") > 0).cast("int").alias("__y"))
    known = known if all_folds else known.where(~held_out("__id"))
    some = known.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(some), "__id").select("__id", "__y", "__text")  # max_labelled short rows at most

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [" ".join(sorted(raw_words(t.as_py()))) for t in b.column("__text")]
            yield pa.RecordBatch.from_arrays([b.column("__id").cast(pa.string()), b.column("__y"), pa.array(texts, pa.string())], ["id", "y", "words"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for y, w in zip(b.column("y").to_pylist(), b.column("words").to_pylist(), strict=True):
                    seen[y].update(_features(w.split(" ")))
                names = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], ["feature", "ones", "zeros"])

    sample = materialize(rows.mapInArrow(words, "id string, y int, words string").repartition(16), "toxicity")
    n, n1 = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or n1 in (0, n):
        return Model(30.0 if n and n1 else -30.0)
    both = sample.mapInArrow(counts, "feature string, ones bigint, zeros bigint").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    rate = (F.col("ones") + F.col("zeros")) / n
    both = both.where(F.col("ones") + F.col("zeros") >= LEAST_ROWS).withColumn("worth", F.abs(F.col("ones") / n1 - F.col("zeros") / (n - n1)) / F.sqrt(rate * (1 - rate) + 1e-9))
    best = [r[0] for r in both.orderBy(F.desc("worth"), "feature").limit(features).select("feature").collect()]
    ids = {f: i for i, f in enumerate(dict.fromkeys([*best, *sorted(_SWAPS)]))}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(own: set[str]) -> list[int]:
            return sorted({ids[f] for f in _features(own) if f in ids})

        for b in batches:
            lists, swaps = [], []
            for key, w in zip(b.column("id").to_pylist(), b.column("words").to_pylist(), strict=True):
                own = set(w.split(" "))
                other = _swapped(own, np.random.default_rng([7, zlib.crc32(key.encode())]))
                lists.append(of(own))
                swaps.append(None if other is None else of(other))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(lists, kind), pa.array(swaps, kind)], ["id", "y", "own", "swapped"])

    got = sample.mapInArrow(numbered, "id string, y int, own array<int>, swapped array<int>").toArrow().sort_by("id")
    own, swapped = got.column("own").to_pylist(), got.column("swapped").to_pylist()
    pairs = [(a, b) for a, b in zip(own, swapped, strict=True) if b is not None]
    w, bias = optimise(own, got.column("y").to_numpy().astype(float), pairs, len(ids), fairness)
    return Model(bias, {f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 1e-6})


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row for each row of docs, scored where it is. A null or empty text scores as no words do;
    repeated rows stay; other columns are ignored; an empty table gives an empty one."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(model.scores(t.as_py() for t in b.column("__text"))), pa.float64())], ["id", "score"])

    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores under the threshold, columns and their names as they were. A null or empty
    text scores as no words do; equal rows go or stay alike; an empty table gives an empty one."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_col))
        return batch.filter(pa.array([s < threshold for s in model.scores(t.as_py() for t in texts)], pa.bool_()))

    return map_rows(docs, keep)
