"""Token counts without encoding: distinct pre-tokens in a trie, forward scores once for each shared prefix.

An arc of a piece weighs one, so the forward score of a node is the number of tokens of its prefix, and a terminal's
score is its pre-token's count. Which arcs may follow each other is what lattice.py tells for byte-pair vocabularies,
whose pieces have ranks and no probabilities."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .lattice import Cache, Lattice

#: Pre-tokens whose counts each of two generations of a worker's cache holds, and characters that are counted at once.
REMEMBERED = 300_000
CHUNK_CHARS = 1 << 20


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def _byte_of() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts tokens of a byte-level BPE vocabulary as the tokenizers library would, its added tokens included."""

    def __init__(self, path: str):
        t = tokens.tokenizer(path)
        added = {a.content for a in t.get_added_tokens_decoder().values()}
        of = _byte_of()
        self.lattice = Lattice({bytes(of[c] for c in word): rank for word, rank in t.get_vocab(with_added_tokens=False).items() if word not in added})
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.known = Cache(self._learn, REMEMBERED)

    def _learn(self, words: list[str]) -> dict[str, int]:
        """The terminal's count of each word."""
        lattice, by_bytes = self.lattice, {w.encode("utf-8", "surrogatepass"): w for w in words}
        return {by_bytes[word]: lattice.score[path[-1]] for word, path in lattice.walk(by_bytes)}

    def count(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """(tokens, pre-tokens) of each text; 0 for null and empty ones."""
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for text in texts:
            parts, extra = [text or ""], 0
            if text and self.added is not None and self.added.search(text):
                parts, extra = self.added.split(text), len(self.added.findall(text))
            waiting.append((extra, [w for p in parts for w in self.split.findall(p)]))
            size += len(text or "")
            if size > CHUNK_CHARS:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int]]:
        found = self.known.of(set().union(*[words for _, words in waiting]))
        for extra, words in waiting:
            yield sum(map(found.__getitem__, words)) + extra, len(words) + extra


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, n_pretokens) for each row, counted where it is, whole. Null and empty texts have none; repeated
    rows stay; other columns are ignored; an empty table gives an empty one."""
    path = path or tokens.default_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                got = list(counter.count([t.as_py() for t in b.column("__text")]))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([n for n, _ in got], pa.int64()), pa.array([w for _, w in got], pa.int64())], ["id", "n_tokens", "n_pretokens"])

    return rows.mapInArrow(counted, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, n_pretokens bigint")
