"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three parts are compiled from a model file: the normaliser (a one-state transducer from characters to characters, and
what it puts before a text), the pieces as weighted arcs, and the byte fallback, an arc to the ids of a character's
bytes for each character that is no piece. They are composed with each input, word by word, and the answer is the
shortest path in the tropical semiring. For a BPE model a bigram acceptor weighs the pairs of pieces that merging
could not leave standing with infinity (see lattice.py); so the path is merging's own.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lattice import Cache, Lattice

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Words that each of two generations of a worker's cache holds, and characters of texts that are encoded at once.
REMEMBERED = 500_000
CHUNK_CHARS = 1 << 21


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
        yield key >> 3, data[at : at + size]
        at += size


class Transducer:
    """Encoder and decoder of one model file: BPE with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        pieces: list[tuple[str, float, int]] = []
        normal = {3: 1, 4: 1, 5: 1}
        with open(path, "rb") as f:
            data = f.read()
        kind_of_model = 1
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                normal |= dict(_fields(value))
        if kind_of_model != 2 or normal.get(2) or normal[4] or not normal[5]:
            raise ValueError("only BPE models with the identity normaliser and kept spaces are compiled")
        self.prefix = bool(normal[3])
        self.pieces = [p for p, _, _ in pieces]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
        # equal scores merge from the left, so they may share a rank
        order = {s: r for r, s in enumerate(sorted({pieces[i][1] for i in self.ids.values()}, reverse=True))}
        self.lattice = Lattice({p: order[pieces[i][1]] for p, i in self.ids.items()})
        self.outputs = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode()
            for p, _, k in pieces
        ]
        # a word: marks, then the rest, cut where no piece spans the border, so that each part has its own path
        self.words = re.compile(f"{MARK}*[^{MARK}\n\t]+|{MARK}+|[\n\t]") if not any(c in p for p in self.ids for c in "\n\t") else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that span words are not compiled")
        # the normaliser's arcs that change what they read, spaces to marks; and a mark before a text that is not empty
        self.normaliser, self.before = [(" ", MARK)], MARK if normal[3] else ""
        #: Output of each arc: a piece's id; of the fallback arcs, by character, the ids of its bytes.
        self.arc_ids = [array("i", [self.ids[p]]).tobytes() for p in self.lattice.pieces]
        self.fallback: dict[str, bytes] = {}
        self.known = Cache(self._learn, REMEMBERED)

    def _fallback(self, character: str) -> bytes:
        found = self.fallback.get(character)
        if found is None:
            found = self.fallback[character] = array("i", [self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")]).tobytes()
        return found

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The output of each word's shortest path."""
        out, lattice, arc_ids = {}, self.lattice, self.arc_ids
        for word, path in lattice.walk(words):
            number, span, end, parts = lattice.number, lattice.span, len(word), []
            while end:
                node = path[end]
                i = number[node]
                parts.append(arc_ids[i] if i >= 0 else self._fallback(word[end - 1]))
                end -= span[node]
            out[word] = b"".join(parts[::-1])
        return out

    def normalise(self, text: str) -> str:
        for read, put in self.normaliser:
            text = text.replace(read, put)
        return (self.before if text else "") + text

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """int32 ids of each text."""
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            waiting.append(self.words.findall(self.normalise(text or "")))
            size += len(text or "")
            if size > CHUNK_CHARS:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[str]]) -> Iterator[np.ndarray]:
        found = self.known.of(set().union(*waiting))
        for words in waiting:
            yield np.frombuffer(b"".join(map(found.__getitem__, words)), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The inverse transducer: bytes are gathered to UTF-8 (what is none becomes U+FFFD), marks to spaces, and the
        space before the text goes."""
        text = b"".join(map(self.outputs.__getitem__, ids))
        if self.prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def default_path() -> str:
    return public_tokenizers.path(MODEL)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) for each row, whole, where it is. Null and empty texts have no ids; repeated rows stay;
    other columns are ignored; an empty table gives an empty one."""
    path = path or default_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                got = transducer(path).encode([t.as_py() for t in b.column("__text")])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(got), pa.list_(pa.int32()))], ["id", "ids"])

    return rows.mapInArrow(encoded, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with a column `text`, decoded from the ids: null ids give null and no ids an empty text; repeated rows
    stay, all other columns too (one named text is replaced), and an empty table gives an empty one."""
    path = path or default_path()

    @F.pandas_udf(T.StringType())
    def decoded(ids):
        own = transducer(path)
        return ids.map(lambda x: None if x is None else own.decode(x))

    return encoded.withColumn("text", decoded(F.col(ids_col)))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_ids, ids_crc32, decoded_sha256, restored): digest of the ids (little-endian, 32 bits) and of the text
    decoded from them, and whether that is the text. Nulls, ties and repeats are as in encode_documents."""
    path = path or default_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    names = ["id", "n_ids", "ids_crc32", "decoded_sha256", "restored"]

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [t.as_py() for t in b.column("__text")]
                out = []
                for text, ids in zip(texts, own.encode(texts), strict=True):
                    back = own.decode(ids.tolist())
                    out.append((len(ids), zlib.crc32(ids.astype("<u4")), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (text or "")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names)

    return rows.mapInArrow(digested, f"id {rows.schema['id'].dataType.simpleString()}, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, restored boolean")
