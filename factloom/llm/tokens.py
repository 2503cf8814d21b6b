"""Token ids by the tokenizers library, in bounded memory."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2
#: Bytes of text that go to the library at once; an encoding takes some 40 times its text.
CHUNK_BYTES = 1 << 19
#: A cut after a letter and before a space and a letter never divides a pre-token of byte-level BPE.
_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already take the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_path() -> str:
    return public_tokenizers.path(BYTE_BPE)


def safe_parts(text: str, limit: int = CHUNK_BYTES) -> list[str]:
    """text in parts of about limit characters that encode as they do in the whole."""
    parts, at = [], 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if not cut:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


def encode(texts: Iterable[str | None], path: str | None = None) -> Iterator[np.ndarray]:
    """uint32 ids of each text, in order, without special tokens added; null and empty texts have none."""
    t = tokenizer(path or default_path())
    waiting: list[str] = []
    counts: list[int] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        got = iter(t.encode_batch_fast(waiting, add_special_tokens=False))
        for n in counts:
            own = [np.array(next(got).ids, np.uint32) for _ in range(n)]
            yield own[0] if n == 1 else np.concatenate(own) if own else np.zeros(0, np.uint32)

    for text in texts:
        parts = safe_parts(text) if text else []
        waiting += parts
        counts.append(len(parts))
        size += len(text or "")
        if size >= CHUNK_BYTES or len(counts) >= 4096:
            yield from flush()
            waiting, counts, size = [], [], 0
    yield from flush()


#: Byte classes of the byte-level pattern: letter, digit, space, other white space, anything else, not decided here.
LETTER, DIGIT, SPACE, BLANK, OTHER, ODD = range(6)
#: Distinct pre-tokens that each of two generations of a worker's cache holds; what falls out is encoded anew.
REMEMBERED = 400_000
#: Bytes of text that are cut into pre-tokens at once.
COLUMN_BYTES = 1 << 21


def _classes() -> np.ndarray:
    """Of ASCII, and of U+00C0 to U+027F (two bytes led by C3 to C9), which are letters but for two signs. A text
    with any other character goes to the library as it is."""
    of = np.full(256, ODD, np.uint8)
    of[:0x80] = OTHER
    of[0x1C:0x20] = ODD
    for a, b in (("A", "Z"), ("a", "z")):
        of[ord(a) : ord(b) + 1] = LETTER
    of[ord("0") : ord("9") + 1] = DIGIT
    of[0x20], of[9:14] = SPACE, BLANK
    of[0x80:0xC0], of[0xC3:0xCA] = LETTER, LETTER
    return of


CLASSES = _classes()
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")


def pretoken_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Offsets at which the byte-level pattern's matches begin in the texts that `rows` (their offsets, and the end)
    part data into; a text that must go to the library, with odd characters or "<|", is one match."""
    n = len(data)
    kind = CLASSES[data]
    opens = np.zeros(n + 1, bool)
    opens[rows] = True
    opens = opens[:n]
    blank = (kind == SPACE) | (kind == BLANK)
    changed = np.ones(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    # a run of one class begins a match; so does the last blank before another character, which a space goes with
    start = opens | (changed & ~after_blank)
    enters = np.flatnonzero(~blank & after_blank & ~opens)
    start[enters - 1] = True
    start[enters[kind[enters - 1] == BLANK]] = True
    marks = np.flatnonzero((data == 0x27) & start)
    marks = marks[marks + 1 < n]
    marks = marks[~opens[marks + 1]]
    short = marks[np.isin(data[marks + 1], np.frombuffer(_ONE, np.uint8))]
    start[short + 1] = False
    start[short[short + 2 < n] + 2] = True
    pairs = marks[marks + 2 < n]
    pairs = pairs[~opens[pairs + 2]]
    long = pairs[np.logical_or.reduce([(data[pairs + 1] == a) & (data[pairs + 2] == b) for a, b in _TWO])]
    start[long + 1] = False
    start[long[long + 3 < n] + 3] = True
    odd = kind == ODD
    odd[:-1] |= ((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))) | ((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    if odd.any():
        for r in np.unique(np.searchsorted(rows, np.flatnonzero(odd), side="right") - 1).tolist():
            start[rows[r] + 1 : rows[r + 1]] = False
    return np.flatnonzero(start)


@functools.lru_cache(maxsize=4)
def _plain_byte_level(path: str) -> bool:
    """Whether the file's pre-tokenizer is the byte-level pattern alone, so that matches encode independently."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre = t.get("pre_tokenizer") or {}
    specials = {a["content"] for a in t.get("added_tokens", [])}
    return not t.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and all(s.startswith("<|") for s in specials)


def _listed(column: pa.Array) -> list[bytes]:
    """A binary column without nulls as to_pylist gives it, which takes four times as long."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    body = column.buffers()[2].to_pybytes()
    return [body[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class ColumnEncoder:
    """Ids of Arrow text columns: the library encodes each distinct pre-token once, and rows are put together."""

    def __init__(self, path: str | None = None):
        self.path = path or default_path()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        t = tokenizer(self.path)
        self.model = t.model
        self.opens = np.array([(t.id_to_token(i) or "").startswith("Ġ") for i in range(t.get_vocab_size())])

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct pre-tokens as bytes; those that two generations of the cache do not know are encoded."""
        new, old = self.new, self.old
        found = list(map(new.get, words))
        missing = []
        for i in [i for i, f in enumerate(found) if f is None]:
            if (ids := old.get(words[i])) is None:
                missing.append(i)
            else:
                found[i] = new[words[i]] = ids
        for at in range(0, len(missing), 8192):
            own = missing[at : at + 8192]
            for i, ids in zip(own, self._encoded([words[i] for i in own]), strict=True):
                found[i] = ids
                if len(words[i]) <= 32:
                    new[words[i]] = ids
            if len(new) > REMEMBERED:
                self.old, self.new = new, {}
                new = self.new
        return found

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens. Those of a space and ASCII letters go to the library's model, in which that space is a letter.
        Those of a space and other letters go to the library as one text, since it parts them before each space, and only
        their first tokens begin with one; the rest one by one."""
        tokenize = self.model.tokenize
        out = [array("I", [x.id for x in tokenize("Ġ" + w[1:].decode())]).tobytes() if w[:1] == b" " and w[1:].isalpha() else b"" for w in words]
        texts = {i: words[i].decode("utf-8", "surrogatepass") for i, ids in enumerate(out) if not ids}
        plain = [i for i, x in texts.items() if x[0] == " " and x[1:].isalpha()]
        if plain:
            joined = np.concatenate(list(encode(("".join(texts[i] for i in plain[k : k + 1024]) for k in range(0, len(plain), 1024)), self.path)))
            cuts = np.flatnonzero(self.opens[joined])
            if len(cuts) == len(plain):
                body, edges = memoryview(joined.astype(np.uint32)).cast("B"), [*(4 * cuts).tolist(), 4 * len(joined)]
                for i, lo, hi in zip(plain, edges[:-1], edges[1:], strict=True):
                    out[i] = bytes(body[lo:hi])
            else:
                plain = []
        taken = set(plain)
        rest = [i for i in texts if i not in taken]
        for i, ids in zip(rest, encode((texts[i] for i in rest), self.path), strict=True):
            out[i] = ids.tobytes()
        return out

    def _part(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = pretoken_starts(data, rows)
        edges = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        ids = self._ids_of(_listed(words.dictionary))
        which = words.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat, first = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
        each = size[which]
        ends = np.concatenate(([0], np.cumsum(each)))
        out = flat[np.repeat(first[which] - ends[:-1], each) + np.arange(ends[-1])]
        return out, ends[np.searchsorted(starts, rows)]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """uint32 ids of each row, as encode() gives them."""
        if not _plain_byte_level(self.path):
            yield from encode((t.as_py() for t in column), self.path)
            return
        column = column.cast(pa.large_binary()).fill_null(b"")
        if not len(column):
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(column):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + COLUMN_BYTES, side="right")) - 1)
            lo, hi = int(offsets[row]), int(offsets[stop])
            if hi - lo > 4 * COLUMN_BYTES:  # one very long text
                yield from encode([data[lo:hi].tobytes().decode()], self.path)
            else:
                ids, ends = self._part(np.ascontiguousarray(data[lo:hi]), offsets[row : stop + 1] - lo) if hi > lo else (np.zeros(0, np.uint32), np.zeros(stop - row + 1, int))
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    yield ids[a:b]
            row = stop


@functools.lru_cache(maxsize=2)
def column_encoder(path: str) -> ColumnEncoder:
    """The encoder of this worker, whose cache serves one task after the other."""
    return ColumnEncoder(path)
