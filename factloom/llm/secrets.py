"""Secret scans: fixed patterns, and zstandard novelty of strings that stand in a sensitive context."""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: The kinds in their order, their patterns, and the least length that counts.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: Words that make what follows within REACH characters sensitive.
SENSITIVE = re.compile(
    r"passphrase|password|passwd|credential|secret|token|bearer|authorization|api[ _-]?key|private[ _-]?key|access[ _-]?key|signing[ _-]?key|encryption[ _-]?key|client[ _-]?id|session[ _-]?id|webhook",
    re.IGNORECASE | re.ASCII,
)
REACH = 96
#: What may stand between the lines or parts of one secret: line ends, quotes and other marks, but no words.
BETWEEN = re.compile(r"(?:\\[nrt]|[^\w\\]){0,96}")
#: Bounds of a private key in PEM form; all between them is one secret.
BOUND = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
#: What is left of an identifier after its sensitive word, with a name up to '='; and the value that follows in the same run.
NAME = re.compile(r"[A-Za-z0-9_]*(?:[A-Za-z_.-]*=)?")
VALUE = re.compile(r"[A-Za-z0-9+/_=.-]*")
#: An '=' inside a run, not the padding at its end.
EQUALS = re.compile(r"=+(?=[^=])")
#: Characters of text on either side that prime the compressor.
AROUND = 512
#: Characters that two strings must share in a row to count as related.
SHARED = 6
#: Part that a character must add of the bytes that its alphabet allows.
NOVEL = 0.8
#: Kinds of characters, and how many a random string draws from; hexadecimal strings draw from fewer letters.
CLASSES = ((re.compile("[0-9]"), 10), (re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26))
HEXADECIMAL = re.compile("[0-9a-f]+|[0-9A-F]+")

#: Text that secrets are measured against: what identifiers and code are usually made of.
DICTIONARY = (
    "public static final String private protected class import package return function const let var def self None True False null undefined "
    "if else elif for while try except finally raise throw new delete async await lambda yield from module require export default interface struct enum "
    "config configuration settings environment production development staging localhost example username user_name user_id client_id session_id request_id "
    "application/json text/html content-type accept charset utf-8 https://www. http://api. .com/ .org/ .net/ index.html readme license version 1.0.0 2.0.0 "
    "getElementById addEventListener toString hashCode equals length append insert update select where group order limit offset timestamp created_at updated_at "
    "placeholder changeme your_api_key_here your-secret-key example_token dummy_password insert_token_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
)


class Span(NamedTuple):
    start: int
    rank: int
    end: int


@functools.lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(DICTIONARY.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=6, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def marginal_bytes(before: str, candidate: str, after: str) -> int:
    """Compressed bytes that the candidate adds to the code around it, under the primed dictionary."""
    z = _compressor()
    return len(z.compress((before + candidate + after).encode("utf-8", "surrogatepass"))) - len(z.compress((before + after).encode("utf-8", "surrogatepass")))


def least_bytes(value: str) -> float:
    """Compressed bytes that a novel value must add: NOVEL of its alphabet's entropy where its digits and letters are
    as mixed as in even draws from that alphabet (each kind half its share or more), NOVEL of a byte a character
    elsewhere, as in words with a number."""
    letters = 6 if HEXADECIMAL.fullmatch(value) else 26
    kinds = [(len(found), min(size, letters)) for pattern, size in CLASSES if (found := pattern.findall(value))]
    symbols = sum(size for _, size in kinds) + len({c for c in value if not c.isalnum()})
    mixed = all(n >= int(0.5 * len(value) * size / symbols) for n, size in kinds)
    return NOVEL * len(value) * (math.log2(symbols) / 8 if mixed else 1)


def base_spans(text: str) -> list[Span]:
    """What the patterns match, by start and then by kind; code points, end exclusive."""
    found = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class _Taken:
    """Spans by start, for finding those that touch a range without going through all."""

    def __init__(self, spans: list[Span]) -> None:
        self.spans = sorted(spans)
        self.starts = [s.start for s in self.spans]
        self.ends = list(itertools.accumulate((s.end for s in self.spans), max))

    def touching(self, start: int, end: int) -> list[Span]:
        last = bisect.bisect_left(self.starts, end)
        return [s for s in self.spans[bisect.bisect_right(self.ends, start, hi=last) : last] if s.end > start]


def _outside(spans: list[Span], start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a range that spans, by start, leave."""
    parts = []
    for s in spans:
        if s.start > start:
            parts.append((start, s.start))
        start = max(start, s.end)
    return [*parts, (start, end)] if start < end else parts


def _context(text: str, taken: _Taken, start: int, end: int, value: str) -> str:
    """A stretch of the text around a value, without base spans and without other candidates that share nothing with it:
    keys that stand together must not teach the compressor each other's alphabet, while a string that is written again and
    again, or with another number, still tells what it is."""
    own = {value[i : i + SHARED] for i in range(len(value) - SHARED + 1)}

    def left(run: re.Match[str]) -> str:
        found = run[0]
        other = any(c.isdigit() for c in found) and any(c.isalpha() for c in found)
        return "" if other and not any(found[i : i + SHARED] in own for i in range(len(found) - SHARED + 1)) else found

    base = [s for s in taken.touching(start, end) if KINDS[s.rank] != "novel"]
    return "".join(CANDIDATE.sub(left, text[a:b]) for a, b in _outside(base, start, end))


def _novel(text: str, taken: _Taken, start: int, end: int) -> list[Span]:
    """The run from start to end without its outer marks, if it is a candidate that does not compress. Of a run with
    an access key or hexadecimal span inside, what that leaves: all if the run has no marks, novel parts otherwise."""
    value = text[start:end].strip(".=-/_")
    start += text[start:end].find(value)
    end = start + len(value)
    if len(value) < 16 or value.isalpha() or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return []
    touching = taken.touching(start, end)
    if any(KINDS[s.rank] in ("assign", "novel") for s in touching):
        return []
    rest = _outside(touching, start, end)
    if touching and not value.isalnum():
        return [s for a, b in rest for s in _novel(text, taken, a, b)]
    before, after = _context(text, taken, max(0, start - AROUND), start, value), _context(text, taken, end, min(len(text), end + AROUND), value)
    if rest and marginal_bytes(before, value, after) >= least_bytes(value):
        return [Span(a, 3, b) for a, b in rest]
    return []


def _parts(text: str, taken: _Taken, start: int, end: int) -> list[Span]:
    """The whole run, if it is novel; otherwise what is novel between its '='."""
    if whole := _novel(text, taken, start, end):
        return whole
    inner = [m.end() for m in EQUALS.finditer(text, start, end)]
    return [s for a, b in zip([start, *inner], [*inner, end], strict=True) for s in _novel(text, taken, a, b)] if inner else []


def key_spans(text: str, base: list[Span]) -> list[Span]:
    """Bodies of PEM private keys, from BEGIN to END, outside the base spans."""
    found: list[Span] = []
    taken, begin = _Taken(base), None
    for bound in BOUND.finditer(text):
        if bound[1] == "BEGIN":
            begin = bound.end()
        elif begin is not None:
            start = BETWEEN.match(text, begin, bound.start()).end()
            body = text[start : bound.start()].rstrip()
            value = "".join(CANDIDATE.findall(body))
            if value and marginal_bytes("", value, "") >= least_bytes(value):
                found += [Span(a, 3, b) for a, b in _outside(taken.touching(start, start + len(body)), start, start + len(body))]
            begin = None
    return found


def novel_spans(text: str, base: list[Span]) -> list[Span]:
    """Strings of letters and digits within REACH of a sensitive word that no base span touches and that the
    dictionary and the text around, without other keys, do not compress, each to its end in the text; and bodies of private keys. What
    follows the word's identifier in the same run, as in SECRET_KEY=value, is such a string, too. A secret brings
    the string that adjoins it, as the next line of a key does, within reach."""
    found = key_spans(text, base)
    taken = _Taken(base + found)
    done = 0
    for word in SENSITIVE.finditer(text):
        reach, start, end = word.end() + REACH, word.end(), word.end()
        if word.end() >= done:
            start, end = NAME.match(text, word.end()).end(), VALUE.match(text, word.end()).end()
        while True:
            if start < end:
                own = _parts(text, taken, start, end)
                found += own
                if own or taken.touching(start, end):
                    reach = max(reach, BETWEEN.match(text, end).end())
            done = max(done, end)
            if not (m := CANDIDATE.search(text, done, min(len(text), reach + 16))):
                break
            start, end = m.start(), VALUE.match(text, m.start()).end()
    return sorted(found)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of a whole text."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.rank]}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for s in spans:
        if s.end <= at:
            continue
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = s.end
    return "".join([*out, text[at:]])


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(t.as_py()) for t in batch.column("__text")]
        counts = [[sum(s.rank == k for s in base) for base, _ in rows] for k in range(3)]
        clean = [t.as_py() if not every else redact(t.as_py(), every) for t, (_, every) in zip(batch.column("__text"), rows, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([joined(b) for b, _ in rows], pa.string()), pa.array([joined(e) for _, e in rows], pa.string()), pa.array(clean, pa.string())],
            ["id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "redacted"],
        )


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_assign, n_access, n_hex, base_spans, spans, redacted (the text with
    every span replaced; null stays null).

    Rows are scanned where they are, whole, with no shuffle. Null and empty texts have no spans; repeated rows
    stay; other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan_batches, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string, redacted string")


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every secret in the text replaced, all columns and rows kept, whatever their names; length_col, if
    there, is renewed, and null where the text is null. Null and empty texts stay; repeated rows stay, changed alike; an
    empty table gives an empty one."""
    renewed = docs.columns.index(length_col) if length_col in docs.columns else None

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        new = pa.array([t and redact(t, scan(t)[1]) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
        batch = batch.set_column(at, batch.schema.field(at), new)
        if renewed is None:
            return batch
        kind = batch.schema.field(renewed)
        return batch.set_column(renewed, kind, pc.utf8_length(new.cast(pa.string())).cast(kind.type))

    return map_rows(docs, clean)
