"""Secrets by fixed patterns and by sliding-window Shannon entropy.

Assignments, access keys and long hexadecimal runs are the base spans. Beside them, maximal runs of each character class are candidate strings.
A window slides over a candidate; its Shannon entropy comes from counts that change by one character in and one out. A candidate with a window above
the class's threshold is a span, unless an allow-list pattern matches it or the text before it, or a span covers a part of it already.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import bounded_batches, query, table
from newsloom.llm.words import byte_class, column_bytes, row_chunks

KINDS = ("assign", "access", "hex")
ENTROPY = "entropy"
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
DIGITS, UPPER, LOWER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``chars``; a window of ``window`` of them counts from ``bits`` of entropy on, if it holds ``each`` characters of every set in ``needs``."""

    chars: bytes
    window: int
    bits: float
    needs: tuple[bytes, ...]
    each: int = 2


#: From the widest class to the narrowest; thresholds lie below what random characters of the class have, and above words with numbers.
CLASSES = (
    CharClass(DIGITS + UPPER + LOWER + b"+/_=-", 20, 3.9, (DIGITS, UPPER, LOWER)),
    CharClass(DIGITS + UPPER, 20, 3.6, (DIGITS, UPPER), 3),
    CharClass(DIGITS + LOWER, 20, 3.6, (DIGITS, LOWER), 3),
    CharClass(DIGITS + b"ABCDEFabcdef", 16, 3.0, (DIGITS, b"ABCDEFabcdef"), 3),
)
#: Candidates that are no secrets: placeholders, UUIDs, alphabets written out.
ALLOW = (
    rb"(?i)example|placeholder|changeme|dummy|sample|redacted|x{6}",
    rb"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    rb"(?i)0123456789|abcdefghij",
    rb"(?i)^(?:sha(?:1|224|256|384|512)|md5)[-_=]",
)
#: What stands directly before a candidate's first letter or digit where it is no secret: digests, embedded data, the rest of an address.
ALLOW_BEFORE = (rb"(?i)(?:sha(?:1|224|256|384|512)|md5)[:=-]$", rb"(?i);base64,$", rb"://[^\s\"'<>]*$")
BEFORE_BYTES = 256

_SCALE = 1 << 40


def _runs(data: np.ndarray, bounds: np.ndarray, chars: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a byte class of at least ``least`` bytes; runs end with their row."""
    n = len(data)
    inner = np.zeros(n + 2, bool)
    inner[1:-1] = chars[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    start = np.flatnonzero(inner[1:-1] & (~inner[:-2] | cut[:-1]))
    end = np.flatnonzero(inner[1:-1] & (~inner[2:] | cut[1:])) + 1
    long = end - start >= least
    return start[long], end[long]


def window_entropy(x: np.ndarray, window: int) -> np.ndarray:
    """Shannon entropy in bits of every ``window`` consecutive values, by the place of the first one.

    The sum of c*log2(c) over the counts changes by one step when a value enters and one when a value leaves. The counts before each step are
    differences of places in the sorted (value, place) list; steps are integers, so their running sums carry no rounding error.
    """
    n = len(x)
    if n < window:
        return np.zeros(0)
    c = np.arange(window + 2, dtype=float)
    table_ = np.zeros(window + 2, np.int64)
    table_[1:] = np.rint(c[1:] * np.log2(c[1:]) * _SCALE).astype(np.int64)
    place = np.arange(n, dtype=np.int64)
    base = x.astype(np.int64) * (n + 1)
    key = np.sort(base + place)
    at = np.searchsorted(key, base + place)
    before = at - np.searchsorted(key, base + np.maximum(place - window + 1, 0))
    entering = table_[before + 1] - table_[before]
    after = np.searchsorted(key, base + np.minimum(place + window, n)) - at
    leaving = table_[after] - table_[after - 1]
    total = np.cumsum(entering)
    total[window:] -= np.cumsum(leaving)[:-window]
    return np.log2(window) - total[window - 1:] / (_SCALE * window)


def hot_candidates(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: CharClass) -> np.ndarray:
    """Which candidates hold a window above the class's threshold with all that it needs."""
    length = end - start
    if not len(start):
        return np.zeros(0, bool)
    first = np.r_[0, np.cumsum(length)]
    x = data[np.repeat(start - first[:-1], length) + np.arange(first[-1])]
    ok = window_entropy(x, kind.window) >= kind.bits
    for chars in kind.needs:
        seen = np.r_[0, np.cumsum(byte_class(chars)[x])]
        ok &= seen[kind.window:] - seen[:-kind.window] >= kind.each
    # windows that reach into the next candidate don't count
    owner = np.repeat(np.arange(len(start)), length)
    ok &= owner[:len(ok)] == owner[kind.window - 1:]
    hot = np.zeros(len(start), bool)
    hot[owner[:len(ok)][ok]] = True
    return hot


class Scanner:
    """Spans of many texts at once, over one byte buffer."""

    def __init__(self, classes: Sequence[CharClass] = CLASSES, allow: Iterable[bytes] = ALLOW, allow_before: Iterable[bytes] = ALLOW_BEFORE):
        self.classes = tuple(classes)
        self.tables = [byte_class(c.chars) for c in self.classes]
        self.hex = byte_class(DIGITS + b"abcdef")
        self.assign_sign = byte_class(b":=")
        self.allow = [re.compile(p) for p in allow]
        self.allow_before = [re.compile(p) for p in allow_before]

    def suppressed(self, buf: bytes, row: int, s: int, e: int) -> bool:
        at = s + len(buf[s:e]) - len(buf[s:e].lstrip(b"+/_=-"))
        value, left = buf[s:e], buf[max(row, at - BEFORE_BYTES):at]
        return any(p.search(value) for p in self.allow) or any(p.search(left) for p in self.allow_before)

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
        """Row number -> (start, end, kind) in code points, for rows that have any; row ``i`` is ``data[bounds[i]:bounds[i + 1]]``."""
        buf = data.tobytes()
        found: dict[int, list[tuple[int, int, str]]] = {}

        def row_of(at):
            return np.searchsorted(bounds, at, "right") - 1

        for i in np.unique(row_of(np.flatnonzero(self.assign_sign[data]))).tolist():
            for m in ASSIGN.finditer(buf, int(bounds[i]), int(bounds[i + 1])):
                if m.end(2) - m.start(2) >= MIN_ASSIGN:
                    found.setdefault(i, []).append((m.start(), m.end(), "assign"))
        at = buf.find(b"AKIA")
        while at >= 0:
            i = int(row_of(at))
            for m in ACCESS.finditer(buf, at, int(bounds[i + 1])):
                if m.end() - m.start() >= MIN_ACCESS:
                    found.setdefault(i, []).append((m.start(), m.end(), "access"))
            at = buf.find(b"AKIA", int(bounds[i + 1]))
        s, e = _runs(data, bounds, self.hex, MIN_HEX)
        for i, a, b in zip(row_of(s).tolist(), s.tolist(), e.tolist()):
            found.setdefault(i, []).append((a, b, "hex"))
        # marked[p]: bytes before p that lie in a span, so that overlaps are told without a search
        covered = np.zeros(len(data) + 1, np.int32)
        for spans in found.values():
            for a, b, _ in spans:
                covered[a] += 1
                covered[b] -= 1
        covered = np.cumsum(covered) > 0
        for kind, chars in zip(self.classes, self.tables):
            s, e = _runs(data, bounds, chars, kind.window)
            hot = hot_candidates(data, s, e, kind)
            s, e = s[hot], e[hot]
            for i, a, b in zip(row_of(s).tolist(), s.tolist(), e.tolist()):
                if not covered[a:b].any() and not self.suppressed(buf, int(bounds[i]), a, b):
                    found.setdefault(i, []).append((a, b, ENTROPY))
                    covered[a:b] = True
        order = {k: n for n, k in enumerate((*KINDS, ENTROPY))}
        out = {}
        for i, spans in found.items():
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            chars = np.r_[0, np.cumsum((data[lo:hi] & 0xC0) != 0x80)]
            spans.sort(key=lambda x: (x[0], order[x[2]]))
            out[i] = [(int(chars[a - lo]), int(chars[b - lo]), k) for a, b, k in spans]
        return out


def scan(docs: DataFrame, classes: Sequence[CharClass] = CLASSES, allow: Iterable[bytes] = ALLOW, allow_before: Iterable[bytes] = ALLOW_BEFORE) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs(doc_id, text)``; spans is an array of (s, e, kind), code points, end exclusive, by start and kind.

    Whole texts, whatever their length. A null or empty text has no spans. Rows that repeat, also by doc_id, and null doc_ids are rows like others;
    spans of different kinds may start together (base kinds first in the order of KINDS); other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    schema = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string())]))
    classes, allow, allow_before = tuple(classes), tuple(allow), tuple(allow_before)

    def run(batches):
        scanner = Scanner(classes, allow, allow_before)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for rows in row_chunks(offsets, 1 << 20):
                lo, hi = int(offsets[rows.start]), int(offsets[rows.stop])
                found = scanner.spans(data[lo:hi], offsets[rows.start:rows.stop + 1] - lo)
                spans = [[dict(zip(("s", "e", "kind"), x)) for x in found.get(i, ())] for i in range(rows.stop - rows.start)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(rows.start, rows.stop - rows.start), pa.array(spans, schema)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<s:int,e:int,kind:string>>")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def _is_base(x):
    return x.kind != ENTROPY


def _is_kind(kind: str):
    return lambda x: x.kind == kind


@query("op12_entropy_secret_scan")
def op12(spark, sf_dir):
    out = scan(table(spark, sf_dir, "documents"))
    count = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *count, F.sha2(_joined(F.filter("spans", _is_base)).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
