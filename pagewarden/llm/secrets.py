"""Secret scan with linked parts of credentials.

Base spans are found by three patterns on whole texts. Other parts are weak alone: account names,
random-looking strings, endpoints. An interval join within each scope (a paragraph of one document)
pairs parts of complementary roles that stand at most `reach` code points apart: an identifier needs a
secret, a secret needs an identifier or an endpoint, an endpoint needs a secret. A weak part is
reported only if it has a partner; base spans are always reported, and serve as partners.

A scope lies in one document, so the join is array work on sorted positions in the task that scanned
the text: nothing is shuffled. Documents without any anchor of a pattern are told by byte search.

Each part is linked to the nearest of each complementary role on either side; the links are returned.

A null text counts as empty: no spans. A null doc_id stays null. Repeated rows are scanned each. Patterns
take time linear in a text, long runs included. An empty table gives no rows. Columns besides doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm._text import LOWER, bounded_batches, flat, texts, units

REACH = 400
KINDS = ("assign", "access", "hex", "account", "random", "endpoint")
BASE = 3
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
ROLE = (SECRET, IDENTIFIER, SECRET, IDENTIFIER, SECRET, ENDPOINT)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ACCOUNT = re.compile(r"""(?:user(?:name)?|login|account(?:_?id)?|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""", re.I | re.A)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Endpoints: addresses with a scheme, and hosts under well-known endings. Both patterns begin only where a
#: run of their characters does, and a host is judged label by label, so that long runs take linear time.
URL = re.compile(r"(?<![a-z0-9+])[a-z][a-z0-9+]{0,15}://[^\s\"'<>]{4,}", re.I | re.A)
HOST = re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9.-]{4,}(:\d{2,5}(?!\d))?", re.A)
ENDINGS = ("com", "net", "org", "io", "internal", "local")
BREAK = re.compile(r"\n[ \t]*\n")

_ANCHORS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", dtype=np.uint8))
_IS_TOKEN = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", dtype=np.uint8))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), code points; kinds as in KINDS."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def _random_looking(s: str) -> bool:
    return len(set(s)) >= 12 and any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)


def hosts(text: str) -> list[tuple[int, int]]:
    """Spans of host names, with their ports: in a run of host characters, up to the last label that is an ending."""
    out = []
    for m in HOST.finditer(text):
        whole = m[0] if m[1] is None else m[0][: -len(m[1])]
        begin = len(whole) - len(whole.lstrip(".-"))
        labels = whole[begin:].split(".")
        end, last = begin + len(labels[0]), 0
        for label in labels[1:]:
            if not label:
                break
            end += 1 + len(label)
            if label.lower() in ENDINGS:
                last = end
        if last:
            out.append((m.start() + begin, m.end() if last == len(whole) else m.start() + last))
    return out


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Account names, random-looking strings and endpoints; none that overlaps a base span, no host inside an address."""
    out = [(3, m.start(), m.end()) for m in ACCOUNT.finditer(text)]
    out += [(4, m.start(), m.end()) for m in RANDOM.finditer(text) if _random_looking(m[0])]
    urls = [(m.start(), m.end()) for m in URL.finditer(text)]
    out += [(5, s, e) for s, e in urls]
    out += [(5, s, e) for s, e in apart(hosts(text), urls)]
    kept = set(apart([(s, e) for _, s, e in out], [(s, e) for _, s, e in base]))
    return [x for x in out if x[1:] in kept]


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of `taken`."""
    if not taken or not spans:
        return spans
    taken = sorted(taken)
    reached = np.maximum.accumulate([e for _, e in taken])
    at = np.searchsorted([s for s, _ in taken], [e for _, e in spans]) - 1
    return [x for k, x in zip(at, spans) if k < 0 or reached[k] <= x[0]]


def partners(scope: np.ndarray, role: np.ndarray, start: np.ndarray, end: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): each part with the nearest of each complementary role, on either side, in its scope and at most `reach` away.

    An interval join on sorted positions: of those that begin before, the one that ends last, and of those
    that begin after, the first. So links are linear in the parts, however many share a scope.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for mine, other in ((IDENTIFIER, SECRET), (SECRET, IDENTIFIER), (SECRET, ENDPOINT), (ENDPOINT, SECRET)):
        a, b = np.flatnonzero(role == mine), np.flatnonzero(role == other)
        if not len(a) or not len(b):
            continue
        wide = np.int64(max(end.max(), 1) + 2 * reach + 2)
        left, right = scope * wide + start, scope * wide + end
        by = b[np.argsort(left[b], kind="stable")]
        at = np.searchsorted(left[by], left[a])
        ok = at < len(by)
        after = by[np.minimum(at, len(by) - 1)]
        ok &= left[after] - right[a] <= reach
        found.append((a[ok], after[ok]))
        last = np.maximum.accumulate(right[by] * len(by) + np.arange(len(by)))  # the farthest end among those that begin before
        at = np.searchsorted(left[by], left[a], "right") - 1
        before = by[last[np.maximum(at, 0)] % len(by)]
        ok = (at >= 0) & (left[a] - right[before] <= reach)
        found.append((a[ok], before[ok]))
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate([x for x, _ in found] or none), np.concatenate([x for _, x in found] or none)


def partnered(scope: np.ndarray, role: np.ndarray, start: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
    """Which parts have a part of a complementary role in their scope, at most `reach` away."""
    found = np.zeros(len(scope), dtype=bool)
    found[partners(scope, role, start, end, reach)[0]] = True
    return found


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def _anchored(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows that may hold a base span or two weak parts."""
    # An endpoint needs a secret: of weak parts only a random-looking string may be the one.
    low = LOWER[data].tobytes()
    raw = data.tobytes()
    marks = []

    def mark(where: bytes, what: bytes) -> None:
        at = where.find(what)
        while at >= 0:
            row = int(np.searchsorted(ends, at, "right")) - 1
            marks.append(row)
            at = where.find(what, int(ends[row + 1]))

    for a in _ANCHORS:
        mark(low, a)
    mark(raw, b"AKIA")
    mark(_IS_HEX[data].tobytes(), b"\x01" * 24)
    mark(_IS_TOKEN[data].tobytes(), b"\x01" * 32)
    return np.unique(np.array(marks, dtype=np.int64))


def scan(strings: pa.Array, reach: int = REACH) -> tuple[list[list], list[list], list[list]]:
    """Per row: base spans, the weak spans that have partners, and links as pairs of spans (the secret second)."""
    data, ends = flat(strings)
    base: list[list] = [[] for _ in range(len(strings))]
    linked: list[list] = [[] for _ in range(len(strings))]
    links: list[set] = [set() for _ in range(len(strings))]
    parts, scopes = [], 0
    for row in _anchored(data, ends).tolist() if len(data) else []:
        text = strings[row].as_py()
        base[row] = base_spans(text)
        weak = weak_spans(text, base[row])
        if weak or len(base[row]) > 1:
            breaks = [m.start() for m in BREAK.finditer(text)]
            for k, s, e in base[row] + weak:
                parts.append((scopes + int(np.searchsorted(breaks, s)), ROLE[k], s, e, row, k))
            scopes += len(breaks) + 1
    if parts:
        p = np.array(parts, dtype=np.int64)
        i, j = partners(p[:, 0], p[:, 1], p[:, 2], p[:, 3], reach)
        for _, _, s, e, row, k in p[np.unique(i)].tolist():
            if k >= BASE:
                linked[row].append((k, s, e))
        secret = p[i, 1] == SECRET
        for (_, _, s, e, row, k), (_, _, t, f, _, m) in zip(p[np.where(secret, j, i)].tolist(), p[np.where(secret, i, j)].tolist()):
            links[row].add(((k, s, e), (m, t, f)))
    return base, linked, [sorted(x, key=lambda x: (x[0][1:], x[1][1:], x)) for x in links]


SECRETS_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long, links string"


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document. links: identifier or endpoint, '+', secret, each as kind:start:end; comma-joined."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            base, linked, links = scan(texts(unit), reach)
            n = [[sum(k == kind for k, _, _ in b) for b in base] for kind in range(BASE)]
            digest = [hashlib.sha256(_said(b).encode()).hexdigest() for b in base]
            spans = [_said(b + w) for b, w in zip(base, linked)]
            said = [",".join(f"{_said([a])}+{_said([b])}" for a, b in x) for x in links]
            yield pa.RecordBatch.from_arrays([unit.column("doc_id"), *(pa.array(c, pa.int64()) for c in n), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array([len(w) for w in linked], pa.int64()), pa.array(said, pa.string())], [x.split()[0] for x in SECRETS_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SECRETS_SCHEMA)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
