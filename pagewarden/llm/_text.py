"""Array helpers shared by the text operators: Arrow string columns as flat byte arrays.

Everything works on whole texts. A unit is a bounded piece of a partition (by bytes of text, or one
row if that alone is larger), so a worker's memory follows the unit and not the partition.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNIT_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on lower-cased text: digits, a-z and all non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Word bytes of `[^\x20\x09-\x0D]+`.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[9, 10, 11, 12, 13, 32]] = False

ODD = np.uint64(0x9E3779B97F4A7C15)


def bounded_batches(spark, rows: int = 1000) -> None:
    """Lower the session's Arrow batch size, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def units(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = UNIT_BYTES) -> Iterator[pa.RecordBatch]:
    """Regroup record batches into units of about `limit` bytes of text."""
    pending: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + limit - size, "right")) - 1
            last = min(max(last, first + (0 if pending else 1)), batch.num_rows)
            if last > first:
                pending.append(batch.slice(first, last - first))
                size += int(ends[last] - ends[first])
            if last < batch.num_rows or size >= limit:
                yield pa.concat_batches(pending)
                pending, size = [], 0
            first = last
    if pending:
        yield pa.concat_batches(pending)


def freed() -> None:
    """Give memory back to the system: a worker that waits for its next task otherwise keeps what the last one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column with '' for null."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")


def offsets_of(strings: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type) else np.int32
    if not len(strings):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(strings.buffers()[1], dtype=kind)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 bytes of all rows in a row, and where each begins."""
    ends = offsets_of(strings)
    data = strings.buffers()[2] if len(strings) else None
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(ends), dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def words(data: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and per row the number of words before it.

    kind: which byte values belong to words. No word crosses from one row into the next.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(ends), dtype=np.int64)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = kind[data]
    start = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = inside[1:-1][cuts]
    end[cuts - 1] = inside[1:-1][cuts - 1]
    start = np.flatnonzero(start)
    return start, np.flatnonzero(end) + 1, np.searchsorted(start, ends)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of a word kept by its last lane.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Longer spans are hashed and compared one by one.
LONG = 4096


def lanes_of(data: np.ndarray) -> np.ndarray:
    """Per place, the eight bytes that begin there, as one integer; zeros follow the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes, equal hash, wherever the span stands.

    Eight bytes at a time, mixed by a bijection: spans of one size up to 8 never share a hash. Longer ones
    may, by chance; who must not take two words for one compares bytes (`same_spans`).
    """
    size = end - start
    h = mixed(size.astype(np.uint64) * ODD + np.uint64(1))
    if not len(start):
        return h
    lanes = lanes_of(data)
    h = mixed(h ^ (lanes[start] & _MASKS[np.minimum(size, 8)]))
    more = np.flatnonzero((size > 8) & (size <= LONG))
    more = more[np.argsort(-size[more], kind="stable")]
    at, left = start[more] + 8, size[more] - 8
    while len(more):
        h[more] = mixed(h[more] ^ (lanes[at] & _MASKS[np.minimum(left, 8)]))
        n = int(np.searchsorted(-left, -8, "left"))  # those of more than eight bytes still
        more, at, left = more[:n], at[:n] + 8, left[:n] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, others: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Per pair of spans, one of `data` and one of `others`, whether their bytes are equal."""
    size = end - start
    same = size == stop - begin
    a, b = lanes_of(data), lanes_of(others)
    more = np.flatnonzero(same & (size > 0) & (size <= LONG))
    more = more[np.argsort(-size[more], kind="stable")]
    at, to, left = start[more], begin[more], size[more].copy()
    while len(more):
        same[more] &= ((a[at] ^ b[to]) & _MASKS[np.minimum(left, 8)]) == 0
        n = int(np.searchsorted(-left, -8, "left"))
        more, at, to, left = more[:n], at[:n] + 8, to[:n] + 8, left[:n] - 8
    for i in np.flatnonzero(same & (size > LONG)).tolist():
        same[i] = data[start[i] : end[i]].tobytes() == others[begin[i] : stop[i]].tobytes()
    return same


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, for every start that has k words in the array."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total = total * ODD + hashes[j : j + n]
    return mixed(total)

