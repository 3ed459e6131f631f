"""Packing of token ids into windows of bounded length by Karmarkar-Karp multiway differencing.

A document's ids (with an end id) fill whole windows first; what remains is cut into pieces of at most
`piece` ids. Pieces are packed in groups, each within one task: every piece begins as a partial
partition of k windows that holds it alone; the two partial partitions of the largest difference are
merged, the fullest windows of one meeting the emptiest of the other, until one is left with near-equal
windows. k begins at the least count that could hold the group and rises while a window is over
capacity. Nothing is shuffled, and memory follows the group, not the table.

A null or empty text has only its end id. Repeated rows are packed each on its own. An empty table
gives no rows. A null doc_id stays null. A very long text is a unit of its own: its worker holds about
thirty times its bytes. Columns besides doc_id and text are ignored, whatever their names. Sequence ids
are unique and not dense; they follow the order of rows within partitions, so an input that is itself
shuffled should be written first, for a lost task to number its rows as before.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm._text import bounded_batches, texts, units
from pagewarden.llm._tokens import UNIT_BYTES, default_path, encoder
from pagewarden.llm.token_files import with_last

END_ID = 0
CAPACITY = 1024
PACKED_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PACKED_SCHEMA.split(", ")]


def differenced(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window of each size, of k windows with near-equal sums."""
    n = len(sizes)
    if k <= 1:
        return np.zeros(n, dtype=np.int64)
    left, right = np.zeros(n * k + n + 1, dtype=np.int64), np.zeros(n * k + n + 1, dtype=np.int64)  # sets, as pairs of sets; 1..n hold one item, 0 none
    made = n
    heap, parts = [], {}
    for i in range(n):
        sums, sets = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        sums[0], sets[0] = sizes[i], i + 1
        parts[i] = (sums, sets)
        heap.append((-int(sizes[i]), i))
    heapq.heapify(heap)
    name = n
    while len(heap) > 1:
        (a, x), (b, y) = parts.pop(heapq.heappop(heap)[1]), parts.pop(heapq.heappop(heap)[1])
        sums, x, y = a + b[::-1], x, y[::-1]
        sets = x + y  # where one of them is empty
        both = np.flatnonzero((x > 0) & (y > 0))
        if len(both):
            new = np.arange(made + 1, made + 1 + len(both))
            left[new], right[new] = x[both], y[both]
            sets[both] = new
            made += len(both)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        parts[name] = (sums, sets[order])
        heapq.heappush(heap, (-int(sums[0]), name))
        name += 1
    window = np.full(made + 1, -1, dtype=np.int64)
    sets = parts[heap[0][1]][1]
    window[sets] = np.arange(k)
    for s in range(made, n, -1):
        window[left[s]] = window[right[s]] = window[s]
    return window[1 : n + 1]


def packed(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each size, windows): the least count tried of which no window is over capacity."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        window = differenced(sizes, k)
        over = int(np.bincount(window, weights=sizes, minlength=k).max()) - capacity
        if over <= 0:
            return window, k
        # The fullest window is this much above the mean; with as much room below capacity, k windows may do.
        spread = over + capacity - total / k
        k = max(k + 1, -(-total // max(1, int(capacity - spread))))


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, piece: int = 256, group: int = 2048) -> DataFrame:
    """Pieces of all documents with their sequences and places.

    piece: the largest remainder that is packed uncut, at most capacity. group: pieces packed at once.
    """
    if not 0 < piece <= capacity:
        raise ValueError("piece must be from 1 to capacity")
    vocabulary = vocabulary or default_path()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[np.ndarray] = []  # rows of doc_id, start, length, crc, doc_tokens, and whether there is an id
        count = 0

        def out(rows: np.ndarray, ids: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
            doc_id, *rest, there = rows.T
            return pa.RecordBatch.from_arrays([pa.array(doc_id, mask=there == 0), *(pa.array(c) for c in (*rest, ids, offset))], NAMES)

        def placed() -> pa.RecordBatch:
            nonlocal sequence, waiting, count
            rows = np.concatenate(waiting)
            window, k = packed(rows[:, 2], capacity)
            order = np.argsort(window, kind="stable")
            rows, window = rows[order], window[order]
            before = np.cumsum(rows[:, 2]) - rows[:, 2]
            first = np.searchsorted(window, window)
            waiting, count = [], 0
            sequence += k
            return out(rows, sequence - k + window, before - before[first])

        for unit in units(batches, limit=UNIT_BYTES):
            ids, ends = with_last(*encoder(vocabulary).encode(texts(unit)), end_id)
            ids_of, total = unit.column("doc_id"), np.diff(ends)
            doc_id, there = np.asarray(pc.fill_null(ids_of, 0)), np.asarray(pc.is_valid(ids_of)).astype(np.int64)
            rest = total % capacity
            n = total // capacity + -(-rest // piece)
            doc = np.repeat(np.arange(len(total)), n)
            i = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)  # the piece within its document
            full = total[doc] // capacity
            start = np.where(i < full, i * capacity, full * capacity + (i - full) * piece)
            length = np.minimum(np.where(i < full, capacity, piece), total[doc] - start)
            view = ids.astype("<u4", copy=False).data
            begin = ends[doc] + start
            crc = np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())), dtype=np.int64, count=len(doc))
            rows = np.stack([doc_id[doc], start, length, crc, total[doc], there[doc]], axis=1)
            whole = length == capacity
            if m := int(whole.sum()):
                yield out(rows[whole], sequence + np.arange(m), np.zeros(m, dtype=np.int64))
                sequence += m
            rows = rows[~whole]
            while len(rows):
                take = rows[: group - count]
                waiting.append(take)
                count += len(take)
                rows = rows[len(take) :]
                if count >= group:
                    yield placed()
        if count:
            yield placed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACKED_SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
