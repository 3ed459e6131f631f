"""Removal of benchmark text by suffix arrays over the training documents.

Documents are taken in shards (bounded pieces of a partition). Each shard's words become one array of
integers, document ends between them, and its suffixes are sorted over their whole length (by prefix
doubling, up to the end of their document). Suffixes of the benchmark are binary-searched in every
shard: `longest_matches` searches every one and gives the longest verbatim match and a place of it;
`find_benchmark` and `decontaminated` search those that begin a window: the interval found holds all
places where that window stands, and windows that follow each other on both sides are one longer
match. A document lies in one shard, so nothing but one row per suffix is shuffled. Words are numbered
by their hashes; every match found is then compared byte by byte.

The benchmark is read in blocks of bounded size by a hash of item_id, each broadcast for one pass over
the documents; an item larger than a block makes a block of its own size.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null or empty text has no words
and is never contaminated; an item without words is never found; an item of a null id counts as ''.
Items that share an id count as one item. Repeated documents are each treated alone; a null doc_id stays
null. A very long text is a shard of its own: its worker holds about a hundred times its bytes. Empty
tables give no rows, or no hits. Other columns are ignored (find_benchmark) or passed through
(decontaminated), whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm._text import ALNUM, LOWER, bounded_batches, flat, same_spans, texts, units, word_hashes, words

WINDOW = 10
BLOCK_BYTES = 16 << 20


class Queries:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window = window
        self.items = [i for i, _ in items]
        data, ends = flat(pa.array([t or "" for _, t in items], pa.string()))
        self.data = LOWER[data]
        self.start, self.end, first = words(self.data, ends, ALNUM)
        self.hashes = word_hashes(self.data, self.start, self.end)
        size = np.diff(first)
        #: Per word: its item, its place there, and how many words of the item begin with it.
        self.of = np.repeat(np.arange(len(items)), size)
        self.within = np.arange(len(self.of)) - np.repeat(first[:-1], size)
        self.rest = np.repeat(size, size) - self.within
        length = np.minimum(size, window)
        n = np.where(size > 0, size - length + 1, 0)
        self.item = np.repeat(np.arange(len(items)), n)
        self.place = np.arange(len(self.item)) - np.repeat(np.cumsum(n) - n, n)  # first word, within the item
        self.at = first[self.item] + self.place
        self.length = length[self.item]


class Shard:
    """A suffix array over the words of some documents."""

    def __init__(self, strings: pa.Array) -> None:
        data, ends = flat(strings)
        self.data = LOWER[data]
        self.start, self.end, first = words(self.data, ends, ALNUM)
        self.n_words = np.diff(first)
        self.vocabulary, number = np.unique(word_hashes(self.data, self.start, self.end), return_inverse=True)
        #: Word numbers to a key, and bits to a number.
        self.per, self.bits = (3, 21) if len(self.vocabulary) < (1 << 21) - 1 else (2, 31)
        rows = len(self.n_words)
        self.doc = np.repeat(np.arange(rows), self.n_words + 1)  # of each place; a document's last place is its end
        self.begin = first[:-1] + np.arange(rows)
        self.ids = np.zeros(len(number) + rows + 16, dtype=np.int64)
        place = np.arange(len(number)) + np.repeat(np.arange(rows), self.n_words)
        self.ids[place] = number + 1
        self.order = place[np.argsort(self.key(place, 0), kind="stable")]
        self._sort_whole(first)

    def _sort_whole(self, first: np.ndarray) -> None:
        """Sort by further words what the first ones left equal: places by the rank of what stands d words on, d doubling."""
        left = np.zeros(len(self.ids), dtype=np.int64)  # words from a place to the end of its document
        left[: len(self.doc)] = (self.begin + self.n_words)[self.doc] - np.arange(len(self.doc)) if len(self.doc) else 0
        key = self.key(self.order, 0)
        group = self._starts(key[1:] != key[:-1])
        rank = np.zeros(len(self.ids), dtype=np.int64)
        rank[self.order] = group + 1
        at = np.arange(len(group))
        d = self.per
        while True:
            tied = np.zeros(len(at), dtype=bool)
            same = group[at[1:]] == group[at[:-1]]
            tied[1:] |= same
            tied[:-1] |= same
            at = at[tied & (left[self.order[at]] >= d)]  # the others end within these words, together
            if not len(at):
                return
            places, of = self.order[at], group[at]
            key = rank[places + d]
            by = np.lexsort((key, of))
            places, of, key = places[by], of[by], key[by]
            new = self._starts((of[1:] != of[:-1]) | (key[1:] != key[:-1]))
            self.order[at] = places
            group[at] = at[new]
            rank[places] = group[at] + 1
            d *= 2

    def same(self, places: np.ndarray, q: Queries, at: np.ndarray) -> np.ndarray:
        """Per pair of a place and a word of the benchmark, whether the two words are equal byte by byte."""
        word = places - self.doc[places]
        return same_spans(self.data, self.start[word], self.end[word], q.data, q.start[at], q.end[at])

    def longest(self, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, length, place): per suffix of the benchmark that matches, its longest match and a place of it."""
        number = self.numbers(q)
        which = np.flatnonzero(number)
        low, high = np.zeros(len(which), dtype=np.int64), np.full(len(which), len(self.order), dtype=np.int64)
        length, place = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
        d = 0
        while len(which):
            key = number[which + d]
            low, high = self._search(low, high, d, key, 1), self._search(low, high, d, key + 1, 1)
            found = (key > 0) & (low < high)
            which, low, high = which[found], low[found], high[found]
            length[which], place[which] = d + 1, self.order[low]
            d += 1
            more = q.rest[which] > d
            which, low, high = which[more], low[more], high[more]
        some = np.flatnonzero(length)
        n = length[some]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = self.same(np.repeat(place[some], n) + step, q, np.repeat(some, n) + step)
        wrong = np.full(len(some), np.iinfo(np.int64).max)
        np.minimum.at(wrong, np.repeat(np.arange(len(some)), n)[~same], step[~same])
        length[some] = np.minimum(n, wrong)
        some = np.flatnonzero(length)
        return some, length[some], place[some]

    def numbers(self, q: Queries) -> np.ndarray:
        """The shard's number of each word of the benchmark, from 1; 0: not here."""
        if not len(self.vocabulary):
            return np.zeros(len(q.hashes), dtype=np.int64)
        number = np.searchsorted(self.vocabulary, q.hashes)
        number[number == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[number] == q.hashes, number + 1, 0)

    @staticmethod
    def _starts(new: np.ndarray) -> np.ndarray:
        """Per place, where its run of equal keys begins."""
        at = np.concatenate([[0], np.where(new, np.arange(1, len(new) + 1), 0)]) if len(new) else np.zeros(len(new) + 1, dtype=np.int64)
        return np.maximum.accumulate(at)

    def key(self, places: np.ndarray, d: int, n: int = 0) -> np.ndarray:
        key = self.ids[places + d]
        for j in range(1, n or self.per):
            key = (key << self.bits) | self.ids[places + d + j]
        return key

    def intervals(self, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, low, high): windows that occur, and the range of the suffix array that they begin."""
        number = self.numbers(q)
        padded = np.concatenate([number, np.zeros(q.window + 3, dtype=np.int64)])
        which = np.flatnonzero(number[q.at] > 0)
        low = np.zeros(len(which), dtype=np.int64)
        high = np.full(len(which), len(self.order), dtype=np.int64)
        for d in range(0, q.window, self.per):
            live = q.length[which] > d
            left = np.clip(q.length[which] - d, 0, self.per)
            at = q.at[which] + d
            known = np.ones(len(which), dtype=bool)
            key = np.zeros(len(which), dtype=np.int64)
            for j in range(self.per):
                used = left > j
                known &= ~used | (padded[at + j] > 0)
                key |= np.where(used, padded[at + j], 0) << ((self.per - 1 - j) * self.bits)
            step = np.int64(1) << ((self.per - left) * self.bits)
            low, high = np.where(live, self._search(low, high, d, key), low), np.where(live, self._search(low, high, d, key + step), high)
            found = (known | ~live) & (low < high)
            which, low, high = which[found], low[found], high[found]
        return which, low, high

    def _search(self, low: np.ndarray, high: np.ndarray, d: int, key: np.ndarray, n: int = 0) -> np.ndarray:
        """Per query, the first place of [low, high) whose key at depth d is not below `key`."""
        low, high = low.copy(), high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            below = self.key(self.order[mid], d, n) < key[open_]
            low[open_] = np.where(below, mid + 1, low[open_])
            high[open_] = np.where(below, high[open_], mid)
        return low


def _occurrences(shard: Shard, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every occurrence."""
    which, low, high = shard.intervals(q)
    n = high - low
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    which, place = np.repeat(which, n), shard.order[at]
    for j in range(q.window):
        live = np.flatnonzero(q.length[which] > j)
        wrong = live[~shard.same(place[live] + j, q, q.at[which[live]] + j)]
        if len(wrong):
            which, place = np.delete(which, wrong), np.delete(place, wrong)
    return which, place


def hits_of(strings: pa.Array, q: Queries) -> dict[str, list]:
    """Per document: n_words, hit (positions of hit words, as a mask), items, and its longest match."""
    shard = Shard(strings)
    which, place = _occurrences(shard, q)
    rows = len(shard.n_words)
    change = np.zeros(len(shard.doc) + 1, dtype=np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + q.length[which], -1)
    hit = np.cumsum(change)[:-1] > 0
    out = {"n_words": shard.n_words, "hit": hit, "begin": shard.begin, "n_hit": np.bincount(shard.doc[hit], minlength=rows), "items": [[] for _ in range(rows)], "longest": [None] * rows}
    if not len(which):
        return out
    doc, item = shard.doc[place], q.item[which]
    order = np.lexsort((place, place - q.place[which], item))  # runs of a diagonal
    p, i, w = place[order], item[order], which[order]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (p[1:] != p[:-1] + 1) | (q.place[w][1:] != q.place[w][:-1] + 1)])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(p))) - 1 + q.length[w[first]]
    by = np.lexsort((p[first], -size, doc[order][first]))
    d = doc[order][first][by]
    best = by[np.concatenate([[True], d[1:] != d[:-1]])]
    for f, n in zip(first[best], size[best]):
        row = doc[order][f]
        out["longest"][row] = (int(n), int(p[f] - shard.begin[row]), q.items[i[f]], int(q.place[w[f]]))
    pairs = np.unique(doc * np.int64(len(q.items)) + item)
    for pair in pairs.tolist():
        out["items"][pair // len(q.items)].append(q.items[pair % len(q.items)])
    return out


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """The benchmark's windows as broadcasts of bounded size."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    parts = ([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect()] for b in range(n))
    return [spark.sparkContext.broadcast((p, window, uuid.uuid4().hex)) for p in parts]


_QUERIES: dict[str, Queries] = {}


def _queries(broadcast) -> Queries:
    """Built once per worker; only the last block stays."""
    items, window, name = broadcast.value
    if name not in _QUERIES:
        _QUERIES.clear()
        _QUERIES[name] = Queries(items, window)
    return _QUERIES[name]


_STATE = "hit binary, items array<string>, longest long, longest_word long, longest_item string, longest_item_word long"
FOUND_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_word long, longest_item string, longest_item_word long"


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its words inside any window of the benchmark, the items, the longest match."""
    bounded_batches(docs.sparkSession)
    blocks = _blocks(benchmark, window, block_bytes)
    df = docs.select(F.col("doc_id").cast("long"), "text")
    for b, broadcast in enumerate(blocks):
        df = df.mapInArrow(_finder(broadcast, b == 0, b == len(blocks) - 1), FOUND_SCHEMA if b == len(blocks) - 1 else f"doc_id long, text string, {_STATE}")
    return df


def _finder(broadcast, is_first: bool, is_last: bool):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            found = hits_of(texts(unit), _queries(broadcast))
            old = None if is_first else unit.drop_columns(["doc_id", "text"]).to_pylist()
            rows = []
            for k in range(unit.num_rows):
                n, begin = int(found["n_words"][k]), int(found["begin"][k])
                mask = found["hit"][begin : begin + n]
                items, longest = set(found["items"][k]), found["longest"][k] or (0, None, None, None)
                if old:
                    before = np.unpackbits(np.frombuffer(old[k]["hit"], dtype=np.uint8), count=n).astype(bool)
                    mask = mask | before
                    items |= set(old[k]["items"])
                    was = tuple(old[k][c] for c in ("longest", "longest_word", "longest_item", "longest_item_word"))
                    longest = was if was[0] >= longest[0] else longest
                if is_last:
                    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
                    rows.append((n, int(mask.sum()), len(items), digest, bool(mask.any()), *longest))
                else:
                    rows.append((np.packbits(mask).tobytes(), sorted(items), *longest))
            columns = list(zip(*rows)) if rows else [[]] * 9
            if is_last:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                names = [x.split()[0] for x in FOUND_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([unit.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)
            else:
                kinds = [pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                names = ["doc_id", "text", *(x.split()[0] for x in _STATE.split(", "))]
                yield pa.RecordBatch.from_arrays([unit.column("doc_id"), texts(unit), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return find


LONGEST_SCHEMA = "item_id string, word long, length long, doc_id long, doc_word long"


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, word, length, doc_id, doc_word): per suffix of an item that matches anywhere, the longest match and where it stands.

    Of matches equally long the one of the largest doc_id, then of the last word. Items that share an id
    share their suffixes' rows, by the longest.
    """
    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in LONGEST_SCHEMA.split(", ")]
    out = None
    for broadcast in _blocks(benchmark, WINDOW, block_bytes):

        def search(batches: Iterable[pa.RecordBatch], broadcast=broadcast) -> Iterator[pa.RecordBatch]:
            q = _queries(broadcast)
            for unit in units(batches):
                shard = Shard(texts(unit))
                word, length, place = shard.longest(q)
                doc = shard.doc[place]
                columns = [pa.array([q.items[i] for i in q.of[word].tolist()], pa.string()), pa.array(q.within[word]), pa.array(length), unit.column("doc_id").take(pa.array(doc)), pa.array(place - shard.begin[doc])]
                yield pa.RecordBatch.from_arrays(columns, names)

        rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, LONGEST_SCHEMA)
        out = rows if out is None else out.union(rows)
    best = out.groupBy("item_id", "word").agg(F.max(F.struct("length", "doc_id", "doc_word")).alias("best"))
    return best.select("item_id", "word", "best.length", "best.doc_id", "best.doc_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns."""
    bounded_batches(docs.sparkSession)
    for broadcast in _blocks(benchmark, window, block_bytes):

        def clean(batches: Iterable[pa.RecordBatch], broadcast=broadcast) -> Iterator[pa.RecordBatch]:
            for unit in units(batches):
                yield unit.filter(pa.array(hits_of(texts(unit), _queries(broadcast))["n_hit"] == 0))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
