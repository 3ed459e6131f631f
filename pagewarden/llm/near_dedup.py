"""Near-duplicate groups by SimHash: pigeonhole blocks, an exact check of the distance, components.

Fingerprints: words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, shingles of `shingle` words joined by
single spaces (fewer words: the whole sequence), XXH64 with seed 42 of each, and per bit the majority.
Links: the 64 bits are split into `blocks` blocks; fingerprints at most `distance` bits apart agree in
`blocks - distance` of them, so each choice of that many blocks is a table, and rows meet where they
agree on a table's blocks. Equal fingerprints are one node from the start. Within a bucket, pairs are
found by array work and only a spanning forest of its links leaves it. A bucket of more than LARGE nodes
is not held: its nodes are dealt once more by the same rule over the bits that its key leaves open, so
the largest that any task can meet has two thirds to three quarters of all bits in common, whatever the
input. There, a large bucket is not compared pair by pair: rows that differ in at most `distance` of the
bits that vary there are equal once those bits are masked, so one sort per choice of bits links them
all, in time linear in the bucket.
Components then come from alternating star contraction over the links, written after each round.

A null or empty text has no words: fingerprint 0, linked like any other. Repeated rows are equal
fingerprints. A row of a null doc_id has the component of the rows of its fingerprint; where none of them
has an id, it is null. A very long text is a unit of its own: its worker holds about eighty times its
bytes. An empty table gives no rows. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm._shared import written
from pagewarden.llm._text import LOWER, VISIBLE, bounded_batches, flat, texts, units, words

SHINGLE, DISTANCE, BLOCKS = 3, 3, 6
#: Nodes to a bucket above which it is dealt again.
LARGE = 4096

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # XXH64's primes


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of byte spans, all at once."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    short = np.ndarray(shape=(len(padded) - 3,), dtype="<u4", buffer=padded, strides=(1,))
    size = end - start
    seed = np.uint64(seed)
    h = np.full(len(start), seed + _P5, dtype=np.uint64)
    at = start.copy()
    with np.errstate(over="ignore"):
        if len(big := np.flatnonzero(size >= 32)):
            stripes = size[big] // 32
            by = np.argsort(-stripes, kind="stable")
            big, stripes = big[by], stripes[by]
            v = [np.full(len(big), x, dtype=np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            for s in range(int(stripes[0])):
                n = int(np.searchsorted(-stripes, -s, "left"))
                p = at[big[:n]] + 32 * s
                for j in range(4):
                    v[j][:n] = _turned(v[j][:n] + lanes[p + 8 * j] * _P2, 31) * _P1
            total = _turned(v[0], 1) + _turned(v[1], 7) + _turned(v[2], 12) + _turned(v[3], 18)
            for x in v:
                total = (total ^ (_turned(x * _P2, 31) * _P1)) * _P1 + _P4
            h[big] = total
            at[big] += 32 * stripes
        h += size.astype(np.uint64)
        for _ in range(3):
            if not len(i := np.flatnonzero(end - at >= 8)):
                break
            h[i] = _turned(h[i] ^ (_turned(lanes[at[i]] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[i] += 8
        if len(i := np.flatnonzero(end - at >= 4)):
            h[i] = _turned(h[i] ^ (short[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at[i] += 4
        for _ in range(3):
            if not len(i := np.flatnonzero(end > at)):
                break
            h[i] = _turned(h[i] ^ (padded[at[i]].astype(np.uint64) * _P5), 11) * _P1
            at[i] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def shingles_of(strings: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n): XXH64 of the shingles of all rows, and how many each row has."""
    data, ends = flat(strings)
    start, end, first = words(data, ends, VISIBLE)
    size = end - start
    before = np.cumsum(size + 1) - size - 1
    clean = np.full(int(before[-1] + size[-1] + 1) if len(size) else 1, 32, dtype=np.uint8)
    inside = np.repeat(start - before, size)
    at = np.arange(len(inside)) + np.repeat(np.arange(len(size)), size)
    clean[at] = LOWER[data[at + inside]]
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    left = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    right = left + np.repeat(np.minimum(n_words, shingle), n) - 1
    return xxh64(clean, before[left], before[right] + size[right]), n


def fingerprints_of(strings: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints, unsigned."""
    h, n = shingles_of(strings, shingle)
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        begin = (np.cumsum(n) - n)[some]
        for j in range(8):
            bits = np.unpackbits(((h >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
            ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
            byte = np.packbits(ones * 2 > n[some][:, None], axis=1, bitorder="little")[:, 0]
            out[some] |= byte.astype(np.uint64) << np.uint64(8 * j)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            yield pa.RecordBatch.from_arrays([unit.column("doc_id"), pa.array(fingerprints_of(texts(unit), shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label != (up := label[label])).any():
            label = up


def links_of(group: np.ndarray, fp: np.ndarray, distance: int, direct: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of indices) that connect all rows of a group within `distance` bits of each other.

    group: sorted. direct: groups up to this size are compared pair by pair, larger ones by masks.
    """
    n = len(fp)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(first, n))
    last = np.repeat(first + size, size)  # the end of each row's group
    large = np.repeat(size > direct, size)
    u, v = [], []
    live = np.flatnonzero(~large & (np.arange(n) + 1 < last))
    for d in range(1, direct):
        if not len(live):
            break
        near = np.bitwise_count(fp[live] ^ fp[live + d]) <= distance
        u.append(live[near])
        v.append(live[near] + d)
        live = live[live + d + 1 < last[live]]
    for g in np.flatnonzero(size > direct):
        at = np.arange(first[g], first[g] + size[g])
        own = fp[at]
        varying = np.bitwise_or.reduce(own ^ own[0])
        bits = [b for b in range(64) if varying >> np.uint64(b) & np.uint64(1)]
        if comb(len(bits), min(distance, len(bits))) * 16 > len(at):  # few rows for so many bits: blocks of pairs
            for lo in range(0, len(at), 512):
                a, b = np.nonzero(np.bitwise_count(own[lo : lo + 512, None] ^ own[None, lo:]) <= distance)
                keep = a < b
                label = _forest(len(at) - lo, a[keep], b[keep])
                child = np.flatnonzero(label != np.arange(len(label)))
                u.append(at[lo + label[child]])
                v.append(at[lo + child])
            continue
        for chosen in combinations(bits, min(distance, len(bits))):
            mask = np.uint64(0)
            for b in chosen:
                mask |= np.uint64(1) << np.uint64(b)
            rest = own & ~mask
            by = np.argsort(rest, kind="stable")
            same = rest[by][1:] == rest[by][:-1]
            u.append(at[by[:-1][same]])
            v.append(at[by[1:][same]])
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(u or none), np.concatenate(v or none)


def _masks(bits: list[int], distance: int, blocks: int) -> list[int]:
    """Per choice of blocks - distance blocks of the bits, their mask."""
    width = [len(bits) // blocks + (i < len(bits) % blocks) for i in range(blocks)]
    parts = [bits[sum(width[:i]) : sum(width[: i + 1])] for i in range(blocks)]
    return [sum(1 << b for i in chosen for b in parts[i]) for chosen in combinations(range(blocks), blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, large: int = LARGE) -> DataFrame:
    """(u, v) with u < v: links that connect all nodes (fp distinct, id) at most `distance` bits apart."""
    masks = _masks(list(range(64)), distance, blocks)
    table = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks))))
    rows = nodes.filter("id is not null").select("fp", "id", table.alias("at")).select("at.t", "at.key", "fp", "id")
    found = written(_linked(rows, distance, large), "bucket_links")
    out = found.filter("u is not null").select("u", "v")
    again = found.filter("u is null").select("t", "key")
    if not again.isEmpty():
        inner = [[m | x for x in _masks([b for b in range(64) if not m >> b & 1], distance, blocks)] for m in masks]
        deeper = F.array(*(F.array(*(F.lit(_signed(x)) for x in own)) for own in inner))
        rows = rows.join(again, ["t", "key"], "left_semi").select("fp", "id", "t", F.posexplode(F.get(deeper, F.col("t"))).alias("i", "mask"))
        rows = rows.select((F.col("t") * len(inner[0]) + F.col("i")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "id")
        out = out.union(_linked(rows, distance, None).select("u", "v"))
    return out.distinct()


def _linked(rows: DataFrame, distance: int, large: int | None) -> DataFrame:
    """(u, v, t, key): links within the buckets (t, key) of rows (t, key, fp, id); u and v null: a bucket of more than `large` rows, left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None
        left_out: tuple[int, int] | None = None
        for batch in _with_end(batches):
            if batch is None:
                ready, kept = kept, None
            else:
                if left_out and batch.num_rows:
                    table, key = np.asarray(batch.column("t")), np.asarray(batch.column("key"))
                    other = (table != left_out[0]) | (key != left_out[1])
                    batch = batch.slice(int(other.argmax()) if other.any() else batch.num_rows)
                if not batch.num_rows:
                    continue
                whole = pa.concat_batches([kept, batch]) if kept is not None else batch
                table, key = np.asarray(whole.column("t")), np.asarray(whole.column("key"))
                other = np.flatnonzero((table != table[-1]) | (key != key[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                ready, kept = whole.slice(0, cut), whole.slice(cut)
                left_out = None
                if large is not None and kept.num_rows > large:
                    left_out, kept = (int(table[-1]), int(key[-1])), None
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([left_out[0]], pa.int32()), pa.array([left_out[1]], pa.int64())], ["u", "v", "t", "key"])
            if ready is None or ready.num_rows < 2:
                continue
            table, key = np.asarray(ready.column("t")), np.asarray(ready.column("key"))
            fp, ids = np.asarray(ready.column("fp")).view(np.uint64), np.asarray(ready.column("id"))
            group = np.cumsum(np.concatenate([[False], (table[1:] != table[:-1]) | (key[1:] != key[:-1])]))
            u, v = links_of(group, fp, distance)
            if not len(u):
                continue
            names, node = np.unique(ids, return_inverse=True)
            label = _forest(len(names), node[u], node[v])
            child = np.flatnonzero(label != np.arange(len(label)))
            none = pa.nulls(len(child))
            yield pa.RecordBatch.from_arrays([pa.array(names[label[child]]), pa.array(names[child]), none.cast(pa.int32()), none.cast(pa.int64())], ["u", "v", "t", "key"])

    return rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(run, "u long, v long, t int, key long")


def _with_end(batches: Iterable) -> Iterator:
    yield from batches
    yield None


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): per node of the links (u < v) the smallest node that it reaches.

    Alternates two contractions until nothing changes: larger neighbours move to the smallest
    neighbour, then smaller ones do. Each round is written, so lineage and plans stay short.
    """
    edges = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "links")
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), "v"))).alias("e")).select("e.u", "e.v").filter("u < v").distinct()
        new = written(small, "links")
        state = [d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (edges, new)]
        edges = new
        if state[0] == state[1]:
            return edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("root"))
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp, component_id: one row per document."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    roots = components(links(nodes, distance, blocks))
    of = nodes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
