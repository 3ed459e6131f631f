"""Audit of how sources of one language diverge in their terms, by mergeable radix tries.

Each task counts the terms of its documents in a byte trie: leaves in UTF-8 order, each with its edge (how
much it shares with the leaf before it, and the bytes that follow) and a counter per (lang, source) of
occurrences and documents. Tries are cut into subtrees by the first bytes of their terms and dealt by
range of those bytes; subtrees of one prefix meet and merge, whatever task they come from. So one row per
task and prefix is shuffled, and not one per word, and a term that is everywhere is a leaf per task. A
prefix under which too many leaves lie is cut again by further bytes. Terms kept (in at least `least`
documents of a lang) are written as tries again, with totals per group. A last pass streams these in
UTF-8 order: it adds up differences of all pairs of sources from the leaves where either has the term
(everywhere else the difference is one constant), and holds the first `top` candidates of each group.

All arithmetic is on integers, exact. Groups are known by 64-bit hashes whose seed is chosen so that no
two of the table's groups share one. The table of groups goes to all tasks: its square is in the result,
so it is small wherever the result can be written. Where a lang has so many sources that its matrix is
too large for a task, the matrix is dealt in blocks of its rows.

Null text, lang and source count as ''. doc_id is not read, repeated rows count each. A very long text is
a unit of its own: its worker holds about fifty times its bytes. An empty table gives no rows. Columns
besides text, lang and source are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewarden.llm._shared import written
from pagewarden.llm._text import LOWER, bounded_batches, flat, texts, units, words
from pagewarden.llm.exact_dedup import LOWER as SMALL
from pagewarden.llm.exact_dedup import UPPER

LEAST_DOCS, TOP = 30, 50
SCALE, ADDED = 1_000_000_000, 5
#: Bytes of a term by which tries are cut, and the leaves under one prefix from which it is cut again.
HEAD, DEEPER, MOST_LEAVES = 4, 2, 4_000_000
#: Counters that a task holds before it writes its trie or merges what it holds; counters of a row.
HELD, ROW = 400_000, 2_000
#: Cells of a matrix that a task holds.
CELLS = 4_000_000

#: Bytes of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` on lower-cased text: a-z and all non-ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True

COUNTER = np.dtype([("lid", "<i8"), ("gid", "<i8"), ("n", "<i8"), ("docs", "<i8")])
EDGE = np.dtype([("shared", "<u4"), ("size", "<u4"), ("fan", "<u4")])
TRIE_SCHEMA = "head binary, leaves long, edges binary, labels binary, counters binary"
KEPT_SCHEMA = TRIE_SCHEMA + ", lid long, gid long, n long, v long"
FOUND_SCHEMA = "lid long, x long, y long, value long, term binary"


def _schema(said: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in said.split(", ")])


class Trie:
    """Leaves (terms in UTF-8 order), how many counters each has (fan), and the counters, by group."""

    def __init__(self, terms: pa.Array, fan: np.ndarray, counters: np.ndarray) -> None:
        self.terms, self.fan, self.counters = terms, fan, counters

    @property
    def leaf(self) -> np.ndarray:
        """The leaf of each counter."""
        return np.repeat(np.arange(len(self.fan)), self.fan)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        found = pa.concat_arrays([t.terms for t in tries]).dictionary_encode()
        order = pc.sort_indices(found.dictionary).to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        before = np.cumsum([0, *(len(t.fan) for t in tries)])
        leaf = place[found.indices.to_numpy()][np.concatenate([t.leaf + b for t, b in zip(tries, before)])]
        counters = np.concatenate([t.counters for t in tries])
        by = np.lexsort((counters["gid"], leaf))
        leaf, counters = leaf[by], counters[by]
        new = np.ones(len(leaf), dtype=bool)
        new[1:] = (leaf[1:] != leaf[:-1]) | (counters["gid"][1:] != counters["gid"][:-1])
        out = counters[new]
        for c in ("n", "docs"):
            out[c] = np.add.reduceat(counters[c], np.flatnonzero(new)) if len(out) else 0
        return cls(found.dictionary.take(pa.array(order)), np.bincount(leaf[new], minlength=len(order)), out)

    def kept(self, least: int) -> Trie:
        """Without the counters of langs in which fewer than `least` documents have the term."""
        leaf, own = self.leaf, self.counters
        by = np.lexsort((own["lid"], leaf))
        new = np.ones(len(by), dtype=bool)
        new[1:] = (leaf[by][1:] != leaf[by][:-1]) | (own["lid"][by][1:] != own["lid"][by][:-1])
        stays = np.zeros(len(by), dtype=bool)
        if len(by):
            docs = np.add.reduceat(own["docs"][by], np.flatnonzero(new))
            stays[by] = (docs >= least)[np.cumsum(new) - 1]
        fan = np.bincount(leaf[stays], minlength=len(self.fan))
        return Trie(self.terms.filter(pa.array(fan > 0)), fan[fan > 0], own[stays])

    def shared(self) -> np.ndarray:
        """How many bytes each leaf has in common with the one before it."""
        data, begin = flat(self.terms)
        size = np.diff(begin)
        out = np.zeros(len(size), dtype=np.int64)
        more = np.arange(1, len(size))
        at = 0
        while len(more):
            more = more[(size[more] > at) & (size[more - 1] > at)]
            more = more[data[begin[more] + at] == data[begin[more - 1] + at]]
            at += 1
            out[more] = at
        return out

    def rows(self, depth: int, most: int | None = None) -> pa.RecordBatch:
        """TRIE_SCHEMA: a row per prefix of `depth` bytes, or rows of at least `most` counters where that is given."""
        data, begin = flat(self.terms)
        shared, size = self.shared(), np.diff(begin)
        if most is None:  # a leaf begins a subtree unless it has its first bytes in common with the leaf before
            first = (shared < depth) | (np.concatenate([[0], size[:-1]]) < depth)
        else:
            part = (np.cumsum(self.fan) - self.fan) // most
            first = np.diff(part, prepend=-1) > 0
        first = np.flatnonzero(first)
        shared[first] = 0
        ends = np.append(first, len(size)).astype(np.int64)
        edges = np.empty(len(size), dtype=EDGE)
        edges["shared"], edges["size"], edges["fan"] = shared, size - shared, self.fan
        inside = np.arange(len(data)) - np.repeat(begin[:-1], size) >= np.repeat(shared, size)
        labels, label_ends = data[inside], np.concatenate([[0], np.cumsum(size - shared)])[ends]
        heads = self.terms.take(pa.array(first))
        heads = pc.binary_slice(heads, 0, depth) if most is None else heads
        counter_ends = np.concatenate([[0], np.cumsum(self.fan)])[ends]
        return pa.RecordBatch.from_arrays([heads, pa.array(np.diff(ends)), _blobs(edges, ends), _blobs(labels, label_ends), _blobs(self.counters, counter_ends)], schema=_schema(TRIE_SCHEMA))


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array, as bytes."""
    at = np.ascontiguousarray(ends * values.dtype.itemsize, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def _bytes(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return flat(column)[0].view(kind)


def trie_of(batch: pa.RecordBatch) -> Trie:
    """The leaves of all rows, one row after the other: `merged` puts them in order."""
    edges, labels = _bytes(batch.column("edges"), EDGE), flat(batch.column("labels"))[0].tobytes()
    out, last, at = [], b"", 0
    for shared, size in zip(edges["shared"].tolist(), edges["size"].tolist()):
        last = last[:shared] + labels[at : at + size]
        at += size
        out.append(last)
    return Trie(pa.array(out, pa.binary()), edges["fan"].astype(np.int64), _bytes(batch.column("counters"), COUNTER))


def counted(batch: pa.RecordBatch) -> Trie:
    """The trie of a unit's texts (columns lid, gid, text)."""
    data, ends = flat(texts(batch))
    data = LOWER[data]
    start, end, first = words(data, ends, LETTER)
    at = np.concatenate([[0], np.cumsum(end - start)])
    bytes_ = np.ascontiguousarray(data[LETTER[data]])
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(bytes_)]).dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    n = max(len(order), 1)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    gids, group = np.unique(np.asarray(batch.column("gid")), return_inverse=True)
    lids = np.zeros(len(gids), dtype=np.int64)
    lids[group] = np.asarray(batch.column("lid"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    pair, times = np.unique(row * n + place[found.indices.to_numpy()], return_counts=True)
    key, where = np.unique((pair % n) * len(gids) + group[pair // n], return_inverse=True)
    counters = np.empty(len(key), dtype=COUNTER)
    counters["gid"], counters["lid"] = gids[key % len(gids)], lids[key % len(gids)]
    counters["n"] = np.bincount(where, weights=times, minlength=len(key))
    counters["docs"] = np.bincount(where, minlength=len(key))
    return Trie(found.dictionary.take(pa.array(order)), np.bincount(key // len(gids), minlength=len(order)), counters)


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): lid, gid and text of every row; lang, source, lid and gid of every group."""
    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = written(own.groupBy("lang", "source").agg(F.count("*").alias("rows")), "groups")
    for seed in range(100):
        ids = {"lid": F.xxhash64(F.lit(seed), "lang"), "gid": F.xxhash64(F.lit(seed + 1000), "lang", "source")}
        named = groups.withColumns(ids)
        langs = named.select("lang", "lid").distinct()
        if named.select("gid").distinct().count() == groups.count() and langs.select("lid").distinct().count() == langs.count():
            return own.withColumns(ids).select("lid", "gid", "text"), named
    raise ValueError("no seed tells the groups apart")


def tries(rows: DataFrame, depth: int = HEAD) -> DataFrame:
    """Subtrees of all tasks' tries."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Trie] = []
        for unit in units(batches):
            held.append(counted(unit))
            if sum(len(t.counters) for t in held) > HELD:
                held = [Trie.merged(held)]
                if len(held[0].counters) > HELD // 2:
                    yield held[0].rows(depth)
                    held = []
        if held:
            yield Trie.merged(held).rows(depth)

    return written(rows.mapInArrow(run, TRIE_SCHEMA), "tries")


def cut(rows: DataFrame, depth: int = HEAD, most: int = MOST_LEAVES) -> DataFrame:
    """The subtrees, cut by further bytes where more than `most` leaves of all tasks lie under a prefix."""
    while True:
        hot = rows.groupBy("head").agg(F.sum("leaves").alias("n")).filter((F.col("n") > most) & (F.octet_length("head") == depth)).select("head")
        if hot.isEmpty():
            return rows
        depth += DEEPER

        def run(batches: Iterable[pa.RecordBatch], to: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield trie_of(batch.slice(k, 1)).rows(to)

        hot = written(hot, "hot_prefixes")
        deeper = rows.join(hot, "head", "left_semi").mapInArrow(run, TRIE_SCHEMA)
        rows = written(rows.join(hot, "head", "left_anti").unionByName(deeper), "tries")


def merged(rows: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """KEPT_SCHEMA: the kept terms as tries, and without a head the totals of each task: occurrences by group, kept terms by lang (gid null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int | None], int] = {}

        def out(done: list[Trie]) -> Iterator[pa.RecordBatch]:
            trie = Trie.merged(done).kept(least)
            if not len(trie.fan):
                return
            own, leaf = trie.counters, trie.leaf
            for gid, lid, n in _sums(own["gid"], own["lid"], own["n"]):
                sums[lid, gid] = sums.get((lid, gid), 0) + n
            for lid, n in zip(*(x.tolist() for x in np.unique(np.unique(np.stack([own["lid"], leaf]), axis=1)[0], return_counts=True))):
                sums[lid, None] = sums.get((lid, None), 0) + n
            part = trie.rows(0, ROW)
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.nulls(part.num_rows, pa.int64())] * 4], schema=_schema(KEPT_SCHEMA))

        head, held = None, []  # the subtrees of the last prefix so far; more of it may follow
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = batch.column("head")
            if heads[-1] != head:
                done = pc.not_equal(heads, heads[-1])
                whole = batch.filter(done)
                held += [trie_of(whole)] if whole.num_rows else []
                yield from out(held) if held else ()
                head, held, batch = heads[-1], [], batch.filter(pc.invert(done))
            held.append(trie_of(batch))
            if len(held) > 1 and sum(len(t.counters) for t in held) > HELD:
                held = [Trie.merged(held)]
        if held:
            yield from out(held)
        if sums:
            keys = [*sums]
            blank = [pa.nulls(len(keys), f.type) for f in _schema(TRIE_SCHEMA)]
            n = [sums[k] if k[1] is not None else None for k in keys]
            v = [sums[k] if k[1] is None else None for k in keys]
            yield pa.RecordBatch.from_arrays([*blank, *(pa.array(x, pa.int64()) for x in ([k[0] for k in keys], [k[1] for k in keys], n, v))], schema=_schema(KEPT_SCHEMA))

    return written(rows.repartitionByRange("head").sortWithinPartitions("head").mapInArrow(run, KEPT_SCHEMA), "kept_terms")


def _sums(gid: np.ndarray, lid: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(gid, lid, sum of n) per gid."""
    own, at, where = np.unique(gid, return_index=True, return_inverse=True)
    total = np.zeros(len(own), dtype=np.int64)
    np.add.at(total, where, n)
    return zip(own.tolist(), lid[at].tolist(), total.tolist())


def scaled(count: np.ndarray, n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + ADDED) / (n + ADDED v)), in three steps of long division, none of which overflows."""
    left, under = np.asarray(count, dtype=np.int64) + ADDED, np.maximum(np.asarray(n, dtype=np.int64) + ADDED * np.asarray(v, dtype=np.int64), 1)
    out = np.zeros(np.broadcast(left, under).shape, dtype=np.int64)
    for step in (1, 1000, 1000, 1000):
        out, left = out * 1000 + left * step // under, left * step % under
    return out + 1


class Lang:
    """The groups of one lang (in order of gid): their totals, and their p where a term is missing."""

    def __init__(self, gids: np.ndarray, n: np.ndarray, v: int) -> None:
        by = np.argsort(gids)
        self.gids, self.n, self.v, self.all = gids[by], n[by], v, int(n.sum())
        self.none = scaled(np.zeros(len(by), dtype=np.int64), self.n, v)
        #: Rows of the matrix of pairs that a task holds.
        self.block = max(1, min(len(by), CELLS // max(len(by), 1)))

    def apart(self, lo: int, hi: int) -> np.ndarray:
        """What groups lo to hi and all others differ by in a term that neither has."""
        return np.abs(self.none[lo:hi, None] - self.none[None, :])


def _pair_sums(lang: Lang, leaf: np.ndarray, group: np.ndarray, p: np.ndarray, block: int, out: np.ndarray) -> None:
    """Add to out[a, b], for a in the block: what leaves where a or b occurs differ by, beyond what a and b differ by elsewhere.

    Leaves with both a and b count half in each order of the pair, so sums of whole pairs are twice theirs.
    """
    lo, hi = block * lang.block, min((block + 1) * lang.block, len(lang.gids))
    apart = lang.apart(lo, hi)
    step = max(1, CELLS // len(lang.gids))
    leaves, row = np.unique(leaf, return_inverse=True)
    for first in range(0, len(leaves), step):
        some = (row >= first) & (row < first + step)
        at, g = row[some] - first, group[some]
        n = min(step, len(leaves) - first)
        full = np.tile(lang.none, (n, 1))
        full[at, g] = p[some]
        here = np.zeros(full.shape, dtype=bool)
        here[at, g] = True
        for a in range(lo, hi):
            own = np.flatnonzero(here[:, a])
            if len(own):
                more = np.abs(full[own, a][:, None] - full[own]) - apart[a - lo]
                out[a - lo] += (more * (2 - here[own])).sum(axis=0)


def measured(kept: DataFrame, langs: dict[int, Lang], top: int = TOP) -> DataFrame:
    """FOUND_SCHEMA: pairs of groups x, y with their sums, and candidates x with their terms (y null)."""
    sent = kept.sparkSession.sparkContext.broadcast(langs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, schema = sent.value, _schema(FOUND_SCHEMA)
        sums: dict[int, np.ndarray] = {}
        best, at_block = None, 0

        def pairs(block: int) -> Iterator[pa.RecordBatch]:
            for lid, found in sums.items():
                lang, first = langs[lid], block * langs[lid].block
                x, y = np.nonzero(found)
                for k in range(0, len(x), 50_000):
                    a, b = x[k : k + 50_000], y[k : k + 50_000]
                    value = found[a, b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), lid)), pa.array(lang.gids[a + first]), pa.array(lang.gids[b]), pa.array(value), pa.nulls(len(a), pa.binary())], schema=schema)
            sums.clear()

        for batch in batches:
            for block in np.unique(np.asarray(batch.column("block"))).tolist():
                if block != at_block:
                    yield from pairs(at_block)
                    at_block = block
                part = batch.filter(pc.equal(batch.column("block"), block))
                trie = trie_of(part)
                own, leaf = trie.counters, trie.leaf
                for lid in np.unique(own["lid"]).tolist():
                    lang, some = langs[lid], own["lid"] == lid
                    where, mine = leaf[some], own[some]
                    group = np.searchsorted(lang.gids, mine["gid"])
                    p = scaled(mine["n"], lang.n[group], lang.v)
                    if block * lang.block < len(lang.gids):
                        shape = (min(lang.block, len(lang.gids) - block * lang.block), len(lang.gids))
                        _pair_sums(lang, where, group, p, block, sums.setdefault(lid, np.zeros(shape, dtype=np.int64)))
                    if block == 0:
                        _, row = np.unique(where, return_inverse=True)
                        total = np.zeros(int(row.max()) + 1, dtype=np.int64)
                        np.add.at(total, row, mine["n"])
                        more = p - scaled(total, lang.all, lang.v)[row]
                        up = more > 0
                        found = pa.table({"lid": np.full(int(up.sum()), lid), "x": mine["gid"][up], "value": more[up], "term": trie.terms.take(pa.array(where[up]))})
                        best = _first(found if best is None else pa.concat_tables([best, found]), top)
        yield from pairs(at_block)
        for batch in best.to_batches() if best is not None else ():
            yield pa.RecordBatch.from_arrays([batch.column("lid"), batch.column("x"), pa.nulls(batch.num_rows, pa.int64()), batch.column("value"), batch.column("term")], schema=schema)

    blocks = max((-(-len(x.gids) // x.block) for x in langs.values()), default=1)
    rows = kept.filter("head is not null").select("edges", "labels", "counters", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return written((rows.sortWithinPartitions("block") if blocks > 1 else rows).mapInArrow(run, FOUND_SCHEMA), "measures")


def _first(found: pa.Table, top: int) -> pa.Table:
    """The first `top` rows of each x, by value descending and then term."""
    found = found.take(pc.sort_indices(found, [("x", "ascending"), ("value", "descending"), ("term", "ascending")]))
    x = found.column("x").to_numpy()
    begin = np.flatnonzero(np.diff(x, prepend=x[:1] - 1))
    place = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
    return found.filter(pa.array(place < top)).combine_chunks()


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, depth: int = HEAD, most: int = MOST_LEAVES) -> DataFrame:
    """lang, source, part, item, value, rank: for each group the other sources of its lang, and the terms that it has more of than its lang."""
    rows, groups = grouped(docs)
    kept = merged(cut(tries(rows, depth), depth, most), least)
    totals = kept.filter("head is null").groupBy("lid", "gid").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    v = totals.filter("gid is null").select("lid", "v")
    sizes = written(groups.join(totals.filter("gid is not null").select("gid", "n"), "gid", "left").join(v, "lid", "left").select("lang", "source", "lid", "gid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "group_sizes")
    by_lang = sizes.groupBy("lid").agg(F.collect_list(F.struct("gid", "n")).alias("own"), F.first("v").alias("v")).filter("v > 0").collect()
    langs = {r["lid"]: Lang(np.array([g["gid"] for g in r["own"]], dtype=np.int64), np.array([g["n"] for g in r["own"]], dtype=np.int64), r["v"]) for r in by_lang}
    found = measured(kept, langs, top)

    # Sums of a pair stand in both orders, each leaf twice in total.
    sums = found.filter("y is not null").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.expr("sum(value) div 2").alias("sum"))
    none = F.expr(f"1 + {SCALE * ADDED} div greatest(n + {ADDED} * v, 1)")
    one = sizes.select("lid", "lang", "source", "v", F.col("gid").alias("a"), none.alias("p"))
    other = sizes.select("lid", F.col("source").alias("item"), F.col("gid").alias("b"), none.alias("q"))
    pairs = one.join(other, "lid").filter("a <> b").withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(sums, ["x", "y"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr("if(v = 0, 0L, v * abs(p - q) + coalesce(sum, 0L))").alias("value"))
    terms = found.filter("y is null").join(sizes.select("lang", "source", F.col("gid").alias("x")), "x").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return pairs.unionByName(terms).withColumn("rank", rank).filter(f"part = 'pair' or rank <= {int(top)}")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
counts AS (SELECT lang, source, id, t, count(*) AS n FROM (SELECT lang, source, id, unnest(w) AS t FROM d) GROUP BY ALL),
kept AS (SELECT lang, t FROM counts GROUP BY lang, t HAVING count(*) >= 30),
c AS (SELECT lang, source, t, sum(n)::BIGINT AS n FROM counts JOIN kept USING (lang, t) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total, coalesce(any_value(v), 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY lang, source),
l AS (SELECT lang, sum(total)::BIGINT AS total, any_value(v) AS v FROM g GROUP BY lang),
p AS (SELECT g.lang, g.source, kept.t, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.total + 5 * g.v) AS p FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
q AS (SELECT lang, t, 1 + 1000000000 * (sum(n)::BIGINT + 5) // (any_value(l.total) + 5 * any_value(l.v)) AS q FROM c JOIN l USING (lang) GROUP BY lang, t),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', t, (p - q)::BIGINT FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""
