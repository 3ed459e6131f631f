"""Language-model scores by deleted interpolation.

A token's probability is a mixture of maximum-likelihood estimates: bigram, unigram, and uniform over
the known tokens and an unknown one. The weights depend on how often the context was seen (a bucket
per power of two) and are learned by expectation-maximisation on the training tokens, each with its own
occurrence taken out of all counts (leave-one-out). Held-out documents count and teach nothing.

Tokens are counted by blocks, bounded pieces of the input that never mix held-out and other documents.
A block's tokens are written once, as numbers into its own vocabulary, whose words are kept whole: words
are told apart by their bytes everywhere. For counting, each block sends its distinct words and bigrams,
packed, to parts of the hash range; a part adds up the counts (64 bits) and answers each block in the
order it asked in. So one entry per block and distinct n-gram is shuffled, and not one row per token,
whatever is frequent; every count covers all training rows. The number of parts grows with the tokens.
A row holds all that one block asks of one part; where parts are so many that few entries are left to a
row, rows approach one per distinct n-gram of a block, which is linear in the text but no longer packed.
Expectation-maximisation works on a histogram of the training tokens (bucket, and both ratios to the
uniform estimate in quarter octaves) of bounded size.

Bigrams are known by hashes of 52 bits, so that a few of 10^8 share a count; unigram counts are exact.

A null or empty text is only its end token. A null doc_id stays null and is not held out, so its text
teaches. Repeated rows count and are scored each. A very long text is a block of its own: its worker
holds about forty times its bytes. An empty table gives no rows. Without training tokens the weights are
DEFAULT. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm._shared import written
from pagewarden.llm._text import LOWER, ODD, VISIBLE, bounded_batches, flat, freed, mixed, texts, units, word_hashes, words

FOLDS, HELD_OUT = 7, 2
PART_TOKENS = 800_000
BLOCK_BYTES = 4 << 20
DEFAULT = (0.5, 0.4, 0.1)  # bigram, unigram, uniform
BUCKETS = 40
STEPS = 4  # bins to an octave
_BIGRAM_BITS = np.uint64(12)

BLOCK_SCHEMA = "block long, held boolean, doc_ids array<long>, sizes array<int>, vocabulary_size long, vocabulary binary, tokens binary"
ASKED_SCHEMA = "part int, block long, held boolean, n1 int, n2 int, words binary, size long, hashes binary, counts binary"
COUNTED_SCHEMA = "block long, held boolean, part int, n1 int, n2 int, counts binary, total long, distinct long"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_CODEC = pa.Codec("zstd", 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _packed(data: bytes) -> bytes:
    return _CODEC.compress(data, asbytes=True) if data else b""


def _unpacked(data: bytes, n: int) -> bytes:
    return _CODEC.decompress(data, n, asbytes=True) if n else b""


def _squeezed(values: np.ndarray, kind: str) -> bytes:
    """Zstd of the bytes, byte planes apart."""
    flat_ = values.astype(kind, copy=False).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize)
    return _CODEC.compress(np.ascontiguousarray(flat_.T).data, asbytes=True) if len(values) else b""


def _expanded(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(_CODEC.decompress(data, n * width), dtype=np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def tokens_of(strings: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(tokens, sizes): the tokens of all rows, each with a line end after it (a row's end is only that), and how many each row has."""
    data, ends = flat(strings)
    data = LOWER[data]
    start, end, first = words(data, ends, VISIBLE)
    sizes = np.diff(first) + 1
    length = np.ones(int(sizes.sum()), dtype=np.int64)
    word = np.arange(len(start)) + np.repeat(np.arange(len(sizes)), sizes - 1)
    length[word] += end - start
    begin = np.concatenate([[0], np.cumsum(length)])
    out = np.full(int(begin[-1]), 10, dtype=np.uint8)
    size = end - start
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin[:-1][word], size) + within] = data[np.repeat(start, size) + within]
    return _lines(out, begin).dictionary_encode(), sizes


def _lines(data: np.ndarray, begin: np.ndarray | None = None) -> pa.Array:
    """Bytes as an array of lines, each with its end."""
    if begin is None:
        begin = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    return pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(np.ascontiguousarray(begin, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def blocks(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for unit in units(batches, limit=BLOCK_BYTES):
            held = np.asarray(unit.column("held").to_numpy(zero_copy_only=False), dtype=bool)
            for side in (False, True):
                own = unit.filter(pa.array(held == side))
                if not own.num_rows:
                    continue
                tokens, sizes = tokens_of(texts(own))
                data, begin = flat(tokens.dictionary)
                order = np.argsort(word_hashes(data, begin[:-1], begin[1:] - 1), kind="stable")
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                kept, _ = flat(tokens.dictionary.take(pa.array(order)))
                ids = pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column("doc_id"))
                packed = [pa.array([len(kept)]), pa.array([_packed(kept.tobytes())], pa.binary()), pa.array([_squeezed(rank[tokens.indices.to_numpy()], "<u4")], pa.binary())]
                del tokens, data, begin, order, rank, kept
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([side]), ids, pa.array([sizes.astype(np.int32)]), *packed], [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])
                block += 1
            freed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    return written(rows.mapInArrow(run, BLOCK_SCHEMA), "lm_blocks")


class Block:
    """A block's tokens, and its distinct bigrams."""

    def __init__(self, row: dict) -> None:
        self.block, self.held = row["block"], row["held"]
        self.doc_ids, self.sizes = row["doc_ids"], np.array(row["sizes"], dtype=np.int64)
        #: The block's distinct words, by their hashes, as lines.
        self.data = np.frombuffer(_unpacked(row["vocabulary"], row["vocabulary_size"]), dtype=np.uint8)
        self.begin = np.concatenate([[0], np.flatnonzero(self.data == 10) + 1])
        self.hashes = word_hashes(self.data, self.begin[:-1], self.begin[1:] - 1)
        self.number = _expanded(row["tokens"], int(self.sizes.sum()), "<u4").astype(np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        self.context = np.concatenate([[0], self.number[:-1]])
        #: A document begins after an end, so its first token's context is the end token.
        self.context[first] = int(np.flatnonzero(np.diff(self.begin) == 1)[0])
        self.first = first
        grams = mixed(self.hashes[self.context] * ODD + self.hashes[self.number]) >> _BIGRAM_BITS
        self.grams, self.gram = np.unique(grams, return_inverse=True)


def rows_of(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one, binary values as buffers of the table."""
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        for k in range(batch.num_rows):
            yield {n: (c[k].as_buffer() if c[k].is_valid else b"") if pa.types.is_binary(c.type) else c[k].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def occupied(*places: np.ndarray) -> np.ndarray:
    """The parts that some of a block's entries fall in, by the places of the parts' edges."""
    return np.flatnonzero(np.any([np.diff(p) > 0 for p in places], axis=0))


def _counts(where: np.ndarray, n: int, held: bool) -> np.ndarray:
    return np.zeros(n, dtype=np.int64) if held else np.bincount(where, minlength=n)


def counted(of: DataFrame, parts: int) -> DataFrame:
    """Per block and part, the training counts of the block's distinct tokens and bigrams, in its order.

    Also one row per part without a block: its training tokens and distinct ones.
    """

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                b = Block(row)
                c1, c2 = _counts(b.number, len(b.hashes), b.held), _counts(b.gram, len(b.grams), b.held)
                at1 = np.searchsorted(b.hashes >> _BIGRAM_BITS, edges)
                at2 = np.searchsorted(b.grams, edges)
                out = []
                for p in occupied(at1, at2).tolist():
                    h2 = b.grams[at2[p] : at2[p + 1]]
                    said = b.data[b.begin[at1[p]] : b.begin[at1[p + 1]]]
                    counts = np.concatenate([c1[at1[p] : at1[p + 1]], c2[at2[p] : at2[p + 1]]])
                    out.append((p, b.block, b.held, int(at1[p + 1] - at1[p]), len(h2), _packed(said.tobytes()), len(said), _squeezed(np.diff(h2, prepend=np.uint64(0)), "<u8"), b"" if b.held else _squeezed(counts, "<u4")))
                for lo in range(0, len(out), 64):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out[lo : lo + 64]], schema=asked)
                del b, c1, c2, out
                freed()

    edges = np.array([i * (1 << 52) // parts for i in range(parts + 1)], dtype=np.uint64)
    names = [x.split()[0] for x in ASKED_SCHEMA.split(", ")]
    asked = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("held", pa.bool_()), ("n1", pa.int32()), ("n2", pa.int32()), ("words", pa.binary()), ("size", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
    answered = pa.schema([("block", pa.int64()), ("held", pa.bool_()), ("part", pa.int32()), ("n1", pa.int32()), ("n2", pa.int32()), ("counts", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])

    def add(table: pa.Table) -> pa.Table:
        rows = []
        said, hashes, counts = [], [], []
        for r in rows_of(table):
            said.append(_unpacked(r["words"], r["size"]))
            hashes.append(np.cumsum(_expanded(r["hashes"], r["n2"], "<u8"), dtype=np.uint64))
            c = _expanded(r["counts"], r["n1"] + r["n2"], "<u4") if r["counts"] else np.zeros(r["n1"] + r["n2"], dtype=np.uint32)
            counts.append((c[: r["n1"]], c[r["n1"] :]))
            rows.append({k: r[k] for k in ("part", "block", "held", "n1", "n2")})
        answers, stats = [], (0, 0)
        found = _lines(np.frombuffer(b"".join(said), dtype=np.uint8)).dictionary_encode()
        kinds = ((len(found.dictionary), found.indices.to_numpy()), np.unique(np.concatenate(hashes), return_inverse=True))
        for side, (distinct, where) in enumerate(kinds):
            n = distinct if side == 0 else len(distinct)
            #: Sums in doubles: whole numbers up to 2^53 are exact there.
            total = np.bincount(where, weights=np.concatenate([c[side] for c in counts]), minlength=n).astype(np.int64)
            if side == 0:
                stats = (int(total.sum()), int((total > 0).sum()))
            answers.append(np.split(total[where], np.cumsum([len(c[side]) for c in counts])[:-1]))
        out = [{"block": r["block"], "held": r["held"], "part": r["part"], "n1": r["n1"], "n2": r["n2"], "counts": _squeezed(np.concatenate([a, b]), "<u8"), "total": 0, "distinct": 0} for r, a, b in zip(rows, *answers)]
        del said, hashes, counts, found, kinds, answers
        freed()
        out.append({"block": None, "held": None, "part": rows[0]["part"], "n1": 0, "n2": 0, "counts": b"", "total": stats[0], "distinct": stats[1]})
        return pa.Table.from_pylist(out, schema=answered)

    return written(of.mapInArrow(ask, ASKED_SCHEMA).groupBy("part").applyInArrow(add, COUNTED_SCHEMA), "lm_counts")


def _answers(b: Block, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training counts of each token, of its context, and of both together."""
    c1, c2 = [], []
    for r in sorted(rows_of(table.select(["part", "n1", "n2", "counts"])), key=lambda r: r["part"]):
        c = _expanded(r["counts"], r["n1"] + r["n2"], "<u8").astype(np.int64)
        c1.append(c[: r["n1"]])
        c2.append(c[r["n1"] :])
    single, double = np.concatenate(c1), np.concatenate(c2)
    return single[b.number], single[b.context], double[b.gram]


def _estimates(cw: np.ndarray, ch: np.ndarray, chw: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, bigram, unigram), as ratios to the uniform estimate."""
    uniform = distinct + 1
    bucket = np.minimum(np.floor(np.log2(ch + 1)).astype(np.int64), BUCKETS - 1)
    return bucket, chw / np.maximum(ch, 1) * uniform, cw / max(total, 1) * uniform


def weights(histogram: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Mixture weights per bucket (bigram, unigram, uniform), by expectation-maximisation.

    histogram: rows of bucket, bin of the bigram ratio, bin of the unigram ratio, tokens; bin 0: ratio 0.
    """
    out = np.tile(np.array(DEFAULT), (BUCKETS, 1))
    if not len(histogram):
        return out

    def ratio(b: np.ndarray) -> np.ndarray:
        return np.where(b == 0, 0.0, np.exp2((b - 1000) / STEPS))

    bucket, n = histogram[:, 0], histogram[:, 3].astype(np.float64)
    parts = np.stack([ratio(histogram[:, 1]), ratio(histogram[:, 2]), np.ones(len(n))], axis=1)

    def learned(start: np.ndarray, rows: np.ndarray) -> np.ndarray:
        w = start
        for _ in range(rounds):
            post = parts[rows] * w
            w = ((post / post.sum(axis=1, keepdims=True)) * n[rows, None]).sum(axis=0) / n[rows].sum()
            w = np.maximum(w, 1e-6)
            w /= w.sum()
        return w

    pooled = learned(out[0], np.arange(len(n)))
    for b in range(BUCKETS):
        rows = np.flatnonzero(bucket == b)
        out[b] = learned(pooled, rows) if len(rows) else pooled
    return out


def train_weights(of: DataFrame, counts: DataFrame, total: int, distinct: int) -> np.ndarray:
    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        bins = []
        for row in rows_of(left):
            cw, ch, chw = (c - 1 for c in _answers(Block(row), right))  # each token's own occurrence taken out
            bucket, two, one = _estimates(cw, ch, np.minimum(chw, ch), total - 1, distinct)
            scaled = [np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-300)) * STEPS).astype(np.int64) + 1000, 0) for x in (two, one)]
            key, n = np.unique((bucket * 4096 + scaled[0]) * 4096 + scaled[1], return_counts=True)
            bins.append(pa.table({"bucket": key >> 24, "two": key >> 12 & 4095, "one": key & 4095, "n": n}))
            del cw, ch, chw, bucket, two, one, scaled
            freed()
        return pa.concat_tables(bins) if bins else pa.schema([(c, pa.int64()) for c in ("bucket", "two", "one", "n")]).empty_table()

    training = of.filter("not held").groupBy("block").cogroup(counts.filter("not held").groupBy("block"))
    rows = training.applyInArrow(tally, "bucket long, two long, one long, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    got = np.array([tuple(r) for r in rows.collect()], dtype=np.int64).reshape(-1, 4)
    return weights(got[np.lexsort(got.T[::-1])])


def scores(docs: DataFrame, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs."""
    of = blocks(docs)
    tokens = of.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    counts = counted(of, max(8, -(-tokens // part_tokens)))
    total, distinct = counts.agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = total or 0, distinct or 0
    counts = counts.filter("block is not null")
    mixture = train_weights(of, counts, total, distinct)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in rows_of(left):
            b = Block(row)
            cw, ch, chw = _answers(b, right)
            bucket, two, one = _estimates(cw, ch, chw, total, distinct)
            w = mixture[bucket]
            p = (w[:, 0] * two + w[:, 1] * one + w[:, 2]) / (distinct + 1)
            base = np.log10((cw + 1) / (total + distinct + 1))
            sums = [np.add.reduceat(x, b.first) for x in (base, np.log10(p), (cw > 0).astype(np.int64))]
            out.append(pa.table({"doc_id": pa.array(b.doc_ids, pa.int64()), "held_out": np.full(len(b.doc_ids), b.held), "n_tokens": b.sizes, "n_known": sums[2], "base_score": sums[0], "score": sums[1]}))
            del b, cw, ch, chw, bucket, two, one, w, p, base, sums
        freed()
        return pa.concat_tables(out) if out else scored.empty_table()

    scored = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    rows = of.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(score, SCORE_SCHEMA)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
