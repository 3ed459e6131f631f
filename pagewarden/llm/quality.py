"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is put into quantile bins; the score is a sum of one table entry per feature and
one per chosen pair of features, through a logistic. Tables are learned by cyclic boosting: round after
round, each feature in turn gets a small tree (at most three leaves) fitted to the gradients, added with
a low rate. Then the pairs whose coarse grid explains most of what is left are boosted in the same way.
Scoring a batch is one bin lookup and one addition per table.

Fitting takes at most `max_train` labelled rows (those with the smallest hash of their doc_id), joined
to the documents as a broadcast of that size; everything else is one pass over all documents.

Features come from the text alone. A null or empty text has all-zero features and a score like any
other. Labels that are null are left out; of several labels of one doc_id the largest counts, and of
several texts the one of the smallest features. Without labels of both kinds the score is their share of
1 (0.5 without any). Repeated rows are scored each. A null doc_id stays null, is not held out and has no
label. A very long text is a unit of its own: its worker holds about thirty times its bytes. An empty
table gives no rows. Extra columns are ignored (scored) or passed through (filtered).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm._text import VISIBLE, bounded_batches, flat, texts, units, word_hashes, words

MAX_TRAIN = 20_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

_IS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "lower": np.isin(np.arange(256), np.arange(97, 123)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "bang": np.arange(256) == 33,
    "bar": np.arange(256) == 124,
    "symbol": np.isin(np.arange(256), np.frombuffer(b"#$%&*@^~<>{}[]\\_=+", dtype=np.uint8)),
    "stop": np.isin(np.arange(256), np.frombuffer(b".,;:?", dtype=np.uint8)),
    "line": np.arange(256) == 10,
    "wide": np.arange(256) >= 128,
}
_NOT_LINE = np.arange(256) != 10
FEATURES = [*(f"{k}_share" for k in _IS), "bang_n", "bar_n", "symbol_n", "bytes", "words", "word_length", "word_spread", "repeat_share", "repeat_n", "distinct_share", "top_share", "line_length", "line_repeat", "caps_share", "caps_n", "longest_word"]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over [ends[i], ends[i + 1])."""
    out = np.zeros(len(ends) - 1, dtype=np.float64)
    some = np.flatnonzero(ends[1:] > ends[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, ends[:-1][some], dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    return out


def _repeats(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct items, and the count of the most frequent."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(first))
    both = np.sort((row << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct, most = np.zeros(rows), np.zeros(rows)
    if len(both):
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        of = (both[new] >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(of, minlength=rows).astype(np.float64)
        np.maximum.at(most, of, np.diff(np.append(new, len(both))))
    return distinct, most


def features_of(strings: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    data, ends = flat(strings)
    size = np.maximum(np.diff(ends), 1)
    start, end, first = words(data, ends, VISIBLE)
    n_words = np.diff(first)
    n = np.maximum(n_words, 1)
    counts = {k: _sums(mask[data].view(np.uint8), ends) for k, mask in _IS.items()}
    length = end - start
    mean = _sums(length, first) / n
    spread = np.sqrt(np.maximum(_sums((length * length).astype(np.float64), first) / n - mean * mean, 0))
    hashes = word_hashes(data, start, end)
    same = np.zeros(len(hashes), dtype=np.uint8)
    same[1:] = hashes[1:] == hashes[:-1]
    inner = first[:-1]
    same[inner[inner < len(same)]] = 0
    repeats = _sums(same, first)
    distinct, most = _repeats(hashes, first)
    upper = np.concatenate([[0], np.cumsum(_IS["upper"][data])])
    lower = np.concatenate([[0], np.cumsum(_IS["lower"][data])])
    caps = _sums(((upper[end] - upper[start] >= 2) & (lower[end] == lower[start])).view(np.uint8), first)
    l_start, l_end, l_first = words(data, ends, _NOT_LINE)
    lines = np.maximum(np.diff(l_first), 1)
    l_distinct, _ = _repeats(word_hashes(data, l_start, l_end), l_first)
    longest = np.zeros(len(n))
    np.maximum.at(longest, np.repeat(np.arange(len(n)), n_words), length)
    columns = [
        *(c / size for c in counts.values()),
        *(np.log1p(counts[k]) for k in ("bang", "bar", "symbol")),
        np.log1p(np.diff(ends)), np.log1p(n_words), mean, spread, repeats / n, np.log1p(repeats), distinct / n, most / n, np.log1p(size / lines), 1 - l_distinct / lines, caps / n, np.log1p(caps), np.log1p(longest),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Additive:
    """An additive model: cuts and a table for each feature, and tables for pairs."""

    prior: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, f], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values per bin of a tree over ordered bins that splits where the gain is largest."""
    spans = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(spans) < leaves:
        best = (1e-9, None, 0)
        for s, (lo, hi) in enumerate(spans):
            if hi - lo < 2:
                continue
            gl, hl = cg[lo + 1 : hi] - cg[lo], ch[lo + 1 : hi] - ch[lo]
            gr, hr = cg[hi] - cg[lo] - gl, ch[hi] - ch[lo] - hl
            gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1), 0)
            if gain.max() > best[0]:
                best = (gain.max(), s, lo + 1 + int(gain.argmax()))
        if best[1] is None:
            break
        lo, hi = spans.pop(best[1])
        spans += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in spans:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 120, rate: float = 0.15, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 60, least: float = 3.0) -> Additive:
    """Cyclic boosting of single features, then of the pairs that explain most of the rest."""
    n, width = x.shape if x.ndim == 2 else (0, len(FEATURES))
    if not n or y.min() == y.max():
        share = float(y.mean()) if n else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Additive(prior=float(np.log(share / (1 - share))))
    share = y.mean()
    model = Additive(prior=float(np.log(share / (1 - share))), cuts=[_quantiles(x[:, f], bins) for f in range(width)])
    at = [np.searchsorted(model.cuts[f], x[:, f], "right") for f in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(n, model.prior)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            g, h = gradients()
            m = len(model.tables[f])
            step = rate * _tree(np.bincount(at[f], g, m), np.bincount(at[f], h, m), 3, least)
            model.tables[f] += step
            total += step[at[f]]
    model.pair_cuts = [_quantiles(x[:, f], pair_bins) for f in range(width)]
    coarse = [np.searchsorted(model.pair_cuts[f], x[:, f], "right") for f in range(width)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def grid(a: int, b: int, weights: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], weights, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = gradients()
    gains = {(a, b): float((grid(a, b, g) ** 2 / (grid(a, b, h) + 5)).sum()) for a in range(width) for b in range(a + 1, width)}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:pairs]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = gradients()
            gg, hh = grid(a, b, g), grid(a, b, h)
            rows = _tree(gg.sum(axis=1), hh.sum(axis=1), 2, least)  # the first split, by a; then b within each side
            step = np.zeros_like(table)
            for side in np.unique(rows):
                of = rows == side
                step[of] = rate * _tree(gg[of].sum(axis=0), hh[of].sum(axis=0), 2, least)
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Additive:
    """Fit on at most max_train labelled documents that are not held out."""
    bounded_batches(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            x = features_of(texts(unit))
            yield pa.RecordBatch.from_arrays([unit.column("doc_id"), unit.column("quality"), *(pa.array(x[:, f]) for f in range(x.shape[1]))], ["doc_id", "quality", *FEATURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = rows.mapInArrow(run, "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *FEATURES)).alias("r")).select("doc_id", "r.*")  # at most max_train rows
    got = one.toPandas().sort_values("doc_id")
    return fit(got[FEATURES].to_numpy(dtype=np.float64), got["quality"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            yield pa.RecordBatch.from_arrays([unit.column("doc_id"), pa.array(sent.value.score(features_of(texts(unit))))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            yield unit.filter(pa.array(sent.value.score(features_of(texts(unit))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
