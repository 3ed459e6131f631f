"""License scan by diagonal voting.

All rolling k-grams of a document's words are hashed and joined to the positions of the same grams in
license templates; a pair that meets is compared word by word in bytes. Each match votes for a diagonal
(document position less template position); votes are aggregated per diagonal, and diagonals at most
`gap` apart are merged into one span (words inserted or missing shift a span by a few). A span is
verified if the template's words that its matches cover, each counted once, are enough of the template,
and if it is not much longer than the template. Templates may have any length. The template table is as
large as the templates given and does not grow with the documents: below `small` rows the join is a
broadcast one and no gram is shuffled, above it the grams are shuffled by their hash.

Base labels: places where a phrase's words stand consecutively. Words are
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.

A null text counts as empty: no words, no labels, score 0. Rows are known by doc_id and a digest of the
text, so a task that runs again names them alike; equal rows are scanned each, counted, and returned as
often as they came. A null doc_id stays null. A very long text is a unit of its own: its worker holds
about sixty times its bytes. An empty table gives no rows. Columns besides doc_id and text are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewarden.llm._text import ALNUM, LOWER, bounded_batches, flat, gram_hashes, same_spans, texts, units, word_hashes, words

K, GAP, COVER, STRETCH = 3, 2, 0.7, 1.5
#: The phrases of the base labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices that name common licenses, and the texts or openings of short ones.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
)
#: Template rows up to which the table is broadcast.
SMALL = 200_000


def _numbered(phrases: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, end, first, hashes) of the words of all phrases."""
    data, ends = flat(pa.array(phrases, pa.string()))
    data = LOWER[data]
    start, end, first = words(data, ends, ALNUM)
    return data, start, end, first, word_hashes(data, start, end)


def template_rows(templates: Iterable[tuple[str, str]] = TEMPLATES, k: int = K) -> list[tuple[int, bytearray, int, int, str, int]]:
    """(gram, its words, template, position, label, words in the template)."""
    templates = list(templates)
    data, start, end, first, hashes = _numbered([t for _, t in templates])
    out = []
    for i, (label, _) in enumerate(templates):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo < k:
            raise ValueError(f"template {i} has {hi - lo} words")
        said = [data[start[j] : end[j]].tobytes() for j in range(lo, hi)]
        out += [(int(g), bytearray(b" ".join(said[p : p + k])), i, p, label, hi - lo) for p, g in enumerate(gram_hashes(hashes[lo:hi], k).view(np.int64))]
    return out


SCAN_SCHEMA = "doc_id long, row binary, n_words long, n_base long, first_word long, last_word long, base array<string>, plain binary, begins array<int>, grams array<long>"


def scan_words(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row: a digest that names it, words, base labels, the words joined by spaces and where each begins, and the hashes of all grams behind a leading 0."""
    bounded_batches(docs.sparkSession)
    phrases = _numbered([p for p, _ in PHRASES])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p_data, p_start, p_end, p_first, p_hashes = phrases
        for unit in units(batches):
            own = texts(unit)
            data, ends = flat(own)
            data = LOWER[data]
            start, end, first = words(data, ends, ALNUM)
            hashes = word_hashes(data, start, end)
            rows, n = unit.num_rows, np.diff(first)
            count, low, high = np.zeros(rows, dtype=np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1, dtype=np.int64)
            labels: list[list[str]] = [[] for _ in range(rows)]
            for i, (_, label) in enumerate(PHRASES):
                said = np.arange(p_first[i], p_first[i + 1])
                at = np.flatnonzero(hashes == p_hashes[said[0]])
                at = at[at + len(said) <= len(hashes)]
                for j, w in enumerate(said):
                    at = at[hashes[at + j] == p_hashes[w]]
                    w = np.full(len(at), w)
                    at = at[same_spans(data, start[at + j], end[at + j], p_data, p_start[w], p_end[w])]
                of = np.searchsorted(first, at, "right") - 1
                inside = at + len(said) <= first[of + 1]
                at, of = at[inside], of[inside]
                np.add.at(count, of, 1)
                np.minimum.at(low, of, at - first[of])
                np.maximum.at(high, of, at - first[of])
                for r in np.unique(of).tolist():
                    labels[r].append(label)
            none = count == 0
            ids = unit.column("doc_id").to_pylist()
            named = [hashlib.blake2b(repr(i).encode() + b" " + t.as_buffer().to_pybytes(), digest_size=16).digest() for i, t in zip(ids, own)]
            columns = [pa.array(named, pa.binary()), pa.array(n), pa.array(count), pa.array(low, mask=none), pa.array(high, mask=none), pa.array(labels, pa.list_(pa.string()))]
            # The words of all rows, each with a space after it.
            size = end - start + 1
            begin = np.concatenate([[0], np.cumsum(size)])
            plain = np.full(int(begin[-1]), 32, dtype=np.uint8)
            within = np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
            plain[np.repeat(begin[:-1], size - 1) + within] = data[np.repeat(start, size - 1) + within]
            bounds = begin[first]
            grams = gram_hashes(hashes, k).view(np.int64)
            many = np.maximum(n - k + 1, 0)
            list_ends = np.concatenate([[0], np.cumsum(many + 1)])
            values = np.zeros(list_ends[-1], dtype=np.int64)
            of = np.repeat(np.arange(rows), many)
            within = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            values[list_ends[of] + 1 + within] = grams[first[of] + within] if len(of) else 0
            starts = (begin[:-1] - np.repeat(bounds[:-1], n)).astype(np.int32)
            for lo in range(0, rows, 500):
                hi = min(lo + 500, rows)
                said = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((bounds[lo : hi + 1] - bounds[lo]).astype(np.int32)), pa.py_buffer(plain[bounds[lo] : bounds[hi]])])
                places = pa.ListArray.from_arrays(pa.array((first[lo : hi + 1] - first[lo]).astype(np.int32)), pa.array(starts[first[lo] : first[hi]]))
                lists = pa.ListArray.from_arrays(pa.array((list_ends[lo : hi + 1] - list_ends[lo]).astype(np.int32)), pa.array(values[list_ends[lo] : list_ends[hi]]))
                yield pa.RecordBatch.from_arrays([unit.column("doc_id").slice(lo, hi - lo), *(c.slice(lo, hi - lo) for c in columns), said, places, lists], [x.split()[0] for x in SCAN_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCAN_SCHEMA)


def license_spans(votes: DataFrame, carried: Iterable[str] = (), k: int = K, gap: int = GAP, cover: float = COVER, stretch: float = STRETCH) -> DataFrame:
    """From votes (row, template, label, size, pos, at), each once: spans with the share of the template that they cover.

    carried: columns kept by their largest value; rows without a template give one span without a share.
    All windows are by row, so votes dealt by row are not shuffled again.
    """
    names = list(carried)
    key = ["row", "template", "label", "size"]
    kept = [F.max(c).alias(c) for c in names]
    w = Window.partitionBy("row", "template").orderBy("diagonal", "pos")
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("at"))
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > gap).cast("int"), F.lit(0))
    spans = votes.withColumn("span", new).withColumn("span", F.sum("span").over(w))
    places = spans.groupBy(*key, "span", "at").agg(F.count("template").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), *kept)
    step = F.col("at") - F.lag("at").over(Window.partitionBy("row", "template", "span").orderBy("at"))
    places = places.withColumn("covered", F.least(F.coalesce(step, F.lit(k)), F.lit(k)))  # template words that no earlier match covers
    spans = places.groupBy(*key, "span").agg(F.sum("votes").alias("votes"), F.sum("covered").alias("covered"), F.min("first").alias("first"), F.max("last").alias("last"), *kept)
    share = F.when(F.col("template").isNotNull(), F.col("covered") / F.col("size"))
    length = F.col("last") + k - F.col("first")
    spans = spans.select("row", *names, "template", "label", "size", "votes", "first", (F.col("last") + k).alias("end"), share.alias("share"), ((share >= cover) & (length <= F.col("size") * stretch)).alias("fits"))
    # Of verified spans that overlap, the one that covers most of its template counts.
    by = Window.partitionBy("row").orderBy("first", "end", "template", "size")
    reached = F.max(F.when(F.col("fits"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("island", F.coalesce((F.col("first") >= reached).cast("int"), F.lit(0))).withColumn("island", F.sum("island").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct("share", "size")
    best = F.max(F.when(F.col("fits"), rank)).over(Window.partitionBy("row", "island"))
    return spans.withColumn("verified", F.col("fits") & (rank == best)).drop("island", "fits", "size")


def find_licenses(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, k: int = K, small: int = SMALL) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    rows = template_rows(templates, k)
    table = spark.createDataFrame(rows, "gram long, said binary, template int, at int, label string, size int")
    if len(rows) <= small:
        table = F.broadcast(table)
    base = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    grams = scan_words(docs, k).select("row", *base, "plain", "begins", F.posexplode("grams").alias("place", "gram"))
    # Where a row has fewer than k words, its one place is 0; a gram's words end before the space after its last one.
    begin = F.get("begins", F.col("place") - 1)
    end = F.coalesce(F.get("begins", F.col("place") - 1 + k), F.octet_length("plain")) - 1
    met = grams.join(table, "gram", "left").filter((F.col("place") == 0) | (F.col("template").isNotNull() & (F.col("said") == F.substring("plain", begin + 1, end - begin))))
    # One exchange, by row: matches, and for each document its leading row. All that follows stays within it.
    met = met.select("row", *(F.when(F.col("place") == 0, F.col(c)).alias(c) for c in base), (F.col("place") - 1).alias("pos"), *(F.when(F.col("place") > 0, F.col(c)).alias(c) for c in ("template", "at", "label", "size")))
    key = ["row", "pos", "template", "at", "label", "size"]
    met = met.repartition("row").groupBy(*key).agg(*(F.max(c).alias(c) for c in base), F.count("*").alias("times"))  # equal rows vote once
    spans = license_spans(met.withColumn("times", F.when(F.col("template").isNull(), F.col("times"))), [*base, "times"], k)
    spans = spans.groupBy("row").agg(*(F.max(c).alias(c) for c in [*base, "times"]), F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("found"), F.max("share").alias("share"))
    spans = spans.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    say = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return spans.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        say(F.col("base")).alias("base_labels"), say(F.concat("base", "found")).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
