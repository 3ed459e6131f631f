"""Token ids as Parquet lists: dictionary or delta encoded, in bounded row groups, with page indexes.

`write_tokens` encodes whole texts and writes one row per document, in ascending doc_id order over all
files: doc_id, part, at (ids before it within its file), n_tokens, ids. Metadata columns and the list
column are separate column chunks, so a reader that wants only counts never touches the ids, and the
page index (with sorted doc_ids) lets a lookup of a few documents skip the pages of all others.

A null text counts as empty. Repeated rows stay, each with its own ids; rows of one doc_id are ordered
by a hash of their text. A null doc_id stays null and stands before all others. A very long text is a
unit of its own: its worker holds about thirty times its bytes, and its ids are one list. An empty table
gives no rows. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewarden.llm._shared import dropped_at_exit, new_path
from pagewarden.llm._text import bounded_batches, texts, units
from pagewarden.llm._tokens import default_path, encoder

END_ID = 2
#: Bytes of text encoded at once, beside the rows of the sort and the writer's pages.
UNIT_BYTES = 8 << 20
FILE_SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"


def with_last(ids: np.ndarray, ends: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the id `last` to each row's ids."""
    n = len(ends) - 1
    out = np.full(len(ids) + n, last, dtype=np.uint32)
    rows = np.repeat(np.arange(n), np.diff(ends))
    out[np.arange(len(ids)) + rows] = ids
    return out, ends + np.arange(n + 1)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_rows: int = 2000) -> None:
    """Encode and write. encoding: "dictionary", or "delta" (DELTA_BINARY_PACKED pages)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    vocabulary = vocabulary or default_path()
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for unit in units(batches, limit=UNIT_BYTES):
            ids, ends = with_last(*encoder(vocabulary).encode(texts(unit)), end_id)
            for lo in range(0, unit.num_rows, 500):
                hi = min(lo + 500, unit.num_rows)
                lists = pa.ListArray.from_arrays(pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), pa.array(ids[ends[lo] : ends[hi]].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([unit.column("doc_id").slice(lo, hi - lo), pa.array(np.full(hi - lo, part, dtype=np.int32)), pa.array(before + ends[lo:hi]), pa.array(np.diff(ends[lo : hi + 1])), lists], ["doc_id", "part", "at", "n_tokens", "ids"])
            before += int(ends[-1])

    (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(encode, FILE_SCHEMA)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "v2")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_tokens; select only what is needed, and only that is read."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, part_start): ids in all files before. One row per file, so small enough to broadcast."""
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, as read back from the files."""
    bounded_batches(spark)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            ends = np.asarray(lists.offsets)
            ids = np.asarray(lists.values).astype("<u4", copy=False).data
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("at"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "part", "at", "ids").mapInArrow(digest, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(token_starts(spark, path)), "part").select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token_files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    dropped_at_exit(spark, path)
    return token_digest(spark, path)
