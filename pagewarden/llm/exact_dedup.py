"""Exact duplicates by deterministic naming of blocks, in DataFrame operations only.

A text (A-Z lower-cased, in UTF-8) is split into blocks of fixed size. The distinct blocks of the whole
corpus, sorted by (hash, block), get integer names: equal names mean equal blocks, whatever the hashes
do, because blocks are grouped by their full bytes and a hash that two blocks share gives them two
names. Then pairs of adjacent names are sorted and named in the same way, level by level, until every
document has one name. Names depend on the set of blocks only, so a recomputed task gives the same.

Only the first grouping moves text, pre-aggregated in each task, so a text that a third of all rows
share crosses once per task. All later steps move integers; joins are on plain exchanges that adaptive
execution may split where a name is hot.

A null text counts as empty (one empty block). Rows are treated one by one: repeated rows of one doc_id
are each returned, and counted, and stay or go together. Rows of a null doc_id are returned and counted
too; they stay only where no equal text has an id (keep_id is null there). Very long texts are more
blocks. An empty table gives no rows. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewarden.llm._shared import written

BLOCK_BYTES = 16 << 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHIFT = 1 << 40
#: Blocks or pairs to a naming window, about; windows are 1,024 at least.
_WINDOW = 50_000


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null as empty. lower() is the same for ASCII, and faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def blocks_of(normal: Column, size: int) -> Column:
    """The blocks of a text as an array of binary; an empty text has one empty block."""
    data = normal.cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(size)).cast("int"))
    return F.when(F.octet_length(data) <= size, F.array(data)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * size + 1, F.lit(size))))


def _buckets(n: int) -> int:
    """A power of two of naming windows for n keys."""
    return 1 << max(10, (n // _WINDOW).bit_length())


def _named(keys: DataFrame, bucket: Column, *by: str) -> DataFrame:
    """Distinct keys with integer names: sorted within buckets that the keys alone decide."""
    keys = keys.withColumn("bucket", bucket)
    return keys.withColumn("name", F.col("bucket") * F.lit(_SHIFT) + F.row_number().over(Window.partitionBy("bucket").orderBy(*by))).drop("bucket")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, no_id, text_sha256, level, name) per row: equal (level, name), equal normalised text. no_id: doc_id is null, and 0 here."""
    normal = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").cast("long").isNull().alias("no_id"), normalised(F.col("text")).alias("normal"))
    block = normal.select(F.explode(blocks_of(F.col("normal"), block_bytes)).alias("block")).select(F.xxhash64("block").alias("h"), "block")
    heads = written(block.distinct().groupBy("h").agg(F.count("*").alias("n")), "block_hashes")

    rows = normal.select("doc_id", "no_id", F.sha2("normal", 256).alias("text_sha256"), F.posexplode(blocks_of(F.col("normal"), block_bytes)).alias("pos", "block"))
    rows = rows.select("doc_id", "no_id", "text_sha256", "pos", F.xxhash64("block").alias("h"), "block")
    shared = heads.filter("n > 1").select("h")
    if shared.isEmpty():
        rows, sorted_blocks = rows.withColumn("r", F.lit(0)).drop("block"), heads.select("h", F.lit(0).alias("r"))
    else:  # blocks that differ under one hash: told apart by their bytes
        apart = block.join(shared, "h", "left_semi").distinct().withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("block")))
        rows = rows.join(apart, ["h", "block"], "left").withColumn("r", F.coalesce("r", F.lit(0))).drop("block")
        sorted_blocks = heads.filter("n = 1").select("h", F.lit(0).alias("r")).union(apart.select("h", "r"))
    buckets = _buckets(heads.count())
    names = _named(sorted_blocks, F.shiftrightunsigned("h", 64 - (buckets.bit_length() - 1)), "h", "r")
    key = ["doc_id", "no_id", "text_sha256"]
    rows = written(rows.join(names, ["h", "r"]).select(*key, "pos", "name"), "named_blocks")

    whole = rows.groupBy(*key).agg(F.max("pos").alias("top"), F.min("name").alias("name"))  # distinct documents
    done = whole.filter("top = 0").select(*key, F.lit(0).alias("level"), "name")
    rest = rows.join(whole.filter("top > 0").select(*key), key, "left_semi").distinct()
    level, (top, inner) = 0, rows.agg(F.coalesce(F.max("pos"), F.lit(0)), F.count_if(F.col("pos") > 0)).first()
    while top > 0:
        level, top = level + 1, top // 2
        place = F.col("pos") % 2
        pairs = rest.groupBy(*key, F.floor(F.col("pos") / 2).cast("int").alias("at")).agg(F.max(F.when(place == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(place == 1, F.col("name"))), F.lit(-1)).alias("b"))
        names = _named(pairs.select("a", "b").distinct(), F.pmod(F.xxhash64("a", "b"), F.lit(_buckets(inner >> (level - 1)))), "a", "b")
        rest = written(pairs.join(names, ["a", "b"]).select(*key, F.col("at").alias("pos"), "name"), "named_pairs")
        ended = rest.groupBy(*key).agg(F.max("pos").alias("top"), F.min("name").alias("name")).filter("top = 0")
        done = done.union(ended.select(*key, F.lit(level).alias("level"), "name"))
        rest = rest.join(ended.select(*key), key, "left_anti")
    return rows.filter("pos = 0").select(*key).join(done, key)


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    names = written(identities(docs, block_bytes), "identities")
    groups = written(names.groupBy("level", "name").agg(F.max(F.when(~F.col("no_id"), F.col("doc_id"))).alias("keep_id"), F.count("*").alias("group_size")), "groups")
    own = F.when(~F.col("no_id"), F.col("doc_id"))
    return names.join(groups, ["level", "name"]).select(own.alias("doc_id"), "keep_id", "group_size", own.eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS normal FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(normal) AS text_sha256
FROM n WINDOW w AS (PARTITION BY normal)
"""
