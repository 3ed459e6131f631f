"""Importance resampling towards a target: documents drawn by hashed n-gram weights and Gumbel noise.

All in DataFrame operations. Words are exploded beside their two successors, the up to three n-grams that
begin at a word are exploded again, and each falls into a bucket by crc32. Bucket counts of the corpus and
of the target give a gain per bucket (a table of at most `buckets` rows, so it is broadcast), and the
gains of a document's features add up to its weight. Both generators run inside code generation, so
n-grams are never written or shuffled: counts leave a task as one row per bucket, sums as one per document.

Ranks need no window over all rows: distinct documents are dealt by range of (score, doc_id, text), summed
per range, and each range's ranks begin where those before it end. The ranges' sums are one row each.

A row is known by doc_id and text, repeated rows by how often their first word was seen: they are ranked
once, and the ranks of the copies follow each other. So no id or text that a third of all rows share
makes a large group. A null text has no words. A null doc_id is hashed as an empty one and comes last
among ties; ties of one doc_id go by the text's digest. A very long text is one array of words in its
task, about sixty times its bytes. An empty table gives no rows, an empty target the weights of its
missing counts. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewarden.llm._shared import written
from pagewarden.llm.exact_dedup import LOWER, UPPER, normalised

BUCKETS, ORDER, SEED = 10_000, 3, 42
LEAST_WORDS, PERCENT = 20, 5
#: Copies of one row that one task writes.
_COPIES = 4096


def words_of(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    spaced = F.trim(F.regexp_replace(normalised(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _grams(words: Column, order: int) -> Column:
    """Per word, the word and those that follow it: columns w1, w2, ..., null beyond the end."""
    n = F.greatest(F.size(words), F.lit(1))
    return F.arrays_zip(words.alias("w1"), *(F.slice(words, k + 1, n).alias(f"w{k + 1}") for k in range(1, order)))


def _bucket(order: int, buckets: int) -> Column:
    """The buckets of the n-grams that begin at a word; null where there is no such n-gram."""
    text, out = F.col("w1"), []
    for k in range(1, order + 1):
        out.append((F.crc32(text.cast("binary")) % buckets).cast("int"))
        text = F.concat(text, F.lit(" "), F.col(f"w{k + 1}")) if k < order else text
    return F.array(*out)


def features(docs: DataFrame, *keys: str, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(*keys, first, bucket): one row per feature, of null bucket where a text has none; first: a text's first one."""
    rows = docs.select(*keys, words_of(F.col("text")).alias("words"))
    rows = rows.select(*keys, F.posexplode_outer(_grams(F.col("words"), order)).alias("at", "gram"))
    rows = rows.select(*keys, F.coalesce("at", F.lit(0)).alias("at"), *(F.col(f"gram.w{k}").alias(f"w{k}") for k in range(1, order + 1)))
    rows = rows.select(*keys, "at", F.posexplode(_bucket(order, buckets)).alias("n", "bucket"))
    return rows.filter("n = 0 or bucket is not null").select(*keys, (F.expr("at = 0 and n = 0")).alias("first"), "bucket")


def gains(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that docs fill: how much likelier the target has a feature there, in thousandths of e-folds."""

    def counts(of: DataFrame, name: str) -> DataFrame:
        return of.transform(features, order=order, buckets=buckets).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))

    both = written(counts(docs.select("text"), "s").join(counts(target.select("text"), "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "bucket_counts")
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    number = lambda x: x.cast("double") if isinstance(x, Column) else F.lit(float(x))
    ratio = (number(F.col("t")) + 1) * number(sums[0] + buckets) / ((number(F.col("s")) + 1) * number(sums[1] + buckets))
    return both.filter("s > 0").select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, decided by doc_id and seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)) * 1000)


def weighed(docs: DataFrame, target: DataFrame, seed: int = SEED, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, digest, copies, n_words, n_features, weight, score) per distinct row of (doc_id, text)."""
    gain = gains(docs, target, order, buckets)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    rows = keyed.transform(features, "doc_id", "digest", order=order, buckets=buckets)
    # At most `buckets` rows of two integers.
    rows = rows.join(F.broadcast(gain), "bucket", "left").groupBy("doc_id", "digest")
    n = F.count("bucket")
    sums = rows.agg(F.count_if("first").alias("copies"), n.alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    each = sums.select("doc_id", "digest", "copies", F.expr("n div copies").alias("n_features"), F.expr("sum div copies").alias("weight"))
    return each.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _words_for(n_words: int, order: int) -> int:
    """The features of a text of n_words words."""
    return sum(max(n_words - k, 0) for k in range(order))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of docs; rank is null for those not drawn."""
    rows = written(weighed(docs, target, seed, order, buckets), "weights")
    able = F.col("n_features") >= _words_for(least_words, order)  # more words, more features
    total = rows.filter(able).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    drawn = total * percent // 100
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("digest")]
    ranged = written(rows.filter(able).select("doc_id", "digest", "score", "copies").repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "ranges")
    # One row per range, as many as there are shuffle partitions.
    sizes = ranged.groupBy("range").agg(F.sum("copies").alias("size"))
    before = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))
    own = F.sum("copies").over(Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    begins = ranged.join(F.broadcast(before.filter(F.col("before") < drawn)), "range").select("doc_id", "digest", (own + F.col("before")).alias("above")).filter(F.col("above") < drawn)
    out = rows.join(begins.withColumnsRenamed({"doc_id": "drawn_id", "digest": "drawn_digest"}), F.col("doc_id").eqNullSafe(F.col("drawn_id")) & (F.col("digest") == F.col("drawn_digest")), "left")
    place = F.col("above") + F.col("copy") + 1
    return copied(out).select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))


def copied(rows: DataFrame) -> DataFrame:
    """Each row as often as its `copies` says, numbered by `copy` from 0; many copies in several tasks."""
    some = rows.filter(F.col("copies") <= _COPIES).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    many = rows.filter(F.col("copies") > _COPIES).withColumn("from", F.explode(F.expr(f"sequence(0L, copies - 1, {_COPIES}L)"))).repartition("digest", "from")
    return some.unionByName(many.withColumn("copy", F.explode(F.expr(f"sequence(from, least(copies, from + {_COPIES}) - 1)"))).drop("from"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: crc32 is not among DuckDB's functions: its table follows from the polynomial, byte by byte.
OP11_SQL = rf"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, [k::BIGINT FOR k IN range(8)]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
feature AS (
  SELECT doc_id, false AS target, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS f FROM docs
  UNION ALL
  SELECT NULL, true, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM items
),
distinct_feature AS (SELECT DISTINCT f FROM feature),
named AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT FOR i IN range(1, strlen(f) + 1)]), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 10000 AS bucket
  FROM distinct_feature, crc
),
placed AS (SELECT doc_id, target, bucket FROM feature JOIN named USING (f)),
counts AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM placed GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS big_s, sum(t)::DOUBLE AS big_t FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain FROM counts, sums),
weighed AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE NOT target GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (doc_id)
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 5 // 100 FROM ranked) THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
