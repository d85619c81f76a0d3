"""Sharding as a two-pass external shuffle, in DataFrame functions only.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash of the row.
Pass two permutes each bucket with Fisher-Yates (the built-in ``shuffle`` with a seed,
over the bucket sorted by that hash, so that a task run again gives the same order).
Buckets stand one after the other, which makes a uniform order of all rows; row i goes
to shard i mod n, place i div n. So shards differ by one row at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut, read_table

#: Rows that a bucket holds on average, for narrow rows; and bytes, for whole ones.
BUCKET_ROWS, BUCKET_BYTES, SEED = 20_000, 32 << 20, 20_240_601


def shuffled(rows: DataFrame, n_shards: int, buckets: int, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; the law is "rows".

    ``rows`` should be materialised, as it is read twice. The scatter hash covers all
    columns and the row's place in its partition, so repeated rows part as well.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    keyed = rows.select(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in rows.columns], F.monotonically_increasing_id()).alias("h"), row)
    keyed = keyed.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    piles = keyed.groupBy("bucket").agg(F.shuffle(F.array_sort(F.collect_list(F.struct("h", "row"))), seed).alias("pile"))
    laid = piles.join(F.broadcast(base), "bucket").select("base", F.posexplode("pile").alias("pos", "item"))
    index = F.col("base") + F.col("pos")
    return laid.select("item.row.*", (index % n_shards).cast("int").alias("shard"), F.floor(index / n_shards).cast("bigint").alias("slot"))


def write_shards(documents: DataFrame, path: str, n_shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write whole rows as Parquet under ``path``/shard=k, each shard in slot order."""
    total = documents.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    out = shuffled(documents, n_shards, total // bucket_bytes + 1, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law).

    Null text: size 1, the crc32 of no bytes. Null ids and repeated rows are dealt like
    any others; an empty table gives an empty result; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = cut(docs)
    out = shuffled(rows, 8, rows.count() // BUCKET_ROWS + 1)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
