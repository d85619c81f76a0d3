"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every normalised text to PROBES positions of a bit array and keeps the
positions that at least two rows hit: a Bloom filter of the hashes that may repeat. It
is a table of 64-bit words of at most ``bits`` bits, so its broadcast is bounded by a
parameter whatever the input holds. Pass two tests each row against it. Rows that
miss are alone and pass straight through; only the others shuffle, and an exact
comparison of SHA-256 digests settles them.

Copies of one text may be a third of all rows: their minimum and count are aggregated
before the shuffle, and the answer returns to the rows over (digest, salt) keys, so
no task gets a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import SPACE_CLASS, cut, read_table

#: Bits of the filter for each row, the largest filter, and positions for each row.
BITS_PER_ROW, MAX_BITS, PROBES = 16, 1 << 27, 2
#: Keys that one digest is dealt over.
SALTS = 64


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _position(hash_: Column, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(hash_, F.lit(k)), F.lit(bits))


def filter_bits(rows: int) -> int:
    """A power of two of at least BITS_PER_ROW bits a row, up to MAX_BITS. A fuller
    filter only lets more rows through to the exact comparison."""
    return min(MAX_BITS, max(1 << 16, 1 << (max(1, rows) * BITS_PER_ROW - 1).bit_length()))


def repeated_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """Pass one: (word, mask) of the bit positions that two rows or more of ``hashes``
    (a column ``h``) hit. At most bits / 64 rows."""
    spots = hashes.select(F.explode(F.array(*[_position(F.col("h"), k, bits) for k in range(PROBES)])).alias("p"))
    twice = spots.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return twice.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("mask"))


def mark_repeated(rows: DataFrame, words: DataFrame, bits: int, hash_: str) -> DataFrame:
    """Pass two: ``rows`` with a boolean ``__maybe``: whether its hash may be repeated."""
    out, hit = rows, F.lit(True)
    for k in range(PROBES):
        table = F.broadcast(words.select(F.col("word").alias(f"__w{k}"), F.col("mask").alias(f"__m{k}")))
        p = _position(F.col(hash_), k, bits)
        out = out.withColumn(f"__p{k}", p)
        out = out.join(table, F.shiftright(f"__p{k}", 6) == F.col(f"__w{k}"), "left")
        hit = hit & F.coalesce(F.expr(f"(shiftright(__m{k}, int(__p{k} & 63)) & 1) = 1"), F.lit(False))
    helpers = [f"__{x}{k}" for k in range(PROBES) for x in "wmp"]
    return out.withColumn("__maybe", hit).drop(*helpers)


def groups(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Equal texts (after white-space normalisation) form a
    group; the smallest doc_id stays, a null id last; of fully repeated rows one
    stays. An empty table gives an empty result; further columns of the input are
    ignored, whatever their names.
    """
    rows = cut(
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("sha")).withColumn(
            "uid", F.monotonically_increasing_id()
        )
    )
    rows = rows.withColumn("h", F.xxhash64("sha"))
    bits = filter_bits(rows.count())
    marked = mark_repeated(rows, repeated_filter(rows.select("h"), bits), bits, "h")
    alone = marked.filter(~F.col("__maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    shuffled = resolve(marked.filter("__maybe").select("doc_id", "uid", "sha"))
    return alone.unionByName(shuffled).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def resolve(rows: DataFrame) -> DataFrame:
    """The exact comparison for (doc_id, uid, sha): adds keep_id, group_size and kept."""
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "uid"), F.lit(SALTS)).cast("int"))
    part = rows.groupBy("sha", "salt").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("sha").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
    answers = part.select("sha", "salt").join(whole, "sha")
    return rows.join(answers, ["sha", "salt"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "sha"
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of equal texts, all columns as they came.

    Rows that the filter clears pass through without a shuffle. The others are dealt by
    (digest, id), which spreads large groups, and meet only their group's winner there.
    Null texts count as empty; of rows with one id and one text a single one stays.
    """
    names = documents.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    base = documents.select(row, F.col("doc_id").cast("bigint").alias("__id"), digest(F.col("text")).alias("__sha"))
    base = base.withColumn("__h", F.xxhash64("__sha"))
    hashes = cut(base.select(F.col("__h").alias("h")))
    bits = filter_bits(hashes.count())
    marked = mark_repeated(base, repeated_filter(hashes, bits), bits, "__h")
    alone = marked.filter(~F.col("__maybe")).select("__row.*")
    # Of the rest, the smallest id of each digest wins; equal ids are told apart by their
    # place, and only the digest, not the text, is aggregated.
    maybe = marked.filter("__maybe").select("__row", "__id", "__sha")
    win = maybe.groupBy("__sha").agg(F.min(F.struct(F.col("__id").isNull().alias("a"), F.col("__id").alias("b"))).alias("w"))
    win = win.select(F.col("__sha").alias("__ws"), F.col("w.b").alias("__wb"))
    match = maybe.join(win, (F.col("__sha") == F.col("__ws")) & F.col("__id").eqNullSafe(F.col("__wb")))
    once = match.groupBy("__sha", "__id").agg(F.first("__row").alias("__row"))
    return alone.unionByName(once.select("__row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
