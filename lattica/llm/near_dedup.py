"""Near-duplicate classes by DartMinHash.

A text is the set of its five-word shingles (white-space words, A-Z lower-cased; a text
of fewer words is one shingle). Every element throws darts into its region, weight by
rank: the region is cut into cells, the ranks [0,1), [1,2), [2,4) ... for each unit of
weight, and a hash gives each cell a Poisson number of darts and each dart a rank and a
coordinate. The dart of least rank at each coordinate is the signature. Cells are opened
from the low ranks up and only until every coordinate has a dart, so a text of n shingles
costs about n + k log k darts instead of n k.

BANDS bands of ROWS coordinates are joined. In a bucket nobody is compared with
everybody: members are first compared with one leader; where they are not all connected by
then, with SLOTS more, and at last with all members that are not connected with the
commonest class of the bucket. A pair comes out of such a join only if the odd sketches of
both sets (ODD bits that hold the parity of the elements dealt to them) allow the
similarity, so that the many pairs of a family of loosely similar texts never come to be
rows. Each pair that does is checked on the whole shingle sets. Links give connected
classes. Texts with equal shingle sets are one node throughout.

A link of two texts is missed only if no band is shared (5e-6 at similarity 0.8) or if their
sketches differ by more than SIGMA deviations from what the similarity makes them differ by
(3e-6).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Words, chunks, cut, cut_in_loop, freed, mix64, read_table, text_bytes
from lattica.llm.exact_dedup import filter_bits

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 40, 6
COORDS = BANDS * ROWS
#: Different orders in which leaders come, and keys that one class is dealt over.
ORDERS, SALTS = 2, 32
#: Leaders of a bucket in each round; 0: all that are not of its commonest class.
SLOTS = (1, 16, 0)
#: Bits of an odd sketch, elements that it takes (of larger sets a sample by hash), and
#: deviations that are allowed for.
ODD, TAKES, SIGMA = 1024, 2048, 4.5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = mix64(np.arange(7, 7 + 256, dtype=np.uint64)) | np.uint64(1)


def shingles(words: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text, sorted, and their texts' numbers."""
    h, doc = words.hash, words.doc
    total = np.zeros(len(h), dtype=np.uint64)
    for i in range(n):
        m = len(h) - i
        if m <= 0:
            break
        same = doc[:m] == doc[i:]
        total[:m] += np.where(same, h[i:] * _ODD[i] + np.uint64(i + 1), np.uint64(0))
    full = np.zeros(len(h), dtype=bool)
    if len(h) >= n:
        full[: len(h) - n + 1] = doc[: len(h) - n + 1] == doc[n - 1 :]
    count = np.diff(words.at)
    short = words.at[:-1][(count > 0) & (count < n)]
    full[short] = True
    s, d = mix64(total[full]), doc[full]
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], d[new]


@cache
def _poisson(mean: float) -> np.ndarray:
    """Cumulated Poisson probabilities, scaled to 2**53."""
    k = np.arange(1, int(mean + 12 * np.sqrt(mean) + 20))
    logs = np.concatenate([[0.0], np.cumsum(np.log(mean / k))]) - mean
    return np.cumsum(np.exp(logs)) * 2.0**53


def _at(level: int, k: int) -> np.uint64:
    """A constant for a level, modulo 2**64."""
    return np.uint64((level + 1) * int(_ODD[k]) & (1 << 64) - 1)


def darts(element: np.ndarray, owner: np.ndarray, n: int, coords: int = COORDS, weight: np.ndarray | None = None) -> np.ndarray:
    """n x coords signatures; elements of one owner are different; whole-number weights
    (1 by default) cut an element into units. Owners without elements keep _EMPTY."""
    if weight is not None:
        unit = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
        element = mix64(np.repeat(element, weight) + unit.astype(np.uint64) * _ODD[20])
        owner = np.repeat(owner, weight)
    sig = np.full(n * coords, _EMPTY, dtype=np.uint64)
    low, high, level = 0.0, 1.0, 0
    while len(element):
        u = (mix64(element + _at(level, 21)) >> np.uint64(11)).astype(float)
        thrown = np.searchsorted(_poisson(high - low), u, "right")
        e, o = np.repeat(element, thrown), np.repeat(owner, thrown)
        which = np.arange(len(e)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
        h = mix64(e + _at(level, 22) + which.astype(np.uint64) * _ODD[23])
        spot = o * coords + ((h >> np.uint64(40)) * np.uint64(coords) >> np.uint64(24)).astype(np.int64)
        h = mix64(h)
        rank = low + (high - low) * (h >> np.uint64(11)).astype(float) / 2.0**53
        packed = ((rank * 2.0**26).astype(np.uint64) << np.uint64(22)) | (h & np.uint64((1 << 22) - 1))
        np.minimum.at(sig, spot, packed)
        short = (sig.reshape(n, coords) == _EMPTY).any(axis=1)
        more = short[owner]
        element, owner = element[more], owner[more]
        low, high, level = high, 2 * high, level + 1
    return sig.reshape(n, coords)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of ROWS coordinates each; the low six bits are the band's number."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    h = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        h = mix64(h * _ODD[40 + r] + parts[:, :, r])
    number = np.arange(BANDS, dtype=np.uint64)
    return (mix64(h + (number + np.uint64(1)) * _ODD[50]) & ~np.uint64(63) | number).view(np.int64)


def _by_text(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: shingles, owners, and each text's node: a hash of its set."""
    data, offsets = text_bytes(column)
    for i, j in chunks(offsets):
        s, owner = shingles(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        node = np.zeros(j - i, dtype=np.uint64)
        np.add.at(node, owner, mix64(s ^ _ODD[60]))
        size = np.bincount(owner, minlength=j - i).astype(np.uint64)
        yield i, j, s, owner, mix64(node + size * _ODD[61]).view(np.int64)


def odd_sketch(element: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n x ODD / 64 words of parity bits, and the level of each owner: of a set of more than
    TAKES elements one in 2**level is taken, by hash, TAKES at most on average."""
    size = np.bincount(owner, minlength=n)
    level = np.ceil(np.log2(np.maximum(size, 1) / TAKES)).clip(0, 40).astype(np.int64)
    h = mix64(element ^ _ODD[70])
    taken = (h >> np.uint64(24)) & ((np.uint64(1) << level[owner].astype(np.uint64)) - np.uint64(1)) == 0
    spot = (h[taken] & np.uint64(ODD - 1)).astype(np.int64)
    words = np.zeros(n * (ODD >> 6), dtype=np.uint64)
    np.bitwise_xor.at(words, owner[taken] * (ODD >> 6) + (spot >> 6), np.uint64(1) << (spot & 63).astype(np.uint64))
    return words.reshape(n, ODD >> 6).view(np.int64), level


_SKETCH = [f"t{k}" for k in range(ODD >> 6)]
#: What _signed() makes of doc_id, key, key2 and text.
SIGNED = "doc_id bigint, key bigint, key2 bigint, node bigint, size int, level int, bands array<bigint>, " + ", ".join(f"{t} bigint" for t in _SKETCH)


@freed
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, s, owner, node in _by_text(batch.column("text")):
            keys = band_keys(darts(s, owner, j - i))
            size = np.bincount(owner, minlength=j - i)
            sketch, level = odd_sketch(s, owner, j - i)
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            part = batch.slice(i, j - i)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[size > 0].ravel()))
            own = [pa.array(node), pa.array(size.astype(np.int32)), pa.array(level.astype(np.int32)), bands, *map(pa.array, np.ascontiguousarray(sketch.T))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), part.column("key2"), *own], ["doc_id", "key", "key2", "node", "size", "level", "bands", *_SKETCH])


@freed
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, s, owner, node in _by_text(batch.column("text")):
            ends = 8 * np.searchsorted(owner, np.arange(j - i + 1))
            raw = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["node", "shingles"])


@freed
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = int(np.isin(x, y, assume_unique=True).sum())
            near.append(both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], ["a", "b", "near"])


def row_key(seed: int = 0) -> Column:
    """A hash of a document's id and text, by which rows are found again. Two of different
    seeds make 128 bits."""
    own = [F.lit(seed)] if seed else []
    return F.xxhash64(*own, F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")))


def in_filter(rows: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """``rows`` with ``__in``: whether ``key`` may be among ``keys``. A Bloom filter of one
    probe, a table of 64-bit words with a bound on its size (see filter_bits)."""
    bits = filter_bits(count)
    spot = lambda c: F.pmod(F.xxhash64(c, F.lit(77)), F.lit(bits))
    words = keys.select(spot(F.col("key")).alias("p")).groupBy(F.shiftright("p", 6).alias("__w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("__m"))
    out = rows.withColumn("__p", spot(F.col("key")))
    out = out.join(F.broadcast(words), F.shiftright("__p", 6) == F.col("__w"), "left")
    hit = F.coalesce(F.expr("(shiftright(__m, int(__p & 63)) & 1) = 1"), F.lit(False))
    return out.withColumn("__in", hit).drop("__p", "__w", "__m")


def _alike(x: str, y: str) -> str:
    """SQL: whether two members may have the similarity, by sizes and odd sketches.

    At the similarity t, sets of a and b elements differ in d = (a + b) (1 - t) / (1 + t) at
    most; sketches of m bits then differ in m/2 (1 - exp(-2d/m)) on average. Of sets that
    are sampled at different levels only the sizes are compared.
    """
    d = f"(({x}.size + {y}.size) * {(1 - SIMILARITY) / (1 + SIMILARITY)!r}D / shiftleft(1L, {x}.level))"
    q = f"exp({d} * {-4.0 / ODD!r}D)"
    spread = f"greatest({ODD / 4}D * (1 - {q}) - {d} * {q} / shiftleft(1L, {x}.level), 0D) + 0.5D"
    apart = " + ".join(f"bit_count({x}.{t} ^ {y}.{t})" for t in _SKETCH)
    sizes = f"least({x}.size, {y}.size) >= {SIMILARITY}D * greatest({x}.size, {y}.size) - 1e-9D"
    return f"{sizes} AND ({x}.level <> {y}.level OR {apart} <= {ODD / 2}D * (1 - sqrt({q})) + {SIGMA}D * sqrt({spread}))"


def _candidates(members: DataFrame) -> DataFrame:
    """(a, b), a < b: members of one bucket with different labels, one of them with ``lead``,
    that may have the similarity."""
    x, y = members.alias("x"), members.filter("lead").alias("y")
    new = F.expr("x.bucket = y.bucket AND x.label <> y.label AND (NOT x.lead OR x.node < y.node)")
    met = x.join(y, new & F.expr(_alike("x", "y")))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _members(signed: DataFrame) -> DataFrame:
    """The different nodes of each bucket that holds two or more: (node, bucket, label, lead),
    sizes, sketches and a row's key; one of each bucket leads.

    The least and the greatest node of every bucket are aggregated before the shuffle, so a
    bucket may hold any share of the rows. A bounded Bloom filter of the buckets where they
    differ spares the other rows, most of them, a shuffle.
    """
    # Nodes are ordered by other bits in every second band, so that one node does not lead all.
    turn = F.when(F.col("bucket") % ORDERS == 0, F.lit(int(_ODD[80].view(np.int64)))).otherwise(F.lit(int(_ODD[81].view(np.int64))))
    spots = signed.select("node", F.explode("bands").alias("bucket")).withColumn("o", F.col("node").bitwiseXOR(turn))
    first = spots.groupBy("bucket").agg(F.min("o").alias("low"), F.max("o").alias("high")).filter("low <> high")
    first = cut_in_loop(first.select(F.col("bucket").alias("key"), F.col("low").bitwiseXOR(turn).alias("first")))
    wide = ["node", "size", "level", *_SKETCH]
    rows = signed.select(*wide, F.col("key").alias("row"), F.explode("bands").alias("key"))
    some = in_filter(rows, first.select("key"), first.count()).filter("__in")
    some = some.groupBy("key", "node").agg(*[F.first(c).alias(c) for c in wide[1:]], F.min("row").alias("row"))
    return some.join(first, "key").select(*wide, "row", F.col("key").alias("bucket"), F.col("node").alias("label"), (F.col("node") == F.col("first")).alias("lead"))


def connected(signed: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label): the least node of each class of nodes that links connect, for nodes with
    a link. All nodes whose shingle sets have the similarity and that share a bucket are
    linked, by themselves or through others. ``texts`` has key and text."""
    members = cut_in_loop(_members(signed))
    keys = cut_in_loop(members.groupBy("node").agg(F.min("row").alias("key")))
    label = sets = None
    for k, slots in enumerate(SLOTS):
        if k:
            members = cut_in_loop(_apart(members, label, slots))
        pairs = cut_in_loop(_candidates(members))
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if sets is not None:
            ends = ends.join(sets.select("node"), "node", "left_anti")
        own = cut_in_loop(keys.join(ends, "node"))
        some = in_filter(texts, own.select("key"), own.count()).filter("__in").select("key", "text")
        more = some.mapInArrow(_sets, "node bigint, shingles binary").join(own.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
        more = cut(more)
        sets = more if sets is None else sets.union(more)
        one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        checked = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_near, "a bigint, b bigint, near boolean")
        label = _relabelled(label, cut_in_loop(checked.filter("near").select("a", "b")))
    return label


def _relabelled(label: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, label) with more edges (a, b): classes that they connect become one."""
    if label is None:
        return components(edges)
    for end in ("a", "b"):
        known = label.select(F.col("node").alias(end), "label")
        edges = edges.join(known, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    top = components(cut_in_loop(edges.filter("a <> b"))).select(F.col("node").alias("label"), F.col("label").alias("top"))
    moved = label.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    new = top.join(label.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("label"))
    return cut_in_loop(moved.union(new))


def _apart(members: DataFrame, label: DataFrame, slots: int) -> DataFrame:
    """The members of those buckets that hold more than one label, with new labels and
    leaders: those that have not led and are not of the bucket's commonest label, ``slots``
    of them at most (all, if 0). Nodes without a link are labels of their own. Labels are few
    next to the sets, but not bounded, so they join by shuffle."""
    names = members.columns
    known = members.withColumnRenamed("lead", "led").drop("label").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    most = by_label.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    most = most.filter("labels > 1").select("bucket", F.col("top.label").alias("top"))
    known = known.join(most, "bucket").withColumn("may", ~F.col("led") & (F.col("label") != F.col("top")))
    if slots:
        own = F.xxhash64("node", F.pmod("bucket", F.lit(ORDERS)), F.lit(slots))
        known = known.withColumn("slot", F.pmod(own, F.lit(slots))).withColumn("o", own)
        first = known.filter("may").groupBy("bucket", "slot").agg(F.min("o").alias("least"))
        known = known.join(first, ["bucket", "slot"], "left").withColumn("may", F.col("may") & (F.col("o") == F.col("least")))
    return known.withColumn("lead", F.col("may")).select(*names)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for nodes with an edge."""
    both = cut_in_loop(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    label, parts = cut_in_loop(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label"))), both.rdd.getNumPartitions()
    while True:
        # What neighbours have, and then what the label's own node has. A graph that is in few
        # partitions stays in them, so that its rounds do not grow by shuffles.
        heard = both.join(label.withColumnRenamed("a", "b"), "b").coalesce(parts).groupBy("a").agg(F.min("label").alias("heard"))
        step = label.join(heard, "a").select("a", F.least("label", "heard").alias("label"), F.col("label").alias("old")).coalesce(parts)
        jump = label.select(F.col("a").alias("label"), F.col("label").alias("far"))
        step = cut_in_loop(step.join(jump, "label").select("a", F.least("label", "far").alias("label"), (F.least("label", "far") < F.col("old")).alias("moved")).coalesce(parts))
        label = step.select("a", "label")
        if step.filter("moved").isEmpty():
            return label.withColumnRenamed("a", "node")


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, key, key2, class_id, class_size, kept for each document.

    class_id is the least doc_id of the class, and that document is kept (of fully
    repeated rows one; a null id comes last). Null texts count as empty; texts without a
    word form one class. Texts that are alone are classes of one. An empty table gives
    an empty result; further columns are ignored, whatever their names.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("key"), row_key(1).alias("key2"), "text")
    signed = cut(rows.mapInArrow(_signed, SIGNED).withColumn("uid", F.monotonically_increasing_id()))
    label = connected(signed, rows.select("key", "text"))
    ids = signed.select("doc_id", "key", "key2", "uid", "node", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).alias("salt"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid")))
    part = cut(ids.groupBy("node", "salt").agg(first.alias("first"), F.count(F.lit(1)).alias("n")))
    owned = part.groupBy("node").agg(F.min("first").alias("first"), F.sum("n").alias("n")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    owned = cut(owned.withColumn("lsalt", F.pmod("node", F.lit(SALTS))))
    half = owned.groupBy("label", "lsalt").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    whole = half.groupBy("label").agg(F.min("first").alias("top"), F.sum("n").alias("class_size"))
    top = half.select("label", "lsalt").join(whole, "label")
    by_node = owned.select("node", "label", "lsalt").join(top, ["label", "lsalt"]).select("node", "top", "class_size")
    answer = part.select("node", "salt").join(by_node, "node")
    out = ids.join(answer, ["node", "salt"])
    return out.select("doc_id", "key", "key2", F.col("top.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("top.uid")).alias("kept"))


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """``documents`` with one document of each class, columns as they came. Only rows
    that a bounded Bloom filter of the dropped ones names are shuffled with their texts."""
    found = cut(classes(documents))
    names = documents.columns
    gone = found.filter(~F.col("kept")).select("key")
    base = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), row_key().alias("key"), row_key(1).alias("key2"))
    marked = in_filter(base, gone, gone.count())
    stay = marked.filter(~F.col("__in")).select("__row.*")
    known = found.groupBy("key", "key2").agg(F.max("kept").alias("__kept"))
    maybe = marked.filter("__in").join(known, ["key", "key2"]).filter("__kept").groupBy("key", "key2").agg(F.first("__row").alias("__row"))
    return stay.unionByName(maybe.select("__row.*"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents")).drop("key", "key2")
