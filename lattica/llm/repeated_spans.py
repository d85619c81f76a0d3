"""Removal of repeated substrings by the interval tree of an enhanced suffix array.

Every 200-byte window belongs to the 32-byte gram in it whose hash is least, its seed; equal
windows have equal seeds. A document falls into segments: runs of windows of one seed and
on one side of it, which share over 100 bytes, their core. The core's hash is the
segment's key, and equal windows have equal keys. Keys that occur once need no more: a
bounded Bloom filter of the others decides which segments are sent on. Equal segments are
counted, not kept twice; the distinct segments of a key meet in one shard.

A shard builds the suffix array of its segments by prefix doubling, takes longest common
prefixes from the ranks of each doubling, and scans the array with a stack for intervals
whose common prefix is 200 bytes or more. An interval whose occurrences are preceded by
different bytes is a maximal repeat, and all its occurrences are put out; one that could be
extended to the left is left out, as its extension covers it.

A seed with more than HOT distinct segments (a passage that very many documents quote in
contexts of their own) is not given to one shard. Its windows are hashed and counted one by
one instead, which spreads over all tasks; the outcome is the same.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import chunks, cut, freed, mix64, prepare, read_table, text_bytes
from lattica.llm.exact_dedup import filter_bits
from lattica.llm.near_dedup import in_filter, row_key

LEAST, GRAM = 200, 32
#: Distinct segments of one seed that a shard takes at most; segments of a shard on average.
HOT, SHARD = 400, 5_000
SALTS = 32
_BLOCK = LEAST - GRAM + 1
_HALF = _BLOCK // 2
_A = mix64(np.arange(900, 916, dtype=np.uint64)) | np.uint64(1)
_B = (mix64(np.arange(950, 960, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _sliding(op: np.ufunc, a: np.ndarray, width: int, pad: int) -> np.ndarray:
    """op over each ``width`` neighbours; len(a) - width + 1 values."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    rows = -(-len(a) // width)
    full = np.full(rows * width, pad, dtype=a.dtype)
    full[: len(a)] = a
    grid = full.reshape(rows, width)
    ahead = op.accumulate(grid, axis=1).ravel()
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], ahead[width - 1 : width - 1 + n])


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, none of them 0. They only order the grams, so 32
    bits do; grams that agree by chance count as ties."""
    h, width, k = data.astype(np.uint32) + np.uint32(1), 1, 0
    while width < GRAM:
        h = h[:-width] * _B[k] + h[width:]
        h ^= h >> np.uint32(15)
        width, k = 2 * width, k + 1
    h *= _B[8]
    h ^= h >> np.uint32(16)
    h *= _B[9]
    return h | np.uint32(1)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, text number, first window (a place in ``data``) and number of windows of each
    segment: a run of windows with one seed, on one side of it. All windows of a segment
    share its core, the bytes that the key hashes. In windows in which the least hash
    stands twice (periodic text) the seed's place is arbitrary; there the seed alone is
    the core, so that windows meet whichever place was taken."""
    none = np.zeros(0, np.int64)
    nothing = none, none, none, none
    if len(data) < LEAST:
        return nothing
    g = _grams(data)
    least = _sliding(np.minimum, g, _BLOCK, 0xFFFFFFFF)
    n = len(least)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    valid = owner[:n] == owner[LEAST - 1 :]
    if not valid.any():
        return nothing
    padded = np.zeros(n + 2 * (_BLOCK - 1), dtype=np.uint32)
    padded[_BLOCK - 1 : _BLOCK - 1 + n] = np.where(valid, least, np.uint32(0))
    every = np.flatnonzero(_sliding(np.maximum, padded, _BLOCK, 0) == g)
    own = g[every]
    order = np.lexsort((every, own))
    before, after = np.full(len(every), -len(data)), np.full(len(every), 2 * len(data))
    same = own[order[1:]] == own[order[:-1]]
    before[order[1:][same]] = every[order[:-1][same]]
    after[order[:-1][same]] = every[order[1:][same]]
    keep = _thinned(every, own)
    spots, own, before, after = every[keep], own[keep], before[keep], after[keep]
    starts = np.flatnonzero(valid)
    seed = np.searchsorted(spots, starts)
    want = least[starts]
    open_ = np.flatnonzero(own[seed] != want)
    while len(open_):
        seed[open_] += 1
        open_ = open_[own[seed[open_]] != want[open_]]
    tied = (before[seed] >= starts) | (after[seed] <= starts + _BLOCK - 1)
    side = np.where(tied, 2, starts - spots[seed] >= -_HALF)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (seed[1:] != seed[:-1]) | (side[1:] != side[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    at, which = spots[seed[first]], side[first]
    # To the left of the seed, windows start _BLOCK - 1 to _HALF + 1 bytes before it; else
    # _HALF to 0 before it.
    lo = np.where(which == 0, at - _HALF - 1, at)
    hi = np.where(which == 0, at - _BLOCK + 1 + LEAST, np.where(which == 1, at - _HALF + LEAST, at + GRAM))
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    key = np.array([digest(raw[a:b], k) for a, b, k in zip(lo.tolist(), hi.tolist(), which.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
    return key, owner[starts[first]].astype(np.int64), starts[first], np.diff(np.append(first, len(starts)))


def _thinned(spots: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the seeds to keep: of those that stand close together with one hash
    (periodic text), enough for every window to have one."""
    tied = np.zeros(len(spots), dtype=bool)
    tied[1:] = (hashes[1:] == hashes[:-1]) & (np.diff(spots) <= _BLOCK)
    keep = ~tied
    place, more, n = spots.tolist(), tied.tolist(), len(spots)
    for i in (np.flatnonzero(tied[1:] & ~tied[:-1]) + 1).tolist():
        last, j = place[i - 1], i
        while j < n and more[j]:
            if j + 1 == n or not more[j + 1] or place[j + 1] - last > _BLOCK:
                keep[j], last = True, place[j]
            j += 1
    return keep


def _each(column: pa.Array) -> Iterator[tuple]:
    data, offsets = text_bytes(column)
    for i, j in chunks(offsets, 256 << 10):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, part, at, *segments(part, at)


@freed
def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, seed, _, _, _ in _each(batch.column("text")):
            h, n = np.unique(seed, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["seed", "n"])


def _probes(seed: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix64(seed.view(np.uint64) ^ _A[10 + k]) & np.uint64(bits - 1)).astype(np.int64) for k in (0, 1)]


def _bit_words(bits: int):
    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate(_probes(batch.column("seed").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array(np.int64(1) << (p & 63))], ["word", "mask"])

    return run


def _cut_out(shared, bits: int):
    """Segments of seeds in the filter: seed, key, pos, windows, segment."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            key = batch.column("key").to_numpy()
            for i, data, at, seed, owner, start, count in _each(batch.column("text")):
                hit = np.ones(len(seed), dtype=bool)
                for p in _probes(seed, bits):
                    hit &= (table[p >> 6] >> (p & 63)) & 1 == 1
                seed, owner, start, count = seed[hit], owner[hit], start[hit], count[hit]
                raw = data.tobytes()
                bodies = [raw[a : a + n] for a, n in zip(start.tolist(), (count + LEAST - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed), pa.array(key[i + owner]), pa.array(start - at[owner]), pa.array(count), pa.array(bodies, pa.binary())],
                    ["seed", "key", "pos", "windows", "segment"],
                )

    return run


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of the values, from 1."""
    order = np.argsort(key)
    s = key[order]
    step = np.ones(len(s), dtype=np.int64)
    step[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), dtype=np.int64)
    out[order] = np.cumsum(step)
    return out


def maximal_repeats(data: np.ndarray, ends: np.ndarray, group: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of all occurrences of maximal repeats of ``least`` bytes or more.

    ``data`` holds strings laid end to end that stop at ``ends``; only strings of equal
    ``group`` are compared, and matches never cross an end.
    """
    n = len(data)
    begin = np.concatenate([[0], ends[:-1]])
    size = ends - begin
    stop = np.repeat(ends, size)
    string = np.repeat(np.arange(len(ends)), size)
    place = np.arange(n)

    def ahead(r: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        if by < n:
            out[: n - by] = np.where(place[: n - by] + by < stop[: n - by], r[by:], 0)
        return out

    word = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        own = np.zeros(n, dtype=np.uint64)
        own[: n - k] = np.where(place[: n - k] + k < stop[: n - k], data[k:], 0)
        word |= own << np.uint64(56 - 8 * k)
    levels = [(8, _dense(word).astype(np.int32))]
    while levels[-1][0] < least:
        width, r = levels[-1]
        levels.append((2 * width, _dense(r.astype(np.int64) << 32 | ahead(r, width)).astype(np.int32)))
    # Suffixes that are long enough, by group and then in lexicographic order.
    width, r = levels[-1]
    tail = np.flatnonzero(stop - place >= least)
    suffix = tail[np.lexsort((ahead(r, width)[tail], r[tail], group[string[tail]]))]
    a, b = suffix[:-1], suffix[1:]
    lcp = np.zeros(len(a), dtype=np.int64)
    for width, r in reversed(levels):
        x, y = a + lcp, b + lcp
        inside = (x < stop[a]) & (y < stop[b])
        same = inside & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)])
        lcp += np.where(same, width, 0)
    x, y = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
    differ = word[x] ^ word[y]
    for k in range(1, 8):
        lcp += (differ >> np.uint64(64 - 8 * k)) == 0
    lcp = np.minimum(lcp, np.minimum(stop[a] - a, stop[b] - b))
    lcp[group[string[a]] != group[string[b]]] = 0
    before = np.where(suffix > begin[string[suffix]], data[np.maximum(suffix - 1, 0)].astype(np.int64), -1)
    return _scan(suffix, lcp, before, least)


def _scan(suffix: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Stack scan for left-diverse intervals. ``before``: the byte to the left; -1: none."""
    deep = lcp >= least
    edge = np.flatnonzero(np.diff(np.concatenate([[0], deep.astype(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]  # entries first..last, both included, share a prefix
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = last - first + 1
    at = np.repeat(first - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
    starts = np.cumsum(span) - span
    low, high = np.minimum.reduceat(before[at], starts), np.maximum.reduceat(before[at], starts)
    diverse = (low != high) | (low < 0)
    two = diverse & (span == 2)
    places = [suffix[first[two]], suffix[last[two]]]
    lengths = [lcp[first[two]], lcp[first[two]]]
    for lo, hi in zip(first[diverse & (span > 2)].tolist(), last[diverse & (span > 2)].tolist(), strict=True):
        depth, left = lcp[lo:hi].tolist(), before[lo : hi + 1].tolist()
        # Each open interval: common prefix, first entry, its left byte, or None if diverse.
        stack: list[list] = []
        mixed = lambda p, q: None if p is None or q is None or p != q or p < 0 else p
        for k in range(hi - lo + 1):
            now = depth[k] if k < hi - lo else 0
            began, byte = k, left[k] if left[k] >= 0 else None
            while stack and stack[-1][0] > now:
                length, start, common = stack.pop()
                common = mixed(common, byte)
                if common is None:
                    places.append(suffix[lo + start : lo + k + 1])
                    lengths.append(np.full(k + 1 - start, length))
                began, byte = start, common
            if now and (not stack or stack[-1][0] < now):
                stack.append([now, began, byte])
            elif now:
                stack[-1][2] = mixed(stack[-1][2], byte)
    return np.concatenate(places), np.concatenate(lengths)


def _covered(places: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def _shard(table: pa.Table) -> pa.Table:
    """Repeated stretches of each segment of a shard: seed, sh, from, till."""
    seed = table.column("seed").to_numpy()
    sh = table.column("sh").to_numpy()
    bodies = table.column("segment").to_pylist()
    size = np.array([len(b) for b in bodies], dtype=np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    mark = _covered(*maximal_repeats(data, ends, seed), len(data))
    copies = np.repeat(table.column("n").to_numpy() > 1, size)
    return _stretches(mark | copies, ends, seed, sh)


def _stretches(mark: np.ndarray, ends: np.ndarray, seed: np.ndarray, sh: np.ndarray) -> pa.Table:
    begin = np.concatenate([[0], ends[:-1]])
    size = ends - begin
    string = np.repeat(np.arange(len(ends)), size)
    on = mark.astype(np.int8)
    head = on.copy()
    head[1:] &= ~(on[:-1] & (string[1:] == string[:-1])) & 1
    foot = on.copy()
    foot[:-1] &= ~(on[1:] & (string[1:] == string[:-1])) & 1
    a, b = np.flatnonzero(head), np.flatnonzero(foot)
    s = string[a]
    return pa.table({"seed": seed[s], "sh": sh[s], "from": a - begin[s], "till": b + 1 - begin[s]})


@freed
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of every window of every segment."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            bodies = part.column("segment").to_pylist()
            size = np.array([len(b) for b in bodies])
            data = np.frombuffer(b"".join(bodies), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
            h, parts, shift, width, k = data, None, 0, 1, 0
            while width <= LEAST:  # 200 = 128 + 64 + 8
                if LEAST & width:
                    piece = h[shift:]
                    parts = piece if parts is None else mix64(parts[: len(piece)] * _A[k + 1]) + piece[: len(parts)]
                    shift += width
                h = mix64(h[:-width] * _A[k]) + h[width:] * _A[k + 2] if width < 128 else h
                width, k = 2 * width, k + 1
            first = np.cumsum(size) - size
            count = size - LEAST + 1
            offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            row = np.repeat(np.arange(len(size)), count)
            w = mix64(parts[first[row] + offset])
            copies = np.where(part.column("n").to_numpy() > 1, 2, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.column("seed").to_numpy()[row]),
                    pa.array(part.column("sh").to_numpy()[row]),
                    pa.array(offset.astype(np.int32)),
                    pa.array(w.view(np.int64)),
                    pa.array(copies[row].astype(np.int64)),
                ],
                ["seed", "sh", "at", "w", "n"],
            )


def _hot(distinct: DataFrame) -> DataFrame:
    """Repeated stretches of the segments of hot seeds, by counting window hashes."""
    rows = cut(distinct.mapInArrow(_windows, "seed bigint, sh bigint, at int, w bigint, n bigint"))
    rows = rows.withColumn("salt", F.pmod("sh", F.lit(SALTS)))
    part = rows.groupBy("w", "salt").agg(F.sum("n").alias("n"))
    many = part.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1").select("w")
    answer = part.select("w", "salt").join(many, "w")
    return rows.join(answer, ["w", "salt"]).select("seed", "sh", F.col("at").cast("bigint").alias("from"), (F.col("at") + LEAST).cast("bigint").alias("till"))


_TOUCHING = """
aggregate(m, cast(array() as array<struct<from:bigint,till:bigint>>), (done, x) ->
    if(size(done) > 0 and x.from <= element_at(done, -1).till,
       concat(slice(done, 1, size(done) - 1), array(named_struct('from', element_at(done, -1).from, 'till', greatest(element_at(done, -1).till, x.till)))),
       concat(done, array(x))))
"""


def _shared_path(spark: SparkSession) -> str:
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/segments-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def repeated(documents: DataFrame) -> DataFrame:
    """(key, start, end): stretches of bytes that the repeated windows cover; key is
    row_key() of a document. Stretches of one document may overlap."""
    spark = documents.sparkSession
    prepare(spark)
    rows = documents.select(row_key().alias("key"), "text").filter(F.octet_length("text") >= LEAST)
    seeds = rows.select("text").mapInArrow(_seeds, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    seeds = cut(seeds.filter("n > 1").select("seed"))
    bits = filter_bits(seeds.count())
    words = seeds.mapInArrow(_bit_words(bits), "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits >> 6, dtype=np.int64)  # at most MAX_BITS / 8 bytes
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    shared = spark.sparkContext.broadcast(table)
    path = _shared_path(spark)
    cutting = rows.mapInArrow(_cut_out(shared, bits), "seed bigint, key bigint, pos bigint, windows bigint, segment binary")
    cutting.withColumn("sh", F.xxhash64("segment")).withColumn("size", F.octet_length("segment").cast("bigint")).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    kinds = cut(found.groupBy("seed", "sh").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")))
    many = cut(kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.first("sh").alias("sh"), F.first("size").alias("size")).filter("n > 1"))
    # A seed with one kind of segment: all of it is repeated, and there is nothing to compare.
    marks = many.filter("kinds = 1").select("seed", "sh", F.lit(0).cast("bigint").alias("from"), F.col("size").alias("till"))
    several = many.filter("kinds > 1").select("seed", "kinds")
    shards = max(1, (several.filter(F.col("kinds") <= HOT).agg(F.sum("kinds")).first()[0] or 0) // SHARD)
    some = in_filter(found.select(F.col("seed").alias("key"), "sh", "segment"), several.select(F.col("seed").alias("key")), several.count()).filter("__in")
    bodies = some.groupBy(F.col("key").alias("seed"), "sh").agg(F.first("segment").alias("segment"))
    bodies = bodies.join(kinds.select("seed", "sh", "n"), ["seed", "sh"]).join(several, "seed")
    bodies = cut(bodies)
    tree = bodies.filter(F.col("kinds") <= HOT).withColumn("shard", F.pmod(F.xxhash64("seed"), F.lit(shards)))
    marks = marks.union(tree.groupBy("shard").applyInArrow(_shard, "seed bigint, sh bigint, from bigint, till bigint"))
    hot = bodies.filter(F.col("kinds") > HOT)
    if not hot.isEmpty():
        marks = marks.union(_hot(hot))
    # At most a segment's windows each; stretches that touch become one.
    marks = marks.groupBy("seed", "sh").agg(F.array_sort(F.collect_list(F.struct("from", "till"))).alias("m"))
    marks = cut(marks.withColumn("m", F.expr(_TOUCHING)))
    spans = found.select("seed", "sh", "key", "pos").join(marks, ["seed", "sh"]).select("key", "pos", F.explode("m").alias("m"))
    out = cut(spans.select("key", (F.col("pos") + F.col("m.from")).alias("start"), (F.col("pos") + F.col("m.till")).alias("end")).distinct())
    _delete(spark, path)
    return out


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with a column key) and the ``spans`` of each, null if it has none. Only
    rows that a bounded Bloom filter of the keys names are shuffled."""
    spans = cut(found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    marked = in_filter(rows, spans.select("key"), spans.count())
    no = F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans")
    straight = marked.filter(~F.col("__in")).drop("__in").select("*", no)
    return straight.unionByName(marked.filter("__in").drop("__in").join(spans, "key", "left").select(*straight.columns))


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document.

    Texts are UTF-8 bytes; null: empty. A text under 200 bytes keeps everything. Fully
    repeated rows repeat each other. An empty table gives an empty result; further
    columns are ignored.
    """

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                runs = _merged(spans)
                kept = _kept(raw, runs)
                got.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            n, gone, runs, sha = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", row_key().alias("key"))
    return with_spans(rows, repeated(documents)).drop("key").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with the repeated bytes cut out of ``text``, other columns as they
    came, but n_chars is counted anew. A character cut in two goes as a whole."""
    names = documents.columns

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(where), batch.column("spans").to_pylist(), strict=True):
                whole = text.as_py()
                texts.append(_kept(whole.encode(), _merged(spans)).decode("utf-8", "ignore") if spans else whole)
            out = [pa.array(texts, pa.string()) if c == where else batch.column(c) for c in cols]
            yield pa.RecordBatch.from_arrays(out, cols)

    cols = [f"c{k}" for k in range(len(names))]
    where = cols[names.index("text")]
    plain = documents.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(cols, names, strict=True)], row_key().alias("key"))
    kind = ", ".join(f"{k} {documents.schema[c].dataType.simpleString()}" for k, c in zip(cols, names, strict=True))
    out = with_spans(plain, repeated(documents)).drop("key").mapInArrow(run, kind).toDF(*names)
    if "n_chars" in names:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out


def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
