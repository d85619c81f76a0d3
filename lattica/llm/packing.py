"""Best-fit packing with large-item matching.

Only a document longer than a sequence is cut; all its pieces but the first fill one. The
other pieces are packed by their lengths alone, from a histogram of at most CAPACITY
numbers, however many pieces there are. Lengths above a third of the capacity go in pairs
at most: from the longest down, each is matched with the longest that still fits. Shorter
ones, from the longest down, go where they leave the smallest gap. The plan is a short
list of runs: pieces of one length and of ranks r0 to r1 are put at one offset into
sequences counted upwards from one number. Ranks within a length are dealt by counting
over (length, salt) first, so no task ranks all pieces of a common length.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut, freed, prepare, read_table

CAPACITY, END = 1024, 2
#: Pieces of one (length, salt) that a task ranks, on average at most.
RANKED = 20_000


def _specials(spec: dict) -> dict[str, int] | None:
    """The added tokens of a tokenizers file, if each stands for its exact text only."""
    added = spec.get("added_tokens") or ()
    plain = not any(t.get(x) for t in added for x in ("lstrip", "rstrip", "single_word"))
    return {t["content"]: t["id"] for t in added} if plain else None


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """The ranks of a tokenizers file that is plain byte-level BPE: its vocabulary's
    single bytes and, in order, its merges. None for any other tokenizer."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    # The characters that byte-level tokenizers write for bytes: printable ones stand for
    # themselves, the others are counted upwards from 256.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = _specials(spec)
    if special is None:
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    in_order = [model["vocab"].get("".join(m)) for m in merges] == list(range(256, 256 + len(merges)))
    return ranks if in_order and len(ranks) == 256 + len(merges) else None


class TextIds:
    """Ids of whole texts by a tokenizers file; no special tokens are added, but those that
    a text spells out are found, as tokenizers does.

    A byte-level BPE file is run by the tiktoken engine, which gives the same ids in a
    third of the time (the tests hold both against each other); others by tokenizers.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ranks = _byte_ranks(spec)
        if ranks:
            import tiktoken

            special = _specials(spec) or {}
            engine = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

            def one(text: str) -> list[int]:
                return engine.encode(text, allowed_special="all") if any(s in text for s in special) else engine.encode_ordinary(text)

            self.encode = lambda texts: [array("I", one(t)).tobytes() for t in texts]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.encode = lambda texts: [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self.encode(texts)


@lru_cache(2)
def text_ids(path: str, pattern: str) -> TextIds:
    return TextIds(path, pattern)


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """The pieces of a document of n ids: whole, or full pieces after a shorter first."""
    return [n] if n <= capacity else [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pieces(documents: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces (and the ids,
    if asked for); its ids are the text's and then END. A null text is an empty one."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    end = np.array([END], dtype="<u4").tobytes()

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                doc, number, start, length, crc, ids = [], [], [], [], [], []
                for k, raw in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    raw, where = raw + end, 0
                    for i, n in enumerate(cut_lengths(len(raw) // 4, capacity)):
                        own = raw[4 * where : 4 * (where + n)]
                        doc.append(k), number.append(i), start.append(where), length.append(n), crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, dtype="<i4"))
                        where += n
                columns = [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, kind)


class _Plan:
    """Bins of equal content, by their gap; and the runs laid so far."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first and end rank, sequence, offset
        self.used: dict[int, int] = {}
        self.gaps: list[int] = []
        self.groups: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)

    def lay(self, length: int, first: int, count: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.used[length] = rank + count
        self.runs.append((length, rank, rank + count, first, offset))

    def leave(self, gap: int, first: int, count: int) -> None:
        if count and gap:
            if gap not in self.groups:
                insort(self.gaps, gap)
                self.groups[gap] = []
            self.groups[gap].append((first, count))

    def open(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def fill(self, length: int, first: int, count: int, gap: int, items: int) -> int:
        """Put items of one length into bins of one gap, as many in each as fit, in order;
        returns how many were put."""
        each = gap // length
        full = min(count, items // each)
        at = self.capacity - gap
        for k in range(each if full else 0):
            self.lay(length, first, full, at + k * length)
        self.leave(gap - each * length, first, full)
        put, rest = full * each, 0
        if full < count and put < items:
            rest = items - put
            for k in range(rest):
                self.lay(length, first + full, 1, at + k * length)
            self.leave(gap - rest * length, first + full, 1)
        untouched = full + (rest > 0)
        self.leave(gap, first + untouched, count - untouched)
        return put + rest


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset) for all pieces."""
    p, left = _Plan(capacity), {n: c for n, c in histogram.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        count = left[a]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            p.lay(a, first := p.open(count), count, 0)
            p.leave(capacity - a, first, count)
            left[a] = 0
        elif large[at] == a:
            if count // 2:
                first = p.open(count // 2)
                p.lay(a, first, count // 2, 0), p.lay(a, first, count // 2, a)
                p.leave(capacity - 2 * a, first, count // 2)
            left[a] = count % 2
            if left[a]:  # one is over; its partner is the next longest
                partner = large[at - 1] if at else 0
                first = p.open(1)
                p.lay(a, first, 1, 0)
                if partner:
                    p.lay(partner, first, 1, a)
                    left[partner] -= 1
                p.leave(capacity - a - partner, first, 1)
                left[a] = 0
        else:
            b = large[at]
            both = min(count, left[b])
            first = p.open(both)
            p.lay(a, first, both, 0), p.lay(b, first, both, a)
            p.leave(capacity - a - b, first, both)
            left[a] -= both
            left[b] -= both
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        items = left[n]
        while items:
            at = bisect_left(p.gaps, n)
            if at < len(p.gaps):
                gap = p.gaps.pop(at)
                todo = p.groups.pop(gap)
                while todo and items:
                    first, count = todo.pop()
                    items -= p.fill(n, first, count, gap, items)
                for first, count in todo:
                    p.leave(gap, first, count)
            else:
                count = -(-items // (capacity // n))
                items -= p.fill(n, p.open(count), count, capacity, items)
    return p.runs


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Materialised pieces with ``sequence_id`` and ``offset``."""
    spark = rows.sparkSession
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # CAPACITY rows at most
    runs = plan(histogram, capacity)
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "r_length bigint, r0 bigint, r1 bigint, sequence bigint, r_offset bigint")
    salts = max(1, -(-max(histogram.values(), default=0) // RANKED))
    salted = rows.withColumn("__uid", F.monotonically_increasing_id()).withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "__uid"), F.lit(salts)))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "__uid")
    ranked = salted.withColumn("__rank", F.row_number().over(own) - 1).join(base, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__base"))
    # The runs are bounded by the capacity, not by the rows; see plan().
    found = ranked.join(F.broadcast(table), (F.col("length") == F.col("r_length")) & (F.col("__rank") >= F.col("r0")) & (F.col("__rank") < F.col("r1")))
    placed = found.withColumn("sequence_id", F.col("sequence") + F.col("__rank") - F.col("r0")).withColumn("offset", F.col("r_offset"))
    return placed.select(*rows.columns, "sequence_id", "offset")


def pack(documents: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids; one row a piece.

    An empty or null text is one piece, END alone. Null ids and repeated rows are packed
    like any others. An empty table gives an empty result. Further columns are ignored.
    """
    prepare(documents.sparkSession)
    return place(cut(pieces(documents, path, pattern, capacity, with_ids)), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN)
