"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Words are known by 64-bit hashes whose low bits hold a hash of the word's last two bytes,
its bucket. All training words are counted. The commonest SYMBOLS - TAILS words (the end
among them) are symbols of their own; each other word is predicted by its bucket:

    p(word | context) = p(class | context) p(symbol | class, context) p(word | symbol)

The two softmaxes are log-linear in hashed features of the context, which are of whole words,
however rare: the word before, the one before that (a skip feature), and both together. A
feature is a hash; with it go CLASS_SIZE weights for the classes and, for each class that
follows it, as many for the symbols of that class. Both lie in blocks of one table whose length
grows with the training tokens, from LEAST_BLOCKS to MOST_BLOCKS (a bound on what is
broadcast); features that share a block share its weights. p(word | symbol) is 1 for a word of
its own and smoothed relative frequency within a bucket.

Training is distributed gradient ascent: in each of EPOCHS passes every task takes all its
texts, a batch of STEP tokens an update (AdaGrad, one scale a block), and gives out the blocks
that it moved. A block's moves are averaged over the tasks that met it, weighted by how
often they did. So every training token counts in each pass. Weights depend on how
the table's files are dealt to tasks, as in any such mixing; within a run a score depends on the
text alone.

The counts of the HEAD commonest words are broadcast, a bound whatever the vocabulary is.
Rarer words of each text are joined with the table of counts and summed by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Words, chunks, cut, fold, freed, mix64, read_table, text_bytes

CLASS_SIZE, TAILS = 16, 32
SYMBOLS = CLASS_SIZE * CLASS_SIZE
#: Blocks of weights: one for so many training tokens, within these bounds.
BLOCK_TOKENS, LEAST_BLOCKS, MOST_BLOCKS = 16, 1 << 16, 1 << 18
HEAD, FLUSH = 1 << 18, 1 << 20
#: Passes over the training texts, tokens of an update, and its rate.
EPOCHS, STEP, RATE = 2, 1 << 12, 1.0
#: Training tokens that a task takes at least, if files are small; tasks whose moves are mixed at
#: once; and blocks that one row of moves holds.
TASK_TOKENS, FAN, PART = 1 << 22, 64, 1 << 12
#: Blocks that are no feature's: unigram weights of the classes, and of each class's symbols.
_FIXED = 1 + CLASS_SIZE
#: The end's hash; no word can have it, as those of words have another low part.
END = np.uint64(0x9E3779B97F4A7C00 | (TAILS - 1) + 1)
_LOW = np.uint64(63)
_ODD = mix64(np.arange(101, 105, dtype=np.uint64)) | np.uint64(1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text's followed by END; and their texts' numbers."""
    w = Words(data, offsets)
    last = data[w.end - 1].astype(np.uint64) | np.uint64(32)
    before = np.where(w.end - w.start > 1, data[w.end - 2], 0).astype(np.uint64) | np.uint64(32)
    bucket = mix64(last << np.uint64(8) | before) % np.uint64(TAILS)
    out = np.full(len(w.hash) + w.n_docs, END, dtype=np.uint64)
    doc = np.empty(len(out), dtype=np.int64)
    at = np.arange(len(w.hash)) + w.doc
    out[at], doc[at] = (w.hash & ~_LOW) | bucket, w.doc
    doc[w.at[1:] + np.arange(w.n_docs)] = np.arange(w.n_docs)
    return out, doc


class _Tally:
    """Counts of 64-bit keys; gives them out when there are FLUSH of them."""

    def __init__(self, name: str):
        self.name, self.keys, self.counts, self.held = name, [], [], 0

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            k, n = np.unique(keys, return_counts=True)
            self.keys.append(k), self.counts.append(n)
            self.held += len(k)
        if self.held > 2 * FLUSH:
            k, n = self._merged()
            self.keys, self.counts, self.held = [k], [n], len(k)
            if len(k) > FLUSH:
                yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            k, n = self._merged()
            self.keys, self.counts, self.held = [], [], 0
            for i in range(0, len(k), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(k[part].view(np.int64)), pa.array(n[part])], [self.name, "n"])


@freed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally("word")
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for i, j in chunks(offsets):
            yield from tally.add(tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0])
    yield from tally.close()


class Lexicon:
    """The commonest words, by hash, with their counts and symbols; and totals."""

    def __init__(self, counts: DataFrame):
        # The lowest of some 16 count classes an octave at which no more than HEAD words remain.
        level = F.floor(F.log2("n") * 16)
        least, many = 0.0, 0
        for r in sorted(counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r["l"]):
            many += r["v"]
            if many > HEAD:
                least = r["l"] + 1
                break
        top = counts.filter(level >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
        word, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(float)
        by_bucket = {r["b"]: (r["n"], r["v"]) for r in counts.groupBy(F.expr("word & 63").alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
        self.total = sum(n for n, _ in by_bucket.values())
        self.distinct = sum(v for _, v in by_bucket.values())
        own = word[word != END][: SYMBOLS - TAILS - 1]
        unigram = np.full(SYMBOLS, 0.5)
        symbol = {int(END): 0} | {int(w): k + 1 for k, w in enumerate(own)}
        if END not in word:
            word, n = np.append(word, END), np.append(n, 0.0)
        order = np.argsort(word)
        self.word, self.n = word[order], n[order]
        bucket = SYMBOLS - TAILS + (self.word & _LOW).astype(np.int64)
        self.symbol = np.array([symbol.get(int(w), b) for w, b in zip(self.word, bucket, strict=True)], dtype=np.int64)
        mass = np.array([by_bucket.get(b, (0, 0)) for b in range(TAILS)], dtype=float)
        single = self.symbol < SYMBOLS - TAILS
        for w, c in zip(self.word[single & (self.word != END)], self.n[single & (self.word != END)], strict=True):
            mass[int(w & _LOW)] -= (c, 1)
        unigram[self.symbol[single]] += self.n[single]
        unigram[SYMBOLS - TAILS :] += mass[:, 0]
        #: of the symbols, smoothed
        self.unigram = unigram
        #: log10 of what a count plus a half is divided by, for words of no symbol's own
        self.within = np.log10(mass[:, 0] + 0.5 * (mass[:, 1] + 1))
        self.over_all = float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the lexicon, whether the words are there, and their symbols."""
        at = np.minimum(np.searchsorted(self.word, words), len(self.word) - 1)
        there = self.word[at] == words
        return at, there, np.where(there, self.symbol[at], SYMBOLS - TAILS + (words & _LOW).astype(np.int64))


def contexts(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each and the one before that; before a text stand ends."""
    one, two = np.full_like(words, END), np.full_like(words, END)
    one[1:] = np.where(doc[1:] == doc[:-1], words[:-1], END)
    two[2:] = np.where(doc[2:] == doc[:-2], words[:-2], END)
    return one, two


def feature_blocks(one: np.ndarray, two: np.ndarray, group: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each context's three features, a row a feature: for the classes, and for the
    symbols of ``group``."""
    keys = np.stack([mix64(one ^ _ODD[0]), mix64(two ^ _ODD[1]), mix64(mix64(one ^ _ODD[2]) + two)])
    free = np.uint64(blocks - _FIXED)
    inner = mix64(keys + (group.astype(np.uint64) + np.uint64(1)) * _ODD[3])
    return (keys % free).astype(np.int64) + _FIXED, (inner % free).astype(np.int64) + _FIXED


def _softmax(z: np.ndarray) -> np.ndarray:
    """By rows, in place. Halves are compared, as numpy's maximum along a short axis is slow."""
    top, width = z, z.shape[1]
    while width > 1:
        width //= 2
        top = np.maximum(top[:, :width], top[:, width:])
    z -= top
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], dtype=z.dtype))[:, None]
    return z


def _both(weights: np.ndarray, one: np.ndarray, two: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks, the features' rows first; and softmaxes of the classes, then of the symbols in each
    symbol's own class."""
    n, group = len(symbol), symbol // CLASS_SIZE
    outer, inner = feature_blocks(one, two, group, len(weights))
    z = np.empty((2 * n, weights.shape[1]), dtype=weights.dtype)
    z[:n] = weights[0]
    weights.take(1 + group, axis=0, out=z[n:], mode="clip")
    for k in range(len(outer)):
        z[:n] += weights.take(outer[k], axis=0, mode="clip")
        z[n:] += weights.take(inner[k], axis=0, mode="clip")
    return outer, inner, _softmax(z)


def log_probability(weights: np.ndarray, one: np.ndarray, two: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """log10 of p(class | context) p(symbol | class, context), by batches."""
    out = np.empty(len(symbol))
    for i in range(0, len(symbol), STEP):
        part = slice(i, i + STEP)
        s = symbol[part]
        p = _both(weights, one[part], two[part], s)[2]
        row = np.arange(len(s))
        out[part] = np.log10(p[row, s // CLASS_SIZE].astype(float)) + np.log10(p[row + len(s), s % CLASS_SIZE].astype(float))
    return out


def gradient(weights: np.ndarray, one: np.ndarray, two: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log-likelihood: the blocks that it moves, how often each was met, and its rows."""
    outer, inner, slope = _both(weights, one, two, symbol)
    row, n = np.arange(len(symbol)), len(symbol)
    slope[row, symbol // CLASS_SIZE] -= 1
    slope[row + n, symbol % CLASS_SIZE] -= 1
    np.negative(slope, out=slope)
    # A block's number and its row of slopes make one key, of 32 bits if they fit.
    bits = (2 * n - 1).bit_length()
    kind = np.uint32 if bits + (len(weights) - 1).bit_length() <= 32 else np.uint64
    key = np.concatenate([outer << bits | row, inner << bits | (row + n)], axis=None).astype(kind)
    key.sort()
    block, place = (key >> kind(bits)).astype(np.int64), (key & kind((1 << bits) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    met = np.diff(np.append(first, len(block)))
    g = slope.take(place[first], axis=0)
    many = np.flatnonzero(met > 1)
    if len(many):
        size = met[many]
        begin = np.cumsum(size) - size
        rows = slope.take(place[np.repeat(met > 1, met)], axis=0)
        # Pairs of numbers are added as one complex number: half as many sums.
        pairs = np.complex64 if rows.dtype == np.float32 else np.complex128
        g[many] = np.add.reduceat(rows.view(pairs), begin, axis=0).view(rows.dtype)
    return block[first], met, g


def start(lexicon: Lexicon) -> np.ndarray:
    """Weights before training: those of the unigram model."""
    want = max(int(lexicon.total) // BLOCK_TOKENS, 1)
    weights = np.zeros((min(max(1 << (want - 1).bit_length(), LEAST_BLOCKS), MOST_BLOCKS), CLASS_SIZE), dtype=np.float32)
    by_class = lexicon.unigram.reshape(CLASS_SIZE, CLASS_SIZE)
    weights[0], weights[1:_FIXED] = np.log(by_class.sum(axis=1)), np.log(by_class)
    return weights


class _Learner:
    """One task's copy of the weights, moved by gradients; ``scale``: of each block, the sum
    of squares of its gradients' rows so far."""

    def __init__(self, weights: np.ndarray, scale: np.ndarray):
        self.before, self.weights, self.scale = weights, weights.copy(), scale.copy()
        self.met = np.zeros(len(weights))

    def update(self, one: np.ndarray, two: np.ndarray, symbol: np.ndarray) -> None:
        for i in range(0, len(symbol), STEP):
            part = slice(i, i + STEP)
            block, met, g = gradient(self.weights, one[part], two[part], symbol[part])
            self.met[block] += met
            scale = self.scale[block] + np.einsum("ij,ij->i", g, g)
            self.scale[block] = scale
            g *= (RATE / np.sqrt(scale))[:, None]
            g += self.weights.take(block, axis=0)
            self.weights[block] = g

    def moves(self) -> Iterator[pa.RecordBatch]:
        """By PART blocks: which were met, how often, their moves and their scales."""
        for k in range(0, len(self.weights), PART):
            at = k + np.flatnonzero(self.met[k : k + PART])
            if len(at):
                yield _moved(k // PART, 0, at, self.met[at], self.weights[at] - self.before[at], self.scale[at])


def _moved(part: int, slot: int, at: np.ndarray, met: np.ndarray, move: np.ndarray, scale: np.ndarray) -> pa.RecordBatch:
    """One row; moves travel with 11 significant bits."""
    raw = [at.astype(np.int32), met.astype(np.float32), move.astype(np.float16), scale.astype(np.float32)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([slot], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in raw)], ["part", "slot", "at", "met", "move", "scale"])


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at, met = np.frombuffer(row["at"], np.int32), np.frombuffer(row["met"], np.float32)
    return at, met, np.frombuffer(row["move"], np.float16).reshape(-1, CLASS_SIZE), np.frombuffer(row["scale"], np.float32)


@freed
def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Averages of moves and scales by block and slot, weighted by how often tasks met it. Rows are
    taken one by one, so what is held is PART blocks for each part and slot."""
    held = {}
    for batch in batches:
        for row in batch.to_pylist():
            at, met, move, scale = _read(row)
            key = row["part"], row["slot"]
            if key not in held:
                held[key] = np.zeros(PART), np.zeros((PART, CLASS_SIZE)), np.zeros(PART)
            n, m, s = held[key]
            k = at % PART
            n[k] += met
            m[k] += met[:, None].astype(float) * move
            s[k] += met.astype(float) * scale
    for (part, slot), (n, m, s) in held.items():
        k = np.flatnonzero(n)
        yield _moved(part, slot, k + part * PART, n[k], m[k] / n[k][:, None], s[k] / n[k])


def train(texts: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Blocks of weights, learnt from all the texts."""
    context = texts.sparkSession.sparkContext
    weights = start(lexicon)
    scale = np.ones(len(weights), dtype=np.float32)
    kind = "part int, slot int, at binary, met binary, move binary, scale binary"
    texts = texts.coalesce(max(-(-int(lexicon.total) // TASK_TOKENS), 1))
    tasks = texts.rdd.getNumPartitions()
    for _ in range(EPOCHS):
        shared = context.broadcast((lexicon, weights, scale))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lex, *now = shared.value
            learner = _Learner(*now)
            for batch in batches:
                data, offsets = text_bytes(batch.column("text"))
                for i, j in chunks(offsets):
                    words, doc = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    learner.update(*contexts(words, doc), lex.find(words)[2])
            yield from learner.moves()

        moves, slots = texts.mapInArrow(freed(learn), kind).withColumn("slot", F.spark_partition_id()), tasks
        while True:  # a tree, so that no task reads the moves of more than FAN others for a part
            slots = -(-slots // FAN)
            dealt = moves.withColumn("slot", F.expr(f"int(slot div {FAN})")).repartition(slots * -(-len(weights) // PART), "part", "slot")
            moves = dealt.mapInArrow(_mixed, kind)
            if slots <= 1:
                break
        mixed = moves.toArrow()  # a row for each part, bounded by MOST_BLOCKS
        weights, scale = weights.copy(), scale.copy()
        for row in mixed.to_pylist():
            at, _, move, new = _read(row)
            weights[at] += move
            scale[at] = new
        shared.unpersist()
    return weights


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is an empty one: it is one token, the end. Null ids train. With nothing to
    train on every count is 0. An empty table gives an empty result; further columns are
    ignored.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold() == 1).alias("held_out"), "text")
    texts = rows.filter(~F.col("held_out")).select("text")
    counts = cut(texts.mapInArrow(_count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    lexicon = Lexicon(counts)
    weights = train(texts, lexicon)
    shared = spark.sparkContext.broadcast((lexicon, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, learnt = shared.value
        half = np.log10(lex.n + 0.5)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                words, doc = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, there, symbol = lex.find(words)
                n = j - i
                mine = np.where(there, half[at], 0.0)
                tail = symbol >= SYMBOLS - TAILS
                model = log_probability(learnt, *contexts(words, doc), symbol)
                model += np.where(tail, mine - lex.within[np.maximum(symbol - (SYMBOLS - TAILS), 0)], 0.0)
                rare, owner = words[~there], doc[~there]
                order = np.lexsort((rare, owner))
                rare, owner = rare[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1])])) if len(rare) else np.zeros(0, np.int64)
                ends = pa.array(np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32))
                times = np.diff(np.append(first, len(rare))).astype(np.int32)
                part = batch.slice(i, n)
                size = np.bincount(doc, minlength=n)
                columns = [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(size),
                    pa.array(np.bincount(doc, there & (lex.n[at] > 0), minlength=n).astype(np.int64)),
                    pa.array(np.bincount(doc, mine, minlength=n) - size * lex.over_all),
                    pa.array(np.bincount(doc, model, minlength=n)),
                    pa.ListArray.from_arrays(ends, pa.array(rare[first].view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(times)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare", "times"]
    kind = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, rare array<bigint>, times array<int>"
    found = cut(rows.mapInArrow(run, kind).withColumn("uid", F.monotonically_increasing_id()))
    pairs = found.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    joined = pairs.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = joined.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    whole = found.drop("rare", "times").join(sums, "uid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(int(lexicon.total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
