"""Quality classification by Bradley-Terry pairwise ranking.

Each text becomes a vector of shape statistics. A pair (text labelled 1, text labelled 0)
is a preference; weights are learnt by the logistic loss on the difference of the two
vectors, so that sigma(w . (x_i - x_j)) is the chance that i is preferred to j. The
threshold is the quantile of the training utilities that leaves as many texts below it as
there are labels 0, and scores are laid so that they are CUT there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Words, chunks, fold, freed, read_table, text_bytes

#: The classifier is fitted on at most so many labelled rows, those with the smallest
#: hashed ids; the sample is all that is bounded: every document is scored.
MAX_LABELLED = 8192
CUT, STEPS, PAIRS, RIDGE, SEED = 0.3, 400, 2048, 1e-4, 11
_KINDS = 8


def _kinds() -> np.ndarray:
    """lower, upper, digit, blank, newline, sentence marks, other marks, above ASCII."""
    kind = np.full(256, 6, dtype=np.int64)
    kind[128:] = 7
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[32, 9]], kind[[10, 13]] = 3, 4
    kind[[ord(c) for c in ".,;:?'\"-()"]] = 5
    return kind


_KIND = _kinds()
EXTRA = 8
WIDTH = _KINDS**3 + EXTRA


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of WIDTH statistics for each text: square roots of the shares of trigrams of
    character kinds; then its length, mean word length, share of distinct words, of words
    equal to the one before, of the commonest word, words a line, and share of repeated
    lines and of marks at word ends. An empty text has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), dtype=np.float32)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    kind = _KIND[data]
    if len(data) >= 3:
        tri = (kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:]
        same = owner[:-2] == owner[2:]
        counted = np.bincount(owner[:-2][same] * _KINDS**3 + tri[same], minlength=n * _KINDS**3).reshape(n, -1)
        out[:, : _KINDS**3] = np.sqrt(counted / np.maximum(size, 1)[:, None])
    x = out[:, _KINDS**3 :]
    w = Words(data, offsets)
    words = np.bincount(w.doc, minlength=n)
    least = np.maximum(words, 1)
    x[:, 0] = np.log1p(size) / 10
    x[:, 1] = np.minimum(size / least, 50) / 10 * (size > 0)
    if len(w.hash):
        order = np.lexsort((w.hash, w.doc))
        h, d = w.hash[order], w.doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        run = np.diff(np.append(np.flatnonzero(new), len(h)))
        x[:, 2] = np.bincount(d[new], minlength=n) / least
        top = np.zeros(n)
        np.maximum.at(top, d[new], run)
        x[:, 4] = top / least
        twin = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        x[:, 3] = np.bincount(w.doc[1:][twin], minlength=n) / least
        x[:, 7] = np.bincount(w.doc, _KIND[data[w.end - 1]] == 6, minlength=n) / least
    lines = np.bincount(owner[kind == 4], minlength=n) + 1
    x[:, 5] = np.log1p(words / lines) / 5
    x[:, 6] = np.minimum(lines / least, 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Weights and threshold from vectors and labels 0 and 1. Without both labels every
    text gets the score 0.5."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 0.01) if len(x) else (0.0, 1.0)
    if not len(good) or not len(bad):
        return {"w": np.zeros(WIDTH), "mean": np.zeros(WIDTH), "spread": np.ones(WIDTH), "at": None, "scale": 1.0}
    z = (x - mean) / spread
    rng = np.random.default_rng(SEED)
    w, m, v = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    for t in range(1, STEPS + 1):
        diff = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        g = -(diff * p[:, None]).mean(axis=0) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    u = z @ w
    share = len(bad) / len(y)
    scale = max(float(np.std(u)), 1e-6)
    return {"w": w, "mean": mean, "spread": spread, "at": float(np.quantile(u, share)), "scale": scale}


def utility(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1; CUT at the threshold."""
    if model["at"] is None:
        return np.full(len(x), 0.5)
    u = 4 * (((x - model["mean"]) / model["spread"]) @ model["w"] - model["at"]) / model["scale"] + np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(u, -700, 700)))


@freed
def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for i, j in chunks(offsets):
            x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            flat = pa.array(x.ravel(), pa.float32())
            ends = pa.array(np.arange(0, len(x) * WIDTH + 1, WIDTH, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(i, j - i), pa.ListArray.from_arrays(ends, flat)], ["quality", "x"])


def train(documents: DataFrame, labels: DataFrame) -> dict:
    """Fit on the labelled documents outside the held-out fold, MAX_LABELLED at most."""
    sample = (
        labels.filter((fold() != 0) & F.col("quality").isin(0, 1))
        .select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("__id"), "quality")
        .limit(MAX_LABELLED)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    got = rows.select("quality", "text").orderBy(F.xxhash64("__id"), "quality").limit(MAX_LABELLED)
    table = got.mapInArrow(_vectors, "quality int, x array<float>").toArrow()
    x = table.column("x").combine_chunks()
    return fit(x.flatten().to_numpy().reshape(-1, WIDTH).astype(float), table.column("quality").to_numpy())


def score(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; null text: empty; null
    ids count as held out. Equal texts get equal scores; further columns are ignored."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            got = [np.zeros(0)]
            for i, j in chunks(offsets):
                got.append(utility(shared.value, features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
            s = np.concatenate(got)
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold() == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return score(documents, train(documents, read_table(spark, sf_dir, "labels")))
