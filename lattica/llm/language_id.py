"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters (lower-cased, anything but letters as one
kind of gap) in BUCKETS buckets for each label. Every partition counts in numpy and
emits a row for each label and bucket that it met; Spark adds them up. The log
probabilities, labels x BUCKETS numbers, are then broadcast, and texts are scored in
batches: each n-gram looks up one row of that matrix, and rows are summed by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import chunks, fold, freed, mix64, read_table, text_bytes

BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
#: The bucket under which a label's documents are counted.
PRIOR = -1
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter (categories L*)."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and text numbers of all n-grams, and whether each text has a letter.

    A gap stands before and after each text and for each run of other characters; a gap
    alone is no n-gram. What a text yields does not depend on its neighbours.
    """
    joined = "".join([f"\x00{t} " for t in texts]).lower()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # Lower-casing can lengthen a text, so starts are found after it; a NUL inside a text
    # would look like a start and is taken out by the caller.
    letter, start = _letters()[code], code == 0
    doc = np.cumsum(start) - 1
    keep = letter | start
    keep[1:] |= letter[:-1]
    code, letter, doc = np.where(letter, code, 0)[keep], letter[keep], doc[keep]
    has = np.zeros(len(texts), dtype=bool)
    has[doc[letter]] = True
    buckets, owners = [], []
    h = np.zeros(len(code), dtype=np.uint64)
    for n in ORDERS:
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :].astype(np.uint64) + np.uint64(1)
        first, last = doc[: len(h)], doc[n - 1 :]
        use = (first == last) & (letter[: len(h)] if n == 1 else True)
        buckets.append((mix64(h[use] ^ np.uint64(n << 56)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        owners.append(first[use])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), has
    return np.concatenate(buckets), np.concatenate(owners), has


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    column = batch.column("text")
    _, offsets = text_bytes(column)
    for i, j in chunks(offsets, 1 << 19):
        yield i, j, [(x or "").replace("\x00", " ") for x in column.slice(i, j - i).to_pylist()]


@freed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i, j, texts in _batches(batch):
            bucket, owner, has = _grams(texts)
            names = sorted({x for x, h in zip(langs[i:j], has, strict=True) if h})
            number = {x: k for k, x in enumerate(names)}
            label = np.array([number.get(x, 0) for x in langs[i:j]])
            made = np.bincount(label[owner] * BUCKETS + bucket, minlength=len(names) * BUCKETS) if len(owner) else np.zeros(0)
            for x, k in number.items():
                counts[x] = counts.get(x, 0) + made[k * BUCKETS : (k + 1) * BUCKETS]
                docs[x] = docs.get(x, 0) + int((has & (label == k)).sum())
    for x, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": [x] * (len(at) + 1),
                "bucket": pa.array([PRIOR, *at.tolist()], pa.int32()),
                "n": pa.array([docs[x], *c[at].astype(np.int64).tolist()], pa.int64()),
            }
        )


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels in order, the BUCKETS x labels log probabilities, and the log priors.

    ``labelled`` has text and lang. Rows with a null lang, a null text or no letter
    teach nothing. The driver gets labels x BUCKETS sums at most.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sums.column("lang").to_pylist()
    labels = sorted(set(langs))
    number = {x: k for k, x in enumerate(labels)}
    label = np.array([number[x] for x in langs], dtype=np.int64)
    bucket, n = sums.column("bucket").to_numpy(), sums.column("n").to_numpy().astype(float)
    table = np.full((BUCKETS, len(labels)), SMOOTHING)
    prior = np.ones(len(labels))
    gram = bucket >= 0
    table[bucket[gram], label[gram]] += n[gram]
    prior[label[~gram]] = n[~gram]
    return labels, np.log(table / table.sum(axis=0, keepdims=True)) if labels else table, np.log(prior / prior.sum())


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], columns: list[str]) -> DataFrame:
    """The named columns of ``documents`` (text among them, to read) with lang_pred and
    score, the posterior of the predicted label. Text is returned only if named.

    A null text, one without a letter, or a model without labels gives ``und`` and 0.
    Equal posteriors go to the label that sorts first.
    """
    labels, table, prior = model
    shared = documents.sparkSession.sparkContext.broadcast((table.astype(np.float32), prior))

    @freed
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, first = shared.value
        for batch in batches:
            names, sure = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for i, j, texts in _batches(batch) if labels else ():
                bucket, owner, has = _grams(texts)
                logs = np.stack([np.bincount(owner, weights[bucket, k], minlength=j - i) for k in range(len(labels))], axis=1) + first
                best = logs.argmax(axis=1)
                part = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                names[i:j], sure[i:j] = np.where(has, best, -1), np.where(has, part, 0)
            out = [batch.column(c) for c in columns]
            out += [pa.array([labels[k] if k >= 0 else UNDETERMINED for k in names], pa.string()), pa.array(sure)]
            yield pa.RecordBatch.from_arrays(out, [*columns, "lang_pred", "score"])

    need = list(dict.fromkeys([*columns, "text"]))
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)
    return documents.select(*[F.col(f"`{c}`") for c in need]).mapInArrow(score, f"{kinds}, lang_pred string, score double")


def identify(documents: DataFrame) -> DataFrame:
    """Train on the folds that are not held out, and predict every document.

    Returns doc_id, held_out, lang_pred, score. Null ids count as held out; an empty
    table gives an empty result; further columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold() == 0).alias("held_out"), "text", "lang")
    model = train(rows.filter(~F.col("held_out")))
    return predict(rows, model, ["doc_id", "held_out"])


def keep_identified(documents: DataFrame, score: float = 0.5) -> DataFrame:
    """The documents in a language that the model knows, columns as they came: those
    predicted ``und`` go, and those whose best posterior is under ``score``."""
    model = train(documents.filter(fold() != 0).select("text", "lang"))
    names = documents.columns
    cols = ["text" if c == "text" else f"c{k}" for k, c in enumerate(names)]
    plain = documents.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(cols, names, strict=True)])
    found = predict(plain, model, cols).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= score))
    return found.select(*[F.col(k).alias(c) for k, c in zip(cols, names, strict=True)])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
