"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled web text train a logistic model of text shape: the risk of the negative class is
estimated from unlabelled text less the share of positives in it (the class prior), and kept from falling below zero,
where a plain unbiased estimate would overfit. Training takes bounded seeded samples; scoring reads every whole text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import as_text, documents
from granary.llm.hashing import U, groups, mix, prefix_sums, shingles, span_hashes, words

#: Rows of each training sample at most, taken in the order of a hash of doc_id.
SAMPLE = 8000
THRESHOLD = 0.7
EPOCHS, RATE, DECAY = 400, 0.05, 1e-3
#: The prior is read where at least this share of the positives scores higher: fewer would be left to chance.
TAIL = 0.2

CHARACTERS = "\n .,!?;:'\"-()|#*$%&<>/@=_"


def _classes() -> tuple[np.ndarray, int]:
    """A class for each byte: 0 lower case and bytes of other letters, 1 upper case, 2 digits, one for each of
    CHARACTERS, and the last for any other."""
    n = 3 + len(CHARACTERS) + 1
    out = np.full(256, n - 1)
    out[ord("a") : ord("z") + 1] = 0
    out[128:] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    for i, c in enumerate(CHARACTERS):
        out[ord(c)] = 3 + i
    return out, n


CLASS, CLASSES = _classes()
STATISTICS = 6
FEATURES = CLASSES + CLASSES * CLASSES + STATISTICS


def _repeated(of: np.ndarray, hashes: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """Share of a text's items that equal an earlier one."""
    pairs = np.unique(mix(hashes + of.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)[1]
    kinds = np.bincount(of[pairs], minlength=n)
    return 1 - kinds / np.maximum(total, 1) * (total > 0) - (total == 0)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: square roots of the shares of byte classes and of neighbouring pairs of them, and repetition."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    of = np.repeat(np.arange(n), size)
    c = CLASS[data]
    if len(data) > 1:  # two-byte capitals: a lead byte 0xC3 and 0x80 to 0x9E
        c[1:][(data[:-1] == 0xC3) & (data[1:] < 0x9F)] = 1
    one = np.bincount(of * CLASSES + c, minlength=n * CLASSES).reshape(n, CLASSES)
    inner = of[1:] == of[:-1] if len(data) else np.zeros(0, bool)
    pair = np.bincount((of[1:] * CLASSES + c[:-1])[inner] * CLASSES + c[1:][inner], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    per = np.maximum(size, 1)[:, None]
    out = [np.sqrt(one / per), np.sqrt(pair / per)]
    w_of, starts, ends = words(data, offsets)
    many = np.bincount(w_of, minlength=n)
    h = mix(span_hashes(prefix_sums(data), starts, ends)) if len(w_of) else np.zeros(0, U)
    again = np.zeros(n)
    if len(w_of) > 1:
        again = np.bincount(w_of[1:][(h[1:] == h[:-1]) & (w_of[1:] == w_of[:-1])], minlength=n)
    s_of, s = shingles(data, offsets, 3)
    length = np.bincount(w_of, weights=ends - starts, minlength=n) / np.maximum(many, 1)
    out.append(np.stack([
        np.log1p(many) / 10, np.log1p(length) / 2, _repeated(w_of, h, n, many), again / np.maximum(many, 1),
        np.sqrt(np.maximum(_repeated(s_of, s, n, np.bincount(s_of, minlength=n)), 0)), (many == 0).astype(float),
    ], axis=1))
    return np.concatenate(out, axis=1).astype(np.float32)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled text, from trusted positives and that text alone; kept off 0 and 1.

    A model that tells positives from unlabelled text is fitted on the even rows. Wherever a threshold is set on the odd
    rows, the unlabelled share above it is at least the prior times the positives' share: the least ratio is the
    estimate, and is reached where hardly any negatives score so high. Chance makes it lean low, by some hundredths for
    a thousand positives: the safe side, since too high a prior takes negatives for positives.
    """
    if len(positive) < 20 or len(unlabelled) < 20:
        return 0.5
    mean, scale, w, b = fit_nnpu(positive[::2], unlabelled[::2], None)
    p, u = (np.sort((x[1::2] - mean) / scale @ w + b) for x in (positive, unlabelled))
    at = np.unique(np.quantile(p, np.linspace(0, 1 - TAIL, 81)))
    above = [1 - np.searchsorted(x, at, side="left") / len(x) for x in (p, u)]
    return float(min(0.98, max(0.02, (above[1] / above[0]).min())))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, bias) of a logistic model that minimises the non-negative unbiased risk, by Adam.

    Without a prior, of one that tells positives from unlabelled text.
    """
    plain, prior = prior is None, prior or 0.5
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 0.02
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, epochs + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, gp = su / len(su), prior * sp / len(sp)  # of the negative risk
        if plain:
            zgu, zgp = prior * gu, prior * (sp - 1) / len(sp)
        elif negative >= 0:
            zgu, zgp = gu, -gp + prior * (sp - 1) / len(sp)
        else:  # go back up: only the negative risk, the other way
            zgu, zgp = -gu, gp
        g = np.append(u.T @ zgu + p.T @ zgp + DECAY * w, zgu.sum() + zgp.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * min(1.0, 2 * (1 - t / (epochs + 1)))
        w, b = w - step[:-1], b - float(step[-1])
    return mean, scale, w, b


def _sample(docs: DataFrame, ids: DataFrame, n: int) -> np.ndarray:
    """Features of the documents with at most n of the given ids: those of least hash."""
    chosen = ids.filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "_chosen")), F.col("doc_id") == F.col("_chosen"), "left_semi")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in groups(batch.column("text")):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    got = rows.mapInArrow(of, "doc_id long, x binary").collect()  # n rows of FEATURES numbers, but for repeated ids
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    return np.stack([np.frombuffer(r["x"], np.float32) for r in got[: 2 * n]]).astype(np.float64) if got else np.zeros((0, FEATURES))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, prior: float | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), from the text alone.

    labels (doc_id, quality) are read where held_out is false; rows with a null doc_id or quality teach nothing. At most
    `sample` positives and as many documents without a label train; labels other than 1 are not read. Without a prior, it
    is estimated from the two samples. Without positives, or without unlabelled text, every score is the prior, or 0.5. A null text is empty; empty texts are scored like others; repeated rows get equal scores;
    no rows give no rows; further columns are not read.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_text(text).alias("text"))
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    positive = _sample(slim, known.filter("quality = 1").select("doc_id"), sample)
    others = slim.select("doc_id").join(known.select("doc_id"), "doc_id", "left_anti")
    unlabelled = _sample(slim, others, sample)
    if len(positive) and len(unlabelled):
        mean, scale, w, b = fit_nnpu(positive, unlabelled, prior or estimated_prior(positive, unlabelled))
        w = w / scale
        b = b - float(mean @ w)
    else:
        prior = prior or 0.5
        w, b = np.zeros(FEATURES), float(np.log(prior / (1 - prior)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in groups(batch.column("text")):
                z = features(data, offsets) @ w + b
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(z)), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return slim.mapInArrow(score, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score_quality(documents(spark, sf_dir), labels)
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
