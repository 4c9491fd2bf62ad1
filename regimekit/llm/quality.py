"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

The target model counts the n-grams of a bounded sample of documents labelled good, the raw model
those of all documents.  A document's log weight is the sum over its n-grams of
log p_target - log p_raw, tempered for their dependence (below).  Keys are log weight + Gumbel noise, and the k documents with the
largest keys are a sample without replacement in proportion to the weights.  k is the number of
documents that the two models do not rule out as target text.

n-grams: three bytes; words and pairs of adjacent words, where a word that repeats the one
before counts as one fixed pair, and runs of three to five equal words.  They are hashed to a fixed
number of buckets.  The n-grams of a text are not independent draws: neighbours overlap and one text has one
topic, so the sum of n log ratios carries the evidence of n / (1 + (n - 1) * dependence) independent ones (the
design effect of n draws that correlate by ``dependence``).  A text's log weight is therefore the sum over its
n-grams of log p_target - log p_raw, divided by 1 + (n - 1) * dependence, by the same rule at every length; with a
dependence of 0 it is the plain sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimekit.llm import common as C
from regimekit.llm import kernels as K

BYTE_BITS, WORD_BITS = 16, 14
BUCKETS = (1 << BYTE_BITS) + (1 << WORD_BITS)
RUNS = 3
DEPENDENCE = 1 / 32  # correlation of the log ratios of a text's n-grams
SCALE = 1 << 16  # log ratios are whole multiples of 1 / SCALE, so sums do not depend on their order


def features(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, n+1 positions of each document's first), byte and word kinds."""
    n = len(offsets) - 1
    if len(raw) >= 3:
        b = raw.astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        ok = np.ones(len(code), dtype=bool)
        for k in (1, 2):
            at = offsets[1:] - k
            ok[at[(at >= 0) & (at < len(code))]] = False
        code = code[ok]
        with np.errstate(over="ignore"):
            byte = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BYTE_BITS)).astype(np.int64)
    else:
        byte = np.zeros(0, np.int64)
    byte_first = np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - 2, 0))])
    h, first = K.words(raw, offsets)
    pairs, pairs_first = K.ngrams(h, first, 2)
    if len(pairs):
        second = np.ones(len(h), dtype=bool)
        second[first[:-1][first[:-1] < len(h)]] = False
        at = np.flatnonzero(second)
        again = np.zeros(len(h), dtype=bool)
        again[at] = h[at] == h[at - 1]
        pairs = np.where(again[at], K.U64(1), pairs)
        runs = []
        for order in range(RUNS):  # bucket RUNS + i: the word repeats the i + 2 words before it
            again[1:] &= again[:-1]
            again[0] = False
            runs.append((np.full(int(again.sum()), (1 << BYTE_BITS) + 1 + order), np.searchsorted(np.flatnonzero(again), first)))
    else:
        runs = []
    shift = K.U64(64 - WORD_BITS)
    return [(byte, byte_first), *(((x >> shift).astype(np.int64) + (1 << BYTE_BITS), f) for x, f in ((h, first), (pairs, pairs_first))), *runs]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """``bucket, raw, target``: n-gram counts over all rows of (text, good) and over those with good true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good_rows = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, raw, offsets in K.chunks(batch.column(0)):
                for x, first in features(raw, offsets):
                    counts[0] += np.bincount(x, minlength=BUCKETS)
                    counts[1] += np.bincount(x[np.repeat(good_rows[i:j], np.diff(first))], minlength=BUCKETS)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "raw", "target"])

    rows = docs.select("text", "good").mapInArrow(K.tidy(run), "bucket int, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """Scaled log p_target - log p_raw of each bucket, add-one smoothed within each kind of n-gram."""
    c = np.zeros((2, BUCKETS))
    for bucket, raw, target in counts:
        c[:, bucket] = raw, target
    out = np.zeros(BUCKETS)
    for part in (slice(0, 1 << BYTE_BITS), slice(1 << BYTE_BITS, BUCKETS)):
        p = c[:, part] + 1.0
        p /= p.sum(axis=1, keepdims=True)
        out[part] = np.log(p[1]) - np.log(p[0])
    return np.round(out * SCALE).astype(np.int64)


def score_texts(texts: pa.Array, ratios: np.ndarray, dependence: float = DEPENDENCE) -> np.ndarray:
    """Log importance weight of each text; 0 for a text without n-grams."""
    parts = [np.zeros(0)]
    for _, _, raw, offsets in K.chunks(texts):
        total, n = np.zeros((2, len(offsets) - 1), np.int64)
        for x, first in features(raw, offsets):
            total += K.segment(np.add, ratios[x], first, 0)
            n += np.diff(first)
        parts.append(total / SCALE / (1.0 + np.maximum(n - 1, 0) * dependence))
    return np.concatenate(parts)


class Model:
    """Fitted ratios, as a column function; small (one number per bucket) and equal in every task."""

    def __init__(self, ratios: np.ndarray, share: float, dependence: float = DEPENDENCE):
        self.ratios, self.share, self.dependence = ratios, share, dependence

    def score(self, text):
        ratios, dependence = self.ratios, self.dependence

        @F.arrow_udf("double")
        def log_weight(t: pa.Array) -> pa.Array:
            out = pa.array(score_texts(t, ratios, dependence))
            K.give_back()
            return out

        return log_weight(text)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_target: int = 20_000, seed: int = 5, dependence: float = DEPENDENCE) -> Model:
    """Fit on all of ``docs`` (raw) and on at most ``max_target`` documents with quality 1 (target).

    The sample is the ``max_target`` good labels least by a hash of doc_id.  ``share`` is the share of
    good ones among all labels (1 where there is none).
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_l_id")).agg(F.min("quality").alias("quality"))
    good, n = known.agg(F.count(F.when(F.col("quality") == 1, 1)), F.count("*")).first()
    sample = known.where("quality = 1").orderBy(F.xxhash64("_l_id", F.lit(seed)), "_l_id").limit(max_target).select("_l_id", F.lit(True).alias("_good"))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("text"))
    # at most `max_target` ids: bounded whatever the input's size
    rows = rows.join(F.broadcast(sample), F.col("_id") == F.col("_l_id"), "left").select("text", F.coalesce("_good", F.lit(False)).alias("good"))
    counts = [tuple(r) for r in count_ngrams(rows).collect()]  # at most BUCKETS rows
    if not good:
        counts = [(b, raw, raw) for b, raw, _ in counts]
    return Model(log_ratios(counts), good / n if n and good else 1.0, dependence)


def gumbel(doc_id, seed: int):
    """Standard Gumbel noise from a hash of doc_id: reruns and repeated rows draw alike."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", min_posterior: float = 0.005, max_target: int = 20_000, seed: int = 5, dependence: float = DEPENDENCE) -> tuple[DataFrame, Model, float | None]:
    """``doc_id, log_weight, key, kept`` of every row, the model, and the least key kept (None: none).

    k = number of rows whose posterior of being target text, ``share * exp(log_weight)``, is ``min_posterior``
    or more; the k largest keys are kept (all rows that tie with the k-th too).  A null, empty or very short text has
    no n-grams and weight 1.  Rows with a null doc_id share one draw.  Repeated rows have equal
    keys.  An empty table gives no rows; without good labels every weight is 1 and all is kept.  Other
    columns are not read.
    """
    C.prepare(docs.sparkSession)
    model = fit(docs, labels, text, doc_id, max_target, seed, dependence)
    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), model.score(F.col(text).cast("string")).alias("log_weight"))
    scored = C.stage(scored.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "quality-scores")
    floor = float(np.log(min_posterior) - np.log(model.share))
    k = scored.where(F.col("log_weight") >= F.lit(floor)).count()
    least = C.kth_largest(scored, "key", k)
    kept = F.col("key") >= F.lit(least) if least is not None else F.lit(False)
    return scored.withColumn("kept", kept), model, least


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that ``resample`` keeps; scored again on the way, so no text is shuffled."""
    seed = options.get("seed", 5)
    _, model, least = resample(docs, labels, text, doc_id, **options)
    if least is None:
        return docs.limit(0)
    return docs.where(model.score(F.col(text).cast("string")) + gumbel(F.col(doc_id).cast("long"), seed) >= F.lit(least))
