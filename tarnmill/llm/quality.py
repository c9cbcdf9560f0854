"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

The raw model counts the n-grams of all documents, the target model those of documents labelled
good. A document's log weight is the log ratio of the two over its n-grams. The k documents with the
greatest log weight plus Gumbel noise are a sample without replacement with chances in proportion to
the weights. Unless given, k is the number of documents whose weight lies above the cut that tells
good from bad best on labelled documents that the target model hasn't seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import Scratch, bounded_batches, by_size, collect_counts, count_blocks, free_others, mix, run_hashes, texts_of, with_fields

#: Hash buckets of the n-gram models: 1 MB of weights in each worker, at every size of the input.
BUCKET_BITS = 17
#: Labelled documents used at most (ids and labels are broadcast); the raw model counts all documents.
MAX_LABELLED = 50_000
#: What is added to seen and expected counts of a bucket.
SMOOTHING = 2.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _ngrams(tokens: np.ndarray) -> np.ndarray:
    """Buckets of a document's tokens, pairs, and of the mark for a token that comes again at once or after one other."""
    with np.errstate(over="ignore"):
        pairs = mix(tokens[:-1] * _STEP ^ tokens[1:])
        again = [np.full(np.count_nonzero(tokens[:-d] == tokens[d:]), mix(_STEP * np.array([d], np.uint64))[0], np.uint64) for d in (1, 2) if len(tokens) > d]
    return (np.concatenate([tokens, pairs, *again]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count(batches):
    """Counts of raw text in the first half of the buckets, of target text in the second."""
    free_others()
    size = 1 << BUCKET_BITS
    counts = np.zeros(2 * size, np.int64)
    for batch in batches:
        texts, target = texts_of(batch.column(0)), batch.column(1).fill_null(False).to_pylist()
        for lo, hi in by_size(texts):
            tokens, bounds = run_hashes(texts[lo:hi])
            raw, good = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(hi - lo):
                grams = _ngrams(tokens[bounds[k] : bounds[k + 1]])
                raw.append(grams)
                if target[lo + k]:
                    good.append(grams)
            counts[:size] += np.bincount(np.concatenate(raw), minlength=size)
            counts[size:] += np.bincount(np.concatenate(good), minlength=size)
    yield from count_blocks(counts)


def _weights(ratio):
    """Adds the log weight; null for a document without tokens."""

    def weigh(batches):
        free_others()
        table = ratio.value
        for batch in batches:
            texts, out = texts_of(batch.column("text")), []
            for lo, hi in by_size(texts):
                tokens, bounds = run_hashes(texts[lo:hi])
                for k in range(hi - lo):
                    mine = tokens[bounds[k] : bounds[k + 1]]
                    out.append(float(table[_ngrams(mine)].sum()) if len(mine) else None)
            yield batch.append_column("log_weight", pa.array(out, pa.float64()))

    return weigh


def _labels(labels: DataFrame) -> DataFrame:
    """The labelled documents that are used: one label each (the lower of several), the bound taken by a hash of the id."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    return one.orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0)


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Per bucket the log ratio of target to raw text, from counts over all documents."""
    known = F.broadcast(_labels(labels))
    rows = docs.select("doc_id", "text").join(known, "doc_id", "left").select("text", (F.col("good") & ~F.col("held")).alias("target"))
    counts = collect_counts(rows.mapInArrow(_count, "block int, counts binary"), 2 << BUCKET_BITS)
    raw, good = counts[: 1 << BUCKET_BITS], counts[1 << BUCKET_BITS :]
    expected = raw * (good.sum() / max(raw.sum(), 1))
    return np.log((good + SMOOTHING) / (expected + SMOOTHING))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise that depends on id and seed alone."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the least share of errors in both classes together; of ties the lowest."""
    values = np.unique(np.concatenate([good, bad]))
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    passed = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[np.argmin(lost + passed)])


def kth_largest(values: DataFrame, k: int) -> float:
    """The k-th largest of a column ``x`` without nulls, by histograms of 4096 bins that close in on it."""
    lo, hi, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if k <= 0 or not n:
        return np.inf
    if k >= n:
        return lo
    above, bins = 0, 4096
    while True:
        width = (hi - lo) / bins
        inside = values.where(F.col("x").between(lo, hi))
        if width <= 0 or lo + width == lo:
            return lo
        place = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1))
        rows = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy(F.desc("b")).collect()
        for r in rows:
            if above + r.n >= k:
                break
            above += r.n
        if r.n == 1 or r.lo == r.hi:
            return r.lo
        lo, hi = r.lo, r.hi


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 1) -> DataFrame:
    """The k documents drawn from ``docs(doc_id, text, ...)``, all columns, with ``log_weight`` and ``perturbed``.

    ``labels(doc_id, quality, ...)`` names good documents by a quality above 0. Without k, see above;
    without labels of both kinds every document with tokens is kept. Documents without tokens (null,
    empty or blank text) have no weight and are never drawn. Rows that tie at the k-th place are all
    drawn, which repeated rows do. Null ids share their noise. An empty table gives an empty result;
    columns ``log_weight`` and ``perturbed`` of the input are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("log_weight", "perturbed")
    ratio = spark.sparkContext.broadcast(log_ratios(docs, labels))

    def weighed(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(_weights(ratio), with_fields(rows.schema, log_weight=DoubleType()))

    noisy = F.col("log_weight") + gumbel(F.col("doc_id"), seed)
    scratch = Scratch(spark, "quality")
    scores = weighed(docs.select("doc_id", "text")).select("doc_id", "log_weight").where("log_weight is not null")
    scores = scratch.save(scores.withColumn("x", noisy), "scores")
    if k is None:
        known = scores.join(F.broadcast(_labels(labels)), "doc_id").where("not good or held").groupBy("doc_id", "good").agg(F.min("log_weight").alias("log_weight")).collect()
        cut = best_cut(np.array([r.log_weight for r in known if r.good]), np.array([r.log_weight for r in known if not r.good]))
        k = scores.where(F.col("log_weight") > F.lit(cut)).count()
    least = kth_largest(scores, k)
    scratch.drop("scores")
    return weighed(docs).withColumn("perturbed", noisy).where(F.col("perturbed") >= F.lit(float(least)))
