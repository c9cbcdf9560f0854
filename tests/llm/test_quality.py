import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarnmill.llm.quality import SMOOTHING, _labels, gumbel, kth_largest, log_ratios, resample
from tarnmill.llm.queries import op9_quality

SF = "/root/testdata/sf0.1"


def test_keeps_good_and_rejects_bad(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in op9_quality(spark, SF).collect()}
    good, bad = ([d for d, q in labels.items() if q == x] for x in (1, 0))
    assert sum(d in kept for d in good) > 0.99 * len(good)
    assert sum(d in kept for d in bad) < 0.05 * len(bad)


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(1, "A b, b!"), (2, "a b"), (3, None), (4, "!!! é x x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0)], "doc_id long, quality int")
    ratio = log_ratios(docs.repartition(3), labels)
    assert len(set(np.round(ratio, 9))) > 1 and np.isfinite(ratio).all()


def test_kth_largest(spark):
    values = [1.0, 5.0, 5.0, 2.0, -3.5, 1e9, 1e-9, 0.0] + [i / 7 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 3, 100, 507, 508, 600):
        assert kth_largest(df, k) == sorted(values)[::-1][min(k, len(values)) - 1]
    assert kth_largest(df, 0) == np.inf


def test_top_k_is_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    every = resample(docs, labels, k=10**9).collect()
    want = sorted(every, key=lambda r: -r.perturbed)[:50]
    got = resample(docs, labels, k=50).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in want}
    assert resample(docs, labels, k=50, seed=2).columns == [*docs.columns, "log_weight", "perturbed"]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "w " * 60_000), (5, "x"), (5, "x"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("log_weight", F.lit("a")).withColumn("good", F.lit(1)).withColumn("held", F.lit(1))
    labels = spark.createDataFrame([(None, 1), (5, None), (77, 1)], "doc_id long, quality int")
    assert sorted(str(r.doc_id) for r in resample(docs, labels).collect()) == ["4", "5", "5", "None"]
    none = docs.limit(0)
    assert resample(none, labels).collect() == [] and resample(none, labels.limit(0)).collect() == []
    assert spark.range(1).select(gumbel(F.lit(1), 1).alias("g")).first().g is not None


M = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_buckets(text):
    """The n-gram buckets of a text in plain Python: tokens, pairs, and tokens that come again after none or one other."""
    runs = [m[0] for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|([^0-9A-Za-z\x80-\xff\x20\t\n\x0b\x0c\r])\1*", (text or "").encode())]
    step = 0x9E3779B97F4A7C15
    hashes = []
    for run in runs:
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in run)
        hashes.append(plain_mix(sum(plain_mix((c + 1) * step & M) * pow(0xD6E8FEB86659FD93, k, 1 << 64) for k, c in enumerate(low)) & M))
    out = list(hashes) + [plain_mix((x * step & M) ^ y) for x, y in zip(hashes, hashes[1:])]
    out += [plain_mix(step * d & M) for d in (1, 2) if len(hashes) > d for x, y in zip(hashes, hashes[d:]) if x == y]
    return [h >> 64 - 17 for h in out]


def test_counts_ratios_and_weights_against_plain_python(spark):
    texts = {1: "A b, b! the cat sat", 2: "a b cat cat the end", 3: None, 4: "!!! é x x the", 5: "other words here, and the cat", 6: "xx yy xx yy -- --"}
    good = {d for d in texts if d != 4}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d in good)) for d in texts], "doc_id long, quality int")
    held = {r.doc_id for r in _labels(labels).where("held").collect()}
    raw, target = Counter(), Counter()
    for d, t in texts.items():
        raw.update(plain_buckets(t))
        if d in good and d not in held:
            target.update(plain_buckets(t))
    assert target
    share = sum(target.values()) / sum(raw.values())
    ratio = lambda b: math.log((target[b] + SMOOTHING) / (raw[b] * share + SMOOTHING))
    got = log_ratios(docs.repartition(3), labels)
    assert all(abs(got[b] - ratio(b)) < 1e-12 for b in raw) and abs(got.sum() - sum(map(ratio, raw))) < 1e-9
    kept = {r.doc_id: r for r in resample(docs, labels, k=10).collect()}
    assert set(kept) == {1, 2, 4, 5, 6}
    for d, r in kept.items():
        assert abs(r.log_weight - sum(map(ratio, plain_buckets(texts[d])))) < 1e-9
        assert r.perturbed == r.log_weight + spark.range(1).select(gumbel(F.lit(d).cast("long"), 1)).first()[0]
