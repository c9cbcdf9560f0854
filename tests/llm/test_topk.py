import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill.llm import topk
from tarnmill.llm.queries import op3_topk
from tarnmill.llm.topk import top_k


def brute(rows, k, every=20):
    vecs = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vecs[i] = [math.floor(64 * x) for x in v]
    out = []
    for q, a in vecs.items():
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vecs.items() if i != q)
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op3_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 20)


@pytest.mark.parametrize("seed", range(2))
def test_clusters_ties_and_small_blocks(spark, monkeypatch, seed):
    for name, n in (("ANNULUS", 7), ("QUERIES", 3), ("PIVOTS", 5), ("SAMPLE", 60)):
        monkeypatch.setattr(topk, name, n)
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 3) for _ in range(4)] for _ in range(4)]
    rows = [(k, [c + rng.gauss(0, 0.2) for c in centre[0 if rng.random() < 0.4 else k % 4]]) for k in range(-40, 260)]
    rows += [(1000 + k, [1.0, 1.0, 1.0, 1.0]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, 6).collect())) == brute(rows, 6)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [-1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [0.0, -0.01]), (6, [3e5, -3e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("pivot", F.lit("x")).withColumn("score", F.lit(1))
    extra = spark.createDataFrame([(7, [1.0])], "vec_id long, embedding array<double>").withColumn("pivot", F.lit("x")).withColumn("score", F.lit(1))
    assert sorted(map(tuple, top_k(df.union(extra).union(df), 20).collect())) == brute(rows, 20)
    assert top_k(df.limit(0)).collect() == []


def _annuli(vectors, pivots, most):
    d = topk._distances(topk._lifted(vectors, most), pivots)
    own = d.argmin(1)
    out = []
    for p in range(len(pivots)):
        mine = np.flatnonzero(own == p)
        mine = mine[np.argsort(d[mine, p])]
        for lo in range(0, len(mine), 50):
            some = mine[lo : lo + 50]
            out.append((p, d[some[0], p], d[some[-1], p], some, vectors[some]))
    return out


def test_clustered_vectors_skip_annuli():
    """Most annuli lie beyond the shrinking bound, and what is found is what brute force finds."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-400, 400, (20, 16))
    vectors = (centres[rng.integers(0, 20, 6000)] + rng.integers(-12, 13, (6000, 16))).astype(np.int64)
    vectors *= 1000
    vectors //= np.maximum(np.sqrt((vectors * vectors).sum(1)) / 400, 1).astype(np.int64)[:, None]
    most = float((vectors * vectors).sum(1).max())
    pivots = topk._pivots(topk._lifted(vectors[::3], most), 20)
    ids = np.arange(0, 6000, 40)
    own = topk._distances(np.concatenate([vectors[ids].astype(float), np.zeros((len(ids), 1))], 1), pivots).argmin(1)
    annuli = _annuli(vectors, pivots, most)
    least = np.full(len(ids), np.iinfo(np.int64).min // 4)
    found, searched, possible = {int(i): [] for i in ids}, 0, 0
    for home in (True, False):
        search = topk._Search(topk.Queries(ids, vectors[ids], own, least), pivots, most, 5, home)
        for lo in range(0, len(annuli), topk.ANNULI):
            search.take(annuli[lo : lo + topk.ANNULI])
        for q, v, s in zip(*search.found()):
            found[int(q)].append((-int(s), int(v)))
        searched, possible = searched + search.searched, possible + search.possible
        least = np.array([-sorted(found[int(i)])[4][0] if len(found[int(i)]) >= 5 else least[0] for i in ids])
    scores = vectors[ids] @ vectors.T
    for i, row in zip(ids, scores):
        want = sorted((-int(s), v) for v, s in enumerate(row) if v != i)[:5]
        assert sorted(found[int(i)])[:5] == want
    assert searched < 0.5 * possible


def test_several_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(topk, "HELD", 100)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    few = {tuple(r) for r in topk.top_k(df, 7, 10, 64).collect()}
    monkeypatch.undo()
    assert few == {tuple(r) for r in topk.top_k(df, 7, 10, 64).collect()}
