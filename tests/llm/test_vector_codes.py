import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill.llm import vector_codes
from tarnmill.llm.queries import op12_vector_codes
from tarnmill.llm.vector_codes import Cells, encode_vectors

COLUMNS = ("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def brute(rows, parts, entries, rounds, scale):
    """Plain Python over ``(vec_id, vector, label)``."""
    kept = [(i, tuple(math.floor(scale * x) for x in v), lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = max(1, -(-longest // parts))
    cut = [[(*v, *[0] * (width * parts - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((dist(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own) if o[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    errors = [sum(d for d, _ in o) for o in own]
    labels = {}
    for (_, _, lab), e in zip(kept, errors):
        labels[lab] = labels.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(map(str, ((i, lab, "".join(f"{k:02x}" for _, k in o), e, labels[lab], digest) for (i, _, lab), o, e in zip(kept, own, errors))))


def got(df):
    return sorted(str(tuple(r)) for r in df.select(*COLUMNS).collect())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(op12_vector_codes(spark, sf)) == brute(rows, 16, 64, 2, 256)


@pytest.mark.parametrize("seed", range(2))
def test_ties_repeats_and_few_entries(spark, monkeypatch, seed):
    monkeypatch.setattr(vector_codes, "_ROWS", 7)
    rng = random.Random(seed)
    rows = [(rng.randrange(-20, 60), [rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(8)], rng.choice(["a", "b", None])) for _ in range(150)]
    df = spark.createDataFrame(rows + rows[:30], "vec_id long, embedding array<double>, label string").repartition(5)
    assert got(encode_vectors(df, parts=4, entries=9, rounds=3, scale=2)) == brute(rows + rows[:30], 4, 9, 3, 2)


def test_odd_rows(spark):
    rows = [(1, [0.5, -0.5, 0.1], 1), (1, [0.5, -0.5, 0.1], 1), (None, [0.25, 1.0, -1.0], None), (2, None, 1), (3, [None, 1.0, 2.0], 1), (4, [float("nan")] * 3, 2), (5, [float("-inf"), 0.0, 0.0], 2), (6, [], None), (7, [9.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("x")).withColumn("_label", F.lit(1)).withColumn("code", F.lit(0))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert got(encode_vectors(df, parts=2, entries=64, rounds=2)) == brute(rows, 2, 64, 2, 256)
    assert got(encode_vectors(df.limit(0))) == []
    assert got(encode_vectors(df.where("embedding is null"))) == []


def test_large_components_end_the_job(spark):
    df = spark.createDataFrame([(1, [1e6], 1), (2, [0.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="16777216 or more"):
        encode_vectors(df)


def test_cells_bound_and_filter():
    """Bounds hold for every entry, the nearest entry is brute force's, and most entries aren't compared."""
    rng = np.random.default_rng(5)
    entries = rng.integers(-200, 200, (64, 4))
    x = entries[rng.integers(0, 64, 3000)] + rng.integers(-20, 21, (3000, 4))
    exact = ((x[:, None] - entries[None]) ** 2).sum(2)
    for bits in (1, 2, 3, 6):
        entry, dist, compared = Cells(entries, bits).nearest(x)
        assert (entry == exact.argmin(1)).all() and (dist == exact.min(1)).all()
        assert compared >= len(x)
    assert compared < 2 * len(x) and Cells(entries).nearest(x)[2] < 0.15 * x.shape[0] * 64
    same = Cells(np.array([[3, 3]] * 5))
    assert same.nearest(np.array([[3, 4], [0, 0]]))[0].tolist() == [0, 0]
