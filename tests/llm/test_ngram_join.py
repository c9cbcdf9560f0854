import random
import re

import pytest
from pyspark.sql import functions as F

from tarnmill.llm import ngram_join as module
from tarnmill.llm.common import Scratch
from tarnmill.llm.ngram_join import keep_first, ngram_join

SF = "/root/testdata/sf0.01"


def brute(rows, width, num, den):
    """Component ids by comparing all pairs that share a shingle."""
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(i, j) for ids in by.values() for k, i in enumerate(ids) for j in ids[k + 1 :]}
    for i, j in pairs:
        if len(sets[i] & sets[j]) * den >= num * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(ngram_join(docs, 3, 9, 10)) == brute(rows, 3, 9, 10)


@pytest.mark.parametrize("num,den,width", [(9, 10, 3), (4, 5, 5), (1, 2, 2)])
def test_near_copies(spark, num, den, width):
    rng = random.Random(num)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(60)] for _ in range(6)]
    rows = []
    for k in range(240):
        w = list(base[k % 6])
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(w[: rng.randrange(40, 61)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join(df, width, num, den)) == brute(rows, width, num, den)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\ttwo"), (5, "one two"), (6, long), (7, long + " end"), (None, "a b c d"), (8, "A b c d"), (None, None), (9, "été \U0001f600"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("key", F.lit("x"))
    assert got(ngram_join(df, 3, 9, 10)) == brute(rows, 3, 9, 10)
    kept = keep_first(df, 3, 9, 10)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 4, 6, None, 8, None, 9, 9]))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join(df).collect() == [] and keep_first(df).collect() == []


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_postings_are_shuffled_in_parts(spark, monkeypatch, parts):
    """Each part has a share of the shingles of its own, and together they give every link."""
    monkeypatch.setattr(module, "TOKEN_PARTS", parts)
    rng = random.Random(parts)
    rows = [(k, " ".join(f"w{k // 3}x{i}" if rng.random() > 0.02 else f"y{rng.randrange(99)}" for i in range(60))) for k in range(90)]
    rows += [(100 + k, t) for k, t in rows[:20]]
    found, save = [], Scratch.save

    def saved(self, df, name):
        df = save(self, df, name)
        if name == "tokens":
            found.append({r.token for r in df.collect()})
        return df

    monkeypatch.setattr(Scratch, "save", saved)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join(df, 3, 1, 2)) == brute(rows, 3, 1, 2)
    every = set().union(*found)
    assert len(found) == parts and sum(map(len, found)) == len(every) and max(map(len, found)) < 1.5 * len(every) / parts
