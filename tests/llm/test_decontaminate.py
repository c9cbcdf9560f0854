import random

import pytest
from pyspark.sql import functions as F

from tarnmill.llm.decontaminate import EDIT_RATE, WINDOW, Index, banded_distance, find_leaks, normal, normal_places, without_leaks
from tarnmill.llm.queries import op5_decontamination

SF = "/root/testdata/sf0.01"


def distance(pattern, region):
    """Least edits between the pattern and any part of the region, by the full table."""
    row = [0] * (len(region) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, r in enumerate(region, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != r)))
        row = new
    return min(row)


def test_verbatim_items_of_the_table(spark):
    docs = {r.doc_id: normal(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op5_decontamination(spark, SF).collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert want and want <= got
    for d, i in got - want:  # what else is reported holds a window within its budget
        x = items[i]
        assert min(distance(x[k : k + WINDOW], docs[d]) for k in range(0, max(1, len(x) - WINDOW + 1))) <= EDIT_RATE * WINDOW


@pytest.mark.parametrize("seed", range(3))
def test_every_window_within_the_budget_is_found(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    for _ in range(60):
        item = " ".join(word() for _ in range(rng.randrange(8, 30)))
        text = list(" ".join(word() for _ in range(20)) + " " + item + " " + " ".join(word() for _ in range(20)))
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(text))
            text[k : k + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        text = normal("".join(text))
        index = Index([(1, item)])
        want = any(distance(w, text) <= e for _, w, e in index.windows)
        assert bool(index.find(text)) == want


def test_alignment_and_places():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(20)))
        e = rng.randrange(4)
        got, want = banded_distance(a, b, e), distance(a, b)
        if want <= e:
            assert got and got[0] == want and distance(a, b[got[1] : got[2]]) == want
        else:
            assert got is None
    for t in ("", "  A--b!", "Straße ÉTÉ…x", "İ_a"):
        assert [normal(t)[i] for i in range(len(normal(t)))] == [normal(t)[i] for i, _ in enumerate(normal_places(t))]
        assert len(normal_places(t)) == len(normal(t))


def test_odd_rows(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away from it at once"
    rows = [(1, None), (2, ""), (3, f"x {item.upper()}!"), (3, f"x {item.upper()}!"), (None, item.replace(" ", "*** ")), (4, "word " * 40_000 + item), (5, "clean text of another kind altogether")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("end", F.lit(1))
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "short"), (None, "another thing that nobody has written down")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = find_leaks(docs, bench).collect()
    assert sorted(str(r.doc_id) for r in found) == ["3", "3", "4", "None"]
    assert all(r.item_id == 7 and r.edits == 0 for r in found)
    assert next(r for r in found if r.doc_id == 3)[2:4] == (2, 2 + len(item))
    kept = without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5]
    assert find_leaks(docs, bench.limit(0)).collect() == [] and find_leaks(docs.limit(0), bench).collect() == []
    assert without_leaks(docs, bench.limit(0)).count() == len(rows)
