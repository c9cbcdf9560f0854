import random

import pytest
from pyspark.sql import functions as F

from tarnmill.operators import chain
from tarnmill.record_queries import ENGINEER

COLUMNS = "seq long, source string, title string, company string, url string, location string, salary string, posted_date string, description string, job_type string"


def rows_of(spark, rows):
    """``(seq, source, url, title, company)``: postings that pass every gate of a single row."""
    return spark.createDataFrame([(s, src, t, c, f"https://jobs.example/view/{u}", "Remote", "", "2026-01-12", "machine learning engineer for NLP and LLM work", "") for s, src, u, t, c in rows], COLUMNS)


def gates(spark, rows, cap, fuzzy, dead=()):
    none = spark.createDataFrame([], "id string")
    gone = spark.createDataFrame([(f"https://jobs.example/view/{u}",) for u in dead], "url string")
    out = chain.run(rows_of(spark, rows), [ENGINEER], F.lit("2026-01-15").cast("date"), F.lit("2026-01-01").cast("timestamp"), none, gone, cap, False, fuzzy)
    return {r.seq: r.gate for r in out.select("seq", "gate").collect()}


def read_in_order(rows, cap, dead=()):
    """Row by row: a source at its cap is read no further, a link found dead hides nothing."""
    out, taken, ids = {}, {}, set()
    for seq, source, url, _, _ in rows:
        if taken.get(source, 0) >= cap:
            continue
        out[seq] = "dedup" if url in ids else "dead_link" if url in dead else None
        if out[seq] is None:
            ids.add(url)
            taken[source] = taken.get(source, 0) + 1
    return out


def test_rows_beyond_a_cap_mark_nobody(spark):
    name = ("ML Engineer", "Acme")
    rows = [(1, "a", "u1", *name), (2, "a", "u2", *name), (3, "b", "u2", *name), (4, "b", "u3", *name)]
    assert gates(spark, rows, 1, False) == {1: None, 3: None}
    rows = [(1, "a", "u1", "ML Engineer", "Acme"), (2, "a", "u2", "Senior Machine Learning Engineer", "Initech"), (3, "b", "u3", "Senior Machine Learning Engineer", "Initech"), (4, "b", "u4", "ML Engineer", "Globex")]
    assert gates(spark, rows, 1, True) == {1: None, 3: None}
    assert gates(spark, rows, 9, True) == {1: None, 2: None, 3: "dedup", 4: None}


@pytest.mark.parametrize("seed", range(2))
def test_caps_against_reading_in_order(spark, seed):
    rng = random.Random(seed)
    by_source = seed % 2 == 0
    sources = sorted(rng.choice("abcd") for _ in range(60)) if by_source else [rng.choice("abcd") for _ in range(60)]
    picked = [rng.randrange(25) for _ in sources]
    rows = [(k, s, f"u{u}", f"ML Engineer {u}", f"Company {u}") for k, (s, u) in enumerate(zip(sources, picked, strict=True))]
    dead = {"u1", "u2"}
    assert gates(spark, rows, 4, False, dead) == read_in_order(rows, 4, dead)
