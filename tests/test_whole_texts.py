"""Queries over texts read them to the end."""

import random

import pytest

from tarnmill import registry
from tarnmill.functions import diffing

from .test_functions import lcs


@pytest.fixture(scope="module")
def late(tmp_path_factory, spark):
    """Two documents that differ only after 3,000 characters."""
    root, start = str(tmp_path_factory.mktemp("late")), "One line of words.\n" * 160
    spark.createDataFrame([(1, start + "old end\n"), (2, start + "new end\n")], "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    return root, start


def test_differences_late_in_a_text(spark, late):
    root, start = late
    script = registry.QUERIES["diff_edit_script"](spark, root).first().script
    assert "".join(text for op, text in script if op != "insert") == start + "old end\n"
    assert "".join(text for op, text in script if op != "delete") == start + "new end\n"
    assert registry.QUERIES["similarity_lcs"](spark, root).first().similarity < 1
    assert "-old end\n+new end\n" in registry.QUERIES["unified_diff"](spark, root).first().patch


def greedy(a, b):
    """The script by Myers' greedy search, one unit at a time."""
    furthest, trace, d = {1: 0}, [], 0
    while True:
        trace.append(dict(furthest))
        for k in range(-d, d + 1, 2):
            x = furthest[k + 1] if k == -d or k != d and furthest[k - 1] < furthest[k + 1] else furthest[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            furthest[k] = x
        if furthest.get(len(a) - len(b), -1) >= len(a):
            break
        d += 1
    x, y, out = len(a), len(b), []
    for d in range(d, 0, -1):
        k, reach = x - y, trace[d]
        down = k == -d or k != d and reach[k - 1] < reach[k + 1]
        to = (reach[k + 1], reach[k + 1] - k) if down else (reach[k - 1] + 1, reach[k - 1] + 1 - k)
        out += [("equal", a[i]) for i in range(x - 1, to[0] - 1, -1)] + [("insert", b[to[1] - 1]) if down else ("delete", a[to[0] - 1])]
        x, y = (to[0], to[1] - 1) if down else (to[0] - 1, to[1])
    return (out + [("equal", u) for u in reversed(a[:x])])[::-1]


def test_script_is_that_of_the_greedy_search():
    rng = random.Random(2)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(40))) for _ in "ab")
        b = a[:9] + b + a[30:] if rng.random() < 0.4 else b
        assert [(op, u) for op, run in diffing.edit_script(a, b) for u in run] == greedy(a, b)
        assert diffing._common(a, b) == lcs(a, b)


def test_postings_are_read_to_the_end(spark, tmp_path):
    long = "Plain words. " * 100
    rows = [(0, "a", long), (1, "a", long + "Applications are closed."), (8, "a", long + "This is a hybrid role."), (6, "a", long + "You must be based in Berlin.")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: {r.seq: r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(run("expired_filter")) == {1}
    gates = run("gate_first_failure")
    assert gates[1].gate == "expired" and gates[0].gate != "expired"
    assert set(run("gate_source_cap")) == {0, 6, 8}
    verdicts = run("law_verdicts")
    changed = lambda k: [v for v in verdicts[k].asDict().values() if isinstance(v, str) and ("hybrid" in v or v == "description")]
    assert changed(8) and changed(6) and not changed(0)
