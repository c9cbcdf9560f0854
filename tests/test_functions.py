"""Truth tables of the functions, and properties of the diff against a plain table of distances."""

import datetime
import itertools
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tarnmill.functions import dates, diffing, text
from tarnmill.functions.money import parse_salary
from tarnmill.operators import dedup
from tarnmill.sources import state


def column(spark, values, expr, ddl="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text(spark):
    assert column(spark, ["A—B_C.D", "Über Café", "!!!", None], text.slugify) == ["a-b-c-d", "ber-caf", "", None]
    assert column(spark, ["aaaa bbbb cccc", "a" * 20], lambda c: text.slugify(c, 9)) == ["aaaa-bbbb", "a" * 9]
    assert column(spark, ["hello world", "hi"], lambda c: text.truncate(c, 5)) == ["he...", "hi"]
    assert column(spark, ["", "tab\tseparated\nwords"], text.count_words) == [0, 3]
    assert column(spark, ["x ghp_" + "a" * 20, "Bearer " + "b" * 24, "plain"], text.redact_secrets) == ["x [REDACTED]", "[REDACTED]", "plain"]
    assert column(spark, ["ghp_" + "a" * 20], lambda c: text.redact_secrets(c, "$1\\")) == ["$1\\"]
    assert column(spark, ["Sr. ÜBER-Dev_2", None], text.normalize_text) == ["sr über dev 2", ""]
    assert column(spark, ["ml engineer", "x"], text.expand_abbreviations) == ["machine learning engineer", "x"]
    assert column(spark, ["a.example.com", "-a.com", "1.2.3.4", "a_b.com", None], text.valid_hostname) == [True, False, False, False, False]
    assert column(spark, ["x LOOP_FAIL y LOOP_DONE", "none"], text.decision_token) == ["done", "continue"]
    with pytest.raises(ValueError):
        text.truncate(F.lit("a"), 2)


@pytest.mark.parametrize(
    "raw,low,high,sign",
    [
        ("$150-200K", 150000, 200000, "$"), ("₹25L-30L", 2500000, 3000000, "₹"), ("3.5 LPA", 350000, None, None), ("$150 - $200 / year", 150000, 200000, "$"),
        ("$100 - $150 / hr", 100, 150, "$"), ("N/A", None, None, None), ("£120k", 120000, None, "£"), ("$150,000 - $200,000", 150000, 200000, "$"), ("From 100k", 100000, None, "From"),
    ],
)
def test_salary(spark, raw, low, high, sign):
    r = column(spark, [raw], parse_salary)[0]
    assert (r.salary_min, r.salary_max, r.currency or None) == (low, high, sign)


def test_dates(spark):
    today = datetime.date(2026, 1, 15)
    want = {"Posted 3 days ago": 3, "30+ days ago": 30, "6d": 6, "6 hours ago": 0, "2 weeks ago": 14, "yesterday": 1, "just posted": 0, "1.5 weeks ago": 10}
    got = column(spark, list(want), lambda c: dates.posted_date(c, F.lit(today)))
    assert got == [today - datetime.timedelta(days=d) for d in want.values()]
    assert column(spark, ["2026-01-03T10:00:00Z", "2026-1-3", "garbage", None, ""], lambda c: dates.posted_date(c, F.lit(today))) == [datetime.date(2026, 1, 3), None, None, None, None]
    assert column(spark, ["00:08:00", "01:02", "00:60", "a:b", "-1:00", "1", None], dates.timecode_seconds) == [8, 62, None, None, None, None, None]
    assert column(spark, [datetime.date(2024, 12, 30)], dates.week_key, "date") == ["2025-W01"]
    friday = datetime.datetime(2026, 1, 16, 10, 0)
    assert column(spark, [friday, datetime.datetime(2026, 1, 12, 8, 0)], dates.next_start, "timestamp") == [datetime.datetime(2026, 1, 19, 9, 0), datetime.datetime(2026, 1, 12, 9, 0)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: max(left, row[j], row[j - 1] + (x == b[j - 1])), initial=0))
    return row[-1]


def test_diff_is_shortest_and_rebuilds():
    words = ["".join(w) for n in range(5) for w in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(words, words):
        script = diffing.edit_script(list(a), list(b))
        assert "".join("".join(u) for op, u in script if op != "insert") == a
        assert "".join("".join(u) for op, u in script if op != "delete") == b
        assert sum(len(u) for op, u in script if op != "equal") == len(a) + len(b) - 2 * lcs(a, b)


def test_diff_columns(spark):
    df = spark.createDataFrame([("abc", "abXc"), ("", ""), (None, "a")], "a string, b string")
    got = df.select(diffing.diff(F.col("a"), F.col("b"), False).alias("d"), diffing.similarity(F.col("a"), F.col("b"), False).alias("s")).collect()
    assert [tuple(x) for x in got[0].d] == [("equal", "ab"), ("insert", "X"), ("equal", "c")] and got[1].s == 1.0 and got[2].s is None
    assert diffing.unified("a\n", "b\n", "a", "b", 3) == "--- a\n+++ b\n@@ -1 +1 @@\n-a\n+b\n"
    assert "@@ -0,0 +1,2 @@" in diffing.unified("", "x\ny\n", "a", "b", 3)


def test_fuzzy_first_is_greedy_in_order(spark):
    names = ["Acme Holdings", "Acme Holding", "Globex", "Acme Holdings", ""]
    rows = [(i, t, names[i % 5]) for i, t in enumerate(["ML Engineer", "Machine Learning Engineer", "Data Scientist", "Sales Lead", "ML Engineer"] * 6)]
    df = spark.createDataFrame(rows, "seq long, title string, company string")
    got = {r.seq for r in dedup.fuzzy_first(df).collect()}
    norm = lambda s: " ".join(s.lower().split())
    long = lambda s: " ".join(text.ABBREVIATIONS.get(w, w) for w in s.split())
    kept, want = [], set()
    import difflib

    for i, t, c in rows:
        t, c = norm(t), norm(c)
        if c and any(difflib.SequenceMatcher(None, c, k).ratio() >= 0.85 and dedup.title_similarity(t, u, long(t), long(u)) >= 0.85 for u, k in kept):
            continue
        if c:
            kept.append((t, c))
        want.add(i)
    assert got == want


def test_sources(spark):
    root = tempfile.mkdtemp()
    with open(f"{root}/rows.json", "w") as f:
        f.write(json.dumps({"a": 1, "b": "x"}) + "\n{broken\n")
    good, bad = state.read_json_quarantine(spark, f"{root}/rows.json", "a int, b string")
    assert [tuple(r) for r in good.collect()] == [(1, "x")] and [r.text for r in bad.collect()] == ["{broken"]
    one = spark.createDataFrame([("k1", 1), ("k2", 2)], "id string, v int")
    two = spark.createDataFrame([("k2", 9), ("k3", 3)], "id string, v int")
    for rows in (one, two):
        state.merge_into_day(spark, rows, f"{root}/jobs", "2026-01-15")
    got = state.read_last_days(spark, f"{root}/jobs", "2026-01-16").orderBy("id").collect()
    assert [(r.id, r.v) for r in got] == [("k1", 1), ("k2", 2), ("k3", 3)]
    with pytest.raises(ValueError):
        state.read_sources(spark, ["nothing"])
