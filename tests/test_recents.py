import hashlib
import random

from pyspark.sql import functions as F

from tarnmill.operators import dedup

TITLES = ["ML Engineer", "Machine Learning Engineer", "Senior ML Engineer", "Data Scientist", "Data Scientist II", "Backend Dev", "Backend Developer", "", "Cook"]
COMPANIES = ["Acme Corp", "Acme Corp.", "ACME corpo", "Globex", "", "Initech"]


def plain(rows, seen, recent):
    """Row by row against all that was accepted before, in this run and earlier."""
    ratio = lambda a, b: dedup._ratio(a, b) >= 0.85
    norm = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    long = dedup._written_out
    names, ids, out = [(norm(t), norm(c)) for t, c in recent], set(seen), {}
    for seq, i, t, c, url in rows:
        old = hashlib.sha256("|".join(x.strip().lower() for x in (url, t, c)).encode()).hexdigest()[:16]
        t, c = norm(t), norm(c)
        alike = t and c and any(a and b and ratio(c, b) and dedup.title_similarity(t, a, long(t), long(a)) >= 0.85 for a, b in names)
        out[seq] = "exact" if i in ids or old in ids else "fuzzy" if alike else "new"
        ids.add(i)
        if out[seq] == "new":
            names.append((t, c))
    return out


def test_recents_against_row_by_row(spark):
    rng = random.Random(6)
    pick = lambda: (rng.choice(TITLES), rng.choice(COMPANIES))
    rows = [(k, f"id{rng.randrange(30)}", *pick(), f" https://X.example/{k} ") for k in range(40)]
    recent = [("Data Scientist", "Globex"), ("Data Scientist II", "Globex"), ("ML Engineer", ""), ("Cook", "Acme Corp")]
    old = hashlib.sha256("|".join(x.strip().lower() for x in (rows[7][4], rows[7][2], rows[7][3])).encode()).hexdigest()[:16]
    seen = ["id3", "id4", old]
    df = spark.createDataFrame(rows, "seq long, id string, title string, company string, url string")
    got = dedup.verdicts(df, spark.createDataFrame([(i,) for i in seen], "id string"), recent=spark.createDataFrame(recent, "title string, company string"))
    assert {r.seq: r.verdict for r in got.collect()} == plain(rows, seen, recent)
    assert len({r.verdict for r in got.collect()}) == 3


def test_window_of_recent_names(spark):
    recent = spark.createDataFrame([(f"t{k}", "c", k, 0) for k in range(5)], "title string, company string, pushed_at int, seq long")
    new = spark.createDataFrame([(1, "a", "c"), (2, "b", "c")], "seq long, title string, company string")
    assert [r.title for r in dedup.pushed(recent, new, F.lit(9), 4).collect()] == ["b", "a", "t4", "t3"]
    assert dedup.pushed(recent.limit(0), new.limit(0), F.lit(9), 4).collect() == []
