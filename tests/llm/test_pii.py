import hashlib
import random
import re

from pyspark.sql import functions as F

from tarnmill.llm.pii import KINDS, candidates, find_pii, fit, masked
from tarnmill.llm.queries import op4_pii

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    """The base spans by Python's re."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or "0") > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                d = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
                if not 12 <= len(digits) <= 19 or sum(x - 9 * (x > 9) for x in d) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_query_against_re(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    assert sum(r.n_email for r in rows) and sum(r.n_ip for r in rows) and sum(r.n_card for r in rows) and sum(r.n_phone for r in rows)
    for r in rows:
        want = base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in want) for j in range(4))
        assert r.base_sha256 == digest(want)
        assert {f"{KINDS[k]}:{s}:{e}" for s, k, e in want} <= set(r.spans.split(","))


def test_random_texts(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "@", ".", "+1 ", "4111111111111111", "0", "255", "256.1.1.1", "1.2.3.4", "-", " ", "  ", "(", ")", "x", "é", "\U0001f600", "12", "9999", "\n", "_", "a@b", "00.0.0.0", "+"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += ["", "1" * 30_000, "a" * 50_000 + "@", "a@" + "b." * 20_000 + "c", "1.2.3.4 " * 6_000, "4111 1111 1111 1111 " * 500, "+" * 20_000, "0" * 40_000 + ".1.1.1", "1." * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, None)], "doc_id long, text string").withColumn("pii", F.lit(0)).withColumn("kind", F.lit(0))
    rows = find_pii(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert [(s.start, s.kind, s.end) for s in r.pii if s.base] == base(r.text)


def test_method_adds_spans(spark):
    good = [f"please call me, my phone is (555) 21{k % 10}-41{k % 10}2 today, or mail jo{k} [at] mail{k} [dot] com" for k in range(40)]
    plain = [f"reach us: jo{k}@site{k}.com or call +49 30 1234{k:03d}5, card 4111111111111111, host 10.1.{k}.9" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(good + plain)), "doc_id long, text string")
    model = fit(df.select(candidates(F.col("text")).alias("spans")))
    assert set(model.reliability) == set(KINDS)
    rows = {r.doc_id: r for r in find_pii(df, model).withColumn("m", masked(F.col("text"), F.col("pii"))).collect()}
    assert "[PHONE]" in rows[3].m and "[EMAIL]" in rows[3].m and "555" not in rows[3].m
    assert rows[40].m == "reach us: [EMAIL] or call [PHONE], card [CARD], host [IP]"
    assert rows[3].m.startswith("please call me, my phone is [PHONE] today")


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert find_pii(df).collect() == []
