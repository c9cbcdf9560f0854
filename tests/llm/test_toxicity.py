import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tarnmill.llm.queries import op6_toxicity
from tarnmill.llm.toxicity import CLAUSE, Grammar, fit, pieces, score_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op6_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic = [p for p, t in held if t]
    clean = [p for p, t in held if not t]
    print("held out: recall", sum(toxic) / len(toxic), "of", len(toxic), "false alarms", sum(clean) / len(clean), "of", len(clean))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_clauses_not_words():
    g = Grammar({"idiot$": 4.0})
    score = lambda t: g.clause([k for w in t.split() if (k := g.read(w))])[0]
    assert score("you are an idiot") > score("idiot") > score("he said idiot") > 0
    assert score("you are not an idiot") < score("you are an idiot")
    assert score("i will kill you") > 0 and score("i kill time") == 0
    assert g.read("idiotic") is None and g.read("idiot") == ("insult", 4.0)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x " * 60_000 + "idiot"), (4, "you idiot. scum!"), (4, "you idiot. scum!"), (None, "fine words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("a")).withColumn("half", F.lit(3))
    labels = spark.createDataFrame([(4, 1), (None, 1), (2, None), (99, 0)], "doc_id long, toxic int")
    model = fit(docs, labels)
    got = score_toxicity(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score > 0.5 for r in got if r.doc_id == 4) and all(r.score < 0.5 for r in got if r.doc_id in (1, 2, None))
    none = docs.limit(0)
    assert score_toxicity(none, fit(none, labels.limit(0))).collect() == []


def plain_clause(symbols):
    """What the composed machine must give, step by step without it."""
    negated = reported = will = 0
    aimed = any(kind == "target" for kind, _ in symbols)
    insults = threats = 0.0
    for kind, weight in symbols:
        scale = (0.5 if negated else 1.0) * (0.6 if reported else 1.0)
        if kind == "insult":
            insults += weight * scale
        elif kind == "threat" and will:
            threats += 2.0 * scale
        will |= kind == "will"
        reported |= kind == "report"
        negated = 2 if kind == "negation" else max(0, negated - 1)
    return insults * (1.1 if aimed else 1.0) + threats * (1.1 if aimed else 0.0)


def test_composition_against_plain_python():
    rng = random.Random(1)
    g = Grammar({})
    for _ in range(3000):
        symbols = [(rng.choice(["insult", "threat", "will", "target", "negation", "report"]), rng.random() * 5) for _ in range(rng.randrange(12))]
        assert abs(g.clause(symbols)[0] - plain_clause(symbols)) < 1e-9
    assert len(CLAUSE.moves) == 24


def test_arcs_and_scores_against_plain_python(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for d in range(400):
        toxic = d % 4 == 0
        some = [rng.choice(words) for _ in range(20)] + (["blorg"] if toxic or rng.random() < 0.02 else [])
        rng.shuffle(some)
        rows.append((d, " ".join(some) + ". you are fine", int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, toxic int")
    model = fit(docs, labels)
    count = {0: Counter(), 1: Counter()}
    for _, text, t in rows:
        count[t].update({p for w in set(re.findall(r"[a-z0-9]+", text)) for p in pieces(w)})
    want = {}
    for p, t in count[1].items():
        w = math.log((t + 0.5) / 101) - math.log((count[0][p] + 0.5) / 301)
        e = (t + count[0][p]) / 4
        if t >= 3 and w > 1 and t - e >= 4 * math.sqrt(e):
            want[p] = min(w, 8.0)
    learned = {p: w for p, w in model.arcs.items() if w != 3.0}
    assert want and learned.keys() == want.keys() and all(abs(learned[p] - want[p]) < 1e-9 for p in want)
    grammar = Grammar(model.arcs)
    for r in score_toxicity(docs, model).collect():
        f = grammar.features(r.text)
        z = sum(w * a for w, a in zip(model.weights, [f[i] * f[j] for i in range(len(f)) for j in range(i, len(f))]))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
        assert (r.score > 0.5) == ("blorg" in r.text)
