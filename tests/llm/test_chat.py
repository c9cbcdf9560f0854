import hashlib
import random

from pyspark.sql import functions as F

from tarnmill.llm.chat import format_chat, read_chat
from tarnmill.llm.queries import op8_chat_formatting

BITS = ["<s>", "</s>", "[INST]", "[/INST]", " [/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "\\", "\\\\", "<", "[", "</", "s>", "\n", "é", "\U0001f600", "a", " ", "$0", "<\\s>", "INST]"]


def want(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t if t is not None else -(10**9), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}


def test_round_trip(spark):
    rng = random.Random(7)
    rows = []
    for c in range(400):
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "<s>", "a\\b"])
            rows.append((c, t, role, "".join(rng.choice(BITS) for _ in range(rng.randrange(9)))))
    rows += [(None, 1, "user", None), (None, None, "assistant", "x"), (500, 1, "user", "a"), (500, 1, "user", "a"), (500, 1, "assistant", "b"), (501, 0, "assistant", "<s>long " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("t", F.lit(2))
    out = format_chat(df).collect()
    turns = want(rows)
    assert len(out) == len(turns)
    read = {r.conv_id: r for r in read_chat(spark.createDataFrame(out)).collect()}
    for r in out:
        assert [(t.role, t.text) for t in read[r.conv_id].turns] == turns[r.conv_id]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert spans == [t.body for t in read[r.conv_id].turns if t.role == "assistant"]
    # the text of a turn without marks or backslashes stays as it is
    assert next(r for r in out if r.conv_id == 500).formatted == "<s>b</s>[INST] a [/INST][INST] a [/INST]"


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    turns = want([*rows, (-7, 0, "user", odd), (-7, 1, "assistant", odd)])
    out = op8_chat_formatting(spark, sf).collect()
    assert {r.conv_id for r in out} == set(turns)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in out:
        t = turns[r.conv_id]
        loss = "".join(x for role, x in t if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), len(loss), sha(loss))


def test_empty(spark):
    assert format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_loss_columns_are_read_through_the_mask(spark, monkeypatch):
    """A mask that is wrong by one place changes what the query gives."""
    from tarnmill.llm import queries

    want = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in queries.op8_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    assert want[-7] == (21, hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest())
    right = queries.format_chat
    moved = lambda rows: right(rows).withColumn("loss_spans", F.transform("loss_spans", lambda s: s.withField("start", s["start"] + 1)))
    monkeypatch.setattr(queries, "format_chat", moved)
    got = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in queries.op8_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    assert got[-7] != want[-7]
