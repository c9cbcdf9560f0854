import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnmill.llm import alignment
from tarnmill.llm.alignment import PieceEncoder, align, groups
from tarnmill.llm.bpe import byte_of
from tarnmill.llm.queries import op13_alignment

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(docs):
    """Whole texts by the libraries, groups and links by sets of offsets."""
    t, sp, byte = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE), byte_of()
    t.encode_special_tokens = True

    def tokens(text):
        a = t.encode(" " + text, add_special_tokens=False)
        b = sp.encode(text)
        bytes_a = [bytes(byte[c] for c in s) for s in a.tokens]
        pieces = [sp.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        data = (" " + text).encode()
        return list(zip(a.ids, bytes_a)), list(zip(b, bytes_b)), b"".join(bytes_a) == data == b"".join(bytes_b)

    def ends(side):
        at = 0
        for k, data in side:
            at += len(data)
            yield at, k

    rows, counts = [], Counter()
    for doc, text in docs:
        a, b, same = tokens(text) if text else ([], [], False)
        if not same:
            rows.append((doc, 0, 0, 0, [], ""))
            continue
        a, b = list(ends(a)), list(ends(b))
        common = {e for e, _ in a} & {e for e, _ in b}
        links = _links(a, b)
        counts.update(links)
        cut = lambda side: _cut(side, common)
        text = ";".join(f"{x}|{y}" for x, y in zip(cut(a), cut(b), strict=True))
        rows.append((doc, len(a), len(b), len(common), links, hashlib.sha256(text.encode()).hexdigest()))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(str((d, na, nb, ng, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), h)) for d, na, nb, ng, ls, h in rows)


def _links(a, b):
    at = dict(b)
    return [(i, at[e]) for e, i in a if e in at]


def _cut(side, common):
    out, now = [], []
    for e, k in side:
        now.append(str(k))
        if e in common:
            out.append(",".join(now))
            now = []
    return out


def got(df):
    return sorted(str(tuple(r)) for r in df.select(*COLUMNS).collect())


ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (None, "null id"), (5, "<|endoftext|> <s> </s> <0x41>"), (6, "▁ mark ▁"), (7, "🙂 é 中文\n\ttab  two   three "), (8, "x" * 3000), (9, "word " * 4000), (10, "\x00 nul"), (11, " lead"), (12, "trail "), (13, "éclair naïve 12345 don't"), (14, "𐍈" * 50)]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_odd_rows(spark, monkeypatch, limit):
    """With the pairs broadcast, and by a shuffle join."""
    monkeypatch.setattr(alignment, "PAIRS_BROADCAST", limit)
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("a", F.lit(1)).withColumn("common", F.lit(2)).repartition(3)
    assert got(align(df, BYTE, PIECE)) == brute(ODD)
    assert got(align(df.limit(0), BYTE, PIECE)) == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op13_alignment(spark, sf)) == brute(docs)


def test_groups_of_given_ends(spark):
    """A group of many tokens, groups of one, and no tokens at all."""
    rows = [("x", [1, 2, 3, 4], [1, 3, 4, 9], [7, 8, 9], [2, 4, 9]), ("none", [], [], [], []), ("one", [5], [3], [6], [3]), ("late", list(range(50)), list(range(1, 51)), [1], [50])]
    df = spark.createDataFrame(rows, "doc_id string, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>")
    found = {r.doc_id: r.groups for r in groups(df).collect()}
    assert found == {"x": ["1,2,3|7,8", "4|9"], "none": [], "one": ["5|6"], "late": [",".join(map(str, range(50))) + "|1"]}


def test_pieces_of_words_and_whole_texts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    enc = PieceEncoder(PIECE, cached_words=50)
    assert enc.cuts
    texts = [t for _, t in ODD if t] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for _ in range(2):
        for t, ids in zip(texts, enc.encode(texts), strict=True):
            assert (ids is None) == ("▁" in t) and (ids is None or np.frombuffer(ids, np.int32).tolist() == sp.encode(t))


def test_no_step_is_computed_twice(spark):
    """One Python step, and no plan node that repeats the intersection."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = groups(alignment.tokens(df, BYTE, PIECE)).select("groups", "a_cuts", "b_cuts")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1 and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("cached", [alignment.CACHED_WORDS, 40])
def test_words_aligned_once_give_the_groups_of_whole_texts(spark, cached):
    texts = [t for _, t in ODD if t] + ["a\nb\n\nc \n d", "\n", "\nx", "x\n", "one\ntwo ▁ three", "one\n▁", "a\tb\n\tc", "y" * 100 + "\n" + "z" * 100, "ﬁ\nﬁ x"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    plain, pair = alignment._Pair(BYTE, PIECE), alignment._Pair(BYTE, PIECE, cached_words=cached)
    assert pair.b.lines
    want = []
    for a, b in plain.encode(texts):
        a_ends, b_ends = (np.cumsum(size[ids]).tolist() for ids, size in zip((a, b), plain.sizes))
        sides = list(zip(a_ends, a.tolist())), list(zip(b_ends, b.tolist()))
        common = set(a_ends) & set(b_ends)
        text = ";".join(f"{x}|{y}" for x, y in zip(*(_cut(s, common) for s in sides), strict=True))
        want.append((len(a), len(b), text.encode(), [(x << 32) + y for x, y in _links(*sides)]))
    for _ in range(2):
        assert [(m, n, g, np.frombuffer(k, np.int64).tolist()) for m, n, g, k in pair.align(texts)] == want
        assert not any(len(w) > alignment.CACHED_LENGTH for w in pair.words)


def test_work_goes_by_distinct_words(spark, monkeypatch):
    """A word is aligned once, and no lambda runs over the tokens of a document."""
    seen, pair = [], alignment._Pair(BYTE, PIECE)
    once = pair._align
    monkeypatch.setattr(pair, "_align", lambda a, b: seen.append(len(a)) or once(a, b))
    pair.align(["some words\nand some more words"] * 1000)
    pair.align(["more words and some"] * 1000)
    assert sum(seen) == len({"some", "words", "\nand", "more", "and"})
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "lambda" not in alignment.aligned(df, BYTE, PIECE)._jdf.queryExecution().optimizedPlan().toString()
