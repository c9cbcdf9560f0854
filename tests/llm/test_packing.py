import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnmill.llm.packing import pack
from tarnmill.llm.queries import op2_packing
from tarnmill.llm.tokens import WordEncoder

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n\nb\n", "It's  one's\tX", "é́ é  x", "x  y", "a\x1cb \x1c c", "<|endoftext|> a<|endoftext|>", "y" * 300 + " z", "\U0001f600 \U0001f600!! 12 3\r\n4", "tail\n", "a  b", "ΑΣ Σ ", "\ta b", "w " * 50, "\nx", " \nx y", "\n\nx", " a b " , "a" * 99 + "\t b", " " + "q" * 99 + " r", "\n" + "q" * 99 + " <|endoftext|>"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_encode_like_whole_texts(path, spark):
    t = Tokenizer.from_file(path)
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    enc = WordEncoder(path)
    assert enc.kind != "whole"
    for _ in range(2):
        got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def check(rows, texts, window=2048):
    t = Tokenizer.from_file(WORD)
    want = sorted((d if d is not None else -1, t.encode(x or "", add_special_tokens=False).ids + [1]) for d, x in texts)
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[(r.doc_id, r.doc_tokens)].append(r)
        seqs[r.sequence_id].append(r)
    total = sum(len(x) for _, x in want)
    assert sum(r.length for r in rows) == total
    for s, pieces in seqs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or s == max(seqs)
        assert pieces[0].padded_to == (at if at & (at - 1) == 0 else window)
    assert sorted(seqs) == list(range(len(seqs))) and len(seqs) == -(-total // window)
    return want, docs


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = op2_packing(spark, "/root/testdata/sf0.001").collect()
    want, got = check(rows, texts)
    for d, ids in want:
        pieces = sorted(got[(d, len(ids))], key=lambda r: r.start)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "word " * 30_000), *((10 + i, x) for i, x in enumerate(ODD))]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("part", F.lit(0)).repartition(3)
    rows = pack(df, WORD, 1, 64).collect()
    want, _ = check(rows, texts, 64)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    by = defaultdict(int)
    for d, _, ids in got:
        by[d] += len(ids)
    assert by == {d: sum(len(x) for e, x in want if e == d) for d, _ in want}


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), WORD, 1).collect() == []
