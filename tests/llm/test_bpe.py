import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnmill.llm import bpe
from tarnmill.llm.bpe import Backtracking, BacktrackingEncoder, Decoder, Vocabulary, decode, encode
from tarnmill.llm.queries import op11_bpe

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(BYTE)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def ours():
    return BacktrackingEncoder(BYTE)


def ids_of(coder, text):
    return np.frombuffer(coder.encode([text])[0], coder.dtype).tolist()


def merged(vocabulary, data: bytes):
    """Plain merging: always the pair of the least rank, the leftmost of equals."""
    at = {t: k for k, t in enumerate(vocabulary.tokens) if len(t) == 1}
    ids = [at[bytes([b])] for b in data]
    while True:
        ranks = [(vocabulary.merges[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in vocabulary.merges]
        if not ranks:
            return ids
        _, k = min(ranks)
        both = vocabulary.tokens[ids[k]] + vocabulary.tokens[ids[k + 1]]
        ids[k : k + 2] = [next(i for i in (vocabulary.words[both.decode("latin-1")],))]


def test_every_token_is_its_own_encoding(ours):
    """What the method rests on: merging a token's bytes gives that token."""
    words = [w for w in ours.vocabulary.words if len(w) > 1]
    for w in random.Random(1).sample(words, 1500) + sorted(words, key=len)[-200:]:
        assert merged(ours.vocabulary, w.encode("latin-1")) == [ours.vocabulary.words[w]]


def test_compatible_pairs(ours):
    v, rng = ours.vocabulary, random.Random(2)
    pairs = [(rng.randrange(256), rng.randrange(256)) for _ in range(300)] + [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1500)]
    pairs += [p for p in rng.sample(list(v.merges), 300)] + [(k, k) for k in range(0, 2000, 5)]
    for a, b in pairs:
        assert v.compatible(a, b) == (merged(v, v.tokens[a] + v.tokens[b]) == [a, b]), (a, b)


def test_pieces_without_cutting(ours):
    """Whole byte strings as one piece, which no pre-tokenizer has cut: long runs and random bytes, against plain merging."""
    rng = random.Random(3)
    data = [b"a" * n for n in (1, 2, 3, 5, 17, 64, 65, 200)] + [b" " * 37, b"-" * 90, b"=" * 33, b"abababab" * 20, b"the other others" * 5]
    data += [bytes(rng.randrange(256) for _ in range(40)) for _ in range(40)] + [bytes(rng.choice(b"aeinst ") for _ in range(60)) for _ in range(60)]
    assert ours.coder.encode([d.decode("latin-1") for d in data]) == [merged(ours.vocabulary, d) for d in data]
    assert ours.coder.encode([]) == [] and ours.coder.encode(["", "a", ""]) == [[], [ours.vocabulary.words["a"]], []]


def test_backtracking_is_needed():
    """Longest matches alone go wrong here: 'ab' and 'abc' stand in the vocabulary, but 'bcd' is merged first."""
    v = Vocabulary.__new__(Vocabulary)
    v.tokens = [b"a", b"b", b"c", b"d", b"cd", b"bcd", b"ab", b"abc"]
    v.rank, v.parts = [-1] * 4 + [0, 1, 2, 3], [(-1, -1)] * 4 + [(2, 3), (1, 4), (0, 1), (6, 2)]
    v.merges, v.words = {(2, 3): 0, (1, 4): 1, (0, 1): 2, (6, 2): 3}, {t.decode(): k for k, t in enumerate(v.tokens)}
    assert Backtracking(v).encode(["abcd", "abc", "abcabcd"]) == [[0, 5], [7], [7, 0, 5]] == [merged(v, b) for b in (b"abcd", b"abc", b"abcabcd")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "'s", "'ll", "word", "Words", "12", "３", "é", "中文", "🙂", "<|endoftext|>", "<|endof", "...", "a" * 70, "؀", "\U0003134a", "\U000323b0", "ߐ"]), max_size=14).map("".join))
def test_any_text(text):
    coder, lib = test_any_text.both
    ids = lib.encode(text, add_special_tokens=False).ids
    assert ids_of(coder, text) == ids
    assert test_any_text.decoder.decode(np.array(ids)).decode() == text


test_any_text.both = BacktrackingEncoder(BYTE), library()
test_any_text.decoder = Decoder(Vocabulary(BYTE))


def test_pieces_of_every_character(ours):
    lib = library()
    for lo in [*range(0, 0x3400, 1 << 10), 0x4C00, 0x9C00, *range(0xA400, 0x1F000, 1 << 10), 0x2A400, 0x2EC00, *range(0x31000, 0x34000, 1 << 10), 0xE0000]:
        text = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in range(lo, lo + (1 << 10)) if not 0xD800 <= c < 0xE000)
        assert ours.split(text) == [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)]


def test_decoding_any_ids():
    table, lib, rng = Decoder(Vocabulary(BYTE)), library(), random.Random(4)
    for _ in range(60):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(30))]
        assert table.decode(np.array(ids, np.int64)).decode("utf-8", "replace") == lib.decode(ids, skip_special_tokens=False)
    assert table.decode(np.array([-1, 60_000])) == b""


def test_whole_table(spark):
    sf, lib = "/root/testdata/sf0.01", library()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_odd_rows(spark, monkeypatch):
    lib = library()
    rows = [(1, None), (None, ""), (2, "one two"), (2, "one two"), (3, "<|endoftext|> <|endoftext|>x"), (4, "word " * 30_000), (5, "x" * 30_000), (6, " \n \n"), (7, "a<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    out = decode(encode(df, BYTE), BYTE)
    want = [(d, lib.encode(t or "", add_special_tokens=False).ids, t or "") for d, t in rows]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert decode(encode(df.limit(0), BYTE), BYTE).collect() == []
    ids = spark.createDataFrame([("k", None), ("l", []), ("m", [None, 70_000, 64])], "doc_id string, ids array<int>")
    assert [r.decoded for r in decode(ids, BYTE).orderBy("doc_id").collect()] == [None, "", "a"]


def test_full_tables_of_words_and_pairs(monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 5)
    coder, lib = BacktrackingEncoder(BYTE, cached_words=10), library()
    for text in ("one two three four five six seven eight nine ten eleven twelve " * 3, "unlikelywordformation andanother", ""):
        assert ids_of(coder, text) == lib.encode(text, add_special_tokens=False).ids
