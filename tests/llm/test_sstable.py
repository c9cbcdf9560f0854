import io
import tempfile
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnmill.llm import sstable
from tarnmill.llm.queries import op7_sstable
from tarnmill.llm.sstable import ShardReader, ShardWriter, key_of, lookup, read_shards, write_shards

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def want(texts, end=0):
    t = Tokenizer.from_file(BYTE)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    rows = sorted(op7_sstable(spark, "/root/testdata/sf0.001").collect())
    at, ids = 0, want([r.text for r in docs])
    assert len(rows) == len(docs)
    for r, d, x in zip(rows, docs, ids, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)


def test_odd_rows_and_lookup(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 4000)
    rows = [(5, "b"), (5, "b"), (5, "a"), (None, "x"), (None, None), (-3, ""), (7, "word " * 20_000), (2**63 - 1, "last"), (-(2**63), "first"), *((100 + k, f"text {k}") for k in range(600))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit(1)).withColumn("part", F.lit("p"))
    folder = "file://" + tempfile.mkdtemp()
    manifest = write_shards(df, folder, BYTE, 0)
    got = [(r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in read_shards(manifest, folder).collect()]
    got.sort()
    ids = dict(zip([(d, t) for d, t in rows], want([t for _, t in rows])))
    assert [d for _, d, _ in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert sorted(map(str, (x for _, _, x in got))) == sorted(map(str, (ids[r] for r in rows)))
    assert [s for s, _, _ in got] == [0, *np.cumsum([len(x) for _, _, x in got])[:-1]]
    for d in (5, None, -3, 7, 2**63 - 1, -(2**63), 100, 377, 699):
        assert sorted(x.tolist() for x in lookup(manifest, folder, d)) == sorted(ids[r] for r in rows if r[0] == d)
    assert lookup(manifest, folder, 6) == []


def test_prefix_compression_and_damage():
    w = ShardWriter(2)
    for k in range(5000):
        w.add(key_of(3 * k, 0), np.array([k, 0], "<u2").tobytes())
    data = w.finish()
    assert len(data) < 0.75 * 5000 * (len(key_of(0, 0)) + 3 + 4)
    r = ShardReader(io.BytesIO(data), len(data))
    assert r.docs == 5000 and len(r.index) > 1 and len(list(r.scan())) == 5000
    assert r.get(3 * 4321) == [np.array([4321, 0], "<u2").tobytes()] and r.get(4) == []
    bad = bytearray(data)
    bad[10] ^= 1
    try:
        list(ShardReader(io.BytesIO(bytes(bad)), len(bad)).scan())
        raise AssertionError
    except ValueError:
        pass


def test_empty(spark):
    folder = "file://" + tempfile.mkdtemp()
    manifest = write_shards(spark.createDataFrame([], "doc_id long, text string"), folder, BYTE, 0)
    assert read_shards(manifest, folder).collect() == []
