import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarnmill.llm.decontaminate import normal
from tests.llm.test_ngram_join import brute
from tests.llm.test_pii import base

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        after = spark.createDataFrame(stage(spark, docs, SF).collect())
        rows = after.collect()
        if name != "packing":
            assert set(after.columns) == set(docs.columns)
        ids = {r.doc_id for r in rows}
        if name == "quality":
            good = [d for d in labels if labels[d]]
            bad = [d for d in labels if not labels[d]]
            assert sum(d in ids for d in good) >= 0.97 * len(good) and sum(d in ids for d in bad) <= 0.15 * len(bad)
        elif name == "near_duplicates":
            want = {c for _, _, c in brute([(r.doc_id, r.text) for r in before], 5, 4, 5)}
            assert ids == want and len(rows) == len(ids) < len(before)
        elif name == "decontaminate":
            leaks = {r.doc_id for r in before if any(x in normal(r.text) for x in items)}
            assert leaks and not leaks & ids and len(before) - len(rows) <= len(leaks) + 2
        elif name == "personal_data":
            assert len(rows) == len(before)
            old = {r.doc_id: r.text for r in before}
            for r in rows:
                assert r.n_chars == len(r.text)
                if not base(old[r.doc_id]) and r.text == old[r.doc_id]:
                    continue
                assert not [s for s in base(r.text) if s[1] in (0, 3)]
        else:
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert sum(r.length for r in rows) == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in before)
            one = next(r for r in rows if r.length == r.doc_tokens)
            text = next(r.text for r in before if r.doc_id == one.doc_id)
            assert one.ids_crc32 == zlib.crc32(np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes())
        docs, before = after, rows


def test_run_is_the_query(spark):
    from __spark_entry__ import queries

    rows = queries()["pipeline"](spark, "/root/testdata/sf0.001").collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_odd_rows_in_every_stage(spark):
    long = " ".join(f"w{i * 7919 % 10_007}" for i in range(60_000))
    copy = " ".join(f"c{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, long), (4, copy), (4, copy), (5, copy + " end"), (None, "write to a.b@c.org please"), (6, "call +49 30 1234567 now")]
    docs = spark.createDataFrame([(d, t, None, None, len(t or ""), f"x{k}", "i", 3.5) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, pii string, _id string, log_weight double")
    docs = docs.withColumn("row", F.lit("r")).withColumn("perturbed", F.lit(1)).withColumn("_gone", F.lit(2)).withColumn("_key", F.lit(3))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "/root/testdata/sf0.001").collect()
        none = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert none.collect() == []
        ids = [r.doc_id for r in got]
        if name == "packing":
            assert {(r.doc_id, r.doc_tokens) for r in got if r.doc_id in (1, 2)} == {(1, 1), (2, 1)} and ids.count(None) == 1 and ids.count(3) > 1
            continue
        assert none.columns == docs.columns
        for r in got:
            assert (r._id, r.log_weight, r.row, r.perturbed, r._gone, r._key, r.pii[0]) == ("i", 3.5, "r", 1, 2, 3, "x")
        if name == "quality":
            assert 1 not in ids and 2 not in ids
        elif name == "near_duplicates":
            assert sorted(map(str, ids)) == ["1", "2", "3", "4", "6", "None"]
        else:
            assert len(ids) == len(rows)
        if name == "personal_data":
            text = {r.doc_id: (r.text, r.n_chars) for r in got}
            assert text[1] == (None, None) and text[2] == ("", 0) and text[None][0] == "write to [EMAIL] please" and text[6][0] == "call [PHONE] now"
