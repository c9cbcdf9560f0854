"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .bpe import decode, encode
from .chat import format_chat, read_chat, unescape
from .common import Scratch
from .decontaminate import find_leaks
from .html_text import extract_text
from .ngram_join import ngram_join
from .packing import pack
from .pii import KINDS, candidates, decide, fit, span_list
from .quality import resample
from .sstable import read_shards, write_shards
from .topk import top_k
from .toxicity import fit as fit_toxicity
from .toxicity import score_toxicity
from .vector_codes import encode_vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "sstable").root
    manifest = write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    ids = F.col("ids")
    return read_shards(manifest, folder).select("doc_id", "start", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.sql("select -7L conv_id, t.* from (select explode(array(struct(0L turn, 'user' role), struct(1L turn, 'assistant' role))) t)").withColumn("text", F.lit(odd))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = read_chat(format_chat(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(masked(s))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op8_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *,
    length(regexp_extract_all(role, '\\|</?s>|<</?(?:SYS|ROLE)>>|\[/?INST\]')) AS role_escapes,
    length(regexp_extract_all(text, '\\|</?s>|<</?(?:SYS|ROLE)>>|\[/?INST\]')) AS escapes,
    regexp_matches(text, '(?s)\\.|</?s>|<</?(?:SYS|ROLE)>>|\[/?INST\]') AS conflict
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + CASE WHEN conflict THEN escapes ELSE 0 END
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 21 + length(role) + role_escapes END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", candidates(F.col("text")).alias("spans"))
    found = Scratch(spark, "pii").save(found, "candidates")  # without the texts
    pii = decide(F.col("spans"), fit(found))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    n_spans = F.size("pii").cast("long").alias("n_spans")
    return found.select("doc_id", pii.alias("pii")).select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("pii")).alias("spans"), n_spans)


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "log_weight", "perturbed")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit_toxicity(docs, labels.where(~held_out))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


ORACLES["op3_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = decode(encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def _codes_sql() -> str:
    """Two rounds and the last assignment, written out one after another."""
    nearest = """
own{k} AS MATERIALIZED (
  SELECT id, part, v, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + entry) AS best
  FROM parts JOIN book{k} USING (part) GROUP BY id, part, v)"""
    moved = """,
means{k} AS (
  SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY place) AS c
  FROM (SELECT part, best % 64 AS entry, place, sum(v[place]) AS total, count(*) AS n FROM own{k}, range(1, 1 + len(v)) t(place) GROUP BY ALL) GROUP BY part, entry),
book{l} AS MATERIALIZED (SELECT part, entry, CAST(coalesce(m.c, b.c) AS BIGINT[]) AS c FROM book{k} b LEFT JOIN means{k} m USING (part, entry)),"""
    return (
        """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v FROM kept, range(16) t(part)),
book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, v AS c FROM parts WHERE id <= 64),"""
        + "".join(nearest.format(k=k) + (moved.format(k=k, l=k + 1) if k < 2 else "") for k in range(3))
        + """,
coded AS (SELECT id, string_agg(format('{:02x}', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM own2 GROUP BY id),
digest AS (SELECT sha256(string_agg(CAST(c[place] AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book2, range(1, 1 + len(c)) t(place))
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (id), digest
"""
    )


ORACLES["op12_vector_codes"] = _codes_sql()
