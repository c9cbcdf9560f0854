"""A corpus pipeline: quality, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns
packed sequences. ``run`` writes every stage's rows to the shared folder and rereads them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm.common import Scratch, apart, together
from tarnmill.llm.decontaminate import without_leaks
from tarnmill.llm.ngram_join import keep_first
from tarnmill.llm.packing import pack
from tarnmill.llm.pii import find_pii, masked
from tarnmill.llm.quality import resample


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by importance resampling; those it rejects go, and so do texts without any word or mark.

    Rows are weighed each by itself: repeated ones tie, and stay or go together. Rows without doc_id share
    one noise. An empty table stays empty. Columns stay as they are, whatever their names.
    """
    rows = resample(apart(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return together(rows, docs.columns, "doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are 0.8 alike, that with the least id.

    A text of one to four words is one shingle. Rows without words or without doc_id all stay; of rows
    that repeat id and text one stays. Texts are compared whole. An empty table stays empty.
    """
    return keep_first(docs, width=5, num=4, den=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no part of a benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together; texts are read whole.
    Without items all documents stay.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and ``n_chars`` of the text as it is then.

    A null text stays null, with a null length. Repeated rows are masked alike. An empty table stays empty.
    """
    found = find_pii(apart(docs, "text")).withColumn("text", masked(F.col("text"), F.col("pii")))
    length = F.length("text").cast("long").alias("n_chars")
    return found.select(*(F.col(c) if c == "text" else length if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; workers that serve other stages too keep few words.

    A null or empty text is its end id alone. Repeated rows and rows without id are documents of their
    own. An empty table gives no pieces; other columns than ``doc_id`` and ``text`` aren't carried on.
    """
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048, cached_words=80_000)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("packing", packing)]

#: Models fitted by iteration, hashing and tokenizing have no SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
