"""Packing by concatenate and cut: two-pass prefix sums give global offsets, fixed windows cut them.

Pass one tokenizes and writes each document's ids with its place in its task's partition. The token
totals of the partitions (a number each) are summed up on the driver, which gives every document its
offset in the whole. Pass two cuts at the multiples of the window; a document that crosses one leaves
a boundary record on either side. Nothing is shuffled, and no task sees more than its own rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_size, texts_of
from .tokens import CACHED_WORDS, encoder

_TOKENS = "part int, before long, doc_id long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to long"


def _tokenize(tokenizer: str, end_id: int, cached_words: int):
    def tokenize(batches):
        enc, part, before = encoder(tokenizer, cached_words), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in by_size(texts):
                ids = [x + end for x in enc.encode(texts[lo:hi])]
                starts = list(accumulate((len(x) // enc.dtype.itemsize for x in ids), initial=before))
                before = starts.pop()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), batch.column(0)[lo:hi].cast(pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "before", "doc_id", "ids"],
                )

    return tokenize


def _cut(window: int, bases: dict[int, int], total: int, dtype: str):
    last, rest = divmod(total, window)
    kind = np.dtype(dtype)

    def cut(batches):
        for batch in batches:
            part, before, doc, ids = (batch.column(k) for k in range(4))
            rows: dict[str, list] = {n.split()[0]: [] for n in _PIECES.split(", ")}
            for p, b, d, x in zip(part.to_pylist(), before.to_pylist(), doc.to_pylist(), ids, strict=True):
                at = bases[p] + b
                x = np.frombuffer(x.as_buffer(), kind).astype("<u4")
                k = 0
                while k < len(x):
                    seq, off = divmod(at + k, window)
                    n = min(window - off, len(x) - k)
                    pad = rest if seq == last and rest & (rest - 1) == 0 else window
                    for name, v in zip(rows, (d, k, n, x[k : k + n].tobytes(), len(x), seq, off, pad), strict=True):
                        rows[name].append(v)
                    k += n
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if n == "ids" else pa.int64()) for n, v in rows.items()], names=list(rows))

    return cut


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, cached_words: int = CACHED_WORDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> pieces of sequences of ``window`` tokens.

    A piece: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` in the sequence, and
    ``padded_to``, the sequence's length with padding: the window, but for a last sequence whose ids
    are a power of two already. A document is the ids of its whole text and ``end_id``; a null or empty
    text is the end id alone. Repeated rows and null ids are documents of their own; an empty table
    gives no pieces; other columns are ignored. ``tokenizer`` is a file that every worker can read. A worker keeps the ids of up to twice
    ``cached_words`` words, also after the job; fewer take less memory and more time.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    tokens = docs.select("doc_id", "text").mapInArrow(_tokenize(tokenizer, end_id, cached_words), _TOKENS)
    tokens = scratch.save(tokens, "tokens")
    dtype = encoder(tokenizer).dtype
    sums = tokens.groupBy("part").agg(F.sum(F.octet_length("ids")).alias("bytes")).orderBy("part").collect()
    totals = [r.bytes // dtype.itemsize for r in sums]
    bases = dict(zip([r.part for r in sums], accumulate(totals, initial=0)))
    return tokens.mapInArrow(_cut(window, bases, sum(totals), dtype.str), _PIECES)
