"""Codes of vectors by small codebooks, the nearest entries found through bit-quantised cells.

A vector is cut into equal parts, and each part is coded by the nearest of its position's entries.
The entries' coordinates are quantised into cells of a few bits, each with its least and greatest
coordinate. For a query, a table per coordinate holds the least and greatest squared distance to each
cell; sums of table values bound the distance to every entry from below and above. Only entries whose
lower bound doesn't lie above the least upper bound are compared by their exact integer distance.

Codebooks are a fixed number of entries, whatever the number of vectors: they travel with the tasks.
A round is one pass in which each task adds up its own vectors by entry; Spark adds the tasks' sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bits of a cell of an entry's coordinate.
CELL_BITS = 3
#: Vectors whose bounds are computed at a time.
_ROWS = 2048
#: Integers from here on are refused: squared distances over up to 8,191 components must fit 63 bits.
LIMIT = 1 << 24


class Cells:
    """The entries of one part's codebook as cells: per coordinate each entry's cell, and each cell's least and greatest value."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        dim = entries.shape[1]
        self.cell = np.zeros(entries.shape, np.int64)
        self.low, self.high = (np.zeros((dim, 1 << bits), np.int64) for _ in range(2))
        for d in range(dim):
            x = entries[:, d]
            least = int(x.min())
            width = -(-(int(x.max()) - least + 1) >> bits)
            self.cell[:, d] = (x - least) // width
            for c in np.unique(self.cell[:, d]):
                inside = x[self.cell[:, d] == c]
                self.low[d, c], self.high[d, c] = inside.min(), inside.max()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest entry (ties to the lower one), its squared distance, and how many distances were computed in all."""
        lower, upper = (np.zeros((len(x), len(self.entries)), np.int64) for _ in range(2))
        for d in range(x.shape[1]):
            below, above = self.low[d] - x[:, d, None], x[:, d, None] - self.high[d]
            gap = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            lower += (gap * gap)[:, self.cell[:, d]]
            upper += (far * far)[:, self.cell[:, d]]
        row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))  # at least one of each row
        off = x[row] - self.entries[entry]
        dist = (off * off).sum(1)
        begins = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(dist, begins) if len(x) else dist
        hits = np.flatnonzero(dist == best[row])
        first = hits[np.searchsorted(row[hits], np.arange(len(x)))]
        return entry[first], best, len(row)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy().astype(np.int64)
    if len(flat) == len(column) * dim:
        return flat.reshape(-1, dim)
    out, size = np.zeros((len(column), dim), np.int64), np.diff(ends)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return out


def _assigned(column: pa.Array, cells: list[Cells], dim: int):
    """Some rows at a time: the rows by part, their entries and their distances (rows x parts)."""
    width = dim // len(cells)
    for lo in range(0, len(column), _ROWS):
        x = _matrix(column.slice(lo, _ROWS), dim).reshape(-1, len(cells), width)
        found = [c.nearest(x[:, p])[:2] for p, c in enumerate(cells)]
        yield x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(codebooks: np.ndarray):
    """A task's sums: per part and entry the number of its vectors and, per coordinate, their total."""
    parts, entries, width = codebooks.shape

    def sums(batches):
        cells = [Cells(c) for c in codebooks]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for x, own, _ in _assigned(batch.column(0), cells, parts * width):
                for p in range(parts):
                    count[p] += np.bincount(own[:, p], minlength=entries)
                    np.add.at(total[p], own[:, p], x[:, p])
        part, entry = np.nonzero(count)
        place = np.tile(np.arange(width), len(part))
        columns = (np.repeat(part, width), np.repeat(entry, width), place, np.repeat(count[part, entry], width), total[part, entry].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "place", "n", "total"])

    return sums


def _codes(codebooks: np.ndarray):
    parts, _, width = codebooks.shape

    def codes(batches):
        cells = [Cells(c) for c in codebooks if len(c)]  # none without vectors
        for batch in batches:
            code, error = [], [np.zeros(0, np.int64)]
            for _, own, dist in _assigned(batch.column(2), cells, parts * width):
                code += [row.tobytes().hex() for row in own.astype(np.uint8)]
                error.append(dist.sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(np.concatenate(error))], names=["vec_id", "label", "code", "error"])

    return codes


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label`` and ``v``, the components floor(scale * x), of the vectors that are whole."""
    x = lambda c: c.cast("double")
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < F.lit(float("inf"))))
    large = F.exists("embedding", lambda c: F.abs(x(c) * scale) >= LIMIT)
    v = F.transform("embedding", lambda c: F.floor(x(c) * scale).cast("int"))
    v = F.when(large, F.raise_error(F.lit(f"a component is {LIMIT} or more as an integer"))).otherwise(v)
    return vectors.where(whole).select("vec_id", "label", v.alias("v"))


def encode_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """``vectors(vec_id, embedding, label, ...)`` -> ``vec_id, label, code, error, label_error, codebooks_sha256``.

    Vectors that are null or hold null or non-finite components are left out. The others become
    integers floor(``scale`` * x) and are cut into ``parts`` equal parts; all have the length of the
    longest, rounded up to a multiple of ``parts``, and shorter ones count as filled up with zeros.
    Integers of 2**24 or more in size end the job with an error, as distances wouldn't fit a long.

    The codebook of a part begins as that part of the vectors of the ``entries`` (at most 256) least
    ids, ascending (null ids last, ties by the vector; all vectors, if fewer). Each round assigns all
    parts to their nearest entries and moves every entry that has some to the floor of their mean.
    ``code`` has two hex digits a part, ``error`` the squared distances of a vector's parts in sum,
    ``label_error`` that sum over all vectors of the same label (null is one label), and the digest is
    that of all final entries' components. Repeated rows are vectors of their own; an empty table
    gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    rows = scratch.save(integers(vectors, scale), "rows")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    dim = max(1, -(-longest // parts)) * parts
    first = [r.v + [0] * (dim - len(r.v)) for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    codebooks = np.array(first, np.int64).reshape(-1, parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        sums = rows.select("v").mapInArrow(_sums(codebooks), "part long, entry long, place long, n long, total long")
        # As many rows as the codebooks have components, whatever the input.
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            codebooks[r.part, r.entry, r.place] = r.total // r.n
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = scratch.save(rows.mapInArrow(_codes(codebooks), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "coded")
    # Labels may be as many as vectors: Spark broadcasts the written sums if their files are small, else it deals out both sides and splits a label that holds many rows.
    sums = scratch.save(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "_label")
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel())).encode()).hexdigest()
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
