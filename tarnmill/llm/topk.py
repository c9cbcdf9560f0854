"""Exact top-k inner products by a pivot-distance index.

Vectors are integers. Adding a coordinate sqrt(M - |v|^2) to each (M the greatest squared norm) and 0
to a query makes the greatest inner product the nearest neighbour: d^2 = |q|^2 + M - 2<q, v>. Every
vector is keyed by its nearest pivot and its distance to that pivot; the vectors of a pivot, sorted
by distance, are cut into annuli, which are written once and never shuffled again.

Queries are broadcast in blocks of a fixed size. A task takes some annuli at a time and orders them
by their gap to the queries' rings: |d(q, p) - d(v, p)| <= d(q, v), so an annulus whose gap is greater
than a query's k-th distance so far holds nothing for it. It begins with the nearest and stops where
all gaps lie beyond the bound, which shrinks with every annulus. A first job searches the annuli of
each query's own pivot alone, so that the second one begins everywhere with a good bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_others

#: Vectors that the pivots are fitted on at most, and pivots.
SAMPLE, PIVOTS = 8_192, 32
#: Vectors in an annulus, annuli that a task orders at a time, and queries whose products are taken at a time.
ANNULUS, ANNULI, QUERIES = 512, 32, 1024
#: Bytes of the queries in one broadcast block; more queries take several passes over the index.
BLOCK_BYTES = 16 << 20
#: Candidates that a task holds before it keeps each query's k best of them.
HELD = 1 << 18
#: Allowance for rounding in distances; it only makes more annuli be searched.
SLACK = 1e-6


def _dimension(vectors: DataFrame) -> int:
    """The commonest length of a vector; of ties the greatest."""
    row = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return row.d if row else 0


def quantized(table: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id`` and the integer components; vectors that are null or hold null or non-finite ones are left out."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return table.where(whole & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("embedding"))


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots of a sample, then one round of means."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    p = sample[chosen]
    own = _distances(sample, p).argmin(1)
    return np.stack([sample[own == k].mean(0) if (own == k).any() else p[k] for k in range(len(p))])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(most - (v * v).sum(1), 0))[:, None]], 1)


def _assign(pivots, most: float, dim: int):
    """Nearest pivot and distance of each vector, and whether it is a query."""

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(_lifted(_matrix(batch.column(1), dim), most), pivots)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(d[np.arange(len(d)), own])], names=["vec_id", "embedding", "pivot", "dist"])

    return assign


def inner_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: in double precision where no sum can leave its whole numbers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


class Queries:
    """A block of queries: ids, vectors, own pivots, and the scores that a candidate must reach."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, least: np.ndarray):
        self.ids, self.vectors, self.own, self.least = ids, vectors, own, least


def _k_best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best by score, ties to the smaller id."""
    order = np.lexsort((ids, -scores, q))
    first = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1])) if len(q) else q
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


class _Search:
    """The k best of each query of a block among the annuli that it is given."""

    def __init__(self, queries: Queries, pivots: np.ndarray, most: float, k: int, home: bool):
        self.queries, self.k, self.most, self.home = queries, k, most, home
        self.least = queries.least.copy()
        lifted = np.concatenate([queries.vectors.astype(np.float64), np.zeros((len(queries.ids), 1))], 1)
        self.rings, self.norms = _distances(lifted, pivots), (lifted * lifted).sum(1)
        self.held = [np.zeros(0, np.int64)] * 3
        self.new: list[tuple] = []
        self.fresh = self.searched = self.possible = 0

    def _reach(self, some: np.ndarray) -> np.ndarray:
        """The distance within which a candidate can still be among the k best."""
        gone = self.norms[some] + self.most - 2 * self.least[some]
        return np.sqrt(np.maximum(gone, 0)) * (1 + SLACK) + SLACK

    def take(self, annuli: list[tuple]) -> None:
        """Searches ``(pivot, d_min, d_max, ids, vectors)`` for every query, the annuli nearest to the queries' rings first."""
        pivot, low, high = (np.array([x[j] for x in annuli]) for j in range(3))
        for lo in range(0, len(self.queries.ids), QUERIES):
            some = np.arange(lo, min(lo + QUERIES, len(self.queries.ids)))
            ring = self.rings[some][:, pivot]
            gaps = np.maximum(np.maximum(low - ring, ring - high), 0)
            mine = (self.queries.own[some, None] == pivot) == self.home
            self.possible += int(mine.sum())
            gaps[~mine] = np.inf
            for j in np.argsort(gaps.min(0), kind="stable"):
                ask = some[gaps[:, j] <= np.minimum(self._reach(some), np.finfo(float).max)]
                if len(ask):
                    self.searched += len(ask)
                    self._annulus(ask, annuli[j][3], annuli[j][4])

    def _annulus(self, ask: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = inner_products(self.queries.vectors[ask], vectors)
        fits = (scores >= self.least[ask, None]) & (ids != self.queries.ids[ask, None])
        if len(ids) > 4 * self.k and (many := fits.sum(1) > 2 * self.k).any():  # no bound yet: the k-th best of the annulus is one
            kth = np.partition(np.where(fits, scores, np.iinfo(np.int64).min)[many], len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            self.least[ask[many]] = np.maximum(self.least[ask[many]], kth)
            fits &= scores >= self.least[ask, None]
        row, column = np.nonzero(fits)
        if len(row):
            self.new.append((ask[row], ids[column], scores[row, column]))
            self.fresh += len(row)
            if self.fresh >= HELD:
                self._settle()

    def _settle(self) -> None:
        """Keeps each query's k best and raises its bound to the last of them."""
        q, ids, scores = (np.concatenate([old, *new]) for old, new in zip(self.held, zip(*self.new, strict=True), strict=True)) if self.new else self.held
        best = _k_best(q, ids, scores, self.k)
        self.held = [q[best], ids[best], scores[best]]
        self.new, self.fresh = [], 0
        n = np.bincount(self.held[0], minlength=len(self.least))
        last = np.cumsum(n) - 1
        full = n >= self.k
        self.least[full] = np.maximum(self.least[full], self.held[2][last[full]])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._settle()
        return self.queries.ids[self.held[0]], self.held[1], self.held[2]


def _expand(k: int, dim: int, pivots, most: float, block, home: bool):
    """Per task the k best of each query among its annuli: those of the query's own pivot, or all others."""

    def expand(batches):
        free_others()
        search = _Search(block.value, pivots, most, k, home)
        own, waiting = set(search.queries.own.tolist()), []
        for batch in batches:
            for pivot, ids, vectors, low, high in zip(*(batch.column(c) for c in ("pivot", "ids", "vectors", "d_min", "d_max")), strict=True):
                if home and pivot.as_py() not in own:
                    continue
                waiting.append((pivot.as_py(), low.as_py(), high.as_py(), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(vectors.as_buffer(), np.int64).reshape(-1, dim)))
                if len(waiting) >= ANNULI:
                    search.take(waiting)
                    waiting = []
        if waiting:
            search.take(waiting)
        q, ids, scores = search.found()
        for lo in range(0, len(q), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (q, ids, scores)], names=["query_id", "vec_id", "score"])

    return expand


def _pack(batches):
    """Rows in order of pivot and distance -> annuli of at most ``ANNULUS`` vectors."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def annuli(table: pa.Table, last: bool):
        """The complete annuli of some rows, and the rows that are left."""
        pivot = table.column("pivot").to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(pivot)) + 1, len(pivot))
        out, lo = [], 0
        for cut in cuts:
            while lo < cut and (last or cut < len(pivot) or cut - lo >= ANNULUS):
                hi = min(lo + ANNULUS, cut)
                part = table.slice(lo, hi - lo)
                dist = part.column("dist").to_numpy()
                vectors = part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
                out.append((int(pivot[lo]), part.column("vec_id").to_numpy().astype("<i8").tobytes(), vectors.tobytes(), float(dist[0]), float(dist[-1])))
                lo = hi
        return out, table.slice(lo)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64()), strict=True)], names=["pivot", "ids", "vectors", "d_min", "d_max"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 8 * ANNULUS:
            out, rest = annuli(pa.Table.from_batches(held), False)
            held, rows = rest.to_batches(), rest.num_rows
            for lo in range(0, len(out), 8):
                yield batch_of(out[lo : lo + 8])
    if rows:
        out, _ = annuli(pa.Table.from_batches(held), True)
        for lo in range(0, len(out), 8):
            yield batch_of(out[lo : lo + 8])


_ANNULI = "pivot int, ids binary, vectors binary, d_min double, d_max double"


def _block(rows, dim: int) -> Queries:
    """Collected queries with the least score that each must reach; without one any will do."""
    ids, own = (np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "pivot"))
    least = np.array([np.iinfo(np.int64).min // 4 if r["least"] is None else r["least"] for r in rows], np.int64)
    return Queries(ids, np.array([r["embedding"] for r in rows], np.int64).reshape(-1, dim), own, least)


def top_k(table: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """``table(vec_id, embedding, ...)`` -> ``query_id, rank, vec_id, score``: each query's k best by inner product.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows with another
    vec_id. Components become floor(scale * x). Vectors that are null, hold null or non-finite
    components, are empty, or have another length than the commonest take no part, nor do rows without vec_id.
    Ties go to the smaller vec_id; rows that repeat an id and vector count once; with fewer candidates
    than k all are returned. An empty table gives an empty result; other columns are ignored.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = scratch.save(quantized(table, scale), "vectors")
    dim = _dimension(vectors)
    if dim <= 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = vectors.where(F.size("embedding") == dim).dropDuplicates()
    most = float(vectors.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0] or 0.0)
    sample = np.array([r.embedding for r in vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("embedding").collect()], np.int64).reshape(-1, dim)
    pivots = _pivots(_lifted(sample, most), PIVOTS)
    keyed = scratch.save(vectors.mapInArrow(_assign(pivots, most, dim), "vec_id long, embedding array<long>, pivot int, dist double"), "keyed")
    scratch.drop("vectors")
    # A pivot may hold most vectors: ranges of (pivot, distance) split it over tasks.
    ordered = keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    annuli = scratch.save(ordered.mapInArrow(_pack, _ANNULI), "annuli")

    asked = keyed.where(F.col("vec_id") % every == 0)
    blocks = -(-asked.count() * dim * 8 // BLOCK_BYTES)
    block_of = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(max(blocks, 1)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for b in range(blocks):
        mine = asked.where(block_of == b).select("vec_id", "embedding", "pivot")
        home = _run(annuli, mine.withColumn("least", F.lit(None).cast("long")), k, dim, pivots, most, True)
        home = scratch.save(best(home).drop("rank"), f"home-{b}")
        least = home.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
        mine = mine.join(least, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "embedding", "pivot", "least")
        rest = scratch.save(_run(annuli, mine, k, dim, pivots, most, False), f"rest-{b}")
        found = found.unionByName(home).unionByName(rest)
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _run(annuli: DataFrame, queries: DataFrame, k: int, dim: int, pivots: np.ndarray, most: float, home: bool) -> DataFrame:
    """One block of queries over all annuli; what each task finds, k rows of a query at most."""
    block = annuli.sparkSession.sparkContext.broadcast(_block(queries.collect(), dim))
    return annuli.mapInArrow(_expand(k, dim, pivots, most, block, home), "query_id long, vec_id long, score long")
