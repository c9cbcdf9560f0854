"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with one shingle set form a class, and the join runs over classes. The shingles of a
class are ordered rare-first (by the counts of their hash buckets over all documents, then by
hash), and only the prefix that any linked partner must meet is posted. Candidates that pass the
length and positional filters are verified once per pair, on whole sets, after a suffix filter on counts by hash range.

Only components are asked for, so pairs inside one component need no check. In a first round each
posting meets the best one of its n-gram (which has least before it), which ties a group of copies
together with as many pairs as members. A second round checks what is left: pairs that share a
prefix n-gram across components. Every link between different texts is thus either verified or lies
inside a component already; none is lost and no cap is set.

Most postings have a shingle that no other class posts. They are found by two shuffles of all postings,
the largest of the join, which is why these go part by part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import Scratch, by_size, collect_counts, count_blocks, free_others, mix, shingle_sets, texts_of, with_fields
from .components import connected_components

#: Hash buckets of the shingle counts: 2 MB on the driver and in each worker, at every size of the input.
BUCKET_BITS = 18
#: Ranges of hashes whose counts the suffix filter compares; a class carries a byte for each.
RANGES = 64
#: Up to so many document ids (8 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: The postings are shuffled in so many parts by their shingles, one part after another, so that the disk holds a part's shuffle alone.
TOKEN_PARTS = 2


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def class_hash(h: np.ndarray) -> int:
    """A 64-bit hash of a sorted set, which names the class of all documents that have it."""
    if not len(h):
        return 0
    with np.errstate(over="ignore"):
        place = np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return int(mix(mix(h ^ place).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_EDGES = np.arange(1, RANGES, dtype=np.uint64) << np.uint64(58)


def _sketch(h: np.ndarray) -> bytes:
    """How many of a sorted set fall in each range of hashes (255 at most, which only weakens the filter)."""
    return np.minimum(np.diff(np.searchsorted(h, _EDGES), prepend=0, append=len(h)), 255).astype(np.uint8).tobytes()


def _scan(width: int):
    """Per document its set size, class and sketch; per task the bucket counts, in blocks."""

    def scan(batches):
        free_others()
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            texts, sizes, keys, sketches = texts_of(batch.column(1)), [], [], []
            for lo, hi in by_size(texts):
                sets = list(shingle_sets(texts[lo:hi], width))
                sizes += map(len, sets)
                keys += map(class_hash, sets)
                sketches += map(_sketch, sets)
                counts += np.bincount(_buckets(np.concatenate(sets)), minlength=len(counts))
            none = len(sizes)
            yield _table(doc_id=batch.column(0).cast(pa.int64()), n=pa.array(sizes, pa.int64()), key=pa.array(keys, pa.int64()), sketch=pa.array(sketches, pa.binary()), block=pa.nulls(none, pa.int32()), counts=pa.nulls(none, pa.binary()))
        for blocks in count_blocks(counts):
            none = pa.nulls(len(blocks), pa.int64())
            yield _table(doc_id=none, n=none, key=none, sketch=pa.nulls(len(blocks), pa.binary()), block=blocks.column(0), counts=blocks.column(1))

    return scan


def _post(width: int, num: int, den: int, counts):
    """The postings of each document: the rarest shingles, of which a linked partner has at least one."""

    def post(batches):
        free_others()
        rank = counts.value
        for batch in batches:
            texts = texts_of(batch.column(0))
            for lo, hi in by_size(texts):
                token, key, size, place = [np.zeros(0, np.int64)], [], [], []
                for h in shingle_sets(texts[lo:hi], width):
                    if n := len(h):
                        keep = n - -(-num * n // den) + 1
                        common, key_of = rank[_buckets(h)], class_hash(h)
                        few = common <= np.partition(common, keep - 1)[keep - 1]  # the prefix, and ties of its last
                        h, common = h[few], common[few]
                        token.append(h[np.lexsort((h, common))[:keep]].view(np.int64))
                        key.append(key_of)
                        size.append(n)
                        place.append(keep)
                yield _table(token=pa.array(np.concatenate(token)), key=pa.array(np.repeat(np.array(key, np.int64), place)), n=pa.array(np.repeat(np.array(size, np.int32), place)), pos=pa.array(np.concatenate([np.arange(1, k + 1, dtype=np.int32) for k in place] or [np.zeros(0, np.int32)])))

    return post


def _sets(width: int):
    def sets(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            for lo, hi in by_size(texts):
                found = [h for h in shingle_sets(texts[lo:hi], width) if len(h)]
                yield _table(key=pa.array([class_hash(h) for h in found], pa.int64()), hashes=pa.array([h.tobytes() for h in found], pa.binary()))

    return sets


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have a similarity of num/den."""
    least = -(-num * (len(x) + len(y)) // (num + den))
    return min(len(x), len(y)) >= least and len(np.intersect1d(x, y, assume_unique=True)) >= least


def _suffix_filter(num: int, den: int):
    """Keeps the pairs whose sketches differ by no more than linked sets may; a shingle of one set alone shifts one count by one."""

    def keep(batches):
        for batch in batches:
            total = batch.column("m").to_numpy() + batch.column("n").to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int32) for c in ("x", "y"))
            least = -(-num * total // (num + den))
            yield batch.select(["a", "b"]).filter(pa.array(np.abs(x - y).sum(1) <= total - 2 * least))

    return keep


def _verify(num: int, den: int):
    def verify(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(k)] for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array([linked(*p, num, den) for p in zip(x, y, strict=True)], pa.bool_()))

    return verify


class _Join:
    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.spark = docs.sparkSession
        self.width, self.num, self.den = width, num, den
        self.docs = docs.select("doc_id", "text")
        self.scratch = Scratch(self.spark, "ngram-join")

    def length_class(self) -> Column:
        """A number of the set size that differs by 1 at most between linked sets; the least allowance is for rounding."""
        return F.floor(F.ln("n") / (math.log(self.den / self.num) * (1 + 1e-9))) if self.num < self.den else F.col("n").cast("long")

    def least(self, total: str) -> str:
        """How many shingles two linked sets of so many in all share at least."""
        return f"(({self.num} * ({total}) + {self.num + self.den - 1}) div {self.num + self.den})"

    def may_link(self, a: str, b: str) -> str:
        """The length and the positional filter on two postings of one shingle."""
        return f"{self.den} * least({a}.n, {b}.n) >= {self.num} * greatest({a}.n, {b}.n) and 1 + least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {self.least(f'{a}.n + {b}.n')}"

    def shared_postings(self) -> DataFrame:
        """Postings of shingles that several classes post, without those that can pass with no partner of theirs."""
        counts = collect_counts(self.scan.where("block is not null").select("block", "counts"), 1 << BUCKET_BITS)
        rank = self.spark.sparkContext.broadcast(counts)
        post = self.docs.select("text").mapInArrow(_post(self.width, self.num, self.den, rank), "token long, key long, n int, pos int")
        post = self.scratch.save(post, "postings")
        smallest = f"greatest(({self.num} * n + {self.den - 1}) div {self.den}, n_min)"
        for k in range(TOKEN_PARTS):
            part = post.where(F.pmod("token", F.lit(TOKEN_PARTS)) == k)
            shared = part.groupBy("token").agg(F.min("n").alias("n_min"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").drop("lo", "hi")
            shared = self.scratch.save(shared, "tokens")  # by itself, so that its shuffle is gone when the postings are joined
            kept = part.join(shared, "token").where(f"1 + n - pos >= {self.least(f'n + {smallest}')}").select("token", "key", "n", "pos").distinct()
            self.scratch.save(kept, f"shared-{k}")
        self.scratch.drop("postings", "tokens")
        return self.spark.read.schema(kept.schema).parquet(*(self.scratch.path(f"shared-{k}") for k in range(TOKEN_PARTS)))

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs of classes (a < b) that link; the set of a class comes from one of its documents."""
        side = lambda key, n, sketch: self.classes.select(F.col("key").alias(key), F.col("n").alias(n), F.col("sketch").alias(sketch))
        pairs = self.scratch.save(pairs.distinct(), f"pairs-{name}")
        both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")
        near = self.scratch.save(both.mapInArrow(_suffix_filter(self.num, self.den), "a long, b long"), f"near-{name}")
        keys = near.select(F.col("a").alias("key")).union(near.select("b")).distinct()
        ids = self.scratch.save(self.classes.join(keys, "key").select("doc_id").distinct(), f"ids-{name}")
        few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        texts = self.docs.join(few, self.docs["doc_id"].eqNullSafe(few["doc_id"]), "left_semi").select("text")
        sets = self.scratch.save(texts.mapInArrow(_sets(self.width), "key long, hashes binary"), f"sets-{name}")
        both = near.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
        links = both.select("a", "b", "x", "y").mapInArrow(_verify(self.num, self.den), "a long, b long")
        links = self.scratch.save(links, f"links-{name}")
        self.scratch.drop(*(f"{x}-{name}" for x in ("sets", "ids", "near", "pairs")))
        return links

    def run(self) -> DataFrame:
        scan = self.docs.mapInArrow(_scan(self.width), "doc_id long, n long, key long, sketch binary, block int, counts binary")
        self.scan = self.scratch.save(scan, "scan")
        self.features = self.scan.where("block is null").select("doc_id", "n", "key")
        # A class is as its documents: any sketch will do, and the least id stands for it.
        classes = self.scan.where("n > 0").groupBy("key").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch"))
        self.classes = self.scratch.save(classes, "classes")
        post = self.shared_postings()
        best = post.groupBy("token").agg(F.min(F.struct("pos", "n", "key")).alias("p")).select("token", "p.*")
        pairs = post.alias("x").join(best.alias("y"), "token").where(f"x.key <> y.key and {self.may_link('x', 'y')}")
        first = self.verified(pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")), "1")
        roots = connected_components(first, self.scratch, "cc1")

        post = self.scratch.save(post.join(roots, F.col("key") == F.col("node"), "left").select("token", "key", "n", "pos", self.length_class().alias("len"), F.coalesce("root", "key").alias("comp")), "rest")
        groups = post.groupBy("token", "len", "comp").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max(F.col("n") - F.col("pos")).alias("after"))
        several = groups.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        groups = self.scratch.save(groups.join(several, "token"), "groups")
        # A common n-gram's components meet only those of their own or the next length: its rows are dealt out by both.
        h = groups.withColumn("at", F.explode(F.array(F.col("len") - 1, F.col("len"), F.col("len") + 1))).alias("h")
        cross = groups.alias("g").join(h, F.expr("g.token = h.token and g.len = h.at")).where(
            f"g.comp < h.comp and {self.den} * g.n_max >= {self.num} * h.n_min and {self.den} * h.n_max >= {self.num} * g.n_min and 1 + least(g.after, h.after) >= {self.least('g.n_min + h.n_min')}"
        )
        cross = self.scratch.save(cross.selectExpr("g.token", "g.len", "g.comp", "h.len as other_len", "h.comp as other"), "cross")
        one = cross.join(post, ["token", "len", "comp"]).select("token", "other_len", "other", "key", "n", "pos").alias("x")
        two = post.select("token", F.col("len").alias("other_len"), F.col("comp").alias("other"), "key", "n", "pos").alias("y")
        pairs = one.join(two, ["token", "other_len", "other"]).where(self.may_link("x", "y"))
        second = self.verified(pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")), "2")
        if not second.isEmpty():
            roots = connected_components(first.union(second), self.scratch, "cc2")
        self.scratch.drop("rest", "groups", "cross", *(f"shared-{k}" for k in range(TOKEN_PARTS)))
        return self.with_components(roots)

    def with_components(self, roots: DataFrame) -> DataFrame:
        classes = self.features.groupBy("key").agg(F.min("doc_id").alias("first"))
        classes = classes.join(roots, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("comp"))
        # Of one id's classes the least key stands for the component; a null id counts as greatest.
        least = classes.groupBy("comp").agg(F.min(F.struct(F.col("first").isNull(), "first", "key")).alias("least"))
        named = classes.join(least, "comp").select("key", F.col("least.first").alias("component"), (F.col("least.key") == F.col("key")).alias("stands"))
        own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
        return self.features.join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "key", "stands")


def ngram_join(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row per document: ``doc_id, n_shingles, component_id``.

    Two documents link when their sets of ``width``-word shingles have a Jaccard similarity of at
    least ``num / den``; ``component_id`` is the smallest doc_id reachable by links. A text of fewer
    words is one shingle; a null or empty text has none, links with nothing and is its own component.
    Repeated rows and ids keep a row each. Null ids count as greatest: they name a component only if
    all ids in it are null, and then by null. An empty table gives an empty result; other columns are
    ignored. Shingles and classes are told apart by 64-bit hashes.
    """
    return _Join(docs, width, num, den).run().select("doc_id", "n_shingles", "component_id")


def _keyed(width: int):
    """The batches with the class of each text beside it."""

    def keyed(batches):
        for batch in batches:
            texts, keys = texts_of(batch.column("_text")), []
            for lo, hi in by_size(texts):
                keys += map(class_hash, shingle_sets(texts[lo:hi], width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "_key"])

    return keyed


def keep_first(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one document of each component, the one with its id; of repeated rows one stays.

    Rows of one id are told apart by their texts: each stays if it stands for a component of its own,
    and in a component the row of the least id and then of the least class stands.
    Documents without words, and those with a null id, all stay. The texts aren't shuffled while the
    ids that go are few enough to be broadcast; only rows whose id is repeated are compared. Other
    columns stay as they are, whatever their names.
    """
    found = Scratch(docs.sparkSession, "keep-first").save(_Join(docs, width, num, den).run(), "found")
    found = found.where("n_shingles > 0 and doc_id is not null").withColumn("first", F.col("stands") & (F.col("doc_id") == F.col("component_id")))
    by_id = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("first").cast("int")).alias("first"))

    def ids(condition: str) -> tuple[DataFrame, int]:
        some = by_id.where(condition).select(F.col("doc_id").alias("_gone"))
        n = some.count()
        return (F.broadcast(some) if n <= BROADCAST_IDS else some), n

    words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.when(words, F.col("doc_id")).alias("_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    gone, _ = ids("first = 0")
    kept = rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    repeated, n = ids("first = 1 and rows > 1")
    if n:
        same = F.col("_id") == F.col("_gone")
        some = kept.join(repeated, same, "left_semi").withColumn("_text", F.col("_row.text"))
        some = some.mapInArrow(_keyed(width), with_fields(some.schema, _key=LongType()))
        stay = found.where("first").join(repeated, F.col("doc_id") == F.col("_gone"), "left_semi").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
        some = some.dropDuplicates(["_id", "_key"]).join(stay, ["_id", "_key"], "left_semi")
        kept = kept.join(repeated, same, "left_anti").unionByName(some.select("_id", "_row"))
    return kept.select("_row.*")
