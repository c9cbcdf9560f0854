"""What the operators of this subpackage share: scratch tables and byte-level word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of a batch for Python, where the session sets no size: the executor and its workers hold several copies of one.
BATCH_BYTES = 4 << 20


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: a lambda's body would compute an outer expression for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; in local mode a new one if unset."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    path = "file://" + tempfile.mkdtemp(prefix="tarnmill-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches for Python have about BATCH_BYTES, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def with_fields(schema: StructType, **kinds: DataType) -> StructType:
    """A schema with further fields at its end."""
    return StructType([*schema.fields, *(StructField(name, kind) for name, kind in kinds.items())])


def apart(rows: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others in one column ``row``, where no working column can clash with them."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in names]
    return rows.select(*names, *([F.struct(*rest).alias("row")] if rest else []))


def together(rows: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """What ``apart`` took apart, with the columns in their order."""
    return rows.select(*(F.col(c) if c in names else F.col(f"row.`{c}`") for c in columns))


_KEPT: dict[tuple, object] = {}


def kept(owner: str, key: tuple, make):
    """What ``make`` returns, kept in the worker for later tasks of the same owner."""
    if (owner, *key) not in _KEPT:
        free_others(owner)
        _KEPT[owner, *key] = make()
    return _KEPT[owner, *key]


def free_others(owner: str = "") -> None:
    """Drops what tasks of other owners have kept in this worker, and gives the memory back to the system.

    Workers outlive a job: without this, each stage of a pipeline would run beside the caches of those before it.
    """
    gone = [key for key in _KEPT if key[0] != owner]
    for key in gone:
        del _KEPT[key]
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and outlive lost executors.

    A table is computed once and reread; ``drop`` removes those that are no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        bounded_batches(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        # Shuffle files of earlier tables go when the driver collects its garbage, which by itself may be long after.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; a null counts as empty."""
    return column.fill_null("").to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: 64-bit, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
    _POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << 12) - 1, _BASE, np.uint64)]), dtype=np.uint64)

#: Per byte: 0 between words, 1 part of a word.
_WORD = (~_SPACE).astype(np.uint8)
#: Per byte: 0 white space, 1 part of a word, else the mark itself.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[_SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1

#: Bytes hashed at a time; the arrays of one such part take about 5 MB.
_PART = 1 << 17


def _powers(place: np.ndarray) -> np.ndarray:
    """Powers of an odd number modulo 2**64, from a table of the first 4096."""
    if int(place.max()) < len(_POWER):
        return _POWER[place]
    far = place >> 12
    first = int(far.min())
    high = np.array([pow(_BASE, k << 12, 1 << 64) for k in range(first, int(far.max()) + 1)], np.uint64)
    return _POWER[place & 4095] * high[far - first]


def _run_hashes(texts: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of bytes of one kind (other than 0) of all texts, and where each text's runs begin.

    The bytes are hashed part by part; what a part holds of a run is added to the run's sum, so that
    neither a long text nor a long word needs more than 8 bytes for each of its runs.
    """
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    if not data:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data])
    del data
    kind = kinds[raw]
    first = kind > 0
    first[1:] &= kind[1:] != kind[:-1]
    starts = np.flatnonzero(first)
    bounds = np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)
    sums, before = np.zeros(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        for lo in range(0, len(raw), _PART):
            at = np.flatnonzero(kind[lo : lo + _PART])
            begun = np.cumsum(first[lo : lo + _PART])
            if len(at):
                run = begun[at] + (before - 1)
                at += lo
                part = _BYTE[_LOWER[raw[at]]] * _powers(at - starts[run])
                begins = np.flatnonzero(np.diff(run, prepend=-1))
                sums[run[begins]] += np.add.reduceat(part, begins)
            before += int(begun[-1])
        return mix(sums), bounds


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words begin (one entry more than texts).

    A word is a run of bytes other than blank and 9 to 13; A to Z are lower-cased first.
    """
    return _run_hashes(texts, _WORD)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words are one run; no words give none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(words) < width:
            total = np.uint64(len(words))
            for w in words:
                total = mix((total * np.uint64(_STEP)) ^ w)
            return mix(np.array([total], np.uint64))
        n = len(words) - width + 1
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h = mix(h * np.uint64(_STEP) ^ words[k : k + n])
    return np.unique(h)


def by_size(texts: list[str], limit: int = 1 << 20):
    """Ranges of a batch with about ``limit`` characters each; a longer text has a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[str], width: int):
    """The shingle set of each text, in order, with memory bounded by a slice of the batch."""
    for lo, hi in by_size(texts):
        words, bounds = word_hashes(texts[lo:hi])
        for k in range(hi - lo):
            yield shingle_hashes(words[bounds[k] : bounds[k + 1]], width)


def run_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, but tokens are runs of letters and digits (or bytes from 128) and runs of one and the same other mark."""
    return _run_hashes(texts, _KIND)


_BLOCK = 1 << 12


def count_blocks(counts: np.ndarray):
    """A task's counts as rows ``(block, counts)``, blocks of zeros left out."""
    blocks = [k for k in range(-(-len(counts) // _BLOCK)) if counts[k * _BLOCK : (k + 1) * _BLOCK].any()]
    data = [counts[k * _BLOCK : (k + 1) * _BLOCK].astype("<i8").tobytes() for k in blocks]
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names=["block", "counts"])


def _add_blocks(batches):
    """Sums the blocks that a partition holds; a partition holds all counts of its blocks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            c = np.frombuffer(c.as_buffer(), "<i8")
            total[k] = total[k] + c if k in total else c
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["block", "counts"])


def collect_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """The sums of ``count_blocks`` rows of all tasks; what reaches the driver has the fixed size given."""
    counts = np.zeros(-(-size // _BLOCK) * _BLOCK, np.int64)
    for k, c in blocks.repartition("block").mapInArrow(_add_blocks, "block int, counts binary").collect():
        counts[k * _BLOCK : (k + 1) * _BLOCK] = np.frombuffer(c, "<i8")
    return counts[:size]
