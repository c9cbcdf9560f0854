"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared in a normal form: case folded, runs of other characters than letters and
digits one blank. Items are matched by overlapping windows, so that a part of one counts as well: any
verbatim passage of PASSAGE characters holds a window, and so does the longer side of a replaced word
of up to GAP characters with its blanks where the item is long enough (2 * LEAST + GAP). Items of fewer than
PASSAGE characters are one window; those of fewer than Q are looked for as they stand, as whole words.
A window of length L within e edits of a passage shares at least L - q + 1 - q*e of its q-grams with
it, on diagonals that spread over e at most. Shared q-grams are counted in overlapping diagonal bands;
bands that reach the bound are verified by a banded alignment. Counting goes part by part with a fixed
number of entries, so that repetitive texts and items take no more memory than others. Texts are
scanned where they lie; only the items' q-grams are broadcast, one block of bounded size at a time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, free_others, texts_of

Q = 12
#: Edits allowed per character of a window.
EDIT_RATE = 0.04
#: The shortest verbatim part of an item that counts; windows of items that are long enough, and the shortest windows of parts.
PASSAGE, WINDOW, LEAST = 50, 40, 25
#: A replaced word and a blank.
GAP = 8
#: Characters of items in one broadcast block; a larger benchmark takes several passes over the texts.
BLOCK_CHARS = 4_000_000
#: Places of a text with a q-gram of some window in one part, pairs of such a place and a window's that are
#: counted at a time, and verified regions that are remembered for a text.
HITS, ENTRIES, TRIED = 1 << 13, 1 << 17, 1 << 16
_BITS = 22
_OTHER = re.compile(r"[\W_]+")
#: Scripts that are written without blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")
_FOUND = "doc_id long, item_id long, start long, `end` long, edits long"


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.casefold()).strip()


def normal_places(text: str) -> list[int]:
    """For each character of ``normal(text)`` the place in ``text`` that it comes from."""
    folded, places = [], []
    for i, c in enumerate(text):
        for f in c.casefold():
            folded.append(f)
            places.append(i)
    folded, out, at = "".join(folded), [], 0
    for m in _OTHER.finditer(folded):
        out += places[at : m.start()]
        if 0 < m.start() and m.end() < len(folded):
            out.append(places[m.start()])
        at = m.end()
    return out + places[at:]


def qgram_hashes(text: str) -> np.ndarray:
    """A 32-bit hash of the q-gram at each place, from hashes of half its length."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(0x9E3779B1)
    if len(h) < Q:
        return np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint32(15)
        two = h[:-1] * np.uint32(0x85EBCA77) + h[1:]
        four = two[:-2] * np.uint32(0xC2B2AE3D) + two[2:]
        eight = four[:-4] * np.uint32(0x27D4EB2F) + four[4:]
        twelve = eight[:-4] * np.uint32(0x165667B1) + four[8:]
        return twelve ^ (twelve >> np.uint32(16))


def banded_distance(pattern: str, region: str, budget: int) -> tuple[int, int, int] | None:
    """The least edits between the pattern and a part of the region, with its start and end; None beyond the budget.

    Only the diagonals that such an alignment can take are filled.
    """
    at = region.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    m, n = len(pattern), len(region)
    far = budget + 1
    row = {j: (0, j) for j in range(n + 1)}
    for i in range(1, m + 1):
        lo, hi = max(0, i - budget), min(n, n - m + i + budget)
        new: dict[int, tuple[int, int]] = {}
        for j in range(lo, hi + 1):
            best = (row[j][0] + 1, row[j][1]) if j in row else (far, j)
            if j and j - 1 in row:
                d, s = row[j - 1]
                best = min(best, (d + (pattern[i - 1] != region[j - 1]), s))
            if j - 1 in new:
                best = min(best, (new[j - 1][0] + 1, new[j - 1][1]))
            if best[0] <= budget:
                new[j] = best
        if not new:
            return None
        row = new
    d, s, j = min((d, s, j) for j, (d, s) in row.items())
    return d, s, j


def _edge(text: str, at: int) -> bool:
    """Whether a word can start or end at a place of a normal text."""
    around = text[max(0, at - 1) : at + 1]
    return at in (0, len(text)) or " " in around or bool(_UNSPACED.search(around))


def _ranges(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ..., so many of each, in a row."""
    return np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))


class Index:
    """The windows of a block of items, by q-gram; items that hold one and the same window share it."""

    def __init__(self, items: list[tuple[int, str]]):
        self.short: dict[str, list[int]] = {}
        holders: dict[str, set[int]] = {}
        for item, text in items:
            text = normal(text or "")
            if 0 < len(text) < Q:
                self.short.setdefault(text, []).append(item)
            elif text:
                wide = min(WINDOW, max(LEAST, (len(text) - GAP) // 2)) if len(text) >= PASSAGE else len(text)
                last = len(text) - wide
                for at in [*range(0, last, PASSAGE - wide + 1), last]:
                    holders.setdefault(text[at : at + wide], set()).add(item)
        self.windows = [(sorted(of, key=str), w, min(int(EDIT_RATE * len(w)), (len(w) - Q) // Q)) for w, of in holders.items()]
        grams = [qgram_hashes(w) for _, w, _ in self.windows]
        self.size = np.array([len(g) for g in grams], np.int64)
        self.gram, rank, count = np.unique(np.concatenate(grams or [np.zeros(0, np.uint32)]), return_inverse=True, return_counts=True)
        #: The ranks of a window's q-grams stand together, in order of place.
        self.rank, self.begin = rank.astype(np.int64), np.cumsum(self.size) - self.size
        self.known = np.zeros(1 << _BITS, bool)
        self.known[self.gram >> np.uint32(32 - _BITS)] = True
        self.edits = np.array([e for _, _, e in self.windows], np.int64)
        self.bound = self.size - Q * self.edits
        self.span = max((len(w) + 2 * e for _, w, e in self.windows), default=0)
        # Of the rarest size - bound + 1 of its q-grams a window shares one at least with what it matches.
        of = np.repeat(np.arange(len(grams)), self.size)
        order = np.lexsort((self.rank, count[self.rank], of))
        rare = order[np.arange(len(order)) - self.begin[of] <= (self.size - self.bound)[of]]
        rare = rare[np.argsort(self.rank[rare], kind="stable")]
        self.rare_rank, self.rare_of = self.rank[rare], of[rare]

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Per item the span that its windows cover in a normal text, and the edits of the best window."""
        found: dict[int, tuple[int, int, int]] = {}

        def add(items, d: int, x: int, y: int) -> None:
            for item in items:
                old = found.get(item, (d, x, y))
                found[item] = (min(d, old[0]), min(x, old[1]), max(y, old[2]))

        for w, (d, x, y) in self._find_windows(text).items():
            items, pattern, _ = self.windows[w]
            add(items, 0 if d and pattern in text else d, x, y)
        for wide in {len(s) for s in self.short}:
            for i in range(len(text) - wide + 1):
                if (part := text[i : i + wide]) in self.short and _edge(text, i) and _edge(text, i + wide):
                    add(self.short[part], 0, i, i + wide)
        return found

    def _find_windows(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Per window the edits of a match, the start of the first and the end of the last one.

        Shared q-grams are counted part by part: a part of the text holds every match that begins before
        its last ``span`` characters, and so many windows at a time that there are about ENTRIES to count.
        """
        h = qgram_hashes(text)
        at = np.flatnonzero(self.known[h >> np.uint32(32 - _BITS)])
        if not len(at):
            return {}
        g = np.searchsorted(self.gram, h[at])
        hit = self.gram[np.minimum(g, len(self.gram) - 1)] == h[at]
        at, g = at[hit], g[hit]
        found: dict[int, tuple[int, int, int]] = {}
        tried: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        i = 0
        while i < len(at):
            j = max(i + HITS, int(np.searchsorted(at, at[i] + 2 * self.span)))
            some = g[i:j]
            few = np.unique(some)
            first = np.searchsorted(self.rare_rank, few)
            active = np.unique(self.rare_of[_ranges(first, np.searchsorted(self.rare_rank, few, "right") - first)])
            self._count(text, at[i:j], some, active, found, tried)
            if j >= len(at):
                break
            i = max(i + 1, int(np.searchsorted(at, at[j - 1] - self.span + 1)))
        return found

    def _count(self, text: str, at, g, windows, found, tried) -> None:
        """Counts what a part of a text shares with some windows in each band, and verifies the bands that reach the bound."""
        entry = _ranges(self.begin[windows], self.size[windows])
        entry = entry[np.argsort(self.rank[entry], kind="stable")]
        first = np.searchsorted(self.rank[entry], g)
        times = np.searchsorted(self.rank[entry], g, "right") - first
        total = int(times.sum())
        if total > ENTRIES and len(windows) > 1:
            for half in np.array_split(windows, 2):
                self._count(text, at, g, half, found, tried)
            return
        if not total:
            return
        entry = entry[_ranges(first, times)]
        of = np.searchsorted(self.begin, entry, "right") - 1
        place = entry - self.begin[of]
        # Bands of 2(e+1) diagonals, one every e+1: a spread of e lies within one. Each place counts once in a band.
        band = (np.repeat(at, times) - place) // (self.edits[of] + 1)
        band, of, place = np.concatenate([band, band - 1]), np.concatenate([of, of]), np.concatenate([place, place])
        low, least, wide = int(windows[0]), int(band.min()), int(band.max() - band.min()) + 1
        key = ((of - low) * wide + (band - least)) * PASSAGE + place
        pairs, counts = np.unique(np.unique(key) // PASSAGE, return_counts=True)
        of = pairs // wide + low
        enough = counts >= self.bound[of]
        of, band = of[enough], pairs[enough] % wide + least
        for w in np.unique(of):
            self._verify(text, int(w), band[of == w].tolist(), found, tried)

    def _verify(self, text: str, w: int, bands: list[int], found, tried) -> None:
        """The first of the bands, in order, that holds the window within its edits, and the last one."""
        _, pattern, e = self.windows[w]

        def match(bands) -> tuple[int, int, int] | None:
            for b in bands:
                lo = max(0, b * (e + 1) - e)
                region = text[lo : lo + len(pattern) + 4 * (e + 1)]
                if (w, region) not in tried:
                    if len(tried) >= TRIED:
                        tried.clear()
                    tried[w, region] = banded_distance(pattern, region, e)
                if best := tried[w, region]:
                    return best[0], lo + best[1], lo + best[2]
            return None

        last = match(reversed(bands))
        if last:
            d, x, y = found[w] if w in found else match(bands)
            found[w] = (min(d, last[0]), x, max(y, last[2]))


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items dealt out by hash, so that a block has about BLOCK_CHARS characters."""
    chars = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-chars // BLOCK_CHARS)
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _scan(index):
    def scan(batches):
        free_others()
        block = index.value
        for batch in batches:
            docs, texts, rows = batch.column(0).cast(pa.int64()).to_pylist(), texts_of(batch.column(1)), []
            for doc, text in zip(docs, texts, strict=True):
                if found := block.find(normal(text)):
                    places = normal_places(text)
                    rows += [(doc, item, places[x], places[y - 1] + 1, d) for item, (d, x, y) in sorted(found.items(), key=str)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"])

    return scan


def _broadcast(block: DataFrame):
    rows = block.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct().collect()
    return block.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in rows]))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``benchmark(item_id, text, ...)`` -> ``doc_id, item_id, start, end, edits``.

    A row for each document row and item of which it holds a window: the span in the text (code
    points, end exclusive) that the item's windows cover from first to last, and the edits of the best.
    Items are told apart by id; repeated ones count once within a block. Null or empty texts hold
    nothing; items of fewer than 12 characters in normal form count where they stand as whole words. An empty table on
    either side gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts, blocks = docs.select("doc_id", "text"), _blocks(benchmark)
    if len(blocks) == 1:
        return texts.mapInArrow(_scan(_broadcast(blocks[0])), _FOUND)
    found, scratch = spark.createDataFrame([], _FOUND), Scratch(spark, "leaks")
    for k, block in enumerate(blocks):  # one index at a time
        index = _broadcast(block)
        found = found.unionByName(scratch.save(texts.mapInArrow(_scan(index), _FOUND), str(k)))
        index.destroy()
    return found


def _clean(index):
    def clean(batches):
        free_others()
        for batch in batches:
            texts = texts_of(batch.column("text"))
            yield batch.filter(pa.array([not index.value.find(normal(t)) for t in texts], pa.bool_()))

    return clean


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item; all columns, nothing is shuffled.

    A benchmark of several blocks takes a pass for each, over what the ones before it left.
    """
    blocks = _blocks(benchmark)
    bounded_batches(docs.sparkSession)
    if len(blocks) == 1:
        return docs.mapInArrow(_clean(_broadcast(blocks[0])), docs.schema)
    scratch = Scratch(docs.sparkSession, "without-leaks")
    for k, block in enumerate(blocks):
        index = _broadcast(block)
        docs = scratch.save(docs.mapInArrow(_clean(index), docs.schema), str(k))
        index.destroy()
        if k:
            scratch.drop(str(k - 1))
    return docs
