"""Alignment of two tokenizers' tokens over the same bytes.

The byte offsets at which tokens of both end cut a document into groups. Both tokenizers end a token
before a blank or line feed that follows another character than white space, so groups never reach over
such a place: words are aligned, each once as long as a worker keeps it, and a document is its words'
groups in a row. New words are aligned by the batch, by the offsets of all their tokens in a row. Where
tokens of both end together, they are linked; links are counted over the corpus by Spark, as pairs of
ids that are added up in each task before any shuffle.

``tokens`` and ``groups`` give the same as columns: ids and offsets of whole documents, and the groups of
any two lists of offsets. There a list merged with the common offsets by a sort holds each of these twice
in a row, so the place of the j-th pair, less j, is the place of that offset in the list: no lookup by
value is needed. ``align`` with them took 2399 CPU seconds a GB where it takes 834 now.
"""

from __future__ import annotations

import gc
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary
from .common import Scratch, by_size, kept, texts_of
from .tokens import CACHED_LENGTH, WordEncoder

#: Pairs of ids that are broadcast at most (a long, a long and a flag each); more are joined by a shuffle.
PAIRS_BROADCAST = 1_000_000
#: Distinct words whose ids a worker keeps, of each tokenizer.
CACHED_WORDS = 300_000
_MARK = "▁"


class PieceEncoder:
    """Whole texts by a sentencepiece model, through a cache of words.

    A text can be cut before every run of blanks that follows something else, as long as no piece of the
    model holds a blank after another character; a model that has one encodes texts whole.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        as_byte = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" and p[5] == ">" else p.replace(_MARK, " ").encode()
        self.tokens = [as_byte(p) for p in pieces]
        self.cuts = not any(_MARK in p.lstrip(_MARK) for p in pieces) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")
        #: Whether a line feed is a token by itself, so that a text can be cut before one as well.
        self.lines = self.cuts and not any("\n" in p for p in pieces) and self.model.encode("a\nb") == self.model.encode("a") + self.model.encode("\nb")[1:]
        self.cached_words = cached_words
        self.words: dict[str, bytes | None] = {}

    def _raw(self, texts: list[str]) -> list[bytes | None]:
        found = self.model.encode(texts, num_threads=1) if texts else []
        same = lambda t, ids: b"".join(map(self.tokens.__getitem__, ids)) == (" " + t).encode("utf-8", "surrogatepass")
        return [array("i", ids).tobytes() if same(t, ids) else None for t, ids in zip(texts, found, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text as native 32-bit integers; None if the pieces' bytes aren't the text with a blank before it."""
        words = [t.split(" ") if self.cuts else [""] for t in texts]
        words = [None if "" in w else w for w in words]  # blanks in a row, or at an end
        new = [w for w in set().union(*(w for w in words if w)).difference(self.words) if len(w) <= CACHED_LENGTH]
        if len(self.words) + len(new) > self.cached_words:
            self.words = {}
            new = [w for w in set().union(*(w for w in words if w)) if len(w) <= CACHED_LENGTH]
        self.words.update(zip(new, self._raw(new), strict=True))
        whole = iter(self._raw([t for t, w in zip(texts, words, strict=True) if w is None]))
        return [next(whole) if w is None else self._join(w) for w in words]

    def _join(self, words: list[str]) -> bytes | None:
        try:
            return b"".join(map(self.words.__getitem__, words))
        except (KeyError, TypeError):  # a long word, or one whose bytes differ
            ids = [self.words[w] if w in self.words else self._raw([w])[0] for w in words]
            return None if None in ids else b"".join(ids)


def _ends(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.cumsum(size[ids], dtype=np.int64).astype(np.int32)


#: Tokens of A and of B, groups as text, and a link for each group (a in the upper half of a long, b in the lower).
_Aligned = tuple[int, int, bytes, bytes]
_NONE: _Aligned = (0, 0, b"", b"")


class _Pair:
    def __init__(self, byte_path: str, piece_path: str, cached_words: int = CACHED_WORDS):
        self.a, self.b = WordEncoder(byte_path, CACHED_WORDS, plain=True), PieceEncoder(piece_path)
        # The bytes of A's tokens are always the text's: Vocabulary refuses files that change them.
        self.sizes = [np.array([len(t) for t in tokens], np.int64) for tokens in (Vocabulary(byte_path).tokens, self.b.tokens)]
        most = max(map(len, self.sizes))
        #: The decimal digits of each id, and a place for the mark behind them; zeros are left out.
        self.digits = np.zeros((most, len(str(most)) + 1), np.uint8)
        for k in range(most):
            self.digits[k, : len(str(k))] = np.frombuffer(str(k).encode(), np.uint8)
        self.cached_words = cached_words
        self.words: dict[str, _Aligned | bool | None] = {}
        self.older: dict[str, _Aligned | bool | None] = {}

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both tokenizers for each text with a blank before it; none where either's bytes differ from that."""
        none = np.zeros(0, np.int32)
        pairs = zip(texts, self.a.encode([" " + t for t in texts]), self.b.encode(texts), strict=True)
        return [(np.frombuffer(a, self.a.dtype).astype(np.int32), np.frombuffer(b, np.int32)) if t and b is not None else (none, none) for t, a, b in pairs]

    def _align(self, a: list[bytes], b: list[bytes]) -> list[_Aligned]:
        """The groups of texts by their ids, all in one pass: offsets count on from text to text, and texts end at common ones."""
        if not a:
            return []
        ids = [np.frombuffer(b"".join(a), self.a.dtype).astype(np.int64), np.frombuffer(b"".join(b), np.int32).astype(np.int64)]
        ends = [np.cumsum(size[i]) for i, size in zip(ids, self.sizes, strict=True)]
        common = np.intersect1d(*ends, assume_unique=True)
        cuts = [np.searchsorted(e, common) for e in ends]
        links = (ids[0][cuts[0]] << 32) + ids[1][cuts[1]]
        # Of each group first A's tokens, then B's: a token comes after its own side's earlier ones and the other side's of earlier groups.
        before = [np.concatenate([[0], c + 1]) for c in cuts]
        place = [np.arange(len(e)) + np.repeat(other, np.diff(own)) for e, own, other in zip(ends, before, (before[1][:-1], before[0][1:]), strict=True)]
        order, mark = np.empty(len(ends[0]) + len(ends[1]), np.int64), np.full(len(ends[0]) + len(ends[1]), ord(","), np.uint8)
        for i, p, c, last in zip(ids, place, cuts, b"|;", strict=True):
            order[p] = i
            mark[p[c]] = last
        written = self.digits[order]
        written[:, -1] = mark
        to = np.concatenate([[0], np.cumsum(np.count_nonzero(written, axis=1))])  # where each token's digits begin
        text, links = written[written > 0].tobytes(), links.tobytes()
        last = [np.concatenate([[0], np.cumsum([len(x) // size for x in side])]) for side, size in ((a, self.a.dtype.itemsize), (b, 4))]
        group, at = np.searchsorted(cuts[0], last[0]) * 8, to[last[0] + last[1]]
        sizes = zip(*(np.diff(x).tolist() for x in last), strict=True)
        return [(m, n, text[lo : hi - 1], links[g:h]) for (m, n), lo, hi, g, h in zip(sizes, at[:-1].tolist(), at[1:].tolist(), group[:-1].tolist(), group[1:].tolist(), strict=True)]

    def _new(self, words: list[str]) -> dict[str, _Aligned | bool | None]:
        """New words as they stand in a text, behind a blank or beginning with a line feed; None for one that can't be cut off, False for one whose bytes differ."""
        found: dict[str, _Aligned | bool | None] = dict.fromkeys(words)
        safe = [w for w in words if w and (self.b.lines or "\n" not in w)]
        a = dict(zip(safe, self.a._ids(safe, " "), strict=True))
        safe = [w for w in safe if a[w] is not None]
        b = dict(zip(safe, self.b._raw(safe), strict=True))
        blank = array("i", [self.b.model.piece_to_id(_MARK)]).tobytes()
        for w in safe:
            if b[w] is None:
                found[w] = False
            elif w[0] == "\n":
                b[w] = b[w][4:] if b[w].startswith(blank) else None
        safe = [w for w in safe if b[w] is not None]
        found.update(zip(safe, self._align([a[w] for w in safe], [b[w] for w in safe]), strict=True))
        return found

    def _learn(self, parts: list[list[str]]) -> None:
        """Adds new words; those used since the newer of two generations began move over to it, so that a full cache forgets the rare ones alone."""
        used = set().union(*parts)
        new = used.difference(self.words)
        if len(self.words) + len(new) > self.cached_words:
            self.older, self.words, new = self.words, {}, used
        again = self.older.keys() & new
        self.words.update((w, self.older[w]) for w in again)
        self.words.update(self._new(list(new - again)))

    def align(self, texts: list[str]) -> list[_Aligned]:
        """Each text with a blank before it, aligned; ``_NONE`` for empty texts and where either tokenizer's bytes differ from the text's."""
        collecting = gc.isenabled()
        gc.disable()  # what is made here has no cycles, and is much to look through
        try:
            parts = [t.replace("\n", " \n").split(" ") if self.b.cuts else [""] for t in texts]
            self._learn(parts)
            out, whole = [], []
            for i, p in enumerate(parts):
                found = list(map(self.words.__getitem__, p))
                try:
                    m, n, groups, links = zip(*found, strict=True)
                    out.append((sum(m), sum(n), b";".join(groups), b"".join(links)))
                except TypeError:
                    out.append(_NONE)
                    if None in found and texts[i]:
                        whole.append(i)
            for w in [w for w in self.words.keys() & {w for p in parts for w in p if len(w) > CACHED_LENGTH}]:
                del self.words[w]
            b = dict(zip(whole, self.b._raw([texts[i] for i in whole]), strict=True))
            whole = [i for i in whole if b[i] is not None]
            for i, found in zip(whole, self._align(self.a._raw([" " + texts[i] for i in whole]), [b[i] for i in whole]), strict=True):
                out[i] = found
            return out
        finally:
            if collecting:
                gc.enable()


def _tokenize(byte_path: str, piece_path: str):
    def tokenize(batches):
        pair = kept("alignment", (byte_path, piece_path), lambda: _Pair(byte_path, piece_path))
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in by_size(texts):
                found, columns = pair.encode(texts[lo:hi]), [batch.column(0)[lo:hi]]
                for side in range(2):
                    ids = [f[side] for f in found]
                    offsets = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([_ends(i, pair.sizes[side]) for i in ids]))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "a_ends", "b_ids", "b_ends"])

    return tokenize


def tokens(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, a_ids, a_ends, b_ids, b_ends``, the tokens of whole documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"
    return docs.select("doc_id", "text").mapInArrow(_tokenize(byte_path, piece_path), schema)


def _at(name: str, k: Column) -> Column:
    return F.get(F.col(name), k)


def _cut_places(rows: DataFrame, ends: str, name: str) -> DataFrame:
    """Adds the places (from 0) in the list ``ends`` of the offsets in ``common``."""
    rows = rows.withColumn("_merged", F.sort_array(F.concat(ends, "common")))
    places = F.filter(F.sequence(F.lit(1), F.size("_merged") - 1), lambda p: _at("_merged", p) == _at("_merged", p - 1))
    places = F.when(F.size("_merged") > 1, places).otherwise(F.array().cast("array<int>"))
    return rows.withColumn(name, F.transform(places, lambda p, j: p - j - 1)).drop("_merged")


def groups(rows: DataFrame) -> DataFrame:
    """Adds ``a_cuts`` and ``b_cuts``, the places of each group's last tokens, and ``groups``, an array of ``a1,a2|b1`` strings."""
    rows = rows.withColumn("common", F.array_intersect("a_ends", "b_ends"))
    rows = _cut_places(_cut_places(rows, "a_ends", "a_cuts"), "b_ends", "b_cuts")

    for side in "ab":
        rows = rows.withColumn(f"{side}_str", F.col(f"{side}_ids").cast("array<string>"))
    before = lambda cuts: F.slice(F.concat(F.array(F.lit(-1)), F.col(cuts)), 1, F.size(cuts))
    ranges = F.arrays_zip(*(x for side in "ab" for x in (before(f"{side}_cuts").alias(f"{side}0"), F.col(f"{side}_cuts").alias(f"{side}1"))))

    def ids_of(side: str, g: Column) -> Column:
        """The ids of a group, most often of one token."""
        last, cut = g[f"{side}0"], g[f"{side}1"]
        return F.when(cut - last == 1, _at(f"{side}_str", cut)).otherwise(F.array_join(F.slice(F.col(f"{side}_str"), last + 2, cut - last), ","))

    rows = rows.withColumn("groups", F.transform(ranges, lambda g: F.concat(ids_of("a", g), F.lit("|"), ids_of("b", g))))
    return rows.drop("a_str", "b_str")


def _aligned(byte_path: str, piece_path: str):
    def aligned(batches):
        pair = kept("alignment", (byte_path, piece_path), lambda: _Pair(byte_path, piece_path))
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in by_size(texts):
                n_a, n_b, groups, links = zip(*pair.align(texts[lo:hi]), strict=True)
                offsets = pa.array(np.cumsum([0, *(len(x) // 8 for x in links)]).astype(np.int32))
                links = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(links), np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.binary()).cast(pa.string()), links], names=["doc_id", "n_a", "n_b", "groups", "links"])

    return aligned


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_a, n_b, groups, links``: groups as ``a1,a2|b1;a3|b2,b3``, and the last tokens of each group, a in the upper half of a long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_aligned(byte_path, piece_path), f"doc_id {kind}, n_a long, n_b long, groups string, links array<long>")


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per document: how its tokens of two tokenizers hang together.

    A: the byte-level BPE tokens of the text with a blank before it; B: the sentencepiece tokens, whose
    model adds that blank. Special tokens' strings are plain text. Columns: ``doc_id``, ``n_a``, ``n_b``,
    ``n_groups`` (stretches between offsets at which both end a token), ``n_links`` (pairs of tokens that
    end together; tokens have bytes, so that is one a group), ``n_best`` (links whose pair of ids is one
    of the commonest of its B id in the corpus), ``count_sum`` (those counts over all links) and
    ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``).

    Null and empty texts, and texts whose tokens' bytes differ from theirs, have no tokens: zeros, and
    '' for the digest. Repeated rows and null doc_ids are documents of their own; an empty table gives
    no rows; other columns are ignored. Texts are tokenised once; what is kept in the shared folder are
    the links. The files of both tokenizers are ones that every worker can read.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    digest = F.when(F.size("links") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = aligned(docs, byte_path, piece_path)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", F.size("links").cast("long").alias("n_groups"), digest, "links")
    rows = scratch.save(rows, "rows")
    pair = F.explode("links").alias("pair")
    counted = scratch.save(rows.select(pair).groupBy("pair").agg(F.count("*").alias("n")), "counted")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    pairs = counted.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    pairs = scratch.save(pairs, "pairs")
    linked = rows.select("row", pair)
    if pairs.count() <= PAIRS_BROADCAST:
        linked = linked.join(F.broadcast(pairs), "pair").withColumn("k", F.lit(1))
    else:  # a document's equal links as one row; Spark splits a pair that many documents have
        linked = linked.groupBy("row", "pair").agg(F.count("*").alias("k")).join(pairs, "pair")
    sums = linked.groupBy("row").agg(F.sum("k").alias("n_links"), F.sum(F.col("best") * F.col("k")).alias("n_best"), F.sum(F.col("n") * F.col("k")).alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", none("n_links"), none("n_best"), none("count_sum"), "groups_sha256")
