"""Byte-level BPE, encoded by backtracking over longest matches and decoded by an offset table.

A sequence of tokens is what merging gives exactly if every two neighbours in it are compatible: if
merging the bytes of both leaves them as they are. So a piece of text is encoded from the left, at
each place by the longest token there that is compatible with the token before; where none is, the
token before gives way to a shorter one, and the place is never tried again. An Aho-Corasick
automaton finds the longest tokens of all places in one pass, and compatibility is looked up in a
table of pairs, which fills as pairs occur. Both take time in proportion to the bytes.
"""

from __future__ import annotations

import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches, by_size, kept, texts_of
from .tokens import CACHED_WORDS, WordEncoder

#: Fixed values of the byte-level format: the pieces of a text, and the bytes that stand for themselves in a vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
#: White space as the format's library reads it, whatever the regex module counts as such.
SPACES = r"\t-\r\x20\x85\xa0  -     　"

#: Not in any token, as those are spelled in bytes.
_BETWEEN = "Ā"
#: Pairs in the table of a worker, at most; a full one is begun anew.
PAIRS = 1 << 20
#: Ids decoded at a time.
_IDS = 1 << 18


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    others = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(others)}


def _unassigned() -> str:
    """The inside of a character class: all that this Python's Unicode doesn't assign."""
    odd = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(odd, prepend=False, append=False)).tolist()
    return "".join(rf"\U{lo:08x}-\U{hi - 1:08x}" for lo, hi in zip(edges[::2], edges[1::2], strict=True))


class Vocabulary:
    """Tokens as bytes, merges by rank, and the pair that each token is merged from."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"] or {}
        plain = not spec["normalizer"] and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or not steps.get("use_regex", True):
            raise ValueError("the file is no plain byte-level BPE tokenizer")
        byte, ids = byte_of(), model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with conditions aren't supported")
        self.tokens = [b""] * (1 + max([*ids.values(), *self.specials.values()]))
        for spelled, k in ids.items():
            self.tokens[k] = bytes(map(byte.__getitem__, spelled)) if spelled not in self.specials else spelled.encode()
        for content, k in self.specials.items():
            self.tokens[k] = content.encode()
        self.rank = [-1] * len(self.tokens)
        self.parts = [(-1, -1)] * len(self.tokens)
        self.merges: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = ids[left], ids[right], ids[left + right]
            if self.rank[made] >= 0:
                raise ValueError("a token is made by two merges")
            self.rank[made], self.parts[made], self.merges[a, b] = r, (a, b), r
        # Only what merging can make is a match; a special token's bytes are none.
        self.words = {t.decode("latin-1"): k for k, t in enumerate(self.tokens) if len(t) == 1 or self.rank[k] >= 0}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens in a row gives just these two.

        The merges of both are undone from the last one back. What then stands on either side of the border
        are the symbols that once stood there together; were they merged before either went into a larger
        one, the two tokens wouldn't have come about. Of equal ranks the left one is merged first.
        """
        rank, parts, gone_a, gone_b = self.rank, self.parts, len(self.merges), len(self.merges)
        while True:
            m = self.merges.get((a, b))
            if m is not None and m < gone_a and m <= gone_b:
                return False
            if rank[a] > rank[b]:
                gone_a, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                gone_b, b = rank[b], parts[b][0]
            else:
                return True


class Backtracking:
    """Encodes pieces of bytes (given as Latin-1 text) by longest matches and compatible pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, words = vocabulary, vocabulary.words
        self.automaton = ahocorasick.Automaton()
        for w, k in words.items():
            self.automaton.add_word(w, (len(w), k))
        self.automaton.make_automaton()
        self.size = [len(t) for t in vocabulary.tokens]
        self.shorter = [-1] * len(vocabulary.tokens)
        for w, k in words.items():
            self.shorter[k] = next((words[w[:n]] for n in range(len(w) - 1, 0, -1) if w[:n] in words), -1)
        self.pairs: dict[tuple[int, int], bool] = {}

    def _fits(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.vocabulary.compatible(a, b)
        return found

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece; the automaton reads all of them in one pass."""
        text = _BETWEEN.join(pieces)
        longest, reach = [-1] * len(text), [0] * len(text)
        for end, (n, k) in self.automaton.iter(text):
            at = end + 1 - n
            if n > reach[at]:
                longest[at], reach[at] = k, n
        out, at = [], 0
        for p in pieces:
            out.append([longest[at]] if p and reach[at] == len(p) else self._piece(longest, at, at + len(p)))
            at += len(p) + 1
        return out

    def _piece(self, longest: list[int], start: int, end: int) -> list[int]:
        ids: list[int] = []
        at, dead, shorter, size = start, set(), self.shorter, self.size
        token = longest[at] if at < end else -1
        while at < end:
            # A match can't leave the piece: no token holds what stands between two of them.
            while token >= 0 and (at + size[token] in dead or ids and not self._fits(ids[-1], token)):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += size[token]
                token = longest[at] if at < end else -1
            else:
                dead.add(at)
                token = ids.pop()
                at -= size[token]
                token = shorter[token]
        return ids


class BacktrackingEncoder(WordEncoder):
    """Whole texts by backtracking, through the cache of words; ids as the library gives them without special tokens added."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        super().__init__(path, cached_words)
        self.vocabulary = Vocabulary(path)
        self.coder = Backtracking(self.vocabulary)
        self._pieces = regex.compile(PIECES.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")).findall
        # Letters of a later Unicode: the library and the regex module may be of different ones, so the library cuts there.
        self._unsure = regex.compile(f"[{_unassigned()}]").search
        by_length = sorted(self.vocabulary.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")").split if by_length else lambda text: [text]

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        if text.isascii() or not self._unsure(text):
            return self._pieces(text)
        return [text[lo:hi] for _, (lo, hi) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _raw(self, texts: list[str]) -> list[bytes]:
        pieces: list[str] = []
        plans: list[list[tuple[int, int]]] = []  # per text: ranges of pieces, and ids of special tokens as (-1, id)
        for t in texts:
            plan = []
            for k, part in enumerate(self.special(t)):
                if k % 2:
                    plan.append((-1, self.vocabulary.specials[part]))
                elif part:
                    new = [p.encode("utf-8", "surrogatepass").decode("latin-1") for p in self.split(part)]
                    plan.append((len(pieces), len(pieces) + len(new)))
                    pieces += new
            plans.append(plan)
        distinct = list(dict.fromkeys(pieces))
        ids_of = dict(zip(distinct, self.coder.encode(distinct), strict=True))
        found = [ids_of[p] for p in pieces]
        return [np.array([k for lo, hi in plan for ids in ([[hi]] if lo < 0 else found[lo:hi]) for k in ids], self.dtype).tobytes() for plan in plans]


class Decoder:
    """All tokens' bytes in a row, and an offset for each id."""

    def __init__(self, vocabulary: Vocabulary):
        self.offsets = np.cumsum([0, *map(len, vocabulary.tokens)])
        self.bytes = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids; those that no token has give none."""
        out = []
        for lo in range(0, len(ids), _IDS):
            some = ids[lo : lo + _IDS].astype(np.int64)
            some = some[(some >= 0) & (some < len(self.offsets) - 1)]
            size = self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(size)
            out.append(self.bytes[np.repeat(self.offsets[some] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
        return b"".join(out)


def _encode(tokenizer: str, cached_words: int):
    def encode(batches):
        coder = kept("bpe", (tokenizer, cached_words), lambda: BacktrackingEncoder(tokenizer, cached_words))
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in by_size(texts):
                ids = coder.encode(texts[lo:hi])
                ends = np.cumsum([0, *(len(x) // coder.dtype.itemsize for x in ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), coder.dtype).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return encode


def _decode(tokenizer: str):
    def decode(batches):
        table = kept("bpe", ("decoder", tokenizer), lambda: Decoder(Vocabulary(tokenizer)))
        for batch in batches:
            ids = batch.column(1)
            flat = ids.values.fill_null(-1).to_numpy(zero_copy_only=False)
            ends, known = ids.offsets.to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            texts = [table.decode(flat[ends[k] : ends[k + 1]]).decode("utf-8", "replace") if known[k] else None for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return decode


def encode(docs: DataFrame, tokenizer: str, cached_words: int = CACHED_WORDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, ids array<int>``: the ids of whole texts, no special token added.

    The ids are those of the tokenizers library with ``add_special_tokens=False``: a special token's
    own string in a text is that token. ``tokenizer`` is the file of a byte-level BPE that every worker
    can read. A null or empty text has no ids; repeated rows and null doc_ids are rows of their own; an
    empty table stays empty; other columns are ignored. Nothing is shuffled. A worker keeps the ids of
    up to twice ``cached_words`` words.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode(tokenizer, cached_words), f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``rows(doc_id, ids, ...)`` -> ``doc_id, ids, decoded``: the text of the ids, special tokens as their strings.

    Ids that are null or name no token give nothing; bytes that are no UTF-8 become U+FFFD; null ids
    give a null text, no ids an empty one. Other columns are ignored.
    """
    bounded_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(_decode(tokenizer), f"doc_id {kind}, ids array<int>, decoded string")
