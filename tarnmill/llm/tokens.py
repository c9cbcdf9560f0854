"""Token ids of whole texts with the tokenizers library, through a bounded cache of words."""

from __future__ import annotations

import gc
import os
import sys
from array import array

import numpy as np

from .common import kept

#: Distinct words whose ids a worker keeps in each of two generations (about 180 MB each).
CACHED_WORDS = 1_000_000
#: Longer words are encoded each time.
CACHED_LENGTH = 64
#: New words that are encoded in a row.
_ROW = 1 << 14


def encoder(path: str, cached_words: int = CACHED_WORDS, plain: bool = False) -> WordEncoder:
    """The worker's encoder for a tokenizer file; its cache serves all tasks of the worker until it works for another operator."""
    return kept("tokens", (path, cached_words, plain), lambda: WordEncoder(path, cached_words, plain))


class WordEncoder:
    """Encodes texts word by word; the ids are those of encoding the whole text.

    That holds where no token spans a cut. A tokenizer that drops white space can be cut at any
    blank or line feed. A byte-level one, whose tokens may lead with a blank, is cut before a blank
    or line feed that follows another character than white space; texts in which such a cut would
    come after white space are encoded whole. The file's own pre-tokenizer tells the two apart, and
    any other kind is encoded whole. A special token's own string in a text is that token, as the
    library has it, unless ``plain``; texts that hold one are encoded whole.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain  # if so, their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [] if plain else [t["content"] for t in spec["added_tokens"]]
        steps = spec["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [steps])
        drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "[^\\s" in steps[0]["pattern"].get("Regex", "")
        byte_level = len(steps) == 1 and steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex", True) and not steps[0].get("add_prefix_space") and not spec["normalizer"]
        self.kind = "drops" if drops else "leads" if byte_level else "whole"
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        #: Per id the first byte of its token, as far as it is a blank or line feed: characters 0x120 and 0x10A of a byte-level vocabulary.
        self.first = np.zeros(1 + max(self.tokenizer.get_vocab().values()), np.uint8)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.first[k] = {"\u0120": ord(" "), "\u010a": ord("\n")}.get(token[:1], 0)
        self.cached_words = cached_words
        self.firsts: dict[str, bytes] = {}
        self.words: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = [array(self.code, e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for ids in found:
                ids.byteswap()
        return [ids.tobytes() for ids in found]

    def _learn(self, parts: list[list[str]], lead: str) -> None:
        """Adds the ids of new words; none for a word after which a cut isn't safe.

        Words come from two generations: those used since the newer one began move over to it, so that
        a full cache forgets the rare ones alone.
        """
        used = set().union(*parts)
        new = [w for w in used.difference(self.words) if len(w) <= CACHED_LENGTH]
        if len(self.words) + len(new) > self.cached_words:
            self.older, self.words = self.words, {}
            new = [w for w in used if len(w) <= CACHED_LENGTH]
        again = self.older.keys() & new
        for w in again:
            self.words[w] = self.older[w]
        new = [w for w in new if w not in again] if again else new
        if not new:
            return
        self.words.update(zip(new, self._ids(new, lead), strict=True))

    def _ids(self, words: list[str], lead: str) -> list[bytes | None]:
        """The ids of words as they stand in a text; None for one after which a cut isn't safe."""
        if self.kind != "leads":
            return self._raw([lead + w for w in words])
        safe = [w for w in words if w and not w[-1].isspace()]
        lines = [w for w in safe if w[0] == "\n"]
        found = dict(zip(lines, self._in_a_row(lines, self.first == ord("\n")), strict=True))
        others = [w for w in safe if w[0] != "\n"]
        found.update(zip(others, self._in_a_row([lead + w for w in others], self.first == ord(" ")), strict=True))
        return [found.get(w) for w in words]

    def _in_a_row(self, words: list[str], begins: np.ndarray) -> list[bytes]:
        """The ids of words that can be cut apart, encoded as one text: each word has one first token that ``begins``."""
        out: list[bytes] = []
        for k in range(0, len(words), _ROW):
            some = words[k : k + _ROW]
            ids = np.frombuffer(self._raw(["".join(some)])[0], self.dtype)
            at = np.flatnonzero(begins[ids])
            if len(at) == len(some) and at[0] == 0:
                data, cuts = ids.tobytes(), (np.append(at, len(ids)) * self.dtype.itemsize).tolist()
                out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
            else:  # not this kind of vocabulary
                out += self._raw(some)
        return out

    def _join(self, parts: list[str], lead: str) -> bytes | None:
        """The ids of words in a row; None if one of them isn't safe to cut after."""
        try:
            return b"".join(map(self.words.__getitem__, parts))
        except KeyError:  # of a long word
            ids = [self.words[w] if w in self.words else self._ids([w], lead)[0] for w in parts]
        except TypeError:
            return None
        return None if None in ids else b"".join(ids)

    def _heads(self, words: list[str]) -> list[bytes]:
        """The ids of first words, which no blank leads; few are new."""
        new = [w for w in set(words).difference(self.firsts) if len(w) <= CACHED_LENGTH]
        if len(self.firsts) + len(new) > self.cached_words // 10:
            self.firsts.clear()
            new = [w for w in set(words) if len(w) <= CACHED_LENGTH]
        self.firsts.update(zip(new, self._raw(new), strict=True))
        return [self.firsts[w] if w in self.firsts else self._raw([w])[0] for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``."""
        collecting = gc.isenabled()
        gc.disable()  # what is made here has no cycles, and is much to look through
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return self._raw(texts)
        if special := [i for i, t in enumerate(texts) if any(s in t for s in self.specials)]:
            whole = dict(zip(special, self._raw([texts[i] for i in special]), strict=True))
            out = iter(self._words([t for i, t in enumerate(texts) if i not in whole]))
            return [whole[i] if i in whole else next(out) for i in range(len(texts))]
        return self._words(texts)

    def _words(self, texts: list[str]) -> list[bytes]:
        if self.kind == "drops":
            parts = [t.replace("\n", " ").split(" ") for t in texts]
            self._learn(parts, "")
            return [self._join(p, "") for p in parts]
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        heads = [p.pop(0) for p in parts]
        self._learn(parts, " ")
        out = [head + ids if (not first or not first[-1].isspace()) and (ids := self._join(p, " ")) is not None else None for p, first, head in zip(parts, heads, self._heads(heads), strict=True)]
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self._raw([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out
