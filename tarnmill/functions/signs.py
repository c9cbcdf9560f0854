"""Words that a rule hangs on: the patterns of a rule are only matched where one of its words stands in the text.

A pattern whose word stands between word boundaries, white space or marks holds that word as a whole run of
``a-z``, ``0-9`` and ``_``, so a text without the run can't match it. Where a word may be glued to others,
the text is asked for it as a substring instead.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each letter by itself: Java looks up a class of single ones, and asks one of ranges range by range.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_"
_RUN = f"[{_LETTERS}]+"


def runs_of(terms) -> tuple[str, ...]:
    """The longest run of each term: it stands in any text that names the term as a whole word. A term in another script has none."""
    return tuple(dict.fromkeys(max(found, key=len) for t in terms if (found := re.findall(_RUN, t))))


def signs(low: Column, vocabulary) -> Column:
    """The words of the vocabulary that are runs of a lower-case text, each once."""
    return F.array_distinct(F.filter(F.split(low, f"[^{_LETTERS}]+"), lambda w: w.isin(*dict.fromkeys(vocabulary))))


def shown(found: Column, words) -> Column:
    """Whether one of the words is among the signs."""
    return F.arrays_overlap(found, F.split(F.lit(" ".join(words)), " "))


def may_name(found: Column, terms) -> Column:
    """Whether one of the terms may stand in the text as a whole word, by its run; true where a term has none."""
    return shown(found, runs_of(terms)) if all(re.search(_RUN, t) for t in terms) else F.lit(True)


def holds(low: Column, phrases) -> Column:
    """Whether one of the phrases stands anywhere in a text, also within a word."""
    return reduce(lambda a, b: a | b, (low.contains(p) for p in phrases))


def holds_rooted(low: Column, phrases, roots) -> Column:
    """``holds``, where one of the few roots is part of every phrase and asked for first."""
    if not all(any(r in p for r in roots) for p in phrases):
        raise ValueError("a phrase has none of the roots")
    return holds(low, roots) & holds(low, phrases)
