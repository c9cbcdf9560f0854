"""Sentences and clauses of a text as arrays, and what they say of a demand in sum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_DOT, _CUT = "\u0001", "\u0002"


def sentences(text: Column) -> Column:
    """The sentences of a text: they end after ``.``, ``!`` or ``?`` before white space, and at line feeds.

    The dots of U.S. and U.S.A. end none. A null text has none.
    """
    shielded = text
    for letters in ("USA", "US"):
        found = "".join(rf"({c})\." for c in letters)
        shielded = F.regexp_replace(shielded, rf"(?i)\b{found}", "".join(f"${k + 1}{_DOT}" for k in range(len(letters))))
    return F.transform(F.split(shielded, r"(?<=[.!?])\s+|\n+"), lambda s: F.replace(s, F.lit(_DOT), F.lit(".")))


def polarity(parts: Column, mention: Callable[[Column], Column], open_: Callable[[Column], Column]) -> Column:
    """What the parts that ``mention`` a demand say of it: -1 if one of them stands by it, 1 if all are ``open_``, 0 without any."""
    said = F.transform(parts, lambda p: F.when(~mention(p), 0).when(open_(p), 1).otherwise(-1))
    return F.coalesce(F.aggregate(said, F.lit(0), lambda whole, p: F.when(p == 0, whole).when(whole == 0, p).otherwise(F.least(whole, p))), F.lit(0))


def runs(sentence: Column, ends: str) -> Column:
    """All runs of neighbouring clauses of a sentence, with what stands between them; ``ends`` is what clauses end at."""
    parts = F.split(F.regexp_replace(sentence, f"({ends})", f"{_CUT}$1{_CUT}"), _CUT)
    # Clauses and what is between them take turns.
    firsts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2))
    return F.flatten(F.transform(firsts, lambda i: F.transform(F.sequence(i, F.size(parts) - 1, F.lit(2)), lambda j: F.array_join(F.slice(parts, i + 1, j - i + 1), ""))))


def run_around(sentence: Column, ends: str, core: Callable[[Column], Column], span: int, holds: Callable[[Column], Column], opens: Callable[[Column], Column]) -> Column:
    """Whether one of the ``runs`` holds, of those around a clause that is ``core`` with at most ``span`` characters between it and the outer clauses.

    For what a match of at most ``span`` characters decides, those are all that matter, and their number
    grows with the sentence, where that of all runs grows with its square. ``holds`` implies ``opens``,
    which also holds for any longer run: the widest one is asked for it first.
    """
    cut = F.split(F.regexp_replace(sentence, f"({ends})", f"{_CUT}$1{_CUT}"), _CUT)

    def over(parts: Column) -> Column:
        last = F.size(parts) - 1
        between = lambda i, j: F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        run = lambda i, j: F.array_join(F.slice(parts, i + 1, j - i + 1), "")

        def around(p: Column) -> Column:
            firsts = F.filter(F.sequence(p, F.greatest(p - 2 * span - 2, F.lit(0)), F.lit(-2)), lambda i: F.length(between(i, p)) <= span)
            lasts = F.filter(F.sequence(p, F.least(p + 2 * span + 2, last), F.lit(2)), lambda j: F.length(between(p, j)) <= span)
            within = lambda f: F.exists(f["firsts"], lambda i: F.exists(f["lasts"], lambda j: holds(run(i, j))))
            asked = lambda f: opens(run(F.array_min(f["firsts"]), F.array_max(f["lasts"]))) & within(f)
            return F.get(F.transform(F.array(F.struct(firsts.alias("firsts"), lasts.alias("lasts"))), asked), F.lit(0))

        return F.exists(F.filter(F.sequence(F.lit(0), last, F.lit(2)), lambda p: core(F.get(parts, p))), around)

    return F.get(F.transform(F.array(cut), over), F.lit(0))
