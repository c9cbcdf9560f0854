"""Profiles: decision lists that score a posting, and the profiles that take it, best first.

A profile is configuration; each becomes one chain of conditions, so that all profiles are scored in a
single projection without a join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnmill.functions.text import strip
from tarnmill.operators.law import once

#: The threshold of a profile that isn't known.
DEFAULT_THRESHOLD = 70
BOUNDARY = r"\b"


@dataclass(frozen=True)
class Profile:
    """Patterns are regular expressions on the lower-case title; words are looked for in title, tags and description.

    ``tier1`` and ``tier2`` hold (pattern, label, score). A hit of tier 2 without any word of
    ``context`` rejects at once. A title that ``generic`` matches passes with ``generic_count`` of
    ``generic_words`` and one of ``generic_any`` (none asked if empty).
    """

    name: str
    keywords: tuple[str, ...]
    tier1: tuple[tuple[str, str, int], ...]
    tier2: tuple[tuple[str, str, int], ...]
    display: str = ""
    threshold: int = DEFAULT_THRESHOLD
    rejects: tuple[str, ...] = ()
    stacks: tuple[str, ...] = ()
    bonus: tuple[str, ...] = ()
    bonus_points: int = 5
    context: tuple[str, ...] = ()
    generic: str = ""
    generic_words: tuple[str, ...] = ()
    generic_count: int = 2
    generic_any: tuple[str, ...] = ()
    generic_score: int = 70
    generic_label: str = "Generalist fallback"

    def __post_init__(self):
        if not self.name.strip() or not self.keywords or not self.tier1 or not self.tier2:
            raise ValueError(f"profile {self.name!r} needs a name, keywords and both tiers")
        for pattern, _, score in (*self.tier1, *self.tier2):
            if not 0 <= score <= 100:
                raise ValueError(f"profile {self.name}: score {score} isn't between 0 and 100")
            _checked(self.name, pattern)
        for pattern in (*self.rejects, *self.stacks, *([self.generic] if self.generic else [])):
            _checked(self.name, pattern)

    @classmethod
    def of(cls, data: dict) -> Profile:
        """A profile from a mapping; unknown keys are a ValueError, lists become tuples."""
        known = {f.name for f in fields(cls)}
        if extra := set(data) - known:
            raise ValueError(f"unknown settings: {sorted(extra)}")
        plain = lambda v: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v
        try:
            return cls(**{k: plain(v) for k, v in data.items()})
        except TypeError as e:
            raise ValueError(f"malformed profile: {e}") from e


def _checked(name: str, pattern: str) -> None:
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"profile {name}: bad pattern {pattern!r}: {e}") from e


def _verdict(ok: bool, score: Column, label: Column) -> Column:
    return F.struct(F.lit(ok).alias("ok"), score.cast("int").alias("score"), label.alias("label"))


def _rejected(why: str) -> Column:
    return _verdict(False, F.lit(0), F.lit(f"Rejected ({why})"))


def _has(low: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (low.contains(w.lower()) for w in words), F.lit(False))


def blacklist_reason(title: Column, profile: Profile, shared: tuple[str, ...] = ()) -> Column:
    """Why a title is turned down: the first reject (shared ones first), then the first foreign stack; null if none."""
    plain = lambda p: p.replace(r"\b", "").strip()
    kinds = [("blacklisted_role", p) for p in (*shared, *profile.rejects)] + [("unrelated_stack", p) for p in profile.stacks]
    return F.coalesce(F.lit(None).cast("string"), *(F.when(F.lower(title).rlike(p), F.lit(f"{kind}: {plain(p)}")) for kind, p in kinds))


#: Fixed value: a title that names such a role isn't turned down for a stack.
ML_ROLE = r"\b(?:ai\s+engineer|ml\s+engineer|machine\s+learning)\b"


def legacy_reason(title: Column, rejects: tuple[str, ...], stacks: tuple[str, ...]) -> Column:
    """The older blacklist, which knows no profiles: as ``blacklist_reason``, but a machine-learning role in the title outweighs stacks."""
    only = lambda kind, patterns: F.coalesce(F.lit(None).cast("string"), *(F.when(F.lower(title).rlike(p), F.lit(f"{kind}: {p.replace(BOUNDARY, '').strip()}")) for p in patterns))
    return F.coalesce(only("blacklisted_role", rejects), F.when(~F.lower(title).rlike(ML_ROLE), only("unrelated_stack", stacks)))


def _words(title: Column, description: Column, tags: Column | None) -> Column:
    """Title, tags and description as one lower-case text."""
    empty = F.lit("")
    return F.concat_ws("\n", strip(F.lower(F.coalesce(title, empty))), F.lower(F.array_join(tags, " ")) if tags is not None else empty, strip(F.lower(F.coalesce(description, empty))))


def match(profile: Profile, title: Column, description: Column, tags: Column | None = None, shared: tuple[str, ...] = (), text: Column | None = None) -> Column:
    """``struct<ok, score, label>``: the first rule of the profile that decides about a posting; ``text`` are its words where they are read before."""
    empty = F.lit("")
    low = strip(F.lower(F.coalesce(title, empty)))
    if text is None:
        return once(_words(title, description, tags), lambda t: match(profile, title, description, tags, shared, t))
    rules: list[tuple[Column, Column]] = [(F.coalesce(title, empty) == "", _verdict(False, F.lit(0), F.lit("Empty title")))]
    reason = blacklist_reason(title, profile, shared)
    rules.append((reason.isNotNull(), _verdict(False, F.lit(0), F.concat(F.lit("Rejected ("), reason, F.lit(")")))))
    for pattern, label, score in profile.tier1:
        points = F.when(_has(text, profile.bonus), min(100, score + profile.bonus_points)).otherwise(score)
        rules.append((low.rlike(pattern), _verdict(True, points, F.concat(F.lit(f"{label} ("), points.cast("string"), F.lit("%)")))))
    for pattern, label, score in profile.tier2:
        fits = _has(text, profile.context) if profile.context else F.lit(True)
        rules.append((low.rlike(pattern) & ~fits, _rejected("Technical role lacking core stack context")))
        rules.append((low.rlike(pattern), _verdict(True, F.lit(score), F.lit(f"{label} ({score}%)"))))
    if profile.generic:
        votes = reduce(lambda a, b: a + b, (text.contains(w.lower()).cast("int") for w in profile.generic_words), F.lit(0))
        some = _has(text, profile.generic_any) if profile.generic_any else F.lit(True)
        rules.append((low.rlike(profile.generic) & (votes >= profile.generic_count) & some, _verdict(True, F.lit(profile.generic_score), F.lit(f"{profile.generic_label} ({profile.generic_score}%)"))))
    out = _rejected(f"Does not match {profile.display or profile.name} profile")
    for condition, verdict in reversed(rules):
        out = F.when(condition, verdict).otherwise(out)
    return out


def passing(profiles: list[Profile], title: Column, description: Column, tags: Column | None = None, shared: tuple[str, ...] = ()) -> Column:
    """``array<struct<name, score, label>>`` of the profiles that take a posting, by score; ties stay in the order given."""
    ranked = lambda k, p: lambda m: F.struct((-m["score"]).alias("key"), F.lit(k).alias("place"), F.lit(p.name).alias("name"), m["score"].alias("score"), m["label"].alias("label"), m["ok"].alias("ok"))
    every = lambda text: F.array(*(once(match(p, title, description, tags, shared, text), ranked(k, p)) for k, p in enumerate(profiles)))
    took = F.sort_array(F.filter(once(_words(title, description, tags), every), lambda x: x["ok"] & (x["score"] > 0)))
    return F.transform(took, lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score"), x["label"].alias("label")))


def meets_threshold(name: Column, score: Column, profiles: list[Profile]) -> Column:
    """Whether a score reaches its profile's threshold."""
    known = F.create_map(*(F.lit(x) for p in profiles for x in (p.name, p.threshold)))
    return score >= F.coalesce(F.try_element_at(known, name), F.lit(DEFAULT_THRESHOLD))
