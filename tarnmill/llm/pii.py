r"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the strict matches (the base: email, ip, card, phone) and looser ones (a card or
address that fails its check, a phone number without ``+``, an address written out). Labelers vote
on each, for (1), against (-1) or not at all (0):

    form      the strict pattern
    check     Luhn sum, octets up to 255, number of digits, letters in the last part of a host
    known     gazetteers: top-level domains, issuer digits, calling codes, octets of public addresses
    cue       words before it that announce personal data of the kind, or something else
    edge      what touches it: a letter, digit or quote speaks against

Expectation-maximisation over the counted vote patterns (a table of fixed size at most) estimates
how reliable each labeler is and how likely each pattern is personal data. A logistic span
classifier is then trained on those likelihoods, with features beyond the votes, and decides on the
looser candidates; strict matches stay in any case.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone")
VOTES = ("form", "check", "known", "cue", "edge")

# Leftmost matches as with the plain patterns, but linear in the text: a match starts where a run of
# its characters does (or where the last match ended), and repeats don't give back what they took.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_AT = r"(?: ?[\(\[]at[\)\]] ?| at )"
_DOT = r"(?: ?[\(\[]dot[\)\]] ?| dot )"
_LOOSE = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}}){{1,4}}",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
# What the gazetteers and cues know.
_TLDS = "com org net edu gov int info biz io de fr es it nl uk eu ch at be pl se us ca au jp br mx"
_CALLING = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 98"
_CUES = {
    "email": "mail contact write correo adresse courriel reach",
    "ip": "ip host server client login logged from address adresse servidor",
    "card": "card visa mastercard amex payment credit karte carte tarjeta kreditkarte",
    "phone": "call phone tel telephone mobile fax telefon anruf telefono appelez llame contact",
}
_COUNTER = "version release build section isbn issn order invoice token hash sha commit page chapter ref"


def _scan(values: Column, join) -> Column:
    """The running sums (or other joins) of an array, in a logarithmic number of passes."""
    steps = lambda x: F.filter(F.array(*(F.lit(1 << k) for k in range(24))), lambda d: d < F.size(x))
    one = lambda a, d: F.transform(a, lambda v, i: F.when(i < d, v).otherwise(join(v, F.get(a, i - d))))
    return let(values, lambda x: F.aggregate(steps(x), x, one))


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    """All matches in order: ``array<struct<start, end, s>>`` in code points; what lies between them gives their places."""
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    span = lambda p, e, i: F.struct((e - F.length(F.get(p["m"], i))).alias("start"), e.alias("end"), F.get(p["m"], i).alias("s"))
    ends = lambda p: _scan(F.transform(p["m"], lambda s, i: F.length(s) + F.length(F.get(p["gap"], i))), lambda a, b: a + b)
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))
    return F.when(possible, let(cut, lambda p: F.transform(ends(p), lambda e, i: span(p, e, i)))).otherwise(none)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Whether the digits pass; those at even places from the right count twice."""
    d = F.reverse(_digits(s))
    each = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.get(F.array(*(F.lit(2 * k - 9 * (k > 4)) for k in range(10))), c.try_cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _octets(s: Column) -> Column:
    """Numbers of up to three digits without leading zeros; longer ones count as 256."""
    return F.transform(F.split(s, r"\."), lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0))), F.lit(256)))


def _one_of(words: str) -> Column:
    return F.array(*map(F.lit, words.split()))


def _sign(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(-1)


def _check(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    return {"email": F.lower(s).rlike(r"(?:\.|dot\W{0,2})[a-z]{2,}$"), "ip": ~F.exists(_octets(s), lambda o: o > 255), "card": n.between(12, 19) & _luhn(s), "phone": n.between(9, 15)}[kind]


def _known(kind: str, s: Column) -> Column:
    d = _digits(s)
    first = F.get(_octets(s), 0)
    return {
        "email": F.array_contains(_one_of(_TLDS), F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1))),
        "ip": first.between(1, 223) & (first != 127),
        "card": d.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47068]|6)"),
        "phone": F.exists(_one_of(_CALLING), lambda c: d.startswith(c)) | ~s.startswith("+"),
    }[kind]


def _words(words: str) -> str:
    return rf"(?U)\b(?:{'|'.join(words.split())})\w{{0,3}}\b"


def _voted(kind: str, text: Column, span: Column, strict: bool) -> Column:
    """A span with its votes and other features; ``base`` marks the matches that stay."""
    s, start, end = span["s"], span["start"], span["end"]
    before = F.lower(F.substring(text, F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40))))
    left, right = F.substring(before, -1, 1), F.substring(text, end + 1, F.lit(1))
    check = _check(kind, s)
    touched = F.coalesce(F.concat(F.when(start > 0, left).otherwise(""), right), F.lit("")).rlike(r"""(?U)["'=_\w]""")
    cue = F.when(before.rlike(_words(_CUES[kind])), 1).when(before.rlike(_words(_COUNTER)), -1).otherwise(0)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), (check if strict and kind != "email" else F.lit(strict)).alias("base"),
        F.lit(int(strict)).alias("form"), _sign(check).alias("check"), _sign(_known(kind, s)).alias("known"), cue.alias("cue"), _sign(~touched).alias("edge"),
        F.least(F.length(s).bitwiseAND(-8), F.lit(32)).alias("size"),
    )


def candidates(text: Column) -> Column:
    """All candidate spans of a text (null: empty) with their votes."""
    text = F.coalesce(text, F.lit(""))
    digit = text.rlike("[0-9]")
    found = [
        _as_votes("email", text, _matches(text, _EMAIL, text.contains("@")), True),
        _as_votes("ip", text, _matches(text, _IP, digit & text.rlike(r"[0-9]\.[0-9]")), True),
        _as_votes("card", text, _matches(text, _CARD, digit & text.rlike(_CARD)), True),
        _as_votes("phone", text, _matches(text, _PHONE, text.contains("+")), True),
        _as_votes("email", text, _matches(text, _LOOSE["email"], text.rlike(r"(?i)(?:[\(\[ ])dot[\)\] ]")), False),
        _as_votes("phone", text, _matches(text, _LOOSE["phone"], digit & text.rlike(_LOOSE["phone"])), False),
    ]
    return F.concat(*found)


def _as_votes(kind: str, text: Column, spans: Column, strict: bool) -> Column:
    return F.transform(spans, lambda s: _voted(kind, text, s, strict))


@dataclass
class SpanModel:
    """Weights of the span classifier by feature name, and each labeler's estimated reliability by kind."""

    weights: dict[str, float]
    reliability: dict[str, dict[str, float]]

    def score(self, span: Column) -> Column:
        terms = [F.lit(self.weights["bias"])]
        terms += [F.when(span["kind"] == k, F.lit(self.weights[f"kind={k}"])).otherwise(0.0) for k in range(len(KINDS))]
        terms += [F.when(span[v] == x, F.lit(self.weights[f"{v}={x}"])).otherwise(0.0) for v in VOTES for x in (-1, 1)]
        terms += [F.when(span["size"] == x, F.lit(self.weights[f"size={x}"])).otherwise(0.0) for x in range(0, 33, 8)]
        return 1.0 / (1.0 + F.exp(-reduce(lambda a, b: a + b, terms)))


def _reliabilities(votes: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns: how likely each is personal data, and P(vote | class) per labeler.

    Begins with labelers that are right four times in five; counts are smoothed by that belief.
    """
    prior = np.array([[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]])  # class x vote (-1, 0, 1)
    p, share = np.tile(prior, (votes.shape[1], 1, 1)), 0.5
    for _ in range(rounds):
        log = np.stack([np.log(p[np.arange(votes.shape[1]), c, votes + 1]).sum(1) for c in (0, 1)]) + np.log([[1 - share], [share]])
        post = 1 / (1 + np.exp(log[0] - log[1]))
        weight = np.stack([count * (1 - post), count * post])
        for j in range(votes.shape[1]):
            for c in (0, 1):
                got = np.bincount(votes[:, j] + 1, weights=weight[c], minlength=3) + 10 * prior[c]
                p[j, c] = got / got.sum()
        share = (weight[1].sum() + 2) / (count.sum() + 4)
    return post, p


def _features(rows) -> tuple[list[str], np.ndarray]:
    names = ["bias", *(f"kind={k}" for k in range(len(KINDS))), *(f"{v}={x}" for v in VOTES for x in (-1, 1)), *(f"size={x}" for x in range(0, 33, 8))]
    at = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for n in ("bias", f"kind={r.kind}", *(f"{v}={r[v]}" for v in VOTES), f"size={r['size']}"):
            if n in at:
                x[i, at[n]] = 1
    return names, x


def fit(spans: DataFrame) -> SpanModel:
    """Fits on ``spans`` (an array of candidates per row): every candidate of the corpus counts.

    What comes to the driver is the number of each pattern: kinds x 3**5 votes x 5 sizes at most.
    """
    keys = ["kind", *VOTES, "size"]
    rows = spans.select(F.explode("spans").alias("s")).select("s.*").groupBy(*keys).count().orderBy(*keys).collect()
    names, x = _features(rows)
    count = np.array([r["count"] for r in rows], float)
    votes = np.array([[r[v] for v in VOTES] for r in rows], int).reshape(len(rows), len(VOTES))
    kinds = np.array([r.kind for r in rows], int)
    target, reliability = np.zeros(len(rows)), {}
    for k in sorted(set(kinds)):
        mine = kinds == k
        target[mine], p = _reliabilities(votes[mine], count[mine])
        reliability[KINDS[k]] = {v: float((p[j, 1, 2] + p[j, 0, 0]) / 2) for j, v in enumerate(VOTES)}
    w = np.zeros(len(names))
    share = count / max(count.sum(), 1)
    for _ in range(25):  # Newton's method for the logistic loss on soft targets, with a small ridge
        q = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (share * (q - target)) + 1e-4 * w
        hess = x.T @ (x * (share * q * (1 - q))[:, None]) + 1e-4 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return SpanModel(dict(zip(names, map(float, w), strict=True)), reliability)


def decide(spans: Column, model: SpanModel, threshold: float = 0.5) -> Column:
    """The base spans, and the looser candidates that the classifier takes and that touch no base span; by start, then kind."""
    plain = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["kind"], s["end"], s["base"]))
    touches = lambda s, base: F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = lambda spans, base: F.filter(spans, lambda s: ~s["base"] & (model.score(s) >= threshold) & ~touches(s, base))
    both = lambda spans: let(F.filter(spans, lambda s: s["base"]), lambda base: F.sort_array(F.concat(plain(base), plain(more(spans, base)))))
    return let(spans, both)


def find_pii(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with ``pii``: ``array<struct<start, kind, end, base>>``, code points, end exclusive, ``kind`` an index into KINDS.

    Without a model one is fitted on all of ``docs`` first. A null or empty text has no spans; repeated
    rows and null ids are as any other; a table without candidates fits a model that is never asked. A
    column ``pii`` of the input is replaced; all others stay.
    """
    model = model or fit(docs.select(candidates(F.col("text")).alias("spans")))
    return docs.withColumn("pii", decide(candidates(F.col("text")), model))


def span_list(pii: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(pii, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, pii: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts whole, the rest is cut."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    done = lambda reach, i: F.coalesce(F.get(reach, i - 1), F.lit(0))
    part = lambda reach, s, i: F.concat(
        F.substring(text, done(reach, i) + 1, F.greatest(s["start"] - done(reach, i), F.lit(0))),
        F.when(s["end"] > done(reach, i), F.get(kinds, s["kind"])).otherwise(""),
    )
    tail = lambda reach: F.substring(text, F.element_at(reach, -1) + 1, F.length(text))
    whole = lambda reach: F.concat(F.array_join(F.transform(pii, lambda s, i: part(reach, s, i)), ""), tail(reach))
    return F.when(F.size(pii) > 0, let(_scan(F.transform(pii, lambda s: s["end"]), F.greatest), whole)).otherwise(text)
