"""Demands to live in a place: their polarity by sentence and clause, US pins, titles, descriptions, and eligibility from anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnmill.functions import pins
from tarnmill.functions.clauses import polarity, run_around, sentences
from tarnmill.functions.places import ASIA_PACIFIC, HYBRID_TECHNOLOGY, MIDDLE_EAST, RESTRICTED
from tarnmill.functions.signs import holds_rooted, may_name, runs_of, shown
from tarnmill.operators.law import (
    LIVES_SIGNS, US_POSTAL, US_SIGNS, US_STATES, _any, _has_any, _low, asks_language, hybrid_work, is_foreign, is_hybrid, is_open, once, read, words,
)

#: Places that make a label name more than the US.
ELSEWHERE = tuple(dict.fromkeys(RESTRICTED + ASIA_PACIFIC + MIDDLE_EAST))
#: Places that a role may not ask to live in.
ABROAD = tuple(sorted({*RESTRICTED, *pins.MORE_ABROAD}, key=len, reverse=True))
OFFICE = ("onsite", "on-site", "in-office", "office only")
HOME = ("pakistan", "karachi", "lahore", "islamabad", "rawalpindi", "faisalabad", "peshawar")

_COUNTRY = r"(?i)\b(?:usa|united states(?:\s+of\s+america)?|u\.s\.a)\b"
_PERSONS = r"\b(?:US|USA|U\.S(?:\.A)?\.)(?:\s*(?i:persons?|personnel)|\s+(?i:business\s+hours?))\b"
_BACK = "(?i)" + "|".join(pins.US_TAKEN_BACK)
_OREGON = r"\bremote\s*,?\s*(?:or|oregon)\b|\bcoos\s+county\b|\bremote\b.*\b97458\b"


#: What the rules here hang on, besides the words of the places and languages.
SIGNS = ("remote", "only", "coos", *(w for _, groups, _ in pins.PINS for group in groups if group != "abroad" for w in group), *runs_of((*pins.METROS, *ABROAD, *ELSEWHERE, *pins.CONTRACTS)))
#: Parts that every label of ``pins.MARKERS``, and every word of a local residency, has one of.
MARKER_ROOTS = ("remote", "worldwide", "anywhere", "b2b", "freelance", "contractor", "c2c")
LOCAL_ROOTS = ("wohn", "ansässig", "leben", "aufenthaltserlaubnis", "résid", "france")
#: Characters of a demand of local residency at most, with at most 61 of white space at a time.
LOCAL_SPAN = 400


def usa_polarity(text: Column) -> Column:
    """-1: a sentence that names the US stands by it; 1: every such sentence takes it back; 0: none names it."""
    return once(read(text), of_usa)


def of_usa(t: Column) -> Column:
    """``usa_polarity`` of a text that is read."""
    closed = lambda s: s.rlike(rf"(?i)\bonly\b|{pins.HARD}")
    return F.when(shown(t["signs"], ("usa", "united", "u")), polarity(sentences(t["text"]), lambda s: s.rlike(_COUNTRY), lambda s: s.rlike(_BACK) & ~closed(s))).otherwise(0)


def us_persons_polarity(text: Column) -> Column:
    """The same for US persons, personnel and business hours; US must stand in capitals, as "us" is a pronoun.

    A sentence that takes the demand back can still make another one: what remains without the words
    that take back may ask for US persons only, or hold a demand of its own.
    """

    def open_(s: Column) -> Column:
        us = r"(?:us|usa|u\.s(?:\.a)?\.?)"
        left = F.regexp_replace(s, _BACK, " ")
        alone = left.rlike(rf"(?i)\b{us}\s+persons?\s+only\b|\bonly\s+{us}\s+persons?\b") & ~left.rlike(r"(?i)\bnot\s+only\b")
        return s.rlike(_BACK) & ~alone & ~left.rlike(f"(?i){pins.HARD}")

    # Only sentences that name the US in capitals are looked at.
    capitals = ("US", "U.S")
    said = lambda t: polarity(F.filter(sentences(t), lambda s: _has_any(s, capitals)), lambda s: s.rlike(_PERSONS), open_)
    return once(F.coalesce(text, F.lit("")), lambda t: F.when(_has_any(t, capitals), said(t)).otherwise(0))


def _local(patterns) -> str:
    return "(?U)" + "|".join(p.format(de=_any(pins.GERMAN_PLACES), gap=r"[^.!?\n]") for p in patterns)


def local_residency(text: Column) -> Column:
    """A German or French demand of residency that no clause it touches takes back.

    Line feeds are layout here. The seat of a client or of the company itself is no demand. A demand is
    judged by the least run of clauses that holds it: if some run holds one and nothing that takes it
    back, so does the least run within it, so that any run will do.
    """
    return in_local_residency(_low(text))


def in_local_residency(low: Column) -> Column:
    """``local_residency`` of a lower-case text. Only the sentences that hold a word of a demand are laid out and matched."""
    pin, back = _local(pins.LOCAL_PINS), _local(pins.LOCAL_TAKEN_BACK)

    def demands(sentence: Column) -> Column:
        flat = F.regexp_replace(sentence, r"[ \t]*[\r\n]+[ \t]*", " ")
        flat = F.regexp_replace(flat, rf"(?U)({pins.CLIENTS}[^.!?\n]{{0,25}}\s*)bas[eé]e?s?\s+en\s+france\b", "$1")
        flat = F.regexp_replace(flat, r"(?U)\s{62,}", " " * 61)  # more than any gap in a demand
        rooted = lambda c: _has_any(c, LOCAL_ROOTS)
        return once(flat, lambda s: s.rlike(pin) & run_around(s, f"(?U){pins.CLAUSE_ENDS}", rooted, LOCAL_SPAN, lambda r: r.rlike(pin) & ~r.rlike(back), lambda r: r.rlike(pin)))

    found = lambda t: F.exists(F.filter(F.split(t, "[.!?]"), lambda s: _has_any(s, LOCAL_ROOTS)), demands)
    return once(low, lambda t: _has_any(t, LOCAL_ROOTS) & found(t))


def description_restricted(text: Column) -> Column:
    """A description that shuts out whoever works from home abroad: by language, office, residency, permit or time zone. Null: no."""
    return once(read(text), lambda t: shuts_out(t))


def shuts_out(t: Column, language: Column | None = None, hybrid: Column | None = None) -> Column:
    """``description_restricted`` of a text that is read; what is known of its language and office may be given."""
    text, low = t["text"], t["low"]
    places = {"authority": _any(pins.AUTHORITIES), "residence": _any(pins.RESIDENCES), "israel": _any(pins.ISRAEL), "abroad": _any(ABROAD)}
    filled = lambda p: reduce(lambda s, kv: s.replace(f"{{{kv[0]}}}", kv[1]), places.items(), p)
    anchors: dict[tuple, list[str]] = {}
    for part, needed, pin in pins.PINS:
        anchors.setdefault((part, needed), []).append(filled(pin))
    asked = lambda part, needed: reduce(lambda a, b: a & b, [shown(t["signs"], runs_of(ABROAD) if group == "abroad" else group) for group in needed] + [low.contains(part)] * bool(part))
    found = [asked(*key) & low.rlike("(?U)" + "|".join(p)) for key, p in anchors.items()]
    us_only = _has_any(text, ("US", "U.S")) & text.rlike(r"\b(?:US|USA|U\.S\.)\s*[-–]?\s*(?i:only)\b")
    tests = [asks_language(t) if language is None else language, is_hybrid(t) if hybrid is None else hybrid, us_only, *found, us_persons_polarity(text) < 0, in_local_residency(low)]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def read_description(text: Column) -> Column:
    """What the rules read of a description: ``struct<read, language, hybrid, strong, restricted>``, each rule asked once."""
    asked = lambda t: F.struct(t.alias("read"), asks_language(t).alias("language"), is_hybrid(t).alias("hybrid"), is_open(t["low"]).alias("strong"))
    whole = lambda f: F.struct(*(f[k].alias(k) for k in ("read", "language", "hybrid", "strong")), shuts_out(f["read"], f["language"], f["hybrid"]).alias("restricted"))
    return once(once(read(text), asked), whole)


def read_title(title: Column) -> Column:
    """What the rules read of a title: ``struct<read, restricted>``."""
    return once(read(title), lambda t: F.struct(t.alias("read"), title_restricted(title).alias("restricted")))


def title_restricted(title: Column) -> Column:
    """A title that shuts out whoever works from home abroad, or that is no engineer's. Null: no."""
    return once(read(title), lambda whole: once(F.replace(whole["low"], F.lit("_"), F.lit(" ")), lambda t: _title_shuts(whole, t)))


def _title_shuts(whole: Column, t: Column) -> Column:
    nation, short = _any(pins.TITLE_NATIONS), "(?:us|usa|uk|canada|europe|germany|poland|latam|israel)"
    within = lambda x: rf"\[(?:[^\]]*\b)?{x}(?:\b[^\]]*)?\]|\((?:[^)]*\b)?{x}(?:\b[^)]*)?\)"
    signs = [
        rf"\b{nation}\s*[-–]?\s*only\b", rf"\bonly\s+in\s+(?:the\s+)?{nation}\b", rf"\b(?:{nation}|eu|european|emirates)\s+candidates?\s+only\b",
        r"\b(?:us|usa|u\.s\.|uk|canada|eu|european|israel)\s+based\b", rf"\b(?:must\s+reside\s+in|residen(?:ce|cy)\s+in)\s+(?:the\s+)?{nation}\b",
        r"\bresiden(?:ce|cy)\s+(?:is\s+)?(?:required|mandatory)\b", within(f"{short}[- ]only"), within(_any(pins.TITLE_HUBS)),
        r"\b(?:on-site|onsite|on site|in[- ]office|office[- ]based|office only)\b", r"\bcommission\s+(?:only|-only|based)\b", r"\bworking\s+student\b|\bwerkstudent\b|\bco[- ]op\b",
        rf"\bwohnsitz\s+(?:(?:in|innerhalb\s+der|i\.?\s*d\.?)\s*)?{_any(pins.GERMAN_PLACES)}\b",
    ]
    hybrid = F.regexp_replace(t, rf"(?U)\bhybrid[\s_-]+{_any(HYBRID_TECHNOLOGY)}\b|\bhybrid\s+of\b", " ").rlike(r"(?U)\bhybrid\b")
    tests = [asks_language(whole), is_hybrid(whole), _has_any(t, LOCAL_ROOTS) & t.rlike(_local(pins.LOCAL_PINS)), t.rlike("(?U)" + "|".join(signs)), t.contains("hybrid") & hybrid, recruiter(t)]
    return reduce(lambda a, b: a | b, tests)


def recruiter(low: Column) -> Column:
    """A title of recruiting, unless an engineer's word stands in it for another reason than what is recruited."""
    craft = r"(?:engineer(?:ing|s)?|developers?|architects?|scientists?|researchers?|programmers?)"
    head = r"(?:(?:technical\s+)?recruit(?:er|ing|ers)|talent\s+(?:acquisition|intelligence|partner|scout|lead|specialist)|headhunter)"
    named = low.rlike(rf"(?U)\b{head}\b")
    left = F.when(low.contains("solution"), low).otherwise(F.regexp_replace(low, rf"(?U)\b{craft}\s+(?:technical\s+)?(?:recruiter|recruiting)\b", " "))
    left = F.regexp_replace(left, rf"(?U)\b{head}\s*[-–,:/]\s*(?:\w+\s+){{0,5}}{craft}\b", " ")
    return named & ~left.rlike(r"(?U)\b(?:engineer(?:ing)?|developer|architect|scientist|researcher|programmer)\b")


def us_pinned(text: Column) -> Column:
    """A label or prose that ties work to the US, one of its states or metros; text that only names them beside other places does not. Null: no."""
    return once(read(text), pins_us)


def pins_us(t: Column) -> Column:
    """``us_pinned`` of a text that is read."""
    s, low, state, metro = t["text"], t["low"], _any(US_STATES), _any(pins.METROS)
    lives, town = r"(?:based|located|living|reside(?:s|ing)?)\s+in", r"remote\s+(?:in|at)"
    live_in = rf"\b(?:{lives}|must\s+be\s+(?:based\s+|located\s+)?in|{town})\s+{state}\b|\b{state}\s+only\b|\b{state}[\s-]+based\b"
    metro_in = rf"\b(?:{lives}|must\s+be\s+(?:based\s+)?in|{town}|remote|remote\s+(?:role|job|position|work|team)\s+in)\s+{metro}\b|\b{metro}\s+only\b|\b{metro}[\s-]+based\b"
    # Every demand that ends in two capitals, whichever comes first: "or" and "in" are no states.
    codes = lambda p: F.exists(F.regexp_extract_all(s, F.lit(p), F.lit(1)), lambda c: F.lower(c).isin(US_POSTAL))
    tied, town_named = shown(t["signs"], (*LIVES_SIGNS, "remote", "only")), may_name(t["signs"], pins.METROS)
    bare = town_named & (F.size(F.split(F.trim(low), r"\s+")) <= 6) & ~_has_any(low, pins.WORLD) & ~low.rlike(words(ELSEWHERE)) & low.rlike(words(pins.METROS))
    return (
        (low.contains("remote") | shown(t["signs"], ("coos",))) & low.rlike(f"(?U){_OREGON}") | (of_usa(t) < 0)
        | shown(t["signs"], US_SIGNS) & low.rlike(r"(?U)\b(?:us|u\.s\.)\s*(?:only|based|resident|citizen|candidates?)\b")
        | tied & may_name(t["signs"], US_STATES) & low.rlike(f"(?U){live_in}")
        | _has_any(low, ("based", "located", "living", "reside", "must")) & codes(rf"(?i)(?:{lives}|\bmust\s+be\s+(?:based\s+)?in)\s+((?-i:[A-Z]{{2}}))\b")
        | shown(t["signs"], ("only",)) & codes(r"(?i)\bin\s+((?-i:[A-Z]{2}))\s+only\b")
        | shown(t["signs"], ("remote",)) & F.exists(label_clauses(s), clause_pinned) | tied & town_named & low.rlike(f"(?U){metro_in}") | bare
    )


def label_clauses(text: Column) -> Column:
    """What stands beside each "remote" of a text: in parentheses or after a dash, comma or slash behind it, or before one in front of it.

    The text is cut at the word, so that each piece is read from an end of its own, and long prose in one pass.
    """
    pieces = F.split(text, r"(?iU)\bremote\b", -1)
    behind, front = F.slice(pieces, F.lit(2), F.size(pieces)), F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    run = r"(?i)^\s*[-,–/]\s*([a-z .&,]+)"
    found = [
        F.transform(behind, lambda p: F.regexp_extract(p, r"^\s*\(([^)]*)\)", 1)),
        F.transform(behind, lambda p: F.regexp_extract(p, run, 1)),
        F.transform(front, lambda p: F.reverse(F.regexp_extract(F.reverse(p), run, 1))),
    ]
    return F.filter(F.flatten(F.array(*found)), lambda c: c != "")


def clause_pinned(clause: Column) -> Column:
    """What a label says beside "remote" names the US, or in up to four words a state or metro and no place elsewhere."""
    low = F.trim(F.lower(clause))
    country = low.rlike(r"(?U)\b(?:us|usa|united states|u\.s\.a?)\b") | _has_any(low, ("us only", "usa only", "united states only", "u.s."))
    place = low.rlike(words((*US_STATES, *US_POSTAL, *pins.METROS)))
    return country | ~low.rlike(words(ELSEWHERE)) & (F.size(F.split(low, r"\s+")) <= 4) & place


def worldwide(location: Column, source: Column, title: Column, description: Column) -> Column:
    """``struct<stage string, open boolean>``: whether a role is open to whoever works from home abroad, and the rule that decided.

    The rules are asked in a fixed order, and the first that applies decides; what several of them need
    is computed once, and a description is read only where label and title leave it open. A null label
    is like an empty one.
    """
    return once(read_title(title), lambda t: decided(location, source, F.struct(t.alias("title")), description))


def decided(location: Column, source: Column, known: Column, description: Column | None = None) -> Column:
    """``worldwide`` of what is read: ``known`` has the title and, unless the description is given, the description as well."""
    # What the rules of the label need.
    text = F.trim(_low(location))
    facts = F.struct(
        text.alias("text"), hybrid_work(location).alias("hybrid"), F.lower(F.coalesce(source, F.lit(""))).isin(*pins.US_BOARDS).alias("us_board"),
        known["title"].alias("title"), *([] if description is not None else [known["description"].alias("description")]),
    )

    def by_label(f: Column) -> Column:
        told = lambda d: _by_description(f, d)
        read_on = once(f["description"], told) if description is None else once(read_description(description), told)
        return F.when(f["text"] == "", _stage("no_label", False)).when(f["title"]["restricted"], _stage("title", False)).otherwise(read_on)

    return once(facts, by_label)


def _stage(name: str, open_: bool | Column) -> Column:
    return F.struct(F.lit(name).alias("stage"), (open_ if isinstance(open_, Column) else F.lit(open_)).alias("open"))


def _by_description(f: Column, d: Column) -> Column:
    """The rules from the description on."""

    def later(r: Column) -> Column:
        text, told, found = r["low"], d["read"]["low"], F.concat(r["signs"], d["read"]["signs"])
        both = F.concat_ws(" ", text, told)
        remote = _has_any(text, ("remote", "work from home", "wfh", "anywhere", "telecommute"))
        remote_told = _has_any(told, ("100% remote", "fully remote", "work from home", "wfh")) | shown(d["read"]["signs"], ("remote",)) & told.rlike(r"(?U)\b(?:location|workplace|workplace\s+type)\s*:\s*remote\b|\bremote[,\s]+pakistan\b|\bpakistan[,\s]+remote\b")
        marked = once(both, lambda b: holds_rooted(b, pins.MARKERS, MARKER_ROOTS))
        town = text.rlike(rf"(?U)remote\s+in\s+\w|remote\s*,\s+[a-z]|{_OREGON}")
        allowed, abroad = words((*pins.CONTRACTS, *ASIA_PACIFIC, *MIDDLE_EAST)), (*ASIA_PACIFIC, *MIDDLE_EAST, *pins.CONTRACTS)
        office_told = _has_any(text, (*OFFICE, "office-based")) | holds_rooted(told, (*OFFICE, "office-based"), ("office", "site"))
        us, office, hybrid = pins_us(r), _has_any(text, OFFICE), f["hybrid"]
        scope = may_name(r["signs"], (*ASIA_PACIFIC, *MIDDLE_EAST)) & text.rlike(words(ASIA_PACIFIC + MIDDLE_EAST))
        remote_title = f["title"]["read"]["low"].rlike(r"(?U)\b(?:remote|wfh|work\s+from\s+home)\b")

        def rules(x: Column) -> Column:
            us, scope = x["us"], x["scope"]
            stages = [
                ("open_description", d["strong"] & ~us & ~text.rlike(words(pins.ISRAEL)) & ~hybrid & ~office, True),
                ("foreign", is_foreign(r), False),
                ("us", us, False),
                ("us_board", f["us_board"] & ~(marked | may_name(found, abroad) & both.rlike(words(abroad))), False),
                ("anywhere", _has_any(text, (*pins.WORLD, "work from home", "wfh", "anywhere")), True),
                ("global", text.rlike(r"(?U)\bglobal(?:ly)?\b"), True),
                ("contract", _has_any(text, ("b2b", "freelance")), True),
                ("closed_market", text.rlike(words(pins.CLOSED_MARKETS)), False),
                ("region", _has_any(text, ("apac", "asia pacific", "south asia", "middle east", "mena", "gcc")) & ~_has_any(text, ("onsite", "on-site", "hybrid", "in-office")), True),
                ("scope_hybrid", scope & (hybrid | d["hybrid"]), False),
                ("scope_office", scope & office_told, False),
                ("home", scope & _has_any(text, HOME), remote | remote_title | remote_told),
                ("scope_unmarked", scope & ~remote & ~(marked | _has_any(both, pins.CONTRACTS) | both.contains("pakistan")), False),
                ("scope_told", scope & ~remote, remote_told),
                ("scope", scope, True),
                ("qualified", _bare(text) & ~town & text.rlike(r"remote\s*\(") & ~F.regexp_extract(text, r"(remote\s*\(.*)", 1).rlike(allowed), False),
                ("bare", _bare(text) & ~town, True),
            ]
            return _first(stages).otherwise(_stage("none", False))

        opening = [("town_of_remote", _has_any(text, ("remote", "coos")) & text.rlike(f"(?U){_OREGON}"), False), ("anywhere_within", text.rlike(r"(?U)anywhere\s+in\s+(?!(?:the\s+)?world\b)"), False)]
        return _first(opening).otherwise(once(F.struct(us.alias("us"), scope.alias("scope")), rules))

    return F.when(d["restricted"], _stage("description", False)).otherwise(once(read(f["text"]), later))


def _first(stages) -> Column:
    """The first stage that applies."""
    (name, applies, open_), *more = stages
    return reduce(lambda chosen, s: chosen.when(s[1], _stage(s[0], s[2])), more, F.when(applies, _stage(name, open_)))


def _bare(text: Column) -> Column:
    return text.rlike(r"(?:^|[,;|\s])remote(?:$|[,\s(;\-])")
