"""Queries of the residency rules and of places, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnmill.functions import pins
from tarnmill.operators import geo, law, residency
from tarnmill.plans.notices import NOTICES_SQL, notices
from tarnmill.registry import _sql_list, query


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


BACK, HARD = _text("(?i)" + "|".join(pins.US_TAKEN_BACK)), _text("(?i)" + pins.HARD)
US = r"(?:us|usa|u\.s(?:\.a)?\.?)"


@query(rf"""WITH {NOTICES_SQL},
s AS (SELECT seq, replace(unnest(string_split_regex(regexp_replace(regexp_replace(notice, '\b([Uu])\.([Ss])\.([Aa])\.', '\1·\2·\3·', 'g'), '\b([Uu])\.([Ss])\.', '\1·\2·', 'g'), '[.!?]\s+|\n+')), '·', '.') AS s FROM notices),
p AS (SELECT *, regexp_matches(s, {BACK}) AS back, regexp_replace(s, {BACK}, ' ', 'g') AS rest FROM s),
v AS (SELECT seq,
    CASE WHEN NOT regexp_matches(s, '(?i)\b(?:usa|united states|u\.s\.a)\b') THEN 0 WHEN back AND NOT regexp_matches(s, '(?i)\bonly\b') AND NOT regexp_matches(s, {HARD}) THEN 1 ELSE -1 END AS usa,
    CASE WHEN NOT regexp_matches(s, '\b(?:US|USA|U\.S(?:\.A)?\.)(?:\s*(?i:persons?|personnel)|\s+(?i:business\s+hours?))\b') THEN 0
      WHEN back AND NOT regexp_matches(rest, {HARD}) AND NOT (regexp_matches(rest, '(?i)\b{US}\s+persons?\s+only\b|\bonly\s+{US}\s+persons?\b') AND NOT regexp_matches(rest, '(?i)\bnot\s+only\b')) THEN 1 ELSE -1 END AS persons FROM p)
SELECT seq, CASE WHEN bool_or(usa < 0) THEN -1 WHEN bool_or(usa > 0) THEN 1 ELSE 0 END AS usa, CASE WHEN bool_or(persons < 0) THEN -1 WHEN bool_or(persons > 0) THEN 1 ELSE 0 END AS persons FROM v GROUP BY seq""")
def law_polarity(spark, sf):
    text = F.col("notice")
    return notices(spark, sf).select("seq", residency.usa_polarity(text).alias("usa"), residency.us_persons_polarity(text).alias("persons"))


def _local(patterns) -> str:
    return _text("|".join(p.format(de="(?:" + "|".join(pins.GERMAN_PLACES) + ")", gap=r"[^.!?\n]") for p in patterns))


@query(rf"""WITH {NOTICES_SQL},
f AS (SELECT seq, regexp_replace(regexp_replace(lower(notice), '[ \t]*[\r\n]+[ \t]*', ' ', 'g'), '({pins.CLIENTS}[^.!?\n]{{0,25}}\s*)bas[eé]e?s?\s+en\s+france\b', '\1', 'g') AS t FROM notices),
s AS (SELECT seq, unnest(string_split_regex(t, '[.!?]')) AS s FROM f),
c AS (SELECT seq, string_split(regexp_replace(s, '({pins.CLAUSE_ENDS})', chr(2) || '\1' || chr(2), 'g'), chr(2)) AS parts FROM s WHERE regexp_matches(s, {_local(pins.LOCAL_PINS)})),
r AS (SELECT seq, array_to_string(parts[i:j], '') AS run FROM c, range(1, len(parts) + 1, 2) a(i), range(i, len(parts) + 1, 2) b(j)),
h AS (SELECT DISTINCT seq FROM r WHERE regexp_matches(run, {_local(pins.LOCAL_PINS)}) AND NOT regexp_matches(run, {_local(pins.LOCAL_TAKEN_BACK)}))
SELECT seq, seq IN (SELECT seq FROM h) AS pinned FROM notices""")
def law_local_residency(spark, sf):
    return notices(spark, sf).select("seq", residency.local_residency(F.col("notice")).alias("pinned"))


_STATE, _METRO, _LIVES = "(?:" + "|".join(law.US_STATES) + ")", "(?:" + "|".join(pins.METROS) + ")", r"(?:based|located|living|reside(?:s|ing)?)\s+in"
_ANY_PLACE = lambda values: rf"\b(?:{'|'.join(values)})\b"


# Clauses beside "remote" are found from the pieces between its occurrences: what opens a piece follows one, what closes it comes before one.
@query(rf"""WITH {NOTICES_SQL}, l AS (SELECT seq, label, lower(label) AS low, string_split_regex(lower(label), '\bremote\b') AS pieces FROM notices),
k AS (SELECT seq, label, low, list_concat(
    list_transform(pieces[2:], lambda p: regexp_extract(p, '^\s*\(([^)]*)\)', 1)), list_transform(pieces[2:], lambda p: regexp_extract(p, '^\s*[-,–/]\s*([a-z .&,]+)', 1)),
    list_transform(pieces[:-2], lambda p: regexp_extract(p, '([a-z .&,]+?)\s*[-,–/]\s*$', 1))) AS clauses FROM l),
c AS (SELECT *, list_filter(clauses, lambda c: c <> '' AND (regexp_matches(c, '\b(?:us|usa|united states|u\.s\.a?)\b') OR contains(c, 'us only') OR contains(c, 'u.s.')
    OR NOT regexp_matches(c, '{_ANY_PLACE(residency.ELSEWHERE)}') AND len(string_split_regex(trim(c), '\s+')) <= 4 AND regexp_matches(c, '{_ANY_PLACE((*law.US_STATES, *law.US_POSTAL, *pins.METROS))}'))) AS pinned FROM k)
SELECT seq, regexp_matches(low, '\bremote\s*,?\s*(?:or|oregon)\b') OR regexp_matches(low, '\b(?:usa|united states)\b') OR regexp_matches(low, '\bus\s*(?:only|based|resident|citizen|candidates?)\b')
  OR regexp_matches(low, '\b(?:{_LIVES}|must\s+be\s+(?:based\s+|located\s+)?in|remote\s+(?:in|at))\s+{_STATE}\b|\b{_STATE}(?:\s+only|[\s-]+based)\b')
  OR list_contains({_sql_list(p.upper() for p in law.US_POSTAL)}, regexp_extract(label, '(?:{_LIVES}|must\s+be\s+(?:based\s+)?in)\s+([A-Z]{{2}})\b', 1)) OR len(pinned) > 0
  OR regexp_matches(low, '\b(?:{_LIVES}|must\s+be\s+(?:based\s+)?in|remote\s+(?:in|at)|remote)\s+{_METRO}\b|\b{_METRO}(?:\s+only|[\s-]+based)\b')
  OR len(string_split_regex(trim(low), '\s+')) <= 6 AND NOT contains(low, 'worldwide') AND regexp_matches(low, '{_ANY_PLACE(pins.METROS)}') AND NOT regexp_matches(low, '{_ANY_PLACE(residency.ELSEWHERE)}') AS pinned FROM c""")
def law_us(spark, sf):
    return notices(spark, sf).select("seq", residency.us_pinned(F.col("label")).alias("pinned"))


_TERMS = ", ".join(f"({_text(t)}, '{c}')" for c, terms in geo.CLASSES.items() for t in dict.fromkeys(terms))


@query(rf"""WITH {NOTICES_SQL}, t AS (SELECT seq, lower(label || ' | ' || notice) AS t FROM notices), v(term, class) AS (VALUES {_TERMS}),
w AS (SELECT seq, t, ' ' || regexp_replace(t, '[^\pL\pN_]+', ' ', 'g') || ' ' AS padded FROM t),
m AS (SELECT seq, class, term FROM w JOIN (SELECT *, ' ' || trim(regexp_replace(term, '[^\pL\pN_]+', ' ', 'g')) || ' ' AS whole FROM v) v ON contains(t, term) AND contains(padded, whole))
SELECT seq, class, count(*) AS n_terms, string_agg(term, ',' ORDER BY term) AS terms FROM m GROUP BY seq, class""")
def law_places(spark, sf):
    rows = notices(spark, sf).select("seq", F.concat_ws(" | ", "label", "notice").alias("text"))
    found = geo.with_places(rows, "text").select("seq", F.explode("places").alias("p")).select("seq", "p.class", "p.term").distinct()
    return found.groupBy("seq", "class").agg(F.count("*").alias("n_terms"), F.array_join(F.sort_array(F.collect_list("term")), ",").alias("terms"))


@query()
def law_worldwide_full(spark, sf):
    found = residency.worldwide(F.col("label"), F.col("board"), F.col("title"), F.col("notice"))
    return notices(spark, sf).select("seq", "label", found.alias("found")).select("seq", "label", "found.stage", "found.open")
