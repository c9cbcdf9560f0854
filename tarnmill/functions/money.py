"""Salary strings as a struct of least, greatest and currency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of a suffix, and marks of yearly and hourly pay.
MULTIPLIERS = {"k": 1_000, "m": 1_000_000, "l": 100_000, "lakh": 100_000, "lac": 100_000, "lpa": 100_000}
CURRENCIES = ("$", "£", "€", "₹")
NUMBER = r"(\d+(?:\.\d+)?)\s*((?:lakh|lac|lpa|[kKmMlL])?)"
YEARLY = r"(?i)(?:\bper\s+year|/\s*yr\b|/\s*year\b|\bannually\b|\bannual\b|\bper\s+annum|/\s*annum\b)"
HOURLY = r"(?i)(?:\bper\s+hour|/\s*hr\b|/\s*hour\b|\bhourly\b)"


def parse_salary(raw: Column) -> Column:
    """``struct<salary_min, salary_max, currency>``; a suffix holds for both ends of a range, yearly pay below 1000 is in thousands."""
    sign = F.regexp_extract(raw, r"^\s*([$£€₹A-Za-z]*)", 1)
    currency = F.when(sign.rlike(r"^[A-Za-z]+$") | sign.isin(*CURRENCIES), sign)
    clean = F.regexp_replace(raw, r"(?<=\d),(?=\d)", "")
    values, suffixes = (F.regexp_extract_all(clean, F.lit(NUMBER), F.lit(k)) for k in (1, 2))
    v0, v1 = (F.get(values, F.lit(k)).cast("double") for k in (0, 1))
    s0, s1 = (F.nullif(F.lower(F.get(suffixes, F.lit(k))), F.lit("")) for k in (0, 1))
    t0 = F.when(s0.isNull() & v1.isNotNull() & ((v0 <= v1) | (v0 < 1000)), s1).otherwise(s0)
    t1 = F.when(s1.isNull() & s0.isNotNull() & ((v1 >= v0) | (v1 < 1000)), s0).otherwise(s1)
    table = F.create_map(*(F.lit(x) for kv in MULTIPLIERS.items() for x in kv))
    yearly = raw.rlike(YEARLY) & ~raw.rlike(HOURLY)

    def amount(v: Column, s: Column) -> Column:
        times = F.coalesce(F.element_at(table, s), F.when(yearly & (v >= 20) & (v < 1000), 1000), F.lit(1))
        return F.floor(v * times).cast("long")

    known = raw.rlike(r"\d")
    return F.struct(F.when(known, amount(v0, t0)).alias("salary_min"), F.when(known, amount(v1, t1)).alias("salary_max"), F.when(known, currency).alias("currency"))
