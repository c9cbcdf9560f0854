"""Stored postings: as JSON, read back leniently through ``VARIANT``, gathered for a week, and as rows of a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.functions.dates import lenient_date, lenient_datetime
from tarnmill.functions.text import normalize_text
from tarnmill.operators.dedup import first_wins

# The text fields of a stored posting with what stands for one that is missing, fields that may be null,
# and the columns of the sheet.
TEXTS = {
    "id": "", "title": "", "company": "", "url": "", "source": "", "location_type": "unknown", "job_type": "unknown",
    "description_snippet": "", "cv_match_label": "",
}
SHEET = (
    "Job ID", "Posted Date", "Company", "Job Title", "CV Match %", "Job URL", "Source", "Location", "Location Type", "Salary",
    "Job Type", "Tags", "BD Status", "BD Notes",
)
LAKH_CURRENCIES = ("₹", "INR", "Rs", "PKR")
STORED = (
    "id", "title", "title_normalized", "company", "company_normalized", "url", "source", "location", "location_type", "salary_min", "salary_max",
    "salary_currency", "job_type", "posted_date", "fetched_at", "tags", "description_snippet", "cv_match_score", "cv_match_label", "profile_scores", "profile_best",
)


def serialised(rows: DataFrame, name: str = "record") -> DataFrame:
    """The rows with their stored fields (those of ``STORED`` that they have) as one JSON text beside them; nulls are written."""
    fields = [c for c in STORED if c in rows.columns]
    return rows.withColumn(name, F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}))


def _part(record: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(record, f"$.{name}", kind)


def _kind(value: Column) -> Column:
    """``VOID`` for a JSON null, SQL null for what is missing, else the type's name without its parameters."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _text(record: Column, name: str, default: str) -> Column:
    value = _part(record, name)
    return F.when(value.isNull(), F.lit(default)).when(F.is_variant_null(value), F.lit("None")).otherwise(_part(record, name, "string"))


def _integer(record: Column, name: str) -> Column:
    """A number cut to an integer, or a text that is one; 0 if missing, null if it can't be read."""
    kind, plain = _kind(_part(record, name)), F.trim(_part(record, name, "string"))
    whole = F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("long"))
    number = F.coalesce(whole, plain.try_cast("double").try_cast("long"))
    return F.when(kind.isNull(), F.lit(0).cast("long")).when(kind == "STRING", whole).when(kind == "BOOLEAN", (plain == "true").cast("long")).when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), number)


def rehydrated(rows: DataFrame, text: str, now: Column) -> DataFrame:
    """The rows with ``posting``, a struct of the stored fields, and ``problem``, null where the record could be read.

    A missing field takes its default, keys that aren't known are left out, and normal names are computed
    anew whatever the record says. A null in a text field reads as ``None``, in ``location`` and the salary as null; objects and
    lists in a text field as their JSON. ``posted_date`` that is no ISO date becomes null, ``fetched_at`` ``now``.
    A problem is ``json`` (no object, broken, empty, null, or a key twice), or the first of ``tags`` (no list),
    ``cv_match_score`` (no integer) and ``profile_scores`` (neither empty nor an object of integers); its posting is null.
    The text stays, so that damaged rows can be put aside whole.
    """
    record = F.col("_record")
    part = lambda name: _part(record, name)
    score, tags, raw_scores = _integer(record, "cv_match_score"), part("tags"), part("profile_scores")
    listed = F.when(tags.isNull(), F.array().cast("array<string>")).otherwise(_part(record, "tags", "array<string>"))
    falsy = raw_scores.isNull() | (_kind(raw_scores) == "VOID") | _part(record, "profile_scores", "string").isin("", "0", "0.0", "false", "[]", "{}")
    scores = F.when(falsy, F.create_map().cast("map<string,int>")).otherwise(_part(record, "profile_scores", "map<string,int>"))
    best = _part(record, "profile_best", "string")
    fields = {name: _text(record, name, default) for name, default in TEXTS.items()}
    fields |= {
        "title_normalized": normalize_text(_part(record, "title", "string")), "company_normalized": normalize_text(_part(record, "company", "string")),
        "location": _part(record, "location", "string"), "salary_min": _part(record, "salary_min", "long"), "salary_max": _part(record, "salary_max", "long"),
        "salary_currency": _part(record, "salary_currency", "string"), "posted_date": lenient_date(_part(record, "posted_date", "string")),
        "fetched_at": lenient_datetime(_part(record, "fetched_at", "string"), now), "tags": listed, "cv_match_score": score, "profile_scores": scores,
        "profile_best": F.when(best.isin("0", "0.0", "false", "[]", "{}"), F.lit("")).otherwise(F.coalesce(best, F.lit(""))),
    }
    problem = (
        F.when(F.coalesce(_kind(record), F.lit("")) != "OBJECT", "json")
        .when(~F.coalesce(_kind(tags) == "ARRAY", F.lit(True)) | listed.isNull(), "tags")
        .when(score.isNull(), "cv_match_score")
        .when(scores.isNull(), "profile_scores")
    )
    read = rows.withColumn("_record", F.try_parse_json(F.col(text))).withColumn("problem", problem)
    return read.withColumn("posting", F.when(F.col("problem").isNull(), F.struct(*(fields[n].alias(n) for n in STORED)))).drop("_record")


def day_records(spark: SparkSession, path: str) -> DataFrame:
    """``day, seq, record, problem`` of the files ``jobs_<day>.json`` in a folder: a list, or an object with the list in ``jobs``.

    A file that is neither gives one row with ``problem`` set and no record; an object without ``jobs`` is an
    empty list. A file is one JSON text, so it is read by one task.
    """
    files = spark.read.option("pathGlobFilter", "jobs_*.json").option("wholetext", "true").text(path)
    day = F.regexp_extract(F.col("_metadata.file_name"), r"jobs_(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    parsed = files.select(day.alias("day"), F.try_parse_json("value").alias("_all"))
    whole, inner = F.try_variant_get("_all", "$", "array<variant>"), _part(F.col("_all"), "jobs", "array<variant>")
    is_object = F.coalesce(_kind(F.col("_all")) == "OBJECT", F.lit(False))
    empty = F.when(is_object & _part(F.col("_all"), "jobs").isNull(), F.array().cast("array<variant>"))
    items = parsed.select("day", F.coalesce(whole, inner, empty).alias("_items"))
    good = items.where(F.col("_items").isNotNull()).select("day", F.posexplode("_items").alias("seq", "_one")).select("day", "seq", F.to_json("_one").alias("record"), F.lit(None).cast("string").alias("problem"))
    return good.unionByName(items.where(F.col("_items").isNull()).select("day", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("record"), F.lit("file").alias("problem")))


def weekly(days: DataFrame, store: DataFrame, today: Column, valid: Column, span: int = 7) -> DataFrame:
    """The week's postings, one per id: from the days' tables first (newest day, then order), then from the store.

    ``days(id, day, seq, ...)`` and ``store(id, fetched_at, seq, ...)`` share their other columns. Only rows
    that are ``valid`` claim an id, so that a bad row doesn't hide a later good one. Of the days the last ``span``
    up to today count, of the store what was fetched less than ``span`` days ago; a store row without time counts never.
    """
    last = F.date_sub(today, span - 1)
    rest = [c for c in days.columns if c not in ("day", "seq")]
    recent = days.where(F.col("day").between(last, today)).where(valid)
    kept = store.where(F.to_date("fetched_at") >= last).where(valid)
    one = recent.select(*rest, F.lit(0).alias("_from"), F.datediff(F.lit("9999-12-31").cast("date"), "day").alias("_age"), F.col("seq").alias("_seq"))
    two = kept.select(*rest, F.lit(1).alias("_from"), F.lit(0).alias("_age"), F.col("seq").alias("_seq"))
    return first_wins(one.unionByName(two), "id", ["_from", "_age", "_seq"]).drop("_from", "_age", "_seq")


def sheet_rows(postings: DataFrame, *order: str) -> DataFrame:
    """Stored postings as the fourteen text columns of the sheet, beside columns to order them by (``_<name>``).

    Salaries in lakh for its currencies, else in thousands, cut down; ``N/A`` without a least one. The match is
    its label, else its score, else ``unscored``.
    """
    c = F.col
    least, most, currency = c("salary_min"), c("salary_max"), F.coalesce(F.nullif(c("salary_currency"), F.lit("")), F.lit("$"))
    lakh = currency.isin(*LAKH_CURRENCIES)
    short = lambda v: F.concat(F.floor(v / F.when(lakh, 100_000).otherwise(1_000)).cast("string"), F.when(lakh, "L").otherwise("k"))
    some = lambda v: F.coalesce(v, F.lit(0)) != 0
    salary = F.when(some(least), F.concat(currency, short(least), F.when(some(most), F.concat(F.lit("-"), short(most))).otherwise(""))).otherwise("N/A")
    label = F.nullif(c("cv_match_label"), F.lit(""))
    match = F.coalesce(label, F.when(some(c("cv_match_score")), F.concat(c("cv_match_score").cast("string"), F.lit("%"))), F.lit("unscored"))
    values = (
        c("id"), F.coalesce(c("posted_date"), F.to_date("fetched_at")).cast("string"), c("company"), c("title"), match, c("url"), c("source"),
        F.coalesce(F.nullif(c("location"), F.lit("")), F.lit("Remote")), c("location_type"), salary, c("job_type"),
        F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("AI/ML"), F.lit("New"), F.lit(""),
    )
    return postings.select(*(v.alias(n) for v, n in zip(values, SHEET, strict=True)), *(c(o).alias(f"_{o}") for o in order))
