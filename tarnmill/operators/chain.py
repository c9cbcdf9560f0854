"""The whole gate chain: normalized postings, gates of single rows, then links, duplicates and the cap per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.functions import dates, text
from tarnmill.functions.money import parse_salary
from tarnmill.operators import law, residency
from tarnmill.operators.dedup import fuzzy_first
from tarnmill.operators.gates import first_failure
from tarnmill.operators.profiles import Profile, meets_threshold, passing
from tarnmill.sources.tables import written

SNIPPET = 2000

# A digest leaves out a portal, asks no description of places at home and of plain remote labels, and has a flat least score.
DIGEST_PORTAL = "il.linkedin.com"
HOME = ("pakistan", "karachi", "lahore", "islamabad", "rawalpindi", "faisalabad", "peshawar")
PLAIN_REMOTE = ("remote", "worldwide", "anywhere", "work from anywhere", "global remote")
DIGEST_SCORE = 70


def normalized(rows: DataFrame, profiles: list[Profile], today: Column) -> DataFrame:
    """Postings with all derived columns: id, normal names, salary, dates, kinds of job and place, and the profiles that take them.

    ``rows(seq, source, title, company, url, location, salary, posted_date, description, job_type)``.
    The snippet is for display; every rule reads the whole description.
    """
    c = {name: F.col(name) for name in ("source", "title", "company", "url", "location", "salary", "posted_date", "description", "job_type")}
    kind = law.classify(c["location"], c["title"])
    salary = parse_salary(F.coalesce(c["salary"], F.lit("")))
    return rows.select(
        *rows.columns,
        text.posting_id(c["url"], c["title"], c["company"], c["source"]).alias("id"),
        text.canonical_url(c["url"], c["source"]).alias("canonical_url"),
        text.normalize_text(c["title"]).alias("title_normalized"), text.normalize_text(c["company"]).alias("company_normalized"),
        F.when((kind != "remote") & residency.worldwide(c["location"], c["source"], c["title"], c["description"])["open"], "remote").otherwise(kind).alias("location_type"),
        salary["salary_min"].alias("salary_min"), salary["salary_max"].alias("salary_max"), salary["currency"].alias("salary_currency"),
        text.job_type(c["job_type"]).alias("job_kind"),
        dates.posted_date(c["posted_date"], today).alias("posted_on"), dates.posted_datetime(c["posted_date"]).alias("posted_at"),
        F.substring(F.coalesce(c["description"], F.lit("")), 1, SNIPPET).alias("snippet"),
        passing(profiles, c["title"], c["description"]).alias("profiles"),
    )


def row_gates(profiles: list[Profile], window_start: Column, remote_only: bool = False) -> list[tuple[str, Column]]:
    """The gates that look at one normalized posting alone, in order."""
    on, at, day = F.col("posted_on"), F.col("posted_at"), window_start.cast("date")
    place = (F.col("location"), F.col("title"), F.col("description"), "daily")
    return [
        ("ai_keyword", F.size("profiles") > 0),
        ("expired", ~text.is_expired(F.col("title"), F.col("description"))),
        ("window", (at.isNull() | (at >= window_start)) & (on.isNull() | (on >= day))),
        ("recency", on.isNotNull() | at.isNotNull()),
        ("url", text.valid_job_url(F.col("url"))),
        *([("location", law.verdict(*place)["ok"])] if remote_only else []),
        ("threshold", F.exists("profiles", lambda p: meets_threshold(p["name"], p["score"], profiles))),
        ("quality", ~(F.coalesce("company", F.lit("")).isin("Unknown", "N/A", "n/a", "") & (F.coalesce("description", F.lit("")) == ""))),
    ]


def digest_gates(profiles: list[Profile]) -> list[tuple[str, Column]]:
    """The gates of a digest over stored postings ``(url, location, title, description, scores array<struct<name, score>>, score)``.

    One of the profiles' scores must reach its threshold; a posting without any goes by ``score``, and
    passes if that is null too. Descriptions are read whole; a null is empty in every column.
    """
    url, description = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "description"))
    place = F.lower(F.coalesce(F.col("location"), F.lit("")))
    known = place.rlike("|".join(HOME)) | F.trim(place).isin(*PLAIN_REMOTE)
    reached = F.exists("scores", lambda p: F.coalesce(meets_threshold(p["name"], p["score"], profiles), F.lit(False)))
    return [
        ("url", text.valid_job_url(url)),
        ("portal", ~url.contains(DIGEST_PORTAL)),
        ("location", law.verdict(F.col("location"), F.col("title"), F.col("description"), "digest")["ok"]),
        ("description", known | (description != "")),
        ("threshold", F.when(F.size(F.coalesce("scores", F.array())) > 0, reached).otherwise(F.coalesce(F.col("score") >= DIGEST_SCORE, F.lit(True)))),
    ]


def run(rows: DataFrame, profiles: list[Profile], today: Column, window_start: Column, seen: DataFrame, dead: DataFrame, cap: int = 250, remote_only: bool = False, fuzzy: bool = True) -> DataFrame:
    """Normalized postings with ``gate``, the first gate that each fails (null: accepted).

    ``seen(id)`` was accepted before, ``dead(url)`` are links found dead. A row is a duplicate of an id
    seen before or of an earlier accepted row with its id or, with ``fuzzy``, of alike names. Only
    accepted rows count: a dead link hides no later row. Rows of a source after its last accepted one
    under the cap are left out, and mark no other row, as they have never been read.

    Which rows are read depends on what is accepted before them, in any source. A round judges all rows
    that may still be read and finds where each source reaches its cap. What lies before the first row
    that a row beyond a cap has marked is then settled, and the rows beyond the settled caps go; with no
    such row all is. The least cap is settled in every round, most often all are in the first.
    """
    # The rules read every text, and the steps after them read the outcome several times: it is written once.
    judged = written(normalized(rows, profiles, today).withColumn("gate", first_failure(row_gates(profiles, window_start, remote_only))), "judged")
    flagged = judged.join(seen.select("id").distinct().withColumn("_seen", F.lit(True)), "id", "left").join(dead.select("url").distinct().withColumn("_dead", F.lit(True)), "url", "left")
    left = flagged
    while True:
        out = written(_marked(left, fuzzy), "marked")
        # The last row that a source may have: only its first rows under the cap are looked at, in each task and then once more.
        nth = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
        last = out.where(F.col("gate").isNull()).select("source", "seq", nth.alias("n")).where(F.col("n") == cap).select("source", F.col("seq").alias("_last"))
        unread = F.col("seq") > F.coalesce("_last", F.lit((1 << 63) - 1))
        placed = out.join(last, "source", "left").withColumn("_unread", unread)
        beyond = placed.where("_unread").agg(F.min("seq")).first()[0]
        if beyond is None:
            break
        marks = placed.where(F.col("_unread") & F.col("gate").isNull()).select(F.col("seq").alias("_by"))
        by_id = placed.where(~F.col("_unread") & F.col("_by").isNotNull()).join(marks, "_by").agg(F.min("seq")).first()[0]
        by_name = placed.where(~F.col("_unread") & F.col("_alike") & (F.col("seq") > beyond)).agg(F.min("seq")).first()[0]
        wrong = min((x for x in (by_id, by_name) if x is not None), default=None)
        if wrong is None:
            out = placed.where(~F.col("_unread"))
            break
        left = left.join(last.where(F.col("_last") < wrong), "source", "left").where(F.col("_last").isNull() | (F.col("seq") <= F.col("_last"))).drop("_last")
    columns = [*rows.columns, *(c for c in judged.columns if c not in rows.columns)]
    return out.select(*columns)


def _marked(flagged: DataFrame, fuzzy: bool) -> DataFrame:
    """The gates of duplicates and dead links, with ``_by``, the row of the same id that marks one, and ``_alike`` where it is one by its names."""
    open_, alive = F.col("gate").isNull(), F.col("_dead").isNull() & F.col("_seen").isNull()
    # An id's first row that is open and alive is accepted, so an earlier one makes a row a duplicate.
    first = flagged.where(open_ & alive).groupBy("id").agg(F.min("seq").alias("_first"))
    later = open_ & F.col("_seen").isNull() & (F.col("seq") > F.col("_first"))
    gate = F.when(~open_, F.col("gate")).when(F.col("_seen") | later, "dedup").when(F.col("_dead"), "dead_link")
    out = flagged.join(first, "id", "left").withColumns({"_by": F.when(later, F.col("_first")), "gate": gate, "_alike": F.lit(False)}).drop("_first")
    if fuzzy:
        kept = fuzzy_first(out.where(F.col("gate").isNull()).select("seq", "title", "company")).select("seq", F.lit(True).alias("_kept"))
        alike = F.col("gate").isNull() & F.col("_kept").isNull()
        out = out.join(kept, "seq", "left").withColumns({"_alike": alike, "gate": F.when(alike, "dedup").otherwise(F.col("gate"))}).drop("_kept")
    return out
