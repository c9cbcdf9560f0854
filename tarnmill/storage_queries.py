"""Queries of feeds, boards and stored postings, with their oracles."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tarnmill.functions import dates
from tarnmill.operators import deliveries, feed, profiles
from tarnmill.plans.postings import POSTINGS_SQL, _pick, _sql_pick, postings
from tarnmill.registry import _docs, _read, _stream, query
from tarnmill.sources import batches, board, records
from tarnmill.sources.tables import new_path
from tarnmill.streaming import weekly
from tarnmill.streaming.breaker import breaker_table
from tarnmill.streaming.events import run_available

OPENINGS = ["We're hiring: ML engineer …", "Our team looks back", "Seeking a lead ••", "Worldwide, remote. Apply now", ""]
HEADLINES = ["• 2nd+", "Acme is hiring engineers", "CTO", "", "Opening soon at Globex"]
PLACES = ["Remote worldwide.", "Remote from Germany.", "Onsite in Dubai.", "Fully remote role."]


def _posts(spark, sf):
    d = F.col("doc_id")
    body = F.concat_ws("\n", F.coalesce("text", F.lit("")), _pick(OPENINGS, d), _pick(PLACES, F.floor(d / 5)))
    day = F.date_add(F.lit("2026-01-01").cast("date"), (d % 20).cast("int")).cast("string")
    link = F.concat(F.when(d % 11 == 3, "https://www.linkedin.com/in/p").otherwise("https://feed.example/p"), d.cast("string"))
    return _docs(spark, sf).select(d.alias("seq"), body.alias("text"), link.alias("url"), _pick(HEADLINES, F.floor(d / 3)).alias("headline"), F.col("source").alias("author"), F.when(d % 7 == 2, "2d").otherwise(day).alias("posted"), F.col("lang").alias("keyword"))


# The rule in SQL, from its wording: signs of hiring, then the headline, the first hiring line, the first line, in that order.
_HIRING = r"(?i)\b(?:(?:hire|hires|hiring|jobs?|openings?|seeking|looking\s+for|we(?:[''’]re|\s+are)\s+looking|join(?:ing)?\s+our\s+team|apply|application|resume|cv)\b|vacanc|opportunit|(?:roles?|positions?)\s*[:：])"


@query(rf"""WITH p AS (SELECT doc_id AS seq, trim(coalesce(text, '') || chr(10) || {_sql_pick(OPENINGS, 'doc_id')} || chr(10) || {_sql_pick(PLACES, 'doc_id // 5')}, ' ' || chr(9) || chr(10) || chr(13)) AS body, {_sql_pick(HEADLINES, 'doc_id // 3')} AS h FROM documents),
l AS (SELECT seq, CASE WHEN regexp_full_match(h, '•?\s*[123](?:st|nd|rd)\+?\s*') THEN '' ELSE trim(h) END AS h, list_transform(string_split(body, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS lines FROM p),
m AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '{_HIRING}')) AS hits FROM l)
SELECT seq, substr(CASE WHEN regexp_matches(h, '(?i)\b(?:hire|hiring|hires|job|vacanc|opportunit|opening|opening s)\b') THEN h WHEN len(hits) > 0 THEN regexp_replace(hits[1], '\s+[…•·]+$', '') ELSE lines[1] END, 1, 140) AS title FROM m""")
def feed_titles(spark, sf):
    return _posts(spark, sf).select("seq", feed.post_title(F.col("text"), F.col("headline")).alias("title"))


@query()
def feed_postings(spark, sf):
    found = feed.postings(_posts(spark, sf), F.lit("2026-01-05").cast("date"))
    return found.select("seq", "title", "company", "url", "location", "posted_date", F.length("description").alias("n_chars"))


@query()
def guest_verdicts(spark, sf):
    verdict = feed.guest_verdict(F.col("title"), F.col("location"), F.col("description"))
    return postings(spark, sf).select("seq", verdict.alias("v")).select("seq", "v.ok", "v.reason")


# One way for a record to be damaged, or none, per posting: what is replaced in its JSON, and by what.
DAMAGE = [
    ("sound", None, None), ("id null", r'"id":"[^"]*"', '"id":null'), ("fields missing", r'"(?:title|location_type)":"[^"]*",', ""), ("score as text", r'"cv_match_score":\d+', '"cv_match_score":" 77 "'),
    ("score as words", r'"cv_match_score":\d+', '"cv_match_score":"high"'), ("broken", r"\}$", ""), ("more keys and no date", r'^\{"id"(.*)"posted_date":"[^"]*"', '{"more":[1],"id"$1"posted_date":"soon"'), ("tags as text", r'"tags":\[[^\]]*\]', '"tags":"ai"'),
]


@query(rf"""WITH {POSTINGS_SQL}, k AS (SELECT *, seq % {len(DAMAGE)} AS k, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS low, trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) AS firm FROM postings)
SELECT seq, CASE k WHEN 4 THEN 'cv_match_score' WHEN 5 THEN 'json' WHEN 7 THEN 'tags' END AS problem,
  CASE WHEN k IN (4, 5, 7) THEN NULL WHEN k = 1 THEN 'None' ELSE 'p' || seq END AS id, CASE WHEN k IN (4, 5, 7) THEN NULL WHEN k = 2 THEN '' ELSE title END AS title,
  CASE WHEN k IN (4, 5, 7) THEN NULL WHEN k = 2 THEN '' ELSE low END AS title_normalized, CASE WHEN k NOT IN (4, 5, 7) THEN firm END AS company_normalized, CASE WHEN k IN (4, 5, 7) THEN NULL WHEN k = 2 THEN 'unknown' ELSE 'onsite' END AS location_type,
  CASE WHEN k NOT IN (4, 5, 7) THEN location END AS location, CASE WHEN k IN (0, 1, 2, 3) THEN CAST(fetched_at AS DATE) END AS posted_date, CASE WHEN k NOT IN (4, 5, 7) THEN fetched_at END AS fetched_at,
  CASE WHEN k IN (4, 5, 7) THEN NULL WHEN k = 3 THEN 77 ELSE seq % 101 END AS score, CASE WHEN k NOT IN (4, 5, 7) THEN sha256(coalesce(description, 'None')) END AS snippet_sha256,
  CASE WHEN k NOT IN (4, 5, 7) THEN source END AS tag, CASE WHEN k NOT IN (4, 5, 7) THEN seq % 101 END AS best FROM k""")
def records_reread(spark, sf):
    seq = F.col("seq")
    rows = postings(spark, sf).select(
        "seq", "title", "company", "location", "fetched_at", F.concat(F.lit("p"), seq.cast("string")).alias("id"), F.lit("old").alias("title_normalized"), F.lit("onsite").alias("location_type"), F.to_date("fetched_at").alias("posted_date"),
        (seq % 101).alias("cv_match_score"), F.array("source").alias("tags"), F.col("description").alias("description_snippet"), F.create_map(F.lit("ai"), (seq % 101).cast("int")).alias("profile_scores"),
    )
    kept, text = records.serialised(rows), F.col("record")
    for k, (_, found, other) in enumerate(DAMAGE):
        if found:
            text = F.when(seq % len(DAMAGE) == k, F.regexp_replace("record", found, other)).otherwise(text)
    again = records.rehydrated(kept.select("seq", text.alias("record")), "record", F.lit("2026-01-15").cast("timestamp"))
    p = lambda name: F.col(f"posting.{name}")
    plain = ("id", "title", "title_normalized", "company_normalized", "location_type", "location", "posted_date", "fetched_at")
    return again.select("seq", "problem", *(p(n).alias(n) for n in plain), p("cv_match_score").alias("score"), F.sha2(p("description_snippet"), 256).alias("snippet_sha256"), F.get(p("tags"), F.lit(0)).alias("tag"), F.try_element_at(p("profile_scores"), F.lit("ai")).cast("long").alias("best"))


@query(f"""WITH {POSTINGS_SQL}, p AS (SELECT seq % 500 AS id, seq, title, CAST(fetched_at AS DATE) AS day FROM postings WHERE title <> 'Sales Manager'),
u AS (SELECT id, title, 0 AS part, -epoch(day) AS age, seq FROM p WHERE day BETWEEN DATE '2026-01-06' AND DATE '2026-01-12' AND title NOT LIKE '%Engineer%' UNION ALL SELECT id, title, 1, 0, seq FROM p WHERE day >= DATE '2026-01-06')
SELECT id, title, CAST(part AS INTEGER) AS part FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, age, seq) AS r FROM u) WHERE r = 1""")
def weekly_scan(spark, sf):
    rows = postings(spark, sf).select((F.col("seq") % 500).alias("id"), "seq", "title", "fetched_at")
    days = rows.where(~F.col("title").contains("Engineer")).select("id", "seq", "title", F.lit(0).alias("part"), F.to_date("fetched_at").alias("day"))
    store = rows.select("id", "seq", "title", F.lit(1).alias("part"), "fetched_at")
    return records.weekly(days, store, F.lit("2026-01-12").cast("date"), F.col("title") != "Sales Manager")


@query(f"""WITH {POSTINGS_SQL}, s AS (SELECT *, 'p' || (seq % 500) AS id, seq % 3 AS m FROM postings), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (fetched_at >= TIMESTAMP '2026-01-10'), seq) AS r FROM s)
SELECT id AS "Job ID", strftime(fetched_at, '%Y-%m-%d') AS "Posted Date", company AS "Company", title AS "Job Title", CASE WHEN seq % 101 = 0 THEN 'unscored' ELSE (seq % 101) || '%' END AS "CV Match %", url AS "Job URL", source AS "Source",
  CASE location WHEN '' THEN 'Remote' ELSE location END AS "Location", 'remote' AS "Location Type", CASE m WHEN 0 THEN 'N/A' WHEN 1 THEN '$' || (150 + seq) || 'k' ELSE '₹' || ((2500000 + 1000 * seq) // 100000) || 'L-' || ((3000000 + 1000 * seq) // 100000) || 'L' END AS "Salary",
  job_type AS "Job Type", CASE WHEN seq % 2 = 0 THEN 'AI/ML' ELSE 'a, "' || source || '"' END AS "Tags", 'New' AS "BD Status", '' AS "BD Notes" FROM r WHERE r = 1""")
def sheet_merge(spark, sf):
    seq = F.col("seq")
    m = seq % 3
    rows = postings(spark, sf).select(
        F.concat(F.lit("p"), (seq % 500).cast("string")).alias("id"), "seq", "title", "company", "url", "source", "location", F.lit("remote").alias("location_type"), "job_type", "fetched_at", F.lit(None).cast("date").alias("posted_date"),
        F.when(m == 1, (150 + seq) * 1000 + 999).when(m == 2, 2_500_000 + 1000 * seq).alias("salary_min"), F.when(m == 2, 3_000_000 + 1000 * seq).alias("salary_max"), F.when(m == 2, "₹").otherwise("").alias("salary_currency"),
        F.lit("").alias("cv_match_label"), (seq % 101).alias("cv_match_score"), F.when(seq % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.concat(F.lit('"'), "source", F.lit('"')))).alias("tags"),
    )
    early, path = F.col("fetched_at") < F.lit("2026-01-10").cast("timestamp"), new_path(spark, "sheet")
    with_order = lambda part: records.sheet_rows(part, "seq")
    batches.merge(with_order(rows.where(early)), path, "1", "Job ID", ["_seq"], "csv")
    for _ in range(2):  # a batch that is repeated changes nothing
        table = batches.merge(with_order(rows), path, "2", "Job ID", ["_seq"], "csv")
    return table


KEYWORDS = [f"k{i}" for i in range(8)]


def _board(spark, sf) -> dict:
    """The pages as a stored board: eight keywords by the url's last digits, three pages each."""
    folder, k = new_path(spark, "board"), F.col("page_id") % len(KEYWORDS)
    rows = _read(spark, sf, "pages").select(F.concat(F.lit("k"), k.cast("string")).alias("keyword"), (F.col("page_id") % 3).alias("page"), F.col("page_id").cast("string").alias("title"), "url", F.col("html").alias("description"))
    rows.write.partitionBy("keyword", "page").parquet(folder)
    spark.dataSource.register(board.BoardSource)
    return {"fetch": f"{board.__name__}:{board.stored_pages.__name__}", "folder": folder, "keywords": json.dumps(KEYWORDS), "pages": "4"}


@query("SELECT 'k' || (page_id % 8) AS keyword, CAST(page_id % 3 AS INTEGER) AS page, CAST(page_id AS VARCHAR) AS title, url, sha256(html) AS html_sha256, CAST(NULL AS VARCHAR) AS problem FROM pages")
def board_scan(spark, sf):
    rows = spark.read.format("board").options(**_board(spark, sf)).load()
    return rows.select("keyword", "page", "title", "url", F.sha2("description", 256).alias("html_sha256"), "problem")


LEGACY_REJECTS, LEGACY_STACKS = (r"\bsales\b", r"\brecruiter\b"), (r"\bbackend\b", r"\bnlp\b")


@query(f"""WITH {POSTINGS_SQL} SELECT seq, CASE WHEN title = 'Sales Manager' THEN 'blacklisted_role: sales' WHEN title = 'Backend Developer' THEN 'unrelated_stack: backend' END AS reason FROM postings""")
def blacklist_legacy(spark, sf):
    return postings(spark, sf).select("seq", profiles.legacy_reason(F.col("title"), LEGACY_REJECTS, LEGACY_STACKS).alias("reason"))


@query(f"WITH {POSTINGS_SQL} SELECT seq, title, rank FROM (SELECT seq, title, row_number() OVER (ORDER BY CASE WHEN seq % 5 = 0 THEN 0 ELSE seq % 97 END DESC, seq) AS rank FROM postings) WHERE rank <= 5")
def message_top(spark, sf):
    rows = postings(spark, sf).withColumn("score", F.when(F.col("seq") % 5 != 0, F.col("seq") % 97))
    return deliveries.top_for_message(rows, "score", "seq").select("seq", "title", F.col("rank").cast("long").alias("rank"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, CAST(epoch(ts) AS DOUBLE) AS t, event_type <> 'click' AND value < 60 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS fails, CAST(0 AS BIGINT) AS total_fails, CAST(0 AS BIGINT) AS total_ok, CAST(0 AS DOUBLE) AS due, CAST(0 AS BIGINT) AS skipped FROM e
  UNION ALL SELECT e.key, e.n, CASE WHEN t < due THEN fails WHEN ok THEN 0 ELSE fails + 1 END, total_fails + CASE WHEN t < due OR ok THEN 0 ELSE 1 END, total_ok + CASE WHEN t >= due AND ok THEN 1 ELSE 0 END,
    CASE WHEN t < due THEN due WHEN ok THEN 0 WHEN fails + 1 >= 2 THEN t + 259200 ELSE due END, skipped + CASE WHEN t < due THEN 1 ELSE 0 END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT CAST(key AS VARCHAR) AS key, fails AS consecutive_fails, total_fails, total_ok, due AS open_until, skipped FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1""")
def breaker_gated(spark, sf):
    rows = _read(spark, sf, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.col("event_id").alias("seq"), ((F.col("event_type") != "click") & (F.col("value") < 60)).alias("ok"))
    return breaker_table(rows.withColumn("at", F.col("us") / 1e6), threshold=2, reset_s=259200.0)


CHANNELS = ["click", "purchase", "view"]


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, strftime(ts, '%G-W%V') AS week, event_type AS channel, value > 20 AS ok FROM events), l AS (SELECT key, max(week) AS week FROM e GROUP BY key),
c AS (SELECT key, week, array_agg(DISTINCT channel) FILTER (WHERE ok) AS done FROM e JOIN l USING (key, week) GROUP BY key, week)
SELECT key, week, array_to_string(list_filter({CHANNELS}, lambda c: NOT list_contains(coalesce(done, []), c)), ',') AS missing FROM c""")
def weekly_ledger(spark, sf):
    week = dates.week_key(F.to_date("ts"))
    rows = _stream(spark, sf).select(F.col("user_id").alias("key"), week.alias("week"), F.col("event_type").alias("channel"), (F.col("value") > 20).alias("ok"))
    return run_available(weekly.confirmations(rows, CHANNELS), "weekly", "update")
