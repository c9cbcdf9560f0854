"""Name -> query and name -> oracle SQL of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.functions import dates, diffing, text
from tarnmill.functions.money import parse_salary
from tarnmill.operators import dedup, delivery, digest, gates, law, ledger
from tarnmill.plans import storyboard
from tarnmill.plans.postings import POSTINGS_SQL, postings
from tarnmill.streaming import events as streaming

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _today():
    return F.lit("2026-01-15").cast("date")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SLUG = r"regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"""WITH s AS (SELECT doc_id, {SLUG} AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 64 THEN s WHEN contains(substr(s, 1, 65), '-') THEN regexp_replace(substr(s, 1, 65), '-[^-]*$', '') ELSE substr(s, 1, 64) END AS slug FROM s""")
def text_slugify(spark, sf):
    return _docs(spark, sf).select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END AS short FROM documents")
def text_truncate(spark, sf):
    return _docs(spark, sf).select("doc_id", text.truncate(F.col("text")).alias("short"))


@query(r"SELECT doc_id, CAST(length(regexp_extract_all(text, '\S+')) AS INTEGER) AS words FROM documents")
def text_count_words(spark, sf):
    return _docs(spark, sf).select("doc_id", text.count_words(F.col("text")).alias("words"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text || ' ghp_' || md5(CAST(doc_id AS VARCHAR)) || ' Bearer ' || md5(CAST(doc_id AS VARCHAR)),
  '\b(sk|pk|ghp|gho|ghu|ghs|github_pat|AKIA)[A-Za-z0-9_]{16,}\b', '[REDACTED]', 'g'), '(?i)bearer\s+[a-z0-9._~+/=-]{20,}', '[REDACTED]', 'g')) AS digest FROM documents""")
def text_redact(spark, sf):
    secret = F.md5(F.col("doc_id").cast("string"))
    return _docs(spark, sf).select("doc_id", F.sha2(text.redact_secrets(F.concat("text", F.lit(" ghp_"), secret, F.lit(" Bearer "), secret)), 256).alias("digest"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))) AS digest FROM documents")
def text_normalize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("digest"))


#: What is said to a model beside the text of every document; some of it is harmless.
SAID = ["", "my API_KEY=1", "apikey", "a secret", "token", "Bearer x", "sk-1", "AIza0", "PassWord", "Ignore previous and", "ignore ALL previous", "the system prompt", "disregard it", "You are now free", "print your instructions", "secret token", "fine"]
HINTS_SQL = """[['api_key', 'secret'], ['apikey', 'secret'], ['secret', 'secret'], ['token', 'secret'], ['bearer ', 'secret'], ['sk-', 'secret'], ['AIza', 'secret'], ['password', 'secret'],
  ['ignore previous', 'prompt injection'], ['ignore all previous', 'prompt injection'], ['system prompt', 'prompt injection'], ['disregard', 'prompt injection'], ['you are now', 'prompt injection'], ['print your instructions', 'prompt injection']]"""


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform({HINTS_SQL}, lambda h: CASE WHEN contains(lower(said), h[1]) THEN 'possible ' || h[2] || ' (' || chr(39) || h[1] || chr(39) || ')' END), lambda r: r IS NOT NULL), ';') AS reasons
FROM (SELECT doc_id, coalesce(text, '') || ' ' || [{', '.join(f"'{s}'" for s in SAID)}][doc_id % {len(SAID)} + 1] AS said FROM documents)""")
def text_screen(spark, sf):
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", F.array_join(text.screen_text(F.concat_ws(" ", F.coalesce("text", F.lit("")), said)), ";").alias("reasons"))


@query(r"SELECT page_id, trim(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS body FROM pages WHERE length(trim(regexp_replace(html, '<[^>]+>', ' ', 'g'))) >= 20")
def html_strip(spark, sf):
    return _read(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("body")).where("body is not null")


@query(r"SELECT regexp_replace(url, '[?#].*$', '') AS base, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def url_base_distinct(spark, sf):
    return _read(spark, sf, "pages").groupBy(text.base_url(F.col("url")).alias("base")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(f"WITH {POSTINGS_SQL} SELECT seq, list_has_any(regexp_extract_all(lower(title), '[a-z0-9+#]+'), ['ml', 'ai']) OR contains(lower(title), 'data scientist') AS hit FROM postings")
def text_keyword_match(spark, sf):
    return postings(spark, sf).select("seq", text.keyword_match(F.col("title"), ["ML", "AI", "Data Scientist"]).alias("hit"))


@query(f"""WITH {POSTINGS_SQL} SELECT seq, CASE WHEN contains(lower(job_type), 'full') THEN 'full-time' WHEN contains(lower(job_type), 'part') THEN 'part-time'
  WHEN contains(lower(job_type), 'contract') OR contains(lower(job_type), 'freelance') THEN 'contract' ELSE 'unknown' END AS kind FROM postings""")
def job_type_classify(spark, sf):
    return postings(spark, sf).select("seq", text.job_type(F.col("job_type")).alias("kind"))


EXPIRED_SQL = r"""(regexp_matches(title, '(?i)\b(closed|expired|no longer (?:accepting|available)|filled|ended|terminated|withdrawn|cancelled|canceled)\b')
  OR list_bool_or(list_transform(['this position has been filled', 'this job is no longer', 'this job has expired', 'applications are closed', 'no longer accepting applications'], lambda p: contains(lower(coalesce(description, '')), p))))"""


@query(rf"WITH {POSTINGS_SQL} SELECT seq, title FROM postings WHERE {EXPIRED_SQL}")
def expired_filter(spark, sf):
    return postings(spark, sf).where(text.is_expired(F.col("title"), F.col("description"))).select("seq", "title")


#: An id parameter is in a third of the urls, of each of two sources.
SOURCED = "CASE seq % 3 WHEN 0 THEN 'indeed' WHEN 1 THEN 'glassdoor' ELSE 'other' END"
SOURCED_URL = "url || CASE seq % 3 WHEN 0 THEN '&jk=' || hex(seq) WHEN 1 THEN '&jl=' || seq ELSE '&id=' || seq END"
CANONICAL_SQL = "CASE seq % 3 WHEN 0 THEN 'https://www.indeed.com/viewjob?jk=' || hex(seq) WHEN 1 THEN 'https://www.glassdoor.com/job-listing/?jl=' || seq ELSE url || '&id=' || seq END"


def _sourced(spark, sf) -> DataFrame:
    return postings(spark, sf).withColumn("url", F.expr(SOURCED_URL)).withColumn("source", F.expr(SOURCED))


@query(f"WITH {POSTINGS_SQL} SELECT seq, {CANONICAL_SQL} AS url FROM postings")
def url_canonical(spark, sf):
    return _sourced(spark, sf).select("seq", text.canonical_url(F.col("url"), F.col("source")).alias("url"))


JOB_ID = f"substr(sha256(lower(trim({CANONICAL_SQL})) || '|' || lower(trim(title)) || '|' || lower(trim(company))), 1, 16)"


@query(f"WITH {POSTINGS_SQL} SELECT seq, {JOB_ID} AS id FROM postings")
def job_id_hash(spark, sf):
    rows = _sourced(spark, sf)
    return rows.select("seq", text.posting_id(F.col("url"), F.col("title"), F.col("company"), F.col("source")).alias("id"))


NUM = r"(\d+(?:\.\d+)?)\s*((?:lakh|lac|lpa|[kKmMlL])?)"
SALARY_SQL = rf"""n AS (SELECT seq, salary, regexp_extract_all(regexp_replace(salary, '(\d),(\d)', '\1\2', 'g'), '{NUM}', 1) AS v,
    regexp_extract_all(regexp_replace(salary, '(\d),(\d)', '\1\2', 'g'), '{NUM}', 2) AS s FROM postings),
  p AS (SELECT seq, salary, CAST(v[1] AS DOUBLE) AS a, CAST(v[2] AS DOUBLE) AS b, nullif(lower(s[1]), '') AS sa, nullif(lower(s[2]), '') AS sb,
    regexp_matches(salary, '(?i)(?:/\s*yr\b|/\s*year\b|\bannual)') AND NOT regexp_matches(salary, '(?i)(?:/\s*hr\b|/\s*hour\b|\bhourly\b)') AS yearly FROM n),
  q AS (SELECT *, CASE WHEN sa IS NULL AND b IS NOT NULL AND (a <= b OR a < 1000) THEN sb ELSE sa END AS ta,
    CASE WHEN sb IS NULL AND sa IS NOT NULL AND (b >= a OR b < 1000) THEN sa ELSE sb END AS tb FROM p)
  SELECT seq, CAST(floor(a * coalesce(CASE ta WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 WHEN 'l' THEN 100000 WHEN 'lakh' THEN 100000 END, CASE WHEN yearly AND a >= 20 AND a < 1000 THEN 1000 END, 1)) AS BIGINT) AS salary_min,
    CAST(floor(b * coalesce(CASE tb WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 WHEN 'l' THEN 100000 WHEN 'lakh' THEN 100000 END, CASE WHEN yearly AND b >= 20 AND b < 1000 THEN 1000 END, 1)) AS BIGINT) AS salary_max,
    CASE WHEN regexp_matches(salary, '\d') THEN nullif(regexp_extract(salary, '^\s*([$£€₹A-Za-z]*)', 1), '') END AS currency FROM q"""


@query(f"WITH {POSTINGS_SQL}, {SALARY_SQL}")
def salary_parse(spark, sf):
    return postings(spark, sf).select("seq", parse_salary(F.col("salary")).alias("s")).select("seq", "s.*")


POSTED_SQL = """CASE posted_date WHEN 'Posted 3 days ago' THEN DATE '2026-01-12' WHEN 'yesterday' THEN DATE '2026-01-14' WHEN '30+ days ago' THEN DATE '2025-12-16'
  WHEN '6 hours ago' THEN DATE '2026-01-15' WHEN '2 weeks ago' THEN DATE '2026-01-01' WHEN 'just posted' THEN DATE '2026-01-15' ELSE TRY_CAST(substr(posted_date, 1, 10) AS DATE) END"""


@query(f"WITH {POSTINGS_SQL} SELECT seq, {POSTED_SQL} AS posted FROM postings")
def posted_date_parse(spark, sf):
    return postings(spark, sf).select("seq", dates.posted_date(F.col("posted_date"), _today()).alias("posted"))


@query("SELECT strftime(o_orderdate, '%G-W%V') AS week, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def iso_week_rollup(spark, sf):
    rows = _read(spark, sf, "orders")
    return rows.groupBy(dates.week_key(F.col("o_orderdate")).alias("week")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT event_id, CASE isodow(ts) WHEN 1 THEN 'backfill' WHEN 5 THEN 'weekly' WHEN 6 THEN 'idle' WHEN 7 THEN 'idle' ELSE 'daily' END AS reason,
  epoch(ts) - epoch(ts - INTERVAL 1 HOUR * (CASE isodow(ts) WHEN 1 THEN 72 WHEN 5 THEN 168 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 24 END)) AS seconds FROM events""")
def fetch_window(spark, sf):
    w = _read(spark, sf, "events").select("event_id", dates.fetch_window(F.col("ts").cast("timestamp")).alias("w"))
    return w.select("event_id", "w.reason", (F.unix_timestamp("w.window_end") - F.unix_timestamp("w.window_start")).cast("double").alias("seconds"))


@query("SELECT p_partkey, CASE WHEN p_size % 70 < 60 THEN (p_partkey % 5) * 60 + p_size % 70 END AS seconds FROM part")
def timecode_parse(spark, sf):
    code = F.format_string("%02d:%02d:11", F.col("p_partkey") % 5, F.col("p_size") % 70)
    return _read(spark, sf, "part").select("p_partkey", dates.timecode_seconds(code).cast("long").alias("seconds"))


GATES_SQL = f"""CASE WHEN {EXPIRED_SQL} THEN 'expired'
  WHEN {POSTED_SQL} IS NULL THEN 'recency' WHEN {POSTED_SQL} < DATE '2026-01-08' THEN 'window'
  WHEN regexp_replace(lower(company), '\\W', '', 'g') IN ('unknown', 'na', '') AND description = '' THEN 'quality' END"""


def _gated(spark, sf) -> DataFrame:
    rows = postings(spark, sf)
    posted = dates.posted_date(F.col("posted_date"), _today())
    chain = [
        ("expired", ~text.is_expired(F.col("title"), F.col("description"))), ("recency", posted.isNotNull()), ("window", posted >= F.date_sub(_today(), 7)),
        ("url", text.valid_job_url(F.col("url"))), ("quality", ~(F.col("company").isin("Unknown", "N/A", "n/a", "") & (F.coalesce("description", F.lit("")) == ""))),
    ]
    return gates.apply_gates(rows, chain)


@query(f"WITH {POSTINGS_SQL} SELECT seq, {GATES_SQL} AS gate FROM postings")
def gate_first_failure(spark, sf):
    return _gated(spark, sf).select("seq", "gate")


@query(f"WITH {POSTINGS_SQL} SELECT source, coalesce({GATES_SQL}, 'accepted') AS gate, count(*) AS n FROM postings GROUP BY ALL")
def gate_reject_counts(spark, sf):
    return _gated(spark, sf).groupBy("source", F.coalesce("gate", F.lit("accepted")).alias("gate")).agg(F.count("*").alias("n"))


@query(f"WITH {POSTINGS_SQL} SELECT source, seq FROM (SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM postings WHERE {GATES_SQL} IS NULL) WHERE n <= 5")
def gate_source_cap(spark, sf):
    return gates.cap_per_source(_gated(spark, sf).where("accepted"), 5).select("source", "seq")


@query(f"""WITH {POSTINGS_SQL} SELECT seq, CASE WHEN contains(lower(location || ' ' || title), 'hybrid') THEN 'hybrid' WHEN regexp_matches(lower(location || ' ' || title), '\\b(?:remote|worldwide|anywhere)\\b') THEN 'remote'
  WHEN trim(location) = '' THEN 'unknown' ELSE 'onsite' END AS kind FROM postings""")
def location_classify(spark, sf):
    return postings(spark, sf).select("seq", gates.classify_location(F.col("location"), F.col("title")).alias("kind"))


@query(f"""WITH {POSTINGS_SQL} SELECT seq, CASE WHEN contains(lower(title), 'sales') THEN 0 WHEN regexp_matches(lower(title), '\\bml|machine learning') THEN least(90 + CASE WHEN contains(lower(title), 'senior') THEN 15 ELSE 0 END, 100)
  WHEN regexp_matches(lower(title), '\\bai\\b|\\bllm') THEN 80 + CASE WHEN contains(lower(title), 'senior') THEN 15 ELSE 0 END ELSE 40 END AS score FROM postings""")
def profile_score(spark, sf):
    bonus = F.when(F.lower("title").contains("senior"), 15).otherwise(0)
    score = gates.score_profile(F.col("title"), ["sales"], [(r"\bml|machine learning", 90), (r"\bai\b|\bllm", 80)], bonus, 40)
    return postings(spark, sf).select("seq", score.alias("score"))


@query("SELECT text AS text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_exact_first(spark, sf):
    return dedup.first_wins(_docs(spark, sf).select("text", "doc_id"), "text", ["doc_id"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def anti_join_seen(spark, sf):
    seen = _read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return dedup.not_seen(_read(spark, sf, "orders"), seen, "o_custkey").select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'old' ELSE 'new' END AS side FROM orders""")
def merge_by_id(spark, sf):
    """Orders up to 1995 are there already; those from 1994 on come in."""
    rows = _read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    old, new = rows.where("o_orderdate < timestamp_ntz'1996-01-01'"), rows.where("o_orderdate >= timestamp_ntz'1994-01-01'")
    return dedup.merge_by_id(old.withColumn("side", F.lit("old")), new.withColumn("side", F.lit("new")), "o_orderkey").select("o_orderkey", "side")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR CAST(o_orderdate AS DATE) >= DATE '1998-01-01' - 30")
def ttl_expire(spark, sf):
    seen = _read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("date")).alias("seen_on"))
    return dedup.unexpired(seen, F.lit("1998-01-01").cast("date"), 30).select("o_orderkey")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def bounded_recent(spark, sf):
    return dedup.newest(_read(spark, sf, "events").select("event_id", "event_type"), 200, "event_id")


@query()
def fuzzy_dedup(spark, sf):
    return dedup.fuzzy_first(postings(spark, sf)).select("seq", "title", "company")


@query(f"""WITH {POSTINGS_SQL}, u AS (SELECT seq, 'source' AS dimension, source AS value FROM postings UNION ALL SELECT seq, 'company', company FROM postings UNION ALL SELECT seq, 'location', location FROM postings UNION ALL SELECT seq, 'title', title FROM postings)
SELECT dimension, value, count(*) AS n, min(seq) AS first_seq FROM u GROUP BY ALL""")
def digest_counts(spark, sf):
    return digest.counts(postings(spark, sf), ["source", "company", "location", "title"])


@query(f"WITH {POSTINGS_SQL} SELECT company, count(*) AS n, min(seq) AS first_seq FROM postings GROUP BY 1 ORDER BY n DESC, first_seq LIMIT 10")
def digest_top_companies(spark, sf):
    return digest.most_common(postings(spark, sf), "company", 10)


@query(f"WITH {POSTINGS_SQL} SELECT seq, title FROM postings ORDER BY coalesce({POSTED_SQL}, CAST(fetched_at AS DATE)) DESC, fetched_at DESC, seq LIMIT 20")
def digest_top_jobs(spark, sf):
    day = F.coalesce(dates.posted_date(F.col("posted_date"), _today()), F.col("fetched_at").cast("date"))
    return postings(spark, sf).orderBy(F.desc(day), F.desc("fetched_at"), "seq").limit(20).select("seq", "title")


@query("""WITH e AS (SELECT user_id AS key, event_id AS seq, event_type NOT IN (SELECT min(event_type) FROM events) AS ok FROM events),
  l AS (SELECT key, max(seq) FILTER (ok) AS last_ok, count(*) FILTER (NOT ok) AS total_fails, count(*) FILTER (ok) AS total_ok FROM e GROUP BY key)
  SELECT l.key, coalesce(c.n, 0) AS consecutive_fails, total_fails, total_ok, coalesce(c.n, 0) >= 3 AS open FROM l
  LEFT JOIN (SELECT e.key, count(*) AS n FROM e JOIN l USING (key) WHERE NOT ok AND (last_ok IS NULL OR seq > last_ok) GROUP BY e.key) c ON c.key = l.key""")
def breaker_fold(spark, sf):
    rows = _read(spark, sf, "events")
    bad = rows.agg(F.min("event_type").alias("bad"))
    return ledger.breaker(rows.join(F.broadcast(bad)).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") != F.col("bad")).alias("ok")))


@query("""SELECT coalesce(o.k, n.k) AS key, greatest(o.fails, n.fails) AS fails, coalesce(o.total, 0) + coalesce(n.total, 0) AS total, greatest(o.d, n.d) AS deadline FROM
  (SELECT user_id AS k, count(*) AS total, count(*) % 7 AS fails, max(event_id) AS d FROM events WHERE ts < TIMESTAMP '2024-01-02' GROUP BY 1) o
  FULL JOIN (SELECT user_id AS k, count(*) AS total, count(*) % 5 AS fails, max(event_id) AS d FROM events WHERE ts >= TIMESTAMP '2024-01-02' GROUP BY 1) n ON o.k = n.k""")
def circuit_merge_outer(spark, sf):
    """The first day's history of each user, and that of all days after it."""

    def side(when: str, mod: int) -> DataFrame:
        rows = _read(spark, sf, "events").where(f"ts {when} timestamp_ntz'2024-01-02'")
        return rows.groupBy(F.col("user_id").alias("key")).agg((F.count("*") % mod).alias("fails"), F.count("*").alias("total"), F.max("event_id").alias("deadline"))

    return ledger.merge_histories(side("<", 7), side(">=", 5))


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 400000) ORDER BY c_custkey LIMIT 1""")
def topic_pick(spark, sf):
    """Customers as topics, orders as days: urgent ones are done, dear ones failed too often."""
    topics = _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("seq"))
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "done").otherwise("failed")
    days = _read(spark, sf, "orders").select(F.col("o_custkey").alias("topic_id"), status.alias("status"), F.when(F.col("o_totalprice") > 400_000, 3).otherwise(1).alias("attempts"))
    return ledger.next_topic(topics, days).select("id")


@query("""SELECT p_partkey, i AS scene_number, 10 AS duration_sec, ['Watch', 'Learn', 'Build', 'Share'][(i - 1) % 4 + 1] || ' ' || p_name AS voiceover FROM part, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS i)""")
def storyboard_expand(spark, sf):
    rows = _read(spark, sf, "part").select("p_partkey", F.explode(storyboard.scenes(F.col("p_name"), ["Watch", "Learn", "Build", "Share"])).alias("s"))
    return rows.select("p_partkey", "s.*")


@query("""SELECT p_partkey, array_to_string(list_transform(range(1, CAST(ceil((p_size + 8) / 8.0) AS INTEGER) + 1), lambda i: CASE WHEN i <= 3 THEN p_brand || '-' || i ELSE 'continue' END), '|') AS plan FROM part""")
def extend_plan(spark, sf):
    prompts = F.array(*(F.concat("p_brand", F.lit(f"-{i}")) for i in (1, 2, 3)))
    return _read(spark, sf, "part").select("p_partkey", F.array_join(storyboard.extend_plan(prompts, F.col("p_size") + 8, F.lit(8), "continue"), "|").alias("plan"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'no video stream' WHEN p_size % 7 = 0 THEN 'no audio stream'
  WHEN NOT (720.0 + p_size * 4) / 1280 BETWEEN 0.5325 AND 0.5925 THEN 'aspect' WHEN NOT p_size + 30 BETWEEN 43 AND 53 THEN 'duration' END AS error FROM part""")
def final_eval(spark, sf):
    size = F.col("p_size")
    error = storyboard.final_error(size % 5 != 0, size % 7 != 0, 720 + size * 4, F.lit(1280), size + 30, F.lit(48))
    return _read(spark, sf, "part").select("p_partkey", error.alias("error"))


def _neighbours(spark, sf) -> DataFrame:
    """Each document's whole text beside that of the next id."""
    d = _docs(spark, sf).select("doc_id", F.col("text").alias("a"))
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")


@query()
def diff_edit_script(spark, sf):
    return _neighbours(spark, sf).select("doc_id", diffing.diff(F.col("a"), F.col("b"), by_line=False).alias("script"))


@query()
def unified_diff(spark, sf):
    return _neighbours(spark, sf).select("doc_id", diffing.render_unified(F.col("a"), F.col("b")).alias("patch"))


@query()
def similarity_lcs(spark, sf):
    return _neighbours(spark, sf).select("doc_id", F.round(diffing.similarity(F.col("a"), F.col("b"), by_line=False), 9).alias("similarity"))


def _stream(spark, sf) -> DataFrame:
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf):
    return streaming.run_available(streaming.daily_counts(_stream(spark, sf), "ts", "event_type"), "daily", "complete")


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY ALL")
def stream_ttl_dedup(spark, sf):
    rows = streaming.ttl_dedup(_stream(spark, sf).select("user_id", "ts"), "user_id", "ts", "60 days")
    return streaming.run_available(rows, "dedup", "append").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events))
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    return streaming.run_available(streaming.sessions(_stream(spark, sf), "user_id", "ts", "3 hours"), "sessions", "complete")


#: Labels of places, each with whether it ties a role to a country outside: as the rule has it, not as the lists here do.
PLACES = [
    ("Tokyo, Japan", True), ("Zurich", True), ("Hyderabad", True), ("Lima, Peru", True), ("Greater Rio de Janeiro", True), ("Bogotá", True), ("Remote - Canada", True), ("Berlin, Germany", True),
    ("Singapore", False), ("Dubai, UAE", False), ("Remote", False), ("Freelance, Paris", False), ("Worldwide (London)", False), ("Karachi", False), ("Ukiah", False), ("Istanbul, Türkiye", False), ("", False),
]


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


@query(f"SELECT doc_id AS seq, {_sql_list(p for p, _ in PLACES)}[doc_id % {len(PLACES)} + 1] AS place, {_sql_list(r for _, r in PLACES)}[doc_id % {len(PLACES)} + 1] = 'True' AS restricted FROM documents")
def law_foreign(spark, sf):
    place = F.element_at(F.array(*(F.lit(p) for p, _ in PLACES)), (F.col("doc_id") % len(PLACES) + 1).cast("int"))
    return _docs(spark, sf).select(F.col("doc_id").alias("seq"), place.alias("place")).withColumn("restricted", law.foreign_restricted(F.col("place")))


@query(f"""WITH {POSTINGS_SQL} SELECT seq, CASE location WHEN 'Remote' THEN NULL WHEN 'Berlin, Germany' THEN 'Berlin' WHEN 'Hybrid - London, UK' THEN 'Hybrid' WHEN 'San Francisco, CA' THEN 'San Francisco' WHEN 'On-site, Lahore' THEN 'On' END AS city,
  CASE location WHEN 'San Francisco, CA' THEN 'CA' WHEN 'Hybrid - London, UK' THEN 'London' WHEN 'On-site, Lahore' THEN 'site' END AS state,
  CASE location WHEN 'Berlin, Germany' THEN 'Germany' WHEN 'Worldwide' THEN 'Worldwide' WHEN 'San Francisco, CA' THEN 'United States' WHEN 'Hybrid - London, UK' THEN 'UK' WHEN 'On-site, Lahore' THEN 'Lahore' END AS country,
  location IN ('Remote', 'Worldwide') AS is_remote FROM postings""")
def law_hierarchy(spark, sf):
    return postings(spark, sf).select("seq", law.hierarchy(F.col("location")).alias("h")).select("seq", "h.*")


@query(f"""WITH {POSTINGS_SQL} SELECT seq, CASE WHEN location = '' THEN CASE WHEN contains(title, '(Remote)') THEN 'remote' ELSE 'unknown' END WHEN location IN ('Remote', 'Worldwide') THEN 'remote'
  WHEN contains(title, '(Remote)') AND location = 'Berlin, Germany' THEN 'remote' WHEN location = 'Hybrid - London, UK' THEN 'hybrid' ELSE 'onsite' END AS kind FROM postings""")
def law_classify(spark, sf):
    return postings(spark, sf).select("seq", law.classify(F.col("location"), F.col("title")).alias("kind"))


@query()
def law_verdicts(spark, sf):
    found = law.verdicts(*(F.col(c) for c in ("location", "title", "description", "source")))
    return postings(spark, sf).select("seq", found.alias("found")).select("seq", *(F.col(f"found.{stage}.reason").alias(stage) for stage in law.STAGES))


@query(f"""WITH {POSTINGS_SQL}, p AS (WITH {SALARY_SQL})
SELECT seq, CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN '' ELSE coalesce(currency, '') || CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL
  THEN CASE WHEN currency = '₹' THEN (salary_min // 100000) || 'L-' || (salary_max // 100000) || 'L' ELSE (salary_min // 1000) || 'k-' || (salary_max // 1000) || 'k' END
  ELSE CASE WHEN currency = '₹' THEN (coalesce(salary_min, salary_max) // 100000) || 'L' ELSE (coalesce(salary_min, salary_max) // 1000) || 'k' END END END AS shown FROM p""")
def salary_format(spark, sf):
    s = postings(spark, sf).select("seq", parse_salary(F.col("salary")).alias("s"))
    return s.select("seq", delivery.salary_text(F.col("s.salary_min"), F.col("s.salary_max"), F.nullif(F.col("s.currency"), F.lit(""))).alias("shown"))


@query("""SELECT p_partkey, platform, p_name || chr(10) || chr(10) || 'Follow.' || chr(10) || chr(10) || tags AS caption FROM part, (VALUES """ + ", ".join(f"('{p}', '{' '.join('#' + t for t in sorted(tags))}')" for p, tags in delivery.HASHTAGS.items()) + ") AS v(platform, tags)")
def captions_cross(spark, sf):
    return delivery.captions(_read(spark, sf, "part").select("p_partkey", "p_name"), F.col("p_name"), "Follow.").select("p_partkey", "platform", "caption")


@query("""SELECT week, day, CAST(sum(n) OVER (PARTITION BY week ORDER BY day) AS BIGINT) AS so_far FROM (SELECT strftime(o_orderdate, '%G-W%V') AS week, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL)""")
def weekly_counter(spark, sf):
    rows = _read(spark, sf, "orders").select(F.col("o_orderdate").alias("day"), F.lit(1).alias("n"))
    return delivery.weekly_counter(rows, "day", "n").select("week", "day", "so_far")


@query("SELECT user_id AS run, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) = 0 AND NOT bool_or(event_type = (SELECT max(event_type) FROM events)) AS outage FROM events GROUP BY 1")
def outage_flag(spark, sf):
    rows = _read(spark, sf, "events")
    best = F.broadcast(rows.agg(F.max("event_type").alias("best")))
    runs = rows.join(best).select(F.col("user_id").alias("run"), (F.col("value") > 100).cast("int").alias("found"), F.when(F.col("event_type") == F.col("best"), "ok").otherwise("failed").alias("outcome"))
    return delivery.outage(runs)


@query(f"WITH {POSTINGS_SQL} SELECT source, seq, CAST(row_number() OVER (PARTITION BY source ORDER BY seq % 7 DESC, seq) AS INTEGER) AS rank FROM postings QUALIFY rank <= 10")
def profile_section_topk(spark, sf):
    rows = postings(spark, sf).select("source", "seq", (F.col("seq") % 7).alias("score"))
    return delivery.profile_sections(rows, "source", "score").select("source", "seq", "rank")


@query("SELECT p_partkey, unnest(CASE WHEN p_partkey % 7 = 4 THEN [p_brand, '#hiring ' || p_brand, '\"we are hiring\" ' || p_brand] ELSE [p_brand] END) AS q FROM part")
def feed_query_expand(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", F.explode(delivery.feed_queries(F.col("p_brand"), F.col("p_partkey") % 7)).alias("q"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS key, l_partkey % 60 AS line FROM lineitem),
  g AS (SELECT *, CASE WHEN line - lag(line) OVER w > 7 OR lag(line) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY key ORDER BY line)),
  h AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY line) AS hunk FROM g)
  SELECT key, CAST(hunk AS BIGINT) AS hunk, greatest(min(line) - 3, 0) AS lo, max(line) + 3 AS hi FROM h GROUP BY key, hunk""")
def diff_hunks_window(spark, sf):
    lines = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_partkey") % 60).alias("line")).distinct()
    return delivery.hunk_spans(lines)


from tarnmill import law_queries, record_queries, storage_queries  # noqa: E402, F401
