"""More queries with their oracles: rules, profiles, the gate chain, deliveries, circuits, courses, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnmill.functions import dates, diffing, text
from tarnmill.operators import chain, circuits, dedup, deliveries, delivery, law, profiles
from tarnmill.operators.gates import first_failure
from tarnmill.plans import course
from tarnmill.plans.postings import POSTINGS_SQL, postings
from tarnmill.registry import POSTED_SQL, _docs, _neighbours, _read, _sql_list, _today, query
from tarnmill.sources import scans


def _picked(values, by: str = "doc_id"):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def _pick_sql(values, by: str = "doc_id") -> str:
    return f"{_sql_list(values)}[{by} % {len(values)} + 1]"


def _cases(name: str, pairs: list, function) -> None:
    """A query over ``documents`` that picks one of some texts for each row, beside what the rule says of each by hand."""
    values, wanted = [p for p, _ in pairs], [w for _, w in pairs]
    kind = " = 'True'" if isinstance(wanted[0], bool) else ""

    def run(spark, sf):
        return _docs(spark, sf).select(F.col("doc_id").alias("seq"), _picked(values).alias("text")).withColumn("found", function(F.col("text")))

    run.__name__ = name
    query(f"SELECT doc_id AS seq, {_pick_sql(values)} AS text, {_pick_sql(wanted)}{kind} AS found FROM documents")(run)


LANGUAGE_CASES = [
    ("Fluent German required", True), ("JLPT N2 or above", True), ("UI polish and care", False), ("Polish speaking support", True), ("fluent in Polish", True), ("You speak Arabic", True),
    ("Arabic cuisine fans", False), ("Turkish is a must", True), ("a Turkish bath", False), ("proficiency in Portuguese", True), ("business level Thai", True), ("Urdu fluency", True), ("native or bilingual Arabic", True), ("English only", False), ("Français courant", True),
]
HYBRID_CASES = [
    ("Hybrid role in Lahore", True), ("hybrid search and RAG", False), ("Hybrid cloud engineer", True), ("a hybrid of two teams", False), ("Workplace model: hybrid", True), ("3 days per week in the office", True),
    ("return to office", True), ("hybrid, with commute", True), ("hybrid", False), ("hybrid - remote", True), ("On-site / hybrid", True), ("RTO, then hybrid", True), ("hybrid models for search", False), ("Remote", False),
]
OPEN_CASES = [
    ("Work from anywhere", True), ("work from anywhere in the UK", False), ("Work from anywhere in the world", True), ("impact worldwide", False), ("The role is remote worldwide", True), ("our tooling is remote worldwide", False),
    ("Hire remotely worldwide", True), ("No location requirement", True), ("clients worldwide", False), ("candidates worldwide welcome", True), ("fully remote worldwide", True), ("", False),
]
HOSTS = [("example.org", True), ("a-b.example", True), ("-a.example", False), ("a..b", False), ("127.0.0.1", False), ("x_y.example", False), ("bücher.example", True), ("a." + "b" * 64, False), ("", False), ("localhost", True)]
FEED_CASES = [
    ("Remote role, onsite in week one", "Hybrid"), ("Remote from Germany or the UK", "Germany (Remote)"), ("UK candidates, remote", "UK (Remote)"), ("Remote, based in New Zealand, near Peru", "New Zealand (Remote)"),
    ("Remote for US citizens", "USA (Remote)"), ("remote, must be in Texas", "USA (Remote)"), ("Offices in Texas, remote", "Remote"), ("Remote, based in Lahore", "Hybrid"), ("Remote worldwide, team based in Lahore", "Remote"),
    ("WFH, friends in Karachi", "Remote"), ("A lab in Dubai", "Hybrid"), ("Hybrid days", "Hybrid"), ("Contractor in Germany, worldwide", "Remote"), ("We look for people", ""), ("", ""),
]
HIRING_CASES = [
    ("We are hiring ML engineers", True), ("A deep dive into attention", False), ("Role: data engineer", True), ("My role in the talk", False), ("Send your CV", True), ("3 vacancies", True), ("seeking a lead", True), ("Hired hands", False), ("join our team", True), ("", False),
]
_cases("law_language", LANGUAGE_CASES, law.language_restricted)
_cases("law_hybrid", HYBRID_CASES, law.hybrid_work)
_cases("law_worldwide", OPEN_CASES, law.strongly_open)
_cases("feed_place", FEED_CASES, law.feed_place)
_cases("feed_hiring", HIRING_CASES, law.hiring_post)
_cases("hostname_valid", HOSTS, text.valid_hostname)
_cases("job_url_valid", [("https://jobs.example/1", True), (" HTTP://x.example", True), ("ftp://x.example", False), ("https://www.linkedin.com/in/someone", False), ("", False)], text.valid_job_url)
_cases("shell_quoted", [("a b", "a b"), ("it's", "it'\\''s"), ("''", "'\\'''\\''")], text.shell_quoted)
_cases("embedded_json", [('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('say {"b": {"c": 2}} now', '{"b": {"c": 2}}'), ("{}", "{}")], text.embedded_json)
_cases("badge_text", [("Acme · Posted 3 days ago · apply", "Posted 3 days ago"), ("Just posted", "Just posted"), ("new 30+ days ago", "30+ days ago"), ("5h ago", "5h ago")], scans.badge)
_cases("marker_status", [("uploaded", "done"), ('{"status": "pending"}', "pending"), ('{"status": "failed", "n": 2}', "failed"), ('{"n": 1}', "done")], deliveries.marker_status)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Lahore' WHEN doc_id % 4 = 1 THEN 'Lahore (Remote)' WHEN doc_id % 4 = 2 THEN 'Lahore' ELSE '(Remote)' END AS location FROM documents""")
def remote_mark(spark, sf):
    card = _picked(["an office job", "remote work", "remote or hybrid", "Remote!"])
    place = F.when(F.col("doc_id") % 4 == 3, F.lit("")).otherwise("Lahore")
    return _docs(spark, sf).select("doc_id", scans.marked_location(place, card).alias("location"))


@query("SELECT event_id, CAST(CASE WHEN value / 20 <= 1.25 THEN 1 ELSE greatest(1, least(14, round_even(value / 20, 0))) END AS INTEGER) AS days FROM events")
def day_span(spark, sf):
    return _read(spark, sf, "events").select("event_id", scans.day_span(F.col("value") / 20).alias("days"))


@query("""SELECT p_partkey, t.i + 1 AS place, p_name || ' ' || (t.i + 1) AS title, CASE WHEN t.i = 1 THEN 'Unknown' ELSE p_brand || ' & Co' END AS company, 'Town ' || p_size AS location, 'https://x.example/j-' || p_partkey AS url
  FROM part, (SELECT unnest([0, 1]) AS i) t""")
def page_cards(spark, sf):
    def card(i: int):
        company = F.lit("") if i == 2 else F.concat(F.lit("<h4>"), "p_brand", F.lit(" &amp; Co</h4>"))
        return F.concat(F.lit("<li class=c><a href=\"https://x.example/j-"), F.col("p_partkey").cast("string"), F.lit('?ref=z"><h3 class="t"> '), "p_name", F.lit(f" {i}\n</h3></a>"), company, F.lit('<span class="job-location">Town '), F.col("p_size").cast("string"), F.lit("</span></li>"))

    page = F.concat(F.lit('<a href="/menu">Menu</a><ul>'), card(1), card(2), F.lit("<li><h3>No link</h3></li></ul>"))
    cards = _read(spark, sf, "part").select("p_partkey", F.posexplode(scans.page_cards(page)).alias("place", "c"))
    return cards.select("p_partkey", (F.col("place") + 1).alias("place"), "c.title", "c.company", "c.location", "c.url")


@query(f"WITH {POSTINGS_SQL} SELECT seq, CASE WHEN posted_date LIKE '____-__-__T%' THEN CAST(substr(replace(posted_date, 'T', ' '), 1, 19) AS TIMESTAMP) END AS posted FROM postings")
def posted_datetime_parse(spark, sf):
    return postings(spark, sf).select("seq", dates.posted_datetime(F.col("posted_date")).alias("posted"))


NEXT_SQL = "(CASE WHEN date_trunc('day', ts) + INTERVAL 9 HOUR <= ts THEN date_trunc('day', ts) + INTERVAL 33 HOUR ELSE date_trunc('day', ts) + INTERVAL 9 HOUR END)"


@query(f"SELECT event_id, {NEXT_SQL} + INTERVAL 1 DAY * (CASE isodow({NEXT_SQL}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END) AS at FROM events")
def next_start(spark, sf):
    return _read(spark, sf, "events").select("event_id", dates.next_start(F.col("ts").cast("timestamp")).alias("at"))


@query("""SELECT event_id, CASE WHEN date_trunc('day', ts + INTERVAL 5 HOUR) + INTERVAL 18 HOUR <= ts + INTERVAL 5 HOUR THEN date_trunc('day', ts + INTERVAL 5 HOUR) + INTERVAL 42 HOUR
  ELSE date_trunc('day', ts + INTERVAL 5 HOUR) + INTERVAL 18 HOUR END - INTERVAL 5 HOUR AS at FROM events""")
def publish_at(spark, sf):
    return _read(spark, sf, "events").select("event_id", dates.publish_at(F.col("ts").cast("timestamp"), "Asia/Karachi", 18).alias("at"))


@query("SELECT event_id, CASE WHEN floor(value * 3600) < 3600 AND isodow(ts) < 6 THEN 'recent' WHEN floor(value * 3600) > 72 * 3600 AND isodow(ts) IN (2, 3, 4) THEN 'stale' ELSE 'ok' END AS state FROM events")
def run_freshness(spark, sf):
    """Runs at noon, after as many hours as an event's value."""
    rows = _read(spark, sf, "events").withColumn("now", F.date_trunc("day", F.col("ts").cast("timestamp")) + F.make_dt_interval(hours=F.lit(12)))
    rows = rows.withColumn("last", F.timestamp_seconds(F.unix_timestamp("now") - F.floor(F.col("value") * 3600)))
    return rows.select("event_id", dates.freshness(F.col("last"), F.col("now"), dates.fetch_window(F.col("now"))["reason"]).alias("state"))


@query("SELECT p_partkey, CAST(ceil((p_size + 1) / 8.0) * 8 AS BIGINT) AS seconds, greatest(86400, (p_size + 1) * 7200) AS lookback FROM part")
def whole_clips(spark, sf):
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    rows = _read(spark, sf, "part").withColumn("after", F.timestamp_seconds(1_700_000_000 - (F.col("p_size") + 1) * 7200))
    return rows.select("p_partkey", dates.whole_clips(F.col("p_size") + 1, F.lit(8)).alias("seconds"), dates.lookback_seconds(at, F.col("after")).alias("lookback"))


@query(f"WITH {POSTINGS_SQL} SELECT seq FROM postings WHERE NOT (company IN ('Unknown', 'N/A', 'n/a', '') AND coalesce(description, '') = '')")
def quality_gate(spark, sf):
    quality = dict(chain.row_gates([ENGINEER], F.timestamp_seconds(F.lit(0))))["quality"]
    return postings(spark, sf).where(quality).select("seq")


ENGINEER = profiles.Profile(
    name="engineer", display="Engineer", keywords=("machine learning", "ai"), threshold=80, rejects=(r"\bsales\b",), stacks=(r"\bbackend\b",), bonus=("the ",), bonus_points=5,
    tier1=((r"\bml\b|machine learning", "Core", 90), (r"\bllm\b", "Language models", 98)), tier2=((r"\bai\b", "Applied", 85),), context=("nlp", "pytorch"),
    generic=r"\bscientist\b", generic_words=("data", "remote", "the "), generic_count=2, generic_any=("data",),
)
RESEARCHER = profiles.Profile(name="researcher", keywords=("research",), tier1=(("researcher", "Research", 75),), tier2=(("scientist|engineer", "Near research", 72),), context=("zzz",), threshold=75)
HAS_THE = "(contains(lower(title), 'the ') OR contains(lower(description), 'the '))"
ENGINEER_SQL = f"""CASE WHEN regexp_matches(lower(title), '\\bsales\\b') OR regexp_matches(lower(title), '\\bbackend\\b') THEN 0 WHEN regexp_matches(lower(title), '\\bml\\b|machine learning') THEN CASE WHEN {HAS_THE} THEN 95 ELSE 90 END
  WHEN regexp_matches(lower(title), '\\bllm\\b') THEN CASE WHEN {HAS_THE} THEN 100 ELSE 98 END WHEN regexp_matches(lower(title), '\\bai\\b') THEN CASE WHEN regexp_matches(lower(title || chr(10) || description), 'nlp|pytorch') THEN 85 ELSE 0 END
  WHEN contains(lower(title), 'scientist') AND 1 + contains(lower(title), 'remote')::INT + {HAS_THE}::INT >= 2 THEN 70 ELSE 0 END"""
RESEARCHER_SQL = "CASE WHEN contains(lower(title), 'researcher') THEN 75 WHEN regexp_matches(lower(title), 'scientist|engineer') AND contains(lower(description), 'zzz') THEN 72 ELSE 0 END"
SCORED_SQL = f"scored AS (SELECT *, {ENGINEER_SQL} AS e, {RESEARCHER_SQL} AS r FROM postings)"


@query(f"""WITH {POSTINGS_SQL}, {SCORED_SQL} SELECT seq, (e > 0)::INT + (r > 0)::INT AS n, CASE WHEN e = 0 AND r = 0 THEN NULL WHEN e >= r THEN 'engineer' ELSE 'researcher' END AS best, nullif(greatest(e, r), 0) AS score FROM scored""")
def profile_best(spark, sf):
    rows = postings(spark, sf).withColumn("p", profiles.passing([ENGINEER, RESEARCHER], F.col("title"), F.col("description")))
    return rows.select("seq", F.size("p").alias("n"), F.get("p", F.lit(0))["name"].alias("best"), F.get("p", F.lit(0))["score"].alias("score"))


CHAIN_SQL = f"""ids AS (SELECT *, substr(sha256(lower(url) || '|' || lower(title) || '|' || lower(company)), 1, 16) AS id, {POSTED_SQL} AS posted FROM scored),
judged AS (SELECT *, CASE WHEN e = 0 AND r = 0 THEN 'ai_keyword' WHEN EXPIRED THEN 'expired' WHEN posted < DATE '2026-01-08' THEN 'window' WHEN posted IS NULL THEN 'recency'
  WHEN NOT (e >= 80 OR r >= 75) THEN 'threshold' WHEN company = 'Unknown' AND description = '' THEN 'quality' END AS gate, seq % 500 IN (1, 10) AS seen, seq % 500 IN (2, 6) AS dead FROM ids),
marked AS (SELECT *, min(CASE WHEN gate IS NULL AND NOT dead AND NOT seen THEN seq END) OVER (PARTITION BY id) AS first FROM judged),
final AS (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN seen OR seq > first THEN 'dedup' WHEN dead THEN 'dead_link' END AS verdict FROM marked)
SELECT seq, verdict AS gate, id FROM (SELECT *, count(*) FILTER (verdict IS NULL) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM final) WHERE before < 9"""


def _register_chain() -> None:
    from tarnmill.registry import EXPIRED_SQL

    @query(f"WITH {POSTINGS_SQL}, {SCORED_SQL}, {CHAIN_SQL.replace('EXPIRED', EXPIRED_SQL, 1)}")
    def gate_chain_full(spark, sf):
        """The chain without its fuzzy part; ids of two urls were seen before, two links are dead."""
        rows = postings(spark, sf)
        number = F.col("seq") % 500
        seen = rows.where(number.isin(1, 10)).select(text.posting_id(F.col("url"), F.col("title"), F.col("company"), F.col("source")).alias("id"))
        dead = rows.where(number.isin(2, 6)).select("url")
        out = chain.run(rows, [ENGINEER, RESEARCHER], _today(), F.lit("2026-01-08").cast("timestamp"), seen, dead, cap=9, fuzzy=False)
        return out.select("seq", "gate", "id")


_register_chain()


@query(f"""WITH {POSTINGS_SQL}, t AS (SELECT seq, list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM postings)
SELECT a.seq, round(CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))), 9) AS jaccard FROM t a JOIN t b ON b.seq = a.seq + 1""")
def token_jaccard_pairs(spark, sf):
    rows = postings(spark, sf).select("seq", text.normalize_text(F.col("title")).alias("a"))
    pairs = rows.join(rows.select((F.col("seq") - 1).alias("seq"), F.col("a").alias("b")), "seq")
    return pairs.select("seq", F.round(text.token_jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@query(f"""WITH {POSTINGS_SQL} SELECT seq, array_to_string(list_transform(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE w WHEN 'ml' THEN 'machine learning' WHEN 'ai' THEN 'artificial intelligence'
  WHEN 'nlp' THEN 'natural language processing' WHEN 'llm' THEN 'large language model' WHEN 'swe' THEN 'software engineer' ELSE w END), ' ') AS long FROM postings""")
def abbrev_expand(spark, sf):
    return postings(spark, sf).select("seq", text.expand_abbreviations(text.normalize_text(F.col("title"))).alias("long"))


@query(f"WITH {POSTINGS_SQL} SELECT source, company, job_type, count(*) AS n, min(seq) AS first_seq FROM postings GROUP BY GROUPING SETS ((source), (company), (job_type))")
def digest_grouping_sets(spark, sf):
    rows = postings(spark, sf)
    return rows.groupingSets([[F.col(c)] for c in ("source", "company", "job_type")], "source", "company", "job_type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("SELECT platform, tags FROM (VALUES ('tiktok', '#coding #learning #tech'), ('instagram_reels', '#coding #reels #tech'), ('facebook', '#coding #learning'), ('youtube_shorts', '#coding #shorts #tech')) AS v(platform, tags)")
def hashtags(spark, sf):
    topics = _read(spark, sf, "region").where("r_regionkey = 0").select(F.lit(1).alias("one"))
    return delivery.captions(topics, F.lit(""), "").select("platform", F.regexp_replace("caption", r"^\s+", "").alias("tags"))


@query("SELECT doc_id, array_to_string(['a.example', 'b.example'], ',') AS hosts, trim(substr(regexp_replace('  ' || doc_id || '   x  ', '\\s+', ' ', 'g'), 2, 40)) AS slug FROM documents")
def host_lists(spark, sf):
    raw = F.lit(" A.example, -bad-,b.example ,a.example,,1.2.3.4")
    slug = text.short_slug(F.concat(F.lit("  "), F.col("doc_id").cast("string"), F.lit("   x  ")))
    return _docs(spark, sf).select("doc_id", F.array_join(text.domains(raw), ",").alias("hosts"), slug.alias("slug"))


@query("""SELECT p_partkey, array_to_string(CASE WHEN len(w) > 0 THEN w ELSE ['coding'] END, ' ') AS words FROM (SELECT p_partkey, list_concat(list_filter(string_split(replace(p_name, '-', ' '), ' '), lambda x: length(x) > 2),
  list_filter(string_split(p_type, ' '), lambda x: length(x) > 2)[1:3]) AS w FROM part)""")
def topic_keywords(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", F.array_join(text.topic_keywords(F.col("p_name"), F.col("p_type")), " ").alias("words"))


@query("SELECT a.doc_id, a.text AS a, b.text AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL")
def diff_rebuild(spark, sf):
    """Both sides, put together again from the script by line."""
    rows = _neighbours(spark, sf).where("a is not null and b is not null").withColumn("s", diffing.diff(F.col("a"), F.col("b")))
    side = lambda other: F.array_join(F.transform(F.filter("s", lambda r: r["op"] != other), lambda r: r["text"]), "")
    return rows.select("doc_id", side("insert").alias("a"), side("delete").alias("b"))


@query("""SELECT o_custkey AS key, c AS channel FROM (SELECT DISTINCT o_custkey FROM orders) , (SELECT unnest(['mail', 'chat']) AS c)
  WHERE NOT (c = 'mail' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))""")
def deliveries_due(spark, sf):
    """Every customer with an order is due by mail and chat today, but for mail where an urgent order has sent it."""
    orders = _read(spark, sf, "orders").select(F.col("o_custkey").alias("key"), "o_orderpriority")
    rows = orders.select("key").distinct().withColumn("channel", F.explode(F.array(F.lit("mail"), F.lit("chat"))))
    ledger = orders.where("o_orderpriority = '1-URGENT'").select("key", F.lit("mail").alias("channel"), F.lit("2026-01-15").alias("period")).distinct()
    return deliveries.due(rows, ledger, F.lit("2026-01-15")).select("key", "channel")


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderstatus <> 'P' AND o_totalprice > 100000 THEN 'done' ELSE 'stays' END AS state FROM orders")
def letters_replay(spark, sf):
    letters = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "drop").otherwise("sheet").alias("action"), F.array("o_orderkey").alias("rows"), "o_totalprice")
    done, stay = deliveries.replay(letters, letters.select("seq", (F.col("o_totalprice") > 100_000).alias("ok")), ["sheet"])
    return done.select("seq", F.lit("done").alias("state")).unionByName(stay.select("seq", F.lit("stays").alias("state")))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'skip' WHEN o_orderstatus = 'P' THEN 'refuse' WHEN o_orderkey % 5 >= 3 THEN 'give_up' ELSE 'upload' END AS step FROM orders""")
def upload_steps(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "pending")
    return _read(spark, sf, "orders").select("o_orderkey", deliveries.upload_step(status, F.col("o_orderkey") % 5).alias("step"))


@query("""SELECT l_orderkey AS key, string_agg('file ''' || l_partkey || '''\\''''' || l_linenumber || '.mp4''', chr(10) ORDER BY l_linenumber, l_partkey) AS manifest FROM lineitem GROUP BY 1""")
def concat_manifest(spark, sf):
    path = F.concat(F.col("l_partkey").cast("string"), F.lit("'"), F.col("l_linenumber").cast("string"), F.lit(".mp4"))
    place = F.struct("l_linenumber", "l_partkey")
    return deliveries.concat_manifest(_read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), place.alias("place"), path.alias("path")))


@query("""SELECT split_part(key, ':', 1) AS source, min_by(key, seq) AS key FROM (SELECT n_nationkey AS seq, r_name || ':' || n_name AS key FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE seq % 4 <> 1 GROUP BY 1""")
def circuit_keys_semi(spark, sf):
    """Nations as domains of their regions; the circuits of a quarter of them are open now."""
    nations, regions = _read(spark, sf, "nation"), _read(spark, sf, "region")
    keys = nations.join(F.broadcast(regions), nations["n_regionkey"] == regions["r_regionkey"]).select(circuits.composite(F.col("r_name"), F.col("n_name")).alias("key"), F.col("n_nationkey").alias("seq"))
    table = keys.select("key", F.when(F.col("seq") % 4 == 1, 100.0).otherwise(F.when(F.col("seq") % 4 == 2, 50.0)).alias("open_until"))
    return circuits.first_available(keys, table, F.lit(50.0))


@query("SELECT count(*) AS circuits, count(*) FILTER (d > 300) AS open, sum(f) AS fails, sum(o) AS ok FROM (SELECT user_id, max(value) AS d, count(*) FILTER (value > 50) AS f, count(*) FILTER (value <= 50) AS o FROM events GROUP BY 1)")
def circuit_summary(spark, sf):
    rows = _read(spark, sf, "events").groupBy("user_id").agg(F.max("value").alias("open_until"), F.count_if(F.col("value") > 50).alias("total_fails"), F.count_if(F.col("value") <= 50).alias("total_ok"))
    return circuits.summary(rows, F.lit(300.0))


@query("""SELECT CAST(user_id AS VARCHAR) AS source, CASE WHEN bool_or(value > 150) THEN 'ok' ELSE arg_max(CASE WHEN value > 100 THEN 'login' WHEN value > 60 THEN 'timeout' ELSE 'failed' END, event_id) END AS verdict FROM events GROUP BY 1""")
def run_verdicts(spark, sf):
    v = F.col("value")
    outcome = F.when(v > 150, "ok").when(v > 100, "login").when(v > 60, "timeout").otherwise("failed")
    return circuits.run_verdicts(_read(spark, sf, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("seq"), outcome.alias("outcome")))


@query("""WITH e AS (SELECT user_id AS day, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'clip_done' WHEN 2 THEN 'clip_failed' WHEN 3 THEN 'finish' ELSE 'clip_failed' END AS kind, CASE WHEN event_id % 5 IN (1, 2, 4) THEN 'c' || event_id % 40 END AS clip FROM events),
  c AS (SELECT day, clip, bool_or(kind = 'clip_done') AS done, count(*) FILTER (kind = 'clip_failed') AS failed FROM e WHERE clip IS NOT NULL GROUP BY ALL),
  d AS (SELECT day, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done AND failed >= 3) AS exhausted FROM c GROUP BY 1)
  SELECT e.day, 't' || (e.day % 3) AS topic_id, CASE arg_max(kind, seq) FILTER (kind IN ('start', 'finish')) WHEN 'start' THEN 'in_progress' WHEN 'finish' THEN 'done' END AS status, count(*) FILTER (kind = 'start') AS attempts,
    coalesce(any_value(d.completed), 0) AS completed, coalesce(any_value(d.exhausted), 0) AS exhausted FROM e LEFT JOIN d ON d.day = e.day GROUP BY e.day""")
def day_lifecycle(spark, sf):
    n = F.col("event_id") % 5
    kind = F.when(n == 0, "start").when(n == 1, "clip_done").when(n == 3, "finish").otherwise("clip_failed")
    clip = F.when(n.isin(1, 2, 4), F.concat(F.lit("c"), (F.col("event_id") % 40).cast("string")))
    topic = F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string"))
    return course.day_states(_read(spark, sf, "events").select(F.col("user_id").alias("day"), F.col("event_id").alias("seq"), kind.alias("kind"), clip.alias("clip"), topic.alias("topic_id")))


@query("SELECT p_partkey, i AS scene_number, CASE WHEN i = 1 THEN p_name WHEN i = 2 THEN 'two' ELSE ['one', 'two', 'three'][(i - 1) % 3 + 1] END AS voiceover FROM part, (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS i)")
def storyboard_assembled(spark, sf):
    """A draft of one scene and a blank one, filled up from a template of three."""
    scene = lambda v: F.struct(v.alias("voiceover"), F.lit("p").alias("prompt"))
    draft, template = F.array(scene(F.col("p_name")), scene(F.lit("  "))), F.array(*(scene(F.lit(v)) for v in ("one", "two", "three")))
    return _read(spark, sf, "part").select("p_partkey", F.explode(course.assembled(draft, template)).alias("s")).select("p_partkey", "s.scene_number", "s.voiceover")


# Records of twelve kinds, sound and broken; the oracle states the outcome of each kind from the rule in words.
PROGRESS = {
    "sound": ("1", "3", "https://x.example", "https://x.example/e", "2", "16", "60", "8", "True", ["go"], None), "older": ("0", None, "", "http://e", "0", "0", "4", "8", None, ["go"], None),
    "newer": ("2", "3", "u", "e", "2", "16", "60", "8", "no", ["go"], "schema_version"), "version": ("x", "3", "u", "e", "2", "16", "60", "8", "no", ["go"], "schema_version"),
    "urls": ("1", "3", "", None, "2", "16", "60", "8", "no", ["go"], "url"), "counter": (None, "x", "u", "e", "two", "16", "60", "8", "no", ["go"], "counter"), "day": (None, "x", "u", "e", "2", "16", "60", "8", "no", ["go"], "day"),
    "pending": ("1", "0", "u", None, "2", "16", "60", "8", "maybe", ["go"], "pending_extend"), "missing": ("1", "3", "u", "e", None, "16", "60", "8", "1", ["go"], "range"), "target": ("1", "3", "u", "e", "2", "16", "0", "8", "1", ["go"], "range"),
    "blank": ("1", "3", "u", "e", "2", "16", "60", "8", "1", ["go", "  "], "prompts"), "none": ("1", "3", "u", "e", "2", "16", "60", "8", "1", [], "prompts"),
}


@query(f"""SELECT p_partkey, {_sql_list(v[-1] or '-' for v in PROGRESS.values())}[p_partkey % {len(PROGRESS)} + 1] AS error,
  CASE WHEN p_size % 3 = 0 THEN p_size % 9 ELSE greatest(p_size % 9 + CAST(p_partkey % 2 = 0 AS INTEGER), ((p_size % 9) * 8 + (p_size % 3) * 8) // 8) END AS segments FROM part""")
def progress_check(spark, sf):
    """A record of some kind, and the segments of a run whose file has grown by none, one or two clips."""
    names = ("schema_version", "day", "project_url", "edit_url", "segments_done", "duration_s", "target_s", "clip_s", "pending_extend")
    records = [F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(names, v)), F.array(*map(F.lit, v[9])).cast("array<string>").alias("prompts")) for v in PROGRESS.values()]
    record = F.element_at(F.array(*records), (F.col("p_partkey") % len(records) + 1).cast("int"))
    done, size = (F.col("p_size") % 9).cast("long"), F.col("p_size").cast("long")
    segments = course.resumed_segments(done, F.col("p_partkey") % 2 == 0, done * 8, done * 8 + size % 3 * 8, F.lit(8))
    return _read(spark, sf, "part").select("p_partkey", F.coalesce(course.progress_error(record), F.lit("-")).alias("error"), segments.alias("segments"))


@query(f"""WITH {POSTINGS_SQL}, k AS (SELECT *, 'id' || (seq % 700) AS id FROM postings), f AS (SELECT *, min(CASE WHEN NOT (seq % 700 < 50) THEN seq END) OVER (PARTITION BY id) AS first FROM k)
SELECT seq, CASE WHEN seq % 700 < 50 OR seq > first THEN 'exact' ELSE 'not exact' END AS verdict FROM f""")
def dedup_verdicts(spark, sf):
    """Ids recur every 700 rows; fifty of them were seen before."""
    rows = postings(spark, sf).withColumn("id", F.concat(F.lit("id"), (F.col("seq") % 700).cast("string")))
    seen = rows.where("seq % 700 < 50").select("id")
    return dedup.verdicts(rows, seen).select("seq", F.when(F.col("verdict") == "exact", "exact").otherwise("not exact").alias("verdict"))


@query()
def dedup_recents(spark, sf):
    """Postings fetched from a day on, against the names of those before it; of the seen ids some are of the older kind."""
    rows = postings(spark, sf).withColumn("id", text.posting_id(F.col("url"), F.col("title"), F.col("company"), F.col("source")))
    before, batch = (rows.where(c) for c in (F.col("fetched_at") < "2026-01-06", F.col("fetched_at") >= "2026-01-06"))
    seen = before.where("source = 'web'").select("id").union(before.select(dedup.legacy_id(F.col("url"), F.col("title"), F.col("company"))))
    stored = before.where(F.col("company") != "Initech").select("title", "company", F.col("fetched_at").alias("pushed_at"), "seq")
    return dedup.verdicts(batch, seen, recent=dedup.pushed(stored, stored.limit(0).select("seq", "title", "company"), F.current_timestamp())).select("seq", "verdict")


#: Stored postings by hand: url, location, title, description, the engineer's score (-1: none), the flat score (-1: none), the gate that each fails.
DIGEST_CASES = [
    ("https://jobs.example/1", "Remote", "ML Engineer", "", 80, -1, "-"), ("https://jobs.example/1", "Remote", "ML Engineer", "", 79, 99, "threshold"), ("https://jobs.example/1", "Remote", "ML Engineer", "", -1, 69, "threshold"),
    ("https://jobs.example/1", "Remote", "ML Engineer", "", -1, 70, "-"), ("https://jobs.example/1", "Lahore (Remote)", "ML Engineer", "", -1, -1, "-"), ("https://jobs.example/1", "Dubai (Remote)", "ML Engineer", "", -1, -1, "description"),
    ("https://jobs.example/1", "Dubai (Remote)", "ML Engineer", "Anywhere in our zone", 99, -1, "-"), ("https://jobs.example/1", "Remote", "Fluent German developer", "", 99, -1, "location"),
    ("https://il.linkedin.com/jobs/view/1", "Remote", "ML Engineer", "", 99, -1, "portal"), ("ftp://jobs.example/1", "Remote", "ML Engineer", "", 99, -1, "url"), ("", "", "", "", -1, -1, "url"),
]


@query(f"SELECT doc_id AS seq, {_pick_sql([c[-1] for c in DIGEST_CASES])} AS gate FROM documents")
def digest_gate(spark, sf):
    url, place, title, description, own, flat, _ = (_picked(column) for column in zip(*DIGEST_CASES, strict=True))
    scores = F.when(own >= 0, F.array(F.struct(F.lit("engineer").alias("name"), own.alias("score"))))
    rows = _docs(spark, sf).select(F.col("doc_id").alias("seq"), url.alias("url"), place.alias("location"), title.alias("title"), description.alias("description"), scores.alias("scores"), F.when(flat >= 0, flat).alias("score"))
    return rows.select("seq", F.coalesce(first_failure(chain.digest_gates([ENGINEER, RESEARCHER])), F.lit("-")).alias("gate"))
