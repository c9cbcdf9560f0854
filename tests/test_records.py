"""Profiles, the gate chain, duplicates, deliveries, circuits, scans: against plain Python and small tables."""

import difflib
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tarnmill.functions import dates, diffing, text
from tarnmill.operators import chain, circuits, dedup, deliveries, profiles
from tarnmill.plans import course
from tarnmill.sources import scans, state
from tarnmill.streaming import breaker

PROFILE = {
    "name": "p", "keywords": ["k"], "tier1": [["data", "Data", 96]], "tier2": [["engineer", "Near", 80]], "rejects": [r"\bsales\b"], "stacks": [r"\bphp\b"],
    "bonus": ["Spark"], "context": ["python"], "generic": "scientist", "generic_words": ["a1", "b2", "c3"], "generic_any": ["d4"],
}


def test_profile_rules(spark):
    p = profiles.Profile.of(PROFILE)
    cases = [
        ((None, "x"), (False, 0, "Empty title")), (("Sales of data", ""), (False, 0, "Rejected (blacklisted_role: sales)")), (("PHP data", ""), (False, 0, "Rejected (unrelated_stack: php)")),
        (("Data lead", ""), (True, 96, "Data (96%)")), (("Data lead", "we use SPARK"), (True, 100, "Data (100%)")), (("Engineer", "java"), (False, 0, "Rejected (Technical role lacking core stack context)")),
        (("Engineer", "Python"), (True, 80, "Near (80%)")), (("Scientist", "a1 b2 d4"), (True, 70, "Generalist fallback (70%)")), (("Scientist", "a1 b2"), (False, 0, "Rejected (Does not match p profile)")),
        (("Scientist", "a1 d4"), (False, 0, "Rejected (Does not match p profile)")),
    ]
    df = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "k int, t string, d string").select("k", profiles.match(p, F.col("t"), F.col("d"), F.array(F.lit("tag"))).alias("m"))
    assert [tuple(r.m) for r in df.orderBy("k").collect()] == [w for _, w in cases]
    q = profiles.Profile.of(PROFILE | {"name": "q", "threshold": 99})
    row = spark.range(1).select(profiles.passing([p, q], F.lit("data"), F.lit("")).alias("a"), *(profiles.meets_threshold(F.lit(n), F.lit(s), [p, q]).alias(f"{n}{s}") for n, s in (("p", 70), ("q", 98), ("z", 70), ("z", 69)))).first()
    assert [x.name for x in row.a] == ["p", "q"] and tuple(row)[1:] == (True, False, True, False)


@pytest.mark.parametrize("change", [{"name": " "}, {"keywords": []}, {"tier1": []}, {"tier2": [["a", "b", 101]]}, {"rejects": ["("]}, {"colour": 1}])
def test_malformed_profiles(change):
    with pytest.raises(ValueError):
        profiles.Profile.of(PROFILE | change)


def greedy(rows, threshold=0.85):
    """The rule in plain Python: in order, a row goes if it is alike a kept one before it."""
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    kept, out = [], []
    for seq, title, company in rows:
        if company and title and any(ratio(company, c) >= threshold and dedup.title_similarity(title, t, dedup._written_out(title), dedup._written_out(t)) >= threshold for t, c in kept):
            continue
        out.append(seq)
        if company and title:
            kept.append((title, company))
    return out


def test_fuzzy_against_plain_python(spark):
    rng = random.Random(3)
    words = ["ml", "engineer", "machine", "learning", "senior", "data", "ai", "lead", "scientist"]
    names = ["acme corp", "acme corps", "acme corporation", "globex", "globex inc", "ab", "abc", "initech", ""]
    rows = []
    for k in range(90):
        title = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 4)))
        if rng.random() < 0.4 and rows:
            title = rows[rng.randrange(len(rows))][1]
            at = rng.randrange(len(title) + 1)
            title = " ".join((title[:at] + rng.choice("xyz") + title[at:]).split())
        rows.append((k, title, rng.choice(names)))
    got = dedup.fuzzy_first(spark.createDataFrame(rows, "seq long, title string, company string"))
    assert sorted(r.seq for r in got.collect()) == greedy(rows)


def test_rounds_of_a_chain(spark):
    """With A~B, B~C and not A~C the result is A and C."""
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 1), (5, 4)], "seq long, earlier long")
    assert sorted(r.seq for r in dedup.first_without_alike(edges).collect()) == [2, 4, 5]


def test_chain_order_and_cap(spark):
    cols = "seq long, source string, title string, company string, url string, location string, salary string, posted_date string, description string, job_type string"
    base = ("Data lead", "Acme", "https://x.example/1", "Remote", "$1k", "2026-01-14", "text", "full")
    rows = [(1, "s", *base), (2, "s", *base), (3, "s", "Data lead", "Acme", "https://x.example/3", *base[3:]), (4, "s", "Cook", *base[1:]), (5, "t", "Data head", "Globex", "ftp://x", *base[3:]), (6, "t", "Data old", "Globex", "https://x.example/6", "Remote", "", "2025-01-01", "", ""), (7, "t", "Data x", "Unknown", "https://x.example/7", "Remote", None, "today", None, None), (8, "t", "Data filled", "G", "https://x.example/8", "", "", "", "", ""), (9, "t", "Data none", "G", "https://x.example/9", "", "", "soon", "", "")]
    p = profiles.Profile.of(PROFILE)
    none, dead = spark.createDataFrame([], "id string"), spark.createDataFrame([("https://x.example/1",)], "url string")
    args = (spark.createDataFrame(rows, cols), [p], F.lit("2026-01-15").cast("date"), F.lit("2026-01-08").cast("timestamp"))
    gates = {r.seq: r.gate for r in chain.run(*args, none, dead, fuzzy=False).collect()}
    assert gates == {1: "dead_link", 2: "dead_link", 3: None, 4: "ai_keyword", 5: "url", 6: "window", 7: "quality", 8: "expired", 9: "recency"}
    gates = {r.seq: r.gate for r in chain.run(*args, none, dead.limit(0)).collect()}
    assert (gates[1], gates[2], gates[3]) == (None, "dedup", "dedup")
    assert {r.seq for r in chain.run(*args, none, dead.limit(0), cap=1, fuzzy=False).collect() if r.source == "s"} == {1}
    seen = chain.run(*args, none, dead.limit(0), fuzzy=False).where("seq = 1").select("id")
    assert {r.seq: r.gate for r in chain.run(*args, seen, dead, fuzzy=False).collect()}[2] == "dedup"


def test_ids(spark):
    rows = [("https://www.indeed.com/x?a=1&jk=ab12&b", "indeed", "https://www.indeed.com/viewjob?jk=ab12"), ("https://a.example/?jk=ab12", "indeed", "https://www.indeed.com/viewjob?jk=ab12"), ("https://a.example/?id=1", "x", "https://a.example/?id=1"), ("https://glassdoor.com/?jobListingId=77", None, "https://www.glassdoor.com/job-listing/?jl=77"), (None, "indeed", ""), ("https://indeed.com/", "indeed", "https://indeed.com/")]
    df = spark.createDataFrame(rows, "u string, s string, want string")
    assert all(r.got == r.want for r in df.select("want", text.canonical_url(F.col("u"), F.col("s")).alias("got")).collect())
    with pytest.raises(Exception, match="not a source name"):
        spark.range(1).select(text.session_name(F.lit("../x"))).collect()


def test_deliveries(spark):
    sent = []

    def post(rows):
        sent.append(len(rows))
        if any(r["key"] == 3 for r in rows):
            raise RuntimeError("no")

    out = {r.key: (r.delivered, r.tries) for r in deliveries.send(spark.range(5).withColumnRenamed("id", "key").coalesce(1), post, batch=2, attempts=2, backoff_s=0).collect()}
    assert out == {0: (True, 1), 1: (True, 1), 2: (False, 2), 3: (False, 2), 4: (True, 1)}
    ledger = spark.createDataFrame([(1, "mail", "2026-01-14"), (1, "mail", "2026-01-01")], "key long, channel string, period string")
    rows = spark.createDataFrame([(1, "mail"), (1, "chat")], "key long, channel string")
    assert [r.channel for r in deliveries.due(rows, ledger, F.lit("2026-01-14")).collect()] == ["chat"]
    after = deliveries.recorded(ledger, deliveries.due(rows, ledger, F.lit("2026-01-14")), F.lit("2026-01-14"))
    assert sorted(map(tuple, after.collect())) == [(1, "chat", "2026-01-14"), (1, "mail", "2026-01-14")]
    assert [r.channel for r in deliveries.pending_channels(rows.select("channel"), ledger, F.lit("2026-01-14")).collect()] == ["chat"]
    counts = spark.createDataFrame([("source", "a", 2, 5), ("source", "b", 3, 1), ("source", "c", 2, 0)], "dimension string, value string, n long, first_seq long")
    assert deliveries.report(counts, "Week").first().markdown == "# Week\n\n## source\n\n- b: 3\n- c: 2\n- a: 2"
    assert [r.seq for r in deliveries.bounded_letters(spark.range(9).withColumnRenamed("id", "seq"), 2).collect()] == [8, 7]
    now = F.lit("2026-01-15 09:00:00").cast("timestamp")
    assert spark.range(1).select(*(deliveries.catch_up(F.lit(d).cast("date"), now).alias(str(d)) for d in ("2026-01-14", "2026-01-15", None))).first()[:] == (True, False, True)
    doc = spark.range(1).select(deliveries.seo_document(F.lit("word " * 30), F.lit("h"), F.array(F.lit("a"), F.lit("a")), F.lit("t")).alias("d")).first().d
    assert '"tags":["a"]' in doc and len(doc.split('"')[3]) < 100


def test_circuits(spark):
    table = spark.createDataFrame([("a:x", 9.0, 1, 2), ("b", None, 3, 4)], "key string, open_until double, total_fails long, total_ok long")
    known = spark.createDataFrame([("a",)], "source string")
    assert [r.key for r in circuits.pruned(table, known).collect()] == ["a:x"]
    assert tuple(circuits.summary(table, F.lit(5.0)).first()) == (2, 1, 4, 6)
    assert {r.open_until for r in circuits.reset(table).collect()} == {None}
    assert [r.key for r in circuits.available(table.select("key"), table, F.lit(5.0)).collect()] == ["b"]


def test_course(spark):
    rows = [(1, 1, "start", None, "t"), (1, 2, "clip_failed", "c", None), (1, 3, "clip_failed", "c", None), (1, 4, "clip_failed", "c", None), (1, 5, "fail", None, None), (1, 6, "clip_done", "d", None)]
    r = course.day_states(spark.createDataFrame(rows, "day int, seq int, kind string, clip string, topic_id string")).first()
    assert tuple(r) == (1, "t", "failed", 1, 1, 1)
    one = spark.range(1).select(course.int_map(F.lit('{"a": 1, "b": "x", "c": 2}')).alias("m"), course.int_map(F.lit("no")).alias("n"), course.planner(F.lit("k"), F.lit(True), F.lit(False)).alias("p"), course.planner(F.lit(""), F.lit(True), F.lit(True)).alias("q")).first()
    assert one.m == {"a": 1, "c": 2} and one.n == {} and (one.p, one.q) == ("model", "error")
    with pytest.raises(Exception, match="shorter than its record"):
        spark.range(1).select(course.resumed_segments(F.lit(2), F.lit(False), F.lit(20), F.lit(17), F.lit(8))).collect()
    topics = spark.createDataFrame([("a", "Sorting things", 1), ("b", "More sorting", 0)], "id string, title string, seq int")
    wanted = spark.createDataFrame([("a",), ("sorting",)], "key string")
    assert {r.key: r.id for r in course.topic_by(topics, wanted).collect()} == {"a": "a", "sorting": "b"}
    scenes = F.array(F.struct(F.lit(1).alias("scene_number"), F.lit("a secret").alias("voiceover")))
    assert spark.range(1).select(course.screened(scenes, F.create_map(F.lit("x"), F.lit("You are now"))).alias("s")).first().s == ["scene 1: possible secret ('secret')", "caption x: possible prompt injection ('you are now')"]


def test_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Job ID,x\n1,\"a\nb\"\n", encoding="utf-8")
    rows = scans.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["Job ID", "x"] and rows.first().x == "a\nb"
    (tmp_path / "t.json").write_text('[{"id": "a", "title": "b"}]')
    assert scans.topic_list(spark, str(tmp_path / "t.json")).first().title == "b"
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        scans.topic_list(spark, str(tmp_path / "e.json"))
    for d in ("day_1", "day_2"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "final.mp4").write_bytes(b"x")
    assert scans.latest_finished(spark, str(tmp_path)).endswith("day_2/final.mp4")
    assert scans.load_plugins(["json", "no_such_module_here"]) == ["json"]
    probe = '{"format": {"duration": "48.2"}, "streams": [{"codec_type": "video", "width": 720, "height": 1280}]}'
    r = spark.range(1).select(scans.probed(F.lit(probe)).alias("p"), scans.probed(F.lit("no")).alias("n"), scans.id_suffix(F.lit("https://x/job-12?a=3")).alias("i"), scans.drifted(F.lit("x" * 6000), F.lit(0)).alias("d")).first()
    assert tuple(r.p) == (True, False, 720, 1280, 48.2) and r.n is None and r.i == "12" and r.d
    urls = spark.createDataFrame([(2, "u?a"), (1, "u?b"), (3, "v")], "seq int, url string")
    assert sorted(r.seq for r in scans.first_by_url(urls).collect()) == [1, 3]
    plan = scans.search_plan(spark.createDataFrame([("k",)], "keyword string"), spark.createDataFrame([("p", 1), ("q", 2)], "place string, priority int"), 2)
    assert plan.count() == 4
    state.append_rejects(spark.createDataFrame([("s", "t" * 200, "url")], "source string, title string, gate string"), str(tmp_path / "rejects"))
    assert len(spark.read.json(str(tmp_path / "rejects")).first().title) == 120


def test_lines_and_dates(spark):
    assert diffing.units("a\r\nb\x0cc d\n", True) == ["a\r\n", "b\x0c", "c ", "d\n"]
    r = spark.range(1).select(
        dates.lenient_date(F.lit("2026-01-02x")).alias("a"), dates.lenient_date(F.lit("2026-1-2")).alias("b"), dates.lenient_datetime(F.lit("junk"), F.lit("2026-01-01").cast("timestamp")).alias("c"),
        dates.window_start(F.lit("2026-01-15 10:00:00").cast("timestamp"), F.lit(2)).alias("d"), dates.window_start(F.lit("2026-01-15 10:00:00").cast("timestamp")).alias("e"),
        text.topic_keywords(F.lit(""), F.lit(None).cast("string")).alias("f"),
    ).first()
    assert tuple(r) == (date(2026, 1, 2), None, datetime(2026, 1, 1), datetime(2026, 1, 13, 10), datetime(2026, 1, 14, 10), ["coding"])
    with pytest.raises(Exception, match="must be positive"):
        spark.range(1).select(dates.whole_clips(F.lit(0), F.lit(8))).collect()


def test_a_gated_breaker_skips(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", k, float(at), ok) for k, (at, ok) in enumerate([(0, False), (1, False), (2, False), (3, False), (50, True), (4000, False), (4001, True)])]
    spark.createDataFrame(rows, "key string, seq long, at double, ok boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, at double, ok boolean").parquet(str(tmp_path / "in"))
    from tarnmill.streaming.events import run_available

    got = {g: run_available(breaker.breaker_stream(stream, gated=g), f"breaker{g}", "update").first() for g in (False, True)}
    assert (got[True].skipped, got[True].consecutive_fails, got[True].total_fails, got[True].total_ok) == (3, 4, 4, 0)
    assert (got[False].skipped, got[False].total_fails, got[False].total_ok) == (0, 5, 2)


def test_signs_of_a_generation(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    done = lambda *c: spark.range(1).select(course.generation_finished(*c).alias("x")).first().x
    assert done(f, F.lit(1), f, f, f) and done(f, F.lit(0), t, f, f) and done(f, F.lit(0), f, t, f) and done(n, F.lit(0), n, n, t)
    assert not done(t, F.lit(2), t, t, t) and not done(f, F.lit(0), f, f, n)
    fast = lambda *c: spark.range(1).select(course.fails_fast(*c).alias("x")).first().x
    one, zero = F.lit("1"), F.lit("0")
    assert fast(one, f, t) and fast(zero, t, t) and fast(zero, f, f) and fast(n.cast("string"), f, n)
    assert not fast(zero, f, t) and not fast(F.lit("true"), f, t)


def test_last_verdict_of_a_run(spark):
    rows = [("a", 1, "login"), ("a", 2, "failed"), ("b", 1, "ok"), ("b", 2, "failed"), ("c", 2, "login"), ("c", 1, "cancelled"), ("d", 1, None)]
    assert {r.source: r.verdict for r in circuits.run_verdicts(spark.createDataFrame(rows, "source string, seq int, outcome string")).collect()} == {"a": "failed", "b": "ok", "c": "login", "d": "failed"}


def test_resumed_runs(spark):
    rows = [(2, True, 16, 16, 2), (2, True, 16, 24, 3), (2, False, 16, 24, 3), (2, False, 16, 40, 5), (2, False, 16, 17, 2), (0, True, 0, 0, 0)]
    df = spark.createDataFrame(rows, "done long, pending boolean, recorded long, duration long, want long")
    assert all(r.x == r.want for r in df.select("want", course.resumed_segments(F.col("done"), F.col("pending"), F.col("recorded"), F.col("duration"), F.lit(8)).alias("x")).collect())
