"""Feeds, boards, stored postings and tables of batches on small inputs."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from tarnmill.operators import feed, profiles
from tarnmill.sources import batches, board, records
from tarnmill.streaming import breaker, weekly

NOW = "2026-01-15 00:00:00"


def reread(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, record string")
    return [(r.problem, r.posting) for r in records.rehydrated(rows, "record", F.lit(NOW).cast("timestamp")).orderBy("i").collect()]


def test_defaults_coercion_and_problems(spark):
    good = {
        "{}": {"id": "", "job_type": "unknown", "tags": [], "cv_match_score": 0, "profile_scores": {}, "fetched_at": datetime.datetime(2026, 1, 15), "posted_date": None, "location": None},
        '{"id": 1, "title": null, "profile_best": null}': {"id": "1", "title": "None", "title_normalized": "", "profile_best": ""},
        '{"title": "ML--Eng", "title_normalized": "old", "salary_min": 5.0}': {"title_normalized": "ml eng", "salary_min": 5},
        '{"cv_match_score": 3.9}': {"cv_match_score": 3}, '{"cv_match_score": " 7 "}': {"cv_match_score": 7}, '{"cv_match_score": true}': {"cv_match_score": 1},
        '{"profile_scores": []}': {"profile_scores": {}}, '{"profile_scores": {"a": 3}}': {"profile_scores": {"a": 3}},
        '{"fetched_at": "2026-01-02T03:04:05", "posted_date": "2026-01-02T09"}': {"fetched_at": datetime.datetime(2026, 1, 2, 3, 4, 5), "posted_date": datetime.date(2026, 1, 2)},
        json.dumps({"description_snippet": "x\n\"ü" * 200_000}): {"description_snippet": "x\n\"ü" * 200_000},
    }
    for (problem, posting), wanted in zip(reread(spark, good), good.values(), strict=True):
        assert problem is None and {k: posting[k] for k in wanted} == wanted
    bad = {"": "json", "[]": "json", "x": "json", '{"id": 1': "json", '{"tags": "a"}': "tags", '{"tags": null}': "tags", '{"cv_match_score": "3.9"}': "cv_match_score", '{"cv_match_score": null}': "cv_match_score", '{"profile_scores": [1]}': "profile_scores"}
    assert reread(spark, bad) == [(p, None) for p in bad.values()]
    assert reread(spark, [None]) == [("json", None)]


def test_written_and_read_again_is_the_same(spark):
    texts = ['{"id": "a", "title": "T", "tags": ["x", "y"], "salary_min": 1, "posted_date": "2026-01-02", "fetched_at": "2026-01-02T03:04:05.678901", "profile_scores": {"p": 3}}', "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, record string")
    once = records.rehydrated(rows, "record", F.lit(NOW).cast("timestamp"))
    again = records.rehydrated(records.serialised(once.select("i", "posting.*")).select("i", "record"), "record", F.lit(NOW).cast("timestamp"))
    assert [r.posting for r in once.orderBy("i").collect()] == [r.posting for r in again.orderBy("i").collect()]


def test_day_files(spark, tmp_path):
    texts = {"2026-01-01": '[{"id": "a"}, {"id": "b"}]', "2026-01-02": '{"jobs": [{"id": "c"}], "n": 1}', "2026-01-03": '{"n": 1}', "2026-01-04": "broken", "2026-01-05": "[]", "2026-01-06": "7"}
    for day, text in texts.items():
        (tmp_path / f"jobs_{day}.json").write_text(text)
    found = sorted((str(r.day)[-1], r.seq, r.record, r.problem) for r in records.day_records(spark, str(tmp_path)).collect())
    assert found == [("1", 0, '{"id":"a"}', None), ("1", 1, '{"id":"b"}', None), ("2", 0, '{"id":"c"}', None), ("4", 0, None, "file"), ("6", 0, None, "file")]


def test_weekly_first_valid_row_wins(spark):
    day = datetime.date(2026, 1, 12)
    back = lambda n: day - datetime.timedelta(days=n)
    days = spark.createDataFrame([("a", back(0), 5, "bad", "d0"), ("a", back(1), 1, "ok", "d1"), ("a", back(2), 0, "ok", "d2"), ("b", back(7), 0, "ok", "old"), ("c", back(6), 2, "ok", "c2"), ("c", back(6), 1, "ok", "c1")], "id string, day date, seq long, state string, v string")
    at = lambda n: datetime.datetime.combine(back(n), datetime.time(23))
    store = spark.createDataFrame([("b", at(6), 1, "ok", "s"), ("a", at(0), 0, "ok", "s"), ("e", at(7), 0, "ok", "s"), ("f", None, 0, "ok", "s"), ("g", at(0), 0, "bad", "s")], "id string, fetched_at timestamp, seq long, state string, v string")
    found = records.weekly(days, store, F.lit(day), F.col("state") == "ok")
    assert sorted((r.id, r.v) for r in found.collect()) == [("a", "d1"), ("b", "s"), ("c", "c1")]
    assert records.weekly(days.limit(0), store.limit(0), F.lit(day), F.col("state") == "ok").count() == 0


def test_batches_survive_what_a_killed_job_leaves(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(r, "id string, v string, _seq long")
    table = lambda df: sorted(map(tuple, df.collect()))
    first = rows(("a", "late", 2), ("a", "first", 1), ("b", 'x,"y"', 3), (None, "none", 4), ("", "empty", 5))
    assert table(batches.merge(first, path, "1", "id", ["_seq"], "csv")) == [("a", "first"), ("b", 'x,"y"')]
    for _ in range(2):
        assert table(batches.merge(rows(("b", "other", 1), ("c", "line\nfeed", 2)), path, "2", "id", ["_seq"], "csv")) == [("a", "first"), ("b", 'x,"y"'), ("c", "line\nfeed")]
    os.makedirs(f"{tmp_path}/t/batch=3")  # no mark of a finished job: what is here isn't read, and is written anew
    with open(f"{tmp_path}/t/batch=3/part-0.csv", "w") as f:
        f.write("id,v\nz,half\n")
    assert batches.finished(spark, path) == ["1", "2"]
    assert len(table(batches.read(spark, path, first.select("id", "v").schema, "csv"))) == 3
    assert ("z", "whole") in table(batches.merge(rows(("z", "whole", 1)), path, "3", "id", ["_seq"], "csv"))
    assert batches.finished(spark, path) == ["1", "2", "3"]
    parts = [p for p in os.listdir(f"{tmp_path}/t/batch=1") if p.startswith("part-")]
    assert all(open(f"{tmp_path}/t/batch=1/{p}", "rb").read().startswith("﻿id,".encode()) for p in parts)
    assert table(batches.merge(rows().limit(0), f"{path}-parquet", "1", "id", ["_seq"])) == []


def three_rows(keyword, page, options):
    for i in range(3):
        if options.get("fail") == f"{keyword}{page}" and i == 2:
            raise OSError("lost")
        yield {"title": f"{keyword}-{page}-{i}", "more": 1}


def closed(options):
    return "maintenance"


def pages_now(options):
    return int(open(options["count"]).read())


def reader(source, **options):
    name = lambda f: f"{__name__}:{f.__name__}"
    return source.format("board").options(fetch=name(three_rows), keywords='["a", "b"]', latest=name(pages_now), **options)


def test_board_keeps_what_a_failing_page_gave(spark):
    spark.dataSource.register(board.BoardSource)
    rows = reader(spark.read, pages=2, fail="b1").load()
    found = rows.collect()
    assert rows.rdd.getNumPartitions() == 4 and len([r for r in found if r.problem is None]) == 11
    assert [(r.keyword, r.page, r.seq, r.title, r.problem) for r in found if r.problem] == [("b", 1, 2, None, "OSError: lost")]


@pytest.mark.parametrize("options, why", [({"login": "true"}, "session"), ({"check": f"{__name__}:closed"}, "maintenance"), ({"keywords": "[]"}, "keywords")])
def test_board_that_is_not_ready(spark, options, why):
    spark.dataSource.register(board.BoardSource)
    with pytest.raises(Exception, match=why):
        reader(spark.read).options(**options).load().collect()
    assert reader(spark.read, login="true", session="s").load().count() == 6


def test_board_stream_reads_each_page_once(spark, tmp_path):
    spark.dataSource.register(board.BoardSource)
    count, out = tmp_path / "count", str(tmp_path / "out")
    for n in (1, 1, 3):
        count.write_text(str(n))
        stream = reader(spark.readStream, count=str(count)).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(out).collect()) == sorted(f"{k}-{p}-{i}" for k in "ab" for p in range(3) for i in range(3))


TITLES = [
    ("We build\nNow hiring: ML lead …\nmore", "CTO", "Now hiring: ML lead"), ("We build", "Acme is hiring", "Acme is hiring"), ("We build. And more", "• 3rd+", "We build. And more"),
    ("", "CTO", "CTO"), (None, None, "Hiring"), ("  \n", "2nd", "Hiring"), ("x" * 300, "", "x" * 140), ("Seeking " + "y" * 300, None, ("Seeking " + "y" * 300)[:140]),
]


def test_post_titles(spark):
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TITLES)], "i int, text string, headline string, wanted string")
    found = rows.select("i", "wanted", feed.post_title(F.col("text"), F.col("headline")).alias("t")).orderBy("i").collect()
    assert [r.t for r in found] == [r.wanted for r in found]


def test_feed_postings(spark):
    posts = [
        ("open", "We're hiring, remote worldwide", "https://f.example/1", "2026-01-09"), ("person", "We're hiring, worldwide", "https://linkedin.com/in/x", None), ("talk", "A deep dive, worldwide", "https://f.example/2", None),
        ("office", "We're hiring worldwide, on-site", "https://f.example/3", None), ("old", "Hiring, work from anywhere", "https://f.example/4", "2026-01-01"), ("age", "Hiring, work from anywhere", "https://f.example/5", "2d"),
        ("abroad", "Hiring, remote from Germany", "https://f.example/6", None), ("silent", "We are hiring", "https://f.example/7", None), ("null", None, "https://f.example/8", None), ("no link", "Hiring worldwide", " ", None),
    ]
    rows = spark.createDataFrame([(n, t, u, p, None, " ", "ai", n) for n, t, u, p in posts], "name string, text string, url string, posted string, headline string, author string, keyword string, source string")
    found = {r["name"]: r for r in feed.postings(rows, F.lit("2026-01-05").cast("date")).collect()}
    assert sorted(found) == ["age", "open"]
    assert found["open"].asDict() == {"name": "open", "source": "linkedin", "title": "We're hiring, remote worldwide", "company": "Unknown", "url": "https://f.example/1", "location": "Worldwide", "posted_date": "2026-01-09", "description": "We're hiring, remote worldwide", "tags": ["ai"]}
    assert feed.postings(rows.limit(0)).count() == 0


def test_guest_verdicts(spark):
    cases = [
        ("ML Engineer", "Worldwide", "This job is closed", "closed"), ("ML Engineer", "Worldwide", "Build models", ""), ("Remote ML Engineer", "Remote", "Fluent German required", "language_description"),
        ("ML Engineer", "Global", "Build models", "remote_marker"), ("ML Engineer", "Global", "A fully remote team", ""), ("ML Engineer", "Global", "Location: Remote", ""), ("ML Engineer (Hybrid role)", "Worldwide", None, "hybrid_title"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, l string, d string, wanted string")
    found = rows.select("i", "wanted", feed.guest_verdict(F.col("t"), F.col("l"), F.col("d")).alias("v")).orderBy("i").collect()
    assert [r.v.reason for r in found] == [r.wanted for r in found] and all(r.v.ok == (r.wanted == "") for r in found)


def test_legacy_blacklist(spark):
    titles = {"Sales AI Engineer": "blacklisted_role: sales", "Java Developer": "unrelated_stack: java", "AI Engineer (Java)": None, "Machine  Learning, Java": None, None: None}
    rows = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    assert [r.x for r in rows.select("i", profiles.legacy_reason(F.col("t"), (r"\bsales\b",), (r"\bjava\b",)).alias("x")).orderBy("i").collect()] == list(titles.values())


def test_weekly_ledger_over_batches(spark, tmp_path):
    schema, out = "key string, week string, channel string, ok boolean", {}
    steps = [
        ([("j", "2026-W02", "a", True), ("j", "2026-W02", "b", False), (None, "2026-W02", "a", True)], {"j": ("2026-W02", "b"), None: ("2026-W02", "b")}), ([("j", "2026-W02", "b", True), ("j", "2026-W01", "c", True)], {"j": ("2026-W02", "")}),
        ([("j", "2026-W03", "b", True), ("j", "2026-W02", "a", True), ("j", None, "a", True), ("j", "2026-W03", "z", True), ("k", None, None, None)], {"j": ("2026-W03", "a"), "k": (None, "a,b")}),
    ]
    for n, (rows, wanted) in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = weekly.confirmations(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["a", "b"])
        take = lambda df, _, n=n: out.update({n: {r.key: (r.week, r.missing) for r in df.collect()}})
        stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        assert out[n] == wanted


def test_breaker_over_a_table(spark):
    attempts = [(0, False), (1, False), (2, False), (3, False), (50, True), (4000, False), (4001, True)]
    rows = [(k, i, float(at), ok) for k in ("a", None, "b") for i, (at, ok) in enumerate(attempts)] + [("c", 0, 1.0, True)]
    events = spark.createDataFrame(rows, "key string, seq long, at double, ok boolean").repartition(3)
    found = {r.key: tuple(r)[1:] for r in breaker.breaker_table(events).collect()}
    assert found == {k: (4, 4, 0, 7600.0, 3) for k in ("a", None, "b")} | {"c": (0, 0, 1, 0.0, 0)}
    assert {tuple(r)[1:] for r in breaker.breaker_table(events.where("key = 'a'"), gated=False).collect()} == {(0, 5, 2, 0.0, 0)}
    assert breaker.breaker_table(events.limit(0)).count() == 0
