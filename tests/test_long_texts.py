"""Rules over a long text: a pattern is matched only where one of its words stands, so that prose costs little."""

import time

import pytest
from pyspark.sql import functions as F

from tarnmill.functions import signs
from tarnmill.operators import feed, law, profiles, residency
from tarnmill.record_queries import ENGINEER, RESEARCHER

LINE = "The tion of thren was, only that erst and onan. Le des est zu und die ein, que la mente.\n"


def _took(spark, rule, end):
    rows = spark.createDataFrame([(end,)], "e string").select(F.concat(F.repeat(F.lit(LINE), 150_000), "e").alias("t"), F.col("e"))
    made = rows.select(rule(F.col("t")).alias("found"))
    spark.createDataFrame([(end,)], "t string").select(rule(F.col("t"))).first()  # compiled before the clock starts
    began = time.time()
    return made.first().found, time.time() - began


@pytest.mark.parametrize(("end", "found"), [("Wohnsitz in\nDeutschland.", True), ("Kein Wohnsitz in Hamburg.", False), ("Our client, basé en France.", False), ("Basé en France", True)])
def test_local_residency_at_the_end_of_prose(spark, end, found):
    got, seconds = _took(spark, residency.local_residency, end)
    assert got is found and seconds < 8


def test_local_residency_in_one_long_sentence(spark):
    clauses = [("ein, zwei und drei; " * 3_000 + end, found) for end, found in (("Wohnsitz in Deutschland", True), ("Wohnsitz in Deutschland nicht erforderlich", False), ("kein Wohnsitz in Hamburg, aber Wohnort in Berlin", True))]
    began = time.time()
    rows = spark.createDataFrame(clauses, "t string, wanted boolean").select("wanted", residency.local_residency(F.col("t")).alias("found"))
    assert all(r.wanted == r.found for r in rows.collect()) and time.time() - began < 30


def test_the_pins_of_descriptions_by_words_and_parts(spark):
    cases = {"Eligible to\n  work in Japan": True, "w-2 only": True, "Israel-only": True, "US\nperson: you must be a U.S.person": True, "eligible, to work in the sun": False, "Onsite, in Berlin": True, "only the sun in Berlin": False}
    rows = spark.createDataFrame(list(cases.items()), "t string, wanted boolean").select("t", residency.description_restricted(F.col("t")).alias("found"))
    assert {r.t: r.found for r in rows.collect()} == cases


def test_signs(spark):
    low = F.col("t")
    found = spark.createDataFrame([("the us, us. são_paulo usa",), ("busy in paulo; bogotá",), ("",)], "t string").select(
        signs.signs(low, ("us", "usa", *signs.runs_of(("são paulo", "bogotá")))).alias("s"), signs.may_name(signs.signs(low, ("paulo",)), ("東京", "paulo")).alias("m"))
    assert [(r.s, r.m) for r in found.collect()] == [(["us", "usa"], True), (["paulo", "bogot"], True), ([], True)]
    with pytest.raises(ValueError, match="roots"):
        signs.holds_rooted(low, ("on-site", "remote"), ("site",))


@pytest.mark.parametrize("rule", [lambda t: law.verdicts(F.lit("Remote"), F.lit("ML Engineer"), t)["daily"]["reason"], lambda t: feed.guest_verdict(F.lit("ML Engineer"), F.lit("Worldwide"), t)["reason"].substr(10, 99), lambda t: residency.worldwide(F.lit("Remote"), F.lit("feed"), F.lit("ML Engineer"), t)["stage"]], ids=["verdicts", "guest", "worldwide"])
def test_rules_of_postings_at_the_end_of_prose(spark, rule):
    got, seconds = _took(spark, rule, "Fluent German required.")
    assert got == "description" and seconds < 30


def test_a_feed_post_is_read_once(spark, capsys):
    posts = spark.createDataFrame([("Hiring", "u", None, None, None, None)], "text string, url string, headline string, author string, posted string, keyword string")
    feed.postings(posts.where("url != ''")).explain(True)
    # The cut into words of the first reading, and those of the label and the description behind it, in one node alone.
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert sum("on-site" in line for line in plan.split("\n")) == 1


def test_profiles_read_a_description_once(spark, capsys):
    rows = spark.createDataFrame([("ML Engineer", "the long text")], "title string, description string")
    rows.select(profiles.passing([ENGINEER, RESEARCHER], F.col("title"), F.col("description"))).explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("description#") <= 2  # the column, and the one place where it is used
