import pytest
from pyspark.sql import functions as F

from tarnmill.functions.clauses import runs, sentences
from tarnmill.operators import geo, law, residency
from tarnmill.plans.notices import notices
from tests.test_functions import column

CASES = {
    residency.us_persons_polarity: {
        "US persons only.": -1, "Open to non-US persons": 1, "Open to non-US persons only": 1, "No degree is asked. U.S. persons only": -1, "they tell us persons": 0, None: 0, "": 0,
        "US person status is not required; not only US persons may apply": 1, "US personnel not required; must work US business hours": -1, "Not required.\nUS business hours": -1, "U.S.A. persons, please": -1,
    },
    residency.usa_polarity: {"U.S.A. person status is not required": 1, "USA": -1, "none": 0, "The USA. Not required": -1, "USA residency is not mandatory, remote only": -1, None: 0, "USA: none required! United States: not needed": 1},
    residency.local_residency: {
        "Wohnsitz in Deutschland": True, "Wohnsitz in Deutschland nicht erforderlich": False, "kein Wohnsitz in Deutschland, aber Wohnort bitte in Berlin": True, "Notre client, basé en France, recrute": False,
        "basée en France": True, "Wohnort frei — auch in Deutschland": False, "Der Wohnort\nliegt in Deutschland": True, "Der Wohnort ist frei. Büro in Berlin": False, "résidence en France non requise": False,
        "Bewerber müssen bereit sein, in Dresden zu leben": True, None: False, "": False,
    },
    residency.description_restricted: {
        "You must reside in the US.": True, "Remote - Berlin only": True, "Remote - France vs Texas": False, "Remote - Paris, Madrid": True, "nothing": False, None: False, "green card holder": True, "Asia Pacific time": False,
        "Pacific time zone": True, "gives us only joy": False, "100% remote - US Only": True, "India only": True, "Pakistan only": False, "fluent German needed": True, "hybrid role": True, "must overlap with us": True, "w2 only": True,
        "based in Japan preferred": True, "We sell to teams in Israel": False, "office in Haifa": True, "within 3 hours of CET": True,
    },
    residency.title_restricted: {
        "ML Engineer (US Only)": True, "Dev [NYC or SF]": True, "Software Engineer - Recruiting Solutions": False, "Technical Recruiter - Engineering": True, "Recruiting Software Engineer": False, "ML Engineer": False, None: False,
        "AI_Engineer_Onsite": True, "Hybrid Search Engineer": False, "ML Engineer (Hybrid)": True, "Werkstudent ML": True, "Data Scientist, India only": True, "Closer, commission only": True, "JLPT N1 Dev": True,
    },
    residency.us_pinned: {
        "Austin, TX": True, "Remote - Austin and Berlin": False, "Remote - Austin and Berlin; Remote - Dallas": True, "Worldwide; hubs in Austin and Berlin": False, "based in or near Karachi": False, "must be based in TX": True,
        "must be based in tx": False, "TX - Remote": True, "Remote, OR": True, "Remote (New York, London)": False, None: False, "Remote": False, "offices in New York, London and a long text about them": False, "Denver based": True,
        "Remote-first hubs in Austin and in many other towns": False, "living in or near it; based in CA": True, "only in ON only": False, "in NY only": True,
    },
}


@pytest.mark.parametrize("rule", list(CASES), ids=lambda r: r.__name__)
def test_rules(spark, rule):
    assert dict(zip(CASES[rule], column(spark, list(CASES[rule]), rule), strict=True)) == CASES[rule]


STAGES = [
    ("", None, "", "", "no_label", False), ("Remote", None, "Dev US only", "", "title", False), ("Remote", None, "Dev", "must reside in the US", "description", False), ("Remote, OR", None, "Dev", "", "town_of_remote", False),
    ("anywhere in India", None, "Dev", "", "anywhere_within", False), ("Lahore", None, "Dev", "work from anywhere", "open_description", True), ("Berlin", None, "", "", "foreign", False), ("Austin, TX", None, "", "", "us", False),
    ("Remote", "Indeed", "", "", "us_board", False), ("Remote", "indeed", "", "worldwide", "bare", True), ("Anywhere", None, "", "", "anywhere", True), ("Global", None, "", "", "global", True), ("B2B, Remote", None, "", "", "contract", True),
    ("Macau", None, "", "", "closed_market", False), ("APAC", None, "", "", "region", True), ("Dubai, hybrid role", None, "", "", "scope_hybrid", False), ("Dubai", None, "", "our onsite days", "scope_office", False),
    ("Lahore", "x", "", "", "home", False), ("Lahore", "x", "Dev (Remote)", "", "home", True), ("Dubai", "x", "", "", "scope_unmarked", False), ("Dubai", "x", "", "contractor, fully remote", "scope_told", True), ("Dubai", "x", "", "contractor", "scope_told", False),
    ("Dubai remote", "x", "", "", "scope", True), ("Remote (Moon)", "x", "", "", "qualified", False), ("Remote", "x", None, None, "bare", True), ("Nowhere", "x", "", "", "none", False), (None, None, None, None, "no_label", False),
]


def test_every_stage_of_eligibility(spark):
    df = spark.createDataFrame([(i, *s[:4]) for i, s in enumerate(STAGES)], "i int, l string, s string, t string, d string")
    found = df.orderBy("i").select(residency.worldwide(F.col("l"), F.col("s"), F.col("t"), F.col("d")).alias("w")).collect()
    assert [(r.w.stage, r.w.open) for r in found] == [s[4:] for s in STAGES]


def test_sentences_and_runs(spark):
    assert column(spark, ["Made in the U.S. by U.S.A. people. New! one\ntwo", "", None], sentences) == [["Made in the U.S. by U.S.A. people.", "New!", "one", "two"], [""], None]
    assert column(spark, ["a, b und c", "x"], lambda c: runs(c, r"[,]|\bund\b")) == [["a", "a, b ", "a, b und c", " b ", " b und c", " c"], ["x"]]


def test_long_texts_take_time_in_proportion(spark):
    text = "We work in many towns and like it " * 20_000 + "- remote"
    assert column(spark, [text], residency.us_pinned) == [False]


def test_places_are_those_of_the_alternations(spark):
    rows = notices(spark, "/root/testdata/sf0.001").select("seq", F.concat_ws(" | ", "label", "notice").alias("t"))
    classes = {c: terms for c, terms in geo.CLASSES.items() if c not in ("marker", "contract")}
    found = geo.with_places(rows, "t").select("seq", *(geo.names_one(F.col("places"), c).alias(c) for c in classes), *(F.lower("t").rlike(law.words(terms)).alias(f"by_{c}") for c, terms in classes.items())).collect()
    assert found and all(r[c] == r[f"by_{c}"] for r in found for c in classes)
    assert any(r["us_metro"] for r in found)


def test_places_of_odd_texts(spark):
    vocab = spark.createDataFrame([("Kansas City", "metro"), ("kansas", "state"), ("(x)", "mark"), (None, "a"), ("", "b"), ("kansas", "word")], "term string, class string")
    df = spark.createDataFrame([(1, "KANSAS City, arkansas"), (2, None), (3, ""), (4, "a(X)b"), (5, "kansas " * 30_000)], "i int, t string").withColumn("term", F.lit(0))
    found = {r.i: [tuple(p) for p in r.places] for r in geo.with_places(df, "t", vocab).collect()}
    assert found[1] == [("kansas", "state", 0, 6), ("kansas", "word", 0, 6), ("kansas city", "metro", 0, 11)]
    assert found[2] == found[3] == [] and found[4] == [("(x)", "mark", 1, 4)] and len(found[5]) == 60_000
    assert geo.with_places(df, "t", vocab.limit(0)).where(F.size("places") > 0).count() == 0


def test_too_many_terms(spark, monkeypatch):
    monkeypatch.setattr(geo, "MOST_TERMS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        geo.with_places(spark.createDataFrame([("a",)], "t string"), "t")
