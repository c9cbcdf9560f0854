"""Notices derived from ``documents``: each text with demands of residence added, and a label, title and board picked by doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.plans.postings import _pick, _sql_pick

PERSONS = [
    "US persons only.", "Open to everyone, non-US persons too.", "A degree isn't required. U.S. persons only!", "They tell us persons matter.", "US person status is not required; not only US persons may join.",
    "US personnel not required; must work US business hours.", "The U.S.A. is our market.", "USA residency is not required.", "This needs nobody from the United States. It is not required.", "Without US persons.", "We sail at dawn.",
    "Requirement: none. Staff in the USA only.", "Not a requirement: United States citizenship\nUS persons preferred",
]
RESIDENCE = [
    "Wohnsitz in Deutschland ist Pflicht.", "Ein Wohnsitz in Deutschland ist nicht erforderlich.", "Kein Wohnsitz in Hamburg, aber Wohnort bitte in Berlin.", "Notre client, basé en France, recrute.", "Poste pour candidats basés en France.",
    "Wohnort frei, Büro in Leipzig.", "Résidence en France non requise, mais résident en France bienvenu.", "Nothing more.", "Bewerber müssen gut arbeiten und in Dresden leben.",
]
LABELS = [
    "Austin, TX", "Remote - Austin and Berlin", "Remote - Austin and Berlin; Remote - Dallas", "Worldwide; hubs in Austin and Berlin", "Remote (New York, London)", "TX - Remote", "Remote", "Remote (US Only)",
    "Maryland - Remote", "Lahore (Remote)", "based in or near Karachi", "must be based in TX", "Berlin, Germany", "Remote in Seattle", "Boston only", "Global", "APAC", "Dubai, UAE", "Remote, OR", "B2B, Remote",
    "Remote - Kansas City / Remote - Singapore", "anywhere in India", "Tokyo, Japan (Remote)", "Denver based team", "", "Remote (EMEA)", "Office of the North",
]
TITLES = ["ML Engineer", "ML Engineer (US Only)", "Data Scientist (Remote)", "Technical Recruiter - Engineering", "AI_Engineer_Onsite"]
BOARDS = ["feed", "indeed", "board"]


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), _pick(PERSONS, d), F.lit(" "), _pick(RESIDENCE, F.floor(d / len(PERSONS))))
    picked = {"label": _pick(LABELS, d), "title": _pick(TITLES, F.floor(d / len(LABELS))), "board": _pick(BOARDS, F.floor(d / 5))}
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(d.alias("seq"), *(v.alias(k) for k, v in picked.items()), text.alias("notice"))


NOTICES_SQL = f"""notices AS (
  SELECT doc_id AS seq, {_sql_pick(LABELS, 'doc_id')} AS label, {_sql_pick(TITLES, f'doc_id // {len(LABELS)}')} AS title, {_sql_pick(BOARDS, 'doc_id // 5')} AS board,
    coalesce(text, '') || chr(10) || {_sql_pick(PERSONS, 'doc_id')} || ' ' || {_sql_pick(RESIDENCE, f'doc_id // {len(PERSONS)}')} AS notice
  FROM documents)"""
