"""Scans of pages and files: cards, badges, drift, plug-ins, topic lists, CSV, the latest partition."""

from __future__ import annotations

import importlib
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.functions.text import base_url, strip

_LOG = logging.getLogger(__name__)

# What a page's age badge can say, and the words of remote and of office work.
BADGE = r"(?i)\b(just posted|posted today|today|yesterday|(?:posted\s+|active\s+)?\d+\+?\s*(?:hours?|hrs?|h|days?|d|weeks?|w|months?|mo)\s*(?:ago)?)\b"
REMOTE_WORD, OFFICE_WORD = r"(?i)\bremote\b", r"(?i)\b(?:on-?site|hybrid)\b"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def load_plugins(names: list[str]) -> list[str]:
    """Imports modules that register sources; one that fails is logged and left out. Returns those that came up."""
    up = []
    for name in names:
        try:
            importlib.import_module(name)
            up.append(name)
        except Exception:
            _LOG.exception("source module %s failed", name)
    return up


def day_span(days: Column) -> Column:
    """How many days a source is asked for: one up to 1.25, else whole days from 1 to 14."""
    return F.when(days <= 1.25, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(14), F.bround(days).cast("int"))))


def drifted(body: Column, found: Column, least: int = 5000) -> Column:
    """A long page in which nothing was found: its layout has changed."""
    return (F.octet_length(body) > least) & (found == 0)


def id_suffix(url: Column) -> Column:
    """The number at the end of a url's path; null if there is none."""
    return F.nullif(F.regexp_extract(base_url(url), r"-(\d+)$", 1), F.lit(""))


def badge(text: Column) -> Column:
    """The age that a card's free text names; null if none."""
    return F.nullif(F.regexp_extract(text, BADGE, 1), F.lit(""))


def marked_location(location: Column, card: Column) -> Column:
    """The location with ``(Remote)`` where the card says so and speaks of no office."""
    plain = F.coalesce(location, F.lit(""))
    add = card.rlike(REMOTE_WORD) & ~card.rlike(OFFICE_WORD) & ~plain.rlike(REMOTE_WORD)
    return F.when(F.coalesce(add, F.lit(False)), strip(F.concat(plain, F.lit(" (Remote)")))).otherwise(location)


def _unescaped(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def page_cards(html: Column, start: str = r"<li\b[^>]*>") -> Column:
    """``array<struct<title, company, location, url, posted>>`` of a result page, each field from its own card.

    A card runs from one ``start`` to the next. Cards without title, link or location are left out; a
    company that isn't named is ``Unknown``; links lose their query.
    """
    inside = lambda card, tag: strip(_unescaped(F.regexp_replace(F.regexp_extract(card, rf"(?s)<{tag}[^>]*>(.*?)</", 1), r"<[^>]+>", " ")))
    some = lambda value, other: F.when(value != "", value).otherwise(other)

    def card(c: Column) -> Column:
        return F.struct(
            inside(c, "h3").alias("title"), some(inside(c, "h4"), F.lit("Unknown")).alias("company"),
            inside(c, r"span[^>]*class=\"[^\"]*location").alias("location"),
            base_url(_unescaped(F.regexp_extract(c, r"<a\b[^>]*href=\"([^\"]*)\"", 1))).alias("url"),
            F.nullif(F.regexp_extract(c, r"<time\b[^>]*datetime=\"([^\"]*)\"", 1), F.lit("")).alias("posted"),
        )

    parts = F.slice(F.split(html, start), 2, 1 << 30)
    return F.filter(F.transform(parts, card), lambda c: (c["title"] != "") & (c["url"] != "") & (c["location"] != ""))


def first_by_url(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of each url without its query; which of them it is doesn't depend on how rows are dealt out."""
    keyed = rows.withColumn("_base", base_url(F.col("url")))
    first = keyed.groupBy("_base").agg(F.min(order).alias(order))
    return keyed.join(first, ["_base", order], "left_semi").drop("_base")


def search_plan(keywords: DataFrame, places: DataFrame, pages: int = 1) -> DataFrame:
    """``keywords(keyword)`` x ``places(place, priority)`` x pages, a place of high priority first; both are short lists of configuration."""
    plan = keywords.join(F.broadcast(places)).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    return plan.select("priority", "keyword", "place", "page")


def topic_list(spark: SparkSession, path: str) -> DataFrame:
    """``id, title, takeaway, seq`` of a JSON list; an empty one is a ValueError."""
    rows = spark.read.schema("id string, title string, takeaway string, seq long").json(path, multiLine=True)
    if rows.isEmpty():
        raise ValueError(f"no topics in {path}")
    return rows


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; a byte order mark isn't part of the first name."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))


def latest_finished(spark: SparkSession, root: str, name: str = "final.mp4") -> str | None:
    """The last path by name of a finished day under ``root``; None if no day is."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(root)
    return files.agg(F.max("path")).first()[0]


def probed(report: Column) -> Column:
    """``struct<has_video, has_audio, width, height, duration_s>`` of a media report in JSON; null if it doesn't parse."""
    kind = "format struct<duration:string>, streams array<struct<codec_type:string,width:int,height:int>>"
    r = F.from_json(report, kind)
    of = lambda t: F.filter(r["streams"], lambda s: s["codec_type"] == t)
    video = F.get(of("video"), F.lit(0))
    found = F.struct((F.size(of("video")) > 0).alias("has_video"), (F.size(of("audio")) > 0).alias("has_audio"), video["width"].alias("width"), video["height"].alias("height"), r["format"]["duration"].try_cast("double").alias("duration_s"))
    return F.when(r["streams"].isNotNull(), found)
