"""Rows on their way out: display rows, messages, captions, queues of failed deliveries, run verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.functions.dates import week_key

#: Hashtags of each platform; a default that a caller replaces.
HASHTAGS = {
    "tiktok": ("coding", "learning", "tech"),
    "instagram_reels": ("coding", "reels", "tech"),
    "facebook": ("coding", "learning"),
    "youtube_shorts": ("coding", "shorts", "tech"),
}


def salary_text(low: Column, high: Column, currency: Column) -> Column:
    """A range in thousands, or in lakh for rupees."""
    lakh = F.coalesce(currency == "₹", F.lit(False))
    one = lambda v: F.when(lakh, F.concat((v / 100_000).cast("long").cast("string"), F.lit("L"))).otherwise(F.concat((v / 1_000).cast("long").cast("string"), F.lit("k")))
    both = F.when(low.isNotNull() & high.isNotNull(), F.concat(one(low), F.lit("-"), one(high))).otherwise(one(F.coalesce(low, high)))
    return F.when(low.isNotNull() | high.isNotNull(), F.concat(F.coalesce(currency, F.lit("")), both)).otherwise("")


def captions(topics: DataFrame, text: Column, call: str, hashtags: dict[str, tuple[str, ...]] = HASHTAGS) -> DataFrame:
    """Every topic for every platform; the platforms are a short literal array, no join."""
    rows = F.array(*(F.struct(F.lit(p).alias("platform"), F.lit(" ".join("#" + t for t in sorted(tags))).alias("tags")) for p, tags in hashtags.items()))
    out = topics.withColumn("_p", F.explode(rows))
    return out.select(*topics.columns, F.col("_p.platform").alias("platform"), F.concat_ws("\n\n", text, F.lit(call), F.col("_p.tags")).alias("caption"))


def fit_message(text: Column, limit: int = 4000, keep: int = 3990, mark: str = "\n…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit(mark))).otherwise(text)


def profile_sections(rows: DataFrame, profile: str, score: str, n: int = 10) -> DataFrame:
    """The n best of each profile."""
    order = Window.partitionBy(profile).orderBy(F.desc(score), "seq")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def weekly_counter(events: DataFrame, ts: str, n: str) -> DataFrame:
    """The running total of each ISO week, which begins anew with the week."""
    week = week_key(F.col(ts))
    order = Window.partitionBy("week").orderBy(ts)
    per_day = events.groupBy(week.alias("week"), F.to_date(ts).alias(ts)).agg(F.sum(n).alias(n))
    return per_day.withColumn("so_far", F.sum(n).over(order))


def outage(runs: DataFrame) -> DataFrame:
    """Runs without a new row in which no source was ok."""
    return runs.groupBy("run").agg(((F.sum("found") == 0) & ~F.bool_or(F.col("outcome") == "ok")).alias("outage"))


def split_replayable(letters: DataFrame, actions: list[str]) -> tuple[DataFrame, DataFrame]:
    """Failed deliveries that can be sent again, and the rest."""
    can = F.coalesce(F.col("action").isin(*actions) & (F.size("rows") > 0), F.lit(False))
    return letters.where(can), letters.where(~can)


def session_valid(cookies: Column, now: Column) -> Column:
    """Any cookie without expiry, with a negative one, or one to come."""
    return F.coalesce(F.exists(cookies, lambda c: c["expires"].isNull() | (c["expires"] < 0) | ~F.isnan(c["expires"]) & (c["expires"] > now)), F.lit(False))


def search_url(base: str, keyword: Column, remote: bool = True, days: int | None = None) -> Column:
    parts = [F.lit(f"{base}?q="), F.url_encode(keyword), *([F.lit("&remote=1")] if remote else []), *([F.lit(f"&fromage={days}")] if days else [])]
    return F.concat(*parts)


def feed_queries(keyword: Column, weekday: Column) -> Column:
    """On Fridays a keyword is asked in three ways."""
    return F.when(weekday == 4, F.array(keyword, F.concat(F.lit("#hiring "), keyword), F.concat(F.lit('"we are hiring" '), keyword))).otherwise(F.array(keyword))


def hunk_spans(changes: DataFrame, context: int = 3) -> DataFrame:
    """``changes(key, line)`` -> the spans of lines within the context of a change, those that touch joined: gaps and islands."""
    order = Window.partitionBy("key").orderBy("line")
    gap = F.col("line") - F.lag("line").over(order) > 2 * context + 1
    group = F.sum(F.coalesce(gap.cast("int"), F.lit(1))).over(order)
    return changes.withColumn("hunk", group).groupBy("key", "hunk").agg(F.greatest(F.min("line") - context, F.lit(0)).alias("lo"), (F.max("line") + context).alias("hi"))
