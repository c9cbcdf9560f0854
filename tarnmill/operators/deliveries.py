"""Deliveries with state: what is still to be sent, sending with retries, dead letters, ledgers, reports.

A ledger is a table ``(key, channel, period)`` of what has been delivered; what isn't in it is due.
Sending goes through a function of the caller's, so that tests need no network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType


def due(rows: DataFrame, ledger: DataFrame, period: Column) -> DataFrame:
    """``rows(key, channel, ...)`` that the ledger doesn't hold for the period (a day, a week): once per period and channel."""
    return rows.withColumn("period", period).join(ledger.select("key", "channel", "period"), ["key", "channel", "period"], "left_anti")


def recorded(ledger: DataFrame, sent: DataFrame, oldest: Column) -> DataFrame:
    """The ledger with what was sent now, each entry once; entries of periods before ``oldest`` go."""
    return ledger.select("key", "channel", "period").unionByName(sent.select("key", "channel", "period")).where(F.col("period") >= oldest).distinct()


def pending_channels(configured: DataFrame, ledger: DataFrame, period: Column) -> DataFrame:
    """The configured channels that haven't confirmed the period's delivery."""
    return configured.join(ledger.where(F.col("period") == period).select("channel"), "channel", "left_anti")


def send(rows: DataFrame, post: Callable[[list[dict]], None], batch: int = 100, attempts: int = 3, backoff_s: float = 1.0) -> DataFrame:
    """``rows`` with ``delivered``, ``tries`` and ``error``: batches go to ``post``, which raises when it fails.

    A failed batch waits twice as long before each new attempt; when they are used up, its rows are dead
    letters. A task that is run again sends its batches again, so ``post`` should know a row it has had.
    """
    extra = StructType([StructField("delivered", BooleanType()), StructField("tries", IntegerType()), StructField("error", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                some, error = frame.iloc[lo : lo + batch].copy(), None
                for n in range(1, attempts + 1):
                    try:
                        post(some.to_dict("records"))
                        error = None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        if n < attempts:
                            time.sleep(backoff_s * 2 ** (n - 1))
                yield some.assign(delivered=error is None, tries=n, error=error)

    return rows.mapInPandas(run, StructType([*rows.schema.fields, *extra.fields]))


def bounded_letters(letters: DataFrame, n: int = 200) -> DataFrame:
    """The last n dead letters by ``seq``."""
    return letters.orderBy(F.desc("seq")).limit(n)


def replay(letters: DataFrame, outcomes: DataFrame, actions: list[str]) -> tuple[DataFrame, DataFrame]:
    """Dead letters ``(seq, action, rows, ...)`` and the ``(seq, ok)`` of sending them again -> those now delivered, those that stay.

    A letter of an action that can't be replayed, or without rows, stays whatever its outcome.
    """
    can = F.coalesce(F.col("action").isin(*actions) & (F.size("rows") > 0), F.lit(False))
    good = outcomes.where("ok").select("seq").distinct()
    done = letters.where(can).join(good, "seq", "left_semi")
    return done, letters.join(done.select("seq"), "seq", "left_anti")


def upload_step(status: Column, attempts: Column, most: int = 3) -> Column:
    """What to do about an upload by its marker: skip one that is done, refuse a pending one (it may have gone through), else try, until tries run out."""
    return F.when(status == "done", "skip").when(status == "pending", "refuse").when(F.coalesce(attempts, F.lit(0)) >= most, "give_up").otherwise("upload")


def marker_status(raw: Column) -> Column:
    """A marker's status: that of a JSON object, or done for the bare text that older markers were; null without marker."""
    return F.when(raw.isNull(), None).otherwise(F.coalesce(F.get_json_object(raw, "$.status"), F.lit("done")))


def concat_manifest(clips: DataFrame) -> DataFrame:
    """``clips(key, place, path)`` -> ``key, manifest``: a line for each clip, in order."""
    line = F.concat(F.lit("file '"), F.replace(F.col("path"), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return clips.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda c: c["line"]), "\n").alias("manifest"))


def report(counts: DataFrame, title: str) -> DataFrame:
    """``counts(dimension, value, n, first_seq)`` -> ``dimension, markdown``: a section for each dimension, the commonest first, ties by first appearance."""
    line = F.concat(F.lit("- "), F.coalesce("value", F.lit("")), F.lit(": "), F.col("n").cast("string"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "first_seq", line.alias("line"))))
    lines = counts.groupBy("dimension").agg(rows.alias("rows"))
    return lines.select("dimension", F.concat(F.lit(f"# {title}\n\n## "), "dimension", F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("markdown"))


def catch_up(last_day: Column, now: Column, hour: int = 8, minute: int = 15) -> Column:
    """Whether a day's run was missed: the clock is past the hour and the day has no stamp."""
    past = now >= F.date_trunc("day", now) + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))
    return past & F.coalesce(last_day != now.cast("date"), F.lit(True))


def seo_document(title: Column, hook: Column, keywords: Column, publish_at: Column, most: int = 100) -> Column:
    """A JSON document for an upload: the title cut at a word's end, a description, keywords each once, and when to publish."""
    cut = F.regexp_replace(F.substring(title, 1, most), r" [^ ]*$", "")
    head = F.when(F.length(title) <= most, title).otherwise(cut)
    return F.to_json(F.struct(head.alias("title"), F.concat_ws("\n\n", hook, title).alias("description"), F.array_distinct(keywords).alias("tags"), publish_at.alias("publish_at")))


def top_for_message(rows: DataFrame, score: str, order: str, n: int = 5) -> DataFrame:
    """The n rows of the highest score with their ``rank``; no score counts as 0, ties stay in the given order. Only n rows reach one task."""
    best = rows.withColumn("_score", F.coalesce(F.col(score), F.lit(0))).orderBy(F.desc("_score"), order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_score"), order))).drop("_score")
