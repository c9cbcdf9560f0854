"""Exact and fuzzy deduplication with time-to-live state."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnmill.functions.text import ABBREVIATIONS, expand_abbreviations, normalize_text
from tarnmill.sources.tables import written


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in the given order; pre-aggregated before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    first = F.min(F.struct(*order, *(c for c in rest if c not in order)))
    return rows.groupBy(key).agg(first.alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*rows.columns)


def not_seen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def merge_by_id(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows win; rows with new keys are added."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def unexpired(seen: DataFrame, today: Column, days: int) -> DataFrame:
    """Rows seen within the days, the last of them included; undated ones never expire."""
    return seen.where(F.col("seen_on").isNull() | (F.col("seen_on") >= F.date_sub(today, days)))


def newest(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The last n rows by a number that grows: a top-k that no single task has to sort whole."""
    return rows.orderBy(F.desc(order)).limit(n)


def title_similarity(new: str, old: str, new_long: str, old_long: str) -> float:
    """The greatest of: matching blocks, the same written out, and shared tokens written out."""
    if not new or not old:
        return 0.0
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    x, y = set(new_long.split()), set(old_long.split())
    return max(ratio(new, old), ratio(new_long, old_long), len(x & y) / len(x | y) if x | y else 0.0)


def _pairs_of_characters(text: Column) -> Column:
    """Neighbouring characters, numbered where a pair occurs again, so that what two texts share counts as a set."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    nth = lambda p, i, every: F.size(F.filter(F.slice(every, 1, i), lambda x: x == p)).cast("string")
    return F.get(F.transform(F.array(pairs), lambda every: F.transform(every, lambda p, i: F.concat(p, F.lit("#"), nth(p, i, every)))), F.lit(0))


def _rare_keys(texts: DataFrame, kind: str, parts: Column, shared: Column) -> DataFrame:
    """``text, kind, part``: of each text's parts the rarest, of which any text that shares ``shared`` of them has one."""
    rows = texts.select("text", F.size(parts).alias("n"), shared.alias("least"), F.explode(parts).alias("part"))
    counted = rows.join(rows.groupBy("part").agg(F.count("*").alias("times")), "part")
    rank = F.row_number().over(Window.partitionBy("text").orderBy("times", "part"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.col("least") + 1).select("text", F.lit(kind).alias("kind"), "part")


def _shared_pairs(text: Column, threshold: float) -> Column:
    """How many numbered pairs of characters two texts share at least, of which one is this and the ratio reaches the threshold.

    M matched of T characters in all lie in T - 2M + 1 blocks at most and hold M - (T - 2M + 1) pairs;
    the ratio bounds both M and the other text's length.
    """
    total = F.length(text) * (2 / (2 - threshold))
    return F.greatest(F.ceil(total * (1.5 * threshold - 1) - 1 - 1e-9), F.lit(1))


def _alike(keys: DataFrame, test: Callable[[str, str], bool]) -> DataFrame:
    """``x, y`` in both orders: texts that share a key and pass the test in one of them; each text beside itself as well."""

    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([test(x, y) or test(y, x) for x, y in zip(a, b, strict=True)], dtype=bool)

    near = keys.alias("a").join(keys.alias("b"), ["kind", "part"]).where("a.text < b.text").select(F.col("a.text").alias("x"), F.col("b.text").alias("y")).distinct()
    found = written(near.where(passes("x", "y")), "alike")
    every = keys.select("text").distinct()
    return found.union(found.select("y", "x")).union(every.select("text", "text"))


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def first_without_alike(edges: DataFrame) -> DataFrame:
    """``edges(seq, earlier)`` of rows that are alike -> ``seq`` of those alike an accepted earlier one, in order.

    In rounds: what is alike an accepted row goes, and a row all of whose earlier ones are gone is
    accepted. Each round is a written table.
    """
    spark = edges.sparkSession
    accepted = written(edges.select(F.col("earlier").alias("seq")).distinct().join(edges.select("seq"), "seq", "left_anti"), "accepted")
    gone = spark.createDataFrame([], edges.select("seq").schema)
    while not accepted.isEmpty():
        now = written(edges.join(accepted.select(F.col("seq").alias("earlier")), "earlier", "left_semi").select("seq").distinct(), "gone")
        gone = gone.union(now)
        open_ = edges.join(now, "seq", "left_anti")
        left = written(open_.join(now.select(F.col("seq").alias("earlier")), "earlier", "left_anti").select("seq", "earlier"), "edges")
        accepted = written(open_.select("seq").distinct().join(left.select("seq"), "seq", "left_anti"), "accepted")
        edges = left
    return gone


def fuzzy_first(rows: DataFrame, threshold: float = 0.85, recent: DataFrame | None = None) -> DataFrame:
    """``rows(seq, title, company, ...)`` without those whose title and company are alike an accepted earlier row's, or one in ``recent(title, company)``.

    What is in ``recent`` was accepted before, so all of it counts, also where two of its rows are alike.

    Rows with one normal title and company decide alike, so each such pair is represented by its first
    row. Alike titles and alike companies are found each by itself, by a join on their rarest pairs of
    characters (titles also written out, and on their rarest tokens); rows meet through both. A row
    without title or company is never a duplicate. The threshold is 0.85 at least.
    """
    if threshold < 0.85:
        raise ValueError("alike names are found by shared pairs of characters, which takes a threshold of 0.85")
    named = rows.select("seq", normalize_text(F.col("title")).alias("title"), normalize_text(F.col("company")).alias("company"))
    named = named.withColumn("old", F.lit(False))
    every = named
    if recent is not None:
        before = recent.select(normalize_text(F.col("title")).alias("title"), normalize_text(F.col("company")).alias("company"))
        # Before all rows, and by name: what is alike an old row goes, whichever it is.
        place = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("title", "company"), F.lit(1 << 61))
        every = named.unionByName(before.select(place.alias("seq"), "title", "company", F.lit(True).alias("old")))
    first = written(every.where("company <> '' and title <> ''").groupBy("title", "company").agg(F.min("seq").alias("seq"), F.bool_or("old").alias("old")), "first")
    text, long = F.col("text"), expand_abbreviations(F.col("text"))
    tokens = F.array_distinct(F.filter(F.split(long, " "), lambda w: w != ""))
    companies = first.select(F.col("company").alias("text")).distinct()
    titles = first.select(F.col("title").alias("text")).distinct()
    keys = _rare_keys(titles, "short", _pairs_of_characters(text), _shared_pairs(text, threshold))
    keys = keys.union(_rare_keys(titles, "long", _pairs_of_characters(long), _shared_pairs(long, threshold))).union(_rare_keys(titles, "token", tokens, F.ceil(F.size(tokens) * threshold - 1e-9)))

    def title_alike(new: str, old: str) -> bool:
        return title_similarity(new, old, _written_out(new), _written_out(old)) >= threshold

    def company_alike(new: str, old: str) -> bool:
        return _ratio(new, old) >= threshold

    alike_titles = _alike(keys, title_alike).toDF("title", "old_title")
    alike_companies = _alike(_rare_keys(companies, "short", _pairs_of_characters(text), _shared_pairs(text, threshold)), company_alike).toDF("company", "old_company")

    @F.pandas_udf("boolean")
    def both(title: pd.Series, old_title: pd.Series, company: pd.Series, old_company: pd.Series) -> pd.Series:
        rows = zip(title, old_title, company, old_company, strict=True)
        return pd.Series([company_alike(c, d) and title_alike(t, u) for t, u, c, d in rows], dtype=bool)

    old = first.select(F.col("title").alias("old_title"), F.col("company").alias("old_company"), F.col("seq").alias("earlier"))
    pairs = first.where(~F.col("old")).join(alike_companies, "company").join(alike_titles, "title").join(old, ["old_title", "old_company"]).where("earlier < seq")
    edges = written(pairs.where(both("title", "old_title", "company", "old_company")).select("seq", "earlier"), "edges")
    kept = first.where(~F.col("old")).select("seq").join(first_without_alike(edges), "seq", "left_anti")
    # What a kept row stands for: later rows of its title and company are duplicates of it.
    free = named.where("company = '' or title = ''").select("seq")
    return rows.join(kept.unionByName(free), "seq", "left_semi")


def _written_out(text: str) -> str:
    return " ".join(ABBREVIATIONS.get(w, w) for w in text.split())


def legacy_id(url: Column, title: Column, company: Column) -> Column:
    """The id of a posting in stores that older versions have kept, of the url as it was given; null without a url."""
    part = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
    return F.when(F.coalesce(url, F.lit("")) != "", F.substring(F.sha2(F.concat_ws("|", part(url), part(title), part(company)), 256), 1, 16))


def verdicts(rows: DataFrame, seen: DataFrame, threshold: float = 0.85, recent: DataFrame | None = None) -> DataFrame:
    """``rows(seq, id, title, company, ...)`` with ``verdict``: exact (an id seen before or of an earlier row), fuzzy, or new.

    Rows with a ``url`` are also looked for by their ``legacy_id``. Fuzzy are names alike those of an
    earlier row that is new, or of one in ``recent(title, company)``, names accepted in earlier runs.
    """
    ids = seen.select("id").distinct()
    known = rows.join(ids.withColumn("_seen", F.lit(True)), "id", "left")
    if "url" in rows.columns:
        known = known.withColumn("_legacy_id", legacy_id(F.col("url"), F.col("title"), F.col("company")))
        known = known.join(ids.select(F.col("id").alias("_legacy_id"), F.lit(True).alias("_legacy")), "_legacy_id", "left").withColumn("_seen", F.coalesce("_seen", "_legacy"))
    first = known.where("_seen is null").groupBy("id").agg(F.min("seq").alias("_first"))
    known = known.join(first, "id", "left")
    exact = F.col("_seen").isNotNull() | (F.col("seq") > F.col("_first"))
    kept = fuzzy_first(known.where(~exact).select("seq", "title", "company"), threshold, recent).select("seq", F.lit(True).alias("_kept"))
    out = known.join(kept, "seq", "left").withColumn("verdict", F.when(exact, "exact").when(F.col("_kept").isNull(), "fuzzy").otherwise("new"))
    return out.select(*rows.columns, "verdict")


def pushed(recent: DataFrame, accepted: DataFrame, now: Column, keep: int = 5_000) -> DataFrame:
    """``recent(title, company, pushed_at, seq)`` with ``accepted(seq, title, company)`` of this run added, and the ``keep`` newest of all left.

    Newer by time, then by place in its run. This bound is the feature: what has left the window marks nothing.
    """
    columns = ["title", "company", "pushed_at", "seq"]
    both = recent.select(*columns).unionByName(accepted.select("title", "company", now.alias("pushed_at"), "seq"))
    return both.orderBy(F.desc("pushed_at"), F.desc("seq"), "title", "company").limit(keep)


def marked(seen: DataFrame, ids: DataFrame, today: Column) -> DataFrame:
    """``seen(id, seen_on)`` with ``ids(id)`` seen today: one row an id, the later date, in order."""
    both = seen.select("id", "seen_on").unionByName(ids.select("id", today.alias("seen_on")))
    return both.groupBy("id").agg(F.max("seen_on").alias("seen_on")).orderBy("id")


def purged(rows: DataFrame, valid: Column) -> tuple[DataFrame, int]:
    """The rows for which a predicate holds, and how many went."""
    good = rows.where(F.coalesce(valid, F.lit(False)))
    return good, rows.count() - good.count()
