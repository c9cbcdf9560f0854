"""A course of days and topics: storyboards put together from drafts, progress files checked, days folded from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.functions.text import screen_text


def assembled(draft: Column, template: Column, n: int = 6) -> Column:
    """Exactly n scenes: the draft's, with blank fields from the template's scene at the same place; missing ones from the template.

    Both are arrays of structs with the same text fields.
    """
    def scene(i: Column) -> Column:
        d, t = F.get(draft, i - 1), F.get(template, F.pmod(i - 1, F.size(template)))
        return F.struct(i.alias("scene_number"), *(F.coalesce(F.when(F.trim(d[f]) != "", d[f]), t[f]).alias(f) for f in ("voiceover", "prompt")))

    return F.transform(F.sequence(F.lit(1), F.lit(n)), scene)


def screened(scenes: Column, captions: Column) -> Column:
    """Every problem of a storyboard as ``label: reason``: scenes in order, then captions by key."""
    of = lambda label, text: F.transform(screen_text(text), lambda r: F.concat(label, F.lit(": "), r))
    parts = F.transform(scenes, lambda s: of(F.concat(F.lit("scene "), s["scene_number"].cast("string")), s["voiceover"]))
    notes = F.transform(F.array_sort(F.map_keys(captions)), lambda k: of(F.concat(F.lit("caption "), k), F.element_at(captions, k)))
    return F.flatten(F.concat(parts, notes))


def planner(key: Column, draft_ok: Column, strict: Column) -> Column:
    """Which planner a day gets: the model where there is a key and its draft is usable, an error where that is a must, else the template."""
    model = F.coalesce(key != "", F.lit(False)) & F.coalesce(draft_ok, F.lit(False))
    return F.when(model, "model").when(strict, "error").otherwise("template")


def progress_error(p: Column) -> Column:
    """What makes a progress record unusable, the first reason in a fixed order; null for a sound one.

    ``p`` is a struct of texts, null where a key is missing: schema_version (none or up to 1), project_url
    and edit_url (one of them will do), segments_done, duration_s, target_s, clip_s (all needed, the
    last two above 0), day (none or a number), pending_extend (none or yes or no), and prompts, an array
    without blanks. A number is a text of digits. Money is at stake: what doesn't parse is an error.
    """
    n = {f: p[f].try_cast("long") for f in ("schema_version", "day", "segments_done", "duration_s", "target_s", "clip_s")}
    parses = lambda f: p[f].isNull() | n[f].isNotNull()
    counters = [parses(f) for f in ("segments_done", "duration_s", "target_s", "clip_s")]
    rules = [
        ("record", p.isNotNull()),
        ("schema_version", parses("schema_version") & (F.coalesce(n["schema_version"], F.lit(1)) <= 1)),
        ("url", F.concat_ws("", p["project_url"], p["edit_url"]) != ""),
        ("counter", counters[0] & counters[1] & counters[2] & counters[3]),
        ("day", parses("day")),
        ("pending_extend", p["pending_extend"].isNull() | F.trim(F.lower(p["pending_extend"])).isin("true", "false", "1", "0", "yes", "no")),
        ("range", (n["segments_done"] >= 0) & (n["duration_s"] >= 0) & (n["target_s"] > 0) & (n["clip_s"] > 0)),
        ("prompts", (F.size(p["prompts"]) > 0) & F.forall(p["prompts"], lambda x: F.coalesce(x.rlike(r"\S"), F.lit(False)))),
    ]
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules))


def resumed_segments(done: Column, pending: Column, recorded_s: Column, duration_s: Column, clip_s: Column) -> Column:
    """How many segments a resumed run has; raises if the file is shorter than its record.

    A longer file has the pending segment, or as many as its length shows. In a file of the recorded
    length the pending one hasn't landed, and isn't counted.
    """
    grown = F.greatest(done + pending.cast("long"), F.floor(duration_s / clip_s))
    return F.when(duration_s < recorded_s, F.raise_error(F.lit("the file is shorter than its record")).cast("long")).when(duration_s > recorded_s, grown).otherwise(done.cast("long"))


def generation_finished(stop_shown: Column, videos: Column, download: Column, done_button: Column, thumbnail: Column) -> Column:
    """A generation has ended: nothing to stop, and a sign of its result: a video, a download, a button that says so, or a thumbnail. Null is no sign."""
    sign = [F.coalesce(c, F.lit(False)) for c in (videos > 0, download, done_button, thumbnail)]
    return ~F.coalesce(stop_shown, F.lit(False)) & (sign[0] | sign[1] | sign[2] | sign[3])


def fails_fast(asked: Column, headless: Column, terminal: Column) -> Column:
    """Whether a run gives up at once where it would need a person: if asked by "1" and nothing else, without a screen, or where nobody can answer."""
    return F.coalesce(asked == "1", F.lit(False)) | F.coalesce(headless, F.lit(False)) | ~F.coalesce(terminal, F.lit(False))


def int_map(raw: Column) -> Column:
    """A map of whole numbers from JSON; entries that aren't any, and what isn't a map, are left out."""
    texts = F.from_json(raw, "map<string,string>")
    kept = F.map_filter(texts, lambda _, v: v.try_cast("int").isNotNull())
    return F.coalesce(F.transform_values(kept, lambda _, v: v.try_cast("int")), F.create_map().cast("map<string,int>"))


def day_states(events: DataFrame, most: int = 3) -> DataFrame:
    """``events(day, seq, kind, clip, topic_id)`` -> a day's ``topic_id, status, attempts, completed, exhausted``.

    Kinds: start, resume, clip_done, clip_failed, finish, fail, block. The last of start, resume, finish,
    fail and block gives the status; starts are attempts; a clip that failed ``most`` times and never
    was done is exhausted.
    """
    named = F.create_map(*(F.lit(x) for kv in {"start": "in_progress", "resume": "in_progress", "finish": "done", "fail": "failed", "block": "blocked"}.items() for x in kv))
    status = F.try_element_at(named, F.col("kind"))
    clips = events.where("clip is not null").groupBy("day", "clip").agg(F.bool_or(F.col("kind") == "clip_done").alias("done"), F.count_if(F.col("kind") == "clip_failed").alias("failed"))
    per_day = clips.groupBy("day").agg(F.count_if("done").alias("completed"), F.count_if(~F.col("done") & (F.col("failed") >= most)).alias("exhausted"))
    states = events.groupBy("day").agg(F.max_by("topic_id", F.when(F.col("topic_id").isNotNull(), F.col("seq"))).alias("topic_id"), F.max_by(status, F.when(status.isNotNull(), F.col("seq"))).alias("status"), F.count_if(F.col("kind") == "start").alias("attempts"))
    out = states.join(per_day, "day", "left")
    return out.select("day", "topic_id", "status", "attempts", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("completed", "exhausted")))


def topic_by(topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(key)`` -> the topic with that id, else the first whose title holds the key; topics are a short list of configuration."""
    t = F.broadcast(topics.select("id", "title", "seq"))
    k = F.lower("key")
    hit = wanted.select("key").distinct().join(t, (F.col("id") == F.col("key")) | F.lower("title").contains(k))
    return hit.groupBy("key").agg(F.min(F.struct(F.col("id") != F.col("key"), "seq", "id", "title")).alias("t")).select("key", "t.id", "t.title")
