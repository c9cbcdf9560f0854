"""Plans of fixed length, and validation rules with the first that fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scenes(topic: Column, narrations: list[str], n: int = 6, seconds: int = 10) -> Column:
    """Exactly n scenes; narrations are taken in turn."""
    lines = F.array(*map(F.lit, narrations))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.alias("scene_number"), F.lit(seconds).alias("duration_sec"), F.concat(F.element_at(lines, F.pmod(i - 1, F.lit(len(narrations))) + 1), F.lit(" "), topic).alias("voiceover")))


def extend_plan(prompts: Column, target: Column, clip: Column, filler: str) -> Column:
    """ceil(target / clip) prompts, cut or filled up."""
    n = F.ceil(target / clip).cast("int")
    return F.slice(F.concat(prompts, F.array_repeat(F.lit(filler), n)), 1, n)


def final_error(has_video: Column, has_audio: Column, width: Column, height: Column, duration: Column, expected: Column, aspect: float = 9 / 16, tolerance_s: int = 5) -> Column:
    """The first rule that a finished file breaks; null if none."""
    ratio = F.when(height > 0, width / height).otherwise(0.0)
    return F.coalesce(
        F.when(~has_video, "no video stream"), F.when(~has_audio, "no audio stream"),
        F.when(~ratio.between(aspect - 0.03, aspect + 0.03), "aspect"), F.when(~duration.between(expected - tolerance_s, expected + tolerance_s), "duration"),
    )
