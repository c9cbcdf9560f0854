"""Feed posts and guest cards: a title for a post, a post as a posting, and the verdict on a card's details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.functions.text import strip
from tarnmill.operators import law, residency

TITLE_LENGTH = 140

# What opens a post to the whole world and what takes that back, labels that a feed never yields,
# what closes a guest card, and what says that one is remote.
OPEN_POST = ("worldwide", "work from anywhere", "anywhere in the world", "global remote", "globally remote", "anywhere in world")
OFFICE_POST = ("on-site", "onsite", "in-office", "hybrid")
DROPPED_LABELS = ("Domestic", "Restricted", "USA", "UK", "India", "Germany", "Canada")
CLOSED = ("no longer accepting applications", "this job is closed")
REMOTE_HEADER = ("remote", "work from home", "wfh", "anywhere", "telecommute", "virtual", "worldwide")
REMOTE_DETAIL = (
    "100% remote", "fully remote", "100% work from home", "fully work from home", "remote position", "remote role", "work remotely", "working remotely",
    "remote opportunity", "remote job", "remote candidate", "globally distributed",
)
HIRING_HEADLINE = r"(?i)(?U)\b(?:hir(?:e|ing|es)|job|vacanc|opportunit|open(?:ing|ing s)?)\b"
RANK_ONLY = r"^•?\s*[123](?:st|nd|rd)\+?\s*$"


def _named(low: Column, phrases) -> Column:
    """Whether one of the phrases stands anywhere in a lower-case text."""
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


def post_title(text: Column, headline: Column) -> Column:
    """A posting's title from a feed post, at most 140 characters.

    The author's headline if it speaks of hiring in its first 300 characters (one that only gives a
    rank of acquaintance is none), else the first line that does, without dots and bullets behind it,
    else the first line. Without any text the headline, and ``Hiring`` without that. Null counts as empty.
    """
    header, body = strip(F.coalesce(headline, F.lit(""))), strip(F.coalesce(text, F.lit("")))
    header = F.when(header.rlike(RANK_ONLY), F.lit("")).otherwise(header)
    lines = F.transform(F.split(body, "\n"), strip)
    hiring = F.regexp_replace(F.get(F.filter(lines, law.hiring_post), F.lit(0)), r"\s+[…•·]+$", "")
    found = F.when(F.substring(header, 1, 300).rlike(HIRING_HEADLINE), header)
    some = lambda c: F.nullif(c, F.lit(""))
    return F.substring(F.coalesce(found, some(hiring), some(F.get(lines, F.lit(0))), some(header), F.lit("Hiring")), 1, TITLE_LENGTH)


def post_label(text: Column) -> Column:
    """The location of a post: ``Worldwide`` where its words open it and none speaks of an office, else the guess from its words."""
    return law.once(law.read(text), _label)


def _label(t: Column) -> Column:
    return F.when(_named(t["low"], OPEN_POST) & ~_named(t["low"], OFFICE_POST), F.lit("Worldwide")).otherwise(law.placed(t))


def postings(posts: DataFrame, since: Column | None = None) -> DataFrame:
    """Feed posts ``(text, url, headline, author, posted, keyword, ...)`` as raw postings, those that aren't any left out.

    A post stays if it has text and a link that isn't a person's, offers a job, and its location is open
    to the world by label and text. One with an ISO date before ``since`` goes; any other date, or none,
    stays. The description is the whole text. Nulls count as empty; other columns are kept unless
    a column of the posting has their name.
    """
    text, url, posted = (strip(F.coalesce(F.col(c), F.lit(""))) for c in ("text", "url", "posted"))
    empty = F.lit(None).cast("string")
    closed = lambda label: F.exists(F.array(*map(F.lit, DROPPED_LABELS)), lambda k: F.contains(label, k))

    def judged(t: Column) -> Column:
        """The label of a text that is read, null if it is no open posting."""
        kept = lambda label: F.when((label != "") & ~label.isin("Onsite", "Hybrid") & ~closed(label) & residency.worldwide(label, empty, empty, t["text"])["open"], label)
        return F.when((t["text"] != "") & law.is_hiring(t), law.once(_label(t), kept))

    # A text is read once: what an outer generator made isn't computed again by the filter behind it.
    rows = posts.where((url != "") & ~url.contains("linkedin.com/in/")).withColumn("_read", F.explode_outer(F.array(law.once(law.read(text), lambda t: F.struct(t["text"].alias("text"), judged(t).alias("label"))))))
    rows, text, label = rows.where(F.col("_read.label").isNotNull()), F.col("_read.text"), F.col("_read.label")
    day = F.substring(posted, 1, 10)
    if since is not None:
        on = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))
        rows = rows.where(on.isNull() | (on >= since.cast("date")))
    made = {
        "source": F.lit("linkedin"), "title": post_title(F.col("text"), F.col("headline")), "company": F.coalesce(F.nullif(strip(F.col("author")), F.lit("")), F.lit("Unknown")),
        "url": url, "location": label, "posted_date": F.nullif(day, F.lit("")), "description": text, "tags": F.array("keyword"),
    }
    taken = {*made, "text", "headline", "author", "posted", "keyword", "_read"}
    return rows.select(*(c for c in posts.columns if c not in taken), *(v.alias(k) for k, v in made.items()))


def guest_verdict(title: Column, location: Column, description: Column) -> Column:
    """``struct<ok, reason>`` of a guest card with its details: closed, then the location rules of guests, then a sign that it is remote.

    The reason is ``closed``, the first flag that hit, or ``remote_marker``; empty if the card passes.
    A null is an empty text.
    """
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (title, location, description)]
    place = r"\b(?:location|workplace|workplace\s+type)\s*:\s*remote\b|\bremote[,\s]+pakistan\b|\bpakistan[,\s]+remote\b"
    remote = _named(F.concat_ws(" ", *low[:2]), REMOTE_HEADER) | _named(low[2], REMOTE_DETAIL) | low[2].rlike("(?U)" + place)
    by_law = law.once(law.verdict(location, title, description, "guest", F.lit("linkedin"))["reason"], lambda hit: F.when(hit != "", hit).when(~remote, F.lit("remote_marker")).otherwise(""))
    reason = F.when(_named(F.concat_ws(" ", *low), CLOSED), F.lit("closed")).otherwise(by_law)
    return law.once(reason, lambda r: F.struct((r == "").alias("ok"), r.alias("reason")))
