"""String functions as Column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sources whose urls carry an id, with their host, the parameter and the url it makes; links that are no postings.
ID_PARAMETERS = (
    ("indeed", "indeed.com", r"[?&]jk=([a-fA-F0-9]+)", "https://www.indeed.com/viewjob?jk="),
    ("glassdoor", "glassdoor.com", r"[?&](?:jl|jobListingId)=([0-9]+)", "https://www.glassdoor.com/job-listing/?jl="),
)
PROFILE_LINK = "linkedin.com/in/"
# Secrets, expiry notices, screening hints and abbreviations.
SECRET_PATTERNS = (r"\b(sk|pk|ghp|gho|ghu|ghs|github_pat|AKIA)[A-Za-z0-9_]{16,}\b", r"(?i)bearer\s+[a-z0-9._~+/=-]{20,}")
EXPIRED_TITLE = r"(?i)\b(closed|expired|no longer (?:accepting|available)|filled|ended|terminated|withdrawn|cancelled|canceled)\b"
EXPIRED_PHRASES = ("this position has been filled", "this job is no longer", "this job has expired", "applications are closed", "no longer accepting applications")
SECRET_HINTS = ("api_key", "apikey", "secret", "token", "bearer ", "sk-", "AIza", "password")
INJECTION_HINTS = ("ignore previous", "ignore all previous", "system prompt", "disregard", "you are now", "print your instructions")
ABBREVIATIONS = {
    "ml": "machine learning", "ai": "artificial intelligence", "nlp": "natural language processing", "llm": "large language model", "llms": "large language models",
    "cv": "computer vision", "ds": "data science", "mle": "machine learning engineer", "sde": "software development engineer", "swe": "software engineer",
}


def slugify(text: Column, max_len: int = 64) -> Column:
    """Lower case, other characters than a-z and 0-9 to single hyphens, cut at a word end where there is one."""
    if max_len < 1:
        raise ValueError("max_len must be positive")
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    head = F.substring(slug, 1, max_len + 1)
    cut = F.when(head.contains("-"), F.regexp_replace(head, r"-[^-]*$", "")).otherwise(F.substring(slug, 1, max_len))
    return F.when(F.length(slug) <= max_len, slug).otherwise(cut)


def truncate(text: Column, max_chars: int = 80, ellipsis: str = "...") -> Column:
    """At most ``max_chars`` characters, the ellipsis included."""
    if max_chars < 0 or len(ellipsis) > max_chars:
        raise ValueError("the ellipsis doesn't fit")
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(F.substring(text, 1, max_chars - len(ellipsis)), F.lit(ellipsis)))


def count_words(text: Column) -> Column:
    """Runs of other characters than Unicode white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def redact_secrets(text: Column, replacement: str = "[REDACTED]") -> Column:
    """API keys, then bearer tokens, replaced by the given text as it stands."""
    plain = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return reduce(lambda t, p: F.regexp_replace(t, p, plain), SECRET_PATTERNS, text)


def normalize_text(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits to one blank; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\W_]+", " "))


def keyword_match(text: Column, keywords: list[str]) -> Column:
    """Whether a text has one of the keywords: phrases as substrings, single words as whole tokens."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tokens = F.regexp_extract_all(low, F.lit(r"[a-z0-9+#]+"), F.lit(0))
    words = [k.lower() for k in keywords if " " not in k]
    tests = [low.contains(k.lower()) for k in keywords if " " in k]
    if words:
        tests.append(F.arrays_overlap(tokens, F.array(*map(F.lit, words))))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def job_type(raw: Column) -> Column:
    """full-time, part-time, contract or unknown; the first that occurs in this order."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(low.contains("full"), "full-time").when(low.contains("part"), "part-time").when(low.contains("contract") | low.contains("freelance"), "contract").otherwise("unknown")


def is_expired(title: Column, description: Column) -> Column:
    told = F.transform(F.array(F.lower(F.coalesce(description, F.lit("")))), lambda low: reduce(lambda a, b: a | b, (low.contains(p) for p in EXPIRED_PHRASES)))
    return F.coalesce(F.trim(title), F.lit("")).rlike(EXPIRED_TITLE) | F.get(told, F.lit(0))


def screen_text(text: Column) -> Column:
    """Why a text must not be sent on: ordered reasons. A hint with capitals never occurs in lowered text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    reasons = [(h, f"possible secret ('{h}')") for h in SECRET_HINTS] + [(h, f"possible prompt injection ('{h}')") for h in INJECTION_HINTS]
    return F.array_compact(F.array(*(F.when(low.contains(h), r) for h, r in reasons)))


def expand_abbreviations(text: Column) -> Column:
    """Known abbreviations written out, by whole token."""
    known = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.coalesce(F.element_at(known, w), w)), " ")


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 where both are empty."""
    x, y = (F.filter(F.split(c, " "), lambda w: w != "") for c in (a, b))
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(0.0)


def valid_hostname(host: Column) -> Column:
    """Length, labels and a letter somewhere."""
    label = lambda p: (F.length(p).between(1, 63)) & p.rlike(r"(?U)^\w(?:[\w-]*\w)?$") & ~p.contains("_")
    return F.coalesce((F.length(host) <= 253) & F.forall(F.split(host, r"\."), label) & host.rlike(r"(?U)\p{L}"), F.lit(False))


def strip_html(text: Column, least: int = 20) -> Column:
    """Tags to blanks, trimmed; null where fewer than ``least`` characters are left."""
    plain = F.trim(F.regexp_replace(text, r"<[^>]+>", " "))
    return F.when(F.length(plain) >= least, plain)


def strip(text: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def base_url(url: Column) -> Column:
    """The url without query string and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def canonical_url(url: Column, source: Column) -> Column:
    """One url for all that lead to a posting: those of a source with an id parameter are rebuilt from it, others stay; null becomes empty."""
    out = url
    for name, host, parameter, form in reversed(ID_PARAMETERS):
        found = F.regexp_extract(url, parameter, 1)
        out = F.when((F.coalesce(source == name, F.lit(False)) | url.contains(host)) & (found != ""), F.concat(F.lit(form), found)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def posting_id(url: Column, title: Column, company: Column, source: Column) -> Column:
    """16 hex digits of SHA-256 over the trimmed lower-case parts."""
    parts = (canonical_url(url, source), title, company)
    return F.substring(F.sha2(F.concat_ws("|", *(strip(F.lower(F.coalesce(c, F.lit("")))) for c in parts)), 256), 1, 16)


def valid_job_url(url: Column) -> Column:
    """http or https, and not a link to somebody's profile."""
    low = strip(F.lower(F.coalesce(url, F.lit(""))))
    return low.rlike("^https?://") & ~low.contains(PROFILE_LINK)


def domains(raw: Column, most: int = 15) -> Column:
    """The valid host names of a comma-separated list, each once, in order."""
    names = F.filter(F.transform(F.split(F.lower(raw), ","), strip), valid_hostname)
    return F.slice(F.array_distinct(names), 1, most)


def short_slug(text: Column, most: int = 40) -> Column:
    """White space to single blanks, cut at a number of characters."""
    return F.substring(strip(F.regexp_replace(text, r"(?U)\s+", " ")), 1, most)


def topic_keywords(title: Column, takeaway: Column) -> Column:
    """The title's words of more than two characters and the first three of the takeaway; one word if there are none."""
    long = lambda text: F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 2)
    some = F.concat(long(F.translate(F.coalesce(title, F.lit("")), "-", " ")), F.slice(long(F.coalesce(takeaway, F.lit(""))), 1, 3))
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("coding")))


def shell_quoted(path: Column) -> Column:
    """A path inside single quotes: each quote of its own is closed, escaped and opened again."""
    return F.replace(path, F.lit("'"), F.lit("'\\''"))


def session_name(source: Column) -> Column:
    """A source's name as part of a file name; raises for an empty one or one that leads elsewhere."""
    bad = F.coalesce(source == "", F.lit(True)) | source.rlike(r"[/\\]|\.\.")
    return F.when(bad, F.raise_error(F.concat(F.lit("not a source name: "), F.coalesce(source, F.lit("")))).cast("string")).otherwise(source)


def embedded_json(text: Column) -> Column:
    """What a fenced block holds, else what stands from the first brace to the last; null if there is neither."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.nullif(F.when(fenced != "", fenced).otherwise(braces), F.lit(""))


def decision_token(log: Column) -> Column:
    """The last LOOP_ token of a log; continue if there is none."""
    found = F.regexp_extract_all(log, F.lit(r"LOOP_(DONE|FAIL|CONTINUE)"), F.lit(1))
    return F.lower(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("CONTINUE")))
