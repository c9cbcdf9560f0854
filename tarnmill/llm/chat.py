r"""Chat formatting by a grammar round trip, in DataFrame functions only.

    user         [INST] text [/INST]
    assistant    <s>text</s>
    system       <<SYS>>text<</SYS>>
    other roles  <<ROLE>>role<</ROLE>>text</s>

The parser is deterministic: it cuts a rendered text into turns, each up to its first closing mark,
and refuses a text with anything between turns or a mark inside one; a backslash in a turn stands
for nothing, and the character after it for itself. Each turn is rendered as it is, reparsed and
compared with its source; where they differ, the marks in it are escaped (a backslash after the
first character, and after every backslash); where they differ still, every character that could
begin a mark is. The whole conversation is then reparsed and compared again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

_ANY_MARK = r"</?s>|<</?(?:SYS|ROLE)>>|\[/?INST\]"
_ESCAPES = [None, r"\\|<(?=/?s>|</?(?:SYS|ROLE)>>)|\[(?=/?INST\])", r"[\\<\[]"]
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|<<ROLE>>.*?<</ROLE>>.*?</s>"


def escape(text: Column, level: int) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPES[level]), F.lit(r"$0\\")) if level else text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _opening(role: Column, level: int) -> Column:
    other = F.concat(F.lit("<<ROLE>>"), escape(role, max(level, 1)), F.lit("<</ROLE>>"))
    return F.when(role == "user", "[INST] ").when(role == "assistant", "<s>").when(role == "system", "<<SYS>>").otherwise(other)


def _closing(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "system", "<</SYS>>").otherwise("</s>")


def _inner(turn: Column, opening: str, closing: str) -> Column:
    return F.substring(turn, F.lit(len(opening) + 1), F.length(turn) - len(opening) - len(closing))


def _parsed_turn(turn: Column) -> Column:
    """role, text, and the text as it stands in the rendered form."""
    head = F.regexp_extract(turn, r"(?s)^<<ROLE>>(.*?)<</ROLE>>", 1)
    rest = F.substring(turn, F.length(head) + 18, F.length(turn) - F.length(head) - 21)
    role = F.when(turn.startswith("[INST] "), "user").when(turn.startswith("<s>"), "assistant").when(turn.startswith("<<SYS>>"), "system").otherwise(unescape(head))
    body = F.when(turn.startswith("[INST] "), _inner(turn, "[INST] ", " [/INST]")).when(turn.startswith("<s>"), _inner(turn, "<s>", "</s>")).when(turn.startswith("<<SYS>>"), _inner(turn, "<<SYS>>", "<</SYS>>")).otherwise(rest)
    return F.struct(role.alias("role"), unescape(body).alias("text"), body.alias("body"))


def parse(formatted: Column) -> Column:
    """Rendered text -> ``array<struct<role, text, body>>``; null for a text that the grammar doesn't make."""
    whole = lambda cut, turns: (F.array_join(cut, "") == formatted) & ~F.exists(turns, lambda t: t["body"].rlike(_ANY_MARK))
    turns = lambda cut: let(F.transform(cut, _parsed_turn), lambda turns: F.when(whole(cut, turns), turns))
    return let(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turns)


def _same(formatted: Column, role: Column, text: Column) -> Column:
    one = lambda turns: (F.size(turns) == 1) & (F.get(turns, F.lit(0))["role"] == role) & (F.get(turns, F.lit(0))["text"] == text)
    return F.coalesce(let(parse(formatted), one), F.lit(False))


def format_chat(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, ...)`` -> a row per conversation: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` has the start (code points) and length of each assistant's text in ``formatted``, as
    it stands there. Turns stand by ``turn`` (null first), rows of one turn by role and text; repeated
    rows are turns of their own. A null text or role counts as empty; an empty role is one of the
    others. Rows without conv_id make one conversation. An empty table gives no conversations; other
    columns are ignored. One that didn't survive the round trip would raise an error.
    """
    role, text = F.col("role"), F.col("text")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    forms = []
    for level in range(len(_ESCAPES)):
        forms.append(F.struct(_opening(role, level).alias("head"), escape(text, level).alias("body"), _closing(role).alias("tail")))
    chosen = F.raise_error(F.lit("a turn doesn't survive the round trip")).cast(turns.select(forms[0]).schema[0].dataType)
    for form in reversed(forms):
        chosen = F.when(_same(F.concat(form["head"], form["body"], form["tail"]), role, text), form).otherwise(chosen)
    turns = turns.withColumn("form", chosen).select("conv_id", "turn", "role", "text", "form.*")
    size = F.length("head") + F.length("body") + F.length("tail")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "role", "text", "head", "body", "tail"))).alias("t"))
    rows = rows.withColumn("formatted", F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], t["tail"])), ""))
    plain = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    same = F.coalesce(plain(parse(F.col("formatted"))) == plain(F.col("t")), F.lit(False))
    spoken = F.filter("t", lambda t: t["role"] == "assistant")
    spans = F.transform(spoken, lambda t: F.struct((t["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length")))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't survive the round trip")).cast("string"))
    return rows.select("conv_id", checked.alias("formatted"), spans.alias("loss_spans"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """What ``format_chat`` wrote, reparsed: adds ``turns`` (``array<struct<role, text, body>>``)."""
    return formatted.withColumn("turns", parse(F.col("formatted")))
