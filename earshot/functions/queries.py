"""What a search query asks for: its words, phrases, speaker role and kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.text import content_tokens, tokens

#: Words that open a question.
QUESTION_WORDS = """
what how why when where who which whose whom is are was were do does did can could should would
will has have had tell explain describe
""".split()

#: Fixed value: what the sentence encoder expects before a query (never before a passage).
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def encoder_input(text: Column, *, is_query: bool) -> Column:
    """The text that a sentence encoder is given."""
    return F.concat(F.lit(QUERY_PREFIX), text) if is_query else text


#: Fixed format: how a query names the role of the speaker.
ROLE = r"(?i)\brole:(host|guest)\b"


def parsed(raw: Column, role: Column | None = None) -> dict[str, Column]:
    """Columns text, phrases, role, toks and content of a raw query; a ``role`` given beside the query wins.

    Null queries count as empty ones.
    """
    raw = F.coalesce(raw, F.lit(""))
    said = F.regexp_extract(raw, ROLE, 1)
    body = F.regexp_replace(raw, ROLE, " ")
    phrases = F.transform(F.regexp_extract_all(body, F.lit('"([^"]{1,200})"'), F.lit(1)), lambda p: F.trim(p))
    text = F.trim(F.regexp_replace(F.replace(body, F.lit('"'), F.lit(" ")), r"\s+", " "))
    found = F.when(said != "", F.lower(said))
    return {
        "text": text,
        "phrases": F.filter(phrases, lambda p: p != ""),
        "role": found if role is None else F.coalesce(role, found),
        "toks": tokens(text),
        "content": content_tokens(tokens(text)),
    }


def intent(text: Column, phrases: Column, toks: Column, content: Column) -> Column:
    """phrase, question, keyword or topic, in that order of precedence."""
    asks = text.endswith("?") | F.coalesce(F.get(toks, 0).isin(QUESTION_WORDS), F.lit(False))
    short = (F.size(content) <= 2) & (F.size(toks) <= 3)
    return F.when(F.size(phrases) > 0, "phrase").when(asks, "question").when(short, "keyword").otherwise("topic")
