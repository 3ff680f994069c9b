"""Text columns shared by several operators, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How agents write that there is no content, in lower case and without brackets and marks.
STAND_INS = (
    "null", "none", "nil", "nan", "undefined", "n/a", "na", "empty", "blank", "missing", "void",
    "no content", "no contents", "no text", "no message", "no output", "no response", "no answer", "no reply", "no data",
    "empty response", "empty message", "empty content", "empty output", "empty reply", "empty answer", "empty string",
    "content missing", "content unavailable", "content not available", "not available", "no content available",
)

#: Spellings of the two speakers.
USER_ROLES = ("user", "human", "customer", "prompter", "me", "you", "developer user", "end user", "end-user", "end_user")
ASSISTANT_ROLES = ("assistant", "model", "ai", "bot", "agent", "gpt", "llm", "assistant_message", "ai assistant", "chatbot")

#: What an agent may put around a stand-in.
_WRAP = r"[\s\p{Z}\p{Cf}\[\](){}<>\"'`*_.:;!-]"


def is_blank(text: Column) -> Column:
    """True where text is null, has no letter or digit, or only says that there is nothing."""
    core = F.regexp_replace(F.lower(text), rf"^{_WRAP}+|{_WRAP}+$", "")
    # Nearly always one of the first characters decides, without the whole text.
    solid = F.substring(text, 1, 32).rlike(r"[\p{L}\p{N}]") | text.rlike(r"[\p{L}\p{N}]")
    return F.coalesce(~solid | ((F.length(text) < 60) & core.isin(*STAND_INS)), F.lit(True))


def speaker(role: Column) -> Column:
    """user, assistant, another role in lower case, or null where there is none."""
    plain = F.lower(F.regexp_replace(role, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return (
        F.when(plain.isin(*USER_ROLES), "user")
        .when(plain.isin(*ASSISTANT_ROLES), "assistant")
        .when(plain.isin("", "null", "none", "undefined", "unknown", "n/a", "nan"), F.lit(None))
        .otherwise(plain)
    )


def instant(text: Column) -> Column:
    """The instant a time text names: ISO forms with or without zone (then UTC), or epoch seconds or milliseconds."""
    plain = F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    zoned = F.when(plain.rlike(r"([zZ]|UTC|GMT|[+-]\d{2}:?\d{2})$"), plain).otherwise(F.concat(plain, F.lit("Z")))
    iso = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}"), zoned.try_cast("timestamp")).when(
        plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(plain, F.lit("T00:00:00Z")).try_cast("timestamp")
    )
    number = F.when(plain.rlike(r"^\d{10}(\.\d{1,6})?$"), plain.try_cast("double")).when(
        plain.rlike(r"^\d{13}$"), plain.try_cast("double") / 1000.0
    )
    return F.coalesce(iso, number.try_cast("timestamp"))
