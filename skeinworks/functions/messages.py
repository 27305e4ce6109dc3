"""Columns over arrays of messages, struct<role, content>."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

USER, ASSISTANT = "user", "assistant"
MESSAGES = "array<struct<role:string,content:string>>"

#: Spellings of the roles in releases; fixed values.
ROLE_NAMES = {"user": USER, "human": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "llm": ASSISTANT}
EXACT_ROLES = {USER: USER, ASSISTANT: ASSISTANT}


def falsy_or(value: Column, default: Column | str = "") -> Column:
    """``value``, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def clean(raw: Column, *, role: str = "role", content: str = "content", roles: Mapping[str, str] = EXACT_ROLES, role_fallback: str | None = None) -> Column:
    """The messages of known roles, in order, roles renamed by ``roles`` and null content made empty.

    ``role_fallback`` names a field that gives the role where ``role`` is null or empty.  A null array is an empty one.
    """
    names = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))

    def renamed(m: Column) -> Column:
        found = m[role] if role_fallback is None else falsy_or(m[role], m[role_fallback])
        return F.struct(F.element_at(names, found).alias("role"), F.coalesce(m[content], F.lit("")).alias("content"))

    return F.coalesce(F.filter(F.transform(raw, renamed), lambda m: m["role"].isNotNull()), F.array().cast(MESSAGES))


def role_count(messages: Column, role: str) -> Column:
    return F.size(F.filter(messages, lambda m: m["role"] == role)).cast("long")


def characters(messages: Column) -> Column:
    """Code points of all contents."""
    return F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.length(F.coalesce(m["content"], F.lit(""))))


def stable_id(dataset: Column, source_id: Column) -> Column:
    return F.substring(F.sha2(F.concat(dataset, F.lit("\0"), source_id), 256), 1, 24)


def compact_json(value: Column) -> Column:
    """JSON without spaces that keeps null fields; control characters are escaped in lower case.

    An escape follows an even number of backslashes.  The few texts that have such escapes are cut at backslashes and what they escape, once.
    """
    text = F.to_json(value, {"ignoreNullFields": "false"})
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\u[0-9A-F]{4}|\\.|[^\\]+"), F.lit(0))
    lowered = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\\u"), F.lower(p)).otherwise(p)), "")
    return F.when(text.rlike(r"\\u00[01][A-F]"), lowered).otherwise(text)


def transcript_hash(messages: Column) -> Column:
    return F.sha2(compact_json(messages), 256)


def alternates(messages: Column) -> Column:
    """Whether the roles are user, assistant, over and over, as often as there are users."""
    users = F.size(F.filter(messages, lambda m: m["role"] == USER))
    return F.transform(messages, lambda m: m["role"]) == F.flatten(F.array_repeat(F.array(F.lit(USER), F.lit(ASSISTANT)), users))


def turn_labels(messages: Column) -> Column:
    """``U1``, ``A1``, ... for each message; whatever isn't a user counts as an assistant.

    The places of users and of others are numbered apart and put together by place.
    """
    places = F.transform(messages, lambda m, i: F.struct(i.alias("at"), F.coalesce(m["role"] == USER, F.lit(False)).alias("user")))
    numbered = lambda kind, letter: F.transform(F.filter(places, kind), lambda p, k: F.struct(p["at"].alias("at"), F.concat(F.lit(letter), (k + 1).cast("string")).alias("label")))
    both = F.concat(numbered(lambda p: p["user"], "U"), numbered(lambda p: ~p["user"], "A"))
    return F.transform(F.array_sort(both), lambda p: p["label"])


def realized_path(history: Column, *, chosen: str = "if_chosen") -> Column:
    """Of candidate replies the chosen ones: user messages, and model messages with ``chosen`` strictly true."""
    return F.filter(history, lambda m: (m["role"] == "user") | ((m["role"] == "model") & m[chosen].eqNullSafe(F.lit(True))))


def from_pairs(pairs: Column, *, question: str, answer: str) -> Column:
    """Each pair as a user message and an assistant message."""
    say = lambda role, text: F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    return F.flatten(F.transform(pairs, lambda p: F.array(say(USER, p[question]), say(ASSISTANT, p[answer]))))
