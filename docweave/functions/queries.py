"""Query preparation, Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .common import SPACE, is_blank, let, trim_all

#: Query types in order of precedence, and the phrases that speak for each.
KEYWORDS = {
    "ExplicitFact": ["what is", "who is", "when did", "when was", "where is", "where was", "define", "list", "name", "show me", "tell me about"],
    "ImplicitFact": ["why", "how", "explain", "describe", "причина", "як", "чому", "what causes", "what leads to", "what makes"],
    "InterpretableRationale": ["compare", "analyze", "evaluate", "difference", "порівняти", "аналізувати", "contrast", "versus", "vs", "pros and cons", "advantages"],
    "HiddenRationale": ["should", "opinion", "think", "better", "recommend", "best", "prefer", "suggest", "would you", "do you think"],
}
TYPES = list(KEYWORDS)
#: What a reply may hold to name a type, in order of tests.
REPLIES = {"explicit": "ExplicitFact", "implicit": "ImplicitFact", "interpretable": "InterpretableRationale", "hidden": "HiddenRationale"}


def normalize(text: Column) -> Column:
    return F.regexp_replace(F.lower(trim_all(text)), f"{SPACE}+", " ")


def language(text: Column) -> Column:
    """"uk" if any character is Cyrillic, else "en"."""
    return F.when(F.coalesce(text.rlike("[\\u0400-\\u04FF]"), F.lit(False)), "uk").otherwise("en")


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def query_type(text: Column) -> Column:
    """The type with most of its phrases in the text; the first of equals, and of none."""
    low = F.lower(text)
    scores = [reduce(lambda a, b: a + b, [F.contains(low, F.lit(k)).cast("int") for k in words]) for words in KEYWORDS.values()]
    best = let(F.array(*scores), lambda s: F.element_at(F.array(*map(F.lit, TYPES)), F.array_position(s, F.array_max(s)).cast("int")))
    return F.when(is_blank(text), TYPES[0]).otherwise(best)


def reply_type(reply: Column) -> Column:
    """The type that a free-text reply names, by word or by number; ExplicitFact if none."""
    plain = F.translate(F.lower(trim_all(reply)), "_-", "")
    first, *rest = REPLIES.items()
    out = reduce(lambda c, x: c.when(F.contains(plain, F.lit(x[0])), x[1]), rest, F.when(F.contains(plain, F.lit(first[0])), first[1]))
    out = reduce(lambda c, i: c.when(trim_all(reply) == str(i + 1), TYPES[i]), range(4), out)
    return out.otherwise(TYPES[0])


def fingerprint(query: Column) -> Column:
    return F.concat(F.lit("qc_"), F.substring(F.upper(F.sha2(F.lower(trim_all(query)), 256)), 1, 16))


def answer_key(query: Column, context: Column) -> Column:
    return F.concat(F.lit("query:"), F.sha2(F.concat(query, F.lit("|"), context), 256))
