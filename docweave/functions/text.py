"""Text cleaning steps, each Column -> Column."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F

from .common import SPACE, SPACES, let, trim_all

#: Characters that normalisation replaces, and what replaces each.
CHARACTERS = {
    "\u00a0": " ", "\u2003": " ", "\u2002": " ", "\u2009": " ", "\u200b": " ",
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-",
}


#: White space inside a line.
BLANK = f"[{SPACE}&&[^\n]]"
BLANKS = SPACES.replace("\n", "")

#: A character below U+0300 composes with none before it and is composed itself, so that NFC works on each such piece apart.
_PIECE = re.compile("[\x00-\u02ff]?[^\x00-\u02ff]+")


def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _PIECE.sub(lambda m: unicodedata.normalize("NFC", m[0]), x))


def where(text: Column, test: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """``step(text)`` of the texts that a cheap ``test`` holds for; the others are unchanged."""
    return let(text, lambda t: F.when(test(t), step(t)).otherwise(t))


def no_space_before(text: Column, mark: str, space: str) -> Column:
    """No ``space`` before ``mark`` (patterns of one character). White space is frequent and marks are rare: patterns that begin with the mark pass
    over a text many times faster, so that the text is tested, and changed backwards, from the mark on."""
    return where(text, lambda t: t.rlike(f"{mark}(?<={space}{mark})"), lambda t: F.reverse(F.regexp_replace(F.reverse(t), f"({mark}){space}++", "$1")))


def nfc(text: Column) -> Column:
    return F.pandas_udf(_compose, "string")(text)


def normalize_unicode(text: Column) -> Column:
    """NFC, then plain spaces, quotes and dashes. Spark has no NFC function: only texts with characters from U+0300 on, dashes and quotes apart,
    go to Python."""
    composed = F.coalesce(nfc(F.when(text.rlike(r"[^\x00-\u02FF\u2010-\u2027]"), text)), text)
    found = "".join(CHARACTERS)
    return where(composed, lambda t: t.rlike(f"[{found}]"), lambda t: F.translate(t, found, "".join(CHARACTERS.values())))


def remove_form_artifacts(text: Column, dates: list[str] = (), signatures: list[str] = (), fields: list[str] = (), artifacts: list[str] = ()) -> Column:
    """Date and signature patterns, form-field lines, runs of underscores, then literal artifacts, in this order."""
    wide = lambda p: p.replace(r"[_\s", "[_" + SPACE[1:-1]).replace(r"[\s", SPACE[:-1]).replace(r"\s", SPACE)
    steps = [(wide(p), "") for p in dates] + [("(?iu)" + wide(p), "") for p in signatures] + [("(?m)" + wide(p), "\n") for p in fields]
    text = reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)
    text = where(text, lambda t: F.contains(t, F.lit("___")), lambda t: F.regexp_replace(t, "_{3,}", ""))
    return reduce(lambda t, a: F.replace(t, F.lit(a), F.lit("")), artifacts, text)


def fix_word_spacing(text: Column, pattern: str | None = None) -> Column:
    """The configured split of joined words; no space before punctuation, one after it before a letter or digit."""
    if pattern:
        text = F.regexp_replace(text, pattern, "$1 $2")
    text = no_space_before(text, "[,;:.!?]", SPACE)
    return F.regexp_replace(text, r"([,;:.!?])([A-Za-z0-9Ѐ-ӿ؀-ۿ一-鿿])", "$1 $2")


def normalize_whitespace(text: Column) -> Column:
    """Tabs to spaces, runs of spaces to one, no white space at line ends, at most one blank line in a row."""
    text = F.replace(text, F.lit("\t"), F.lit(" "))
    text = where(text, lambda t: F.contains(t, F.lit("  ")), lambda t: F.regexp_replace(t, " {2,}", " "))
    text = no_space_before(F.rtrim(text, F.lit(BLANKS)), "\n", BLANK)
    return where(text, lambda t: F.contains(t, F.lit("\n\n\n")), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))


def remove_repeated_lines(text: Column, threshold: int = 3, least: int = 20) -> Column:
    """Of lines (trimmed, of ``least`` characters or more) found ``threshold`` times or more, keep the first.

    Lines are sorted with their positions, so that equal lines meet: n log n in the row, whatever its length. A text
    without such lines is unchanged; otherwise every kept line ends with a newline. Most texts hold no line twice, which a count of
    distinct lines tells before anything is sorted.
    """

    def body(lines: Column) -> Column:
        keyed = F.array_sort(F.transform(lines, lambda x, i: F.struct(trim_all(x).alias("k"), i.alias("i"), x.alias("x"))))

        def marked(s: Column) -> Column:
            def mark(e: Column, i: Column) -> Column:
                same = [(F.get(s, i - k)["k"] == e["k"]) & (F.get(s, i - k + threshold - 1)["k"] == e["k"]) for k in range(threshold)]
                often = reduce(lambda a, b: a | b, [F.coalesce((i >= k) & m, F.lit(False)) for k, m in enumerate(same)])
                later = F.coalesce((i > 0) & (F.get(s, i - 1)["k"] == e["k"]), F.lit(False))
                many = often & (F.length(e["k"]) >= least)
                return F.struct(e["i"].alias("i"), e["x"].alias("x"), many.alias("many"), (many & later).alias("drop"))

            return F.transform(s, mark)

        def joined(m: Column) -> Column:
            kept = F.transform(F.array_sort(F.filter(m, lambda e: ~e["drop"])), lambda e: e["x"])
            return F.when(F.exists(m, lambda e: e["many"]), F.concat(F.array_join(kept, "\n"), F.lit("\n"))).otherwise(F.array_join(lines, "\n"))

        return let(let(keyed, marked), joined)

    def some(t: Column) -> Column:
        trimmed = where(trim_all(t), lambda x: x.rlike(f"\n(?:(?<={BLANK}\n)|(?={BLANK}))"), lambda x: F.regexp_replace(x, f"{SPACE}*\n{SPACE}*", "\n"))
        return let(F.array_remove(F.split(trimmed, "\n", -1), F.lit("")), lambda lines: F.size(lines) > F.size(F.array_distinct(lines)))

    return where(text, some, lambda t: let(F.split(t, "\n", -1), body))


def clean_tables(text: Column, replacement: str = ", ") -> Column:
    """Cell separators become ``replacement``."""
    return F.when(F.contains(text, F.lit("|")), F.regexp_replace(text, f"{SPACE}*\\|{SPACE}*", replacement)).otherwise(text)


def finish(text: Column) -> Column:
    """Trim the text and every line; one empty line at most in a row."""
    text = F.regexp_replace(trim_all(text), f"\n{SPACE}*\n", "\n\n")
    # Runs of empty lines are gone and both ends are trimmed, so that only white space beside line ends is left to take.
    return no_space_before(F.regexp_replace(text, f"\n{BLANK}++", "\n"), "\n", BLANK)


def n_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for null or empty."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("int")


def excerpt(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
