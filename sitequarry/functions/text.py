"""Text expressions (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitequarry.functions.urls import bind

# Unicode white space and the byte order mark; the zero-width space is not white space.
_SPACE = r"[\s\p{Z}\x{FEFF}]"
# The language pattern, and the length limits and end of a first sentence.
_HTML_LANG = r"""(?i)<html[^>]*\slang=["']([^"']+)["']"""

MIN_SENTENCE_LINE = 20
MAX_SENTENCE = 150
_SENTENCE = r"^(.+?\.)[\s\p{Z}\x{FEFF}]"


def trim_all(text: Column) -> Column:
    """Trim every kind of Unicode white space."""
    return F.regexp_replace(text, rf"\A{_SPACE}+|{_SPACE}+\z", "")


def collapse_blank_lines(text: Column) -> Column:
    """At most one blank line in a row, trimmed."""
    return trim_all(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def collapse_spaces(text: Column) -> Column:
    return trim_all(F.regexp_replace(text, rf"{_SPACE}+", " "))


def first_sentence(markdown: Column) -> Column:
    """First sentence of the first line that is long enough and no heading."""
    usable = F.filter(
        F.transform(F.split(markdown, "\n", -1), trim_all),
        lambda s: (F.length(s) >= MIN_SENTENCE_LINE) & ~F.startswith(s, F.lit("#")),
    )

    def sentence(line: Column) -> Column:
        cut = F.regexp_extract(line, _SENTENCE, 1)
        return F.when(cut == "", line).otherwise(cut)

    def shorten(s: Column) -> Column:
        short = F.concat(F.left(s, F.lit(MAX_SENTENCE - 3)), F.lit("..."))
        return F.when(F.length(s) > MAX_SENTENCE, short).otherwise(s)

    line = F.coalesce(F.get(usable, F.lit(0)), F.lit(""))
    return bind(bind(line, sentence), shorten)


def html_language(html: Column) -> Column:
    """Language of the first ``<html lang=…>`` without its region, or NULL."""
    tag = F.regexp_extract(html, _HTML_LANG, 1)
    return F.when(tag != "", F.lower(F.get(F.split(tag, "-"), F.lit(0))))


def title_case(segment: Column) -> Column:
    """Hyphens and underscores to spaces, each ASCII word capitalised, the rest kept."""
    words = F.regexp_extract_all(
        F.translate(segment, "-_", "  "), F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0)
    )

    def capital(word: Column) -> Column:
        raised = F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 1 << 30))
        return F.when(word.rlike("^[a-z]"), raised).otherwise(word)

    return F.array_join(F.transform(words, capital), "")


def first_non_empty(*candidates: Column) -> Column:
    """First candidate that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))
