"""Main content and markdown from parsed blocks, as array expressions.

A page with an ``article`` or ``main`` element keeps the blocks inside it.  Any other page
keeps what the word-count and link-density tree of Kohlschuetter, Fankhauser and Nejdl
(Boilerplate Detection using Shallow Text Features, WSDM 2010) calls content.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitequarry.functions.text import collapse_blank_lines, trim_all
from sitequarry.functions.urls import bind
from sitequarry.operators.html_reader import CODE, DELETED, EMPHASIS, LITERAL, STRONG

_SPACE = " \t\n\r\f\0"
_LEADING = r"^[ \t\n\r\f\x00]+"
_TRAILING = r"[ \t\n\r\f\x00]+$"


def is_content_block(block: Column, before: Column, after: Column) -> Column:
    """Decision tree over a block and its neighbours; a missing neighbour counts as empty."""
    # Density limits 1/3 and 5/9, word limits 16, 15, 4, 40 and 17.
    words = block["n_words"]
    after_words = F.coalesce(after["n_words"], F.lit(0))
    before_words = F.coalesce(before["n_words"], F.lit(0))
    before_links = F.coalesce(before["link_words"], F.lit(0))
    linked = block["link_words"] * 3 > words
    before_is_text = before_links * 9 <= before_words * 5
    return (
        F.when(linked, F.lit(False))
        .when(before_is_text, (words > 16) | (after_words > 15) | (before_words > 4))
        .otherwise((words > 40) | (after_words > 17))
    )


def content_blocks(blocks: Column) -> Column:
    """The blocks that make up the main content."""

    def classified(block: Column, i: Column) -> Column:
        return is_content_block(block, F.get(blocks, i - 1), F.get(blocks, i + 1))

    return F.when(
        F.exists(blocks, lambda b: b["in_main"]), F.filter(blocks, lambda b: b["in_main"])
    ).otherwise(F.filter(blocks, classified))


# Lists and quotes nested deeper than this are written no further in; their text is all kept.
MAX_INDENT = 32


def _marks(run: Column) -> Column:
    """The marks around a run, outermost first, as the text that opens each: a link, then styles."""
    style = run["style"]
    fence = F.when(F.contains(run["text"], F.lit("`")), F.lit("``")).otherwise(F.lit("`"))
    has = lambda bit: style.bitwiseAND(bit) > 0
    given = F.array(
        F.when(run["target"] != "", F.concat(F.lit("["), run["target"])),
        F.when(has(STRONG), F.lit("**")),
        F.when(has(EMPHASIS), F.lit("_")),
        F.when(has(DELETED), F.lit("~")),
        F.when(has(CODE), fence),
    )
    return F.when(run["body"] == "", F.array().cast("array<string>")).otherwise(F.array_compact(given))


def _shared(a: Column, b: Column) -> Column:
    """How many marks of two runs are the same, from the outside in."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(equal, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int")


def _opening(marks: Column) -> Column:
    return F.array_join(
        F.transform(marks, lambda m: F.when(F.startswith(m, F.lit("[")), F.lit("[")).otherwise(m)), ""
    )


def _closing(marks: Column) -> Column:
    def close(m: Column) -> Column:
        link = F.concat(F.lit("]("), F.substr(m, F.lit(2)), F.lit(")"))
        return F.when(F.startswith(m, F.lit("[")), link).otherwise(m)

    return F.array_join(F.reverse(F.transform(marks, close)), "")


def _inline(runs: Column) -> Column:
    """Runs as one text: escaped, and with marks where their style changes; space stays outside marks."""

    def split(run: Column) -> Column:
        style = run["style"]
        plain = F.regexp_replace(run["text"], r"([\\*_`\[\]])", r"\\$1")
        text = F.when(style.bitwiseAND(CODE | LITERAL) > 0, run["text"]).otherwise(plain)
        body = F.btrim(text, F.lit(_SPACE))
        return F.struct(
            run["text"].alias("text"),
            run["target"].alias("target"),
            style.bitwiseAND(~LITERAL).alias("style"),
            body.alias("body"),
            F.when(body != "", F.regexp_extract(text, _LEADING, 0)).otherwise(text).alias("before"),
            F.when(body != "", F.regexp_extract(text, _TRAILING, 0)).otherwise(F.lit("")).alias("after"),
        )

    def marked(parts: Column) -> Column:
        with_marks = F.transform(parts, lambda r: r.withField("marks", _marks(r)))
        return bind(with_marks, joined)

    def joined(parts: Column) -> Column:
        none = F.array().cast("array<string>")

        def piece(run: Column, i: Column) -> Column:
            marks = run["marks"]
            kept = _shared(marks, F.coalesce(F.get(parts, i - 1)["marks"], none))
            stays = _shared(marks, F.coalesce(F.get(parts, i + 1)["marks"], none))
            n = F.size(marks)
            opening = _opening(F.slice(marks, kept + 1, F.greatest(n - kept, F.lit(0))))
            closing = _closing(F.slice(marks, stays + 1, F.greatest(n - stays, F.lit(0))))
            return F.concat(run["before"], opening, run["body"], closing, run["after"])

        return F.array_join(F.transform(parts, piece), "")

    return bind(F.transform(runs, split), marked)


def _lines(text: Column) -> Column:
    """A block's text with single spaces and hard breaks, and nothing that would start another block."""
    single = F.regexp_replace(text, r"[ \t\n\r\f]{2,}|[\t\n\r\f]", " ")
    broken = F.regexp_replace(F.btrim(single, F.lit(" \0")), r" ?\x00 ?", "  \n")
    marks = F.regexp_replace(trim_all(broken), r"(?md)^([-+=>]|#{1,6}(?= )|~~~)", r"\\$1")
    return F.regexp_replace(marks, r"(?md)^(\d+)(\. )", r"$1\\$2")


def block_markdown(block: Column) -> Column:
    """One block in its markdown form."""
    tag, runs = block["tag"], block["runs"]

    def cell(i: Column) -> Column:
        text = _lines(_inline(F.filter(runs, lambda r: r["cell"] == i)))
        return F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))

    last = F.coalesce(F.element_at(runs, F.lit(-1))["cell"], F.lit(0))
    row = F.concat(
        F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), last), cell), " | "), F.lit(" |"),
        F.when(
            block["header"],
            F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), last + 1), " | "), F.lit(" |")),
        ).otherwise(F.lit("")),
    )
    verbatim = F.array_join(F.transform(runs, lambda r: r["text"]), "")
    code = F.concat(
        F.lit("```"), block["language"], F.lit("\n"), F.btrim(verbatim, F.lit("\n")), F.lit("\n```")
    )

    def placed(text: Column) -> Column:
        head = F.concat(
            F.repeat(F.lit("#"), F.substr(tag, F.lit(2)).cast("int")), F.lit(" "),
            F.replace(text, F.lit("  \n"), F.lit(" ")),
        )
        return bind(F.when(tag.rlike("^h[1-6]$"), head).otherwise(text), listed)

    def listed(text: Column) -> Column:
        number = block["number"]
        marker = (
            F.when(number.isNull(), F.lit("    "))
            .when(number == 0, F.lit("-   "))
            .otherwise(F.concat((number - 1).cast("string"), F.lit(".  ")))
        )
        item = F.replace(F.concat(marker, text), F.lit("\n"), F.lit("\n    "))
        indent = F.repeat(F.lit("    "), F.least(block["depth"] - 1, F.lit(MAX_INDENT)))
        inner = F.concat(indent, F.replace(item, F.lit("\n"), F.concat(F.lit("\n"), indent)))
        return bind(F.when(block["depth"] > 0, inner).otherwise(text), quoted)

    def quoted(text: Column) -> Column:
        mark = F.repeat(F.lit("> "), F.least(block["quotes"], F.lit(MAX_INDENT)))
        lines = F.concat(mark, F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), mark)))
        return F.when(block["quotes"] > 0, lines).otherwise(text)

    return (
        F.when(tag == "hr", F.lit("* * *"))
        .when(tag == "td", row)
        .otherwise(bind(F.when(tag == "pre", code).otherwise(_lines(_inline(runs))), placed))
    )


def blocks_to_markdown(blocks: Column) -> Column:
    """Join blocks with blank lines; items of one list or table stay on adjoining lines."""

    def piece(block: Column, i: Column) -> Column:
        grp = block["grp"]
        together = (grp != 0) & (grp == F.get(blocks, i - 1)["grp"])
        gap = F.when(i == 0, F.lit("")).when(together, F.lit("\n")).otherwise(F.lit("\n\n"))
        return F.concat(gap, block_markdown(block))

    return bind(F.array_join(F.transform(blocks, piece), ""), collapse_blank_lines)
