"""Text cleaning as column expressions: title, closing sections, short lines, spacing, sentences."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

if TYPE_CHECKING:
    from pyspark.sql import Column

# A body line that begins with one of these ends the page.
TERMINATORS = (
    "See also", "References", "Notes", "External links", "Sources", "Primary sources", "Further reading", "Interviews",
    "Works cited", "Official website", "Notes and references",
)
# White space as Python strings know it; Java's and RE2's \s are ASCII.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MIN_WORDS = 5
MIN_SENTENCE = 15


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def not_blank_text(c: Column) -> Column:
    """False for null and for white space only."""
    return F.coalesce(strip(c) != "", F.lit(False))


def lines(c: Column) -> Column:
    return F.split(strip(c), "\n")


def page_title(c: Column) -> Column:
    """First line of the stripped text, stripped; empty for blank text, null for null."""
    return strip(lines(c)[0])


def before_terminator(body: Column) -> Column:
    """Stripped lines up to the first that begins with a closing keyword."""
    known = r"\A(?:" + "|".join(TERMINATORS) + ")"
    at = F.array_position(F.transform(body, lambda v: v.rlike(known)), True)
    return F.when(at == 0, body).otherwise(F.slice(body, 1, F.greatest(at - 1, F.lit(0)).cast("int")))


def long_lines(body: Column, least: int = MIN_WORDS) -> Column:
    """Lines with at least ``least`` words."""
    return F.filter(body, lambda v: (F.length(v) > 0) & (F.size(F.split(v, rf"{SPACE}+")) >= least))


def normalize(c: Column) -> Column:
    """White space to one blank, none before a sentence mark, one between a mark and an ASCII capital."""
    c = F.regexp_replace(c, rf"{SPACE}+", " ")
    c = F.regexp_replace(c, r" +([.!?])", "$1")
    return F.regexp_replace(c, r"([.!?])([A-Z])", "$1 $2")


def clean_text(c: Column) -> Column:
    """Body of a page: everything behind the title line, cut, filtered and normalised."""
    all_lines = lines(c)
    body = F.transform(F.slice(all_lines, 2, F.greatest(F.size(all_lines) - 1, F.lit(0))), strip)
    return strip(normalize(F.array_join(long_lines(before_terminator(body)), "\n")))


def rule_sentences(c: Column, least: int = MIN_SENTENCE) -> Column:
    """Pieces of a cleaned text, cut after ``.``, ``!`` or ``?`` and a blank, of at least ``least`` characters."""
    pieces = F.split(F.regexp_replace(c, r"([.!?]) ", "$1\x01"), "\x01")
    return F.filter(F.transform(pieces, strip), lambda v: F.length(v) >= least)
