"""Text expressions: trimming, section cuts, rewrite rules, length measures.

All of them are built-in expressions, so they run in batch and in streaming
plans alike and never leave the JVM. White space follows Python's ``str``
rules: the Unicode property plus the separators U+001C to U+001F.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
_WS_IN_LINE = r"[\s\x1c-\x1f&&[^\n]]"

# Headings that start the tail of an encyclopedia article.
TAIL_HEADINGS = ("See also", "References", "External links", "Further reading", "Notes")

# Fixed value: marker that starts the reference list of a paper.
REFERENCES_MARK = "## References\n\n"

# Fixed value: marker put in front of a line that is an article title.
TITLE_MARK = "<SOT>"

# De-spacing rules of the line-wise wiki corpus, applied in order.
# `s*` before the end of the title rule is the letter s on purpose.
DETOK_RULES: tuple[tuple[str, str], ...] = (
    (WS + r"+([,.;:!?])", "$1"),
    (WS + r"('[a-z]{1,2}" + WS + ")", "$1"),
    ('"' + WS + r"([^\n]+?)" + WS + '"', '"$1"'),
    ("'" + WS + r"([^\n]+?)" + WS + "'", "'$1'"),
    (r"\(" + WS + r"([^\n]+?)" + WS + r"\)", "($1)"),
    (r"\[" + WS + r"([^\n]+?)" + WS + r"\]", "[$1]"),
    ("s ' ", "s' "),
    (WS + r"@([^\n]{1,4}?)@" + WS, "$1"),
    ("^" + WS + "*=" + WS + r"([^=\n]+?)" + WS + "=*s*$", TITLE_MARK + "$1"),
    ("(?:=" + WS + r")+([^\n]+?)" + WS + "*(?:" + WS + "=)+", "$1"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: Column | str) -> Column:
    """Strip Unicode white space at both ends."""
    # The look-behind lets the tail pattern start only at the head of a run,
    # which keeps the scan linear on texts with long inner runs.
    pattern = rf"(?U)^{WS}++|(?<!{WS}){WS}++\z"
    return F.regexp_replace(_col(c), F.lit(pattern), F.lit(""))


def char_length(c: Column | str) -> Column:
    """Length in code points."""
    return F.length(_col(c)).cast("long")


def byte_length(c: Column | str) -> Column:
    """Length in UTF-8 bytes."""
    return F.octet_length(_col(c)).cast("long")


def cut_tail(c: Column | str, headings: Sequence[str] = TAIL_HEADINGS) -> Column:
    """Drop everything from the first line that is exactly one of the headings.

    The cut starts at the first line start in the white space before the
    heading, so blank lines in front of it go too.
    """
    names = "|".join(headings)
    pattern = rf"(?sUd)(\A|(?<!{WS}){_WS_IN_LINE}*+\n){WS}*+(?:{names}){_WS_IN_LINE}*+(?=\n|\z).*"
    return F.regexp_replace(_col(c), F.lit(pattern), F.lit("$1"))


def cut_references(c: Column | str, mark: str = REFERENCES_MARK) -> Column:
    """Keep the text before the first reference mark."""
    return F.substring_index(_col(c), mark, 1)


def rewrite(c: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply (Java pattern, replacement) rules one after another."""
    out = _col(c)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, F.lit("(?Ud)" + pattern), F.lit(replacement))
    return out


def wikitext_detok(c: Column | str) -> Column:
    """Undo the token spacing of one wiki line; a title line gains the title mark."""
    return rewrite(c, DETOK_RULES)


def input_target(seq: Column | str) -> tuple[Column, Column]:
    """Next-token training pair: all but the last token, all but the first."""
    seq = _col(seq)
    n = F.greatest(F.size(seq) - 1, F.lit(0))
    return F.slice(seq, F.lit(1), n), F.slice(seq, F.lit(2), n)
