"""Matches of rules in code, outside comments and strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import located, replaced
from .rules import lines

_LINE_STRINGS = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
#: Comments and strings by family of languages; the leftmost wins, so neither is found inside the other.
HASH = r'''"""[^"\\]*(?:(?:\\.|"{1,2}[^"\\])[^"\\]*)*"""|#[^\n]*|''' + _LINE_STRINGS
SLASH = r"/\*(?:[^*]|\*+[^*/])*\*+/|//[^\n]*|`[^`]*`|" + _LINE_STRINGS
WHOLE_LINES = r"(?m)^[\x20\t]*#[^\n]*"
#: A character that no source holds, and what is no end of a line.
MARK, NO_LINE_END = "\x00", "[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
FAMILIES = {"python": HASH, "javascript": SLASH, "typescript": SLASH, "java": SLASH, "go": SLASH, "shell": WHOLE_LINES, "ruby": WHOLE_LINES, "yaml": WHOLE_LINES}


def masked_spans(text: Column, language: Column) -> Column:
    """array<struct<start, stop, value>>: the comments and strings of a text, by its language; none for others."""
    found = F.expr("cast(array() as array<struct<start:int,stop:int,value:string>>)")
    for pattern in dict.fromkeys(FAMILIES.values()):
        found = F.when(language.isin(*[k for k, v in FAMILIES.items() if v == pattern]), located(text, pattern)).otherwise(found)
    return found


def without_comments(text: Column) -> Column:
    """A text of the // and /* */ family with blanks for its comments; strings and line ends stay."""
    return replaced(text, SLASH, lambda m: F.when(m.rlike("^[\"'`]"), m).otherwise(F.regexp_replace(m, "[^\\n]", " ")))


def marked(text: Column, language: Column) -> Column:
    """The text with MARK for each character of its comments and strings, line ends aside, so lines and columns survive."""
    out = text
    for pattern in dict.fromkeys(FAMILIES.values()):
        out = F.when(language.isin(*[k for k, v in FAMILIES.items() if v == pattern]), replaced(text, pattern, lambda m: F.regexp_replace(m, NO_LINE_END, MARK))).otherwise(out)
    return out


def matches_outside(docs: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(…, line, rule, start, stop, match) of docs (path, language, text): matches that neither begin nor end in a mask.

    Masks are found once in the whole text, which then goes along with it line by line; a match is held against the
    two characters of its ends there. One pass, no shuffle, work in proportion to the text and its matches.
    """
    rows = lines(docs, masked=marked(F.col("text"), F.col("language")))

    def placed(name: str, pattern: str) -> Column:
        return F.transform(located(F.col("code"), pattern), lambda m: F.struct(F.lit(name).alias("rule"), m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("match")))

    each = F.flatten(F.array(*[placed(n, p) for n, p in rules.items()]))
    at = lambda place: F.substr(F.col("masked"), place, F.lit(1))
    free = F.filter(each, lambda m: (at(m["start"] + 1) != MARK) & (at(m["stop"]) != MARK))
    keep = [c for c in docs.columns if c != "text"]
    return rows.select(*keep, "line", "code", F.inline(free))
