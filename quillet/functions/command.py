"""Expressions on commands: helpers that build them, names in values, the state of a command's fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of helpers, what a shell construction holds, and patterns of Java text.
HELPERS = ("get_cmd", "build_cmd", "make_cmd", "format_cmd")
SHELLS = ("subprocess", "bash", ".execute(")
HELPER_PATHS = ("::get_cmd@", "::build_cmd@", "::make_cmd@")
HELPER_DEF = r"(?m)^\s*def\s+(?:get|build|make|format)_cmd\s*\("
STRING_LITERAL = r'"(?:\\.|[^"\\])*+"|' + r"'(?:\\.|[^'\\])*+'"
IDENTIFIER = r"\b[A-Za-z_$][\w$]*\b"
NON_VALUES = ("String", "Object", "Integer", "Boolean", "Long", "Double", "Float", "new", "null", "true", "false")
# Characters a modelled shell text may hold, words that start another interpreter, words before a command.
STRANGE = r"[^\w\s/.,:=+%\-]|\n|\r"
INTERPRETERS = r"\b(?:eval|bash|sh|zsh|dash|ksh)\b"
LEADING_EXEC = r"^\s*exec(?:\s+|$)"
NO_COMMAND = r"^\s*(?:$|-|(?:exec|command|env)(?:\s|$)|[^\s=]*=)"
#: What stands for a fragment that is not literal.
MARKS = {"quoted": "\x01", "raw": "\x02", "unknown": "\x03"}


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def builds_shell_command(text: Column) -> Column:
    """Whether a document names a command helper and something that runs commands; null text does neither."""
    return F.coalesce(_any_in(text, HELPERS) & _any_in(text, SHELLS), F.lit(False))


def is_command_helper(path: Column, text: Column) -> Column:
    """Whether a document is a command helper by its path's symbol or defines one."""
    return F.coalesce(_any_in(path, HELPER_PATHS), F.lit(False)) | F.coalesce(text.rlike(HELPER_DEF), F.lit(False))


def value_identifiers(value: Column) -> Column:
    """Sorted distinct names in a value: literals, type words and names with a capital aside."""
    names = F.regexp_extract_all(F.regexp_replace(value, STRING_LITERAL, ""), F.lit(IDENTIFIER), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~n.isin(*NON_VALUES) & ~n.rlike("^[A-Z]"))))


def shell_status(fragments: Column) -> Column:
    """State of a command of fragments (kind, text): AMBIGUOUS, UNSANITIZED or SANITIZED.

    Literals are laid end to end with one control character for each other fragment, so that words and quotes that
    go over fragments are seen whole: a quoted fragment must be a word by itself, and not the command. Null fragments
    or kinds are ambiguous; a control character in a literal is strange text and so is, too.
    """
    kind = lambda f, k: f["kind"] == k
    any_of = lambda k: F.coalesce(F.exists(fragments, lambda f: kind(f, k)), F.lit(False))
    literals = F.filter(fragments, lambda f: kind(f, "literal"))
    strange = F.exists(literals, lambda f: f["text"].rlike("(?U)" + STRANGE))

    def sign(f):
        out = F.when(kind(f, "literal"), f["text"])
        for k, mark in MARKS.items():
            out = out.when(kind(f, k), F.lit(mark))
        return F.coalesce(out, F.lit(MARKS["unknown"]))

    laid = F.array_join(F.transform(fragments, sign), "")
    constants = F.regexp_replace(laid, "[\x01-\x03]", " ")
    prefix = F.regexp_replace(F.regexp_extract(laid, "^([^\x01-\x03]*)", 1), LEADING_EXEC, "")
    loose = laid.rlike("(?:^|[^ \t])\x01|\x01[^ \t]")
    return (
        F.when(fragments.isNull() | F.coalesce(strange, F.lit(True)) | constants.rlike("(?U)" + INTERPRETERS) | F.contains(laid, F.lit(MARKS["unknown"])), "AMBIGUOUS")
        .when(any_of("raw"), "UNSANITIZED")
        .when(any_of("quoted") & (prefix.rlike(NO_COMMAND) | loose), "AMBIGUOUS")
        .otherwise("SANITIZED")
    )
