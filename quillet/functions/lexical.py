"""Documents of files without a syntax tree: definitions, calls, routes and guards by patterns, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LINE_END

# Patterns for definitions, calls, guards and routes.
NAMED = r"(?m)^\s*(?:class|def|function|func)\s+([A-Za-z_]\w*)"
KEYED = r"(?m)^\s*([A-Za-z_][\w.-]*)\s*:"
CALL = r"\b([A-Za-z_]\w*)\s*\("
GUARD = r"(?i)(?:^|[._])(?:auth(?:enticate|orize|orization)?|check_?permission|has_?permission|require_?(?:role|auth)|guard|policy|tenant|principal|owner)(?:$|[._])"
GO_ROUTE = r"""\.(GET|POST|PUT|PATCH|DELETE|HandleFunc)\s*\(\s*['"]([^'"]*)['"]"""
JS_DECORATED = r"""@(Get|Post|Put|Patch|Delete|All)\s*\(\s*(['"][^'"]*['"])?"""
JS_CALLED = r"""(?i)\b(?:app|router|server|fastify)\s*\.\s*(get|post|put|patch|delete|all|use)\s*\(\s*(['"][^'"]*['"])?"""
JS_GUARD = r"(?i)@(?:UseGuards|Roles|Permissions?|Authorize)\b[^\n]*"


def _sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _routes(text: Column, pattern: str) -> Column:
    """VERB:path of each match; a handler registered without a verb is ANY."""
    plain = F.zip_with(_all(text, pattern, 1), _all(text, pattern, 2), lambda m, p: F.concat_ws(":", F.when(m == "HandleFunc", "ANY").otherwise(F.upper(m)), F.regexp_replace(F.coalesce(p, F.lit("")), "^['\"]+|['\"]+$", "")))
    return plain


def routes(text: Column, language: Column) -> Column:
    js = _sorted_set(F.concat(_routes(text, JS_DECORATED), _routes(text, JS_CALLED)))
    return F.when(language == "go", _sorted_set(_routes(text, GO_ROUTE))).when(language.isin("javascript", "typescript"), js).otherwise(F.expr("cast(array() as array<string>)"))


def fallback_documents(files: DataFrame) -> DataFrame:
    """One document for each file (path, text, language): path::file@1-last, defines, calls, routes and guards sorted and distinct."""
    text = F.coalesce("text", F.lit(""))
    broken = F.split(text, LINE_END, -1)
    count = F.size(broken) - F.when(F.element_at(broken, -1) == "", 1).otherwise(0)
    calls = _sorted_set(_all(text, CALL))
    guards = F.filter(calls, lambda c: c.rlike(GUARD))
    marks = F.when(F.col("language").isin("javascript", "typescript"), _all(text, JS_GUARD, 0)).otherwise(F.expr("cast(array() as array<string>)"))
    last = F.greatest(count, F.lit(1))
    return files.select(
        F.concat(F.col("path"), F.lit("::file@1-"), last.cast("string")).alias("path"), F.col("path").alias("file"), F.lit(1).alias("start_line"), last.alias("end_line"), text.alias("text"), "language",
        _sorted_set(F.concat(_all(text, NAMED), _all(text, KEYED))).alias("defines"), calls.alias("calls"), routes(text, F.col("language")).alias("routes"), _sorted_set(F.concat(guards, marks)).alias("guards"),
    )
