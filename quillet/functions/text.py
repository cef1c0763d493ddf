"""Scalar expressions on source text and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{1,}"
#: A word (any script) or a single mark; (?U) makes \w and \s follow Unicode.
CONTEXT_TOKEN = r"(?U)\w+|[^\w\s]"
Z95 = 1.959963984540054
#: Numbers in a block of a running sum; characters in a chunk of a text.
BLOCK, CHUNK = 64, 4096
# Suffixes of sources (lower case), file names that say nothing, headings of advisory pages.
SUPPORTED = r"\.(py|ini|cfg|toml|yaml|yml|json|env\.example|env\.sample)$"
COMMON_NAMES = ("__init__.py", "config.py", "utils.py", "main.py", "cli.py")
AFFECTED = r"(?i)Affected versions\s+(.{0,160}?)\s+Patched versions"
PATCHED = r"(?i)Patched versions\s+(.{0,160}?)\s+Description"
#: A reply of one fenced block; the arguments of a call up to a comma outside quotes, and what follows.
FENCED = r"(?s)^```(?:json)?\n(.*)\n```$"
FIRST_ARGUMENT = r"""(?s)^((?:[^,'"\\]|\\.|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")*),(.*)$"""
#: Ends of lines as Python's splitlines has them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def tokenize(text: Column) -> Column:
    """Identifiers of two letters or more, lower case, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), lambda t: F.lower(t))


def context_token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(CONTEXT_TOKEN), F.lit(0)))


def byte_bound(text: Column) -> Column:
    """An upper bound of a prompt's tokens: its UTF-8 bytes."""
    return F.octet_length(text)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized_contains(text: Column, snippet: Column) -> Column:
    """Whether the snippet occurs, white space runs counting as one blank; a blank snippet doesn't."""
    return (collapsed(snippet) != "") & F.contains(collapsed(text), collapsed(snippet))


def document_symbol(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"^.*?::(.*)@[0-9]+", 1), F.lit(""))


def line_bounds(path: Column) -> Column:
    """struct<first, last> from file::symbol@first-last, or null."""
    first, last = (F.regexp_extract(path, r"@([0-9]+)-([0-9]+)(?:#|$)", i) for i in (1, 2))
    return F.when(first != "", F.struct(first.try_cast("int").alias("first"), last.try_cast("int").alias("last")))


def repository_key(url: Column) -> Column:
    """host/owner/name of an https repository address, lower case, without .git; null for anything else."""
    key = F.lower(F.regexp_extract(url, r"^https://([^/]+/[^/]+/[^/]+?)(?:\.git)?/*$", 1))
    return F.nullif(key, F.lit(""))


def commit_sha(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"/commit/([0-9a-fA-F]{40})(?:[/?#]|$)", 1)), F.lit(""))


def module_name(path: Column) -> Column:
    """Dotted module of a Python path, without a leading src."""
    plain = F.regexp_replace(F.regexp_replace(path, r"(?:/__init__)?\.py$", ""), "^src/", "")
    return F.translate(plain, "/", ".")


def ratio(top: Column, bottom: Column) -> Column:
    """Null on a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def wilson(success: Column, total: Column) -> Column:
    """struct<low, high>: 95 % binomial interval, clamped to [0, 1]; null for no trials."""
    n = F.when(total > 0, total.cast("double"))
    p, z2 = success / n, Z95 * Z95
    base = 1 + z2 / n
    center = (p + z2 / (2 * n)) / base
    radius = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / base
    return F.when(n.isNotNull(), F.struct(F.greatest(F.lit(0.0), center - radius).alias("low"), F.least(F.lit(1.0), center + radius).alias("high")))


def relative_reduction(before: Column, after: Column) -> Column:
    """(before - after) / before; null for a zero or unknown base."""
    return ratio(before - after, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where lambdas inside use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(items: Column, size: int) -> Column:
    """An array cut in arrays of `size` items, the last one shorter."""
    return let(items, lambda a: F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda b: F.slice(a, b * size + 1, F.lit(size)))).otherwise(F.array().cast(ArrayType(ArrayType(IntegerType())))))


def _scan(items: Column, both: Callable[[Column, Column], Column], total: Callable[[Column], Column], levels: int) -> Column:
    """What `both` makes of 0 and all items before each one. Blocks of BLOCK items are summed up, and blocks of those sums, so that an array grows within a block only."""

    def within(block: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(both(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    if not levels:
        return within(items, F.lit(0))
    return let(blocks(items, BLOCK), lambda bs: F.flatten(F.zip_with(bs, _scan(F.transform(bs, total), both, total, levels - 1), within)))


def running(sizes: Column) -> Column:
    """The sum of what stands before each of some whole numbers, in work that grows with their number."""
    return _scan(sizes, lambda a, x: a + x, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x), 3)


def furthest(stops: Column) -> Column:
    """The largest of what stands before each of some whole numbers, 0 before the first."""
    return _scan(stops, F.greatest, F.array_max, 3)


def parts(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<gap, m, v>>: what stands before each match, the match, and the given group of it; the last part has no match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    found = F.zip_with(matches, values, lambda m, v: F.struct(m.alias("m"), v.alias("v"))) if group else F.transform(matches, lambda m: F.struct(m.alias("m"), m.alias("v")))
    return F.zip_with(F.split(text, pattern, -1), found, lambda g, x: F.struct(g.alias("gap"), x["m"].alias("m"), x["v"].alias("v")))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, stop, value>> of a pattern's matches, in code points; value is the given group.

    The text between matches and the matches are laid end to end, so positions are running lengths.
    """

    def placed(ps: Column) -> Column:
        starts = running(F.transform(ps, lambda z: F.length(z["gap"]) + F.coalesce(F.length(z["m"]), F.lit(0))))
        begin = lambda z, at: at + F.length(z["gap"])
        every = F.zip_with(ps, starts, lambda z, at: F.struct(begin(z, at).alias("start"), (begin(z, at) + F.length(z["m"])).alias("stop"), z["v"].alias("value")))
        return F.filter(every, lambda x: x["value"].isNotNull())

    return F.when(text.rlike(pattern), let(parts(text, pattern, group), placed)).otherwise(F.expr("cast(array() as array<struct<start:int,stop:int,value:string>>)"))


def replaced(text: Column, pattern: str, put: Callable[[Column], Column]) -> Column:
    """The text with put(match) for each match of a pattern."""
    pieces = F.transform(parts(text, pattern), lambda z: F.concat(z["gap"], F.when(z["m"].isNotNull(), put(z["m"])).otherwise("")))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def without_spans(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each of its spans (start, stop; by start, none empty); a span that begins in an earlier one adds no mark.

    The text is cut in chunks once, so that what stands between two spans is taken from the chunks that it touches and
    not searched for from the start.
    """
    cut = lambda t, size: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / size).cast("int")), lambda i: F.substr(t, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    chunks = F.flatten(F.transform(cut(text, BLOCK * CHUNK), lambda t: cut(t, CHUNK)))

    def piece(ch: Column, start: Column, stop: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor((stop - 1) / CHUNK).cast("int")
        take = lambda i: F.substr(F.get(ch, i), F.greatest(start - i * CHUNK, F.lit(0)) + 1, F.least(stop - i * CHUNK, F.lit(CHUNK)) - F.greatest(start - i * CHUNK, F.lit(0)))
        return F.when(stop > start, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), take), "")).otherwise("")

    def laid(x: Column) -> Column:
        ends = furthest(F.transform(x["spans"], lambda s: s["stop"]))
        kept = F.zip_with(x["spans"], ends, lambda s, before: F.when(s["start"] >= before, F.concat(piece(x["chunks"], before, s["start"]), F.lit(mark))).otherwise(""))
        tail = F.greatest(F.array_max(F.transform(x["spans"], lambda s: s["stop"])), F.lit(0))
        return F.concat(F.array_join(kept, ""), piece(x["chunks"], tail, F.length(text)))

    return F.when(F.size(spans) > 0, let(F.struct(chunks.alias("chunks"), spans.alias("spans")), laid)).otherwise(text)


def line_array(text: Column) -> Column:
    """A text's lines without their ends; a last empty line doesn't count."""
    return let(F.split(text, LINE_END, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def supported_path(path: Column) -> Column:
    """Whether a path has one of the suffixes that are taken as sources."""
    return F.lower(path).rlike(SUPPORTED)


def first_argument(arguments: Column) -> Column:
    """struct<first, rest> at the first comma outside quotes; null without one."""
    at = lambda i: F.trim(F.regexp_extract(arguments, FIRST_ARGUMENT, i))
    return F.when(arguments.rlike(FIRST_ARGUMENT), F.struct(at(1).alias("first"), at(2).alias("rest")))


def final_json(content: Column) -> Column:
    """The JSON text of a reply that is bare JSON or one fenced block and nothing else; null otherwise."""
    text = F.trim(F.coalesce(content, F.lit("")))
    inside = F.regexp_extract(text, FENCED, 1)
    text = F.when(text.rlike(FENCED), inside).otherwise(text)
    return F.when(F.try_parse_json(text).isNotNull(), text)


def advisory_versions(html: Column) -> Column:
    """struct<affected, patched>: the version texts between an advisory page's headings."""
    text = collapsed(F.regexp_replace(html, "<[^>]+>", " "))
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    found = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in (AFFECTED, PATCHED)]
    return F.struct(found[0].alias("affected"), found[1].alias("patched"))


def bounded_bytes(text: Column, budget: Column) -> Column:
    """The longest prefix of whole characters within so many UTF-8 bytes."""
    sizes = F.transform(F.split(text, ""), lambda c: F.octet_length(c))
    fits = F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("bytes")), lambda a, n: F.struct(F.when(a["bytes"] + n <= budget, a["n"] + 1).otherwise(a["n"]).alias("n"), (a["bytes"] + n).alias("bytes")), lambda a: a["n"])
    return F.when(F.octet_length(text) <= budget, text).otherwise(F.substr(text, F.lit(1), fits))


def truncation_marker(reason: Column, size: Column) -> Column:
    """A JSON object that stands for a payload that was left out."""
    return F.to_json(F.struct(F.lit(True).alias("truncated"), reason.alias("reason"), size.alias("original_size")))


def evidence_origin(evidence: Column, candidate: Column, cases: str) -> Column:
    """Where a sink's evidence (kind:path) lies: in the candidate's file, in another case (by its name), or in a helper."""
    own, other = (F.substring_index(p, "::", 1) for p in (F.regexp_replace(evidence, "^[^:]*:", ""), candidate))
    return F.when(own == other, "candidate_file").when(F.regexp_extract(own, "[^/]*$", 0).startswith(cases), "other_benchmark_case").otherwise("shared_helper_or_framework")


def mentions(haystack: Column, path: Column) -> Column:
    """Whether a scope names a path, or its last part unless that is a common one."""
    last = F.regexp_extract(path, "[^/]*$", 0)
    return F.contains(haystack, path) | (~last.isin(*COMMON_NAMES) & F.contains(haystack, last))
