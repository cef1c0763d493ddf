"""Pattern rules over source lines, and the choice of one document for each hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.text import LINE_END

# Patterns by category, as Java regular expressions.
SCAN_RULES = {
    "command-execution": r"(?i)subprocess\.|os\.(?:system|popen)|Runtime\.getRuntime\(\)\.exec|shell\s*=\s*True",
    "dynamic-evaluation": r"(?i)(?<![\w.])(?:eval|exec)\s*\(",
    "database-operation": r"(?i)\.(?:executeQuery|delete)\s*\(",
    "permission-mode": r"(?i)\bos\.chmod\s*\(",
}
SOURCE_RULES = {
    "http-input": r"(?i)\b(?:request|req)\.(?:args|query|body|params|headers|cookies)\b|\brequest\.get(?:Header|Headers|Parameter|ParameterMap|ParameterValues|Cookies?|QueryString)\s*\(|\.getTheParameter\s*\(|\br\.URL\.Query\s*\(|\bmux\.Vars\s*\(|\bctx\.Param\s*\(",
    "process-input": r"\b(?:input\s*\(|sys\.argv\b|os\.environ\b|process\.env\b)",
}
SINK_RULES = {
    "code-execution": r"(?<![\w.])(?:eval|exec)\s*\(",
    "command-execution": r"\b(?:os\.(?:system|popen)|subprocess\.(?:run|call|Popen|check_call|check_output|getoutput|getstatusoutput)|child_process\.(?:exec|execSync|spawn)|exec\.Command|Runtime\.getRuntime\(\)\.exec|ProcessBuilder)\s*\(",
    "sql": r"(?i)\.(?:execute|executeQuery|executeUpdate|executemany|prepareStatement|prepareCall|query|raw)\s*\(",
    "ldap": r"(?i)\.search\s*\(",
    "path-access": r"\b(?:open|readFile|writeFile|os\.Open|os\.ReadFile)\s*\(",
    "outbound-request": r"\b(?:requests\.(?:get|post)|fetch|http\.Get)\s*\(",
}
SANITIZER_RULES = {
    "shell-escaping": r"\b(?:shlex\.quote|shellescape|escapeShellArg)\s*\(",
    "numeric-validation": r"\b(?:int|parseInt|strconv\.(?:Atoi|ParseInt))\s*\(",
    "path-normalization": r"\b(?:Path\.resolve|os\.path\.realpath|filepath\.Clean)\s*\(",
    "schema-validation": r"\b(?:validate|parse_obj|model_validate|safeParse)\s*\(",
}
PRINCIPAL = r"(?i)\b(?:request|req)\.user\b|\b(?:actor|principal|current_user|session_user|identity)\b"
RESOURCE = r"(?i)\b(?:tenant|organization|project|account|user|resource|document)_id\b|\b(?:req|request)\.params(?:\.[A-Za-z_]\w*|\[['\"][^'\"]+['\"]\])"
SENSITIVE_ACTION = r"(?i)\b(?:delete|remove|update|write|admin|execute|run_command|transfer|invite|set_role|change_role|read_secret)\b"
GUARD = (
    r"(?i)\b(?:authorize|authorization|authenticate|require_?permission|check_?permission|has_?permission|require_?role|is_?admin|UseGuards|enforce_policy|check_?tenant|assert_?owner)\b"
    r"|\b[A-Za-z_]\w*\.(?:user|owner|tenant|organization|project|account)_id\s*(?:==|!=)\s*(?:current_)?(?:user|owner|tenant|organization|project|account)_id\b"
    r"|\b(?:current_)?(?:user|owner|tenant|organization|project|account)_id\s*(?:==|!=)\s*[A-Za-z_]\w*\.(?:user|owner|tenant|organization|project|account)_id\b"
)


def lines(docs: DataFrame, **twins: Column) -> DataFrame:
    """docs with one row a line instead of the text: line (from 1) and code; a twin is a text with the same line ends, cut along."""
    held = F.arrays_zip(T.line_array(F.col("text")).alias("code"), *[T.line_array(c).alias(n) for n, c in twins.items()])
    rows = docs.select(*docs.columns, F.posexplode(held).alias("at", "l"))
    return rows.select(*[c for c in docs.columns if c != "text"], (F.col("at") + 1).alias("line"), *[F.col("l")[n].alias(n) for n in ("code", *twins)])


def hits(docs: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(…, line, code, rule): each line under each rule that it matches. One pass over the lines tests all rules."""
    found = F.filter(F.array(*[F.when(F.col("code").rlike(p), F.lit(n)) for n, p in rules.items()]), lambda x: x.isNotNull())
    return lines(docs).withColumn("rule", F.explode(found))


def distinct_matches(text: Column, pattern: str) -> Column:
    """Sorted distinct matches of a pattern in a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def candidates_of(found: DataFrame, docs: DataFrame, repository: str) -> DataFrame:
    """(candidate_id, path, source_line, rule, query) of hits (path, line, code, rule) in docs (path file::symbol@first-last, text): one for each file, line and rule."""
    first = F.coalesce(F.regexp_extract("path", r"::.+@([0-9]+)", 1).try_cast("int"), F.lit(1))
    sizes = docs.select("path", F.size(F.split("text", LINE_END)).alias("n_lines"), F.contains("path", F.lit("::<module>@")).alias("is_module"))
    placed = found.join(sizes, "path").withColumns({"file": F.substring_index("path", "::", 1), "source_line": first + F.col("line") - 1})
    name = F.concat_ws(":", F.lit(repository), "path", F.col("source_line").cast("string"), "rule")
    return smallest_span(placed).select(name.alias("candidate_id"), "path", "source_line", "rule", F.concat_ws(" ", "rule", F.trim("code")).alias("query"))


def candidates(docs: DataFrame, rules: dict[str, str], repository: str) -> DataFrame:
    """candidates_of() the line rules' hits."""
    return candidates_of(hits(docs.select("path", "text"), rules), docs, repository)


def smallest_span(found: DataFrame) -> DataFrame:
    """One hit for each (file, source line, rule): from the shortest document, functions before modules, then by path."""
    order = Window.partitionBy("file", "source_line", "rule").orderBy("n_lines", "is_module", "path")
    return found.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def outside_spans(found: DataFrame, masks: DataFrame) -> DataFrame:
    """Matches (path, line, start, stop) that neither begin nor end in a masked span (path, line, begin, finish)."""
    m = masks.select(F.col("path").alias("mp"), F.col("line").alias("ml"), "begin", "finish")
    inside = ((F.col("begin") <= F.col("start")) & (F.col("start") < F.col("finish"))) | ((F.col("begin") < F.col("stop")) & (F.col("stop") <= F.col("finish")))
    return found.join(m, (F.col("path") == F.col("mp")) & (F.col("line") == F.col("ml")) & inside, "left_anti")


def security_focus(line: Column) -> Column:
    """3 for a sink, 1 more for a source."""
    any_of = lambda rules: F.coalesce(*[F.when(line.rlike(p), True) for p in rules.values()], F.lit(False))
    return F.when(any_of(SINK_RULES), 3).otherwise(0) + F.when(any_of(SOURCE_RULES), 1).otherwise(0)


def chmod_modes(docs: DataFrame) -> DataFrame:
    """(path, mode, others_write): literal modes of os.chmod calls, octal or decimal."""
    raw = F.explode(F.regexp_extract_all("text", F.lit(r"os\.chmod\s*\([^,()]*,\s*(0o[0-7]+|[0-9]+)\s*\)"), F.lit(1)))
    rows = docs.select("path", raw.alias("raw"))
    mode = F.when(F.col("raw").startswith("0o"), F.conv(F.substring("raw", 3, 20), 8, 10)).otherwise(F.col("raw")).cast("long")
    return rows.select("path", mode.alias("mode"), (mode.bitwiseAND(F.lit(2)) != 0).alias("others_write"))
