"""Deterministic experts over retrieved evidence (case_id, evidence_id, text): one vote a case, by native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of sinks, sensitive operations and guards, case ignored.
SINKS = [
    r"(?<![\w.])(?:eval|exec)\s*\(", r"subprocess\.(?:run|popen|call)", r"Runtime\.getRuntime\(\)\.exec", r"\bProcessBuilder\s*\(", r"\.command\s*\(",
    r"\.(?:execute|executeQuery|executeUpdate|prepareStatement|prepareCall)\s*\(", r"\.(?:search|compile|evaluate)\s*\(", r"\b(?:FileInputStream|FileOutputStream|FileReader|FileWriter)\s*\(", r"\.delete\s*\(", r"shell\s*=\s*True",
]
SENSITIVE = [r"\.delete\s*\(", r"(?<![\w.])transfer\s*\(", r"(?<![\w.])(?:update|set|grant)_role\s*\("]
GUARDS = [r"require_permission\s*\(", r"(?<![\w.])authorize\s*\(", r"is_admin\s*\(", r"check_role\s*\(", r"has_permission\s*\("]


def _any(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def scan_votes(evidence: DataFrame) -> DataFrame:
    """VULNERABLE where evidence holds a sink, surer with each item (0.80 + 0.05 each, at most 0.95); else ABSTAIN: no match proves nothing."""
    hits = evidence.groupBy("case_id").agg(F.count_if(F.col("text").rlike(_any(SINKS))).alias("n"))
    sure = F.when(F.col("n") > 0, F.least(F.lit(0.95), F.round(0.80 + 0.05 * F.col("n"), 9))).otherwise(F.lit(0.35))
    return hits.select("case_id", F.lit("scan").alias("expert"), F.when(F.col("n") > 0, "VULNERABLE").otherwise("ABSTAIN").alias("label"), sure.alias("confidence"))


def _first(text: Column, patterns: list[str]) -> Column:
    """Length of text before the first match; null without one."""
    return F.when(text.rlike(_any(patterns)), F.length(F.get(F.split(text, _any(patterns), 2), F.lit(0))))


def authorization_votes(evidence: DataFrame) -> DataFrame:
    """VULNERABLE where a sensitive operation has no guard ahead of it in the same text, SAFE where all have one, else ABSTAIN.

    A text's first operation decides: a guard ahead of it is ahead of all later ones.
    """
    text = F.col("text")
    rows = evidence.select("case_id", _first(text, SENSITIVE).alias("op"), _first(text, GUARDS).alias("guard"))
    guarded = F.col("op").isNotNull() & F.coalesce(F.col("guard") < F.col("op"), F.lit(False))
    open_ = F.col("op").isNotNull() & ~guarded
    cases = rows.groupBy("case_id").agg(F.bool_or(open_).alias("open"), F.bool_or(guarded).alias("guarded"))
    label = F.when(F.col("open"), "VULNERABLE").when(F.col("guarded"), "SAFE").otherwise("ABSTAIN")
    sure = F.when(F.col("open"), 0.82).when(F.col("guarded"), 0.84).otherwise(0.35)
    return cases.select("case_id", F.lit("authz").alias("expert"), label.alias("label"), sure.alias("confidence"))
