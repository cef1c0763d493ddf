"""Runs as planned: cells of cases and systems, their rows with truth, the protocol's configuration, a direct answer's parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of a direct answer, systems and entry of the ten-trial protocol.
LABELS = ("VULNERABLE", "SAFE", "UNRESOLVED")
SYSTEMS = ("E1", "E2", "E3", "E4", "E5")
ENTRY_METHOD = "doPost"


def planned_cells(cases: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """(…, system, place): a cell for each case and system; a matrix, a gate or a pilot differ in their cases only."""
    return cases.select("*", F.posexplode(F.array(*[F.lit(s) for s in systems])).alias("place", "system"))


def rows_with_truth(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Planned cells (case_id, system, ground_truth) with what rows (case_id, system, status, label) say; a cell without a row was not run.

    A cell with several rows is failed, without a label.
    """
    one = rows.groupBy("case_id", "system").agg(F.count("*").alias("n"), F.any_value("status").alias("status"), F.any_value("label").alias("label"))
    both = cells.select("case_id", "system", "ground_truth").join(one, ["case_id", "system"], "left")
    status = F.when(F.col("n").isNull(), "not_run").when(F.col("n") > 1, "failed").otherwise(F.col("status"))
    return both.select("case_id", "system", "ground_truth", status.alias("status"), F.when(F.col("n") == 1, F.col("label")).alias("label"))


def ten_trial_issues(case_ids: Column, systems: Column, max_trials: Column, concurrency: Column, entry_method: Column) -> Column:
    """Names of what a configuration has otherwise than the ten-trial protocol; null counts as otherwise."""
    holds = {
        "case_ids": (F.size(case_ids) == 2) & (F.size(F.array_distinct(case_ids)) == 2),
        "systems": systems == F.array(*[F.lit(s) for s in SYSTEMS]),
        "max_trials": max_trials == 10,
        "concurrency": concurrency.isin(1, 2),
        "entry_method": entry_method == ENTRY_METHOD,
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in holds.items()]), lambda x: x.isNotNull())


def direct_answer(content: Column) -> Column:
    """(label, confidence, rationale) of a direct model's JSON answer, with or without a fence; null where any of it is invalid.

    The confidence is a number from 0 to 1, the rationale a string; null content is invalid.
    """
    text = F.regexp_replace(F.coalesce(content, F.lit("")), r"^\s+|\s+$", "")
    fenced = text.startswith("```") & text.endswith("```")
    bare = F.when(fenced, F.regexp_extract(text, r"(?s)^```[^\n]*\n(.*)```$", 1)).otherwise(text)
    value = F.try_parse_json(bare)
    at = lambda path, kind: F.try_variant_get(value, path, kind)
    is_a = lambda path, *kinds: F.schema_of_variant(F.try_variant_get(value, path, "variant")).rlike("^(?:" + "|".join(kinds) + r")(?:\(|$)")
    label, confidence = at("$.label", "string"), at("$.confidence", "double")
    valid = label.isin(*LABELS) & is_a("$.confidence", "BIGINT", "DOUBLE", "DECIMAL") & confidence.between(0, 1) & is_a("$.rationale", "STRING")
    return F.when(valid, F.struct(label.alias("label"), confidence.alias("confidence"), at("$.rationale", "string").alias("rationale")))


def visible(candidate_id: Column, path: Column, line: Column, repository: Column, scope: Column) -> Column:
    """What a model sees of a candidate as JSON: its id, line, path, repository and, where it has one, its scope."""
    return F.to_json(F.struct(candidate_id.alias("candidate_id"), line.alias("line"), path.alias("path"), repository.alias("repository_id"), scope.alias("scope")))
