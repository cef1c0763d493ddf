"""Checks of expert conclusions against the observations they cite, as queries that return violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unknown_citations(citations: DataFrame, known: DataFrame) -> DataFrame:
    """Citations (case_id, reference, role) of nothing known (case_id, reference) in their case."""
    return citations.join(known.select("case_id", "reference").distinct(), ["case_id", "reference"], "left_anti").select("case_id", "reference").distinct()


def role_conflicts(citations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(case_id, identity, roles): observations cited in several roles under any of their names; aliases (case_id, reference, identity).

    The general bibliography, role `evidence`, is no role of its own; a reference without alias stands for itself.
    """
    named = citations.filter("role <> 'evidence'").join(aliases, ["case_id", "reference"], "left")
    each = named.groupBy("case_id", F.coalesce("identity", "reference").alias("identity")).agg(F.array_sort(F.collect_set("role")).alias("r"))
    return each.filter(F.size("r") > 1).select("case_id", "identity", F.array_join("r", " / ").alias("roles"))


def missing_validators(required: DataFrame, executed: DataFrame) -> DataFrame:
    """(case_id, tool, missing): required runs (case_id, tool) that were executed less often, as bags."""
    count = lambda df, n: df.groupBy("case_id", "tool").agg(F.count("*").alias(n))
    both = count(required, "want").join(count(executed, "have"), ["case_id", "tool"], "left")
    short = F.col("want") - F.coalesce("have", F.lit(0))
    return both.withColumn("missing", short).filter("missing > 0").select("case_id", "tool", "missing")


def plan_violations(subtasks: DataFrame) -> DataFrame:
    """(case_id, task_id, issue) of plans: repeated ids, blank fields, dependencies that are unknown or not earlier.

    subtasks (case_id, position, task_id, objective, dependencies).
    """
    repeated = subtasks.groupBy("case_id", "task_id").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", "task_id", F.lit("repeated").alias("issue"))
    blank = subtasks.filter("trim(task_id) = '' or trim(coalesce(objective, '')) = ''").select("case_id", "task_id", F.lit("blank").alias("issue"))
    need = subtasks.select("case_id", "task_id", "position", F.explode("dependencies").alias("need"))
    at = subtasks.select("case_id", F.col("task_id").alias("need"), F.col("position").alias("at"))
    joined = need.join(at, ["case_id", "need"], "left")
    order = joined.filter("at is null or at >= position").select("case_id", "task_id", F.when(F.col("at").isNull(), "unknown").otherwise("forward").alias("issue"))
    return repeated.union(blank).union(order)


def command_status(statuses: DataFrame) -> DataFrame:
    """(case_id, status): UNSANITIZED over AMBIGUOUS over NOT_ESTABLISHED over SANITIZED; none is NOT_ESTABLISHED."""
    names = ("SANITIZED", "NOT_ESTABLISHED", "AMBIGUOUS", "UNSANITIZED")
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("status"))
    worst = statuses.groupBy("case_id").agg(F.max(F.when(rank > 0, rank)).alias("r"))
    return worst.select("case_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.coalesce(F.col("r"), F.lit(2)).cast("int")).alias("status"))


# What a concrete validation says.
PROVES = {"CONFIRMED": "VULNERABLE", "REFUTED": "SAFE"}


def prediction_issues(conclusions: DataFrame, observations: DataFrame, cited: DataFrame, support: DataFrame, unfinished: DataFrame) -> DataFrame:
    """(case_id, issue): the first rule that each conclusion breaks, null if none.

    conclusions (case_id, label, validation_status, n_evidence); observations (case_id, identity, validation_status,
    truncated, same_subject); cited and support (case_id, identity); unfinished (case_id) lacks a required validator.
    The rules on single tools (permissions, commands, empty searches) are not among them. Null flags count as false.
    """
    mark = lambda df, name: df.select("case_id", "identity").distinct().withColumn(name, F.lit(True))
    seen = observations.withColumnRenamed("validation_status", "says").filter(F.col("says").isin(*PROVES) & ~F.coalesce("truncated", F.lit(False)))
    seen = seen.join(mark(cited, "cited"), ["case_id", "identity"], "left").join(mark(support, "backs"), ["case_id", "identity"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    counts = []
    for says in PROVES:
        is_it, short = F.col("says") == says, says.lower()
        counts += [F.count_if(is_it & yes("same_subject")).alias(f"{short}_here"), F.count_if(is_it & yes("backs") & yes("cited")).alias(f"{short}_cited")]
        counts += [F.count_if(is_it & yes("backs") & ~yes("cited") & yes("same_subject")).alias(f"{short}_unlisted")]
    facts = seen.groupBy("case_id").agg(*counts, F.count_if(yes("backs") & yes("cited") & ~yes("same_subject")).alias("foreign"))
    both = conclusions.join(facts, "case_id", "left").join(unfinished.select("case_id").distinct().withColumn("unfinished", F.lit(True)), "case_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    label, status = F.col("label"), F.col("validation_status")
    confirmed = status == "CONFIRMED"
    of = lambda what: F.when(confirmed, n(f"confirmed_{what}")).otherwise(n(f"refuted_{what}"))
    against = F.when(confirmed, n("refuted_cited")).otherwise(n("confirmed_cited"))
    listed = of("cited") + against
    contradicted = F.when(label == "VULNERABLE", n("refuted_here")).when(label == "SAFE", n("confirmed_here")).otherwise(0) > 0
    issue = (
        F.when((label != "ABSTAIN") & (F.col("n_evidence") == 0), "uncited")
        .when(F.col("unfinished"), "unfinished")
        .when(contradicted, "contradicted")
        .when(status == "UNRESOLVED", None)
        .when(label != F.when(confirmed, PROVES["CONFIRMED"]).otherwise(PROVES["REFUTED"]), "label")
        .when((listed == 0) & (of("unlisted") > 0), "bibliography")
        .when((listed == 0) | (against > 0), "unmatched")
        .when(n("foreign") > 0, "subject")
    )
    return both.select("case_id", issue.alias("issue"))
