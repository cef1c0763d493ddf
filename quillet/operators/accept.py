"""Plans against observations: planned cells, acceptance, splits, samples, constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def planned_cells(cases: DataFrame, systems: list[str]) -> DataFrame:
    """Every case under every system; the systems are a fixed short list, so each case row is repeated in place."""
    return cases.withColumn("system", F.explode(F.array(*[F.lit(s) for s in systems])))


def with_plan(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Observed rows (case_id, system, status, calls) under their plan (case_id, system, truth).

    A planned cell without rows gets one of status not_run and cost 0; rows outside the plan are kept, marked.
    """
    seen = rows.select("case_id", "system", "status", "calls")
    inside = planned.join(seen, ["case_id", "system"], "left").select("case_id", "system", F.coalesce("status", F.lit("not_run")).alias("status"), F.coalesce("calls", F.lit(0)).alias("calls"), "truth", F.lit(True).alias("planned"))
    outside = seen.join(planned, ["case_id", "system"], "left_anti").select("case_id", "system", "status", "calls", F.lit(None).cast("string").alias("truth"), F.lit(False).alias("planned"))
    return inside.unionByName(outside)


def acceptance_issues(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(case_id, system, issue, category) of all differences between plan and rows (case_id, system, status, label)."""
    seen = rows.groupBy("case_id", "system").agg(F.count("*").alias("n"), F.min("status").alias("status"), F.min("label").alias("label"))
    both = planned.select("case_id", "system", "truth", F.lit(1).alias("p")).join(seen, ["case_id", "system"], "full_outer")
    run, quality = F.lit("run_integrity"), F.lit("detection_quality")
    checks = [
        (F.col("n").isNull(), "missing", run),
        (F.col("p").isNull(), "unexpected", run),
        (F.col("n") > 1, "duplicate", run),
        (F.col("p").isNotNull() & (F.col("n") == 1) & ~F.col("status").isin("completed", "abstained"), "status", run),
        (F.col("p").isNotNull() & (F.col("n") == 1) & (F.col("status") == "completed") & ~F.col("label").eqNullSafe(F.col("truth")), "label", quality),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(i).alias("issue"), g.alias("category"))) for c, i, g in checks]), lambda x: x.isNotNull())
    return both.select("case_id", "system", F.inline(found))


def stratified_sample(cases: DataFrame, per_stratum: int, strata: list[str], key: Column, seed: str) -> DataFrame:
    """The first cases of each stratum in the order of a seeded SHA-256, whatever the input's order; a short stratum is an error when its rows are read."""
    order = F.sha2(F.concat(F.lit(seed), key), 256)
    window = Window.partitionBy(*strata).orderBy("sample_hash", key)
    rows = cases.withColumn("sample_hash", order).withColumns({"place": F.row_number().over(window), "held": F.count("*").over(Window.partitionBy(*strata))})
    short = F.raise_error(F.concat(F.lit("stratum of fewer than "), F.lit(per_stratum).cast("string"), F.lit(" cases")))
    place = F.when(F.col("held") < per_stratum, short.cast("int")).otherwise(F.col("place"))
    return rows.filter(F.col("place") <= per_stratum).withColumn("place", place).drop("held")


def first_of(cases: DataFrame, strata: list[str], order: str, n: int = 1) -> DataFrame:
    """The first n cases of each stratum by their place."""
    if isinstance(n, bool) or n < 1:
        raise ValueError("n must be a positive number of cases")
    return cases.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy(order))).filter(F.col("place") <= n)


def interleaved(cells: DataFrame, position: str, variant: str) -> DataFrame:
    """cells with `slot`: cases in order, the order of their variants turned around at each second case."""
    turn = F.when(F.col(position) % 2 == 0, F.col(variant)).otherwise(-F.col(variant))
    return cells.withColumn("slot", F.row_number().over(Window.partitionBy(position).orderBy(turn)))


def repository_split(inputs: DataFrame, labels: DataFrame, excluded: DataFrame) -> DataFrame:
    """(entry_id, repo, issue): inputs outside the excluded repositories; a label without input is an issue."""
    kept = inputs.join(excluded.select("repo").distinct(), "repo", "left_anti")
    strange = labels.join(inputs.select("entry_id"), "entry_id", "left_anti").select("entry_id", F.lit(None).cast("string").alias("repo"), F.lit("label_without_input").alias("issue"))
    return kept.select("entry_id", "repo", F.lit(None).cast("string").alias("issue")).union(strange)


def run_outcome(error: Column, calls: Column, label: Column) -> Column:
    """The status of a run by how it ended: an error's kind, the calls made before it, the label."""
    budget = error.isin("BudgetExceeded", "BudgetStopped")  # the second is a kind of the first
    failed = F.when(error == "KeyboardInterrupt", "interrupted").when(budget & (calls == 0), "not_run").when(error == "BudgetStopped", "interrupted").otherwise("failed")
    return F.when(error.isNotNull(), failed).when(label == "ABSTAIN", "abstained").otherwise("completed")


def collapsed_cells(rows: DataFrame) -> DataFrame:
    """One row for each (case_id, system): several rows of a cell become one failed row with their costs summed."""
    n = F.count("*")
    one = lambda c: F.when(n == 1, F.min(c))
    return rows.groupBy("case_id", "system").agg(F.when(n > 1, "failed").otherwise(F.min("status")).alias("status"), one("predicted_label").alias("predicted_label"), F.min("ground_truth").alias("ground_truth"), F.min("category").alias("category"), F.sum("model_calls").alias("model_calls"))


def heldout(rows: DataFrame, development: DataFrame) -> DataFrame:
    """rows (entry_id, repo, report_id, verified) with why they are left out, null if they stay.

    Reasons in order: unverified, a repository used in development, an advisory seen in such a repository.
    """
    used = rows.join(development.select("repo").distinct(), "repo", "left_semi").select("report_id").distinct().withColumn("dev_report", F.lit(True))
    repos = development.select("repo").distinct().withColumn("dev_repo", F.lit(True))
    joined = rows.join(repos, "repo", "left").join(used, "report_id", "left")
    reason = F.when(~F.col("verified"), "unverified").when(F.col("dev_repo"), "development_repository").when(F.col("dev_report"), "development_advisory")
    return joined.select("entry_id", "repo", "report_id", reason.alias("reason"))


def largest_group(rows: DataFrame, by: str, group: str) -> DataFrame:
    """Per `by` the group with the most rows; ties go to the smallest name."""
    counts = rows.groupBy(by, group).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), group)
    return counts.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def symmetric_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows that one bag has more often than the other, with the side."""
    return one.exceptAll(two).withColumn("side", F.lit("left")).union(two.exceptAll(one).withColumn("side", F.lit("right")))


def key_differences(labels: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """(key, issue): labels without prediction, predictions without label."""
    one, two = labels.select(key).distinct(), predictions.select(key).distinct()
    return one.join(two, key, "left_anti").withColumn("issue", F.lit("missing")).union(two.join(one, key, "left_anti").withColumn("issue", F.lit("extra")))


def repair_choice(attempts: DataFrame) -> DataFrame:
    """Per entry the first acceptable commit in page order and how many were rejected before it; attempts (entry_id, pos, commit, accepted)."""
    first = attempts.groupBy("entry_id").agg(F.min(F.when(F.col("accepted"), F.col("pos"))).alias("chosen"))
    rows = attempts.join(first, "entry_id")
    return rows.groupBy("entry_id").agg(F.max(F.when(F.col("pos") == F.col("chosen"), F.col("commit"))).alias("commit"), F.count_if(F.col("chosen").isNull() | (F.col("pos") < F.col("chosen"))).alias("rejected"))


def covers(required: DataFrame, retained: DataFrame, key: str, item: str) -> DataFrame:
    """(key, complete): whether everything required of a key was retained (relational division)."""
    missing = required.join(retained.select(key, item).distinct(), [key, item], "left_anti").groupBy(key).agg(F.count("*").alias("m"))
    return required.select(key).distinct().join(missing, key, "left").select(key, F.col("m").isNull().alias("complete"))
