"""Expert votes (case_id, expert, label, confidence, vote_order, ...) and their adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ABSTAIN, VULNERABLE, SAFE = "ABSTAIN", "VULNERABLE", "SAFE"
FAST_CONFIDENCE, QUORUM = 0.80, 2


def checked(votes: DataFrame) -> DataFrame:
    """The votes; an error where an expert votes twice in a case."""
    times = F.count("*").over(Window.partitionBy("case_id", "expert"))
    error = F.raise_error(F.lit("duplicate expert ballots cannot form an independent quorum"))
    return votes.withColumn("times", times).filter(F.when(F.col("times") > 1, error.cast("boolean")).otherwise(True)).drop("times")


def single(votes: DataFrame) -> DataFrame:
    """The first vote of each case."""
    return votes.groupBy("case_id").agg(F.min_by("label", "vote_order").alias("label"), F.min_by("confidence", "vote_order").alias("confidence"))


def _tally(votes: DataFrame, counted: Column) -> DataFrame:
    of = lambda name: counted & (F.col("label") == name)
    aggregates = [F.max(F.when(counted, F.col("confidence"))).alias("top")]
    for name, short in ((VULNERABLE, "v"), (SAFE, "s")):
        aggregates += [F.count_if(of(name)).alias(f"n_{short}"), F.avg(F.when(of(name), F.col("confidence"))).alias(f"c_{short}"), F.min(F.when(of(name), F.col("vote_order"))).alias(f"f_{short}")]
    return votes.groupBy("case_id").agg(*aggregates)


def early(votes: DataFrame, *, quorum: int = QUORUM, confidence: float = FAST_CONFIDENCE) -> DataFrame:
    """(case_id, label, confidence): the early quorum of confident material votes, null without one; a tie goes to the label seen first."""
    t = _tally(votes, (F.col("label") != ABSTAIN) & (F.col("confidence") >= confidence))
    v_wins = (F.col("n_v") > F.col("n_s")) | ((F.col("n_v") == F.col("n_s")) & (F.col("f_v") < F.col("f_s")))
    label = F.when(F.greatest("n_v", "n_s") < quorum, None).when(v_wins, F.lit(VULNERABLE)).otherwise(F.lit(SAFE))
    return t.select("case_id", label.alias("label"), F.when(label == VULNERABLE, F.col("c_v")).when(label == SAFE, F.col("c_s")).alias("confidence"))


def majority(votes: DataFrame, *, quorum: int = QUORUM) -> DataFrame:
    """(case_id, label, confidence): the full review; too few votes, a tie or no quorum abstain with the highest confidence."""
    t = _tally(votes, F.col("label") != ABSTAIN)
    decided = (F.col("n_v") != F.col("n_s")) & (F.greatest("n_v", "n_s") >= quorum)
    label = F.when(~decided, F.lit(ABSTAIN)).when(F.col("n_v") > F.col("n_s"), F.lit(VULNERABLE)).otherwise(F.lit(SAFE))
    sure = F.when(label == VULNERABLE, F.col("c_v")).when(label == SAFE, F.col("c_s")).otherwise(F.coalesce("top", F.lit(0.0)))
    return t.select("case_id", label.alias("label"), sure.alias("confidence"))


def last_ballots(executions: DataFrame) -> DataFrame:
    """Each expert's last judgement in a case, with costs summed over all its tasks (case_id, expert, position, label, confidence, calls)."""
    return executions.groupBy("case_id", "expert").agg(F.max_by("label", "position").alias("label"), F.max_by("confidence", "position").alias("confidence"), F.max("position").alias("position"), F.sum("calls").alias("calls"))


def prefix_replay(executions: DataFrame, experts: tuple[str, ...], after: int, *, quorum: int = QUORUM, confidence: float = FAST_CONFIDENCE) -> DataFrame:
    """(case_id, eligible, label, saved_calls): would an early quorum have ended the case once the first `after` experts were done?

    The cut is the first execution at which exactly those experts' last judgements are in.
    """
    ballots = last_ballots(executions)
    wanted = F.col("expert").isin(*experts[:after])
    edge = ballots.groupBy("case_id").agg(F.max(F.when(wanted, F.col("position"))).alias("cut"), F.count_if(wanted).alias("n"), F.min(F.when(~wanted, F.col("position"))).alias("other"))
    edge = edge.filter((F.col("n") == after) & (F.coalesce("other", F.lit(2**31 - 1)) > F.col("cut")))
    order = F.coalesce(*[F.when(F.col("expert") == e, i) for i, e in enumerate(experts)])
    fast = early(ballots.filter(wanted).withColumn("vote_order", order), quorum=quorum, confidence=confidence).filter("label is not null")
    eligible = edge.join(fast.select("case_id", "label"), "case_id")
    saved = executions.join(eligible.select("case_id", "cut"), "case_id").groupBy("case_id").agg(F.sum(F.when(F.col("position") > F.col("cut"), F.col("calls")).otherwise(0)).alias("saved_calls"))
    rows = executions.select("case_id").distinct().join(eligible.select("case_id", "label"), "case_id", "left").join(saved, "case_id", "left")
    return rows.select("case_id", F.col("label").isNotNull().alias("eligible"), "label", F.coalesce("saved_calls", F.lit(0)).alias("saved_calls"))


def cost_rollup(executions: DataFrame) -> DataFrame:
    return executions.groupBy("case_id").agg(F.sum("calls").alias("calls"), F.count("*").alias("tasks"), F.count_distinct("expert").alias("experts"))


def ready_task(subtasks: DataFrame, done: DataFrame, rank: Column) -> DataFrame:
    """The next subtask of each case: all its dependencies are done, it is not, and its expert ranks first."""
    needed = subtasks.select("case_id", "task_id", F.explode("dependencies").alias("need"))
    waiting = needed.join(done.select("case_id", F.col("task_id").alias("need")), ["case_id", "need"], "left_anti").select("case_id", "task_id").distinct()
    ready = subtasks.join(waiting, ["case_id", "task_id"], "left_anti").join(done, ["case_id", "task_id"], "left_anti")
    first = Window.partitionBy("case_id").orderBy(rank, "position")
    return ready.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
