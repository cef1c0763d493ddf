"""Evidence of a case: support, affirmative counter-evidence, scopes, plans that must reach a fixture, compared versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from . import rules
from .masks import matches_outside

# The tool whose task a plan's other tasks must depend on.
FIXTURE_TOOL = "run_fixture_test"
#: Rows that a task of admitted_pairs() gets.
PER_PART = 500_000


def supporting(citations: DataFrame, aliases: DataFrame) -> DataFrame:
    """(case_id, identity): observations cited as evidence or support under any name, and under none as counter or unresolved.

    citations (case_id, reference, role); aliases (case_id, reference, identity) names each observation.
    """
    of = lambda *roles: F.bool_or(F.col("role").isin(*roles))
    named = aliases.select("case_id", "reference", "identity").join(citations, ["case_id", "reference"])
    each = named.groupBy("case_id", "identity").agg(of("evidence", "supporting").alias("backs"), of("counter", "unresolved").alias("other"))
    return each.filter("backs and not other").select("case_id", "identity")


def affirmative_safe(tool: Column, status: Column, truncated: Column, same_subject: Column, entry_path: Column, entry_line: Column, command_status: Column, content: Column) -> Column:
    """Whether an observation speaks for safety: a refutation of this subject, or a tool's own sign of it.

    same_subject is null for an observation without subject; entry_path is null where the case has none. Content that
    is no JSON object says nothing; an absent, empty, zero or false member counts as nothing.
    """
    at = lambda path: F.get_json_object(content, path)
    holds = lambda path: ~F.coalesce(at(path), F.lit("")).isin("", "[]", "{}", "0", "0.0", "false", "null")
    flows = F.from_json(at("$.candidate_sanitizer_flows"), "array<struct<source_path:string,helper_path:string,sink_line:long,sanitizer_lines:string>>")
    path = at("$.path")

    def crosses(f):
        line = entry_line.isNull() | f["sink_line"].eqNullSafe(entry_line)
        return f["source_path"].eqNullSafe(entry_path) & f["helper_path"].eqNullSafe(path) & line & ~F.coalesce(f["sanitizer_lines"], F.lit("[]")).isin("[]", "")

    elsewhere = entry_path.isNotNull() & holds("$.path") & (path != entry_path)
    cleaned = at("$.findings").startswith("[") & holds("$.findings") & F.when(elsewhere, F.coalesce(same_subject, F.lit(False)) & F.coalesce(F.exists(flows, crosses), F.lit(False))).otherwise(True)
    said = (
        F.when(tool == "get_guards", holds("$.guards"))
        .when(tool == "find_sanitizers", cleaned)
        .when(tool == "compare_route_and_service_guard", at("$.recognized_guard_precedes_actions") == "true")
        .when(tool == "inspect_command_construction", command_status == "SANITIZED")
    )
    is_object = F.ltrim(content).startswith("{")
    typed = F.when(truncated | ~same_subject, False).when(status == "REFUTED", F.coalesce(same_subject, F.lit(False))).when(status == "CONFIRMED", False)
    return F.coalesce(typed, F.coalesce(is_object & said, F.lit(False)))


def admitted(requests: DataFrame, scope: DataFrame, documents: DataFrame) -> DataFrame:
    """requests (case_id, path, ...) with status: blocked outside the case's scope (case_id, path), error without a document, else ok."""
    inside = scope.select("case_id", "path").distinct().withColumn("inside", F.lit(True))
    known = documents.select("path").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("inside").isNull(), "blocked").when(F.col("known").isNull(), "error").otherwise("ok")
    return requests.join(inside, ["case_id", "path"], "left").join(known, "path", "left").withColumn("status", status).drop("inside", "known")


def admitted_pairs(requests: DataFrame, scope: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, path, status) as admitted() has it, each requested pair once.

    Requests and scope meet in one aggregate, over partitions of about PER_PART rows however many there are, and pass by
    the documents' paths, which alone are held in memory.
    """
    named = scope.select("case_id", "path").filter("case_id is not null and path is not null")
    n = requests.count() + named.count()
    parts = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PER_PART))
    flag = lambda df, asked: df.select("case_id", "path", F.lit(asked).alias("asked"))
    both = flag(requests, True).union(flag(named, False)).repartition(parts, "case_id", "path")
    asked = both.groupBy("case_id", "path").agg(F.bool_or("asked").alias("asked"), F.bool_and("asked").alias("outside")).filter("asked")
    known = documents.select("path").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("outside"), "blocked").when(F.col("known").isNull(), "error").otherwise("ok")
    return asked.repartition(parts, "path").join(known.hint("shuffle_hash"), "path", "left").select("case_id", "path", status.alias("status"))


def scope_documents(scope: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, path, ...) of the documents that a case's scope admits."""
    return scope.select("case_id", "path").distinct().join(documents, "path")


def unreaching(subtasks: DataFrame) -> DataFrame:
    """(case_id, task_id): tasks of plans with a fixture task that neither are one nor depend on one, at however many steps.

    subtasks (case_id, task_id, tool, dependencies). The frontier is staged at each step and leaves out what was
    reached before, so cycles end; there are as many steps as the longest chain has tasks.
    """
    needs = stage(subtasks.select("case_id", "task_id", F.explode("dependencies").alias("need")).distinct(), "needs")
    frontier = stage(subtasks.filter(F.col("tool") == FIXTURE_TOOL).select("case_id", "task_id").distinct(), "fixtures")
    cases, seen = frontier.select("case_id").distinct(), frontier
    while not frontier.isEmpty():
        step = needs.join(frontier.withColumnRenamed("task_id", "need"), ["case_id", "need"]).select("case_id", "task_id").distinct()
        frontier = stage(step.join(seen, ["case_id", "task_id"], "left_anti"), "reached")
        seen = seen.union(frontier)
    return subtasks.select("case_id", "task_id").distinct().join(cases, "case_id", "left_semi").join(seen, ["case_id", "task_id"], "left_anti")


def claim_reasons(configured: Column, code_dirty: Column, datasets: Column) -> Column:
    """Why a run may not carry final claims, none if it may; datasets is an array of (name, dirty)."""
    first = F.array(F.when(~configured, "the dataset role is not configured for final claims"), F.when(code_dirty, "the code working tree is dirty"))
    dirty = F.transform(F.filter(datasets, lambda d: d["dirty"]), lambda d: F.concat(F.lit("dataset "), d["name"], F.lit(" is dirty")))
    return F.concat(F.filter(first, lambda x: x.isNotNull()), dirty)


def response_classes(events: DataFrame, records: DataFrame) -> DataFrame:
    """events (case_id, response_id, has_choices) with block_reason and diagnosis from records (response_id, block_reason); records that disagree are an error.

    Null response ids match each other.
    """
    one = records.groupBy("response_id").agg(F.min("block_reason").alias("block_reason"), F.count_distinct("block_reason").alias("kinds"), F.bool_or(F.col("block_reason").isNull()).alias("without"))
    clash = (F.col("kinds") > 1) | ((F.col("kinds") == 1) & F.col("without"))
    told = F.raise_error(F.lit("conflicting native evidence for a response id")).cast("string")
    one = one.select(F.col("response_id").alias("native_id"), F.when(clash, told).otherwise(F.col("block_reason")).alias("block_reason"))
    both = events.join(one.withColumn("native", F.lit(True)), F.col("response_id").eqNullSafe(F.col("native_id")), "left")
    blocked = F.coalesce(F.col("block_reason"), F.lit("")) != ""
    empty = F.when(F.col("native"), "upstream_empty_unresolved").otherwise("empty_response_unresolved")
    diagnosis = F.when(blocked, "upstream_blocked").when(F.col("has_choices"), "nonempty_choices").otherwise(empty)
    return both.select("case_id", "response_id", "block_reason", diagnosis.alias("diagnosis"))


def version_facts(docs: DataFrame) -> DataFrame:
    """(path, sinks, first_sink, guards, first_guard) of docs (path, language, text): matches of sinks outside masks, distinct guards, first lines."""
    sinks = matches_outside(docs.select("path", "language", "text"), rules.SINK_RULES)
    sinks = sinks.groupBy("path").agg(F.count("*").alias("sinks"), F.min("line").alias("first_sink"))
    guarded = rules.lines(docs.select("path", "text")).filter(F.col("code").rlike(rules.GUARD)).groupBy("path").agg(F.min("line").alias("first_guard"))
    guards = F.size(rules.distinct_matches(F.col("text"), rules.GUARD)).alias("guards")
    out = docs.select("path", guards).join(sinks, "path", "left").join(guarded, "path", "left")
    return out.withColumn("sinks", F.coalesce("sinks", F.lit(0)))


def compared_versions(pairs: DataFrame, facts: DataFrame, fixed_facts: DataFrame) -> DataFrame:
    """pairs (path, fixed_path) with counts and whether the source difference supports that the second version is a fix.

    It does if sinks are gone, or if guards were added and one stands before each sink. Without a second document
    there is nothing to compare: its columns are null. The status stays unresolved either way.
    """
    side = lambda df, key, mark: df.select(F.col("path").alias(key), *[F.col(c).alias(f"{mark}_{c}") for c in ("sinks", "first_sink", "guards", "first_guard")])
    both = pairs.join(side(facts, "path", "old"), "path").join(side(fixed_facts, "fixed_path", "new"), "fixed_path", "left")
    before = F.when(F.col("new_sinks").isNotNull(), F.coalesce(F.col("new_first_guard") < F.col("new_first_sink"), F.lit(False)))
    supports = (F.col("new_sinks") < F.col("old_sinks")) | ((F.col("new_guards") > F.col("old_guards")) & before)
    return both.select("path", "fixed_path", "old_sinks", "new_sinks", "old_guards", "new_guards", before.alias("guard_precedes_sinks"), supports.alias("supports_fix"))
