"""Queries of planned runs and of conclusions over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accept, policy, runs
from ..sources import readers
from ..sources.runs import Run, follow
from ..sources.staging import new_path
from . import bindings as B
from .code_catalog import _list
from .evidence_catalog import _pick

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


@query("""WITH o AS (SELECT l_orderkey AS c, CASE l_partkey % 4 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REFUTED' WHEN 2 THEN 'UNRESOLVED' END AS says, l_suppkey % 7 <> 0 AS same, l_quantity >= 45 AS truncated, l_suppkey % 2 = 0 AS cited, l_suppkey % 3 <> 0 AS backs FROM lineitem),
f AS (SELECT c, count(*) FILTER (says = 'CONFIRMED' AND same) AS ch, count(*) FILTER (says = 'REFUTED' AND same) AS rh, count(*) FILTER (says = 'CONFIRMED' AND backs AND cited) AS cc, count(*) FILTER (says = 'REFUTED' AND backs AND cited) AS rc,
  count(*) FILTER (says = 'CONFIRMED' AND backs AND NOT cited AND same) AS cu, count(*) FILTER (says = 'REFUTED' AND backs AND NOT cited AND same) AS ru, count(*) FILTER (says <> 'UNRESOLVED' AND backs AND cited AND NOT same) AS foreign_n FROM o WHERE NOT truncated GROUP BY c),
k AS (SELECT o_orderkey, list_extract(['VULNERABLE', 'SAFE', 'ABSTAIN'], CAST(o_orderkey % 3 AS INT) + 1) AS label, list_extract(['CONFIRMED', 'REFUTED', 'UNRESOLVED'], CAST(o_custkey % 3 AS INT) + 1) AS status, o_orderkey % 5 AS n, o_custkey % 13 = 0 AS open FROM orders),
j AS (SELECT k.*, coalesce(ch, 0) AS ch, coalesce(rh, 0) AS rh, coalesce(cc, 0) AS cc, coalesce(rc, 0) AS rc, coalesce(cu, 0) AS cu, coalesce(ru, 0) AS ru, coalesce(foreign_n, 0) AS fo FROM k LEFT JOIN f ON o_orderkey = c)
SELECT o_orderkey AS case_id, CASE WHEN label <> 'ABSTAIN' AND n = 0 THEN 'uncited' WHEN open THEN 'unfinished' WHEN (label = 'VULNERABLE' AND rh > 0) OR (label = 'SAFE' AND ch > 0) THEN 'contradicted' WHEN status = 'UNRESOLVED' THEN NULL
  WHEN label <> CASE status WHEN 'CONFIRMED' THEN 'VULNERABLE' ELSE 'SAFE' END THEN 'label' WHEN cc + rc = 0 AND CASE status WHEN 'CONFIRMED' THEN cu ELSE ru END > 0 THEN 'bibliography' WHEN cc + rc = 0 OR CASE status WHEN 'CONFIRMED' THEN rc ELSE cc END > 0 THEN 'unmatched' WHEN fo > 0 THEN 'subject' END AS issue FROM j""")
def prediction_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conclusions, their lines as observations: the first rule that each breaks."""
    o, li = B.table(spark, sf_dir, "orders"), B.table(spark, sf_dir, "lineitem")
    says = F.when(F.col("l_partkey") % 4 == 0, "CONFIRMED").when(F.col("l_partkey") % 4 == 1, "REFUTED").when(F.col("l_partkey") % 4 == 2, "UNRESOLVED")
    # a line is known by supplier, part and number, which its citations share
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    seen = li.select(F.col("l_orderkey").alias("case_id"), key.alias("identity"), says.alias("validation_status"), (F.col("l_quantity") >= 45).alias("truncated"), (F.col("l_suppkey") % 7 != 0).alias("same_subject"))
    of = lambda when: li.filter(when).select(F.col("l_orderkey").alias("case_id"), key.alias("identity"))
    said = o.select(F.col("o_orderkey").alias("case_id"), _pick(["VULNERABLE", "SAFE", "ABSTAIN"], F.col("o_orderkey") % 3).alias("label"), _pick(["CONFIRMED", "REFUTED", "UNRESOLVED"], F.col("o_custkey") % 3).alias("validation_status"), (F.col("o_orderkey") % 5).alias("n_evidence"))
    return policy.prediction_issues(said, seen, of("l_suppkey % 2 = 0"), of("l_suppkey % 3 <> 0"), o.filter("o_custkey % 13 = 0").select(F.col("o_orderkey").alias("case_id")))


@query(f"""WITH c AS (SELECT doc_id, quality, unnest({_list(list(runs.SYSTEMS))}) AS system FROM labels), r AS (SELECT o_orderkey AS doc_id, 'E' || (o_custkey % 5 + 1) AS system, count(*) AS n FROM orders GROUP BY ALL)
SELECT c.doc_id AS case_id, c.system, quality = 1 AS ground_truth, CASE WHEN n IS NULL THEN 'not_run' WHEN n > 1 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN n = 1 THEN 'SAFE' END AS label FROM c LEFT JOIN r ON c.doc_id = r.doc_id AND c.system = r.system""")
def planned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents under five systems; an order is the row of the cell that it names."""
    cases = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("ground_truth"))
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("E"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("system"), F.lit("completed").alias("status"), F.lit("SAFE").alias("label"))
    return runs.rows_with_truth(runs.planned_cells(cases, runs.SYSTEMS), rows)


@query("""WITH c AS (SELECT s_suppkey, list_filter([CASE WHEN s_suppkey % 4 = 0 THEN 'case_ids' END, CASE WHEN s_suppkey % 3 = 0 THEN 'systems' END, CASE WHEN s_nationkey % 5 = 0 THEN 'max_trials' END, CASE WHEN s_suppkey % 6 NOT IN (1, 2) THEN 'concurrency' END, CASE WHEN s_acctbal < 0 THEN 'entry_method' END], lambda x: x IS NOT NULL) AS i FROM supplier)
SELECT s_suppkey, array_to_string(i, ',') AS issues FROM c""")
def configuration_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as configurations of the ten-trial protocol."""
    s = F.col("s_suppkey")
    cases = F.array(F.lit("a"), F.when(s % 4 == 0, "a").otherwise("b"))
    systems = F.array(*[F.when(s % 3 == 0, F.lit("E9")).otherwise(F.lit(x)) for x in runs.SYSTEMS])
    issues = runs.ten_trial_issues(cases, systems, F.when(F.col("s_nationkey") % 5 == 0, 9).otherwise(10), s % 6, F.when(F.col("s_acctbal") < 0, "doGet").otherwise("doPost"))
    return B.table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(issues, ",").alias("issues"))


_ANSWERS = ['{"label": "SAFE", "confidence": 0.5, "rationale": "r"}', '```json\n{"label": "VULNERABLE", "confidence": 1, "rationale": ""}\n```', '{"label": "ABSTAIN", "confidence": 0.5, "rationale": "r"}', '{"label": "SAFE", "confidence": "0.5", "rationale": "r"}', '{"label": "SAFE", "confidence": 1.5, "rationale": "r"}', '{"label": "SAFE", "confidence": true, "rationale": "r"}', '{"label": "UNRESOLVED", "confidence": 0, "rationale": 3}', "none", ' {"label": "UNRESOLVED", "confidence": 0, "rationale": "x y"} ']


@query("""WITH a AS (SELECT doc_id, CAST((doc_id + n_chars) % 9 AS INT) AS k FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'SAFE' WHEN 1 THEN 'VULNERABLE' WHEN 8 THEN 'UNRESOLVED' END AS label, CASE k WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0 WHEN 8 THEN 0.0 END AS confidence, CASE k WHEN 0 THEN 'r' WHEN 1 THEN '' WHEN 8 THEN 'x y' END AS rationale FROM a""")
def direct_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a direct model made from documents: what is valid in them."""
    answer = runs.direct_answer(_pick(_ANSWERS, (F.col("doc_id") + F.col("n_chars")) % len(_ANSWERS)))
    return B.table(spark, sf_dir, "documents").select("doc_id", answer.alias("a")).select("doc_id", "a.label", "a.confidence", "a.rationale")


@query("""SELECT doc_id, '{"candidate_id":"c' || doc_id || '","line":' || n_chars || ',"path":"' || coalesce(lang, 'und') || '.py"' || CASE WHEN source IS NOT NULL THEN ',"repository_id":"' || source || '"' ELSE '' END || CASE WHEN n_chars % 3 = 0 THEN ',"scope":"all"' ELSE '' END || '}' AS visible FROM documents""")
def visible_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates: what a model sees of each; text stays out."""
    seen = runs.visible(F.concat(F.lit("c"), F.col("doc_id").cast("string")), F.concat(F.coalesce("lang", F.lit("und")), F.lit(".py")), F.col("n_chars"), F.col("source"), F.when(F.col("n_chars") % 3 == 0, "all"))
    return B.table(spark, sf_dir, "documents").select("doc_id", seen.alias("visible"))


@query("SELECT doc_id AS case_id, system, CASE WHEN (doc_id + toxic) % 3 = 0 THEN 'VULNERABLE' ELSE 'SAFE' END AS label FROM labels, (SELECT unnest(['E1', 'E2', 'E3']) AS system)")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a run that is stopped behind its first batch, taken up again, and whose first batch is then tried once more."""
    labels = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), "toxic")
    cells, path = accept.planned_cells(labels, ["E1", "E2", "E3"]), new_path(spark, "run")
    label = F.when((F.col("case_id") + F.col("toxic")) % 3 == 0, "VULNERABLE").otherwise("SAFE")
    schema, key = cells.select("case_id", "system", label.alias("label")).schema, ["case_id", "system"]
    first = cells.filter("system = 'E1' or case_id % 5 = 0").select(*key, label.alias("label"))
    for turn in range(2):
        run = Run(spark, path)
        taken_up = run.begin(labels=(labels, F.concat_ws(":", "case_id", "toxic")))
        left = run.remaining(cells, key, schema).select(*key, label.alias("label"))
        run.record(left if taken_up else first, turn)
    run.record(first, 0)
    return run.finished(schema)


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def followed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user and type, counted over the batches of a stream."""
    raw = readers.stream_parquet(spark, f"{sf_dir}/events.parquet", B.table(spark, sf_dir, "events").schema)
    return follow(raw, new_path(spark, "progress"), lambda df: df.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id", "event_type"])
