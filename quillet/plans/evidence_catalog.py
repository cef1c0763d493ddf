"""Queries of evidence, scopes, plans and commands over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import command
from ..operators import evidence, rules
from . import bindings as B
from .code_catalog import CODE, MASKED, _list, _plain, _sql, code_files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


def _pick(items: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in items]), at.cast("int"))


_ROLES = ["evidence", "supporting", "counter", "unresolved"]


@query(f"""WITH a AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey % 5 AS identity, l_suppkey AS reference FROM lineitem), c AS (SELECT l_orderkey AS case_id, l_suppkey AS reference, list_extract({_list(_ROLES)}, CAST(l_linenumber % 4 AS INT) + 1) AS role FROM lineitem)
SELECT case_id, identity FROM a JOIN c USING (case_id, reference) GROUP BY ALL HAVING bool_or(role IN ('evidence', 'supporting')) AND NOT bool_or(role IN ('counter', 'unresolved'))""")
def supporting_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases, suppliers as references under which parts are observed."""
    li = B.table(spark, sf_dir, "lineitem")
    cited = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("reference"), _pick(_ROLES, F.col("l_linenumber") % 4).alias("role"))
    named = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("reference"), (F.col("l_partkey") % 5).alias("identity")).distinct()
    return evidence.supporting(cited, named)


_TOOLS = ["get_guards", "find_sanitizers", "compare_route_and_service_guard", "inspect_command_construction", "read_code"]
#: Contents of observations; the twin says of each which tool takes it for a sign of safety.
_CONTENTS = ['{"guards": ["authorize"]}', '{"guards": []}', '{"findings": [{"line": 3}]}', '{"recognized_guard_precedes_actions": true}', '{"recognized_guard_precedes_actions": false}', "no json", '{"findings": "x"}']


@query(f"""WITH o AS (SELECT o_orderkey, list_extract({_list(_TOOLS)}, CAST(o_orderkey % 5 AS INT) + 1) AS tool, CASE o_custkey % 4 WHEN 0 THEN 'REFUTED' WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'UNRESOLVED' END AS status,
  o_orderkey % 11 = 0 AS truncated, CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS same, CAST((o_orderkey + o_custkey) % 7 AS INT) AS k, CASE WHEN o_custkey % 2 = 0 THEN 'SANITIZED' ELSE 'AMBIGUOUS' END AS command FROM orders)
SELECT o_orderkey, CASE WHEN truncated OR same = false THEN false WHEN status = 'REFUTED' THEN coalesce(same, false) WHEN status = 'CONFIRMED' THEN false
  ELSE k <> 5 AND ((tool = 'get_guards' AND k = 0) OR (tool = 'find_sanitizers' AND k = 2) OR (tool = 'compare_route_and_service_guard' AND k = 3) OR (tool = 'inspect_command_construction' AND command = 'SANITIZED')) END AS speaks_for_safety FROM o""")
def safe_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations made from orders: which of them speak for safety."""
    o = B.table(spark, sf_dir, "orders")
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    status = F.when(cust % 4 == 0, "REFUTED").when(cust % 4 == 1, "CONFIRMED").when(cust % 4 == 2, "UNRESOLVED")
    same = F.when(cust % 3 == 0, True).when(cust % 3 == 1, False)
    says = evidence.affirmative_safe(_pick(_TOOLS, key % 5), status, key % 11 == 0, same, F.lit(None).cast("string"), F.lit(None).cast("long"), F.when(cust % 2 == 0, "SANITIZED").otherwise("AMBIGUOUS"), _pick(_CONTENTS, (key + cust) % 7))
    return o.select("o_orderkey", says.alias("speaks_for_safety"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS path FROM lineitem WHERE l_quantity >= 20), r AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS path FROM lineitem)
SELECT r.case_id, r.path, CASE WHEN s.path IS NULL THEN 'blocked' WHEN p_partkey IS NULL THEN 'error' ELSE 'ok' END AS status FROM r LEFT JOIN s ON r.case_id = s.case_id AND r.path = s.path LEFT JOIN part ON r.path = p_partkey AND p_size % 7 <> 0""")
def admitted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents that orders ask for; a scope holds the parts ordered in numbers."""
    li = B.table(spark, sf_dir, "lineitem")
    of = lambda df: df.select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("path"))
    return evidence.admitted_pairs(of(li), of(li.filter("l_quantity >= 20")), _parts(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "part").filter("p_size % 7 <> 0").select(F.col("p_partkey").alias("path"), "p_brand")


@query("SELECT DISTINCT l_orderkey AS case_id, l_partkey AS path, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 20 AND p_size % 7 <> 0")
def scope_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a case's scope admits."""
    scope = B.table(spark, sf_dir, "lineitem").filter("l_quantity >= 20").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("path"))
    return evidence.scope_documents(scope, _parts(spark, sf_dir))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT l_orderkey AS c, l_linenumber AS t, l_partkey % 5 = 0 AS fixture, CASE WHEN l_suppkey % 3 <> 0 THEN l_linenumber - 1 END AS need FROM lineitem),
ok AS (SELECT DISTINCT c, t FROM t WHERE fixture UNION SELECT t.c, t.t FROM t JOIN ok ON t.c = ok.c AND t.need = ok.t)
SELECT DISTINCT c AS case_id, t AS task_id FROM t WHERE c IN (SELECT c FROM t WHERE fixture) AND (c, t) NOT IN (SELECT (c, t) FROM ok)""")
def unreaching_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plans whose lines need the line before: lines that reach no fixture."""
    li = B.table(spark, sf_dir, "lineitem")
    needs = F.when(F.col("l_suppkey") % 3 != 0, F.array(F.col("l_linenumber") - 1))
    tool = F.when(F.col("l_partkey") % 5 == 0, evidence.FIXTURE_TOOL).otherwise("read_code")
    return evidence.unreaching(li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("task_id"), tool.alias("tool"), needs.alias("dependencies")))


@query("""WITH r AS (SELECT s_suppkey, list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'the dataset role is not configured for final claims' END, CASE WHEN s_acctbal < 0 THEN 'the code working tree is dirty' END,
  CASE WHEN s_nationkey % 2 = 0 THEN 'dataset nation is dirty' END, CASE WHEN s_suppkey % 5 = 0 THEN 'dataset orders is dirty' END], lambda x: x IS NOT NULL) AS reasons FROM supplier)
SELECT s_suppkey, len(reasons) = 0 AS eligible, array_to_string(reasons, '; ') AS reasons FROM r""")
def claim_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as runs: why each may not carry final claims."""
    data = F.array(*[F.struct(F.lit(n).alias("name"), d.alias("dirty")) for n, d in (("nation", F.col("s_nationkey") % 2 == 0), ("orders", F.col("s_suppkey") % 5 == 0))])
    reasons = evidence.claim_reasons(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal") < 0, data)
    return B.table(spark, sf_dir, "supplier").select("s_suppkey", (F.size(reasons) == 0).alias("eligible"), F.array_join(reasons, "; ").alias("reasons"))


@query("""WITH n AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 4 = 0 THEN 'SAFETY' END AS reason FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT l_orderkey AS case_id, l_suppkey AS response_id, reason AS block_reason, CASE WHEN reason IS NOT NULL THEN 'upstream_blocked' WHEN l_returnflag <> 'R' THEN 'nonempty_choices' WHEN id IS NOT NULL THEN 'upstream_empty_unresolved' ELSE 'empty_response_unresolved' END AS diagnosis
FROM lineitem LEFT JOIN n ON l_suppkey = id""")
def response_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as replies, suppliers as the provider's own records of them."""
    events = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("response_id"), (F.col("l_returnflag") != "R").alias("has_choices"))
    records = B.table(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("response_id"), F.when(F.col("s_nationkey") % 4 == 0, "SAFETY").alias("block_reason"))
    return evidence.response_classes(events, records)


_HELPER_LINES = ["def get_cmd(x):", "    return build_cmd(x)", "    subprocess.run(cmd)", "    bash -c x", "    cur.execute(q)", "    x = 1", "  def format_cmd (a):"]
_HELPER_SYMBOLS = ["f", "get_cmd", "format_cmd", "make_cmd"]


@query(f"""WITH h AS (SELECT doc_id, 'a.py::' || list_extract({_list(_HELPER_SYMBOLS)}, CAST(n_chars % 4 AS INT) + 1) || '@1-3' AS path, array_to_string(list_transform(range(0, 3), lambda k: list_extract({_list(_HELPER_LINES)}, CAST((doc_id * (k + 1) + n_chars) % 7 AS INT) + 1)), chr(10)) AS text FROM documents)
SELECT doc_id, regexp_matches(text, '(get|build|make|format)_cmd') AND regexp_matches(text, 'subprocess|bash|\\.execute\\(') AS builds, regexp_matches(path, '::(get|build|make)_cmd@') OR regexp_matches(text, '(?m)^\\s*def\\s+(get|build|make|format)_cmd\\s*\\(') AS helper FROM h""")
def command_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as three lines of code: which build shell commands, which are helpers for that."""
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: _pick(_HELPER_LINES, (F.col("doc_id") * (k + 1) + F.col("n_chars")) % 7)), "\n")
    path = F.concat(F.lit("a.py::"), _pick(_HELPER_SYMBOLS, F.col("n_chars") % 4), F.lit("@1-3"))
    return B.table(spark, sf_dir, "documents").select("doc_id", command.builds_shell_command(text).alias("builds"), command.is_command_helper(path, text).alias("helper"))


@query(f"""WITH {CODE} SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(text, {_sql(command.STRING_LITERAL.replace("*+", "*"))}, '', 'g'), {_sql(command.IDENTIFIER)}),
  lambda n: NOT list_contains({_list(list(command.NON_VALUES))}, n) AND NOT regexp_matches(n, '^[A-Z]')))), ',') AS names FROM code""")
def value_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in each derived file, literals and type words aside."""
    return code_files(spark, sf_dir).select("doc_id", F.array_join(command.value_identifiers(F.col("text")), ",").alias("names"))


_FRAGMENTS = [("literal", "ls "), ("quoted", "dir"), ("literal", " -l "), ("raw", "name"), ("literal", "exec env "), ("literal", "a;b"), ("unknown", ""), ("literal", "bash -c ")]
_LAID = [t if k == "literal" else {"quoted": "<q>", "raw": "<r>", "unknown": "<u>"}[k] for k, t in _FRAGMENTS]


@query(f"""WITH f AS (SELECT o_orderkey, list_transform(range(0, 3), lambda k: list_extract({_list(_LAID)}, CAST((o_orderkey // (1 + 3 * k) + o_custkey * (k + 1)) % 8 AS INT) + 1)) AS part FROM orders), l AS (SELECT *, array_to_string(part, '') AS laid FROM f)
SELECT o_orderkey, CASE WHEN laid LIKE '%;%' OR laid LIKE '%bash%' OR laid LIKE '%<u>%' THEN 'AMBIGUOUS' WHEN laid LIKE '%<r>%' THEN 'UNSANITIZED'
  WHEN laid LIKE '%<q>%' AND (regexp_matches(laid, '(^|[^ ])<q>|<q>[^ ]') OR regexp_matches(laid, '^(exec +)?(env|exec) |^ *<q>|^ *-')) THEN 'AMBIGUOUS' ELSE 'SANITIZED' END AS status FROM l""")
def shell_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commands of three fragments, and their states."""
    all_of = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in _FRAGMENTS])
    at = lambda k: (F.floor(F.col("o_orderkey") / (1 + 3 * k)) + F.col("o_custkey") * (k + 1)) % 8
    parts = F.array(*[F.get(all_of, at(k).cast("int")) for k in range(3)])
    return B.table(spark, sf_dir, "orders").select("o_orderkey", command.shell_status(parts).alias("status"))


_SINKS = " + ".join(f"len(regexp_extract_all(code, {_sql(_plain(p))}))" for p in rules.SINK_RULES.values())
_GUARDS = f"len(list_distinct(regexp_extract_all(text, {_sql(rules.GUARD)})))"


@query(f"""WITH {MASKED}, s AS (SELECT doc_id, CAST(sum({_SINKS}) AS BIGINT) AS sinks, min(CASE WHEN {_SINKS} > 0 THEN line END) AS first_sink FROM ln GROUP BY doc_id),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM code), g AS (SELECT doc_id, min(line) AS first_guard FROM raw WHERE regexp_matches(code, {_sql(rules.GUARD)}) GROUP BY doc_id),
v AS (SELECT doc_id, path, sinks, first_sink, {_GUARDS} AS guards, first_guard FROM code JOIN s USING (doc_id) LEFT JOIN g USING (doc_id)),
p AS (SELECT a.path, b.path AS fixed_path, a.sinks AS old_sinks, b.sinks AS new_sinks, CAST(a.guards AS INT) AS old_guards, CAST(b.guards AS INT) AS new_guards, CASE WHEN b.path IS NOT NULL THEN coalesce(b.first_guard < b.first_sink, false) END AS guard_precedes_sinks FROM v a LEFT JOIN v b ON b.doc_id = a.doc_id + 1)
SELECT *, new_sinks < old_sinks OR (new_guards > old_guards AND guard_precedes_sinks) AS supports_fix FROM p""")
def version_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each derived file against the next document's as its second version."""
    docs = code_files(spark, sf_dir)
    facts = evidence.version_facts(docs)
    then = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("fixed_path"))
    return evidence.compared_versions(docs.select("doc_id", "path").join(then, "doc_id", "left").select("path", "fixed_path"), facts, facts)
