"""Queries of code, scopes, schedules and summaries over tables of code derived from documents, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.python_code import python_documents, scanned
from ..operators import accept, context, masks, metrics, rules
from ..sources.staging import stage_facts
from . import bindings as B
from .oracles import RES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Lines that the derived files of code are made of.
LINES = [
    "def handler(request):",
    "    # os.system(request.args['x'])",
    "    os.system(request.args['cmd'])  # open(x)",
    "    value = fetch(body)",
    '    label = "open(x) in text"',
    "    cursor.execute(query)",
    "    os.chmod(path, 0o777)",
    "    subprocess.run(cmd, shell=True)",
    "    // fetch(url)",
    "    data = req.query.name",
    "    user = request.user",
    "    if account.owner_id != current_user_id: deny()",
    "    doc = load(document_id)",
    "    delete_project(project_id)",
    "    name = shlex.quote(raw)",
    "    print('os.popen(x)') /* open(y) */",
]
LANGUAGES = ["python", "javascript", "shell"]


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(map(_sql, items)) + "]"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, language, text): eight lines of code for each document, a span of its source's file."""
    d = B.table(spark, sf_dir, "documents")
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.get(F.array(*[F.lit(x) for x in LINES]), ((F.col("doc_id") * (2 * k + 3) + F.col("n_chars") + k * k) % len(LINES)).cast("int")))
    first = (F.col("doc_id") * 4 + 1).cast("string")
    path = F.concat(F.col("source"), F.lit(".py::f@"), first, F.lit("-"), (F.col("doc_id") * 4 + 8).cast("string"))
    return d.select("doc_id", path.alias("path"), F.get(F.array(*[F.lit(x) for x in LANGUAGES]), (F.col("doc_id") % 3).cast("int")).alias("language"), F.array_join(at, "\n").alias("text"))


CODE = f"""code AS (SELECT doc_id, source || '.py::f@' || (doc_id * 4 + 1) || '-' || (doc_id * 4 + 8) AS path, list_extract({_list(LANGUAGES)}, CAST(doc_id % 3 AS INT) + 1) AS language,
  array_to_string(list_transform(range(0, 8), lambda k: list_extract({_list(LINES)}, CAST((doc_id * (2 * k + 3) + n_chars + k * k) % {len(LINES)} AS INT) + 1)), chr(10)) AS text FROM documents)"""
# Masked text of a language, as the twins have it: the parts between masks and the masks, blanked, laid end to end.
_BLANK = "array_to_string(list_transform(list_zip(string_split_regex(text, {0}), list_append(regexp_extract_all(text, {0}), '')), lambda z: z[1] || {1}), '')"
_ALL = "regexp_replace(coalesce(z[2], ''), '[^\\n]', ' ', 'g')"
_PLAIN_HASH = r"""#[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
MASKED = f"""{CODE}, masked AS (SELECT * REPLACE (CASE language WHEN 'python' THEN {_BLANK.format(_sql(_PLAIN_HASH), _ALL)} WHEN 'javascript' THEN {_BLANK.format(_sql(masks.SLASH), _ALL)}
  ELSE {_BLANK.format(_sql(masks.WHOLE_LINES), _ALL)} END AS text) FROM code),
ln AS (SELECT doc_id, path, language, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM masked)"""


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


def _plain(pattern: str) -> str:
    """A rule for an engine without look-behind: the character before a name is matched instead."""
    return pattern.replace(r"(?<![\w.])", r"(?:^|[^\w.])")


def _any(found: dict[str, str], line: str = "code") -> str:
    return " UNION ALL ".join(f"SELECT path, line, {_sql(n)} AS rule FROM ln WHERE regexp_matches({line}, {_sql(_plain(p))})" for n, p in found.items())


ROLES = {f"{k}:{n}": p for k, table in (("source", rules.SOURCE_RULES), ("sink", rules.SINK_RULES), ("sanitizer", rules.SANITIZER_RULES)) for n, p in table.items()}


@query(f"WITH {MASKED} SELECT DISTINCT path, CAST(line AS INT) AS line, rule FROM ({_any(ROLES)})")
def masked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sources, sinks and sanitizers, comments and strings aside."""
    return masks.matches_outside(code_files(spark, sf_dir), ROLES).select("path", "line", "rule").distinct()


@query(f"WITH {MASKED} SELECT rule, count(*) AS hits, count(DISTINCT path) AS documents FROM (SELECT DISTINCT path, line, rule FROM ({_any(ROLES)})) GROUP BY rule")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a static baseline counts: lines and documents of each rule."""
    return masked_matches(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("hits"), F.count_distinct("path").alias("documents"))


@query(f"WITH {MASKED}, h AS ({_any(rules.SINK_RULES)}) SELECT path, path IN (SELECT path FROM h) AS detected FROM code")
def static_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with whether any sink stands in it."""
    docs = code_files(spark, sf_dir)
    hit = masks.matches_outside(docs, rules.SINK_RULES).select("path").distinct().withColumn("detected", F.lit(True))
    return docs.select("path").join(hit, "path", "left").select("path", F.coalesce("detected", F.lit(False)).alias("detected"))


@query(
    f"""WITH {CODE}, ln AS (SELECT doc_id, path, string_split(path, '::')[1] AS file, doc_id * 4 + generate_subscripts(string_split(text, chr(10)), 1) AS source_line, unnest(string_split(text, chr(10))) AS code FROM code),
h AS ({" UNION ALL ".join(f"SELECT path, file, source_line, code, {_sql(n)} AS rule FROM ln WHERE regexp_matches(code, {_sql(_plain(p))})" for n, p in rules.SCAN_RULES.items())})
SELECT concat_ws(':', 'repo', path, source_line, rule) AS candidate_id, path, CAST(source_line AS INT) AS source_line, rule, rule || ' ' || trim(code) AS query FROM (SELECT *, row_number() OVER (PARTITION BY file, source_line, rule ORDER BY path) AS r FROM h) WHERE r = 1"""
)
def scan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the line rules, one for each file, line and rule."""
    return rules.candidates(code_files(spark, sf_dir), rules.SCAN_RULES, "repo")


_KEEP = "CASE WHEN regexp_matches(coalesce(z[2], ''), '^[\"''`]') THEN z[2] ELSE " + _ALL + " END"


@query(f"WITH {CODE} SELECT doc_id, {_BLANK.format(_sql(masks.SLASH), _KEEP)} AS text FROM code WHERE language = 'javascript'")
def comments_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the // and /* */ family without their comments; lines and columns stay."""
    return code_files(spark, sf_dir).filter("language = 'javascript'").select("doc_id", masks.without_comments(F.col("text")).alias("text"))


_FACTS = {"principals": rules.PRINCIPAL, "resources": rules.RESOURCE, "actions": rules.SENSITIVE_ACTION, "guards": rules.GUARD}


@query(f"WITH {CODE} SELECT path, " + ", ".join(f"array_to_string(list_sort(list_distinct(regexp_extract_all(text, {_sql(p)}))), '|') AS {n}" for n, p in _FACTS.items()) + " FROM code")
def access_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who acts, on what, how, and under which guards: the distinct matches of each document."""
    return code_files(spark, sf_dir).select("path", *[F.array_join(rules.distinct_matches(F.col("text"), p), "|").alias(n) for n, p in _FACTS.items()])


@query(f"WITH {CODE}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS code FROM code) SELECT path, CAST(sum((CASE WHEN " + " OR ".join(f"regexp_matches(code, {_sql(_plain(p))})" for p in rules.SINK_RULES.values()) + " THEN 3 ELSE 0 END) + (CASE WHEN " + " OR ".join(f"regexp_matches(code, {_sql(p)})" for p in rules.SOURCE_RULES.values()) + " THEN 1 ELSE 0 END)) AS BIGINT) AS score FROM l GROUP BY path")
def security_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a document is sinks and sources: the security focus of its lines, summed."""
    return rules.lines(code_files(spark, sf_dir).select("path", "text")).groupBy("path").agg(F.sum(rules.security_focus(F.col("code")).cast("long")).alias("score"))


@query(f"WITH {CODE} SELECT path, regexp_extract(path, '::(.*)@', 1) AS symbol, CAST(regexp_extract(path, '@([0-9]+)-', 1) AS INT) AS first, CAST(regexp_extract(path, '-([0-9]+)$', 1) AS INT) AS last FROM code")
def location_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol and line bounds from a document's path."""
    bounds = T.line_bounds(F.col("path"))
    return code_files(spark, sf_dir).select("path", T.document_symbol(F.col("path")).alias("symbol"), bounds["first"].alias("first"), bounds["last"].alias("last"))


_URL = "CASE doc_id % 3 WHEN 0 THEN 'https://GitHub.com/' || source || '/R' || doc_id || '.git/' WHEN 1 THEN 'http://github.com/a/b' ELSE 'https://github.com/' || lang || '/' || source || '/' END"
_SHA = "CASE WHEN doc_id % 4 = 0 THEN 'https://github.com/a/b/commit/' || upper(md5(source) || 'abcdef01') || '#d' ELSE 'https://github.com/a/b/commit/abc' END"


@query(
    f"""WITH u AS (SELECT doc_id, {_URL} AS url, {_SHA} AS commit_url FROM documents)
SELECT doc_id, CASE WHEN starts_with(url, 'https://') THEN regexp_replace(regexp_replace(lower(substr(url, 9)), '/+$', ''), '\\.git$', '') END AS repo, CASE WHEN doc_id % 4 = 0 THEN lower(regexp_extract(commit_url, '/commit/([0-9a-fA-F]{{40}})', 1)) END AS sha FROM u"""
)
def repository_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository keys and commit hashes from addresses."""
    d = B.table(spark, sf_dir, "documents")
    url = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://GitHub.com/"), "source", F.lit("/R"), F.col("doc_id").cast("string"), F.lit(".git/"))).when(F.col("doc_id") % 3 == 1, "http://github.com/a/b").otherwise(F.concat(F.lit("https://github.com/"), "lang", F.lit("/"), "source", F.lit("/")))
    commit = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://github.com/a/b/commit/"), F.upper(F.concat(F.md5("source"), F.lit("abcdef01"))), F.lit("#d"))).otherwise("https://github.com/a/b/commit/abc")
    return d.select("doc_id", T.repository_key(url).alias("repo"), T.commit_sha(commit).alias("sha"))


_SUFFIX = "list_extract(['/__init__.py', '.py', '.YML', '.txt', '/.env.example'], CAST(doc_id % 5 AS INT) + 1)"


@query(
    f"""WITH p AS (SELECT doc_id, 'src/' || source || '/' || lang || {_SUFFIX} AS path FROM documents)
SELECT path, replace(regexp_replace(regexp_replace(path, '(/__init__)?\\.py$', ''), '^src/', ''), '/', '.') AS module, count(*) AS n, CAST(bool_or(list_contains(['py', 'yml'], lower(split_part(path, '.', -1))) OR ends_with(path, '.env.example')) AS BOOLEAN) AS supported FROM p WHERE path IS NOT NULL GROUP BY path"""
)
def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of paths, and whether their suffix is taken as a source."""
    suffix = F.get(F.array(*[F.lit(x) for x in ("/__init__.py", ".py", ".YML", ".txt", "/.env.example")]), (F.col("doc_id") % 5).cast("int"))
    paths = B.table(spark, sf_dir, "documents").select(F.concat(F.lit("src/"), "source", F.lit("/"), "lang", suffix).alias("path")).filter("path is not null")
    return paths.groupBy("path").agg(F.count("*").alias("n")).select("path", T.module_name(F.col("path")).alias("module"), "n", T.supported_path(F.col("path")).alias("supported"))


@query("""WITH s AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN replace(substr(text, 5, 30), ' ', chr(10) || '  ') WHEN 1 THEN '  ' ELSE 'no such words here ' || doc_id END AS snippet FROM documents),
c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, trim(regexp_replace(snippet, '\\s+', ' ', 'g')) AS s FROM s) SELECT doc_id, s <> '' AND contains(t, s) AS found FROM c""")
def snippet_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a snippet stands in a text, white space aside."""
    k = F.col("doc_id") % 3
    snippet = F.when(k == 0, F.replace(F.substring("text", 5, 30), F.lit(" "), F.lit("\n  "))).when(k == 1, "  ").otherwise(F.concat(F.lit("no such words here "), F.col("doc_id").cast("string")))
    return B.table(spark, sf_dir, "documents").select("doc_id", T.normalized_contains(F.col("text"), snippet).alias("found"))


@query("""WITH p AS (SELECT doc_id, n_chars % 4 AS k FROM documents) SELECT doc_id, CASE WHEN k <> 3 THEN '< ' || doc_id || '.0' END AS affected, CASE WHEN k IN (0, 1) THEN 'v' || k END AS patched FROM p""")
def advisory_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected and patched versions of advisory pages."""
    d, k = B.table(spark, sf_dir, "documents"), F.col("n_chars") % 4
    body = F.concat(F.lit("<h2>Affected  versions</h2>\n<b>&lt; "), F.col("doc_id").cast("string"), F.lit(".0</b>"))
    page = F.when(k == 3, "<p>no versions</p>").otherwise(F.concat(F.regexp_replace(body, "  ", " "), F.lit(" <h2>PATCHED versions</h2> "), F.when(k == 2, "").otherwise(F.concat(F.lit("<i>v"), k.cast("string"), F.lit("</i> "))), F.lit("<h2>Description</h2>")))
    return d.select("doc_id", T.advisory_versions(page).alias("v")).select("doc_id", "v.affected", "v.patched")


_REPLY = """CASE n_chars % 5 WHEN 0 THEN '{"label": "SAFE", "n": ' || doc_id || '}' WHEN 1 THEN ' ```json' || chr(10) || '{"label": "VULNERABLE"}' || chr(10) || '``` ' WHEN 2 THEN 'So: {"label": "SAFE"}' WHEN 3 THEN '```' || chr(10) || '{"label": ' || chr(10) || '```' ELSE NULL END"""


@query("SELECT doc_id, CASE n_chars % 5 WHEN 0 THEN 'SAFE' WHEN 1 THEN 'VULNERABLE' END AS label, n_chars % 5 IN (0, 1) AS accepted FROM documents")
def final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of replies: bare JSON or one fenced block counts, prose and broken JSON don't."""
    reply = F.expr(_REPLY.replace("chr(10)", "'\\n'"))
    rows = B.table(spark, sf_dir, "documents").select("doc_id", T.final_json(reply).alias("j"))
    return rows.select("doc_id", F.get_json_object("j", "$.label").alias("label"), F.col("j").isNotNull().alias("accepted"))


_ARGS = """CASE doc_id % 4 WHEN 0 THEN '"a,b" + x' || doc_id || ', y, z' WHEN 1 THEN 'only' WHEN 2 THEN '''it\\'',s'', "q"' ELSE ' first , second' END"""


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '\"a,b\" + x' || doc_id WHEN 2 THEN '''it\\'',s''' WHEN 3 THEN 'first' END AS first, CASE doc_id % 4 WHEN 0 THEN 'y, z' WHEN 2 THEN '\"q\"' WHEN 3 THEN 'second' END AS rest FROM documents")
def first_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first argument of a call and the rest, commas in quotes aside."""
    d, k = B.table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    args = F.when(k == 0, F.concat(F.lit('"a,b" + x'), F.col("doc_id").cast("string"), F.lit(", y, z"))).when(k == 1, "only").when(k == 2, "'it\\',s', \"q\"").otherwise(" first , second")
    return d.select("doc_id", T.first_argument(args).alias("a")).select("doc_id", "a.first", "a.rest")


@query("""WITH d AS (SELECT DISTINCT 'm' || n_regionkey || '.' || n_name AS definition, n_name AS final FROM nation), s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'pkg.mod.' || n_name ELSE 'm' || (n_regionkey + 1) || '.' || n_name END AS symbol FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, symbol, definition FROM s JOIN d ON split_part(symbol, '.', -1) = final""")
def symbol_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that a symbol can mean: the same last part, whatever stands before."""
    n, s = B.table(spark, sf_dir, "nation"), B.table(spark, sf_dir, "supplier")
    defines = n.select(F.concat(F.lit("m"), F.col("n_regionkey").cast("string"), F.lit("."), "n_name").alias("definition"))
    other = F.concat(F.lit("m"), (F.col("n_regionkey") + 1).cast("string"), F.lit("."), "n_name")
    symbols = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("pkg.mod."), "n_name")).otherwise(other).alias("symbol"))
    final = lambda c: F.substring_index(c, ".", -1)
    return symbols.join(defines, final("symbol") == final("definition")).select("s_suppkey", "symbol", "definition")


@query(f"WITH {CODE} SELECT path FROM code WHERE len(list_filter(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_.]*)\\(', 1), lambda c: contains(c, 'exec'))) > 0")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that call something with a symbol in its name."""
    calls = F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\("), F.lit(1))
    return code_files(spark, sf_dir).filter(F.exists(calls, lambda c: F.contains(c, F.lit("exec")))).select("path")


@query("SELECT * EXCLUDE (place) FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS place FROM documents) WHERE place = 1")
def first_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each language and source."""
    return accept.first_of(B.table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id").select("lang", "source", "doc_id")


@query("WITH c AS (SELECT doc_id AS position, unnest([1, 2, 3]) AS variant FROM labels) SELECT position, variant, row_number() OVER (PARTITION BY position ORDER BY CASE WHEN position % 2 = 0 THEN variant ELSE -variant END) AS slot FROM c")
def interleaved_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of each labelled document, their order turned around at each second one."""
    cells = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("position"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("variant"))
    return accept.interleaved(cells, "position", "variant")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY NOT contains(text, 'the'), doc_id) AS rank FROM documents")
def helpers_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents, those with a helper's mark first, else in their order."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("source").orderBy(F.desc_nulls_last(F.contains("text", F.lit("the"))), "doc_id")
    return B.table(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(order).alias("rank"))


@query("SELECT conv_id, turn, CAST(40 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn)) // count(*) OVER (PARTITION BY conv_id) AS BIGINT) AS ceiling FROM conversations")
def observation_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many observations a conversation may have made by the end of each task, of 40 in all."""
    from pyspark.sql.window import Window

    all_ = Window.partitionBy("conv_id")
    done = F.row_number().over(all_.orderBy("turn"))
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(40 * done / F.count("*").over(all_)).alias("ceiling"))


@query("""WITH o AS (SELECT lang AS system, CASE doc_id % 3 WHEN 0 THEN 'candidate_file' WHEN 1 THEN 'other_benchmark_case' ELSE 'shared_helper_or_framework' END AS origin FROM documents)
SELECT system, count(*) FILTER (origin = 'candidate_file') AS candidate_file, count(*) FILTER (origin = 'other_benchmark_case') AS other_benchmark_case, count(*) FILTER (origin = 'shared_helper_or_framework') AS shared_helper_or_framework FROM o GROUP BY system""")
def sink_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the evidence of sinks lies, counted by system."""
    d, k = B.table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    own = F.concat(F.lit("src/Case"), F.col("doc_id").cast("string"), F.lit(".java"))
    evidence = F.concat(F.lit("sink:"), F.when(k == 0, own).when(k == 1, "src/Case_other.java").otherwise("src/util/Helper.java"), F.lit("::m@1-2"))
    rows = d.select(F.col("lang").alias("system"), T.evidence_origin(evidence, F.concat(own, F.lit("::n@3-9")), "Case").alias("origin"))
    return rows.groupBy("system").pivot("origin", ["candidate_file", "other_benchmark_case", "shared_helper_or_framework"]).agg(F.count(F.lit(1))).na.fill(0)


_CELLS = """cells AS (SELECT r.case_id, r.system, r.status, r.predicted_label, r.ground_truth, r.model_calls, d.lang AS category FROM res r JOIN documents d ON r.case_id = d.doc_id),
twice AS (SELECT * FROM cells UNION ALL SELECT * FROM cells WHERE case_id % 7 = 0),
one AS (SELECT case_id, system, CASE WHEN count(*) > 1 THEN 'failed' ELSE min(status) END AS status, CASE WHEN count(*) = 1 THEN min(predicted_label) END AS predicted_label, min(ground_truth) AS ground_truth, min(category) AS category, sum(model_calls) AS model_calls FROM twice GROUP BY case_id, system)"""


@query(f"WITH {RES}, {_CELLS} SELECT category, system, CAST(grouping(category) AS INT) AS overall, count(*) AS cells, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (predicted_label = ground_truth) AS right, CAST(sum(model_calls) AS BIGINT) AS model_calls FROM one GROUP BY GROUPING SETS ((system), (category, system))")
def heldout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by system and by category and system; a cell with several rows is one failed cell with their costs."""
    d = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("category"))
    cells = B.results(spark, sf_dir).join(d, "case_id")
    one = accept.collapsed_cells(cells.union(cells.filter("case_id % 7 = 0")))
    right = F.count_if(F.col("predicted_label") == F.col("ground_truth"))
    out = one.groupingSets([["system"], ["category", "system"]], "category", "system").agg(F.grouping("category").cast("int").alias("overall"), F.count("*").alias("cells"), F.count_if(F.col("status") == "failed").alias("failed"), right.alias("right"), F.sum("model_calls").cast("long").alias("model_calls"))
    return out.select("category", "system", "overall", "cells", "failed", "right", "model_calls")


@query("""WITH h AS (SELECT lang AS mode, source AS repo, n_chars % 2 = 0 AS cross_file, doc_id, n_chars % 3 = 0 AS hit FROM documents)
SELECT mode, repo, CAST(cross_file AS BOOLEAN) AS cross_file, count(*) AS n, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit)::DOUBLE / count(*), 9) AS rate, coalesce(array_to_string(list_sort(list(doc_id) FILTER (NOT hit)), ','), '') AS missed FROM h GROUP BY GROUPING SETS ((mode), (mode, cross_file), (mode, repo))""")
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, rates and missed cases of each mode: over all, across files or not, and by repository."""
    d = B.table(spark, sf_dir, "documents")
    rows = d.select(F.col("lang").alias("mode"), F.col("source").alias("repo"), (F.col("n_chars") % 2 == 0).alias("cross_file"), "doc_id", (F.col("n_chars") % 3 == 0).alias("hit"))
    return metrics.hit_summary(rows, "mode", ["cross_file", "repo"], "doc_id")


@query("""WITH s AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT status, CASE WHEN status = 'F' THEN n + 1 ELSE n END AS n FROM s WHERE status <> 'P')
SELECT status, n, 'recomputed' AS side FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM p) UNION ALL SELECT status, n, 'published' FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM s)""")
def summary_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which a published summary and the one recomputed from its entries differ."""
    fresh = B.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    published = fresh.filter("status <> 'P'").select("status", F.when(F.col("status") == "F", F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    return accept.symmetric_difference(fresh, published).select("status", "n", F.when(F.col("side") == "left", "recomputed").otherwise("published").alias("side"))


_ERRORS = ["KeyboardInterrupt", "BudgetExceeded", "BudgetStopped", "ValueError"]


@query(f"""WITH e AS (SELECT event_id, list_extract({_list(_ERRORS)}, CAST(event_id % 7 AS INT) + 1) AS error, event_id % 2 AS calls, CASE WHEN event_id % 3 = 0 THEN 'ABSTAIN' ELSE 'SAFE' END AS label FROM events)
SELECT event_id, CASE WHEN error = 'KeyboardInterrupt' THEN 'interrupted' WHEN error LIKE 'Budget%' AND calls = 0 THEN 'not_run' WHEN error = 'BudgetStopped' THEN 'interrupted' WHEN error IS NOT NULL THEN 'failed' WHEN label = 'ABSTAIN' THEN 'abstained' ELSE 'completed' END AS status FROM e""")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How runs ended, by error, calls and label."""
    e = B.table(spark, sf_dir, "events")
    error = F.get(F.array(*[F.lit(x) for x in _ERRORS]), (F.col("event_id") % 7).cast("int"))
    return e.select("event_id", accept.run_outcome(error, F.col("event_id") % 2, F.when(F.col("event_id") % 3 == 0, "ABSTAIN").otherwise("SAFE")).alias("status"))


@query("""SELECT doc_id AS entry_id, source AS repo, CAST(NULL AS VARCHAR) AS issue FROM documents WHERE source IS NULL OR source NOT IN ('src0', 'src3') UNION ALL SELECT doc_id + 10000000, NULL, 'label_without_input' FROM labels WHERE doc_id % 10 = 0""")
def repository_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of repositories that are not excluded; labels that no entry has are issues."""
    strange = B.table(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 10_000_000).otherwise(0)).alias("entry_id"))
    return accept.repository_split(B.entries(spark, sf_dir).select("entry_id", "repo"), strange, spark.createDataFrame([("src0",), ("src3",)], "repo string"))


@query("""WITH t AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS registered FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(list_filter(['1-URGENT', '3-MEDIUM', '9-NONE'], lambda x: list_contains(registered, x)), ',') AS allowed FROM t""")
def allowed_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what a role may use, what is registered, in the role's order."""
    have = B.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("registered"))
    return have.select("o_custkey", F.array_join(F.array_intersect(F.array(F.lit("1-URGENT"), F.lit("3-MEDIUM"), F.lit("9-NONE")), F.col("registered")), ",").alias("allowed"))


@query("SELECT l_orderkey, l_suppkey % 3 AS tool FROM lineitem EXCEPT ALL SELECT l_orderkey, l_suppkey % 3 FROM lineitem WHERE l_quantity >= 10")
def validator_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required validator calls that were not made, each as often as it is missing."""
    li = B.table(spark, sf_dir, "lineitem")
    need = lambda df: df.select("l_orderkey", (F.col("l_suppkey") % 3).alias("tool"))
    return need(li).exceptAll(need(li.filter("l_quantity >= 10")))


@query("""WITH a AS (SELECT o_custkey % 50 AS cell, o_orderstatus AS kind FROM orders), b AS (SELECT o_custkey % 50 AS cell, o_orderstatus AS kind FROM orders WHERE o_orderkey % 20 <> 0 UNION ALL SELECT 99, 'X' FROM region)
SELECT cell, kind, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT cell, kind, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def cell_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a run and its plan do not hold equally often."""
    cell = lambda df: df.select((F.col("o_custkey") % 50).alias("cell"), F.col("o_orderstatus").alias("kind"))
    o = B.table(spark, sf_dir, "orders")
    made = cell(o.filter("o_orderkey % 20 <> 0")).union(B.table(spark, sf_dir, "region").select(F.lit(99).cast("long"), F.lit("X")))
    return accept.symmetric_difference(cell(o), made)


@query("""WITH u AS (SELECT user_id, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (event_type = 'view') AS b, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (event_type = 'click') AS c FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN b <> 0 THEN round((b - c)::DOUBLE / b, 9) END AS reduction, CASE WHEN user_id % 2 = 0 THEN 'VULNERABLE' ELSE 'SAFE' END AS truth FROM u""")
def usage_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relative reduction of a user's tokens between two kinds of events, and the truth of its revision."""
    tokens = F.get_json_object("props", "$.k").cast("long")
    u = B.table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "view", tokens)).alias("b"), F.sum(F.when(F.col("event_type") == "click", tokens)).alias("c"))
    role = F.when(F.col("user_id") % 2 == 0, "vulnerable").otherwise("fixed")
    return u.select("user_id", F.round(T.relative_reduction(F.col("b"), F.col("c")), 9).alias("reduction"), F.when(role == "vulnerable", "VULNERABLE").otherwise("SAFE").alias("truth"))


@query(f"WITH {CODE}, d AS (SELECT DISTINCT string_split(path, '::')[1] AS file FROM code) SELECT file, contains('see a.py and src1.py or utils.py', file) AS mentioned FROM d WHERE file IS NOT NULL")
def scope_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that an advisory's scope names."""
    files = code_files(spark, sf_dir).select(F.substring_index("path", "::", 1).alias("file")).distinct().filter("file is not null")
    return files.select("file", T.mentions(F.lit("see a.py and src1.py or utils.py"), F.col("file")).alias("mentioned"))


@query("""WITH c AS (SELECT DISTINCT source AS file, n_chars % 40 AS line FROM documents WHERE doc_id % 2 = 0) SELECT d.doc_id, EXISTS (SELECT 1 FROM c WHERE c.file = d.source AND c.line = d.n_chars % 41) AS covered FROM documents d JOIN labels USING (doc_id)""")
def reference_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References at whose file and line the scanner has a candidate."""
    d = B.table(spark, sf_dir, "documents")
    candidates = d.filter("doc_id % 2 = 0").select(F.col("source").alias("file"), (F.col("n_chars") % 40).alias("line"), F.lit(True).alias("hit")).distinct()
    wanted = d.join(B.table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", F.col("source").alias("file"), (F.col("n_chars") % 41).alias("line"))
    return wanted.join(candidates, ["file", "line"], "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("covered"))


@query("""WITH b AS (SELECT doc_id, text, strlen(text) AS size FROM documents) SELECT doc_id, size > 100 AS cut, least(size, 100) - (CASE WHEN size > 100 THEN 100 - strlen(array_to_string(list_filter(list_transform(range(1, 101), lambda i: CASE WHEN strlen(substr(text, 1, i)) <= 100 THEN substr(text, i, 1) ELSE '' END), lambda x: true), '')) ELSE 0 END) AS kept FROM b""")
def bounded_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under a budget of 100 bytes, cut between characters."""
    text = F.col("text")
    return B.table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) > 100).alias("cut"), F.octet_length(T.bounded_bytes(text, F.lit(100))).cast("long").alias("kept"))


_WORDS = r"[\p{L}\p{N}_\p{M}]+|[^\p{L}\p{N}_\p{M}\s]"
_ASK = "password token license error the der"


@query(
    f"""WITH RECURSIVE l0 AS (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS l FROM documents), l1 AS (SELECT *, len(l) AS n, list_transform(l, lambda x: len(regexp_extract_all(x, {_sql(_WORDS)}))) AS c, least(doc_id % 5, len(l) - 1) AS near FROM l0 WHERE len(l) > 0),
u AS (SELECT doc_id, near, unnest(range(0, n)) AS i, unnest(l) AS line FROM l1),
ln AS (SELECT doc_id, near, i, len(list_filter({_list(_ASK.split())}, lambda q: list_contains(list_transform(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]{{1,}}'), lambda t: lower(t)), q))) AS q FROM u),
best AS (SELECT doc_id, arg_max(i, {{'q': q, 'd': -abs(i - near), 'i': i}}) AS i, max(q) AS q FROM ln GROUP BY doc_id),
a AS (SELECT doc_id, n, list_concat([0], list_transform(range(1, n + 1), lambda k: CAST(list_sum(list_slice(c, 1, k)) AS BIGINT))) AS cum, CASE WHEN best.q > 0 THEN best.i ELSE near END AS center FROM l1 JOIN best USING (doc_id)),
g AS (SELECT doc_id, n, cum, center, CASE WHEN cum[n + 1] <= 60 THEN 0 ELSE center END AS s, CASE WHEN cum[n + 1] <= 60 THEN n ELSE center + 1 END AS e, cum[n + 1] > 60 AND cum[center + 2] - cum[center + 1] < 60 AS more FROM a
  UNION ALL SELECT doc_id, n, cum, center, s2, CASE WHEN e < n AND cum[e + 2] - cum[s2 + 1] <= 60 THEN e + 1 ELSE e END, true FROM (SELECT *, CASE WHEN s > 0 AND cum[e + 1] - cum[s] <= 60 THEN s - 1 ELSE s END AS s2 FROM g WHERE more) WHERE s2 <> s OR (e < n AND cum[e + 2] - cum[s2 + 1] <= 60)),
w AS (SELECT doc_id, max(center) AS center, min(s) AS first, max(e) AS last, any_value(cum) AS cum FROM g GROUP BY doc_id)
SELECT doc_id, CAST(center AS INT) AS center, CAST(first AS INT) AS first, CAST(last AS INT) AS last, CAST(least(cum[last + 1] - cum[first + 1], 60) AS INT) AS n_tokens FROM w"""
)
def focused_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that best fit a question, within 60 tokens."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    return context.focused(docs, 60, F.lit(_ASK), (F.col("doc_id") % 5 + 1).cast("int")).select("doc_id", "center", "first", "last", "n_tokens")


#: Python lines and the rules that they fall under, by what their module imports.
PY_HEAD = "import subprocess as sp\nfrom os import system as run\nimport sys, os\n"
PY_LINES = {
    "sp.run(cmd)": "command-execution",
    "run(cmd)": "command-execution",
    "# eval(x)": "",
    "x = eval(body)": "dynamic-evaluation",
    "getattr(obj, name)": "dynamic-attribute-access",
    "getattr(obj, 'name')": "",
    "cur.execute(q)": "database-operation",
    "page.render(ctx)": "template-operation",
    "sys.exit(1)": "process-control",
    "os.chmod(p, 0o777)": "permission-mode",
    "label = 'eval(x)'": "",
    "formatters[kind](x)": "template-operation",
    "y = eval(render(cur.execute(q)))": "database-operation,dynamic-evaluation",
}
_PY_AT = f"CAST((doc_id * (k + 2) + n_chars + k) % {len(PY_LINES)} AS INT) + 1"


@query(
    f"""WITH l AS (SELECT doc_id, source, k, {_PY_AT} AS place FROM documents, (SELECT unnest(range(0, 6)) AS k)), c AS (SELECT doc_id, source, k + 4 AS line, list_extract({_list([*PY_LINES])}, place) AS code, unnest(string_split(list_extract({_list([*PY_LINES.values()])}, place), ',')) AS rule FROM l)
SELECT concat_ws(':', 'repo', path, line, rule) AS candidate_id, path, CAST(line AS INT) AS source_line, rule, rule || ' ' || code AS query FROM (SELECT *, 'm' || doc_id || '.py::<module>@1-9' AS path FROM c WHERE rule <> '')"""
)
def python_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each document, scanned by its syntax tree."""
    codes = F.array(*[F.lit(x) for x in PY_LINES])
    body = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.get(codes, ((F.col("doc_id") * (k + 2) + F.col("n_chars") + k) % len(PY_LINES)).cast("int")))
    files = B.numbers(spark, sf_dir).select(F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.encode(F.concat(F.lit(PY_HEAD), F.array_join(body, "\n")), "UTF-8").alias("content"))
    docs = stage_facts(python_documents(files).filter("error is null"), "documents")
    return rules.candidates_of(scanned(docs), docs, "repo")
