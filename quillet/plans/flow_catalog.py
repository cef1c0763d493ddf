"""Queries of taint and guards over Python code derived from documents, with their DuckDB twins.

Each document gives a file of two functions whose statements are chosen by its id and size; the twins know the control
flow of that form and walk it statement by statement with recursive SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.python_code import python_documents, scanned
from ..functions.python_facts import python_facts
from ..operators import authorization, budgets, context, experts, flow, graph, identity, receivers, rules, slices, votes
from ..sources.staging import stage_facts as stage
from . import bindings as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Files that calls go to.
CALLED = 200
#: Values, the names that they are made from (empty: a source), and the categories that they are safe for.
NUMERIC = ["command-execution", "code-execution", "sql"]
VALUES = {"x": ["x"], "y": ["y"], "a": ["a"], "b": ["b"], "'k'": [], "request.args.get('q')": [""], "int(x)": ["x"], "shlex.quote(y)": ["y"], "x + b": ["x", "b"], "make(y, a)": ["y", "a"]}
STEP_VALUES = {"p": ["p"], "'k'": [], "int(p)": ["p"], "p + k": ["p", "k"], "shlex.quote(k)": ["k"], "k": ["k"]}
SAFE = {"int": NUMERIC, "shlex": ["command-execution"]}
HANDLE = """def handle_{d}(a, b):
    x = {1}
    y = {2}
    if a:
        x = {3}
    else:
        y = {4}
    while y:
        x = {5}
        if b:
            break
        y = {6}
    try:
        y = {7}
    except ValueError:
        x = {8}
    os.system({9})
    cursor.execute({10})
    step_{t}({11}, k={12})

def step_{d}(p, k):
    q = {0}
    eval(q)
    open(k)
    step_{u}(q, k)
"""
GUARDED = """@app.get('/r')
def route_{d}(request):
    {0}
    svc_{t}(request)
    {1}

def svc_{d}(r):
    {2}
    svc_{u}(r)
    {3}
"""
FIRST, LAST = ["pass", "check_permission(r)", "delete(r)", "log(r)"], ["update(r)", "pass", "write(r)"]


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


def _filled(form: str, values: dict[str, Column]) -> Column:
    """A form with its {names} replaced, as one concatenation."""
    out, rest = [], form
    while (at := rest.find("{")) >= 0:
        name, _, after = rest[at + 1 :].partition("}")
        out += [F.lit(rest[:at]), values[name]]
        rest = after
    return F.concat(*out, F.lit(rest))


def _pick(items: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in items]), at.cast("int"))


def _targets() -> dict[str, Column]:
    text = lambda c: c.cast("string")
    d, n = F.col("doc_id"), F.col("n_chars")
    return {"d": text(d), "t": text((d * 7 + n) % CALLED), "u": text((d * 3 + 1) % CALLED)}


def handler_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file m<id>.py for each document."""
    d, n = F.col("doc_id"), F.col("n_chars")
    values = _targets() | {str(j): _pick([*VALUES], (d * (2 * j + 3) + n * (j % 3 + 1) + j * j) % len(VALUES)) for j in range(1, 13)} | {"0": _pick([*STEP_VALUES], (d + n) % len(STEP_VALUES))}
    return B.numbers(spark, sf_dir).select(F.concat(F.lit("m"), values["d"], F.lit(".py")).alias("path"), F.encode(_filled(HANDLE, values), "UTF-8").alias("content"))


def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file g<id>.py for each document."""
    d, n = F.col("doc_id"), F.col("n_chars")
    values = _targets() | {"0": _pick(FIRST, (d + n) % 4), "1": _pick(LAST, (d + n) % 3), "2": _pick(FIRST, (d * 3 + n) % 4), "3": _pick(LAST, (d * 5 + n) % 3)}
    return B.numbers(spark, sf_dir).select(F.concat(F.lit("g"), values["d"], F.lit(".py")).alias("path"), F.encode(_filled(GUARDED, values), "UTF-8").alias("content"))


def functions_of(files: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of the functions of some files, with all or some columns, their call graph, and what they define; the parse is staged."""
    docs = python_documents(files, columns).filter("error is null and symbol <> '<module>'")
    docs = stage(docs.select(*dict.fromkeys(["path", "symbol", "calls", "defines", *columns])) if columns else docs, "functions")
    each = lambda c: docs.select("path", F.explode(c).alias("symbol"))
    return docs, stage(graph.build_edges(each("calls"), each("defines")), "edges"), each("defines")


def _rows(name: str, columns: str, rows: list[tuple]) -> str:
    said = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {said})"


def _alternatives(name: str, values: dict[str, list[str]]) -> list[str]:
    """Tables of what each value is made from, by category that it stays dangerous for (raw: whatever is cleaned)."""
    cats = [*flow.CATEGORIES, "raw"]
    safe = lambda v: next((c for k, c in SAFE.items() if v.startswith(k)), [])
    return [_rows(name, "i, src, cat", [(i, s, c) for i, (v, srcs) in enumerate(values.items()) for s in srcs for c in cats if c not in safe(v)])]


#: Control flow of the handler: which statement follows which, and which assigns what.
NEXT = [(1, 2), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6), (6, 7), (6, 11), (7, 8), (8, 9), (8, 10), (9, 11), (10, 6), (11, 13), (12, 13), (13, 14), (14, 15)]
ASSIGNS = [(1, 1, "x"), (2, 2, "y"), (4, 3, "x"), (5, 4, "y"), (7, 5, "x"), (10, 6, "y"), (11, 7, "y"), (12, 8, "x")]
TWIN = f"""WITH RECURSIVE {", ".join([*_alternatives("alt", VALUES), *_alternatives("salt", STEP_VALUES), _rows("nx", "pt, n", NEXT), _rows("asg", "pt, j, dst", ASSIGNS), _rows("vars", "v", [("x",), ("y",), ("a",), ("b",)]), _rows("cats", "cat", [(c,) for c in [*flow.CATEGORIES, "raw"]])])},
j AS (SELECT doc_id, j, CAST((doc_id * (2 * j + 3) + n_chars * (j % 3 + 1) + j * j) % {len(VALUES)} AS INT) AS i FROM documents, (SELECT unnest(range(1, 13)) AS j)),
may AS (SELECT doc_id FROM j WHERE j = 7 AND i <> {[*VALUES].index("'k'")}),
mv AS (SELECT doc_id, pt, src, dst, cat FROM j JOIN asg USING (j) JOIN alt USING (i) WHERE pt <> 12 OR doc_id IN (SELECT doc_id FROM may)),
tr AS (SELECT doc_id, pt, v, cat, n, v AS w FROM documents, nx, vars, cats WHERE NOT EXISTS (FROM asg WHERE asg.pt = nx.pt AND dst = v)
  UNION SELECT doc_id, pt, src, cat, n, dst FROM mv JOIN nx USING (pt) WHERE src <> ''
  UNION SELECT doc_id, 11, v, cat, 12, v FROM may, vars, cats),
st AS (SELECT doc_id, 1 AS pt, v, cat, v AS entry FROM documents, vars, cats WHERE v IN ('a', 'b')
  UNION SELECT doc_id, n, dst, cat, '' FROM mv JOIN nx USING (pt) WHERE src = ''
  UNION SELECT st.doc_id, n, w, st.cat, entry FROM st JOIN tr USING (doc_id, pt, v, cat)),
arg AS (SELECT DISTINCT j.doc_id, j, alt.cat, entry FROM j JOIN alt USING (i) JOIN st ON st.doc_id = j.doc_id AND st.v = src AND st.cat = alt.cat AND st.pt = CASE j WHEN 9 THEN 13 WHEN 10 THEN 14 ELSE 15 END WHERE j > 8
  UNION SELECT doc_id, j, cat, '' FROM j JOIN alt USING (i) WHERE j > 8 AND src = ''),
step AS (SELECT doc_id, src, cat FROM documents JOIN salt ON i = (doc_id + n_chars) % {len(STEP_VALUES)}),
hit AS (SELECT 'm' || doc_id || '.py::handle_' || doc_id || '@1-19' AS path, doc_id, CASE j WHEN 9 THEN 17 ELSE 18 END AS line, CASE j WHEN 9 THEN 'os.system' ELSE 'cursor.execute' END AS symbol, CASE j WHEN 9 THEN 'command-execution' ELSE 'sql' END AS category, entry, cat FROM arg WHERE j < 11
  UNION ALL SELECT 'm' || doc_id || '.py::step_' || doc_id || '@21-25', doc_id, 23, 'eval', 'code-execution', src, cat FROM step
  UNION ALL SELECT 'm' || doc_id || '.py::step_' || doc_id || '@21-25', doc_id, 24, 'open', 'path-access', 'k', cat FROM documents, cats)"""


@query(f"{TWIN} SELECT path, CAST(line AS INT) AS line, symbol, category, entry, NOT bool_or(cat = category) AS cleaned FROM hit GROUP BY ALL")
def python_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks that a function's sources or parameters reach over branches, loops, handlers and re-assignments."""
    docs = python_facts(handler_files(spark, sf_dir), ["symbol", "error", *flow.FACTS]).filter("error is null and symbol <> '<module>'")
    return stage(flow.tainted_sinks(stage(docs.select(*flow.FACTS), "functions")), "sinks")


@query(
    f"""{TWIN}, tg AS (SELECT doc_id, (doc_id * 7 + n_chars) % {CALLED} AS t, (doc_id * 3 + 1) % {CALLED} AS u FROM documents),
w AS (SELECT doc_id AS start, t AS doc_id, CASE j WHEN 11 THEN 'p' ELSE 'k' END AS param, cat, 1 AS hops, 'm' || doc_id || '.py::handle_' || doc_id || '@1-19 > m' || t || '.py::step_' || t || '@21-25' AS trace FROM arg JOIN tg USING (doc_id) WHERE j > 10 AND t IN (SELECT doc_id FROM documents)
  UNION SELECT start, u, m.dst, w.cat, hops + 1, trace || ' > m' || u || '.py::step_' || u || '@21-25' FROM w JOIN tg USING (doc_id) JOIN (SELECT doc_id, src, 'p' AS dst, cat FROM step UNION ALL SELECT doc_id, 'k', 'k', cat FROM documents, cats) m ON m.doc_id = w.doc_id AND m.src = w.param AND m.cat = w.cat
    WHERE hops < 3 AND u <> w.doc_id AND u IN (SELECT doc_id FROM documents)),
found AS (SELECT doc_id AS start, category, 0 AS hops, path AS trace, line, symbol FROM hit WHERE cat = category AND line < 20
  UNION ALL SELECT w.start, category, hops, trace, line, symbol FROM w JOIN hit ON hit.doc_id = w.doc_id AND hit.entry = w.param AND hit.cat = w.cat AND hit.cat = category AND line > 20)
SELECT 'm' || start || '.py::handle_' || start || '@1-19' AS start, category, CAST(hops AS INT) AS hops, trace, CAST(line AS INT) AS line, symbol FROM (SELECT *, row_number() OVER (PARTITION BY start, category ORDER BY hops, trace, line, symbol) AS r FROM found) WHERE r = 1"""
)
def taint_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each handler the first way of calls, three at most, on which taint reaches a sink of each category."""
    docs, edges, defines = functions_of(handler_files(spark, sf_dir), flow.FACTS)
    starts = docs.filter("symbol like 'handle%'").select("path", F.explode("params").alias("entry"))
    return stage(flow.traces(docs, edges, defines, starts, 3), "traces")


_SENSITIVE = "('delete(r)', 'update(r)', 'write(r)')"
_AT = "list_extract({0}, CAST({1} AS INT) + 1)"
_LIST = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, (doc_id * 7 + n_chars) % {CALLED} AS t, (doc_id * 3 + 1) % {CALLED} AS u, {_AT.format(_LIST(FIRST), "(doc_id + n_chars) % 4")} AS g1, {_AT.format(_LIST(LAST), "(doc_id + n_chars) % 3")} AS g2,
  {_AT.format(_LIST(FIRST), "(doc_id * 3 + n_chars) % 4")} AS s1, {_AT.format(_LIST(LAST), "(doc_id * 5 + n_chars) % 3")} AS s2 FROM documents),
w AS (SELECT doc_id AS route, t AS place, 1 AS hops, g1 <> 'check_permission(r)' AS bare FROM d WHERE t IN (SELECT doc_id FROM d)
  UNION ALL SELECT route, u, hops + 1, bare AND s1 <> 'check_permission(r)' FROM w JOIN d ON d.doc_id = w.place WHERE hops < 3 AND u <> w.place AND u IN (SELECT doc_id FROM d)),
reach AS (SELECT route, place, bool_or(bare) AS bare FROM w GROUP BY ALL),
act AS (SELECT doc_id, true AS is_route, 3 AS line, g1 AS code, g1 = 'check_permission(r)' AS covered FROM d UNION ALL SELECT doc_id, true, 5, g2, g1 = 'check_permission(r)' FROM d
  UNION ALL SELECT doc_id, false, 2, s1, s1 = 'check_permission(r)' FROM d UNION ALL SELECT doc_id, false, 4, s2, s1 = 'check_permission(r)' FROM d),
a AS (SELECT * FROM act WHERE code IN {_SENSITIVE})
SELECT 'g' || doc_id || '.py::route_' || doc_id || '@1-5' AS route, 'g' || doc_id || '.py::route_' || doc_id || '@1-5' AS path, CAST(line AS INT) AS line, CASE WHEN covered THEN 'guarded' ELSE 'unguarded' END AS status FROM a WHERE is_route
UNION ALL SELECT 'g' || route || '.py::route_' || route || '@1-5', 'g' || doc_id || '.py::svc_' || doc_id || '@7-10', CAST(line AS INT), CASE WHEN route IS NULL THEN 'unreached' WHEN bare AND NOT covered THEN 'unguarded' ELSE 'guarded' END FROM a LEFT JOIN reach ON place = doc_id WHERE NOT is_route"""
)
def guard_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive actions that each route reaches by three calls at most, and whether every way to them meets a guard."""
    docs, edges, defines = functions_of(route_files(spark, sf_dir))
    return stage(authorization.guard_comparison(docs, edges, defines, 3), "guards")


#: Lines of Java-like code: text, what it assigns, what that needs, its kind, and what the kind asks for.
JAVA = [
    ("String bar = param;", "bar", "param", "", ""),
    ('param = request.getParameter("q");', "param", "request,getParameter", "source", ""),
    ("cmd = prefix + bar;", "cmd", "prefix,bar", "", ""),
    ("if (bar.equals(mode))", "", "", "if", "bar,equals,mode"),
    ('prefix = "sh";', "prefix", "", "", ""),
    ('map.put("k", param);', "", "", "put", "param"),
    ('bar = map.get("k");', "bar", "map,get", "get", ""),
    ("switch (mode) {", "", "", "switch", "mode"),
    ("}", "", "", "close", ""),
    ("Runtime.getRuntime().exec(cmd);", "", "", "sink", "cmd"),
    ("int count = 1;", "count", "", "", ""),
    ("mode = name.trim();", "mode", "name", "", ""),
    ("// note", "", "", "", ""),
    ("statement.execute(sql", "", "", "sink", "sql"),
    ("  + bar);", "", "", "tail", ""),
]
LENGTH = 14


def java_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text): LENGTH lines of code for each document."""
    d = B.table(spark, sf_dir, "documents")
    at = F.transform(F.sequence(F.lit(0), F.lit(LENGTH - 1)), lambda k: F.get(F.array(*[F.lit(x[0]) for x in JAVA]), ((F.col("doc_id") * (2 * k + 3) + F.col("n_chars") * (k % 2 + 1) + k * k) % len(JAVA)).cast("int")))
    return d.select("doc_id", F.concat(F.lit("J"), F.col("doc_id").cast("string"), F.lit(".java")).alias("path"), F.array_join(at, "\n").alias("text"))


JAVA_TWIN = f"""WITH RECURSIVE {_rows("t", "c, code, name, needs, kind, asks", [(i, *x) for i, x in enumerate(JAVA)])},
l AS (SELECT doc_id, i, t.* FROM (SELECT doc_id, unnest(range(0, {LENGTH})) AS i, n_chars FROM documents) JOIN t ON c = (doc_id * (2 * i + 3) + n_chars * (i % 2 + 1) + i * i) % {len(JAVA)}),
fs AS (SELECT doc_id, min(CASE WHEN kind = 'sink' THEN i END) AS first_sink, bool_or(kind = 'source') AND bool_or(kind = 'sink') AS two FROM l GROUP BY doc_id),
sw AS (SELECT doc_id, -1 AS i, CAST([] AS BIGINT[]) AS open, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS closed FROM fs
  UNION ALL SELECT sw.doc_id, sw.i + 1, CASE WHEN kind = 'switch' THEN list_append(open, l.i) WHEN kind = 'close' THEN open[:-2] ELSE open END, CASE WHEN kind = 'close' AND len(open) > 0 THEN list_append(closed, {{'a': open[-1], 'b': l.i}}) ELSE closed END FROM sw JOIN l ON l.doc_id = sw.doc_id AND l.i = sw.i + 1),
ends AS (SELECT doc_id, z.a AS a, z.b AS b FROM (SELECT doc_id, unnest(closed) AS z FROM sw WHERE i = {LENGTH - 1})),
asg AS (SELECT l.doc_id, l.i, l.name, l.kind, string_split(l.needs, ',') AS needs, sw.open[-1] AS switch_at, (SELECT max(x.i) FROM l x WHERE x.doc_id = l.doc_id AND x.kind = 'if' AND x.i BETWEEN l.i - 4 AND l.i - 1) AS if_at
  FROM l JOIN fs USING (doc_id) JOIN sw ON sw.doc_id = l.doc_id AND sw.i = l.i WHERE name <> '' AND l.i < first_sink),
edge AS (SELECT doc_id, name, unnest(needs) AS need FROM asg UNION SELECT doc_id, name, unnest(['bar', 'equals', 'mode']) FROM asg WHERE if_at IS NOT NULL UNION SELECT doc_id, name, 'mode' FROM asg WHERE switch_at IS NOT NULL
  UNION SELECT a.doc_id, a.name, 'param' FROM asg a JOIN l ON l.doc_id = a.doc_id AND l.kind = 'put' AND l.i < a.i WHERE a.kind = 'get'),
want AS (SELECT DISTINCT doc_id, asks AS name, 0 AS depth FROM l WHERE kind = 'sink' UNION SELECT want.doc_id, need, depth + 1 FROM want JOIN edge USING (doc_id, name) WHERE depth < 5),
used AS (SELECT * FROM asg WHERE (doc_id, name) IN (SELECT doc_id, name FROM want)),
call AS (SELECT doc_id, i AS start, i, CASE WHEN code LIKE 'statement%' THEN 1 ELSE 0 END AS depth FROM l WHERE kind = 'sink'
  UNION ALL SELECT call.doc_id, start, l.i, greatest(0, depth + CASE WHEN l.code LIKE 'statement%' THEN 1 WHEN l.kind = 'tail' THEN -1 ELSE 0 END) FROM call JOIN l ON l.doc_id = call.doc_id AND l.i = call.i + 1 JOIN l own ON own.doc_id = call.doc_id AND own.i = call.i WHERE NOT (depth = 0 AND own.code LIKE '%;')),
done AS (SELECT doc_id, start, min(i) AS stop FROM call JOIN l USING (doc_id, i) WHERE depth = 0 AND code LIKE '%;' GROUP BY ALL),
stmt AS (SELECT call.doc_id, call.i FROM call LEFT JOIN done USING (doc_id, start) WHERE call.i <= coalesce(stop, start)),
kept AS (SELECT doc_id, i FROM used WHERE switch_at IS NULL UNION SELECT doc_id, if_at FROM used WHERE if_at IS NOT NULL
  UNION SELECT a.doc_id, l.i FROM used a JOIN l ON l.doc_id = a.doc_id AND l.kind = 'put' AND l.i < a.i WHERE a.kind = 'get'
  UNION SELECT doc_id, unnest(range(switch_at, coalesce(b, switch_at) + 1)) FROM (SELECT DISTINCT u.doc_id, u.switch_at, b FROM used u LEFT JOIN ends ON ends.doc_id = u.doc_id AND ends.a = u.switch_at WHERE u.switch_at IS NOT NULL)
  UNION SELECT doc_id, coalesce(max(CASE WHEN i <= first_sink THEN i END), min(i)) FROM l JOIN fs USING (doc_id) WHERE kind = 'source' GROUP BY doc_id),
every AS (SELECT doc_id, i FROM stmt UNION SELECT doc_id, i FROM kept JOIN fs USING (doc_id) WHERE two UNION SELECT doc_id, min(i) FROM l JOIN fs USING (doc_id) WHERE kind = 'source' AND NOT two GROUP BY doc_id)"""


@query(f"{JAVA_TWIN} SELECT 'J' || doc_id || '.java' AS path, CAST(i AS INT) AS i FROM every")
def security_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that each document's sinks depend on, with the nearest source and the sinks' statements."""
    return slices.kept_lines(java_texts(spark, sf_dir))


def _level(name: str, of: str, digits: int) -> str:
    return f"{name} AS (SELECT source, {f'substr(place, 1, {digits})' if digits else repr('')} AS place, sum(n) AS n, sha256(string_agg(digest, '' ORDER BY place, digest)) AS digest FROM {of} GROUP BY ALL)"


@query(
    f"""WITH leaf AS (SELECT source, own AS place, n, sha256(own || ':' || n) AS digest FROM (SELECT source, sha256(coalesce(text, '')) AS own, count(*) AS n FROM documents GROUP BY ALL)),
{_level("two", "leaf", 2)}, {_level("one", "two", 1)}, {_level("top", "one", 0)}
SELECT source AS repository_id, lang, digest AS source_digest FROM (SELECT DISTINCT source, lang FROM documents) d JOIN top USING (source)"""
)
def subject_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language of a source with the digest of all of the source's texts."""
    docs = B.table(spark, sf_dir, "documents").select(F.col("source").alias("repository_id"), "lang", "text")
    return identity.subjects(docs.select("repository_id", "lang").distinct(), docs, F.col("text"), depth=2)


BOXES = """import c{t} as other

class Base_{d}:
    def __init__(self):
        self.peer = {0}
    def ping(self):
        return 1

class Box_{d}({1}):
    def __init__(self, q: Base_{d}):
        self.near = {2}
    def run(self):
        self.near.ping()
        self.peer.ping()
        self.ping()
"""


def class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file c<id>.py for each document."""
    d, n = F.col("doc_id"), F.col("n_chars")
    values = _targets()
    own, far = F.concat(F.lit("Base_"), values["d"]), F.concat(F.lit("other.Base_"), values["t"])
    pick = lambda items, at: F.get(F.array(*items), at.cast("int"))
    call = lambda c: F.concat(c, F.lit("()"))
    values |= {"0": pick([call(far), F.lit("make()")], (d + n) % 2), "1": pick([own, far, F.lit("object")], (d * 3 + n) % 3), "2": pick([F.lit("q"), call(own), call(far)], (d * 5 + n) % 3)}
    return B.numbers(spark, sf_dir).select(F.concat(F.lit("c"), values["d"], F.lit(".py")).alias("path"), F.encode(_filled(BOXES, values), "UTF-8").alias("content"))


@query(
    f"""WITH d AS (SELECT doc_id, (doc_id * 7 + n_chars) % {CALLED} AS t, (doc_id + n_chars) % 2 AS p, (doc_id * 3 + n_chars) % 3 AS b, (doc_id * 5 + n_chars) % 3 AS n FROM documents),
base AS (SELECT doc_id, CASE b WHEN 0 THEN doc_id WHEN 1 THEN t END AS at_class FROM d),
e AS (SELECT doc_id, CASE n WHEN 2 THEN t ELSE doc_id END AS to_class FROM d UNION SELECT doc_id, at_class FROM base UNION SELECT base.doc_id, o.t FROM base JOIN d o ON o.doc_id = at_class WHERE o.p = 0)
SELECT 'c' || e.doc_id || '.py::Box_' || e.doc_id || '.run@12-15' AS src, 'c' || to_class || '.py::Base_' || to_class || '.ping@6-7' AS dst FROM e JOIN d ON d.doc_id = e.to_class"""
)
def receiver_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on self and its fields, by the fields' types and the classes above, over imports."""
    docs = stage(python_documents(class_files(spark, sf_dir)).filter("error is null"), "classes")
    return stage(receivers.receiver_edges(docs), "edges")


def _form_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(python_documents(route_files(spark, sf_dir)).filter("error is null"), "documents")


_D = f"""d AS (SELECT doc_id, (doc_id * 7 + n_chars) % {CALLED} AS t, (doc_id * 3 + 1) % {CALLED} AS u, {_AT.format(_LIST(FIRST), "(doc_id + n_chars) % 4")} AS g1, {_AT.format(_LIST(LAST), "(doc_id + n_chars) % 3")} AS g2,
  {_AT.format(_LIST(FIRST), "(doc_id * 3 + n_chars) % 4")} AS s1, {_AT.format(_LIST(LAST), "(doc_id * 5 + n_chars) % 3")} AS s2 FROM documents)"""
_CALLS = "array_to_string(list_sort(list_distinct(list_filter([replace({0}, '(r)', ''), 'svc_' || {1}, replace({2}, '(r)', '')], lambda x: x <> 'pass'))), '|')"
_GUARDS = "CASE WHEN {0} LIKE 'check%' THEN 'check_permission' ELSE '' END"


@query(
    f"""WITH {_D} SELECT 'g' || doc_id || '.py::route_' || doc_id || '@1-5' AS path, 'route_' || doc_id AS symbol, 1 AS start_line, 5 AS end_line, 'route_' || doc_id || '|g' || doc_id || '.route_' || doc_id AS defines, {_CALLS.format("g1", "t", "g2")} AS calls, 'GET:/r' AS routes, {_GUARDS.format("g1")} AS guards FROM d
UNION ALL SELECT 'g' || doc_id || '.py::svc_' || doc_id || '@7-10', 'svc_' || doc_id, 7, 10, 'svc_' || doc_id || '|g' || doc_id || '.svc_' || doc_id, {_CALLS.format("s1", "u", "s2")}, '', {_GUARDS.format("s1")} FROM d
UNION ALL SELECT 'g' || doc_id || '.py::<module>@1-10', '<module>', 1, 10, '', '', '', '' FROM d"""
)
def py_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code documents of a file for each document: spans, definitions, calls, routes and guards."""
    joined = lambda c: F.array_join(c, "|").alias(c)
    return _form_docs(spark, sf_dir).select("path", "symbol", "start_line", "end_line", *[joined(c) for c in ("defines", "calls", "routes", "guards")])


@query(
    f"""WITH {_D} SELECT 'g' || doc_id || '.py::route_' || doc_id || '@1-5' AS src, 'g' || t || '.py::svc_' || t || '@7-10' AS dst FROM d WHERE t IN (SELECT doc_id FROM d)
UNION ALL SELECT 'g' || doc_id || '.py::svc_' || doc_id || '@7-10', 'g' || u || '.py::svc_' || u || '@7-10' FROM d WHERE u <> doc_id AND u IN (SELECT doc_id FROM d)"""
)
def py_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges between the functions of a file for each document."""
    docs = _form_docs(spark, sf_dir).filter("symbol <> '<module>'")
    each = lambda c: docs.select("path", F.explode(c).alias("symbol"))
    return stage(graph.build_edges(each("calls"), each("defines")), "edges")


_VALUE = "list_extract([" + ", ".join("'" + v.replace("'", "''") + "'" for v in VALUES) + f"], CAST((doc_id * (2 * {{0}} + 3) + n_chars * ({{0}} % 3 + 1) + {{0}} * {{0}}) % {len(VALUES)} AS INT) + 1)"


@query(
    f"""WITH h AS (SELECT 'm' || doc_id || '.py::handle_' || doc_id || '@1-19' AS path, 17 AS source_line, 'command-execution' AS rule, 'os.system(' || {_VALUE.format(9)} || ')' AS code FROM documents
UNION ALL SELECT 'm' || doc_id || '.py::handle_' || doc_id || '@1-19', 18, 'database-operation', 'cursor.execute(' || {_VALUE.format(10)} || ')' FROM documents
UNION ALL SELECT 'm' || doc_id || '.py::step_' || doc_id || '@21-25', 23, 'dynamic-evaluation', 'eval(q)' FROM documents)
SELECT concat_ws(':', 'repo', path, source_line, rule) AS candidate_id, path, source_line, rule, rule || ' ' || code AS query FROM h"""
)
def py_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the scan rules in a file for each document, each in the innermost function around it."""
    docs = stage(python_documents(handler_files(spark, sf_dir)).filter("error is null"), "documents")
    return stage(rules.candidates_of(scanned(docs), docs, "repo"), "candidates")


CASES = """def case_{d}(r):
    {0}
    help_{t}(r)
    {1}

def help_{d}(r):
    {2}
"""
AHEAD, BEHIND, HELP = ["pass", "require_permission(r)", "db.delete(r)"], ["pass", "db.delete(r)", "subprocess.run(r)", "log(r)"], ["pass", "is_admin(r)", "db.delete(r)", "eval(r)", "log(r)"]


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file e<id>.py for each document."""
    d, n = F.col("doc_id"), F.col("n_chars")
    values = _targets() | {"0": _pick(AHEAD, (d + n) % 3), "1": _pick(BEHIND, (d * 3 + n) % 4), "2": _pick(HELP, (d * 7 + n) % 5)}
    return B.numbers(spark, sf_dir).select(F.concat(F.lit("e"), values["d"], F.lit(".py")).alias("path"), F.encode(_filled(CASES, values), "UTF-8").alias("content"))


@query(
    f"""WITH d AS (SELECT doc_id, (doc_id * 7 + n_chars) % {CALLED} AS t, {_AT.format(_LIST(AHEAD), "(doc_id + n_chars) % 3")} AS g, {_AT.format(_LIST(BEHIND), "(doc_id * 3 + n_chars) % 4")} AS s, {_AT.format(_LIST(HELP), "(doc_id * 7 + n_chars) % 5")} AS h FROM documents),
e AS (SELECT system, doc_id, CAST(g LIKE 'db%' OR s LIKE 'db%' OR s LIKE 'sub%' AS INT) + CASE WHEN system IN ('V3', 'V4', 'V5') AND (far LIKE 'db%' OR far LIKE 'eval%') THEN 1 ELSE 0 END AS n,
    g LIKE 'db%' OR (s LIKE 'db%' AND g NOT LIKE 'req%') OR (system IN ('V3', 'V4', 'V5') AND coalesce(far, '') LIKE 'db%') AS open, s LIKE 'db%' AND g LIKE 'req%' AS guarded
  FROM (SELECT d.*, o.h AS far FROM d LEFT JOIN d o ON o.doc_id = d.t), (SELECT unnest(['V1', 'V2', 'V3', 'V4', 'V5']) AS system)),
v AS (SELECT *, CASE WHEN n > 0 THEN 'VULNERABLE' ELSE 'ABSTAIN' END AS scan, CASE WHEN n > 0 THEN least(0.95, 0.8 + 0.05 * n) ELSE 0.35 END AS scan_sure, CASE WHEN open THEN 'VULNERABLE' WHEN guarded THEN 'SAFE' ELSE 'ABSTAIN' END AS authz, CASE WHEN open THEN 0.82 WHEN guarded THEN 0.84 ELSE 0.35 END AS authz_sure FROM e)
SELECT system, 'e' || doc_id || '.py::case_' || doc_id || '@1-4' AS case_id, CASE WHEN system IN ('V1', 'V2', 'V3') OR scan = authz THEN scan ELSE 'ABSTAIN' END AS label,
  round(CAST(CASE WHEN system IN ('V1', 'V2', 'V3') THEN scan_sure WHEN scan = authz AND scan <> 'ABSTAIN' THEN (scan_sure + authz_sure) / 2 ELSE greatest(CASE WHEN scan <> 'ABSTAIN' THEN scan_sure ELSE 0 END, CASE WHEN authz <> 'ABSTAIN' THEN authz_sure ELSE 0 END) END AS DOUBLE), 6) AS confidence FROM v"""
)
def synthetic_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's first function as a case of five systems: local, text and graph context under one expert (V1-V3), graph context under a full review (V4) and with an early quorum (V5)."""
    docs, edges, _ = functions_of(case_files(spark, sf_dir))
    texts = docs.select("path", "text")
    cases = docs.filter("symbol like 'case%'").select(F.col("path").alias("query_id"), "path", F.col("symbol").alias("query"))
    out = None
    for mode, systems in (("local", ["V1"]), ("text", ["V2"]), ("graph", ["V3", "V4", "V5"])):
        found = stage(context.retrieve(texts, edges, cases, mode).withColumnRenamed("query_id", "case_id"), "evidence")
        ballots = experts.scan_votes(found).withColumn("vote_order", F.lit(0)).union(experts.authorization_votes(found).withColumn("vote_order", F.lit(1)))
        for system in systems:
            verdict = votes.majority(ballots) if system in ("V4", "V5") else votes.single(ballots)
            if system == "V5":
                fast = votes.early(ballots).filter("label is not null").select("case_id", F.col("label").alias("fast"), F.col("confidence").alias("sure"))
                verdict = verdict.join(fast, "case_id", "left").select("case_id", F.coalesce("fast", "label").alias("label"), F.coalesce("sure", "confidence").alias("confidence"))
            verdict = verdict.select(F.lit(system).alias("system"), "case_id", "label", F.round("confidence", 6).alias("confidence"))
            out = verdict if out is None else out.union(verdict)
    return stage(out, "verdicts")


_ESCAPED = "regexp_replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), '[^ -~]', chr(92) || chr(92) || 'u0000', 'g')"
_SIZE = "len(regexp_extract_all({0}, '[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]'))"
_CUT = r"\s*(?:[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_])"
_CUT_SIZE = _SIZE.format(_ESCAPED.format("array_to_string(list_slice(pieces, 1, k), '')"))


@query(
    f"""WITH RECURSIVE c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, 30 + conv_id % 90 AS budget FROM conversations QUALIFY place <= 8),
i AS (SELECT *, {_SIZE.format(_ESCAPED.format("text"))} AS whole, {_SIZE.format("'{\"evidence_id\":\"turn:' || turn || '\",\"graph_distance\":null,\"path\":\"c/' || conv_id || '\",\"retrieval\":\"text\",\"text\":\"\"}'")} AS base, {_SIZE.format("'{\"retrieved_code\":[]}'")} AS frame, regexp_extract_all(text, '{_CUT}') AS pieces FROM c),
s AS (SELECT *, list_transform(range(1, len(pieces) + 1), lambda k: {_CUT_SIZE}) AS sizes FROM i),
w AS (SELECT conv_id, 0 AS place, max(budget) - max(frame) AS room, 0 AS taken, CAST(NULL AS BIGINT) AS keep, 0 AS size FROM s GROUP BY conv_id
  UNION ALL SELECT conv_id, place, CASE WHEN got THEN room - size ELSE room END, taken + CAST(got AS INT), CASE WHEN got THEN keep END, CASE WHEN got THEN size ELSE 0 END FROM (
    SELECT *, keep IS NOT NULL AS got, comma + CASE WHEN keep = -1 THEN whole ELSE list_max(list_filter(sizes, lambda n: n <= room - comma)) END AS size FROM (
      SELECT w.conv_id, s.place, w.room, w.taken, s.whole, s.sizes, s.base + CAST(w.taken > 0 AS INT) AS comma, CASE WHEN w.room < s.base + CAST(w.taken > 0 AS INT) THEN NULL WHEN s.whole <= w.room - s.base - CAST(w.taken > 0 AS INT) THEN -1 ELSE nullif(len(list_filter(s.sizes, lambda n: n <= w.room - s.base - CAST(w.taken > 0 AS INT))), 0) END AS keep
      FROM w JOIN s ON s.conv_id = w.conv_id AND s.place = w.place + 1)))
SELECT w.conv_id, s.turn AS rank, CASE WHEN keep = -1 THEN text ELSE array_to_string(list_slice(pieces, 1, keep), '') END AS text, CAST(w.size AS INT) AS size, CAST(budget - (min(room) OVER (PARTITION BY w.conv_id)) AS INT) AS total FROM w JOIN s USING (conv_id, place) WHERE keep IS NOT NULL"""
)
def prompt_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight turns of each conversation as evidence of a prompt, cut or passed over so that its JSON fits."""
    c = B.table(spark, sf_dir, "conversations")
    items = c.select("conv_id", F.col("turn").alias("rank"), F.concat(F.lit("turn:"), F.col("turn").cast("string")).alias("evidence_id"), F.lit(None).cast("int").alias("graph_distance"), F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("path"), F.lit("text").alias("retrieval"), "text")
    return budgets.fitted(items, 30 + F.col("conv_id") % 90, F.lit('{"retrieved_code":[]}'), key="conv_id")


RESOURCES = """def drop_{d}(user_id, key, db, actor):
    {0}
    {1}
    {2}
    db.delete(row)
"""
LOOKUPS, BETWEEN, CHECKS = ["row = db.get(Row, key)", "row = db.get(Row, key + actor)", "row = find(key)"], ["pass", "row = other(key)", "db = other(key)", "check(row.user_id == user_id)", "log(row)"], ["pass", "if row.owner_id != actor: stop()", "return key", "if row.name != key: stop()"]


def resource_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file r<id>.py for each document."""
    d, n = F.col("doc_id"), F.col("n_chars")
    values = _targets() | {"0": _pick(LOOKUPS, (d + n) % 3), "1": _pick(BETWEEN, (d * 3 + n) % 5), "2": _pick(CHECKS, (d * 5 + n) % 4)}
    return B.numbers(spark, sf_dir).select(F.concat(F.lit("r"), values["d"], F.lit(".py")).alias("path"), F.encode(_filled(RESOURCES, values), "UTF-8").alias("content"))


@query(
    f"""WITH d AS (SELECT doc_id, (doc_id + n_chars) % 3 AS a, (doc_id * 3 + n_chars) % 5 AS b, (doc_id * 5 + n_chars) % 4 AS c FROM documents)
SELECT 'r' || doc_id || '.py::drop_' || doc_id || '@1-5' AS path, 'row' AS resource, 'db.get' AS lookup, 2 AS lookup_line, CASE a WHEN 0 THEN 'key' ELSE 'actor | key' END AS keys, 'db.delete' AS operation, 5 AS operation_line, 'actor | user_id' AS principals,
  array_to_string(list_filter([CASE WHEN b = 3 THEN 'row.user_id == user_id' END, CASE WHEN c = 1 THEN 'row.owner_id != actor' END], lambda x: x IS NOT NULL), ' | ') AS comparisons FROM d WHERE a < 2 AND b NOT IN (1, 2) AND c <> 2"""
)
def resource_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes of what was looked up before, while the lookup holds, with the owner comparisons in between."""
    docs = stage(python_documents(resource_files(spark, sf_dir)).filter("error is null"), "documents")
    return stage(authorization.resource_operations(docs), "operations")
