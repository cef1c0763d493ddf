"""Worked examples of the engine's operators."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillet.functions import text as T
from quillet.functions.python_code import python_documents, scanned
from quillet.operators import accept, context, graph, journal, locate, masks, metrics, retrieval, rules, votes
from quillet.plans import fixtures
from quillet.sources import readers, sinks
from quillet.streaming import journal as stream


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_ternary_rates(spark):
    truth = dict(tp=(True, "VULNERABLE"), fp=(False, "VULNERABLE"), fn=(True, "SAFE"), tn=(False, "SAFE"), ap=(True, "ABSTAIN"), an=(False, "ABSTAIN"))
    r = metrics.ternary(spark.createDataFrame(list(truth.values()), "actual boolean, label string")).first()
    assert (r["tp"], r["fn"], r["abstain_positive"]) == (1, 1, 1)
    assert r["coverage"] == pytest.approx(4 / 6) and r["strict_recall"] == pytest.approx(1 / 3) and r["conservative_fpr"] == pytest.approx(2 / 3)


def test_ternary_rejects_unknown_label(spark):
    with pytest.raises(PySparkException):
        metrics.ternary(spark.createDataFrame([(True, "MAYBE")], "actual boolean, label string")).collect()


def test_failure_aware_metrics(spark):
    data = [("a", "completed", "VULNERABLE", "VULNERABLE"), ("b", "failed", None, "VULNERABLE"), ("c", "not_run", None, "SAFE"), ("d", "completed", "SAFE", "SAFE")]
    df = spark.createDataFrame(data, "case_id string, status string, predicted_label string, ground_truth string").withColumns({"model_calls": F.lit(1), "tool_calls": F.lit(0)})
    r = metrics.failure_aware(df).first()
    assert (r["strict_recall"], r["covered_recall"], r["coverage"], r["conservative_fpr"]) == (0.5, 1.0, 0.5, 0.5)
    assert r["provisional"] and r["recall_low"] is None and r["fn"] == r["fp"] == 0


def test_paired(spark):
    data = [(1, "E2", "failed", None, "SAFE"), (1, "E3", "completed", "SAFE", "SAFE"), (2, "E2", "abstained", None, "SAFE"), (2, "E3", "completed", "SAFE", "SAFE")]
    df = spark.createDataFrame(data, "case_id int, system string, status string, predicted_label string, ground_truth string")
    r = metrics.paired(df, "E2", "E3").first()
    assert tuple(r) == (0, 1, 0, 1, 1)


def _votes(spark, data):
    return spark.createDataFrame([(c, f"x{i}", label, conf, i) for c, case in data.items() for i, (label, conf) in enumerate(case)], "case_id string, expert string, label string, confidence double, vote_order int")


def test_quorum(spark):
    v = _votes(spark, {"tie": [("VULNERABLE", 0.9), ("SAFE", 0.9)], "win": [("SAFE", 0.6), ("SAFE", 0.8), ("ABSTAIN", 1.0)], "none": [("ABSTAIN", 0.9)], "two": [("VULNERABLE", 0.9), ("VULNERABLE", 0.8), ("SAFE", 0.9)]})
    assert rows(votes.majority(v), "case_id", "label", F.round("confidence", 6)) == [("none", "ABSTAIN", 0.0), ("tie", "ABSTAIN", 0.9), ("two", "VULNERABLE", 0.85), ("win", "SAFE", 0.7)]
    assert rows(votes.early(v).filter("label is not null"), "case_id", "label") == [("two", "VULNERABLE")]


def test_early_never_differs_from_full(spark):
    ballots = [(a, b) for a in ("VULNERABLE", "SAFE", "ABSTAIN") for b in (0.79, 0.8, 1.0)]
    v = _votes(spark, {f"{i}-{j}-{k}": [x, y, z] for i, x in enumerate(ballots) for j, y in enumerate(ballots) for k, z in enumerate(ballots)})
    both = votes.early(v).filter("label is not null").join(votes.majority(v).withColumnRenamed("label", "full"), "case_id")
    assert both.filter("label <> full").count() == 0


def test_duplicate_ballots_fail(spark):
    v = spark.createDataFrame([("c", "scan", "SAFE", 1.0, 0), ("c", "scan", "SAFE", 1.0, 1)], "case_id string, expert string, label string, confidence double, vote_order int")
    with pytest.raises(PySparkException):
        votes.checked(v).collect()


def test_ready_task(spark):
    sub = spark.createDataFrame([("c", "a", "taint", [], 0), ("c", "b", "scan", [], 1), ("c", "d", "scan", ["a"], 2)], "case_id string, task_id string, expert string, dependencies array<string>, position int")
    done = spark.createDataFrame([("c", "b")], "case_id string, task_id string")
    assert votes.ready_task(sub, done, F.col("expert")).first()["task_id"] == "a"


def test_budget(spark):
    ev = lambda *t: spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "query_id int, rank int, text string")
    assert rows(retrieval.limit_budget(ev("alpha = beta + gamma", "delta = epsilon"), 7), "rank", "text") == [(0, "alpha = beta + gamma"), (1, "delta =")]
    assert rows(retrieval.limit_budget(ev("alpha beta gamma delta", "epsilon zeta"), 3), "rank", "text") == [(0, "alpha beta gamma")]
    with pytest.raises(ValueError):
        retrieval.limit_budget(ev("a"), 0)


def test_graph(spark):
    calls = spark.createDataFrame([("a", "f"), ("b", "g"), ("c", "run"), ("a", "a")], "path string, symbol string")
    defines = spark.createDataFrame([("b", "f"), ("c", "g"), ("x", "run"), ("y", "run"), ("a", "a")], "path string, symbol string")
    edges = graph.build_edges(calls, defines)
    assert rows(edges, "src", "dst") == [("a", "b"), ("b", "c")]
    seeds = spark.createDataFrame([("a",)], "path string")
    cyclic = edges.union(spark.createDataFrame([("c", "a")], "src string, dst string"))
    assert rows(graph.distances(seeds, cyclic, 8), "path", "distance") == [("a", 0), ("b", 1), ("c", 2)]


def test_precise_definitions_hide_bare_names(spark):
    calls = spark.createDataFrame([("a", "T.f")], "path string, symbol string")
    defines = spark.createDataFrame([("b", "T.f"), ("b", "T.f(int)")], "path string, symbol string")
    assert graph.build_edges(calls, defines).count() == 0


def test_usage_streams(spark):
    data = [(0, "a", "start", None), (1, "a", "received", 10), (2, "b", "start", None), (3, "a", "reply", 10), (4, "b", "received", 20), (5, "b", "invalid", 20)]
    df = spark.createDataFrame(data, "seq int, stream string, event string, tokens int")
    assert rows(journal.stream_usage(df), "stream", "tokens", "unknown") == [("a", 10, 0), ("b", 20, 0)]


def test_heldout(spark):
    data = [("d", "dev", 1, True), ("shared", "r1", 1, True), ("good", "r2", 2, True), ("bad", "r3", 3, False)]
    df = spark.createDataFrame(data, "entry_id string, repo string, report_id int, verified boolean")
    got = dict(rows(accept.heldout(df, spark.createDataFrame([("dev",)], "repo string")), "entry_id", F.coalesce("reason", F.lit("-"))))
    assert got == {"d": "development_repository", "shared": "development_advisory", "good": "-", "bad": "unverified"}


def test_sample_ignores_order(spark):
    cases = [(f"c{i}", i % 2) for i in range(20)]
    pick = lambda d: rows(accept.stratified_sample(spark.createDataFrame(d, "case_id string, s int"), 3, ["s"], F.col("case_id"), "some-seed:"), "case_id")
    assert pick(cases) == pick(cases[::-1]) and len(pick(cases)) == 6


def test_merged_ranges_and_spans(spark):
    r = spark.createDataFrame([("f", 1, 3), ("f", 3, 5), ("f", 7, 9)], "file string, first int, last int")
    assert rows(locate.merged_ranges(r, "file"), "first", "last") == [(1, 5), (7, 9)]
    spans_ = spark.createDataFrame([("f", "outer", "o", 1, 900), ("f", "inner", "i", 2, 4)], "file string, path string, symbol string, first int, last int")
    points = spark.createDataFrame([(1, "f", 3, "x"), (2, "f", 700, "x"), (3, "f", 2000, "o"), (4, "f", 2000, "x")], "point_id int, file string, line int, symbol string")
    assert rows(locate.enclosing_span(points, spans_), "point_id", F.coalesce("path", F.lit("-"))) == [(1, "inner"), (2, "outer"), (3, "-"), (4, "-")]
    assert rows(locate.candidate_document(points, spans_), "point_id", "path") == [(1, "inner"), (2, "outer"), (3, "outer"), (4, "inner")]


def test_rules(spark):
    docs = spark.createDataFrame([("p", "x = eval(y)\nsubprocess.run(z)\n\nobj.eval (a)\n")], "path string, text string")
    assert rows(rules.hits(docs, rules.SCAN_RULES), "line", "rule") == [(1, "dynamic-evaluation"), (2, "command-execution")]
    assert rows(rules.chmod_modes(spark.createDataFrame([("p", "os.chmod(a, 0o644); os.chmod(b, 0o777)")], "path string, text string")), "mode", "others_write") == [(420, False), (511, True)]
    hits = spark.createDataFrame([("p", 1, 0, 4), ("p", 1, 6, 8)], "path string, line int, start int, stop int")
    masks = spark.createDataFrame([("p", 1, 5, 9)], "path string, line int, begin int, finish int")
    assert rows(rules.outside_spans(hits, masks), "start") == [(0,)]


def test_scalars(spark):
    df = spark.createDataFrame([("https://GitHub.com/A/b.git/", "a/b.py::X.f@3-9", "src/p/__init__.py")], "u string, p string, m string")
    r = df.select(T.repository_key(F.col("u")).alias("u"), T.document_symbol(F.col("p")).alias("s"), T.line_bounds(F.col("p")).alias("b"), T.module_name(F.col("m")).alias("m")).first()
    assert (r["u"], r["s"], tuple(r["b"]), r["m"]) == ("github.com/a/b", "X.f", (3, 9), "p")
    w = spark.range(1).select(T.wilson(F.lit(0), F.lit(0)).alias("n"), T.wilson(F.lit(1), F.lit(1)).alias("w")).first()
    assert w["n"] is None and w["w"]["high"] == 1.0


def python_docs(spark, files):
    return python_documents(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary"))


def test_python_spans(spark):
    got = {r["path"]: r for r in python_docs(spark, fixtures.FILES).collect()}
    run = got["src/app/routes.py::run@5-8"]
    assert run["routes"] == ["GET:/run/{name}"] and "subprocess.run" in run["calls"] and "app.store.command" in run["calls"]
    assert "app.routes.Admin.drop" in got["src/app/routes.py::Admin.drop@11-13"]["defines"]
    assert got["src/app/broken.py"]["error"].startswith("SyntaxError") and got["src/app/broken.py"]["calls"] == []


def test_lines_are_the_parsers(spark):
    """A form feed or a line separator in a string ends no line."""
    docs = python_docs(spark, {"a.py": "a = 1\n\f\ndef f(x):\r\n    s = '\u2028'\r    os.system(x)\n", "b.py": "", "c.py": "# only\n"})
    got = {r["path"]: r for r in docs.collect()}
    assert got["a.py::f@3-5"]["text"] == "def f(x):\n    s = '\u2028'\n    os.system(x)" and {"a.py::<module>@1-5", "b.py::<module>@1-1", "c.py::<module>@1-1"} < set(got)
    assert rows(scanned(docs), "path", "line", "code", "rule") == [("a.py::f@3-5", 3, "    os.system(x)", "command-execution")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "repo/.git").mkdir(parents=True)
    (tmp_path / "repo/a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "repo/.git/b.py").write_text("x")
    files = readers.source_files(spark, str(tmp_path / "repo"))
    assert rows(files, "path", "language") == [("a.py", "python")]
    assert python_documents(files).count() == 2 and readers.fingerprint(files).first()["files"] == 1
    (tmp_path / "t.csv").write_text("# comment\n# test name, category, real vulnerability, cwe\nT1,cmdi,TRUE,78\nT2,,FALSE,\n")
    assert rows(readers.truth_csv(spark, str(tmp_path / "t.csv")), "case_id", "category", "vulnerable", "cwe") == [("T1", "cmdi", True, 78), ("T2", "unknown", False, 0)]
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    out = str(tmp_path / "frozen")
    assert sinks.write_frozen(df, out) and not sinks.write_frozen(df, out)
    with pytest.raises(ValueError):
        sinks.write_frozen(spark.createDataFrame([(2, "a")], "i int, s string"), out)


def test_admission_stream(spark, tmp_path):
    spark.createDataFrame([(1, i) for i in range(5)], "stream long, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("stream long, seq long").parquet(str(tmp_path / "in"))
    q = stream.admitted(src, 3).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("admitted"), "seq", "admitted") == [(0, True), (1, True), (2, True), (3, False), (4, False)]


def test_context_shares_and_modes(spark):
    from quillet.operators import context

    ranked = spark.createDataFrame([(1, r) for r in range(3)], "query_id int, rank int")
    assert [r["share"] for r in context.shares(ranked, 1488).orderBy("rank").collect()] == [512, 488, 488]
    docs = spark.createDataFrame([("a", "call helper now"), ("b", "helper body text"), ("c", "unrelated words")], "path string, text string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    cand = spark.createDataFrame([(1, "a", "helper body")], "query_id int, path string, query string")
    for mode, want in (("local", ["a"]), ("graph", ["a", "b"]), ("text", ["a", "b"])):
        assert sorted(r["path"] for r in context.retrieve(docs, edges, cand, mode).collect()) == want


def test_experts(spark):
    from quillet.operators import experts

    ev = spark.createDataFrame([(1, "require_permission(u); db.delete(x)"), (2, "db.delete(x); require_permission(u)"), (3, "nothing")], "case_id int, text string")
    assert rows(experts.authorization_votes(ev), "case_id", "label") == [(1, "SAFE"), (2, "VULNERABLE"), (3, "ABSTAIN")]
    assert rows(experts.scan_votes(ev), "case_id", "label", "confidence") == [(1, "VULNERABLE", 0.85), (2, "VULNERABLE", 0.85), (3, "ABSTAIN", 0.35)]


def test_policy(spark):
    from quillet.operators import policy

    cites = spark.createDataFrame([(1, "o1", "supporting"), (1, "e1", "counter"), (1, "zz", "evidence")], "case_id int, reference string, role string")
    known = spark.createDataFrame([(1, "o1"), (1, "e1")], "case_id int, reference string")
    alias = spark.createDataFrame([(1, "o1", "obs"), (1, "e1", "obs")], "case_id int, reference string, identity string")
    assert rows(policy.unknown_citations(cites, known), "reference") == [("zz",)]
    assert rows(policy.role_conflicts(cites, alias), "identity", "roles") == [("obs", "counter / supporting")]
    tasks = spark.createDataFrame([(1, 0, "a", "x", ["b"]), (1, 1, "b", " ", ["q"])], "case_id int, position int, task_id string, objective string, dependencies array<string>")
    assert rows(policy.plan_violations(tasks), "task_id", "issue") == [("a", "forward"), ("b", "blank"), ("b", "unknown")]
    tools = lambda *t: spark.createDataFrame([(1, x) for x in t], "case_id int, tool string")
    assert rows(policy.missing_validators(tools("p", "p", "q"), tools("p", "q")), "tool", "missing") == [("p", 1)]
    assert policy.command_status(spark.createDataFrame([(1, "SANITIZED"), (1, "AMBIGUOUS"), (2, None)], "case_id int, status string")).orderBy("case_id").collect()[0]["status"] == "AMBIGUOUS"


def test_fallback_documents(spark):
    from quillet.functions import lexical

    files = spark.createDataFrame([("r.js", "@Get('/a')\nrouter.post('/b', check_permission(x))\nfunction run() {}\n", "javascript"), ("s.go", 'r.HandleFunc("/h", f)\nfunc main() {}', "go")], "path string, text string, language string")
    got = {r["file"]: r for r in lexical.fallback_documents(files).collect()}
    assert got["r.js"]["routes"] == ["GET:/a", "POST:/b"] and got["r.js"]["guards"] == ["check_permission"] and got["r.js"]["path"] == "r.js::file@1-3"
    assert got["s.go"]["routes"] == ["ANY:/h"] and "main" in got["s.go"]["defines"]


def test_python_calls_and_routes(spark):
    text = """import os.path
from a.b import tool as t, other
other = None

class Box:
    @app.get('/x/{i}')
    def run(self, i):
        def inner():
            hidden()
        pick = t if i else None
        pick.go()
        self.check_permission()
        t(i); os.path.join(i); other.f(); db.cursor.fetch()
        return lambda: late()
"""
    run = next(r for r in python_docs(spark, {"src/p/m.py": text}).collect() if r["symbol"] == "Box.run")
    checks = ["Box.check_permission", "p.m.Box.check_permission", "src.p.m.Box.check_permission"]
    assert run["calls"] == sorted(["a.b.tool.go", "tool.go", "a.b.tool", "os.path.join", "db.cursor.fetch", "fetch", "cursor.fetch", *checks])
    assert run["routes"] == ["GET:/x/{i}"] and run["guards"] == sorted(checks)
    assert {"run", "p.m.Box.run", "src.p.m.Box.run", "Box.run"} == set(run["defines"])


def test_python_scan(spark):
    text = "import subprocess as sp\nclass A:\n    @app.route('/x')\n    def f(self, q):\n        sp.run(q)\n        from os import kill as k\n        k(1, 9)\n        label = 'eval(x)'\n        T('{}').format(q)\n        getattr(q, q)\n        getattr(q, 'x')\n        renderers[q](q)\n        (lambda: exec(q))()\n"
    docs = python_docs(spark, {"a.py": text, "b.py": "def f(:"})
    want = [(1, "authorization-boundary"), (3, "command-execution"), (5, "process-control"), (7, "template-operation"), (8, "dynamic-attribute-access"), (10, "template-operation"), (11, "dynamic-evaluation")]
    assert rows(scanned(docs), "line", "rule") == want


def test_matches_outside_masks(spark):
    marks = '"' * 3
    texts = [(1, "python", f"x = 1 # open(y)\nopen('a#b'); s = 'open(z)'\n{marks}\nopen(q)\n{marks} ; open(r)"), (2, "java", "/* open(a)\n open(b) */ open(c) // open(d)"), (3, "shell", "  # open(a)\nopen(b) # open(c)"), (4, "cobol", "# open(a)")]
    docs = spark.createDataFrame(texts, "doc_id int, language string, text string")
    got = masks.matches_outside(docs, {"path-access": rules.SINK_RULES["path-access"]})
    assert rows(got, "doc_id", "line", "start") == [(1, 2, 0), (1, 5, 6), (2, 2, 12), (3, 2, 0), (3, 2, 10), (4, 1, 2)]


def test_focused_windows(spark):
    text = "one\ntwo words\nthe needle here\nafter it\nlast\n"
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "needle " * 9), (4, "")], "i int, text string")
    got = rows(context.focused(df, 6, F.lit("needle"), F.lit(1)), "i", "center", "first", "last", "n_tokens", "text")
    assert got == [(1, 2, 0, 3, 6, "one\ntwo words\nthe needle here\n"), (2, 0, 0, 1, 1, "short"), (3, 0, 0, 1, 6, "needle needle needle needle needle needle")]


def test_short_stratum_is_an_error(spark):
    with pytest.raises(Exception, match="fewer than 3"):
        accept.stratified_sample(spark.createDataFrame([("a", 1), ("b", 1)], "case_id string, s int"), 3, ["s"], F.col("case_id"), "x").collect()
