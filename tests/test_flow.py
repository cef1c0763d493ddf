"""Taint against random runs of random functions, and worked cases of control flow, calls and guards."""

import random

import pytest
from pyspark.sql import functions as F

from quillet.functions.python_code import python_documents
from quillet.operators import authorization, budgets, context, flow, graph, identity, receivers, slices

NAMES = ["x", "y", "z"]


def documents(spark, files):
    return python_documents(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary"))


#: Bodies of f(a), and the (line, entry, cleaned) of their sinks.
CASES = [
    ("x = a\nx = 'k'\nos.system(x)", set()),
    ("x, (y, *z) = a, 'k'\nos.system(z)\ndel x\nreturn\nos.system(a)", {(3, "a", False)}),
    ("x = int(a)\nx += a if b else 1\nos.system(x)\nos.system(int(a))", {(4, "a", False), (5, "a", True)}),
    # A handler sees what was there before the statement that failed; a finally block sees all ways.
    ("x = a\ntry:\n    x = clean()\nexcept ValueError:\n    os.system(x)\nelse:\n    os.system(x)\nfinally:\n    eval(x)\nos.system(x)", {(6, "a", False), (10, "a", False), (11, "a", False)}),
    ("x = a\ntry:\n    x = clean()\n    return 1\nfinally:\n    eval(x)\nos.system(x)", {(7, "a", False)}),
    ("x = a\ntry:\n    x = clean()\nfinally:\n    x = 'k'\nos.system(x)", set()),
    # A manager may swallow what is raised in it; a loop that never ends has no end but by break.
    ("x = a\nwith open_it() as h:\n    x = clean()\nos.system(x)", {(5, "a", False)}),
    ("x = 'k'\nwhile True:\n    if b:\n        x = a\n        break\n    x = 'k'\nos.system(x)\nwhile 1:\n    x = a\nos.system(x)", {(8, "a", False)}),
    ("for i in a:\n    if i:\n        continue\n    y = i\nelse:\n    eval(i)\nos.system(y)", {(7, "a", False), (8, "a", False)}),
    ("match a:\n    case [p, *q]:\n        eval(q)\n    case {'k': r}:\n        eval(r)\n    case _:\n        eval(b)", {(4, "a", False), (6, "a", False)}),
    ("subprocess.run(['echo', a])\nsubprocess.run(['/bin/sh', a])\nsubprocess.run(['echo', a], shell=True)\ncursor.execute('q', a)\nrun(args=a)\nsubprocess.run(args=a)", {(3, "a", False), (4, "a", False), (7, "a", False)}),
    ("eval(request.args['x'])\neval(int(input()))\n[eval(i) for i in a]\n(lambda q: os.system(a))()\nif (n := a):\n    eval(n)", {(2, "", False), (3, "", True), (7, "a", False)}),
]


def test_worked_cases(spark):
    docs = documents(spark, {f"m{i}.py": "def f(a):\n" + "".join(f"    {x}\n" for x in body.split("\n")) for i, (body, _) in enumerate(CASES)})
    got = {}
    for r in flow.tainted_sinks(docs).collect():
        got.setdefault(int(r["path"][1:].split(".")[0]), set()).add((r["line"], r["entry"], r["cleaned"]))
    assert {body: got.get(i, set()) for i, (body, _) in enumerate(CASES)} == dict(CASES)


def test_errors_empty_and_methods(spark):
    docs = documents(spark, {"a.py": "def f(:", "b.py": "", "c.py": "class A:\n    def f(self, q):\n        def g(w):\n            eval(w)\n        eval(self)\n        eval(q)\nimport os as o\no.system(input())\n"})
    assert {(r["path"], r["line"], r["entry"]) for r in flow.tainted_sinks(docs).collect()} == {("c.py::A.f@2-6", 6, "q"), ("c.py::A.f.g@3-4", 4, "w"), ("c.py::<module>@1-8", 8, "")}
    assert flow.tainted_sinks(docs.limit(0)).count() == 0


def random_body(r, depth=0, loop=False):
    out = []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["set"] * 4 + ["sink"] * 2 + (["if", "while", "for", "try", "finally", "with"] if depth < 2 else []) + (["break", "continue"] if loop else []) + ["raise", "return"] * (depth > 0))
        value = r.choice([*NAMES, "a", "'k'", "'k'", "int(a)", "x + y", "pick(z)", "request.args"])
        inner = lambda lp=loop: ["    " + x for x in random_body(r, depth + 1, lp)]
        if kind == "set":
            out.append(f"{r.choice(NAMES)} {r.choice(['=', '=', '+='])} {value}")
        elif kind == "sink":
            out.append(f"eval({value})")
        elif kind == "if":
            out += ["if flip():", *inner(), "else:", *inner()]
        elif kind in ("while", "for"):
            out += ["while flip():" if kind == "while" else f"for {r.choice(NAMES)} in items({value}):", *inner(True), *(["else:", *inner()] if r.random() < 0.3 else [])]
        elif kind == "try":
            out += ["try:", *inner(), "except Error:", *inner()]
        elif kind == "finally":
            out += ["try:", *inner(), "finally:", *inner()]
        elif kind == "with":
            out += ["with manager():", *inner()]
        elif kind == "raise":
            out.append("if flip(): raise Error()")
        else:
            out.append(kind if kind != "return" else "return 0")
    return out


class Value:
    """A value that knows whether it is tainted."""

    def __init__(self, tainted):
        self.tainted = tainted

    def __add__(self, other):
        return Value(self.tainted or getattr(other, "tainted", False))

    __radd__ = __iadd__ = __add__


def hits_of_runs(body, r, runs=400):
    """Lines of eval that a tainted value reached in some random runs; any call may raise."""
    hits = set()

    class Error(Exception):
        pass

    def fail():
        if steps[0] > 300 or r.random() < 0.08:
            raise Error
        steps[0] += 1

    def sink(line, v):
        if v is not None and getattr(v, "tainted", False):
            hits.add(line)
        fail()

    class Manager:
        def __enter__(self):
            fail()

        def __exit__(self, *_):
            fail()
            return r.random() < 0.5

    def flip():
        fail()
        return r.random() < 0.5

    def items(v):
        fail()
        return [Value(getattr(v, "tainted", False))] * r.randint(0, 2)

    def pick(v):
        fail()
        return v

    code = "\n".join(["def f(a, request, x, y, z):", *(f"    {line}".replace("eval(", f"sink({n}, ").replace("'k'", "Value(False)") for n, line in enumerate(body, 2))])
    space = dict(Error=Error, Value=Value, Manager=Manager, manager=Manager, flip=flip, items=items, pick=pick, sink=sink, int=lambda v: Value(False))
    exec(code, space)
    for _ in range(runs):
        steps = [0]
        clean = [Value(False) for _ in range(3)]
        try:
            space["f"](Value(True), type("R", (), {"args": Value(True)})(), *clean)
        except Error:
            pass
    return hits


def test_every_run_is_covered(spark):
    """What any run shows, the analysis says; and it says nothing of code that no value reaches."""
    r = random.Random(11)
    bodies = [random_body(r) for _ in range(100)]
    docs = documents(spark, {f"m{i}.py": "\n".join(["def f(a, q, x, y, z):", *("    " + line for line in b)]) for i, b in enumerate(bodies)})
    # x, y and z are parameters here as well: only what comes from a and the request counts.
    said = {}
    for row in flow.tainted_sinks(docs).filter("entry in ('', 'a') and not cleaned").collect():
        said.setdefault(int(row["path"][1:].split(".")[0]), set()).add(row["line"])
    shown = {i: hits_of_runs(b, r) for i, b in enumerate(bodies)}
    assert all(lines <= said.get(i, set()) for i, lines in shown.items())
    total, seen = sum(map(len, said.values())), sum(map(len, shown.values()))
    assert seen > 30 and seen >= 0.8 * total


def graph_of(docs):
    each = lambda c: docs.select("path", F.explode(c).alias("symbol"))
    return graph.build_edges(each("calls"), each("defines")), each("defines")


def test_traces_over_cycles_and_keywords(spark):
    files = {"a.py": "from b import work\ndef start(q):\n    work(1, other=q)\n    work(q)\n", "b.py": "import a\ndef work(first, other=2):\n    again(other)\n    eval(int(first))\n\ndef again(p):\n    work(p, other=p)\n    last(p)\n\ndef last(s):\n    os.system(shlex.quote(s))\n    cursor.execute(query=s)\n"}
    docs = documents(spark, files).filter("symbol <> '<module>'")
    edges, defines = graph_of(docs)
    starts = docs.filter("symbol = 'start'").select("path", F.lit("q").alias("entry"))
    got = {r["category"]: (r["hops"], r["line"], r["trace"].count(">")) for r in flow.traces(docs, edges, defines, starts, 5).collect()}
    assert got == {"sql": (3, 12, 3)}
    assert flow.traces(docs, edges, defines, starts, 2).count() == 0 and flow.traces(docs, edges, defines, starts.limit(0), 2).count() == 0


@pytest.mark.parametrize("first,second,want", [("pass", "pass", "unguarded"), ("is_admin(r)", "pass", "guarded"), ("pass", "is_admin(r)", "guarded")])
def test_guards_on_ways(spark, first, second, want):
    text = f"@app.get('/x')\ndef top(r):\n    {first}\n    left(r)\n    right(r)\n\ndef left(r):\n    is_admin(r)\n    act(r)\n\ndef right(r):\n    {second}\n    act(r)\n\ndef act(r):\n    log(r)\n    delete(r)\n    right(r)\n\ndef alone(r):\n    update(r)\n"
    docs = documents(spark, {"m.py": text}).filter("symbol <> '<module>'")
    edges, defines = graph_of(docs)
    got = {(r["path"].split("::")[1].split("@")[0], r["line"]): (r["route"] and "top", r["status"]) for r in authorization.guard_comparison(docs, edges, defines, 4).collect()}
    assert got == {("act", 3): ("top", want), ("alone", 2): (None, "unreached")}


def test_context_reads_what_lies_behind_a_prefix(spark):
    """A sink at the end of a long document, and the lines that it depends on, come into the context of a candidate that leads there."""
    filler = "\n".join(f"    log('step {i} of the work that is done here, word by word')" for i in range(400))
    far = f"def helper(request):\n    param = request.args\n{filler}\n    cmd = param.name\n{filler}\n    subprocess.run(cmd, shell=True);\n"
    near = f"def entry(request):\n{filler}\n    check_permission(request)\n    helper(request)\n"
    docs = spark.createDataFrame([("a.py::entry@1-404", near), ("b.py::helper@1-805", far), ("c.py::other@1-2", "helper words\nabout check_permission"), ("d.py::none@1-1", ""), ("e.py::lead@1-1", "x")], "path string, text string")
    edges = spark.createDataFrame([("a.py::entry@1-404", "b.py::helper@1-805"), ("c.py::other@1-2", "e.py::lead@1-1")], "src string, dst string")
    cand = spark.createDataFrame([(1, "a.py::entry@1-404", "check_permission helper", 402)], "query_id int, path string, query string, line int")
    for mode, want in (("local", "a"), ("hybrid", "abce")):
        got = context.retrieve(docs, edges, cand, mode).orderBy("part", "rank").collect()
        assert "".join(r["path"][0] for r in sorted(got, key=lambda r: (r["part"] != "base", r["rank"]))) == want
        text = {r["path"][0]: r["text"] for r in got}
        assert "check_permission(request)" in text["a"] and context_tokens(text["a"]) <= 512
        if mode == "hybrid":
            assert "subprocess.run(cmd, shell=True);" in text["b"] and "param = request.args" in text["b"] and slices.OMITTED in text["b"]


def context_tokens(text):
    import re

    return len(re.findall(r"\w+|[^\w\s]", text))


def test_kept_lines_of_odd_texts(spark):
    texts = {"null": None, "empty": "", "plain": "a\nb", "source": "x = 1\ny = request.args", "sink": "eval(\n 'a;('\n);", "open": "eval(x", "loop": "a = b;\nb = a;\nrequest.args\nexec(a);", "case": "switch (k) {\n  bar = request.getParameter(q);\n}\n}\nsql = bar;\nst.executeQuery(sql);"}
    docs = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {}
    for r in slices.kept_lines(docs).collect():
        got.setdefault(r["path"], set()).add(r["i"])
    assert got == {"source": {1}, "sink": {0, 1, 2}, "open": {0}, "loop": {0, 1, 2, 3}, "case": {0, 1, 2, 4, 5}}
    assert slices.kept_lines(docs.limit(0)).count() == 0


def test_tree_digests(spark):
    """The same contents have the same digest however they lie; one change is seen, in its own repository only."""
    rows = [(f"r{i % 3}", f"text {i // 4}") for i in range(3000)] + [("r0", "hot")] * 500 + [("r1", None), (None, "x")]
    docs = spark.createDataFrame(rows, "repository_id string, text string")
    of = lambda df, **k: {r["repository_id"]: (r["rows"], r["digest"]) for r in identity.tree_digest(df, F.col("text"), ["repository_id"], **k).collect()}
    first = of(docs)
    assert of(spark.createDataFrame(rows[::-1], docs.schema).repartition(7)) == first and first["r0"][0] == 1500 and first[None][0] == 1
    changed = of(spark.createDataFrame([*rows[:-3], ("r0", "hut"), *rows[-2:]], docs.schema))
    assert changed["r0"] != first["r0"] and {k: v for k, v in changed.items() if k != "r0"} == {k: v for k, v in first.items() if k != "r0"}
    assert of(docs, depth=3) != first and of(docs.limit(0)) == {}
    cand = spark.createDataFrame([(1, "r0"), (2, "zz"), (3, None)], "id int, repository_id string")
    assert {r["id"]: r["source_digest"] for r in identity.subjects(cand, docs, F.col("text")).collect()} == {1: first["r0"][1], 2: None, 3: first[None][1]}


def test_receivers_over_cycles_and_shadowing(spark):
    text = "class A(B):\n    x: C\n    def go(self):\n        self.x.act()\n        self.y.act()\n        self.up()\n        self.nothing()\n        self.z.act()\nclass B(A):\n    y: C\n    z: 'C'\n    def up(self):\n        self.x.act()\n    def act(self):\n        pass\nclass C(Missing):\n    def act(self):\n        pass\nclass D(A):\n    x: B\n    def run(self):\n        self.x.act()\n"
    docs = documents(spark, {"m.py": text, "bad.py": "class"})
    name = lambda p: p.split("::")[1].split("@")[0]
    assert {(name(r["src"]), name(r["dst"])) for r in receivers.receiver_edges(docs).collect()} == {("A.go", "C.act"), ("A.go", "B.up"), ("B.up", "C.act"), ("D.run", "B.act")}


def test_json_budgets(spark):
    """Items cut, passed over and taken as a plain greedy search over real JSON does, for tokens and for bytes."""
    import json
    import re

    r = random.Random(3)
    alphabet = ["word", "two", "_x1", " ", " ", "\n", "\t", '"', "\\", "é", "ß", "—", "😀", "\x01", "\u00a0", ".", "(", "漢字", "\u2028", "b"]
    texts = ["", None, "   "] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(200)]
    rows = [(i // 5, r.randint(0, 3), f"e{i}", None if i % 3 else i % 4, f"p/é{i}", "graph", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id int, rank int, evidence_id string, graph_distance int, path string, retrieval string, text string")
    render = lambda items: json.dumps({"candidate": "c", "retrieved_code": items}, sort_keys=True, separators=(",", ":"))
    frame = render([])
    for unit, low in (("tokens", 40), ("bytes", 150)):
        count = (lambda t: len(re.findall(r"\w+|[^\w\s]", t))) if unit == "tokens" else (lambda t: len(t.encode()))
        limit = lambda q: low + q * 7
        want = {}
        for q in {x[0] for x in rows}:
            taken, kept = [], {}
            for _, _, eid, d, p, how, t in sorted((x for x in rows if x[0] == q), key=lambda x: (x[1], x[2]))[:4]:
                t = t or ""
                ends = [m.end() for m in re.finditer(r"\w+|[^\w\s]", t)] if unit == "tokens" else list(range(1, len(t) + 1))
                item = lambda s: dict(evidence_id=eid, graph_distance=d, path=p, retrieval=how, text=s)  # noqa: B023, E731
                fits = [s for s in (t, *(t[:e] for e in ends[::-1])) if count(render([*taken, item(s)])) <= limit(q)]
                if fits and (fits[0] or not t):
                    taken.append(item(fits[0]))
                    kept[eid] = fits[0]
            want[q] = (sorted(kept.values()), count(render(taken)))
        got = {}
        for x in budgets.fitted(df, low + F.col("query_id") * 7, F.lit(frame), top_k=4, unit=unit).collect():
            texts_, _ = got.setdefault(x["query_id"], ([], x["total"]))
            texts_.append(x["text"])
        assert {q: (sorted(t), n) for q, (t, n) in got.items()} == {q: w for q, w in want.items() if w[0]}
    with pytest.raises(Exception, match="descriptor exceeds"):
        budgets.fitted(df, F.lit(3), F.lit(frame)).collect()


def test_lookups_that_hold(spark):
    text = "async def f(user_id, k, s):\n    a = await s.db.get(T, k)\n    b = s.db.get(T, {k: user_id})\n    if a.tenant_id == 1 and b.tenant_id in x: pass\n    await s.db.delete(a)\n    b = s.db.get(T, 1)\n    s.db.delete(b)\n    s.other.delete(a)\n    for s in x: pass\n    s.db.delete(b)\n    a, c = 1, s.db.get(T, k)\n    s.db.delete(a)\n    raise E\n    b = s.db.get(T, k)\n    s.db.delete(b)\n"
    docs = documents(spark, {"m.py": text, "bad.py": "def", "none.py": ""})
    got = sorted((r["resource"], r["lookup_line"], r["operation_line"], r["keys"], r["comparisons"]) for r in authorization.resource_operations(docs).collect())
    assert got == [("a", 2, 5, "k", "a.tenant_id == 1"), ("b", 6, 7, "", "")]
