"""Steps whose work must grow with their input, held against plain versions."""

import random
import re
import time

from pyspark.sql import functions as F

from quillet.functions.python_code import python_documents
from quillet.operators import flow, graph, locate, retrieval
from quillet.plans import bindings
from quillet.sources import staging


def plain_nearest(points, spans):
    """For each point the best span of its file, every one looked at."""
    out = {}
    for pid, file, line, symbol in points:
        for sfile, own, first, last, path in spans:
            if file is not None and file == sfile:
                tier = 0 if own == symbol else 1 if None not in (line, first, last) and first <= line <= last else 2
                cost = None if None in ((line, first) if tier == 2 else (first, last)) else abs(first - line) if tier == 2 else last - first
                key = (tier, cost is not None, cost or 0, path)
                out[pid] = min(out.get(pid, key), key)
    return {pid: (key[3], key[0]) for pid, key in out.items()}


def test_nearest_document_odd_rows(spark):
    r = random.Random(5)
    maybe = lambda x: None if r.random() < 0.05 else x
    spans = [(maybe(f"f{r.randrange(4)}"), maybe(f"s{r.randrange(30)}"), maybe(a), maybe(a + r.choice([-3, 0, 5, 40, 700, 5000])), f"p{i}") for i, a in enumerate(r.choices(range(20000), k=200))]
    points = [(i % 250, maybe(f"f{r.randrange(5)}"), maybe(r.randrange(20000) - 10), maybe(f"s{r.randrange(60)}")) for i in range(300)]
    got = locate.candidate_document(spark.createDataFrame(points, "point_id long, file string, line long, symbol string"), spark.createDataFrame(spans, "file string, symbol string, first long, last long, path string"))
    assert {p: (path, tier) for p, path, tier in got.collect()} == plain_nearest(points, spans)


def test_nearest_document_one_large_file(spark):
    n = 60000
    ids = spark.range(n)
    spans = ids.select(F.lit("f").alias("file"), F.lit("s").alias("symbol"), (F.col("id") * 10).alias("first"), (F.col("id") * 10 + 4).alias("last"), F.format_string("p%06d", "id").alias("path"))
    points = ids.select(F.col("id").alias("point_id"), F.lit("f").alias("file"), (F.col("id") * 10 + 5 + F.col("id") % 5).alias("line"), F.lit("other").alias("symbol"))
    began = time.time()
    # Lines 5 to 9 of ten stand behind each span: 5 is as near to one begin as to the next, the others are nearer to the next.
    near = F.when((F.col("point_id") % 5 == 0) | (F.col("point_id") == n - 1), F.col("point_id")).otherwise(F.col("point_id") + 1)
    assert locate.candidate_document(points, spans).filter((F.col("path") != F.format_string("p%06d", near)) | (F.col("tier") != 2)).count() == 0
    assert time.time() - began < 60  # all pairs are 3.6 thousand million


def test_scores_add_up_without_a_shuffle_of_pairs(spark, sf_dir):
    queries = spark.createDataFrame([(i, f"src{i}/en word{i} alpha beta") for i in range(20)], "query_id long, query string")
    docs = spark.createDataFrame([(f"src{i % 7}/en/{i // 2}", f"alpha word{i % 20} beta gamma " * (i % 3)) for i in range(60)], "path string, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = retrieval.bm25(docs, queries, F.col("text"), F.col("query"))
    assert not re.search(r"hashpartitioning\((?:query_id|path)#\d+L?, \w+#", plan(found))
    scored = retrieval.tfidf(docs, queries, F.col("text"), F.col("query"), F.col("query").rlike("/"))
    # What a path holds of the queries' fragments is summed by query and path, and then laid beside the scores.
    assert len(re.findall(r"hashpartitioning\((?:query_id|path)#\d+L?, \w+#", plan(scored))) == 1


def test_small_files_of_many_rows_are_not_sent_to_the_driver(spark):
    rows = spark.range(2_000_000).select(F.concat(F.lit("a/long/name/of/a/file.py::f"), (F.col("id") % 1000).cast("string")).alias("path"), (F.col("id") % 7).alias("step"))
    once = staging.stage_facts(rows, "rows")  # some 3 MB of files, 150 MB of rows
    before = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    staging.stage_facts(once.join(once.withColumnRenamed("step", "other"), "path").filter("step < other - 6"), "joined")
    plan = spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()
    assert "Join" in plan and "Broadcast" not in plan
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == before


def test_requested_pairs_meet_scope_and_documents_in_bounded_tasks(spark, monkeypatch):
    """Statuses are those of the join by rows, null keys among them; partitions grow with the rows, and requests are not sorted for a join."""
    from quillet.operators import evidence

    pairs = "case_id long, path long"
    requests = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (2, 3), (None, 1), (3, None), (4, 9)], pairs)
    scope = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 3), (None, 1), (3, None), (5, 5)], pairs)
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "path long, other string")
    plain = evidence.admitted(requests.distinct(), scope, docs).select("case_id", "path", "status")
    monkeypatch.setattr(evidence, "PER_PART", 1)
    got = evidence.admitted_pairs(requests, scope, docs)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect())) and got.count() == 7
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan.split("== Physical Plan ==")[1]
    assert "RepartitionByExpression [case_id" in plan and ", 13" in plan


def plain_window(text, budget, query, fallback):
    """(center, first, last, n_tokens) of one text, with every line's tokens counted first."""
    lines = text.splitlines(keepends=True)
    counts = [len(re.findall(r"\w+|[^\w\s]", x)) for x in lines]
    words = lambda x: {w.lower() for w in re.findall("[A-Za-z_][A-Za-z0-9_]+", x)}
    near = min(max(fallback - 1, 0), len(lines) - 1)
    q, _, i = max((len(words(x) & words(query)), -abs(i - near), i) for i, x in enumerate(lines))
    center = i if q else near
    if sum(counts) <= budget:
        return center, 0, len(lines), sum(counts)
    first, last, n = center, center + 1, counts[center]
    grows = n < budget
    while grows:
        grows = False
        if first and n + counts[first - 1] <= budget:
            first, n, grows = first - 1, n + counts[first - 1], True
        if last < len(lines) and n + counts[last] <= budget:
            last, n, grows = last + 1, n + counts[last], True
    return center, first, last, min(n, budget)


def test_windows_count_tokens_near_the_centre(spark):
    """Windows are those of counting every line; all work on long texts takes less than five times as long as counting their tokens once."""
    from quillet.functions.text import context_token_count
    from quillet.operators import context

    r = random.Random(8)
    bits = ["the", "The", "DER", "9the", "a9the", "the_", "7 the7", "password", "x", "İ", "Key", "\n", "\n", "\r\n", "\x0b", "\x85", " ", "  ", "!", "é"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(1, 60))), r.choice([1, 2, 3, 5, 8, 20]), r.choice(["", "the der", "The the x key", "password 9the a9the"]), r.choice([-3, 1, 4, 50])) for i in range(1500)]
    odd = spark.createDataFrame(rows, "i int, text string, share int, query string, line int")
    got = {x[0]: tuple(x[1:]) for x in context.focused(odd, F.col("share"), F.col("query"), F.col("line")).select("i", "center", "first", "last", "n_tokens").collect()}
    assert got == {i: plain_window(t, n, q, line) for i, t, n, q, line in rows}

    text = "\n".join(" ".join(r.choices("alpha beta gamma delta other some".split(), k=12)) for _ in range(400))
    docs = spark.range(400).repartition(4).select(F.concat(F.lit(text), F.lit(" the "), F.col("id").cast("string")).alias("text")).localCheckpoint()

    def took(df):
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - began

    lines = docs.select(F.transform(F.split("text", "\n"), context_token_count).alias("n"))
    windows = context.focused(docs, 60, F.lit("the password"), F.lit(1)).select("center", "first", "last")
    for df in (lines, windows):
        took(df)
    assert min(took(windows) for _ in range(3)) < 5 * min(took(lines) for _ in range(3))


def functions(spark, files):
    docs = python_documents(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files], "path string, content binary"))
    return staging.stage(docs.filter("symbol <> '<module>'"), "functions")


def counted(monkeypatch):
    """Rows of each table that flow stages."""
    rows, plain = [], flow.stage

    def stage(df, name):
        out = plain(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(flow, "stage", stage)
    return rows


def test_taint_of_a_long_chain_takes_no_rounds(spark, monkeypatch):
    """Sixty names in a row are followed in one task; rows of one path are one document."""
    names = "".join(f"    x{i} = x{i - 1}\n" for i in range(1, 60))
    files = [("long.py", f"def f(a, b):\n    x0 = a\n{names}    while b:\n        eval(x59)\n        x59 = int(b)\n    os.system(x58)\n")]
    files += [("same.py", "def f(a, b):\n    x = b\n    y = 1\n"), ("same.py", "def f(a, b):\n    x = 1\n    eval(x)\n")]
    docs = functions(spark, files)
    staged = counted(monkeypatch)
    got = {(r["path"].split(".")[0], r["line"], r["entry"], r["cleaned"]) for r in flow.tainted_sinks(docs).collect()}
    assert got == {("long", 63, "a", False), ("long", 63, "b", True), ("long", 65, "a", False), ("same", 3, "b", False)}
    assert len(staged) < 5


def test_ways_from_many_starts_share_what_they_lead_to(spark, monkeypatch):
    """Starts that call one chain have a row each, not one for each document, entry and category behind them."""
    n = 40
    chain = "def one(p):\n    two(p)\n\ndef two(p):\n    three(p)\n    os.system(int(p))\n\ndef three(p):\n    one(p)\n    eval(p)\n    eval(p)\n"
    docs = functions(spark, [("z.py", chain), *[(f"s{i}.py", f"def start{i}(q):\n    one(q)\n    two(q)\n") for i in range(n)]])
    each = lambda c: docs.select("path", F.explode(c).alias("symbol"))
    edges = graph.build_edges(each("calls"), each("defines"))
    starts = docs.filter("symbol like 'start%'").select("path", F.lit("q").alias("entry"))
    staged = counted(monkeypatch)
    got = {tuple(r) for r in flow.traces(docs, edges, each("defines"), starts, 4).collect()}
    way = lambda i: f"s{i}.py::start{i}@1-3 > z.py::two@4-6 > z.py::three@8-11"
    assert got == {(f"s{i}.py::start{i}@1-3", "code-execution", 2, way(i), 10, "eval") for i in range(n)}
    assert sum(staged) < 10 * n


def test_documents_are_parsed_in_many_tasks(spark, sf_dir, monkeypatch):
    """A table of one file is dealt to tasks by its rows, none lost."""
    monkeypatch.setattr(bindings, "PER_TASK", 10)
    dealt = bindings.numbers(spark, sf_dir)
    plain = bindings.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    assert dealt.rdd.getNumPartitions() == plain.count() // 10 + 1 > plain.rdd.getNumPartitions()
    assert sorted(dealt.collect()) == sorted(plain.collect())
