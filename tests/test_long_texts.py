"""Expressions over one text of very many lines or matches: right, and in time that grows with it."""

import re
import time

from pyspark.sql import functions as F

from quillet.functions import text as T
from quillet.operators import masks, rules


def test_scans_over_blocks(spark):
    for n in (0, 1, 63, 64, 65, 4096, 5000, 300_000):
        df = spark.range(1).select((F.when(F.lit(n) > 0, F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda i: ((i.cast("long") * 7919) % 13).cast("int"))).otherwise(F.array().cast("array<int>"))).alias("v"))
        got = df.select(T.running(F.col("v")).alias("s"), T.furthest(F.col("v")).alias("m"), "v").first()
        total, most, sums, tops = 0, 0, [], []
        for x in got["v"]:
            sums.append(total)
            tops.append(most)
            total, most = total + x, max(most, x)
        assert (got["s"], got["m"]) == (sums, tops)


def test_located_and_lines_of_a_long_text(spark):
    text = "é" + "".join(f"line {i} = os.system('x{i}')  # eval(y)\n" for i in range(200_000))
    docs = spark.createDataFrame([("a.py", "python", text), ("b.py", "python", ""), ("c.py", "python", "x\r\ny\n\n")], "path string, language string, text string")
    began = time.time()
    last = docs.filter("path = 'a.py'").select(F.element_at(T.located(F.col("text"), r"x\d+"), -1).alias("m"), F.size(T.located(F.col("text"), r"x\d+")).alias("n")).first()
    want = list(re.finditer(r"x\d+", text))[-1]
    assert (last["m"]["start"], last["m"]["stop"], last["m"]["value"], last["n"]) == (want.start(), want.end(), want[0], 200_000)
    assert rules.lines(docs.select("path", "text")).groupBy("path").count().collect() and {tuple(r) for r in rules.lines(docs.filter("path = 'c.py'").select("path", "text")).collect()} == {("c.py", 1, "x"), ("c.py", 2, "y"), ("c.py", 3, "")}
    found = masks.matches_outside(docs, {"command": r"os\.system\(", "eval": r"eval\("})
    assert {(r["rule"], r["n"]) for r in found.groupBy("rule").agg(F.count("*").alias("n")).collect()} == {("command", 200_000)}
    assert time.time() - began < 60


def test_spans_of_a_long_text(spark):
    text = "".join(f"ü{i:06d} secret{i:06d}; " for i in range(60_000))
    places = [(m.start(), m.end()) for m in re.finditer(r"secret\d+", text)] + [(5, 9), (4, 9)]
    rows = [(1, text, sorted(places)), (2, "abc", []), (3, "abc", [(0, 3)]), (4, "", []), (5, "a" * 9000, [(4000, 4200), (4095, 8192), (8192, 8193)])]
    df = spark.createDataFrame(rows, "id int, text string, spans array<struct<start:int,stop:int>>")
    began = time.time()
    got = {r["id"]: r["t"] for r in df.select("id", T.without_spans(F.col("text"), F.col("spans"), "[x]").alias("t")).collect()}
    out, at = [], 0
    for a, b in sorted(places):
        if a >= at:
            out += [text[at:a], "[x]"]
        at = max(at, b)
    assert got == {1: "".join(out) + text[at:], 2: "abc", 3: "[x]", 4: "", 5: "a" * 4000 + "[x]" + "[x]" + "a" * 807}
    assert time.time() - began < 30
