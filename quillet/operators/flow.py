"""Taint through code as rows: within a document over its control flow, across documents over the call graph.

A fact is a name that may be tainted just before a step that touches it, or at the end of a run. Facts move past a
step that leaves the name alone, into the names that a step writes, or over a run's end to the first step behind it
that touches the name. So a fact skips what does not concern it. They never leave their document: one row has all
its steps, and a task follows them there until nothing new comes (`Walk`), with no shuffle. Categories of sinks are
bits of one number: a sanitizer clears those it makes safe, a fact that brings no new bit is dropped. One more bit is
never cleared: with it and without the sink's own, a value has been cleaned on every way. The bits of all entries of
a document lie in one number, side by side, so they move together.

Only arguments of calls leave a document. Ways over documents are followed from the sinks back, so that what callees
lead to is found once for all their callers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.python_code import last_parts, qualified
from ..sources.staging import stage_facts as stage
from .rules import SINK_RULES, SOURCE_RULES

CATEGORIES = list(SINK_RULES)
BIT = {c: 1 << i for i, c in enumerate(CATEGORIES)}
#: All categories and the bit that says: tainted once, cleaned or not.
RAW = 1 << len(CATEGORIES)
ALL = 2 * RAW - 1
#: Behind the last step of a run.
END = 2**31 - 1
#: The entry of facts that a document's own sources make.
OWN = ""
# What makes an argument safe for which categories; the argument that a sink is about, by keyword; programs whose arguments are data.
CLEANERS = {"shlex.quote": ["command-execution"], "shellescape": ["command-execution"], "escapeShellArg": ["command-execution"], "int": ["command-execution", "code-execution", "sql"]}
SINK_KEYWORD = {"sql": "query", "path-access": "file", "code-execution": "source", "command-execution": "args", "outbound-request": "url"}
ORDINARY_PROGRAMS = ["echo"]
RUNNERS = r"subprocess\.(?:run|call|Popen|check_call|check_output|getoutput|getstatusoutput)|os\.(?:system|popen)"
#: Columns of facts that taint is followed over.
FACTS = ["path", "params", "aliases", "called", "reads", "writes", "nexts", "entries"]
#: Bits that each entry of a document has, and rows of documents that a task holds as Python objects at once.
WIDTH, ROWS = len(CATEGORIES) + 1, 256
GIVEN = pa.schema([("path", pa.string()), ("entry", pa.string()), ("call", pa.int32()), ("slot", pa.string()), ("bits", pa.int32())])


def _cleaned(through: Column) -> Column:
    """The bits that the calls around a value clear."""
    bits = [F.when(F.array_contains(through, n), sum(BIT[c] for c in cats)).otherwise(0) for n, cats in CLEANERS.items()]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _any(text: Column, rules: dict[str, str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [text.rlike(p) for p in rules.values()]), F.lit(False))


def _or(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.bit_or("bits").alias("bits")).filter("bits <> 0")


def laid_out(facts: DataFrame) -> DataFrame:
    """(path, starts, reads, writes, nexts), one row a document: what a walk needs, judged by the rules."""
    read = lambda r: F.struct(r["run"], r["step"], r["to"], r["call"], r["slot"], r["src"], (r["kind"] == "name").alias("name"), F.lit(ALL).bitwiseXOR(_cleaned(r["through"])).alias("keep"))
    counts = F.filter("reads", lambda r: (r["kind"] == "name") | ((r["kind"] == "text") & _any(r["src"], SOURCE_RULES)))
    starts = F.flatten(F.transform("entries", lambda run: F.transform("params", lambda name: F.struct(run.alias("run"), name.alias("name")))))
    lists = {"starts": starts, "reads": F.transform(counts, read), "writes": F.col("writes"), "nexts": F.col("nexts")}
    # Rows of one path are one document; where there are none, nothing is shuffled.
    shared = stage(facts.groupBy("path").count().filter("count > 1 and path is not null").select("path"), "shared-paths")
    rows = facts.filter("path is not null").select("path", *[c.alias(n) for n, c in lists.items()])
    if shared.isEmpty():
        return rows
    merged = rows.join(shared, "path", "left_semi").groupBy("path").agg(*[F.flatten(F.collect_list(n)).alias(n) for n in lists])
    return rows.join(shared, "path", "left_anti").union(merged)


class Walk:
    """What may be tainted in one document: facts (run, step that touches the name or END, name) with the bits of all entries."""

    def __init__(self, starts: list[tuple], reads: list[tuple], writes: list[tuple], nexts: list[tuple]):
        self.reads = reads
        self.first: dict[tuple, int] = {}
        self.facts: dict[tuple, int] = {}
        self.waiting: dict[tuple, int] = {}
        self.entries = {OWN: 0}
        for _, name in starts:
            self.entries.setdefault(name, WIDTH * len(self.entries))
        self.every = sum(1 << at for at in self.entries.values())
        touched: dict[tuple, dict[int, bool]] = defaultdict(dict)
        for run, step, _, _, _, src, is_name, _ in reads:
            if is_name:
                touched[run, src].setdefault(step, False)
        for run, step, name in writes:
            touched[run, name][step] = True
        behind, steps, runs = {}, defaultdict(list), defaultdict(set)
        for (run, name), at in touched.items():
            order = sorted(at)
            self.first[run, name] = order[0]
            for step, after in zip(order, [*order[1:], END]):
                behind[run, step, name] = after
                if not at[step]:
                    steps[run, step, name].append(((run, after, name), ALL * self.every))
        for run, after in nexts:
            runs[run].add(after)
        for run, name in starts:
            self.enter(run, name, ALL << self.entries[name])
        for run, step, to, _, _, src, is_name, keep in reads:
            after = behind.get((run, step, to))
            if after is not None and is_name:
                steps[run, step, src].append(((run, after, to), keep * self.every))
            elif after is not None:
                self.add((run, after, to), keep)
        while self.waiting:
            (run, at, name), bits = self.waiting.popitem()
            if at == END:
                for to in runs[run]:
                    self.enter(to, name, bits)
            else:
                for to, keep in steps[run, at, name]:
                    self.add(to, bits & keep)

    def enter(self, run: int, name: str, bits: int) -> None:
        self.add((run, self.first.get((run, name), END), name), bits)

    def add(self, fact: tuple, bits: int) -> None:
        fresh = bits & ~self.facts.get(fact, 0)
        if fresh:
            self.facts[fact] = self.facts.get(fact, 0) | fresh
            self.waiting[fact] = self.waiting.get(fact, 0) | fresh

    def given(self) -> Iterator[tuple[str, int, str, int]]:
        """(entry, call, slot, bits) of the arguments that may be tainted."""
        found: dict[tuple, int] = defaultdict(int)
        for run, step, _, call, slot, src, is_name, keep in self.reads:
            if call is not None:
                found[call, slot] |= self.facts.get((run, step, src), 0) & keep * self.every if is_name else keep
        for (call, slot), bits in found.items():
            for entry, at in self.entries.items():
                if own := bits >> at & ALL:
                    yield entry, call, slot, own


def _tuples(column: pa.ListArray) -> Iterator[list[tuple]]:
    """The lists of structs of a column, structs as tuples."""
    rows, at = list(zip(*[c.to_pylist() for c in column.flatten().flatten()])), 0
    for n in column.value_lengths().to_pylist():
        yield rows[at : at + n]
        at += n


def arguments(facts: DataFrame, params: bool = True) -> DataFrame:
    """(path, entry, call, slot, bits): the arguments that may be tainted, by the entry that they come from.

    entry is a parameter, or OWN for the document's own sources.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                path, *lists = b.slice(at, ROWS).columns
                out = [(p, *row) for p, starts, *rest in zip(path.to_pylist(), *map(_tuples, lists)) for row in Walk(starts if params else [], *rest).given()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), GIVEN)], schema=GIVEN)

    return stage(laid_out(facts).mapInArrow(run, "path string, entry string, call int, slot string, bits int"), "arguments")


def calls_of(facts: DataFrame) -> DataFrame:
    """(path, call, line, symbol, args, keywords, shell, program) of every call; symbol with its imports resolved."""
    rows = facts.select("path", "aliases", F.inline("called"))
    return rows.select("path", "call", "line", qualified(F.col("name"), F.col("aliases")).alias("symbol"), "args", "keywords", "shell", "program")


def sinks(facts: DataFrame) -> DataFrame:
    """(path, call, line, symbol, category, slot): calls of sinks and the argument that counts.

    That is the first, or by keyword where none is given by place. Arguments of a fixed ordinary program, run without
    a shell, are data.
    """
    text = F.concat("symbol", F.lit("("))
    hit = F.filter(F.array(*[F.when(text.rlike(p), F.lit(c)) for c, p in SINK_RULES.items()]), lambda c: c.isNotNull())
    program = F.lower(F.regexp_extract(F.col("program"), r"[^/\\]*$", 0))
    data = F.coalesce(F.col("symbol").rlike(f"^(?:{RUNNERS})$") & ~F.col("shell") & program.isin(*ORDINARY_PROGRAMS), F.lit(False))
    rows = calls_of(facts).select("*", F.explode(hit).alias("category"))
    keyword = F.element_at(F.create_map(*[F.lit(x) for kv in SINK_KEYWORD.items() for x in kv]), F.col("category"))
    slot = F.when((F.col("category") == "command-execution") & data, None).when(F.col("args") > 0, "0").otherwise(keyword)
    return rows.select("path", "call", "line", "symbol", "category", slot.alias("slot"))


def _bit(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in BIT.items() for x in kv]), category)


def tainted_sinks(facts: DataFrame, *, params: bool = True) -> DataFrame:
    """(path, line, symbol, category, entry, cleaned): sinks that tainted values reach, by the entry that they come from.

    entry is a parameter's name or empty for the document's own sources; cleaned says that every way passes a
    sanitizer for the sink's category. Defined cases: documents that do not parse have no facts, hence no rows;
    documents of one path are one document; nested functions are documents of their own.
    """
    return _sink_hits(facts, arguments(facts, params))


def _sink_hits(facts: DataFrame, given: DataFrame) -> DataFrame:
    hit = sinks(facts).join(given, ["path", "call", "slot"]).withColumn("own", F.col("bits").bitwiseAND(_bit(F.col("category"))))
    hit = hit.groupBy("path", "line", "symbol", "category", "entry").agg(F.bit_or("own").alias("own"))
    return hit.select("path", "line", "symbol", "category", "entry", (F.col("own") == 0).alias("cleaned"))


def passed_on(facts: DataFrame, given: DataFrame, edges: DataFrame, defines: DataFrame) -> DataFrame:
    """(path, entry, to, param, bits): parameters of other documents that a document's tainted arguments reach.

    edges (src, dst) is the call graph; a call belongs to an edge when the last part of its name is that of one of
    the definitions (path, symbol) of the edge's end. Arguments meet parameters by place or by keyword.
    """
    ends = edges.join(defines.select(F.col("path").alias("dst"), last_parts(F.col("symbol"), 1).alias("last")).distinct(), "dst").select(F.col("src").alias("path"), F.col("dst").alias("to"), "last")
    calls = calls_of(facts).select("path", "call", last_parts(F.col("symbol"), 1).alias("last"))
    named = facts.select(F.col("path").alias("to"), F.posexplode("params").alias("place", "param"))
    slots = named.select("to", F.col("place").cast("string").alias("slot"), "param").union(named.select("to", F.col("param").alias("slot"), "param"))
    return _or(given.join(calls, ["path", "call"]).join(ends, ["path", "last"]).join(slots, ["to", "slot"]), ["path", "entry", "to", "param"])


def traces(facts: DataFrame, edges: DataFrame, defines: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """(start, category, hops, trace, line, symbol): the first witness that taint reaches a sink, for each start and category.

    starts has (path, entry): the documents to begin in and the parameters that are tainted there; each begins with
    its own sources as well. Witnesses are ordered by hops, then by trace (documents joined by ` > `), line and symbol.
    The first of a document, entry and category starts with the document and goes on with the first of where it leads,
    so each has one row and is found from its ends: rows don't grow with the starts that lead to a sink.
    """
    given = arguments(facts)
    moves = stage(passed_on(facts, given, edges, defines), "passed-on")
    key, way = ["path", "entry", "category"], F.struct("hops", "trace", "line", "symbol").alias("way")
    ends = _sink_hits(facts, given).filter("not cleaned").select(*key, F.lit(0).alias("hops"), F.col("path").alias("trace"), "line", "symbol")
    new = stage(ends.groupBy(*key).agg(F.min(way).alias("way")), "ways")
    found = new
    # What reaches a document finds its own sources there as well.
    moves = moves.select("path", "entry", "to", F.explode(F.array("param", F.lit(OWN))).alias("at"), "bits")
    for hop in range(1, max_hops + 1):
        last = new.select(F.col("path").alias("to"), F.col("entry").alias("at"), "category", "way.trace", "way.line", "way.symbol")
        step = moves.join(last, ["to", "at"]).filter(F.col("bits").bitwiseAND(_bit(F.col("category"))) != 0)
        step = step.select(*key, F.lit(hop).alias("hops"), F.concat_ws(" > ", "path", "trace").alias("trace"), "line", "symbol")
        step = step.groupBy(*key).agg(F.min(way).alias("way"))
        new = stage(step.join(found.select(*key), key, "left_anti"), "ways")
        if new.isEmpty():
            break
        found = found.union(new)
    begin = starts.select("path", "entry").union(starts.select("path", F.lit(OWN))).distinct()
    first = begin.join(found, ["path", "entry"]).groupBy(F.col("path").alias("start"), "category").agg(F.min("way").alias("way"))
    return first.select("start", "category", "way.hops", "way.trace", "way.line", "way.symbol")
