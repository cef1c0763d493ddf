"""Guards between routes and sensitive actions, as reachability in the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.python_code import last_parts
from . import graph
from .flow import calls_of
from .rules import GUARD, PRINCIPAL, SENSITIVE_ACTION, lines

# Parameters and fields that name an owner.
OWNERS = ["user_id", "owner_id", "tenant_id"]
DEFINITION = r"^\s*(?:(?:async\s+)?def|function|func)\b"


def action_lines(docs: DataFrame) -> DataFrame:
    """(path, line) of sensitive actions in documents (path, text), by line; decorators and definitions run when an endpoint is made and don't count."""
    rows = lines(docs.select("path", "text"))
    begins = rows.filter(F.col("code").rlike(DEFINITION)).groupBy("path").agg(F.min("line").alias("begin"))
    acts = rows.filter(F.col("code").rlike(SENSITIVE_ACTION) & ~F.col("code").rlike(DEFINITION))
    return acts.join(begins, "path", "left").filter("coalesce(line > begin, true)").select("path", "line")


def first_guards(docs: DataFrame) -> DataFrame:
    """(path, guard): the first line of a document on which a guard stands."""
    return lines(docs.select("path", "text")).filter(F.col("code").rlike(GUARD)).groupBy("path").agg(F.min("line").alias("guard"))


def call_lines(facts: DataFrame, edges: DataFrame, defines: DataFrame) -> DataFrame:
    """edges (src, dst) with boundary: the first line of src that calls dst by the last part of a name; null where none does."""
    names = edges.join(defines.select(F.col("path").alias("dst"), last_parts(F.col("symbol"), 1).alias("last")).distinct(), "dst")
    rows = calls_of(facts).join(facts.select("path", "start_line"), "path")
    calls = rows.select(F.col("path").alias("src"), last_parts(F.col("symbol"), 1).alias("last"), (F.col("line") - F.col("start_line") + 1).alias("line"))
    first = names.join(calls, ["src", "last"]).groupBy("src", "dst").agg(F.min("line").alias("boundary"))
    return edges.select("src", "dst").distinct().join(first, ["src", "dst"], "left")


def guard_comparison(facts: DataFrame, edges: DataFrame, defines: DataFrame, max_hops: int) -> DataFrame:
    """(route, path, line, status) of sensitive actions: `unguarded` where a way of calls from the route meets no guard, else `guarded`.

    A document's first guard covers what comes behind it: its own later lines, and the calls that it makes later. So a
    way is free of guards if all its calls are made before their document's first guard, and no paths need to be
    listed: what a route reaches over such calls alone, within max_hops, is what it reaches unguarded. An action that
    no route reaches is `unreached`, with a null route. Documents without routes start nothing; cycles end.
    """
    acts, guards = action_lines(facts), first_guards(facts)
    own = acts.join(guards, "path", "left").select("path", "line", F.coalesce(F.col("guard") < F.col("line"), F.lit(False)).alias("covered"))
    called = call_lines(facts, edges, defines).join(guards.select(F.col("path").alias("src"), "guard"), "src", "left")
    free = called.filter("coalesce(guard >= boundary, true)").select("src", "dst")
    routes = facts.filter(F.size("routes") > 0).select("path")
    reach = graph.distances(routes, edges, max_hops).select(F.col("seed").alias("route"), "path")
    bare = graph.distances(routes, free, max_hops).select(F.col("seed").alias("route"), "path", F.lit(True).alias("bare"))
    found = own.join(reach, "path", "left").join(bare, ["route", "path"], "left")
    status = F.when(F.col("route").isNull(), "unreached").when(F.col("bare") & ~F.col("covered"), "unguarded").otherwise("guarded")
    return found.select("route", "path", "line", status.alias("status"))


def resource_operations(facts: DataFrame) -> DataFrame:
    """(path, resource, lookup, lookup_line, keys, operation, operation_line, principals, comparisons) of deletes of what was looked up.

    A lookup, `name = store.get(kind, key)`, holds from its statement to the next one that binds the name or a name of
    the store anew; a delete, `store.delete(name)`, belongs to the lookup that holds there. keys are the parameters in
    the lookup's key, comparisons the comparisons of the name's owner fields while it holds. Lines count from the
    document's first; lists are joined by ` | `, in order of place, names by name. Only a function's own statements
    up to the first return or raise count, as facts of what the text says, not of what it permits.
    """
    place = lambda r: F.col(f"{r}.line") - F.col("start_line") + 1
    calls = facts.select("path", "start_line", "params", F.explode("sequence").alias("s"))
    lookup = calls.filter("s.method = 'get' and size(s.args) = 2 and s.keywords = 0 and s.to <> ''")
    lookup = lookup.select("path", "params", F.col("s.to").alias("resource"), F.col("s.at").alias("since"), place("s").alias("lookup_line"), F.col("s.on").alias("store"), F.array_union("s.roots", F.array("s.to")).alias("names"), F.array_join(F.array_intersect("s.keys", "params"), " | ").alias("keys"))
    delete = calls.filter("s.method = 'delete' and size(s.args) = 1 and s.to is null").select("path", F.element_at("s.args", 1).alias("resource"), F.col("s.on").alias("store"), F.col("s.at").alias("at"), place("s").alias("operation_line"))
    rebinds = facts.select("path", F.inline("rebinds")).select("path", "name", F.col("at").alias("bound"))
    ends = lookup.select("path", "since", "resource", F.explode("names").alias("name")).join(rebinds, ["path", "name"]).filter("bound > since").groupBy("path", "since", "resource").agg(F.min("bound").alias("until"))
    held = lookup.join(ends, ["path", "since", "resource"], "left")
    found = held.join(delete, ["path", "resource", "store"]).filter("since < at and coalesce(until > at, true)")
    compared = facts.select("path", F.inline("compared")).filter(F.col("field").isin(*OWNERS)).select("path", F.col("name").alias("resource"), F.col("at").alias("said"), "text")
    key = ["path", "resource", "since", "at"]
    said = found.select(*key).join(compared, ["path", "resource"]).filter("said > since and said <= at").groupBy(*key, "text").agg(F.min("said").alias("said"))
    said = said.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("said", "text"))), lambda x: x["text"]), " | ").alias("comparisons"))
    principals = F.array_join(F.array_sort(F.array_distinct(F.filter("params", lambda p: p.rlike(PRINCIPAL) | p.isin(*OWNERS)))), " | ")
    out = found.join(said, key, "left")
    return out.select("path", "resource", F.concat("store", F.lit(".get")).alias("lookup"), "lookup_line", "keys", F.concat("store", F.lit(".delete")).alias("operation"), "operation_line", principals.alias("principals"), F.coalesce("comparisons", F.lit("")).alias("comparisons"))
