"""Calls on objects of known classes: fields by their types, methods by inheritance, as joins over Python facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.python_code import last_parts, qualified, tail_of
from ..sources.staging import stage_facts as stage
from . import graph

#: Bases above a class, at most.
BASES = 16


def classes(facts: DataFrame) -> DataFrame:
    """(class, file, owner, known_as): every class that has a field, a base or a method; known_as lists its dotted names."""
    said = facts.select("file", "modules", "aliases", F.explode(F.concat(F.transform("fields", lambda x: x["owner"]), F.transform("bases", lambda x: x["owner"]), F.when(F.col("owner").isNotNull(), F.array("owner")).otherwise(F.expr("cast(array() as array<string>)")))).alias("owner"))
    return said.select(class_id(F.col("file"), F.col("owner")).alias("class"), "file", "owner", F.transform("modules", lambda m: F.concat_ws(".", m, "owner")).alias("known_as")).distinct()


def class_id(file: Column, owner: Column) -> Column:
    return F.concat(file, F.lit("::"), owner)


def _resolved(rows: DataFrame, known: DataFrame, said: str) -> DataFrame:
    """rows (file, aliases, `said`: a class as it is written) with `means`, the class; rows without one go.

    A name that the file imports is looked up by what it stands for, another one among the file's own classes.
    """
    full = rows.withColumn("full_", qualified(F.col(said), F.col("aliases"))).withColumn("here_", class_id(F.col("file"), F.col(said)))
    names = known.select(F.explode("known_as").alias("full_"), F.col("class").alias("means")).distinct()
    own = known.select(F.col("class").alias("here_"), F.col("class").alias("means")).distinct()
    imported = F.element_at("aliases", F.substring_index(said, ".", 1)).isNotNull()
    cols = rows.columns
    return full.filter(imported).join(names, "full_").select(*cols, "means").union(full.filter(~imported).join(own, "here_").select(*cols, "means"))


def receiver_edges(docs: DataFrame) -> DataFrame:
    """(src, dst): methods that functions call on self and on fields of self, from documents with their facts.

    A field's type is its annotation, the class it is set to an instance of, or the annotation of the parameter it is
    set to. Fields and methods are those of the class or of the nearest class above it; of classes equally near, the
    first by name. Cycles of bases end. Documents that do not parse, and fields without a known type, give no edge.
    """
    known = stage(classes(docs), "classes")
    up = _resolved(docs.select("file", "aliases", F.inline("bases")), known, "base")
    bases = up.select(class_id(F.col("file"), F.col("owner")).alias("src"), F.col("means").alias("dst")).distinct()
    above = stage(graph.distances(known.select(F.col("class").alias("path")).distinct(), bases, BASES).select(F.col("seed").alias("class"), F.col("path").alias("held_by"), "distance"), "bases")
    typed = _resolved(docs.select("file", "aliases", F.inline("fields")), known, "type").select(class_id(F.col("file"), F.col("owner")).alias("held_by"), "field", F.col("means").alias("type"))
    methods = docs.filter(F.col("owner").isNotNull() & F.col("symbol").endswith(F.concat(F.col("owner"), F.lit("."), last_parts(F.col("symbol"), 1)))).select(class_id(F.col("file"), F.col("owner")).alias("held_by"), last_parts(F.col("symbol"), 1).alias("method"), "path")

    def nearest(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
        """rows (class, key) with what the nearest class that has such a key holds."""
        order = Window.partitionBy("class", key).orderBy("distance", "held_by")
        held = above.join(found, "held_by")
        first = held.withColumn("rank_", F.rank().over(order)).filter("rank_ = 1").drop("rank_", "distance", "held_by").distinct()
        return rows.join(first, ["class", key])

    calls = docs.filter("owner is not null").select(F.col("path").alias("src"), class_id(F.col("file"), F.col("owner")).alias("class"), F.explode("called").alias("c")).filter(F.col("c.name").rlike(r"^self(?:\.\w+){1,2}$") & (F.col("c.place") == "body"))
    calls = calls.select("src", "class", tail_of(F.col("c.name")).alias("tail")).distinct()
    direct = calls.filter(~F.contains("tail", F.lit("."))).select("src", "class", F.col("tail").alias("method"))
    deep = calls.filter(F.contains("tail", F.lit("."))).select("src", "class", F.substring_index("tail", ".", 1).alias("field"), F.substring_index("tail", ".", -1).alias("method"))
    on_fields = nearest(deep, typed, "field").select("src", F.col("type").alias("class"), "method")
    return nearest(direct.union(on_fields), methods, "method").select("src", F.col("path").alias("dst")).filter("src <> dst").distinct()
