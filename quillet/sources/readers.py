"""Sources: code repositories, JSON lines, truth tables in CSV, logs in sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.identity import tree_digest

# Folders that no scan enters, and languages by file suffix.
SKIPPED = (".git", ".venv", "venv", "node_modules", "__pycache__", "vendor", "build", "dist")
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rb": "ruby", "sh": "shell", "yaml": "yaml", "yml": "yaml"}


def source_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = tuple(LANGUAGES), *, most_bytes: int | None = None) -> DataFrame:
    """(path relative to root, content, sha256, language) of a tree's source files, without skipped folders.

    The suffix filter is the reader's glob; paths with `..` never occur below a root.
    """
    glob = "*.{" + ",".join(suffixes) + "}" if len(suffixes) > 1 else f"*.{suffixes[0]}"
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    below = F.expr(f"substring_index(path, '{top}/', -1)")
    rows = files.select(below.alias("path"), "content", "length")
    rows = rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in SKIPPED])))
    if most_bytes is not None:
        rows = rows.filter(F.col("length") <= most_bytes)
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    language = F.try_element_at(names, F.lower(F.element_at(F.split("path", r"\."), -1)))
    return rows.select("path", "content", F.sha2("content", 256).alias("sha256"), language.alias("language"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row (fingerprint, files): the digest of the tree over the paths and digests of all files; no row for no files."""
    return tree_digest(files, F.concat_ws("\0", "path", "sha256")).select(F.col("digest").alias("fingerprint"), F.col("rows").alias("files"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def entries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables from one read: what a detector may see (entry, repository, commit) and labels for the evaluator only."""
    twice = F.count("*").over(Window.partitionBy("entry_id"))
    error = F.raise_error(F.concat(F.lit("duplicate entry "), F.col("entry_id"))).cast("boolean")
    checked = rows.withColumn("n_", twice).filter(F.when(F.col("n_") > 1, error).otherwise(True)).drop("n_")
    hidden = [c for c in rows.columns if c not in ("repo_url", "commit")]
    return checked.select("entry_id", "repo_url", "commit"), checked.select(*hidden)


def truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, category, vulnerable, cwe) of an expected-results file whose header stands in a comment line.

    Headers are matched by name, trimmed, in lower case; TRUE, 1 and yes are true; a missing category is `unknown`
    and a missing weakness 0.
    """
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"))
    heads = text.filter(F.lower("line").rlike("^#.*test name.*real vulnerability")).select("line").head(1)
    names = [c.strip().lower() for c in heads[0]["line"].lstrip("# ").split(",")] if heads else ["test name", "category", "real vulnerability", "cwe"]
    cells = F.split("line", r"\s*,\s*")
    at = lambda name: F.nullif(F.trim(F.get(cells, F.lit(names.index(name)))), F.lit("")) if name in names else F.lit(None).cast("string")
    rows = text.filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    return rows.select(at("test name").alias("case_id"), F.coalesce(at("category"), F.lit("unknown")).alias("category"), F.lower(at("real vulnerability")).isin("true", "1", "yes").alias("vulnerable"), F.coalesce(at("cwe").try_cast("int"), F.lit(0)).alias("cwe"))


def log_sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, title, body, config): a log cut at lines that begin with `=== `; config is the last request's, carried on to responses."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "(?m)^=== ")).alias("section", "part"))
    rows = whole.filter("section > 0").select("file", "section", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("title"), F.regexp_replace("part", r"^[^\n]*\n?", "").alias("body"))
    own = F.when(F.col("title").startswith("API REQUEST"), F.get_json_object("body", "$.generationConfig"))
    order = Window.partitionBy("file").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("config", F.last(own, ignorenulls=True).over(order))


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
